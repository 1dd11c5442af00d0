"""Hard negatives against a plain version: every anchor against every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import negatives as N
from lakewarden.llm.queries import op12_hard_negatives

SCHEMA = "vec_id bigint, label bigint, vector array<bigint>, anchor boolean, uid int, score string, `list` int"


def plain(rows, positives=5, negatives=10):
    """Rows are (vec_id, label, vector, anchor); products of Python numbers."""
    used = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    order = lambda a: lambda b: (-score(a, b), b[0] is None, b[0] or 0)
    out = []
    for k, a in enumerate(used):
        if not a[3] or a[0] is None:
            continue
        others = [b for j, b in enumerate(used) if j != k]
        for p in sorted((b for b in others if b[1] == a[1]), key=order(a))[:positives]:
            ps = score(a, p)
            inside = [b for b in others if b[1] != a[1] and 30 * ps <= 100 * score(a, b) <= 90 * ps]
            out += [(a[0], p[0], rank, b[0], ps, score(a, b)) for rank, b in enumerate(sorted(inside, key=order(a))[:negatives], 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    out = N.hard_negatives(frame, F.col("anchor"), **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_many_lists_equal_a_plain_search(spark):
    draw = np.random.default_rng(2)
    middles = draw.normal(0, 40, (12, 8))
    rows = []
    for k in range(600):
        own = middles[k % 12] + draw.normal(0, 8, 8)
        rows.append((k, int(draw.integers(0, 3)), [int(x) for x in own], k % 20 == 0))
    rows += [(1000 + k, k % 2, rows[5][2], k % 50 == 0) for k in range(150)]  # one vector many times over
    rows += [rows[3], rows[20], rows[20], (None, 1, rows[7][2], True), (None, 2, rows[8][2], None)]
    expected = plain(rows)
    assert mined(spark, rows, list_rows=20, rounds=(1, 3)) == expected and len(expected) > 500
    lists = N.centroids(np.array([r[2] for r in rows]), 40)
    assert len(lists) > 12  # so the rounds had something to pass over


def test_odd_rows(spark):
    rows = [
        (0, 1, [3, 4], True), (1, 1, [2, 2, 9], False), (2, 1, [], False), (3, 2, [1, 2], False), (4, 2, [2], False), (5, None, [9, 9], True), (6, 1, None, True),
        (7, 2, [1, None], True), (8, 1, [-3, -4], True), (10, 3, [5, 5], True), (11, 1, [0, 0], True),
    ]
    assert mined(spark, rows) == plain(rows)
    far = [(12, 2, [1 << 40, 1], True), (13, 2, [0] * (N.MAX_WIDTH + 1), True)]
    assert mined(spark, rows + far) == plain(rows)
    for none in ([], [r[:3] + (False,) for r in rows], [(1, None, [1], True)]):
        assert mined(spark, none) == []


def test_all_rows_alike(spark):
    rows = [(k, k % 3 > 0, [2, 1], k == 7) for k in range(200)]
    rows = [(i, int(label), v, a) for i, label, v, a in rows] + [(500, 0, [1, 1], False)]
    assert mined(spark, rows, list_rows=10) == plain(rows)


def test_best_of_a_part_and_exact_products():
    draw = np.random.default_rng(3)
    scores, ids = draw.integers(0, 6, (20, 50)), draw.permutation(50)
    allowed, low, high = draw.random((20, 50)) < 0.7, draw.integers(0, 3, 20), draw.integers(2, 6, 20)
    query, row = N.best_of_part(scores, allowed, ids, low, high, 7)
    for q in range(20):
        good = [j for j in range(50) if allowed[q, j] and low[q] <= scores[q, j] <= high[q]]
        assert row[query == q].tolist() == sorted(good, key=lambda j: (-scores[q, j], ids[j]))[:7]
    big = draw.integers(-(1 << 27), 1 << 27, (4, 8))
    assert N.products(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]


def test_bounds_hold_and_visits_stop_strictly_below_the_kth_score():
    draw = np.random.default_rng(4)
    rows, queries = draw.integers(-50, 50, (300, 5)), draw.integers(-50, 50, (30, 5))
    middle = N.centroids(rows, 10)
    nearest = N.nearest_list(rows.astype(float), middle)
    radius = np.array([np.sqrt(((rows[nearest == k] - middle[k]) ** 2).sum(axis=1)).max(initial=0) for k in range(10)])
    lower, upper = N.bounds(queries, middle, radius)
    scores = queries @ rows.T
    assert (scores <= upper[:, nearest]).all() and (scores >= lower[:, nearest]).all()
    low, high = np.array([0.0, -9.0, 2.0, 1.0]), np.array([5.0, 3.0, 9.0, 4.0])
    window = [{"slot": 1, "low": 2, "high": 8}]
    none = np.empty(0, dtype=np.int64)
    assert N.wanted_lists(low, high, window, {}, none, None).tolist() == [2, 0, 3, 1]
    assert N.wanted_lists(low, high, window, {1: 4}, none, None).tolist() == [2, 0, 3]  # an equal bound is visited
    assert N.wanted_lists(low, high, window, {1: 5}, np.array([2]), None).tolist() == [0]
    assert N.wanted_lists(low, high, [{"slot": 1, "low": 6, "high": 8}], {}, none, 1).tolist() == [2]
    assert N.wanted_lists(low, high, [{"slot": 1, "low": -8, "high": -1}], {}, none, None).tolist() == [1]


@pytest.mark.parametrize("shuffle", [False, True])
def test_query_equals_a_plain_version(spark, sf_dir, tmp_path, shuffle):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if shuffle:
        odd = spark.sql("SELECT 901L vec_id, 3 label, array(float('nan'), 1f) embedding UNION ALL SELECT 902L, 3, array(float('infinity')) UNION ALL SELECT 903L, 3, NULL UNION ALL SELECT 904L, NULL, array(1f)")
        table.unionByName(odd).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
        sf_dir = str(tmp_path)
    rows = []
    for r in table.collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * x)) for x in r.embedding], r.vec_id % 100 == 0))
    assert sorted((tuple(r) for r in op12_hard_negatives(spark, sf_dir).collect()), key=repr) == plain(rows)
