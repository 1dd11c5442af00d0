"""Range joins against every pair."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import intervals, steps
from lakewarden.operators.catalog import Catalog, ConstraintError
from lakewarden.operators.intervals import RangeJoin, comparisons, conjuncts


def test_conjuncts_and_comparisons():
    assert conjuncts("a.x BETWEEN b.y AND b.z AND a.k <> 'AND' AND (a.p < b.q)") == ["a.x BETWEEN b.y AND b.z", "a.k <> 'AND'", "a.p < b.q"]
    assert conjuncts("((a.x < b.y) AND (a.z > b.y OR a.z IS NULL))") == ["a.x < b.y", "a.z > b.y OR a.z IS NULL"]
    assert conjuncts("a.x < b.y OR a.x > 3 AND b.y > 1") == ["a.x < b.y OR a.x > 3 AND b.y > 1"]
    assert conjuncts("(a.x + 1) < (b.y)") == ["(a.x + 1) < (b.y)"]
    assert comparisons("a.x BETWEEN b.y - 1 AND b.y + 1") == [("a.x", ">=", "b.y - 1"), ("a.x", "<=", "b.y + 1")]
    assert comparisons("CASE WHEN a.x = 1 THEN 2 ELSE 3 END <= b.y") == [("CASE WHEN a.x = 1 THEN 2 ELSE 3 END", "<=", "b.y")]
    for other in ("a.x NOT BETWEEN b.y AND b.z", "a.x < b.y OR a.x > b.z", "a.x IN (1, 2)", "a.x <> b.y", "NOT a.x < b.y", "a.x LIKE '<='", "f(a.x, b.y)"):
        assert comparisons(other) == []


def test_what_is_a_range_join(spark):
    a, b = spark.range(3).selectExpr("id AS x", "id AS y", "'t' AS t"), spark.range(3).selectExpr("id AS lo", "id AS hi", "'t' AS u")
    of = lambda text: RangeJoin.of("a", a, "b", b, text)
    for text in ("a.x = b.lo AND a.x < b.hi", "a.t <> b.u", "a.x < 5", "a.x < b.lo OR a.x > b.hi", "a.x < b.u", "abs(a.x - b.lo) < 2"):
        assert of(text) is None, text
    condition = of("a.x BETWEEN b.lo AND b.hi AND a.y > 1 AND b.hi < 9 AND a.t <> b.u").condition
    assert (condition.low.target, condition.low.strict, condition.high.target) == ("b.hi", False, "b.lo")
    assert (condition.source_only, condition.target_only, condition.rest) == (["a.y > 1"], ["b.hi < 9"], ["a.t <> b.u"])
    # The two comparisons with one expression of the target make it a point; the third is checked by pair.
    condition = of("a.x <= b.hi AND a.x < b.lo AND a.y > b.lo").condition
    assert (condition.low.target, condition.high.target, condition.rest) == ("b.lo", "b.lo", ["a.x <= b.hi"])


CONDITIONS = {
    "t.a > s.a AND t.a <= s.b": 100, "s.a BETWEEN t.a AND t.b": 6, "s.a <= t.b AND s.b >= t.a AND s.k > 1 AND t.k < 4": 6, "s.a < t.a": 100,
    "s.a < t.b AND s.b > t.a AND s.k <> t.k": 6,
}


def table(draw, n, wide):
    """Intervals, some of them inverted, with nulls, ties and repeated rows."""
    rows = []
    for _ in range(n):
        a = draw.choice([draw.randint(0, 60), draw.randint(0, 5), 7, None])
        b = None if draw.random() < 0.1 else (a or 0) + draw.choice([0, 1, draw.randint(-4, wide)])
        rows.append((a, b, draw.randint(0, 4)))
    return rows + rows[:5]


def every_pair(spark, condition, s, t):
    """The rows of s and t for which the condition holds, by a condition over a frame of all pairs."""
    frame = spark.createDataFrame([(i, j, x, y) for (i, x), (j, y) in itertools.product(enumerate(s), enumerate(t))], "i int, j int, s struct<a: int, b: int, k: int>, t struct<a: int, b: int, k: int>")
    return [(r.i, r.j) for r in frame.where(condition).select("i", "j").collect()]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CUTS", 4), ("LEAF_ROWS", 8), ("REACH_ROWS", 8)):
        monkeypatch.setattr(intervals, name, value)


@pytest.mark.parametrize("condition", CONDITIONS)
def test_joins_equal_every_pair(spark, rows, small, monkeypatch, condition):
    monkeypatch.setattr(intervals, "NODE_ROWS", CONDITIONS[condition])
    draw = random.Random(condition)
    s, t = table(draw, 40, 30), table(draw, 35, 9)
    schema = "a int, b int, k int"
    state = Catalog({"s": spark.createDataFrame(s, schema).repartition(2), "t": spark.createDataFrame(t, schema).repartition(2)})
    pairs = every_pair(spark, condition, s, t)
    matches = [sum(i == k for k, _ in pairs) for i in range(len(s))]
    options = dict(entity="s", target="t", join_condition=condition)
    inner = [(*s[i], *t[j]) for i, j in pairs]
    alone = [(*s[i], None, None, None) for i in range(len(s)) if not matches[i]]
    assert rows(steps.LeftJoin(**options, new_columns={"t.a": "ta", "t.b": "tb", "t.k": "tk"}).run(state)["s"]) == sorted(inner + alone, key=repr)
    found = steps.HasMatch(**options, column_name="m", perform_integrity_check=False).run(state)["s"]
    assert rows(found) == sorted(((*s[i], matches[i] > 0) for i in range(len(s))), key=repr)
    several = {s[i] for i in range(len(s)) if matches[i] > 1}
    assert several and set(rows(RangeJoin.of("s", state["s"], "t", state["t"], condition).several())) == several


def test_semi_anti_and_checked_joins(spark, rows):
    s, t = spark.range(9).selectExpr("id AS a", "id + IF(id = 5, 2, 1) AS b"), spark.range(0, 18, 2).selectExpr("id AS p")
    state = Catalog({"s": s, "t": t.where("p < 13")})
    options = dict(entity="s", target="t", join_condition="t.p >= s.a AND t.p < s.b")
    assert [r[0] for r in rows(steps.SemiJoin(**options).run(state)["s"])] == [0, 2, 4, 5, 6, 8]
    assert [r[0] for r in rows(steps.AntiJoin(**options).run(state)["s"])] == [1, 3, 7]
    assert rows(steps.OneToOneJoin(**options, new_columns="t.p").run(state)["s"], "a", "p")[:2] == [(0, 0), (1, None)]
    wide = dict(options, join_condition="t.p >= s.a AND t.p <= s.b + 1")
    for step in (steps.OneToOneJoin(**wide, new_columns="t.p"), steps.HasMatch(**wide, column_name="m")):
        with pytest.raises(ConstraintError):
            step.run(state)


KINDS = {
    "double": [0.0, -0.0, 1.5, float("nan"), float("inf"), float("-inf"), 1e300, -2.5, None],
    "decimal(20,3)": None,
    "string": ["", "a", "ab", "abcdefgh", "abcdefgi", "é", "ž", "Z", None],
    "date": [dt.date(2020, 1, k) for k in (1, 2, 9)] + [None],
    "timestamp": [dt.datetime(2020, 3, 29, h, 30) for h in range(5)] + [dt.datetime(1960, 1, 1), None],
    "timestamp_ntz": [dt.datetime(2020, 3, 29, 2, 30), dt.datetime(2020, 3, 29, 3, 15), dt.datetime(2020, 3, 29, 2, 45, 0, 7), None],
}


@pytest.mark.parametrize("kind", KINDS)
def test_axes_of_all_kinds(spark, small, kind):
    values = KINDS[kind] or [None, *range(-3, 9)]
    some = spark.createDataFrame([(x,) for x in values], f"x {kind if KINDS[kind] else 'int'}").select(F.col("x").cast(kind))
    both = some.select(F.col("x").alias("lo")).crossJoin(some.select(F.col("x").alias("hi")))
    state = Catalog({"s": both, "t": some})
    condition = "t.x >= s.lo AND t.x < s.hi"
    expected = both.alias("s").crossJoin(some.alias("t")).where(condition).select("lo", "hi", "x")
    options = dict(entity="s", target="t", join_condition=condition)
    text = lambda frame: sorted(map(str, frame.collect()))
    assert text(steps.InnerJoin(**options, new_columns={"t.x": "x"}).run(state)["s"]) == text(expected)


def test_mixed_numbers_compare_as_spark_does(spark, rows):
    s = spark.sql("SELECT * FROM VALUES (16777217L), (3L) t(x)")
    t = spark.sql("SELECT * FROM VALUES (float(16777216)), (float(2.5)) t(y)")
    out = steps.InnerJoin(entity="s", target="t", join_condition="s.x <= t.y", new_columns={"t.y": "y"}).run(Catalog({"s": s, "t": t}))["s"]
    assert rows(out) == rows(s.crossJoin(t).where("x <= y"))


def test_one_place_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(intervals, "NODE_ROWS", 200)
    s = spark.range(3000, numPartitions=4).selectExpr("id", "IF(id % 3 = 0, 500, id) AS a", "IF(id % 3 = 0, 500, id + 2) AS b")
    t = spark.range(3000, numPartitions=4).selectExpr("IF(id % 3 = 1, 500, id) AS p")
    join = RangeJoin.of("s", s, "t", t, "t.p BETWEEN s.a AND s.b")
    pairs = join.pairs(lambda frame: frame.select("s.id", "t.p", F.col("s.__rows_at"), F.col("s.__columns_at")))
    expected = s.join(t, (F.col("p") >= F.col("a")) & (F.col("p") <= F.col("b")))
    assert pairs.groupBy("id", "p").count().exceptAll(expected.groupBy("id", "p").count()).isEmpty() and pairs.count() == expected.count()
    cells = pairs.where("p = 500").groupBy("__rows_at", "__columns_at").count().collect()
    assert len(cells) >= 16 and max(r["count"] for r in cells) < 0.2 * sum(r["count"] for r in cells)


def test_plans_have_no_nested_loop(spark):
    s, t = spark.range(100).selectExpr("id AS a", "id + 3 AS b"), spark.range(100).selectExpr("id AS p", "id AS k")
    state = Catalog({"s": s, "t": t})
    for condition in ("t.p BETWEEN s.a AND s.b", "t.p BETWEEN s.a AND s.b AND t.k <> s.a", "t.p > s.a"):
        options = dict(entity="s", target="t", join_condition=condition)
        made = [steps.LeftJoin(**options, new_columns="t.p").run(state), steps.IdentifyOrphans(**options).run(state)]
        for out in made:
            plan = out["s"]._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan, condition


def test_empty_sides(spark, rows):
    none, some = spark.range(0).selectExpr("id AS a", "id AS b"), spark.range(4).selectExpr("id AS p")
    join = dict(entity="s", target="t", join_condition="t.p BETWEEN s.a AND s.b", new_columns={"t.p": "p"})
    assert rows(steps.LeftJoin(**join).run(Catalog({"s": none, "t": some}))["s"]) == []
    full = spark.range(2).selectExpr("id AS a", "id AS b")
    assert rows(steps.LeftJoin(**join).run(Catalog({"s": full, "t": some.limit(0)}))["s"]) == [(0, 0, None), (1, 1, None)]
