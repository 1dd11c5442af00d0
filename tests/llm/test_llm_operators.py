import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm import chat, components, decontamination, exact_dedup, langid, mixing, near_dedup, substrings, tokens, toxicity, warc

WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def collected(frame):
    return {r[0]: r for r in frame.collect()}


# 1


def test_decontamination_finds_items_whole(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, prose(2, 12)), (3, "too short"), (4, None), (None, prose(3, 20)), (2, prose(2, 12))], "item_id long, text string")
    part = prose(1, 30).split()
    table = docs(
        (10, prose(10, 3000) + " " + prose(1, 30).upper() + "\n" + prose(11, 2000)),
        (11, " ".join(part[:27])),  # 23 of 26 shingles
        (12, " ".join(part[:23])),  # 19 of 26
        (13, None), (14, ""), (15, "Too  short"), (16, prose(2, 12)), (16, prose(99, 20)), (None, prose(1, 30)), (17, prose(50, 500)),
    )
    found = {(r.doc_id, r.item_id): (r.n_shared, r.n_item_shingles) for r in decontamination.find_contained(table, items).collect()}
    assert found == {(10, 1): (26, 26), (11, 1): (23, 26), (15, 3): (1, 1), (16, 2): (8, 8)}
    left = decontamination.drop_contaminated(table, items)
    assert left.columns == table.columns and sorted(str(r.doc_id) for r in left.collect()) == ["12", "13", "14", "17", "None"]
    assert decontamination.find_contained(empty, items).count() == 0 and decontamination.find_contained(table, items.limit(0)).count() == 0


def test_decontamination_finds_short_items_inside(spark, docs):
    items = spark.createDataFrame([(1, "alpha"), (2, "Alpha beta"), (3, "one two three four"), (4, prose(1, 30)), (5, "beta gamma")], "item_id long, text string")
    table = docs(
        (10, prose(10, 40) + " ALPHA\nbeta " + prose(11, 20)), (11, "one two three four"), (12, "zero one two  three four five six"),
        (13, "one two three"), (14, "beta alpha"), (15, "gamma one two three"), (16, "x beta gamma"), (17, prose(1, 30) + " alpha"), (None, "alpha"), (18, None),
    )
    found = {(r.doc_id, r.item_id): (r.n_shared, r.n_item_shingles) for r in decontamination.find_contained(table, items).collect()}
    assert found == {(10, 1): (1, 1), (10, 2): (1, 1), (11, 3): (1, 1), (12, 3): (1, 1), (14, 1): (1, 1), (16, 5): (1, 1), (17, 1): (1, 1), (17, 4): (26, 26)}
    assert {str(r.doc_id) for r in decontamination.drop_contaminated(table, items).collect()} == {"13", "15", "18", "None"}


def test_decontamination_query_equals_its_sql_with_short_items(spark, docs, tmp_path):
    import duckdb

    from lakewarden.llm.queries import OP1_SQL, op1_benchmark_decontamination

    items = [(1, "alpha"), (2, "Alpha beta"), (3, "one two three four"), (4, prose(1, 30)), (5, None), (6, "beta gamma delta"), (6, "gamma")]
    table = [(10, prose(10, 40) + " ALPHA\nbeta " + prose(11, 20)), (11, "one two three four"), (12, "zero one two  three four five six"), (13, "one two three"), (14, "beta"), (15, None), (16, "x beta gamma delta"), (17, prose(1, 30) + " alpha")]
    docs(*table).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = {tuple(r) for r in op1_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert found == set(connection.execute(OP1_SQL).fetchall()) and {r[:2] for r in found} >= {(10, 1), (10, 2), (12, 3), (17, 4)}


def test_decontamination_runs_no_python(docs, spark):
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    plan = decontamination.find_contained(docs((1, prose(1, 40))), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2


def test_toxicity_learns_and_rejects(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = prose(k, rng.randint(5, 60)) + (f" {rng.choice(['Vile', 'foul,', 'NASTY'])} " if toxic else " ") + prose(k + 1000, 5)
        rows.append((k, text, "en", "s"))
        if k < 300:
            labels.append((k, rng.randint(0, 1), int(toxic)))
    labels = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs(*rows, (1000, None), (1001, ""), (None, "vile"), (1002, prose(7, 20_000) + " nasty"), (5, prose(5, 3)))
    found = [(r.doc_id, r.toxic) for r in toxicity.toxicity(table, labels).collect()]
    assert len(found) == 405 and {d for d, t in found if t} == {k for k in range(0, 400, 4)} | {None, 1002}
    left = toxicity.keep_clean(table, labels)
    assert left.columns == table.columns and left.count() == 405 - 102
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.p_toxic for r in toxicity.toxicity(table, labels.limit(0)).collect()} == {0.0}


def test_toxicity_of_repeated_and_unlabelled_documents(spark, docs):
    """Rows that repeat an id are scored each by its text, and learned from once."""
    rows = [(k, prose(k, 20) + (" vile" if k % 3 == 0 else "")) for k in range(120)]
    labels = spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(120)] * 3, "doc_id long, quality int, toxic int")
    table = docs(*rows, *[(7, prose(7, 20))] * 50, (3, "vile"), (3, prose(4, 9)))
    once, often = toxicity.train(docs(*rows), labels), toxicity.train(table, labels)
    assert [len(m.words) for m in once.models] == [len(m.words) for m in often.models]
    found = collections.Counter((r.doc_id, r.toxic) for r in toxicity.toxicity(table, labels).collect())
    assert found[7, False] == 51 and found[3, True] == 2 and found[3, False] == 1


def plain_logistic(texts, shape, label):
    """Words by their G statistic, then the penalised likelihood by plain gradient descent."""
    import math

    import numpy as np

    n, positive = len(texts), sum(label)
    vocabulary = sorted({w for t in texts for w in t})

    def g(word):
        total = 0.0
        for value in (0, 1):
            for held in (True, False):
                seen = sum(1 for t, y in zip(texts, label, strict=True) if y == value and (word in t) == held)
                expected = sum(1 for y in label if y == value) * sum(1 for t in texts if (word in t) == held) / n
                total += seen * math.log(seen / expected) if seen else 0.0
        return 2 * total

    chosen = [w for w in vocabulary if g(w) >= 2 * math.log(len(vocabulary) / toxicity.SIGNIFICANCE)]
    scaled = np.clip((shape - shape.mean(axis=0)) / np.maximum(shape.std(axis=0), 1e-6), -3, 3)
    x = np.concatenate([np.array([[float(w in t) for w in chosen] for t in texts]).reshape(n, -1), scaled, np.ones((n, 1))], axis=1)
    ridge = np.array([0.02] * len(chosen) + [20.0] * toxicity.SHAPES + [0.02] * (shape.shape[1] - toxicity.SHAPES) + [1e-6])
    beta, y, step = np.zeros(x.shape[1]), np.array(label), 1 / (np.linalg.norm(x, 2) ** 2 / 4 + 20)
    beta[-1], ahead, t = math.log(positive / (n - positive)), None, 1.0
    ahead = beta
    for _ in range(60_000):  # accelerated, so that it ends
        moved = ahead + step * (x.T @ (y - 1 / (1 + np.exp(-x @ ahead))) - ridge * ahead)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = moved + (t - 1) / later * (moved - beta), moved, later
    return set(chosen), 1 / (1 + np.exp(-x @ beta))


def test_logistic_model_equals_a_plain_one():
    import numpy as np

    rng = np.random.default_rng(2)
    texts = [np.sort(rng.choice(np.arange(1, 60, dtype=np.uint64), 8, replace=False)) for _ in range(150)]
    shape = rng.normal(size=(150, toxicity.SHAPES))
    label = np.array([float((5 in t or 9 in t) != (rng.random() < 0.1)) for t in texts])
    model = toxicity.fit_logistic(texts, shape, label)
    chosen, expected = plain_logistic([set(t.tolist()) for t in texts], shape, label.tolist())
    assert set(model.words.tolist()) == chosen and chosen
    assert np.abs(model.probability(texts, shape) - expected).max() < 2e-3


def test_toxicity_is_fit_outside_the_driver(docs, spark, monkeypatch):
    """The driver neither gathers the training rows nor fits; the models don't depend on how the rows are dealt."""
    import os

    rows = [(k, prose(k, 20) + (" vile" if k % 3 == 0 else "")) for k in range(120)]
    labels = spark.createDataFrame([(k, None if k % 7 == 0 else k % 2, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int")
    fit, driver = toxicity.fit_chain, os.getpid()

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit(*args)

    monkeypatch.setattr(toxicity, "fit_chain", elsewhere)
    one, other = (toxicity.train(docs(*rows).repartition(n), labels) for n in (1, 7))
    for m, n in zip(one.models, other.models, strict=True):
        assert len(m.weights) and (m.words == n.words).all() and (m.weights == n.weights).all()


def test_logistic_fit_makes_no_copy_of_all_words(monkeypatch):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(4)
    texts = [np.sort(rng.choice(np.arange(1, 4000, dtype=np.uint64), 2000, replace=False)) for _ in range(1000)]
    shape, label = rng.normal(size=(1000, toxicity.SHAPES)), np.array([float(5 in t) for t in texts])
    tracemalloc.start()
    whole = toxicity.fit_logistic(texts, shape, label)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(t.nbytes for t in texts)
    monkeypatch.setattr(toxicity, "RUN", 3000)
    runs = toxicity.fit_logistic(texts, shape, label)
    assert 5 in whole.words and (whole.words == runs.words).all() and (whole.weights == runs.weights).all()


def test_later_models_see_out_of_fold_probabilities():
    import numpy as np

    rng = np.random.default_rng(0)
    words = [np.sort(rng.choice(np.arange(1, 300, dtype=np.uint64), 12, replace=False)) for _ in range(600)]
    first = np.array([float(5 in own) for own in words])
    chain = toxicity.fit_chain(words, np.zeros((600, toxicity.SHAPES)), np.stack([first, first], axis=1), np.arange(600) % 5, ("a", "b"))
    assert len(chain.models[1].centre) == toxicity.SHAPES + 1
    assert ((chain.probabilities(words, np.zeros((600, toxicity.SHAPES)))[:, 1] > 0.5) == first).all()


# 3


def test_language_id(docs, empty):
    vocab = {"xx": "ka ro mi tu zel".split(), "yy": "sch tze ung ver ich".split(), "zz": "èa ño ção lh qu".split()}
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice(vocab[lang]) for _ in range(2)) for _ in range(rng.randint(8, 40))), lang) for k, lang in enumerate(rng.choice(list(vocab)) for _ in range(300))]
    table = docs(*rows, (900, None, "xx"), (901, " 12 ?! ", "yy"), (902, "", None), (None, rows[0][1], rows[0][2]), (0, rows[0][1], None))
    out = langid.identify(table)
    assert out.count() == 305 and out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = [r for r in out.collect() if r.doc_id is not None and r.doc_id < 300]
    truth = {k: lang for k, _, lang in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in out.where("doc_id >= 900").collect()} == {"und"}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_letters_and_long_texts(docs):
    vocab = {"xx": "kami roti tuzel".split(), "yy": "schver tzeung verich".split()}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(vocab[lang], k=20)), lang) for k, lang in enumerate(["xx", "yy"] * 40)]
    odd = [(200, "½ 2"), (201, "² ³ ١٢ _"), (202, "½ ª"), (203, "日本"), (204, " ".join(rng.choices(vocab["yy"], k=60_000)))]
    table = docs(*rows, *odd)
    found = {r.doc_id: r for r in langid.identify(table).collect()}
    assert found[200].lang_pred == found[201].lang_pred == "und" and found[200].score == 0
    assert "und" not in (found[202].lang_pred, found[203].lang_pred) and found[204].lang_pred == "yy"


def test_language_scores_are_those_of_kernel_ridge_regression(docs):
    """With every text a landmark, the Nyström solution is the whole kernel's, solved here on sets of n-grams."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices(letters, k=4)) for _ in range(12)) for letters in ("abcde", "defgh", "ghijk") for _ in range(9)]
    labels = [k // 9 for k in range(27)]
    bits = [own for _, matrix in langid.presence(pa.array(texts)) for own in np.packbits(matrix, axis=1)]
    model = langid.fit(bits, labels, landmarks=10_000, ridge=1e-2)

    def grams(text):
        data = text.lower().encode()
        return {data[i : i + n] for n in (1, 2, 3, 4) for i in range(len(data) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    train, fresh = [grams(t) for t in texts], ["abc dea hij", "ghik jk", "fgh defg"]
    alpha = np.linalg.solve(kernel(train, train) + 1e-2 * len(train) * np.eye(len(train)), np.eye(3)[labels])
    expected = kernel([grams(t) for t in fresh], train) @ alpha
    got = np.concatenate([model.scores(matrix) for _, matrix in langid.presence(pa.array(fresh))])
    assert np.abs(got - expected).max() < 0.02 and (got.argmax(axis=1) == expected.argmax(axis=1)).all()


def test_language_id_learns_every_language(docs):
    rng = random.Random(6)
    vocab = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(230)}
    rows = [(8 * k + i, " ".join(rng.choices(own, k=40)), lang) for k, (lang, own) in enumerate(vocab.items()) for i in range(8)]
    model = langid.train(docs(*rows), F.lit(True))
    assert model.languages == sorted(vocab)
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs(*rows), model).collect()}
    assert found == {k: lang for k, _, lang in rows}
    few = langid.train(docs(*rows), F.lit(True), labelled=100)
    assert few.languages == sorted(vocab)


# 4


def fill(sizes, weights, cap=3):
    """Reshare by weight until no target is above its ceiling."""
    total, full = sum(sizes), set()
    while True:
        share = sum(w for k, w in enumerate(weights) if k not in full)
        left = total - sum(cap * sizes[k] for k in full)
        level = left / share if share else 0
        over = {k for k in range(len(sizes)) if k not in full and weights[k] * level > cap * sizes[k]}
        if not over:
            return [cap * s if k in full else weights[k] * level for k, s in enumerate(sizes)]
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mixing_targets_are_the_reshared_ones(docs, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "c"]
    sizes = {n: rng.choice([0, 1, 5, 40, 300]) for n in names}
    table = docs(*[(k, "w " * size, "en", name) for k, (name, size) in enumerate(sizes.items())], (99, None, "en", "a"))
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    expected = dict(zip(order, fill([sizes[n] for n in order], [1, 2, 3, 1, 2, 3]), strict=True))
    for r in mixing.mixing_report(table).collect():
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size


def test_mixing_repeats_documents(docs, empty):
    table = docs(*[(k, prose(k, 5 + k % 40), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(900)])
    report = mixing.mixing_report(table)
    again = sorted(map(tuple, report.collect()))
    assert again == sorted(map(tuple, mixing.mixing_report(table.repartition(5)).collect()))
    for r in report.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.25 * r.target
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert copies == {r.doc_id: r.copies for r in report.collect() if r.copies}
    assert mixing.mixing_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# 5


def near_truth(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        return {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())

    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def edited(text, seed, share):
    rng, own = random.Random(seed), text.split()
    for _ in range(max(1, int(share * len(own)))):
        own[rng.randrange(len(own))] = rng.choice(WORDS)
    return " ".join(own)


def test_near_dedup_equals_brute_force(docs):
    rows = [(k, prose(k, 5 + k * 3)) for k in range(20)]
    rows += [(100 + k, edited(prose(500, 120), k, share)) for k, share in enumerate([0, 0.01, 0.02, 0.03, 0.05] * 8)]
    passage = prose(600, 80)  # shared by many, alike but not enough
    rows += [(200 + k, passage + " " + prose(700 + k, 12 + k % 9)) for k in range(40)]
    chain = prose(800, 200).split()  # neighbours are linked, ends are not
    rows += [(300 + k, " ".join(chain[3 * k : 3 * k + 100])) for k in range(12)]
    rows += [(400, None), (401, ""), (402, " \t"), (403, "A b"), (404, "a  B"), (405, "a b c"), (406, prose(19, 62).upper())]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(*rows)).collect()}
    assert found == near_truth(rows)


def test_near_dedup_edge_rows(docs, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    text = prose(1, 40)
    table = docs((5, text), (None, text), (3, text), (3, text + " end"), (7, None), (7, ""), (8, prose(2, 30_000)))
    out = near_dedup.near_duplicates(table)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in out.collect()), key=str) == sorted([(5, 3, False), (None, None, True), (3, 3, True), (3, 3, True), (7, 7, True), (7, 7, True), (8, 8, True)], key=str)
    left = near_dedup.drop_near_duplicates(table)
    assert left.columns == table.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "7", "7", "8", "None"]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    for small in (0, components.SMALL):  # by stars, and in one task
        found = {r.node: r.root for r in components.components(edges, small).collect()}
        assert found == {**{k: 0 for k in range(1, 61)}, 101: 100}
        assert components.components(edges.limit(0), small).count() == 0
    rng = random.Random(3)
    pairs = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(map(tuple, components.components(edges, 0).collect())) == sorted(map(tuple, components.components(edges).collect()))


def test_rows_pass_through_with_any_column_names(spark):
    names = ["__mix_copies", "copies", "copy", "size", "key", "own_sha", "__own_sha", "__sha", "keep_id", "a.b", "tick`s", "digest", "item_id", "rep"]
    text = prose(1, 60)
    plain = [(1, text, "s"), (2, text, "s"), (3, prose(2, 60), "t"), (3, prose(3, 60), "t"), (4, prose(4, 60), None), (-(2**63), text, "s")]
    rows = [(*r, *[100 * k + j for j in range(len(names))]) for k, r in enumerate(plain)]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    table = spark.createDataFrame(rows, T.StructType(fields + [T.StructField(n, T.LongType()) for n in names]))
    by_row = {r[3:]: r for r in rows}

    def whole(out):
        assert out.columns == table.columns
        got = [tuple(r) for r in out.collect()]
        assert all(by_row[r[3:]] == r for r in got)
        return sorted(k for k, r in enumerate(rows) for g in got if g == r)

    items = spark.createDataFrame([(1, prose(4, 60)), (2, "x y")], "item_id long, text string")
    assert whole(decontamination.drop_contaminated(table, items)) == [0, 1, 2, 3, 5]
    assert whole(exact_dedup.drop_copies(table)) == [2, 3, 4, 5]
    assert len(whole(near_dedup.drop_near_duplicates(table))) == 3  # one of the texts, one of the rows of 3, and 4
    taken = {r.doc_id: r.copies for r in mixing.mixing_report(table).collect()}
    assert collections.Counter(r.doc_id for r in mixing.mix_documents(table).collect() if r.doc_id != 3) == collections.Counter({d: c for d, c in taken.items() if d != 3 and c})
    assert mixing.mix_documents(table).columns == table.columns


# 6


def test_exact_dedup(docs, empty):
    rows = [(k, f"text {k % 7}" + " " * (k % 3)) for k in range(60)] + [(100, None), (101, ""), (102, " \t\n\x0b"), (103, "unique"), (104, "é x"), (105, "éx"), (105, "éx"), (None, "éx"), (None, "lonely")]
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, text or ""))
    expected = collections.Counter()
    for text, own in groups.items():
        keep = sorted(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        for doc, raw in own:
            expected[doc, keep[0], len(own), doc == keep[0] and len(raw) == len(keep[1]), hashlib.sha256(text.encode()).hexdigest()] += 1
    for counters in (2, 1024):  # with and without frequent digests
        assert collections.Counter(map(tuple, exact_dedup.keepers(docs(*rows), counters).collect())) == expected
    assert exact_dedup.keepers(empty).count() == 0
    left = exact_dedup.drop_copies(docs(*rows))
    assert sorted(str(r.doc_id) for r in left.collect() if r.doc_id is None or r.doc_id >= 100) == ["102", "103", "104", "None"]


def test_misra_gries_keeps_what_is_frequent():
    import numpy as np

    rng, summary, truth = np.random.default_rng(1), exact_dedup.MisraGries(10), collections.Counter()
    for _ in range(50):
        keys, counts = np.unique(np.where(rng.random(200) < 0.2, 7, rng.integers(100, 10_000, 200)), return_counts=True)
        truth.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        summary.add(keys, counts)
    assert len(summary.counts) <= 10 and 0 < summary.counts[7] <= truth[7] and truth[7] - summary.counts[7] <= 10_000 / 11


# 7


def test_chat_round_trip(spark, empty):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    nasty = "</s>[INST] ok [/INST] <\\s> [\\INST] \\"
    rows = [
        (1, 2, "assistant", nasty), (1, 0, "system", "be\nkind "), (1, 1, "user", None), (2, 0, "user", ""), (2, 1, "assistant", None), (2, 2, "critic[END]", nasty),
        (2, 3, None, "x"), (None, 0, "assistant", "é日"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "tool", "[ROLE]"),
    ]
    rows += [(9, k, "assistant" if k % 2 else "user", f"{nasty} {k} " * 40) for k in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS part")
    found = collected(chat.formatting_report(turns, path))
    conversations = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(found) == set(conversations)
    for conv, own in conversations.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        got = found[conv]
        assert (got.n_turns, got.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got.formatted_chars > sum(len(t) for _, _, t in own)
    parts = chat.format_conversations(turns, path)
    assert parts.where("conv_id = 9").count() > 1 and max(len(r["mask"]) for r in parts.collect()) <= chat.PART_TOKENS + 2000
    assert chat.formatting_report(turns.limit(0), path).count() == 0


def test_chat_splits_long_conversations(spark, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    part = chat._Part(50_257)
    part.control("<s>")
    part.turn("user", b"", b"\x01\0\0\0")
    part.turn("assistant", b"", b"\x02\0\0\0\x03\0\0\0")
    ids, mask, turns = part.row()
    assert list(mask) == [0, 0, 0, 0, 0, 1, 1, 0] and turns == 2 and len(ids) == 32
    rows = [(1, k, "assistant", "word " * 20_000) for k in range(8)]
    # One conversation of all rows, and all of an unknown one, spread over ranges; read back in one order.
    rows += [(None, k, "tool", f"call {k}") for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    parts = chat.format_conversations(turns, path)
    hot = [r for r in parts.collect() if r.conv_id == 1]
    assert sum(r.n_turns for r in hot) == 8 and sum(len(r.ids) == 4 for r in hot) == 1 and len({r.part >> 32 for r in parts.where("conv_id IS NULL AND n_turns > 0").collect()}) > 1
    found = {r.conv_id: r for r in chat.read_back(parts, path).collect()}
    assert found[1].loss_chars == 8 * 100_000
    assert found[None].turns_sha256 == hashlib.sha256("".join(f"tool\ncall {k}\n" for k in range(300)).encode()).hexdigest()
    assert found[None].formatted_chars == sum(len(f"[TOOL]call {k}[/TOOL]") for k in range(300)) + len("<s>")


# 8


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a.com/x", big), (5, "https://b.a.com/y?q=1#f", big), (3, None, big), (7, "http://a.com/x", "small"), (8, "http://a.com/x", "small"), (9, "", None), (10, "http://[bad", ""), (None, "u", big), (11, "line\nbreak", big + "!"), (7, "http://c.com/x", "small"), (7, "http://a.com/x", "other"), (5, "http://c.com/", big)]
    rows += [(100 + k, f"http://h{k % 9}.org/{k}", f"<b>{k}</b>" * (k % 400)) for k in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS target", "2 AS key")
    folder = f"file://{tmp_path}/w"
    found = collections.Counter(map(tuple, warc.archive_report(pages, folder).collect()))
    expected = collections.Counter()
    for page, _, html in rows:
        payload = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == payload and p is not None), default=None)
        revisit = len(payload) >= 1000 and page != top and top is not None
        expected[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert found == expected
    captures = warc.write_archives(pages, f"file://{tmp_path}/v")
    manifest = warc.write_index(captures, f"file://{tmp_path}/v", n_shards=3, lines_a_block=16)
    index = warc.CaptureIndex(f"file://{tmp_path}/v", [tuple(r) for r in manifest.select("file", "first_key", "first_page").collect()])
    for r in captures.collect():
        assert (r.file, r.offset, r.length) in index.find(r.key, r.page_id)
    assert index.find("com,nowhere)/", 1) == []
    import gzip

    files = list((tmp_path / "v").glob("pages*"))
    written = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert written.count(b"WARC/1.1\r\n") == len(rows) + len(files)
    ids = re.findall(rb"WARC-Record-ID: (\S+)", written)
    assert len(set(ids)) == len(ids) == len(rows) + len(files) and set(re.findall(rb"WARC-Refers-To: (\S+)", written)) <= set(ids)
    assert warc.archive_report(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_damaged_records_are_refused():
    record = warc.build_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse_record(record)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad"))


# 9


def test_token_shards(docs, empty, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)  # as it comes, not the one that the operator holds
    rows = [(k, prose(k, k % 50)) for k in range(300, 0, -1)] + [(None, "no id"), (400, None), (401, ""), (402, prose(3, 30_000)), (403, "a <|endoftext|> b<|endoftext|>"), (7, "again"), (7, "again")]
    table = docs(*rows)
    folder, manifest = tokens.write_shards(table, path, 2, f"file://{tmp_path}/t", n_shards=4)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_shards(folder, manifest).collect())
    assert len(found) == len(rows) and manifest.count() <= 4
    at, coded = 0, collections.Counter()
    for start, doc, n, crc in found:
        assert start == at
        at += n
        coded[doc, n, crc] += 1
    assert [d for _, d, _, _ in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    expected = collections.Counter()
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert coded == expected
    assert tokens.token_index(empty, path).count() == 0


# 10


def removal_truth(rows):
    first, out = {}, {}
    ordered = sorted((d, (t or "").encode()) for d, t in rows)
    for doc, data in ordered:
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], doc)
    for doc, data in ordered:
        mask = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < doc:
                mask[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1]))
        out.setdefault(doc, []).append((len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize("heavy", [None, 3, 0])  # no anchor, some or all dealt window by window
def test_substring_removal_equals_brute_force(docs, heavy):
    passage, other = prose(1, 40), "é" * 30 + prose(2, 20)
    rows = [(k, prose(100 + k, 60) + passage[k : 100 + 3 * k] + prose(200 + k, 30)) for k in range(25)]
    rows += [(30, "a" * 49), (31, "a" * 50), (32, "a" * 51 + "b"), (33, "ab" * 60), (34, "ba" * 40), (35, None), (36, ""), (37, other), (38, "x" + other), (39, passage), (40, passage[:49]), (41, passage[:50])]
    rows += [(50 + k, edited(prose(9, 150), k, 0.05)) for k in range(15)] + [(70, passage + other), (71, other + passage), (72, "be " * 90), (73, "be " * 200), (74, prose(5, 20_000)), (75, prose(5, 20_000)[1000:9000])]
    rows += [(80, prose(77, 50)), (80, prose(77, 50)), (80, prose(78, 50) + prose(77, 50)), (81, prose(77, 50))]
    found = collections.defaultdict(list)
    for r in substrings.repeated_spans(docs(*rows), heavy_pieces=heavy).collect():
        found[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in found.items()} == removal_truth(rows)


def test_a_passage_in_every_document_is_found_in_all(docs):
    passage = prose(1, 60)
    rows = [(k, f"{prose(100 + k, 12)} {passage} {prose(900 + k, 9)}") for k in range(400)] + [(1000 + k, passage) for k in range(200)]
    found = collections.defaultdict(list)
    for r in substrings.repeated_spans(docs(*rows).repartition(7)).collect():
        found[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in found.items()} == removal_truth(rows)


def test_substring_removal_edge_tables(docs, empty):
    assert substrings.repeated_spans(empty).count() == 0
    text = prose(1, 60)
    out = substrings.repeated_spans(docs((None, text), (1, text), (2, text), (None, text)), keep_text=True).collect()
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept).decode()) for r in out) == [("1", 0, text), ("2", len(text), ""), ("None", 0, text), ("None", 0, text)]


def test_substrings_with_two_anchors_of_one_hash(docs):
    import numpy as np

    from lakewarden.llm import substrings
    from lakewarden.llm.textkernels import prefix_sums

    a, b = "zsitzhmpoegq", "hgdfqnezzbtv"
    hashes = [substrings._order_values(prefix_sums(np.frombuffer(x.encode(), dtype=np.uint8)), 12, 12)[0] for x in (a, b)]
    assert hashes[0] == hashes[1]
    rng, rows = random.Random(8), []
    filler = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for k in range(0, 80, 2):
        one = filler(30) + a + filler(rng.randint(0, 20)) + b + filler(60)
        at = one.index(b)
        rows += [(k, one), (k + 1, filler(20) + one[at - rng.randint(0, 5) : at + 12 + rng.randint(40, 60)] + filler(20))]
    seen, expected = set(), {}
    for k, text in rows:
        windows = [text[i : i + 50] for i in range(len(text) - 49)]
        expected[k] = len({j for i, w in enumerate(windows) if w in seen for j in range(i, i + 50)})
        seen.update(windows)
    assert sum(n > 0 for n in expected.values()) == 40
    assert {r.doc_id: r.n_removed for r in substrings.repeated_spans(docs(*rows)).collect()} == expected
