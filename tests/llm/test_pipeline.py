"""The pipeline over a small corpus with planted cases, against a plain version of what each stage must do."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from lakewarden.llm.scratch import stage  # noqa: E402

WORDS = [f"w{k}" for k in range(500)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(8)
    rows, labels, toxic, gone, contaminated = [], [], set(), set(), set()
    for k in range(300):
        text = prose(k, rng.randint(20, 80))
        if k % 6 == 0:
            text, _ = text + f" {rng.choice(['vile', 'foul', 'nasty'])} " + prose(k + 900, 3), toxic.add(k)
        rows.append((k, text))
        if k < 200:
            labels.append((k, rng.randint(0, 1), int(k in toxic)))
    for k in range(30):  # near and exact copies of clean documents
        own = rows[7 + 6 * (k % 5)][1].split()
        if k % 2:
            own[-1] = "changed"
        rows.append((1000 + k, " ".join(own)))
        gone.add(1000 + k)
    items = [(k, prose(5000 + k, 24)) for k in range(4)]
    for k in range(12):
        rows.append((2000 + k, prose(6000 + k, 400) + " " + items[k % 4][1] + " " + prose(7000 + k, 90)))
        contaminated.add(2000 + k)
    rows += [(3000, None), (3001, ""), (3002, prose(3, 4000))]
    data = [(d, t, "en", "hot" if d is None or d % 3 else f"s{d % 5}", len(t or "")) for d, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), dict(rows), toxic, gone, contaminated


def plain_copies(rows):
    """How often the mix takes each document: targets by resharing what is above three times a source's size until
    nothing is, and the draw of the id and the text."""
    size = {doc: len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for _, _, s in rows)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total = {s: sum(size[d] for d, _, own in rows if own == s) for s in names}
    full, level = set(), Fraction(0)
    while True:
        rest = [s for s in names if s not in full]
        level = Fraction(sum(total.values()) - 3 * sum(total[s] for s in full), sum(weight[s] for s in rest)) if rest else Fraction(0)
        above = {s for s in rest if weight[s] * level > 3 * total[s]}
        if not above:
            break
        full |= above
    copies = {}
    for doc, text, source in rows:
        target = 3 * total[source] if source in full else weight[source] * level
        rate = target / total[source] if total[source] else Fraction(0)
        inner = "null" if text is None else hashlib.md5(text.encode()).hexdigest()
        draw = int(hashlib.md5(f"mix:{doc}:{inner}".encode()).hexdigest()[:13], 16) / 2**52
        if n := math.floor(rate) + (draw < float(rate - math.floor(rate))):
            copies[doc] = n
    return copies


def test_stages_take_effect(spark, corpus):
    folder, texts, toxic, gone, contaminated = corpus
    docs, expected = spark.read.parquet(f"{folder}/documents.parquet"), set(texts)
    for (name, function), leaving in zip(corpus_pipeline.STAGES[:3], (toxic, gone, contaminated), strict=True):
        docs = stage(function(spark, docs, folder), f"test-{name}")
        expected -= leaving
        assert docs.columns == COLUMNS and {r.doc_id for r in docs.select("doc_id").collect()} == expected, name
    copies = plain_copies([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()])
    mixed = corpus_pipeline.mixing(spark, docs, folder)
    assert mixed.columns == COLUMNS
    # The plain version of the last stage: ids of each row, in order of doc_id.
    library, at, plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc in sorted(copies):
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for _ in range(copies[doc]):
            plain.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1]) == plain


def test_near_dedup_stage_takes_pairs_from_four_fifths(spark, corpus):
    rows, gone = [], set()
    for k in range(40):
        own = prose(8000 + k, 100).split()
        end = 10 if k % 2 else 14  # 86 / 106 = 0.811 and 82 / 110 = 0.745 of the shingles are shared
        rows += [(k, " ".join(own)), (100 + k, " ".join([*own[: 100 - end], *prose(9000 + k, end).split()]))]
        gone |= {100 + k} if k % 2 else set()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, corpus[0]).select("doc_id").collect()}
    assert left == {d for d, _ in rows} - gone


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()} == set(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_interleaved_runs_drop_only_their_own_tables(spark):
    import contextvars

    from lakewarden.llm.scratch import stage

    first = corpus_pipeline._tidy("one", lambda spark, docs, sf_dir: stage(docs, "own"), None)
    second = corpus_pipeline._tidy("two", lambda spark, docs, sf_dir: docs, "one")
    runs = []
    for name in "ab":
        context = contextvars.copy_context()
        context.run(corpus_pipeline._run.set, name)
        runs.append((context, context.run(first, spark, spark.range(3), "")))
    (a, of_a), (b, of_b) = runs
    a.run(second, spark, spark.range(1), "")
    assert of_b.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT"):
        of_a.count()
    b.run(second, spark, spark.range(1), "")
    assert not [key for key in corpus_pipeline._written if key[2] == "one"]
