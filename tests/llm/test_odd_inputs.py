"""Registered queries on inputs that the given tables don't hold, in a session with ANSI errors too."""

import zlib

import pytest

from lakewarden.llm.queries import op13_periodic_runs


@pytest.fixture(params=["false", "true"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_op13_texts_without_words_that_are_drawn(spark, tmp_path, ansi):
    drawn = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:4]
    other = next(k for k in range(200) if zlib.crc32(str(k).encode()) % 10)
    texts = [(drawn[0], ""), (drawn[1], " \n\t"), (drawn[2], None), (drawn[3], "one two three"), (other, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert sorted(found) == sorted(k for k, _ in texts)
    assert all(found[k].n_runs == 0 and found[k].start is None for k in (*drawn[:3], other))
    assert len({found[k].collapsed_sha256 for k in (*drawn[:3], other)}) == 1
