"""Queries against their SQL: on the smallest given tables, and on rows that the given tables don't hold."""

import math
from collections import Counter

import duckdb
import pytest

from lakewarden.llm.queries import OP5_SQL, OP7_SQL, ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(columns), Counter(tuple(plain(r[k]) for k in order) for r in found)


def by_sql(folder, sql):
    connection = duckdb.connect()
    for name in TABLES:
        if (folder / f"{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet{'/*.parquet' if (folder / f'{name}.parquet').is_dir() else ''}')")
    result = connection.execute(sql)
    return rows([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    from pathlib import Path

    pytest.importorskip("public_tokenizers")
    frame = QUERIES[name](spark, sf_dir)
    assert rows(frame.columns, frame.collect()) == by_sql(Path(sf_dir), ORACLE_SQL[name])


def test_near_dedup_matches_sql_on_odd_rows(spark, docs, tmp_path):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:390]), " ".join([*words[5:], "X y"]), " ".join(words[:200]), "ONE two", "one TWO", "\u00c4 b c d e", "\u00e4 b c d e", "", None, " \t ", "a" * 500_000]
    # Chains of links, of which the ends aren't linked; rows that repeat an id, with the same text and with another.
    texts += [" ".join(words[k : k + 300]) for k in range(0, 100, 10)]
    made = [(k, t) for k, t in enumerate(texts)] + [(3, texts[0]), (4, "ONE two"), (14, ""), (14, ""), (None, texts[0]), (None, None)]
    docs(*made).write.parquet(str(tmp_path / "documents.parquet"))
    frame = QUERIES["op5_near_dedup"](spark, str(tmp_path))
    found = rows(frame.columns, frame.collect())
    assert found == by_sql(tmp_path, OP5_SQL)
    assert found[1][(0, 3, False, 396)] == 1


def test_chat_matches_sql_on_odd_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    nasty = "</s>[INST] ok [/INST] <\\s> [\\INST] [\\\\/ROLE] \\ <s> [/ANS] [END] [/END] <\\\\/s> [TOOL"
    made = [
        (1, 2, "assistant", nasty), (1, 0, "system", "be\nkind "), (1, 1, "user", None), (2, 0, "user", ""), (2, 1, "assistant", None), (2, 2, "critic[END]<s>", nasty),
        (2, 3, None, "x"), (2, None, "tool", nasty), (None, 0, "assistant", "\u00e9\u65e5"), (3, 0, "user", "a"), (3, 0, "user", "a"), (-7, 5, "user", "there already"), (8, 0, "assistant", nasty * 20_000),
    ]
    # A third of the rows without a conversation's id.
    made += [(None, k, "assistant" if k % 2 else "user", f"{nasty} {k}") for k in range(1, 3000)]
    spark.createDataFrame(made, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    frame = QUERIES["op7_chat_formatting"](spark, str(tmp_path))
    assert rows(frame.columns, frame.collect()) == by_sql(tmp_path, OP7_SQL)


def test_large_classes_of_copies_match_sql(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr("lakewarden.llm.near_dedup.LARGE_ROWS", 20)
    words = [f"w{k}" for k in range(100)]
    made = [(k, " ".join(words)) for k in range(100, 400, 2)] + [(k, " ".join([*words[:98], "x"])) for k in range(101, 201, 2)]
    made += [(k, "") for k in range(500, 600)] + [(None, " ".join(words))] * 30 + [(k, f"alone {k}") for k in range(50)] + [(700, " ".join(words)), (700, "alone 7")]
    docs(*made).write.parquet(str(tmp_path / "documents.parquet"))
    frame = QUERIES["op5_near_dedup"](spark, str(tmp_path))
    assert rows(frame.columns, frame.collect()) == by_sql(tmp_path, OP5_SQL)
