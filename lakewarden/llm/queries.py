"""The registered queries of the operators in this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.decontamination import find_contained

    return find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM doc_words
  UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT len(w) AS k FROM item_words WHERE len(w) BETWEEN 1 AND 4)
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM item_words
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) / n >= 0.8
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.mixing import mixing_report

    return mixing_report(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight,
         source_size * 3 AS ceiling FROM s
), l AS (
  SELECT source, source_size, weight, ceiling,
    CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(ceiling) OVER (
      ORDER BY ceiling / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "left",
    CAST(sum(weight) OVER (
      ORDER BY ceiling / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS share
  FROM w
), f AS (SELECT *, ceiling * share <= "left" * weight AS "full" FROM l),
t AS (
  SELECT source, source_size, CASE WHEN "full" THEN CAST(ceiling AS DOUBLE)
    ELSE weight * max(CASE WHEN NOT "full" THEN "left" / share END) OVER () END AS target FROM f
), c AS (
  SELECT doc_id, size, source_size, target, d.source,
    coalesce(target / nullif(source_size, 0), 0.0) AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(d.text), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies, source
FROM c
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, md5(unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.r AS ra, b.r AS rb, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT DISTINCT a, b FROM p JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (
  SELECT DISTINCT doc_id, doc_id AS root FROM d
  UNION SELECT e.b, c.root FROM c JOIN e ON c.doc_id = e.a WHERE c.root < e.b
), t AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(d.doc_id = component_id, true) AS kept
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.doc_id = t.doc_id AND n.n > 0
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.exact_dedup import keepers

    return keepers(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    max(n) OVER (PARTITION BY text_sha256) AS most, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND n = most AS kept, text_sha256 FROM g
"""

def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakewarden.llm.chat import formatting_report

    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return formatting_report(turns, public_tokenizers.path("byte_bpe_50k.json"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
), k AS (
  -- A control string, escaped or not, is longer by a backslash in the output.
  SELECT *, '<\\*/?s>|\[\\*/?(?:SYS|INST|TOOL|ROLE)\]|\[\\*(?:ANS|END)\]' AS control FROM t
), f AS (
  SELECT conv_id, turn, role, text, length(text) + len(regexp_extract_all(text, control)) + CASE role
    WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'tool' THEN 13 WHEN 'assistant' THEN 9
    ELSE 18 + length(role) + len(regexp_extract_all(role, control)) END AS chars FROM k
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.warc import archive_report

    return archive_report(_table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakewarden.llm.tokens import token_index

    return token_index(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.substrings import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.repetition import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat", "n_repeats")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d
), u AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
e AS (SELECT doc_id, i, ' ' || word || ' ' || lead(word) OVER p AS pair, lead(word, 4) OVER p AS fifth FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, i, md5(pair || lead(pair, 2) OVER p || ' ' || fifth) AS s5,
    md5(pair || lead(pair, 2) OVER p || lead(pair, 4) OVER p || lead(pair, 6) OVER p) AS s8
  FROM e WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, i, s5, s8, md5(s8 || lead(s8, 8) OVER p || lead(s8, 16) OVER p || lead(s8, 24) OVER p || lead(s8, 32) OVER p
    || lead(s8, 40) OVER p || lead(s8, 43) OVER p) AS s51
  FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT doc_id, 5 AS k, i, s5 AS s FROM g WHERE s5 IS NOT NULL UNION ALL SELECT doc_id, 8, i, s8 FROM g WHERE s8 IS NOT NULL
  UNION ALL SELECT doc_id, 51, i, s51 FROM g WHERE s51 IS NOT NULL
), m AS (SELECT doc_id, k, s FROM s GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, k, i + unnest(range(k)) AS place FROM s SEMI JOIN m USING (doc_id, k, s)),
n AS (
  SELECT doc_id, count(*) FILTER (k = 8) AS n_repeat_words, count(*) FILTER (k = 5) AS covered_words, count(*) FILTER (k = 51) AS long_words
  FROM c GROUP BY doc_id
), j AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(long_words, 0) AS long_words
  FROM b LEFT JOIN n ON b.doc_id = n.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * covered_words <= 30 * n_words AND long_words = 0 AS kept, covered_words
FROM j
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.negatives import hard_negatives

    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)").cast("bigint").alias("label"),
        # A component that isn't finite becomes null, and a row with a null component takes no part.
        F.expr("transform(embedding, x -> IF(isnan(x) OR abs(x) = double('infinity'), NULL, floor(256 * CAST(x AS DOUBLE))))").alias("vector"),
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), q AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM q JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewarden.llm.periodic import runs_report

    return runs_report(_with_periods(_table(spark, sf_dir, "documents")))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The texts with the query's periods put into a tenth of them; a text without an id or without words stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.expr(r"IF(h % 10 = 0, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), NULL)"))
    rows = rows.withColumn("n", F.expr("nullif(size(words), 0)")).withColumn("a", F.expr("(h div 10) % n")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    periods = F.expr("slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))")
    changed = F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), periods), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_warc": op8_warc,
    "op9_token_output": op9_token_output,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op4_source_mixing": OP4_SQL,
    "op5_near_dedup": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
