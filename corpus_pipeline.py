"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage is a function of (spark, docs, sf_dir); :func:`run` writes what a stage returns as Parquet and
reads it again as the next one's documents. A stage is called when the result of the one before it has been written,
so it first drops that one's intermediate tables, those of its own run. The stages can't be expressed in SQL (a trained classifier, a
tokenizer), so there is no oracle; ``tests/llm/test_pipeline.py`` holds the result against a brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm.decontamination import drop_contaminated
from lakewarden.llm.mixing import mix_documents
from lakewarden.llm.near_dedup import drop_near_duplicates
from lakewarden.llm.scratch import drop, new_path, scope
from lakewarden.llm.tokens import token_index
from lakewarden.llm.toxicity import keep_clean

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels, doesn't call toxic."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of 0.8 on five-word shingles)."""
    return drop_near_duplicates(docs, threshold=0.8, bands=48)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than four fifths of the shingles of any benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources come near their target weights."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row in shard files; what the files hold, per row."""
    import public_tokenizers

    # Executors hold what earlier stages left in their workers, so fewer pieces are remembered than by default.
    return token_index(docs, public_tokenizers.path("byte_bpe_50k.json"), memory=300_000)


#: The run that a stage belongs to ('' for stages called by themselves), and the folders of each run's stages.
_run: ContextVar[str] = ContextVar("pipeline_run", default="")
_written: dict[tuple[str, str, str], list[str]] = {}


def _tidy(name: str, function: Stage, before: str | None) -> Stage:
    """The stage, with its intermediate tables in one folder and those of the stage before it dropped."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        of = (spark.sparkContext.applicationId, _run.get())
        for folder in _written.pop((*of, before or ""), []):
            drop(spark, folder)
        with scope(spark, f"pipeline-{name}") as folder:
            _written.setdefault((*of, name), []).append(folder)
            return function(spark, docs, sf_dir)

    return run_stage


_FUNCTIONS = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

STAGES: list[tuple[str, Stage]] = [(name, _tidy(name, function, _FUNCTIONS[k - 1][0] if k else None)) for k, (name, function) in enumerate(_FUNCTIONS)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    token = _run.set(uuid.uuid4().hex)
    try:
        for name, function in STAGES[:-1]:
            path = new_path(spark, f"pipeline-{name}-kept")
            out = function(spark, docs, sf_dir)
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if before is not None:
                drop(spark, before)
            before = path
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        # What the last stage wrote is read by the result.
        _written.pop((spark.sparkContext.applicationId, _run.get(), STAGES[-1][0]), None)
        _run.reset(token)
