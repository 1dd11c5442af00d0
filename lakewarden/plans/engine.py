"""Running a dataset document: as a library call on DataFrames or files, and as a pipeline over submissions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakewarden.functions.library import register_functions
from lakewarden.operators.catalog import RECORD_INDEX, Catalog
from lakewarden.operators.index import add_record_index
from lakewarden.plans.audit import AuditLog
from lakewarden.plans.config import DatasetConfig
from lakewarden.plans.contract import apply_contract, raw_schema, reject_records
from lakewarden.plans.messages import distinct_messages, from_mapping, submission_message
from lakewarden.plans.report import FILE_REJECTION, aggregates, project, statistics, type_totals, write_report
from lakewarden.plans.rules import Outcome, evaluate, union_messages
from lakewarden.sources.files import Files, extension_of, name_of, stem_of
from lakewarden.sources.readers import ReaderError, SubmissionRejected, read_entity
from lakewarden.sources.reference import loader
from lakewarden.sources.sinks import count_rows, describe_error, write_entities, write_messages, write_parquet, write_processing_error


class Engine:
    """One dataset document, ready to run on any input."""

    def __init__(self, spark: SparkSession, config: DatasetConfig, references: Mapping[str, DataFrame] | None = None):
        self.spark, self.config, self.references = spark, config, dict(references or {})
        register_functions(spark)

    def catalog(self, entities: Mapping[str, DataFrame], extra: Mapping[str, DataFrame] | None = None) -> Catalog:
        return Catalog(dict(entities), loader(self.spark, self.config.reference_data, self.config.base, {**self.references, **(extra or {})}))

    def raw_schema(self, entity: str) -> T.StructType:
        return raw_schema(self.config.contract, self.config.contract.datasets[entity])

    def read(self, entity: str, path: str) -> DataFrame:
        """An entity from a file, by the reader of its extension."""
        readers = self.config.contract.datasets[entity].readers
        extension = extension_of(path)
        if extension not in readers:
            if extension in ("", ".parquet"):
                return self.spark.read.parquet(path)
            raise SubmissionRejected("UnsupportedExtension", f"files of type {extension!r} are not supported for {entity}")
        return read_entity(self.spark, path, self.raw_schema(entity), readers[extension])

    def keys(self) -> dict[str, tuple[str, ...]]:
        return {name: d.reporting_fields for name, d in self.config.contract.datasets.items()}

    def rules(self, entities: Mapping[str, DataFrame], extra: Mapping[str, DataFrame] | None = None, hold=None) -> Outcome:
        return evaluate(self.catalog(entities, extra), self.config.rules, self.config.parameters, self.keys(), hold, self.config.templating)

    def run(self, raw: Mapping[str, DataFrame], folder: str | None = None, reject: bool = False) -> Outcome:
        """Contract, then rules. With ``folder`` stages are written there, otherwise all stays one lazy plan."""
        typed, messages = {}, []
        stage = (lambda name: lambda frame: write_parquet(frame, f"{folder}/{name}")) if folder else (lambda name: None)
        for name, frame in raw.items():
            # A staged table gives the same partitions each time, which the record index counts on.
            source = write_parquet(frame, f"{folder}/raw/{name}") if folder and RECORD_INDEX not in frame.columns else frame
            found = apply_contract(self.config.contract, name, add_record_index(source), stage(f"contract/{name}"))
            typed[name] = found.typed
            messages.append(found.messages)
            if self.config.contract.cache_originals:
                typed[f"Original{name}"] = found.typed
        outcome = self.rules(typed)
        total = union_messages([*messages, outcome.messages])
        catalog = outcome.catalog
        if reject:
            contract_messages = union_messages(messages)
            for name in raw:
                if name in catalog.entities:
                    catalog = catalog.put(name, reject_records(catalog[name], contract_messages, name))
        if folder:
            write_entities(dict(catalog.entities), f"{folder}/outputs")
            write_messages(total, folder, "engine", mode="overwrite")
        return Outcome(catalog, total)


# Submissions


@dataclass(frozen=True)
class Submission:
    """A file with its metadata sidecar."""

    path: str
    dataset_id: str
    submission_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    info: Mapping[str, Any] = field(default_factory=dict)


def discover(folder: str, spark: SparkSession | None = None) -> tuple[list[Submission], list[list[str]]]:
    """Files in a folder of any store that stand beside ``<stem>.metadata.json``. A lone file waits for its partner; a
    stem with more than two files is returned for the dead letters."""
    files_of = Files(spark or SparkSession.active())
    groups: dict[str, list[str]] = {}
    for place in files_of.files(folder):
        name = name_of(place)
        if not name.startswith((".", "_")):
            stem = name.removesuffix(".metadata.json") if name.endswith(".metadata.json") else name.split(".")[0]
            groups.setdefault(stem, []).append(place)
    found, dead = [], []
    for files in groups.values():
        sidecars = [f for f in files if f.endswith(".metadata.json")]
        if len(files) == 2 and len(sidecars) == 1:
            info = json.loads(files_of.read_text(sidecars[0]))
            found.append(Submission(next(f for f in files if f != sidecars[0]), info["dataset_id"], info=info))
        elif len(files) > 2:
            dead.append(files)
    return found, dead


@dataclass(frozen=True)
class Status:
    """What has gone wrong so far."""

    validation_failed: bool = False
    processing_failed: bool = False

    @property
    def result(self) -> str:
        return "processing_failed" if self.processing_failed else "validation_failed" if self.validation_failed else "success"


class Pipeline:
    """Submissions through transformation, contract, rules and report, with a written table between stages."""

    def __init__(self, spark: SparkSession, configs: Mapping[str, DatasetConfig], work: str, audit: AuditLog | None = None, references: Mapping[str, DataFrame] | None = None):
        self.spark, self.work, self.audit = spark, work, audit
        self.engines = {name: Engine(spark, config, references) for name, config in configs.items()}

    def _mark(self, status: str, submission: Submission, result: str | None = None) -> None:
        if self.audit:
            self.audit.mark(status, [submission.submission_id], result)

    def receive(self, submission: Submission) -> None:
        if self.audit:
            known = ("submission_method", "submitting_org", "reporting_period_start", "reporting_period_end")
            row = {"submission_id": submission.submission_id, "dataset_id": submission.dataset_id, "file_name": stem_of(submission.path), "file_extension": extension_of(submission.path).lstrip("."), "file_size": Files(self.spark).size(submission.path)}
            self.audit.add("submission_info", [{**row, **{k: submission.info.get(k) for k in known}}])
            self._mark("received", submission)

    def transform(self, submission: Submission, folder: str) -> tuple[dict[str, DataFrame], DataFrame | None]:
        """Strings as Parquet for every entity; if a reader refuses the file, what all of them say of it, once each."""
        engine, staged, refused = self.engines[submission.dataset_id], {}, []
        for name in engine.config.contract.datasets:
            try:
                staged[name] = add_record_index(write_parquet(engine.read(name, submission.path), f"{folder}/transform/{name}"))
            except SubmissionRejected as error:
                refused.append(submission_message(self.spark, error.code, error.text, value=error.value))
        return (staged, None) if not refused else ({}, distinct_messages(union_messages(refused)))

    def run(self, submission: Submission) -> Status:
        """All stages of one submission; nothing is raised, what fails is recorded."""
        folder = f"{self.work}/{submission.submission_id}"
        engine, status, parts = self.engines[submission.dataset_id], Status(), []
        entities: dict[str, DataFrame] = {}
        records = None
        stage = "file_transformation"
        try:
            self.receive(submission)
            self._mark(stage, submission)
            entities, refused = self.transform(submission, folder)
            if refused is not None:
                parts.append(refused)
                status = Status(validation_failed=True)
            else:
                stage = "data_contract"
                self._mark(stage, submission)
                typed, contract_parts = {}, []
                for name, frame in entities.items():
                    found = apply_contract(engine.config.contract, name, frame, lambda f, name=name: write_parquet(f, f"{folder}/data_contract/{name}"))
                    typed[name], typed[f"Original{name}"] = found.typed, found.typed
                    contract_parts.append(found.messages)
                contract_messages = union_messages(contract_parts)
                parts.append(contract_messages)
                stage = "business_rules"
                self._mark(stage, submission)
                info = self.spark.createDataFrame([(submission.submission_id, submission.dataset_id, stem_of(submission.path))], "submission_id string, dataset_id string, file_name string")
                step = iter(range(1 << 30))
                outcome = engine.rules(typed, {"submission_info": info}, lambda f: write_parquet(f, f"{folder}/filters/{next(step)}"))
                catalog = outcome.catalog
                for name in entities:
                    if name in catalog.entities:
                        catalog = catalog.put(name, reject_records(catalog[name], contract_messages, name))
                parts.append(outcome.messages)
                write_entities(dict(catalog.entities), f"{folder}/business_rules")
                main = engine.config.parameters.get("entity", submission.dataset_id)
                records = count_rows(typed.get(f"Original{main}", next(iter(typed.values()))))
        except ReaderError as error:
            status = Status(processing_failed=True)
            parts.append(self._failed(folder, stage, error))
        except Exception as error:  # recorded and reported; one submission must not stop the others
            status = Status(status.validation_failed, True)
            parts.append(self._failed(folder, stage, error))
        return self.report(submission, folder, parts, records, status)

    def _failed(self, folder: str, stage: str, error: Exception) -> DataFrame:
        """Record a failure of the engine; the report says it too, without the traceback."""
        write_processing_error(self.spark, folder, stage, error)
        return from_mapping(self.spark, [describe_error(error, stage)])

    def report(self, submission: Submission, folder: str, parts: list[DataFrame], records: int | None, status: Status) -> Status:
        self._mark("error_report", submission)
        messages = union_messages(parts, None) if parts else None
        if messages is not None:
            messages = self.spark.read.schema(messages.schema).json(write_messages(messages, folder, "all", mode="overwrite"))
            counted = aggregates(project(messages))
            counted = write_parquet(counted, f"{folder}/audit/error_aggregates.parquet")
            failed = not messages.where("Status <> 'informational'").isEmpty()
            status = Status(status.validation_failed or failed, status.processing_failed)
            numbers = statistics(counted, records)
            if self.audit and numbers:
                self.audit.add("submission_statistics", [{"submission_id": submission.submission_id, **numbers}])
            details = {"Submission": submission.submission_id, "File": name_of(submission.path), "Dataset": submission.dataset_id}
            write_report(f"{folder}/error_report.xlsx", messages, list(self.engines[submission.dataset_id].config.contract.datasets), details, status.processing_failed)
        self._mark("failed" if status.processing_failed else "success", submission, status.result)
        return status

    def run_folder(self, folder: str, max_workers: int = 7, dead_letters: str | None = None) -> dict[str, Status]:
        """Every submission of a folder, several at a time; Spark's scheduler shares the cluster among them."""
        found, dead = discover(folder, self.spark)
        for files in dead if dead_letters else []:
            for name in files:
                Files(self.spark).move(name, dead_letters)
        with ThreadPoolExecutor(max_workers) as pool:
            return dict(zip([s.submission_id for s in found], pool.map(self.run, found), strict=True))


__all__ = ["Engine", "Pipeline", "Submission", "Status", "discover", "FILE_REJECTION", "type_totals"]
