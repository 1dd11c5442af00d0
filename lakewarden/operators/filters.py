"""Synchronised filters: all filters of an entity see the same rows and run in one pass.

Each filter adds a private boolean column. Messages are the rows of one ``explode`` over the filters that a
record fails; survivors are the rows on which all ``record_failure`` filters are true. A filter that is null
emits nothing, and a ``record_failure`` that is null still removes the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.catalog import RECORD_INDEX
from lakewarden.operators.expressions import all_of
from lakewarden.plans.messages import MESSAGE_SCHEMA, Reporting, key_column, message_struct, value_column
from lakewarden.plans.templating import to_column


@dataclass(frozen=True, kw_only=True)
class DeferredFilter:
    """``expression`` says what good rows satisfy."""

    entity: str
    expression: str
    name: str | None = None
    reporting: Reporting = field(default_factory=Reporting)
    original_entity: str | None = None


@dataclass(frozen=True)
class FilterOutcome:
    """``flagged`` is the entity with the private columns; the other two are plans over it."""

    survivors: DataFrame
    messages: DataFrame
    flagged: DataFrame
    critical: tuple[str, ...]


_FAILED = "__failed__"


def _flag(position: int) -> str:
    return f"__filter_{position}__"


def apply_filters(frame: DataFrame, filters: Sequence[DeferredFilter], key_fields: Sequence[str] = ()) -> FilterOutcome:
    """Evaluate ``filters`` over ``frame`` in one projection."""
    columns = frame.columns
    flagged = frame.withColumns({_flag(k): F.expr(f.expression).cast("boolean") for k, f in enumerate(filters)})
    index = F.col(RECORD_INDEX) if RECORD_INDEX in columns else F.lit(None)
    rows: list[Column] = []
    for k, own in enumerate(filters):
        message = message_struct(
            own.reporting,
            entity=own.original_entity or own.entity,
            key=key_column(frame, key_fields),
            error_type=own.name or own.reporting.code or "rule",
            message=to_column(own.reporting.message or "", frame.schema),
            index=index,
            value=value_column(own.reporting, frame),
            position=k,
        )
        rows.append(message)
    failed = None
    if rows:
        # Exploded are the filters' numbers, not their messages: an array of messages in a generator is built by interpreted code, some 15 times slower.
        numbers = F.explode(F.array(*[F.when(~F.col(_flag(k)), F.lit(k)) for k in range(len(filters))]))
        told = flagged.select("*", numbers.alias(_FAILED)).where(F.col(_FAILED).isNotNull())
        failed = told.select(F.coalesce(*[F.when(F.col(_FAILED) == k, row) for k, row in enumerate(rows)]).alias("m")).select("m.*")
    messages = failed if failed is not None else frame.sparkSession.createDataFrame([], MESSAGE_SCHEMA)
    removing = [F.col(_flag(k)) for k, own in enumerate(filters) if own.reporting.emit == "record_failure"]
    survivors = flagged.where(all_of(removing)).select(*[F.col(f"`{c}`") for c in columns])
    critical = tuple(own.name or own.expression for own in filters if own.reporting.emit == "critical_failure")
    return FilterOutcome(survivors, messages, flagged, critical)
