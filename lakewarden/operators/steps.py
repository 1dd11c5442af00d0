"""Steps: what each does to the catalog. A step is a frozen dataclass with ``run``; it also tells which entities
it needs, makes and removes, so that a program can be checked before anything runs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.catalog import Catalog, ConstraintError
from lakewarden.operators.expressions import Expressions, split_expressions, to_columns
from lakewarden.operators.intervals import RangeJoin


@dataclass(frozen=True, kw_only=True)
class Step:
    """Reads ``entity`` and writes the result under ``new_entity_name``, or the same name."""

    entity: str
    new_entity_name: str | None = None
    name: str | None = None
    #: Steps that leave rows alone can run between filters of one entity.
    operation: ClassVar[str] = ""

    @property
    def result(self) -> str:
        return self.new_entity_name or self.entity

    def needs(self) -> set[str]:
        return {self.entity}

    def makes(self) -> set[str]:
        return {self.result}

    def removes(self) -> set[str]:
        return set()

    def build(self, catalog: Catalog) -> DataFrame:
        raise NotImplementedError

    def run(self, catalog: Catalog) -> Catalog:
        return catalog.put(self.result, self.build(catalog))


# Columns


@dataclass(frozen=True, kw_only=True)
class AddColumn(Step):
    """A computed column; a column of that name is replaced in its place."""

    column_name: str
    expression: str
    operation = "add"

    def build(self, catalog: Catalog) -> DataFrame:
        return catalog[self.entity].withColumn(self.column_name, F.expr(self.expression))


@dataclass(frozen=True, kw_only=True)
class RemoveColumn(Step):
    """Without a column; nothing happens if it isn't there."""

    column_name: str
    operation = "remove"

    def build(self, catalog: Catalog) -> DataFrame:
        return catalog[self.entity].drop(self.column_name)


@dataclass(frozen=True, kw_only=True)
class SelectColumns(Step):
    """A projection, which may hold one generator, with or without duplicates."""

    columns: Expressions
    distinct: bool = False
    operation = "select"

    def build(self, catalog: Catalog) -> DataFrame:
        frame = catalog[self.entity].select(*to_columns(self.columns))
        return frame.distinct() if self.distinct else frame


@dataclass(frozen=True, kw_only=True)
class FilterRows(Step):
    """Rows for which the expression is true; no messages."""

    expression: str
    operation = "filter_without_notifying"

    def build(self, catalog: Catalog) -> DataFrame:
        return catalog[self.entity].where(F.expr(self.expression))


# Entities


@dataclass(frozen=True, kw_only=True)
class CopyEntity(Step):
    new_entity_name: str
    operation = "copy_entity"

    def build(self, catalog: Catalog) -> DataFrame:
        return catalog[self.entity]


@dataclass(frozen=True, kw_only=True)
class RenameEntity(CopyEntity):
    operation = "rename_entity"

    def removes(self) -> set[str]:
        return {self.entity} - {self.result}

    def run(self, catalog: Catalog) -> Catalog:
        return super().run(catalog).drop(*self.removes())


@dataclass(frozen=True, kw_only=True)
class RemoveEntities(Step):
    """Without these entities; missing ones are ignored."""

    entity: str | Sequence[str]
    operation = "remove_entity"

    def _names(self) -> list[str]:
        return [self.entity] if isinstance(self.entity, str) else list(self.entity)

    def needs(self) -> set[str]:
        return set()

    def makes(self) -> set[str]:
        return set()

    def removes(self) -> set[str]:
        return set(self._names())

    def run(self, catalog: Catalog) -> Catalog:
        return catalog.drop(*self._names())


# Joins


@dataclass(frozen=True, kw_only=True)
class JoinStep(Step):
    """Both sides are known by their entity names in the condition, which may be any boolean expression."""

    target: str
    join_condition: str
    how: ClassVar[str] = "inner"

    def needs(self) -> set[str]:
        return {self.entity, self.target}

    def sides(self, catalog: Catalog) -> tuple[DataFrame, DataFrame]:
        return catalog[self.entity].alias(self.entity), catalog[self.target].alias(self.target)

    def joined(self, catalog: Catalog) -> DataFrame:
        source, target = self.sides(catalog)
        return source.join(target, F.expr(self.join_condition), self.how)

    def ranges(self, catalog: Catalog, existence: bool = False) -> RangeJoin | None:
        """The join by ranges where the condition compares the sides and equates nothing."""
        found = RangeJoin.of(self.entity, catalog[self.entity], self.target, catalog[self.target], self.join_condition)
        return None if found is not None and existence and found.by_pair and not found.groups else found


def _merged_columns(entity: str, source: DataFrame, target_name: str, target: DataFrame, new_columns: Expressions) -> list[Column]:
    """Source columns, then new ones. Of equal names (in any case) the last wins and takes the place of the first."""
    chosen: dict[str, tuple[str, Column]] = {}

    def take(name: str, column: Column) -> None:
        chosen[name.lower()] = (name, column)

    def take_all(qualifier: str, frame: DataFrame) -> None:
        for name in frame.columns:
            take(name, F.col(f"{qualifier}.`{name}`"))

    take_all(entity, source)
    if isinstance(new_columns, str):
        new_columns = split_expressions(new_columns)
    pairs = new_columns.items() if hasattr(new_columns, "items") else ((text, None) for text in new_columns)
    for text, alias in pairs:
        if text == "*":
            take_all(entity, source)
            take_all(target_name, target)
        elif text in (f"{target_name}.*", f"{entity}.*"):
            take_all(text[:-2], target if text == f"{target_name}.*" else source)
        else:
            name = alias if alias else text.rpartition(".")[2].strip("`")
            take(name, F.expr(text))
    return [column.alias(name) for name, column in chosen.values()]


@dataclass(frozen=True, kw_only=True)
class LeftJoin(JoinStep):
    new_columns: Expressions = ()
    operation = "left_join"
    how = "left"

    def build(self, catalog: Catalog) -> DataFrame:
        source, target = catalog[self.entity], catalog[self.target]
        merge = lambda frame: frame.select(*_merged_columns(self.entity, source, self.target, target, self.new_columns))
        ranges = self.ranges(catalog, existence=self.how == "left")
        if ranges is not None:
            return ranges.left(merge) if self.how == "left" else ranges.pairs(merge)
        return merge(self.joined(catalog))


@dataclass(frozen=True, kw_only=True)
class InnerJoin(LeftJoin):
    operation = "inner_join"
    how = "inner"


def _numbered(frame: DataFrame) -> tuple[DataFrame, str]:
    """``frame`` with a row number of its own. It is unique in one run of a plan, which is all that is needed."""
    name = f"__row_{uuid.uuid4().hex[:8]}"
    return frame.withColumn(name, F.monotonically_increasing_id()), name


@dataclass(frozen=True, kw_only=True)
class OneToOneJoin(LeftJoin):
    """A left join that must not multiply rows, which is checked by a job of its own."""

    perform_integrity_check: bool = True
    operation = "one_to_one_join"

    def build(self, catalog: Catalog) -> DataFrame:
        if self.perform_integrity_check:
            _refuse_many_matches(self, catalog)
        return super().build(catalog)


def _equal_columns(step: JoinStep) -> list[tuple[str, str]] | None:
    """(source column, target column) of a condition that only equates columns of the two; None for any other."""
    name = r"`?([A-Za-z_]\w*)`?\.`?([A-Za-z_]\w*)`?"
    pairs = []
    for part in re.split(r"\s+AND\s+", step.join_condition.strip(), flags=re.IGNORECASE):
        found = re.fullmatch(rf"{name}\s*==?\s*{name}", part.strip())
        sides = {found[1]: found[2], found[3]: found[4]} if found else {}
        if set(sides) != {step.entity, step.target}:
            return None
        pairs.append((sides[step.entity], sides[step.target]))
    return pairs


def _refuse_many_matches(step: JoinStep, catalog: Catalog) -> None:
    """A row with several matches is an error. Where columns are equated, rows that meet a repeated key of the target
    are looked for; ranges tell by the second match of each row; only other conditions need the joined pairs counted by row."""
    equal = _equal_columns(step)
    if equal is not None:
        keys = [F.col(f"`{b}`").alias(f"key_{k}") for k, (_, b) in enumerate(equal)]
        repeated = catalog[step.target].select(*keys).groupBy(*[f"key_{k}" for k in range(len(keys))]).count().where("count > 1").alias("repeated")
        on = [F.col(f"{step.entity}.`{a}`") == F.col(f"repeated.key_{k}") for k, (a, _) in enumerate(equal)]
        found = catalog[step.entity].alias(step.entity).join(repeated, on, "left_semi")
        if not found.isEmpty():
            raise ConstraintError(f"rows of {step.entity!r} match several rows of {step.target!r} on {step.join_condition!r}")
        return
    ranges = step.ranges(catalog, existence=True)
    if ranges is not None:
        if not ranges.several().isEmpty():
            raise ConstraintError(f"rows of {step.entity!r} match several rows of {step.target!r} on {step.join_condition!r}")
        return
    source, row = _numbered(catalog[step.entity])
    pairs = source.alias(step.entity).join(catalog[step.target].alias(step.target), F.expr(step.join_condition))
    if not pairs.groupBy(F.col(f"{step.entity}.{row}")).count().where("count > 1").isEmpty():
        raise ConstraintError(f"rows of {step.entity!r} match several rows of {step.target!r} on {step.join_condition!r}")


@dataclass(frozen=True, kw_only=True)
class SemiJoin(JoinStep):
    operation = "semi_join"
    how = "left_semi"

    def build(self, catalog: Catalog) -> DataFrame:
        ranges = self.ranges(catalog, existence=True)
        if ranges is not None:
            return ranges.exists("__exists__").where(f"__exists__ = {self.how == 'left_semi'}").drop("__exists__")
        return self.joined(catalog)


@dataclass(frozen=True, kw_only=True)
class AntiJoin(SemiJoin):
    operation = "anti_join"
    how = "left_anti"


def _exists(step: JoinStep, catalog: Catalog) -> DataFrame:
    """The source with a boolean ``__exists__``: a correlated EXISTS, which plans to one existence join, or the range join's."""
    ranges = step.ranges(catalog, existence=True)
    if ranges is not None:
        return ranges.exists("__exists__")
    source, target = catalog[step.entity], catalog[step.target]
    names = {"source": source, "target": target}
    text = (
        f"SELECT `{step.entity}`.*, EXISTS(SELECT 1 FROM {{target}} AS `{step.target}` WHERE {_escaped(step.join_condition)})"
        f" AS __exists__ FROM {{source}} AS `{step.entity}`"
    )
    return source.sparkSession.sql(text, **names)


def _escaped(condition: str) -> str:
    return condition.replace("{", "{{").replace("}", "}}")


@dataclass(frozen=True, kw_only=True)
class HasMatch(JoinStep):
    """Whether the row has a match. Several matches are an error unless the check is off; a row is never repeated."""

    column_name: str
    perform_integrity_check: bool = True
    operation = "has_match"

    def build(self, catalog: Catalog) -> DataFrame:
        if self.perform_integrity_check:
            _refuse_many_matches(self, catalog)
        return _exists(self, catalog).withColumn(self.column_name, F.col("__exists__")).drop("__exists__")


@dataclass(frozen=True, kw_only=True)
class IdentifyOrphans(JoinStep):
    """``IsOrphaned``: no match; OR-ed with a column of that name if there is one."""

    column_name: str = "IsOrphaned"
    operation = "identify_orphans"

    def build(self, catalog: Catalog) -> DataFrame:
        frame = _exists(self, catalog)
        orphaned = ~F.col("__exists__")
        if self.column_name in catalog[self.entity].columns:
            orphaned = F.coalesce(F.col(self.column_name), F.lit(False)) | orphaned
        return frame.withColumn(self.column_name, orphaned).drop("__exists__")


@dataclass(frozen=True, kw_only=True)
class JoinHeader(Step):
    """The one row of ``target`` as a struct beside every row. One row by contract, so it is broadcast."""

    target: str
    header_column_name: str = "_Header"
    operation = "join_header"

    def needs(self) -> set[str]:
        return {self.entity, self.target}

    def build(self, catalog: Catalog) -> DataFrame:
        header = catalog[self.target]
        if len(header.limit(2).take(2)) != 1:
            raise ConstraintError(f"header entity {self.target!r} must have exactly one row")
        packed = header.select(F.struct(*[F.col(f"`{c}`") for c in header.columns]).alias(self.header_column_name))
        return catalog[self.entity].drop(self.header_column_name).crossJoin(F.broadcast(packed))


# Sets and groups


@dataclass(frozen=True, kw_only=True)
class Union(Step):
    """UNION ALL by name in any case; missing columns are null; the source's spelling and order come first."""

    target: str
    operation = "union"

    def needs(self) -> set[str]:
        return {self.entity, self.target}

    def build(self, catalog: Catalog) -> DataFrame:
        source, target = catalog[self.entity], catalog[self.target]
        spelling = {c.lower(): c for c in source.columns}
        renamed = target.select(*[F.col(f"`{c}`").alias(spelling.get(c.lower(), c)) for c in target.columns])
        return source.unionByName(renamed, allowMissingColumns=True)


@dataclass(frozen=True, kw_only=True)
class GroupBy(Step):
    """Aggregates by group (or of all rows), perhaps pivoted; give pivot values to spare the job that finds them."""

    group_by: Expressions = ()
    agg_columns: Expressions
    pivot_column: str | None = None
    pivot_values: Sequence | None = None
    operation = "group_by"

    def __post_init__(self) -> None:
        if self.pivot_values and not self.pivot_column:
            raise ValueError("pivot values need a pivot column")

    def build(self, catalog: Catalog) -> DataFrame:
        grouped = catalog[self.entity].groupBy(*to_columns(self.group_by))
        if self.pivot_column:
            grouped = grouped.pivot(self.pivot_column, list(self.pivot_values) if self.pivot_values else None)
        return grouped.agg(*to_columns(self.agg_columns))


STEPS: dict[str, type[Step]] = {
    cls.operation: cls
    for cls in (
        AddColumn, RemoveColumn, SelectColumns, FilterRows, CopyEntity, RenameEntity, RemoveEntities, LeftJoin, InnerJoin,
        OneToOneJoin, SemiJoin, AntiJoin, HasMatch, IdentifyOrphans, JoinHeader, Union, GroupBy,
    )
} | {"join": OneToOneJoin, "remove_entities": RemoveEntities}
