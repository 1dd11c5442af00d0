"""The three-phase evaluation of rules: every rule's preparation, then all filters together, then what follows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lakewarden.operators.catalog import Catalog
from lakewarden.operators.filters import apply_filters
from lakewarden.plans.messages import MESSAGE_SCHEMA
from lakewarden.plans.templating import render


STRATEGIES = ("upfront", "runtime")


class CriticalFailure(RuntimeError):
    """A filter whose failure must stop the run has failed for some record."""


@dataclass(frozen=True)
class Rule:
    """Steps before the filters, filters, and steps after them, as JSON that may hold templates."""

    name: str
    pre_sync: tuple[Mapping[str, Any], ...] = ()
    sync_filters: tuple[Mapping[str, Any], ...] = ()
    post_sync: tuple[Mapping[str, Any], ...] = ()
    parameters: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Outcome:
    catalog: Catalog
    messages: DataFrame


def check_program(rules: Sequence[Rule], available: set[str], parameters: Mapping[str, Any]) -> list[str]:
    """Entities that steps or filters need and nothing has made by then, in order of evaluation."""
    from lakewarden.plans.config import build_step

    have, missing = set(available), []
    for phase in ("pre_sync", "sync_filters", "post_sync"):
        for rule in rules:
            for spec in render(getattr(rule, phase), {**parameters, **rule.parameters}):
                step = None if phase == "sync_filters" else build_step(spec)
                needed = {spec["entity"]} if step is None else step.needs()
                missing += sorted(f"{rule.name}: {name}" for name in needed - have if not name.startswith("refdata_"))
                if step is not None:
                    have = (have | step.makes()) - step.removes()
    return missing


def evaluate(
    catalog: Catalog,
    rules: Sequence[Rule],
    parameters: Mapping[str, Any] | None = None,
    keys: Mapping[str, Sequence[str]] | None = None,
    hold: Callable[[DataFrame], DataFrame] | None = None,
    templating: str = "upfront",
) -> Outcome:
    """Run a program. ``keys`` names each entity's key fields; ``hold`` may persist or stage the flagged rows, which
    both messages and survivors read. Only critical filters run a job here. Templates are rendered ``upfront``, so that
    one that can't be rendered or built stops the run before any step, or at ``runtime``, each before its step."""
    from lakewarden.plans.config import build_filter, build_step

    parameters, keys = parameters or {}, keys or {}
    if templating not in STRATEGIES:
        raise ValueError(f"unknown templating strategy {templating!r}")

    def built(phase: str, build: Callable) -> Iterable:
        made = (build(render(spec, {**parameters, **rule.parameters})) for rule in rules for spec in getattr(rule, phase))
        return list(made) if templating == "upfront" else made

    before, filters_of, after = built("pre_sync", build_step), built("sync_filters", build_filter), built("post_sync", build_step)
    for step in before:
        catalog = step.run(catalog)

    by_entity: dict[str, list] = {}
    for own in filters_of:
        by_entity.setdefault(own.entity, []).append(own)
    messages: list[DataFrame] = []
    for entity, filters in by_entity.items():
        frame = catalog[entity] if hold is None else hold(catalog[entity])
        found = apply_filters(frame, filters, keys.get(filters[0].original_entity or entity, ()))
        if found.critical:
            failing = found.messages.where("FailureType = 'integrity'").limit(1).collect()
            if failing:
                raise CriticalFailure(f"{failing[0]['ErrorType']}: {failing[0]['ErrorMessage']}")
        messages.append(found.messages)
        catalog = catalog.put(entity, found.survivors)

    for step in after:
        catalog = step.run(catalog)
    return Outcome(catalog, union_messages(messages, catalog))


def union_messages(frames: Sequence[DataFrame], catalog: Catalog | None = None) -> DataFrame:
    if not frames:
        spark = next(iter(catalog.entities.values())).sparkSession
        return spark.createDataFrame([], MESSAGE_SCHEMA)
    total = frames[0]
    for frame in frames[1:]:
        total = total.unionByName(frame)
    return total
