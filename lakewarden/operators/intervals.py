"""Joins on ranges: conditions that compare the two sides and equate nothing, without nested loops.

Such a condition is a conjunction with at least one comparison (or BETWEEN) of an expression of the source with one of the
target. One comparison bounds the source from below (``s1 <= t2``) and one from above (``s2 >= t1``); together they say that the
intervals ``[s1, s2]`` and ``[t1, t2]`` overlap. Everything else in the condition is checked on what they leave.

*Pairs.* Values become places on one axis of doubles (an order-preserving map for numbers, times and texts). Approximate
quantiles of all ends cut the axis, and equal cuts of the stretches between them make leaves of some ``LEAF_ROWS`` rows. Over the
leaves lies a binary tree. An interval goes to the few nodes that cover it exactly, a point to its leaf's ancestors at the levels
in use, so both meet at one node, and long intervals cost the logarithm of their length. Two intervals overlap if one begins
inside the other, which makes two joins of points with intervals. A node with very many rows is dealt out in
both directions: each side's rows are split over its own salts and repeated over the other's.

*Existence and uniqueness.* A source row has a match if the largest ``t2`` among targets with ``t1 <= s2`` reaches its ``s1``, and
several if the second largest does. Both are running maxima over the targets in the order of ``t1``, within leaves and carried from leaf to
leaf; of every ``t1`` only two rows are looked at and no pair is ever formed.

Building such a join runs up to three jobs that only aggregate: for the quantiles, for the levels in use and, where there are rows
enough for a crowded node, for the nodes that are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quantiles that cut the axis (a power of two), and rows of a leaf of the tree.
CUTS = 256
LEAF_ROWS = 500
MAX_PARTS = 1 << 20
#: Leaves for running maxima are larger; one table has a row for each (at most CUTS * REACH_PARTS).
REACH_ROWS = 100_000
REACH_PARTS = 1 << 11
#: Rows of one side of a node beyond which it is dealt out, or a thousandth of all ends if that is more.
NODE_ROWS = 20_000

_COMPARISON = {"<": (True, True), "<=": (True, False), ">": (False, True), ">=": (False, False)}
_EQUAL = {"=", "==", "<=>"}
_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|<=>|<=|>=|<>|!=|==|[<>=()\[\]]|\w+|\s+|.", re.DOTALL)


def _tokens(text: str) -> list[tuple[int, str, int]]:
    """(place, token in upper case, depth) outside brackets and CASE expressions counted as depth 0."""
    out, depth = [], 0
    for found in _TOKEN.finditer(text):
        token = found[0].upper()
        if token in (")", "]", "END"):
            depth -= 1
        out.append((found.start(), token, depth))
        if token in ("(", "[", "CASE"):
            depth += 1
    return out


def conjuncts(text: str) -> list[str]:
    """The parts of a condition that must all hold; the whole text where OR or NOT stands outside brackets."""
    text = text.strip()
    tokens = _tokens(text)
    while text.startswith("(") and [t for t in tokens[1:-1] if t[2] == 0] == [] and text.endswith(")"):
        text = text[1:-1].strip()
        tokens = _tokens(text)
    top = [(at, token) for at, token, depth in tokens if depth == 0]
    if any(token == "OR" for _, token in top):
        return [text]
    parts, begin, between = [], 0, False
    for at, token in top:
        if token == "BETWEEN":
            between = True
        elif token == "AND" and between:
            between = False
        elif token == "AND":
            parts.append(text[begin:at])
            begin = at + 3
    parts.append(text[begin:])
    return [part.strip() for part in parts] if len(parts) == 1 else [p for part in parts for p in conjuncts(part)]


def comparisons(part: str) -> list[tuple[str, str, str]]:
    """(left, operator, right) of a conjunct that is one comparison or a BETWEEN; nothing for any other."""
    tokens = _tokens(part)
    top = [(at, token) for at, token, depth in tokens if depth == 0]
    words = [token for _, token in top]
    if set(words) & {"NOT", "OR", "IS", "IN", "LIKE", "RLIKE", "EXISTS", "<>", "!=", "!"}:
        return []
    operators = [(at, token) for at, token in top if token in _COMPARISON or token in _EQUAL]
    if "BETWEEN" in words and not operators:
        at = next(a for a, token in top if token == "BETWEEN")
        cut = next(a for a, token in top if token == "AND" and a > at)
        middle = part[:at].strip()
        return [(middle, ">=", part[at + 7 : cut].strip()), (middle, "<=", part[cut + 3 :].strip())]
    if len(operators) != 1 or "BETWEEN" in words:
        return []
    at, operator = operators[0]
    return [(part[:at].strip(), operator, part[at + len(operator) :].strip())]


def _named(text: str, columns: dict[str, list[str]]) -> set[str]:
    """Entities that an expression names, by qualifier or by a column that only one of them has."""
    found = set()
    lower = {name: {c.lower() for c in own} for name, own in columns.items()}
    for name, dotted in re.findall(r"(?<![.\w`])`?(\w+)`?\s*(\.?)", re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text)):
        entities = {e for e in columns if e.lower() == name.lower()} if dotted else set()
        found |= entities or {e for e, own in lower.items() if name.lower() in own}
    return found


@dataclass(frozen=True)
class Term:
    """``source <= target`` (or ``<``), or with ``above`` the other way round, compared as ``kind``."""

    source: str
    target: str
    above: bool
    strict: bool
    kind: T.DataType

    def typed(self, text: str) -> Column:
        return F.expr(f"CAST(({text}) AS {self.kind.simpleString()})")


@dataclass(frozen=True)
class RangeCondition:
    text: str
    #: ``s1 <= t2`` and ``s2 >= t1``; one may be missing.
    low: Term | None
    high: Term | None
    source_only: list[str] = field(default_factory=list)
    target_only: list[str] = field(default_factory=list)
    rest: list[str] = field(default_factory=list)


def _family(kind: T.DataType) -> str | None:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "time"
    return "text" if type(kind) is T.StringType and kind.isUTF8BinaryCollation() else None


def _place(value: Column, kind: T.DataType) -> Column:
    """A double that orders as the value does; different values may have one place."""
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    day = F.unix_date(value.cast("date")) * F.lit(86400.0)
    if isinstance(kind, T.DateType):
        return day
    return day + F.hour(value) * 3600 + F.minute(value) * 60 + F.extract(F.lit("SECOND"), value).cast("double")


@dataclass(frozen=True)
class Axis:
    """Quantiles of all places, the least and the most of them, their number, and the parts of each stretch."""

    cuts: list[float]
    least: float
    most: float
    count: int
    parts: int

    @property
    def levels(self) -> int:
        return (CUTS * self.parts).bit_length() + 1


class RangeJoin:
    """The pairs, or the matched rows, of two entities under a :class:`RangeCondition`."""

    def __init__(self, entity: str, source: DataFrame, target_name: str, target: DataFrame, condition: RangeCondition) -> None:
        self.entity, self.source, self.target_name, self.target, self.condition = entity, source, target_name, target, condition

    @classmethod
    def of(cls, entity: str, source: DataFrame, target_name: str, target: DataFrame, text: str) -> RangeJoin | None:
        """A range join where the condition is one; None where a side is equated or nothing is compared."""
        sides = {}

        def side(expression: str) -> tuple[str, T.DataType | None]:
            if expression not in sides:
                sides[expression] = ("", None)
                named = _named(expression, {entity: source.columns, target_name: target.columns})
                if len(named) == 1:
                    (name,) = named
                    try:
                        kind = (source if name == entity else target).alias(name).select(F.expr(expression)).schema[0].dataType
                        sides[expression] = (name, kind)
                    except AnalysisException:
                        pass
            return sides[expression]

        lows, highs, rest, only = [], [], [], {entity: [], target_name: []}
        if entity == target_name:
            return None
        for part in conjuncts(text):
            own = side(part)[0]
            if own:
                only[own].append(part)
                continue
            used = False
            for left, operator, right in comparisons(part):
                (a, kind_a), (b, kind_b) = side(left), side(right)
                if {a, b} != {entity, target_name}:
                    continue
                if operator in _EQUAL:
                    return None
                if _family(kind_a) is None or _family(kind_a) != _family(kind_b) or isinstance(kind_a, T.TimestampNTZType) != isinstance(kind_b, T.TimestampNTZType):
                    continue
                blank = source.sparkSession.range(0).select(F.greatest(F.lit(None).cast(kind_a), F.lit(None).cast(kind_b)))
                less, strict = _COMPARISON[operator]
                term = Term(*((left, right) if a == entity else (right, left)), above=less != (a == entity), strict=strict, kind=blank.schema[0].dataType)
                (highs if term.above else lows).append((term, part))
                used = True
            if not used:
                rest.append(part)
        if not lows and not highs:
            return None
        pairs = [(a, b) for a in lows or [(None, None)] for b in highs or [(None, None)]]
        low, high = max(pairs, key=lambda p: bool(p[0][0] and p[1][0]) and (2 * (p[0][0].target == p[1][0].target) + (p[0][0].source == p[1][0].source)))
        # A BETWEEN of which one comparison is taken and the other not is checked as a whole.
        taken = [x[1] for x in (low, high) if x[0]]
        spare = {part for term, part in lows + highs if term not in (low[0], high[0])}
        rest += sorted(spare | {part for part in taken if part in spare})
        return cls(entity, source, target_name, target, RangeCondition(text, low[0], high[0], only[entity], only[target_name], rest))

    # Places and leaves

    def _ends(self) -> tuple[DataFrame, DataFrame]:
        """Both sides with the places of their intervals as ``__lo`` and ``__hi`` (an open end is infinite); rows with a null end are left out."""
        low, high = self.condition.low, self.condition.high

        def ends(frame: DataFrame, name: str, first: tuple[Term | None, str], last: tuple[Term | None, str]) -> DataFrame:
            at = lambda end, open_: _place(end[0].typed(getattr(end[0], end[1])), end[0].kind) if end[0] else F.lit(open_)
            return frame.alias(name).select(f"`{name}`.*", at(first, float("-inf")).alias("__lo"), at(last, float("inf")).alias("__hi")).where("__lo IS NOT NULL AND __hi IS NOT NULL")

        source = ends(self.source, self.entity, (low, "source"), (high, "source"))
        target = ends(self.target, self.target_name, (high, "target"), (low, "target"))
        for part in self.condition.source_only:
            source = source.alias(self.entity).where(F.expr(part))
        for part in self.condition.target_only:
            target = target.alias(self.target_name).where(F.expr(part))
        # An interval that ends before it begins matches only what holds both its ends: one of them stands for it.
        return source.withColumn("__hi", F.greatest("__lo", "__hi")), target.withColumn("__lo", F.least("__lo", "__hi"))

    @staticmethod
    def _axis(places: Sequence[DataFrame], leaf_rows: int, most: int) -> Axis:
        """The axis of these places, by one job that aggregates them."""
        together = places[0]
        for other in places[1:]:
            together = together.unionAll(other)
        together = together.toDF("x").where("NOT isnan(x) AND abs(x) < double('infinity')")
        cuts = F.percentile_approx("x", [k / CUTS for k in range(1, CUTS)], 20 * CUTS)
        found = together.agg(cuts.alias("cuts"), F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("n")).first()
        return Axis(found.cuts or [], found.least or 0.0, found.most or 0.0, found.n, min(most, 1 + found.n // (CUTS * leaf_rows)))

    @staticmethod
    def _with_leaf(frame: DataFrame, x: str, leaf: str, axis: Axis) -> DataFrame:
        """``frame`` with the number of the leaf of place ``x``, which never falls as the place grows."""
        cuts = axis.cuts + axis.cuts[-1:] * (CUTS - 1 - len(axis.cuts)) or [axis.most] * (CUTS - 1)
        table = f"array({', '.join(f'{c!r}D' for c in cuts)})"
        steps = ", ".join(str(CUTS >> k) for k in range(1, CUTS.bit_length()))
        stretch = f"aggregate(array({steps}), 0, (c, k) -> IF({table}[c + k - 1] <= {x}, c + k, c))"
        begin, end = f"IF(__c = 0, {axis.least!r}D, {table}[greatest(__c - 1, 0)])", f"IF(__c >= {CUTS - 1}, {axis.most!r}D, {table}[least(__c, {CUTS - 2})])"
        part = f"coalesce(CAST(floor(({x} - {begin}) / nullif({end} - {begin}, 0D) * {axis.parts}) AS bigint), 0L)"
        within = f"IF(isnan({x}), {axis.parts - 1}L, greatest(0L, least({axis.parts - 1}L, {part})))"
        # Never null, so that no filter for it, with the search inside, is put before other steps.
        return frame.withColumn("__c", F.expr(stretch)).withColumn(leaf, F.expr(f"coalesce(__c * {axis.parts}L + {within}, 0L)")).drop("__c")

    # Pairs

    def pairs(self, select: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``select`` of the matching pairs, each once; it knows the sides by their entity names."""
        source, target = self._ends()
        low, high = self.condition.low, self.condition.high
        ends = [source.select("__lo"), source.select("__hi"), target.select("__lo"), target.select("__hi")]
        axis = self._axis(ends, LEAF_ROWS, MAX_PARTS)
        condition = F.expr(self.condition.text)
        first, second = F.col(f"`{self.entity}`.__lo"), F.col(f"`{self.target_name}`.__lo")
        if low is None or high is None or low.target == high.target:
            begins = "__hi" if high is None else "__lo"
            return select(self._meet((source, self.entity), (target, self.target_name), begins, axis, condition))
        if low.source == high.source:
            return select(self._meet((target, self.target_name), (source, self.entity), "__lo", axis, condition))
        inside = self._meet((source, self.entity), (target, self.target_name), "__lo", axis, condition & (first <= second))
        around = self._meet((target, self.target_name), (source, self.entity), "__lo", axis, condition & (second < first))
        return select(inside).unionAll(select(around))

    def _meet(self, intervals: tuple[DataFrame, str], points: tuple[DataFrame, str], begins: str, axis: Axis, condition: Column) -> DataFrame:
        """Points (column ``begins``) that lie in intervals, at the nodes of the tree, where the condition holds."""
        # At level k the cover of [first, last] takes its left end if that is odd, and its right end if it is even.
        left = lambda k: f"shiftright(__first + {(1 << k) - 1}L, {k})"
        right = lambda k: f"shiftright(__last + 1L, {k})"
        takes_left = lambda k: f"{left(k)} < {right(k)} AND {left(k)} % 2 = 1"
        takes_right = lambda k: f"{left(k)} < {right(k)} AND {right(k)} % 2 = 1"
        wide = self._with_leaf(self._with_leaf(intervals[0], "__lo", "__first", axis), "__hi", "__last", axis)
        used = wide.agg(*[F.bool_or(F.expr(f"{takes_left(k)} OR {takes_right(k)}")) for k in range(axis.levels)]).first()
        levels = [k for k, level in enumerate(used) if level]
        nodes = [f"IF({takes_left(k)}, {k << 48}L + {left(k)}, NULL), IF({takes_right(k)}, {k << 48}L + {right(k)} - 1L, NULL)" for k in levels]
        wide = wide.withColumn("__node", F.explode(F.expr(f"array({', '.join(nodes) or 'CAST(NULL AS bigint)'})"))).where("__node IS NOT NULL").drop("__first", "__last")
        narrow = self._with_leaf(points[0], begins, "__leaf", axis)
        ancestors = [f"{k << 48}L + shiftright(__leaf, {k})" for k in levels]
        narrow = narrow.withColumn("__node", F.explode(F.expr(f"array({', '.join(ancestors) or 'CAST(NULL AS bigint)'})"))).drop("__leaf")
        same = ["__node"]
        most = max(NODE_ROWS, axis.count // 1000)
        if axis.count > most:
            same += ["__rows_at", "__columns_at"]
            wide, narrow = self._dealt(wide, narrow, most)
        a, b = wide.alias(intervals[1]), narrow.alias(points[1])
        sides = (a, b) if intervals[1] == self.entity else (b, a)
        for name in same:
            condition = (F.col(f"`{intervals[1]}`.{name}") == F.col(f"`{points[1]}`.{name}")) & condition
        return sides[0].join(sides[1], condition)

    @staticmethod
    def _dealt(wide: DataFrame, narrow: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """Both sides of nodes with over ``most`` rows of one in rows and columns of tasks, as ``__rows_at`` and ``__columns_at``."""
        counts = lambda frame, name: frame.groupBy("__node").agg(F.count(F.lit(1)).alias(name))
        both = counts(wide, "__w").join(counts(narrow, "__n"), "__node").where(f"__w > {most} OR __n > {most}")
        # At most some ten thousand nodes: each has a thousandth of the rows, and a row is at some tens of nodes.
        crowded = both.select("__node", F.expr(f"CAST(1 + __w DIV {most} AS int)").alias("__rows"), F.expr(f"CAST(1 + __n DIV {most} AS int)").alias("__columns"))
        crowded = wide.sparkSession.createDataFrame(crowded.toArrow()) if not crowded.isEmpty() else crowded

        def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
            # Copies of a row fall apart by the partition they come from; a task that runs again deals them alike.
            salt = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in frame.schema if not _has_map(f.dataType)], F.spark_partition_id()), F.coalesce(own, F.lit(1))).cast("int")
            spread = frame.join(F.broadcast(crowded), "__node", "left").withColumn(f"{own}_at", salt)
            return spread.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("__rows", "__columns")

        return dealt(wide, "__rows", "__columns"), dealt(narrow, "__columns", "__rows")

    # Existence and uniqueness

    def _reach(self) -> tuple[Column | None, DataFrame | None]:
        """For a condition of one comparison the two extremes of the target; for two the table of running maxima by ``s2``."""
        low, high, name = self.condition.low, self.condition.high, self.target_name
        target = self.target.alias(name)
        for part in self.condition.target_only:
            target = target.where(F.expr(part))
        if low is None or high is None:
            term = low or high
            value = target.select(term.typed(term.target).alias("x")).where("x IS NOT NULL")
            two = value.orderBy(F.desc("x") if term is low else F.asc("x")).limit(2)
            return two.agg(F.sort_array(F.collect_list("x"), asc=term is high)).scalar(), None
        rows = target.select(high.typed(high.target).alias("v"), low.typed(low.target).alias("reach")).where("v IS NOT NULL AND reach IS NOT NULL")
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("reach")))).where("place <= 2").select("v", "reach", F.lit(int(high.strict)).alias("turn"))
        asked = self.source.alias(self.entity).select(high.typed(high.source).alias("v")).where("v IS NOT NULL").distinct()
        asked = asked.select("v", F.lit(None).cast(low.kind).alias("reach"), F.lit(int(not high.strict)).alias("turn"))
        # Equal values: a target counts for the source's end unless the comparison is strict.
        together = rows.unionAll(asked).withColumn("x", _place(F.col("v"), high.kind))
        axis = self._axis([rows.select(_place(F.col("v"), high.kind)), asked.select(_place(F.col("v"), high.kind))], REACH_ROWS, REACH_PARTS)
        together = self._with_leaf(together, "x", "leaf", axis).drop("x")
        order = Window.partitionBy("leaf").orderBy("v", "turn")
        upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
        both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.least(a, b))
        running = together.withColumn("best", F.max("reach").over(upto)).withColumn("prior", F.max("reach").over(before))
        running = running.withColumn("second", F.max(both("reach", "prior")).over(upto))
        leaves = running.groupBy("leaf").agg(F.max("best").alias("best"), F.max("second").alias("second"))
        earlier = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        carried = leaves.withColumn("prior", F.max("best").over(earlier)).withColumn("candidate", F.greatest("second", both("best", "prior")))
        carried = carried.select(F.col("leaf").alias("from_leaf"), F.col("prior").alias("before_best"), F.max("candidate").over(earlier).alias("before_second"))
        asked = running.where(F.col("turn") == int(not high.strict)).join(carried, F.col("leaf") == F.col("from_leaf"))
        two = F.greatest("second", "before_second", both("best", "before_best"))
        return None, asked.select(F.col("v").alias("__v"), F.array(F.greatest("best", "before_best"), two).alias("__reach"))

    def counted(self) -> DataFrame:
        """The source with ``__matches``: null for none, 1, or 2 for several. Only for conditions that leave nothing to check by pair."""
        low, high = self.condition.low, self.condition.high
        extremes, table = self._reach()
        source = self.source.alias(self.entity)
        own = F.lit(True)
        for part in self.condition.source_only:
            own = own & F.expr(part)
        term = low or high
        reach = extremes if extremes is not None else F.col("__reach")
        value = term.typed(term.source)
        compare = {(False, False): value.__le__, (False, True): value.__lt__, (True, False): value.__ge__, (True, True): value.__gt__}[term.above, term.strict]
        if table is not None:
            source = source.join(table, high.typed(high.source) == F.col("__v"), "left")
        number = F.when(own & compare(F.get(reach, 1)), 2).when(own & compare(F.get(reach, 0)), 1)
        return source.select(f"`{self.entity}`.*", number.alias("__matches"))

    @property
    def by_pair(self) -> bool:
        return bool(self.condition.rest)

    @property
    def groups(self) -> bool:
        """Whether rows of the source can be compared, which conditions by pair need for existence."""
        return not any(_has_map(f.dataType) for f in self.source.schema)

    def exists(self, column: str) -> DataFrame:
        """The source with a boolean column: whether a row has a match."""
        if not self.by_pair:
            return self.counted().withColumn(column, F.col("__matches").isNotNull()).drop("__matches")
        names = self.source.columns
        matched = self.pairs(lambda frame: frame.select(*[F.col(f"`{self.entity}`.`{c}`").alias(f"__{k}") for k, c in enumerate(names)])).distinct().withColumn("__found", F.lit(True))
        same = [F.col(f"`{self.entity}`.`{c}`").eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(names)]
        on = same[0]
        for other in same[1:]:
            on = on & other
        found = self.source.alias(self.entity).join(matched, on, "left")
        return found.select(f"`{self.entity}`.*", F.coalesce("__found", F.lit(False)).alias(column))

    def several(self) -> DataFrame:
        """Rows of the source with several matches (by pair: each such row once)."""
        if not self.by_pair:
            return self.counted().where("__matches = 2").drop("__matches")
        alone = RangeJoin(self.entity, self.source.distinct(), self.target_name, self.target, self.condition)
        pairs = alone.pairs(lambda frame: frame.select(*[F.col(f"`{self.entity}`.`{c}`").alias(f"__{k}") for k, c in enumerate(self.source.columns)]))
        return pairs.groupBy(*pairs.columns).count().where("count > 1").drop("count").toDF(*self.source.columns)

    def left(self, select: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``select`` of the pairs and of the source rows that have none, with a target of nulls."""
        unmatched = self.exists("__exists__").where("NOT __exists__").drop("__exists__").alias(self.entity)
        alone = unmatched.join(self.target.where("false").alias(self.target_name), F.lit(True), "left")
        return self.pairs(select).unionAll(select(alone))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType | T.VariantType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))
