"""Contract types: for each a Spark type, a cast that gives null for what it can't read, and a test of the text.

Test and cast are independent: the test follows the lax coercion of the contract language (``1.0`` is an int,
``yes`` a bool), the cast reads the trimmed text. All are native expressions, so an entity compiles to one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import dates
from lakewarden.functions.library import digits_of_ten, mod11_holds


@dataclass(frozen=True)
class TypeRule:
    """``valid`` is a boolean of a string that isn't null; ``warning`` a text where a valid value is suspect."""

    data_type: T.DataType
    cast: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    warning: Callable[[Column], Column] | None = None
    error_type: str = "value_error"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


# Numbers

_INT = r"\A[+-]?[0-9]+(?:_[0-9]+)*(?:\.0+)?\z"
_FLOAT = r"\A(?i:[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+)?|nan|inf|infinity))\z"
_DECIMAL = r"\A(?i:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"


def _plain(text: Column) -> Column:
    return F.translate(F.trim(text), "_", "")


def _whole(text: Column) -> Column:
    """The integer that the text begins with, if nothing but a fraction follows."""
    return F.nullif(F.regexp_extract(F.trim(text), r"\A([+-]?[0-9]+)(?:\.[0-9]*)?\z", 1), F.lit("")).try_cast("bigint")


def _real(text: Column) -> Column:
    return F.regexp_replace(_plain(text), r"\A([+-]?)(?i:inf)\z", "$1Infinity").try_cast("double")


def _within(value: Column, bounds: Mapping[str, Any], literal: Callable[[Any], Column] = F.lit) -> Column:
    tests = {"gt": lambda b: value > b, "ge": lambda b: value >= b, "lt": lambda b: value < b, "le": lambda b: value <= b}
    total = F.lit(True)
    for name, test in tests.items():
        if bounds.get(name) is not None:
            total &= test(literal(bounds[name]))
    return total


def _integer(**bounds: Any) -> TypeRule:
    def valid(text: Column) -> Column:
        value = F.regexp_replace(_plain(text), r"\.0*\z", "").try_cast("decimal(38,0)")
        fits = _within(value, bounds)
        if bounds.get("multiple_of"):
            fits &= value % F.lit(bounds["multiple_of"]) == 0
        return _matches(F.trim(text), _INT) & fits

    return TypeRule(T.LongType(), _whole, valid, error_type="int_parsing")


def _float(**bounds: Any) -> TypeRule:
    # Spark holds NaN for larger than any number; in the contract language it is within no bound.
    bounded = any(bounds.get(k) is not None for k in ("gt", "ge", "lt", "le"))
    valid = lambda text: _matches(F.trim(text), _FLOAT) & _within(_real(text), bounds) & (~F.isnan(_real(text)) if bounded else F.lit(True))
    return TypeRule(T.DoubleType(), lambda text: F.trim(text).try_cast("double"), valid, error_type="float_parsing")


def _decimal(max_digits: int | None = None, decimal_places: int | None = None, **bounds: Any) -> TypeRule:
    kind = T.DecimalType(max_digits or 38, decimal_places if decimal_places is not None else (0 if max_digits else 18))

    def valid(text: Column) -> Column:
        plain = F.regexp_replace(_plain(text), r"\A[+-]", "")
        fraction = F.regexp_extract(plain, r"\.([0-9]*)", 1)
        whole = F.regexp_replace(F.regexp_extract(plain, r"\A([0-9]*)", 1), r"\A0+", "")
        fits = _within(_plain(text).try_cast("decimal(38,18)"), bounds)
        if decimal_places is not None:
            fits &= F.length(fraction) <= decimal_places
        if max_digits is not None:
            fits &= F.length(whole) + F.length(fraction) <= max_digits
        if max_digits is not None and decimal_places is not None:
            fits &= F.length(whole) <= max_digits - decimal_places
        return _matches(_plain(text), _DECIMAL) & fits

    return TypeRule(kind, lambda text: _plain(text).try_cast(kind), valid, error_type="decimal_parsing")


# Strings


def _string(
    strip_whitespace: bool = True, to_lower: bool = False, strict: bool = False, min_length: int | None = None,
    max_length: int | None = None, regex: str | None = None, pattern: str | None = None, **_: Any,
) -> TypeRule:
    def valid(text: Column) -> Column:
        text = F.trim(text) if strip_whitespace else text
        fits = F.lit(True)
        if min_length is not None:
            fits &= F.length(text) >= min_length
        if max_length is not None:
            fits &= F.length(text) <= max_length
        if regex or pattern:
            fits &= _matches(text, regex or pattern)
        return fits

    return TypeRule(T.StringType(), F.trim, valid, error_type="string_pattern_mismatch" if regex or pattern else "string_length")


def _characters(group: str, max_digits: int = 1, min_digits: int | None = None) -> TypeRule:
    times = f"{max_digits}" if min_digits in (None, max_digits) else f"{min_digits},{max_digits}"
    return _string(pattern=rf"\A{group}{{{times}}}\z")


# Character classes and shapes of the domain types.
ALPHANUMERIC = "[A-Za-z0-9]"
IDENTIFIER = r"[A-Za-z0-9_\-=\/\\#:; ().`*!,|+'\^\[\]]"
ORG_ID = r"\A[A-Z0-9]{3,5}\z"
POSTCODE = r"\A[a-zA-Z]{1,2}[0-9](?:[a-zA-Z]?|[0-9]?)\s[0-9][a-zA-Z]{2}\z"
NO_POSTCODE = ("tba", "tbc", "na", "n/a", "no valid")


def normalised_postcode(text: Column) -> Column:
    """Without spaces, in upper case, with a space before the last three characters; null for a placeholder."""
    tight = F.regexp_replace(text, " ", "")
    size = F.length(tight)
    spaced = F.upper(F.concat_ws(" ", F.substring(tight, F.lit(1), F.greatest(size - 3, F.lit(0))), F.substring(tight, F.greatest(size - 2, F.lit(1)), F.lit(3))))
    return F.when((tight != "") & ~F.lower(tight).isin(*NO_POSTCODE), spaced)


def _postcode(apply_normalize: bool = True, pattern: str | None = None, **_: Any) -> TypeRule:
    def valid(text: Column) -> Column:
        shown = normalised_postcode(text) if apply_normalize else F.nullif(F.trim(text), F.lit(""))
        return shown.isNull() | _matches(shown, pattern or POSTCODE)

    return TypeRule(T.StringType(), F.trim, valid)


def _nhs(warn_on_test_numbers: bool = True) -> TypeRule:
    def valid(text: Column) -> Column:
        ten = digits_of_ten(text)
        return _matches(ten, r"\A[0-9]{10}\z") & F.coalesce(mod11_holds(ten), F.lit(False))

    def warning(text: Column) -> Column:
        ten = digits_of_ten(text)
        reason = F.when(F.startswith(ten, F.lit("9")), "NHS number starts with '9': this indicates a test number").when(
            ten == F.reverse(ten), "NHS number is a palindrome: this indicates a test number"
        )
        return F.concat(F.lit("NHS number possibly invalid ("), reason, F.lit(")"))

    return TypeRule(T.StringType(), F.trim, valid, warning if warn_on_test_numbers else None)


def _boolean() -> TypeRule:
    true, false = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")
    low = lambda text: F.lower(text)
    cast = lambda text: F.when(low(F.trim(text)).isin(*true), True).when(low(F.trim(text)).isin(*false), False)
    return TypeRule(T.BooleanType(), cast, lambda text: low(text).isin(*true, *false), error_type="bool_parsing")


# Dates and times


def _date_literal(value: Any) -> Column:
    return F.lit(str(value)).try_cast("date")


def _iso_date(text: Column) -> Column:
    """ISO dates, datetimes at midnight, and whole days in epoch seconds."""
    iso = F.when(_matches(text, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ]00:00(?::00(?:\.0+)?)?)?\z"), F.substring(text, 1, 10)).try_cast("date")
    seconds = F.when(_matches(text, r"\A-?[0-9]{1,11}\z"), text.try_cast("bigint"))
    return F.coalesce(iso, F.when(seconds % 86400 == 0, F.timestamp_seconds(seconds).cast("date")))


def _date(python_format: str | None = None, strict: bool = False, **bounds: Any) -> TypeRule:
    cast = lambda text: dates.parse(F.trim(text), python_format or dates.ISO_DATE).cast("date")
    read = cast if python_format else _iso_date

    def valid(text: Column) -> Column:
        day = read(text)
        return day.isNotNull() & F.coalesce(_within(day, bounds, _date_literal), F.lit(False))

    return TypeRule(T.DateType(), cast, valid, error_type="date_parsing")


def _datetime(python_format: str | None = None, timezone_treatment: str = "permit") -> TypeRule:
    cast = lambda text: dates.parse(F.trim(text), python_format or dates.ISO_DATETIME)

    def valid(text: Column) -> Column:
        fits = (dates.parse(text, python_format) if python_format else dates.parse_any_datetime(text)).isNotNull()
        if timezone_treatment == "forbid":
            fits &= ~dates.has_offset(text)
        elif timezone_treatment == "require":
            fits &= dates.has_offset(text)
        return fits

    return TypeRule(T.TimestampType(), cast, valid, error_type="datetime_parsing")


def _lax_datetime() -> TypeRule:
    shape = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"
    seconds = lambda text: F.regexp_replace(text, r"([T ][0-9]{2}:[0-9]{2})(Z|[+-].*)?\z", "$1:00$2")
    spelled = lambda text: F.regexp_replace(seconds(text), r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2")
    read = lambda text: F.when(_matches(text, shape), F.when(_matches(text, r"[T ]"), spelled(text)).otherwise(text).try_cast("timestamp"))
    valid = lambda text: read(text).isNotNull() | _matches(text, r"\A[+-]?(?:[0-9]{1,11}(?:\.[0-9]*)?|\.[0-9]+)\z")
    return TypeRule(T.TimestampType(), lambda text: dates.parse(F.trim(text), dates.ISO_DATETIME), valid, error_type="datetime_parsing")


_TIME = r"\A(?:(?:[01][0-9]|2[0-3]):?[0-5][0-9]:?[0-5][0-9](?:\.[0-9]{1,6})?(?:[ ]?(?i:AM|PM))?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)\z"


def _time(time_format: str | None = None, timezone_treatment: str = "permit") -> TypeRule:
    """Times of day as ``HH:mm:ss`` text."""

    def cast(text: Column) -> Column:
        if time_format:
            return F.date_format(dates.parse(F.concat(F.lit("1970-01-01 "), F.trim(text)), f"%Y-%m-%d {time_format}"), "HH:mm:ss")
        digits = F.regexp_extract(F.trim(text), r"\A([0-9]{2}):?([0-9]{2}):?([0-9]{2})", 0)
        return F.when(_matches(F.trim(text), _TIME), F.regexp_replace(digits, r"\A([0-9]{2}):?([0-9]{2}):?([0-9]{2})\z", "$1:$2:$3"))

    def valid(text: Column) -> Column:
        fits = cast(text).isNotNull()
        offset = _matches(text, r"(?:Z|[+-][0-9]{2}:?[0-9]{2})\z")
        return fits & ~offset if timezone_treatment == "forbid" else fits & offset if timezone_treatment == "require" else fits

    return TypeRule(T.StringType(), cast, valid, error_type="time_parsing")


def _period(is_edge: Callable[[Column], Column], date_format: str = dates.ISO_DATE) -> TypeRule:
    read = lambda text: dates.parse(text, date_format).cast("date")
    return TypeRule(T.DateType(), lambda text: read(F.trim(text)), lambda text: F.coalesce(is_edge(read(text)), F.lit(False)))


#: Contract spelling -> rule from the field's arguments.
TYPES: dict[str, Callable[..., TypeRule]] = {
    "str": _string,
    "constr": _string,
    "int": _integer,
    "conint": _integer,
    "PositiveInt": lambda: _integer(gt=0),
    "NonNegativeInt": lambda: _integer(ge=0),
    "NegativeInt": lambda: _integer(lt=0),
    "NonPositiveInt": lambda: _integer(le=0),
    "float": _float,
    "confloat": _float,
    "PositiveFloat": lambda: _float(gt=0),
    "NonNegativeFloat": lambda: _float(ge=0),
    "NegativeFloat": lambda: _float(lt=0),
    "NonPositiveFloat": lambda: _float(le=0),
    "bool": _boolean,
    "bytes": lambda: TypeRule(T.BinaryType(), lambda text: text.cast("binary"), lambda text: F.lit(True)),
    "Decimal": _decimal,
    "condecimal": _decimal,
    "date": _date,
    "condate": _date,
    "conformatteddate": lambda date_format=None, **more: _date(date_format, **more),
    "datetime": _lax_datetime,
    "formatteddatetime": lambda date_format=None, timezone_treatment="permit": _datetime(date_format, timezone_treatment),
    "time": _time,
    "formattedtime": _time,
    "nhsnumber": _nhs,
    "permissivenhsno": lambda warn_on_test_numbers=False: _nhs(warn_on_test_numbers),
    "postcode": _postcode,
    "orgid": lambda: TypeRule(T.StringType(), F.trim, lambda text: _matches(text, ORG_ID)),
    "alphanumeric": lambda max_digits=1, min_digits=None: _characters(ALPHANUMERIC, max_digits, min_digits),
    "identifier": lambda max_digits=1, min_digits=None: _characters(IDENTIFIER, max_digits, min_digits),
    "reportingperiodstart": lambda **more: _period(lambda day: F.dayofmonth(day) == 1, **more),
    "reportingperiodend": lambda **more: _period(lambda day: day == F.last_day(day), **more),
}


def rule_for(kind: str, arguments: Mapping[str, Any] | None = None) -> TypeRule:
    if kind not in TYPES:
        raise ValueError(f"unknown contract type {kind!r}")
    return TYPES[kind](**(arguments or {}))
