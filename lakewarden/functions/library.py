"""The functions that rule expressions may call, as SQL functions that Catalyst inlines. All are null for null
input unless noted, and none runs Python."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The identifiers that the two lookup functions accept.
ODS_CODES = (
    "EE142976", "EE144430", "EE143473", "EE148112", "EE142863", "EE147862", "EE142472", "EE141208",
    "EE143149", "EE140862", "EE140319", "EE144899", "EE144475", "EE141850", "EE147934", "EE141068",
    "EE143825", "EE147805", "EE143489", "EE146813", "EE145703", "EE148295", "EE140156", "EE145502",
    "EE148396", "EE144126", "EE145590", "EE141566", "EE142081", "EE143640", "EE144911", "EE145935",
    "EE145279", "EE143156", "EE146556", "EE140781", "EE144734", "EE144841", "EE140419", "EE140040",
    "EE147342", "EE143330", "EE140926", "EE146438", "EE142137", "EE143856", "EE141067", "EE148534",
    "EE141310", "EE146899", "EE146996", "EE147487", "EE148447", "EE144311", "EE142147", "EE147605",
    "EE142117", "EE144087", "EE147326", "EE147614", "EE143703", "EE146135", "EE140782", "EE143603",
    "EE143554", "EE146659", "EE140321", "EE141185", "EE147648", "EE144527", "EE142680", "EE141620",
    "EE145274", "EE146251", "EE148209", "EE142574", "EE148162", "EE143118", "EE142977", "EE147798",
    "EE147902", "EE145780", "EE146992", "EE142916", "EE144777", "EE146935", "EE145586", "EE144570",
    "EE147122", "EE140874", "EE141338", "EE143244",
)
NATIONAL_ORGS = ("ORG01", "ORG02")


def _members(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def digits_of_ten(text: Column) -> Column:
    """A ten-digit number without its separators (space and hyphen)."""
    return F.translate(text, " -", "")


def mod11_holds(text: Column) -> Column:
    """Whether a ten-digit string ends in the check digit that its other digits, weighted 10 down to 2, ask for.

    A remainder of 0 asks for 0; a remainder of 1 asks for 10, which no digit is.
    """
    digit = lambda k: F.substring(text, k, 1).try_cast("int")
    total = sum((digit(k) * (11 - k) for k in range(2, 10)), digit(1) * 10)
    return F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(11)) == digit(10)


_TEN = "translate(s, ' -', '')"
_SUM = " + ".join(f"try_cast(substring({_TEN}, {k}, 1) AS INT) * {11 - k}" for k in range(1, 10))
_CHECK = f"pmod(11 - pmod({_SUM}, 11), 11)"

#: name -> (parameters, result, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "over_10k": ("x DOUBLE", "BOOLEAN", "x > 10000"),
    "over_1k": ("x DOUBLE", "BOOLEAN", "x > 1000"),
    "over_10": ("x DOUBLE", "BOOLEAN", "x > 10"),
    "over_5": ("x DOUBLE", "BOOLEAN", "x > 5"),
    "under_10k": ("x DOUBLE", "BOOLEAN", "x < 10000"),
    "under_5k": ("x DOUBLE", "BOOLEAN", "x < 5000"),
    "x_not_greater_than_y": ("x DOUBLE, y DOUBLE", "BOOLEAN", "x <= y"),
    "date_in_current_financial_year": ("d DATE", "BOOLEAN", "d >= make_date(year(current_date()), 4, 1)"),
    "is_valid_ods_code": ("s STRING", "BOOLEAN", f"coalesce(s IN ({_members(ODS_CODES)}), false)"),
    "is_valid_national_org": ("s STRING", "BOOLEAN", f"coalesce(s IN ({_members(NATIONAL_ORGS)}), false)"),
    "check_correct_numeric_signage": (
        "v DOUBLE, sign STRING DEFAULT '+/-'",
        "BOOLEAN",
        "CASE WHEN v IS NULL THEN NULL WHEN sign = '+/-' THEN true WHEN sign = '+' THEN v >= 0 WHEN sign = '-' THEN v <= 0 END",
    ),
    "number_matches_within_tolerance": (
        "comparator DECIMAL(38,10), number DECIMAL(38,10), tolerance DECIMAL(38,10)",
        "BOOLEAN",
        "abs(number - comparator) <= abs(tolerance)",
    ),
    "number_matches_within_percentage": (
        "comparator DECIMAL(38,10), number DECIMAL(38,10), percentage DECIMAL(38,10)",
        "BOOLEAN",
        "abs(number - comparator) <= abs(comparator * percentage)",
    ),
    "nhsno_mod11_check": (
        "s STRING",
        "BOOLEAN",
        f"coalesce({_TEN} RLIKE '\\\\A[0-9]{{10}}\\\\z' AND {_CHECK} = try_cast(substring({_TEN}, 10, 1) AS INT), false)",
    ),
}


def register_functions(spark: SparkSession, extra: dict[str, tuple[str, str, str]] | None = None) -> list[str]:
    """Make the library (and ``extra`` ones) callable in expressions of this session; may be called again."""
    for name, (parameters, result, body) in {**FUNCTIONS, **(extra or {})}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [*FUNCTIONS, *(extra or {})]


def register_python(spark: SparkSession, function, name: str | None = None):
    """A user's annotated Python function as a scalar function. The return annotation gives the type; vectorised by
    Arrow, but still the slow path: prefer an SQL body in :func:`register_functions`."""
    import datetime
    import decimal
    import typing

    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", bytes: "binary", datetime.date: "date", datetime.datetime: "timestamp", decimal.Decimal: "decimal(38,18)"}
    hint = typing.get_type_hints(function).get("return")
    arguments = [a for a in typing.get_args(hint) if a is not type(None)]
    hint = arguments[0] if len(arguments) == 1 else hint
    if hint not in kinds:
        raise ValueError(f"{function.__name__} needs a return annotation of a scalar type")
    return spark.udf.register(name or function.__name__, F.udf(function, kinds[hint], useArrow=True))
