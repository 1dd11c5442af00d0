import datetime

import pytest
from pydantic import TypeAdapter, ValidationError
from pyspark.sql import functions as F

from lakewarden.operators.catalog import RECORD_INDEX
from lakewarden.plans.config import ConfigError, Contract
from lakewarden.plans.contract import apply_contract, reject_records
from lakewarden.plans.types import rule_for

TEXTS = ["1", "1.0", " 1 ", "1_000", "+5", "1e3", "", "0x1", "1.5", "-3", "abc", "yes", "ON", "t", "FALSE", " true", "2", "nan", "inf", " 2.5 ", "1_0", ".5", "5.",
         "2020-01-01", "2020-01-01T00:00:00", "1577836800", "20200101", "2020-1-1", " 2020-01-01", "2020-02-30", "2020-01-01 10:00", "2020-01-01T10:00Z", "1__0", "_1", "007", "infinity"]


@pytest.mark.parametrize("kind, reference", [("int", int), ("bool", bool), ("float", float), ("date", datetime.date), ("datetime", datetime.datetime)])
def test_validity_follows_lax_coercion(spark, kind, reference):
    rule = rule_for(kind)
    found = {r.s: r.v for r in spark.createDataFrame([(t,) for t in TEXTS], "s string").select("s", F.coalesce(rule.valid(F.col("s")), F.lit(False)).alias("v")).collect()}

    def accepted(text):
        try:
            TypeAdapter(reference).validate_python(text)
            return True
        except ValidationError:
            return False

    assert found == {t: accepted(t) for t in TEXTS}


def verdicts(spark, kind, arguments, texts):
    rule = rule_for(kind, arguments)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    return [r.v for r in frame.select("k", F.coalesce(rule.valid(F.col("s")), F.lit(False)).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "kind, arguments, good, bad",
    [
        ("nhsnumber", {}, ["943 476 5919", "9434765919", "401-023-2137"], ["9434765918", "943476591", "abc", ""]),
        ("postcode", {}, ["AB12CD", "ab1 2cd", "n/a", "W1A 1AA"], ["1AB 2CD", "ABC12 3DE", "A1 12B"]),
        ("orgid", {}, ["ABC", "A1B2C"], ["AB", "ABCDEF", "abc", "ABC\n"]),
        ("alphanumeric", {"min_digits": 2, "max_digits": 4}, ["a1", "abcd"], ["a", "abcde", "a-b"]),
        ("identifier", {"max_digits": 3}, ["a-b", "[x]"], ["ab", "a?b"]),
        ("conint", {"ge": 1, "lt": 10, "multiple_of": 3}, ["3", "9.0"], ["2", "12", "x"]),
        ("condecimal", {"max_digits": 4, "decimal_places": 2}, ["12.34", "1"], ["123.4", "1.234", "x"]),
        ("conformatteddate", {"date_format": "%d/%m/%Y", "ge": "2020-01-01"}, ["01/02/2020"], ["01/02/2019", "2020-01-01", "31/02/2020"]),
        ("formatteddatetime", {}, ["2020-01-01T10:11:12", "20200101101112", "2020-01-01 10:11:12.5+0100", "2020010110111201"], ["2020-01-01", "2020-13-01T10:11:12"]),
        ("formatteddatetime", {"timezone_treatment": "require"}, ["2020-01-01T10:11:12Z"], ["2020-01-01T10:11:12"]),
        ("formattedtime", {}, ["10:11:12", "101112"], ["25:00:00", "x"]),
        ("reportingperiodstart", {}, ["2020-02-01"], ["2020-02-02", "x"]),
        ("reportingperiodend", {}, ["2020-02-29"], ["2020-02-28"]),
        ("constr", {"min_length": 2, "max_length": 3, "regex": "^a"}, ["ab", " abc "], ["a", "abcd", "bc"]),
    ],
)
def test_domain_types(spark, kind, arguments, good, bad):
    assert verdicts(spark, kind, arguments, good) == [True] * len(good)
    assert verdicts(spark, kind, arguments, bad) == [False] * len(bad)


CONTRACT = {
    "schemas": {"cast": {"fields": {"name": "str", "date_joined": "date"}}},
    "types": {"rating": {"type": "NonNegativeFloat"}},
    "datasets": {
        "movies": {
            "fields": {"title": "str", "year": "int", "genre": {"type": "str", "is_array": True}, "ratings": {"type": "rating", "is_array": True}, "cast": {"model": "cast", "is_array": True}},
            "mandatory_fields": ["title", "year"],
            "reporting_fields": ["title"],
        }
    },
    "error_details": {
        "title": {"Blank": {"error_code": "BLANKTITLE", "error_message": "no title", "error_level": "submission"}},
        "year": {"Blank": {"error_code": "BLANKYEAR", "error_message": "no year", "is_informational": True}, "Bad value": {"error_code": "DODGYYEAR", "error_message": "year ({{year}})", "reporting_entity": "renamed"}},
        "cast.date_joined": {"Bad value": {"error_code": "DODGYDATE", "error_message": "bad: {{__error_value}}"}},
    },
}


def movies(spark):
    schema = f"{RECORD_INDEX} long, title string, year string, genre array<string>, ratings array<string>, cast array<struct<name:string,date_joined:string>>"
    data = [
        (1, "A", "NOT_A_NUMBER", ["x"], ["6.5", "-1"], [("n", "2020-01-01"), ("m", "yesterday")]),
        (2, "B", None, None, None, None),
        (3, "C", "1999", [], ["7"], []),
        (4, None, "2001", ["y"], [], [(None, None)]),
    ]
    return spark.createDataFrame(data, schema)


def test_contract_messages_and_types(spark, rows):
    out = apply_contract(Contract.from_json(CONTRACT), "movies", movies(spark))
    found = rows(out.messages, "ErrorCode", "Entity", "FailureType", "Status", "ErrorLocation", "ErrorMessage", "RecordIndex", "Value")
    assert found == [
        ("BLANKTITLE", "movies", "submission", "error", "title", "no title", 4, None),
        ("BLANKYEAR", "movies", "record", "informational", "year", "no year", 2, None),
        ("BadValue", "movies", "record", "error", "ratings, 1", "is invalid", 1, "-1"),
        ("DODGYDATE", "movies", "record", "error", "cast, 1, date_joined", "bad: yesterday", 1, "yesterday"),
        ("DODGYYEAR", "renamed", "record", "error", "year", "year (NOT_A_NUMBER)", 1, "NOT_A_NUMBER"),
    ]
    first = out.typed.where(f"{RECORD_INDEX} = 1").first()
    assert first.year is None and first.ratings == [6.5, -1.0] and first.cast[0].date_joined == datetime.date(2020, 1, 1) and first.cast[1].date_joined is None
    kept = reject_records(out.typed, out.messages, "movies")
    assert rows(kept, "title") == [("B",), ("C",), (None,)]


def test_missing_columns_are_typed_null(spark):
    out = apply_contract(Contract.from_json(CONTRACT), "movies", spark.createDataFrame([("A",)], "TITLE string"))
    assert out.typed.dtypes[3] == ("ratings", "array<double>") and out.typed.first().title == "A"
    assert [m.ErrorCode for m in out.messages.collect()] == ["BLANKYEAR"]


def test_warnings_and_field_functions(spark):
    document = {"datasets": {"p": {"fields": {"nhs": "nhsnumber", "word": {"type": "str", "functions": [{"name": "split", "kwargs": {"split_on": "-", "keep": 1}, "error_type": "warning", "error_message": "one part"}, {"name": "exclude_word", "kwargs": {"word": "NO"}}]}}}}}
    out = apply_contract(Contract.from_json(document), "p", spark.createDataFrame([("9434765919", "no way")], "nhs string, word string"))
    assert sorted((m.Status, m.ErrorCode, m.Category) for m in out.messages.collect()) == [("informational", "WrongFormat", "Wrong format")] * 2


def test_contract_needs_one_kind_of_type():
    with pytest.raises(ConfigError):
        Contract.from_json({"datasets": {"a": {"fields": {"x": {"type": "str", "model": "y"}}}}})
    with pytest.raises(ConfigError):
        Contract.from_json({"types": {"t": {"type": "t"}}, "datasets": {"a": {"fields": {"x": "t"}}}})


def test_contract_stays_native(spark):
    out = apply_contract(Contract.from_json(CONTRACT), "movies", movies(spark))
    plan = out.flagged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
