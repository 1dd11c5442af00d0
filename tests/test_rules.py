import pytest

from lakewarden.operators.catalog import RECORD_INDEX, Catalog
from lakewarden.plans.config import ConfigError, DatasetConfig, build_step, resolve_filter
from lakewarden.plans.messages import parse_location, severity
from lakewarden.plans.rules import CriticalFailure, check_program, evaluate
from lakewarden.plans.templating import TemplateError, render


def animals(spark):
    data = [(1, "cat", 23.0, 4.0, "uk"), (2, "yeti", None, 80.0, "tibet"), (3, "dog", 60.0, None, "uk"), (4, "whale", 500.0, 9e4, "sea"), (5, "ant", 0.1, 0.0, None)]
    return spark.createDataFrame(data, f"{RECORD_INDEX} long, name string, height double, weight double, region string")


def run(spark, filters, **more):
    config = DatasetConfig.from_json({"transformations": {"filters": filters, **more}})
    return evaluate(Catalog({"animals": animals(spark)}), config.rules, config.parameters, {"animals": ("name",)})


def test_severities_and_null_semantics(spark, rows):
    out = run(
        spark,
        [
            {"entity": "animals", "name": "tall", "expression": "height < 400", "error_code": "ANE01", "reporting_field": "height", "failure_message": "{{name}} is {{height}} tall ({{nobody}})"},
            {"entity": "animals", "name": "heavy", "expression": "weight < 1000", "error_code": "ANE02", "failure_type": "submission", "failure_message": "heavy"},
            {"entity": "animals", "name": "uk", "expression": "region = 'uk'", "error_code": "ANE03", "is_informational": True, "failure_message": "abroad"},
        ],
    )
    # A null record_failure removes the row without a message; other severities never remove.
    assert rows(out.catalog["animals"], "name") == [("ant",), ("cat",), ("dog",)]
    found = rows(out.messages, "ErrorCode", "FailureType", "Status", "RecordIndex", "Key", "Value")
    assert found == [
        ("ANE01", "record", "error", 4, "name: whale", "500.0"),
        ("ANE02", "submission", "error", 4, "name: whale", None),
        ("ANE03", "record", "informational", 2, "name: yeti", None),
        ("ANE03", "record", "informational", 4, "name: whale", None),
    ]
    assert out.messages.where("ErrorCode = 'ANE01'").first().ErrorMessage == "whale is 500.0 tall ({{nobody}})"
    assert out.catalog["animals"].columns == animals(spark).columns


def test_filters_read_the_entity_once(spark):
    out = run(spark, [{"entity": "animals", "expression": f"height < {k}", "error_code": str(k)} for k in range(5)])
    plan = out.messages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("Generate explode") == 1


def test_critical_failure_stops(spark):
    with pytest.raises(CriticalFailure):
        run(spark, [{"entity": "animals", "name": "c", "expression": "height > 1", "failure_type": "integrity"}])
    assert run(spark, [{"entity": "animals", "expression": "height > 0", "failure_type": "integrity"}]).messages.count() == 0


def test_phases_are_major_across_rules(spark, rows):
    store = {"drop": {"type": "complex_rule", "rule_config": {"rules": [], "filters": [], "post_filter_rules": [{"operation": "remove", "entity": "animals", "column_name": "extra"}]}}}
    out = run(
        spark,
        [{"entity": "animals", "expression": "extra > 1", "error_code": "E"}],
        rules=[{"operation": "add", "entity": "animals", "column_name": "extra", "expression": "__record_index__"}],
        complex_rules=[{"rule_name": "drop"}],
        rule_stores=[{"rules": store}],
    )
    assert out.catalog["animals"].columns[-1] == "region" and out.catalog["animals"].count() == 4


def test_parameters_defaults_and_nested_filters():
    stores = {
        "over": {"type": "filter", "parameter_defaults": {"limit": 5}, "filter_config": {"entity": "{{entity}}", "expression": "{{field}} > {{limit}}"}},
        "outer": {"type": "filter", "filter_config": {"rule_name": "over", "parameters": {"field": "{{which}}"}}},
        "loop": {"type": "filter", "filter_config": {"rule_name": "loop"}},
    }
    assert resolve_filter({"rule_name": "outer", "parameters": {"which": "mass"}}, stores)["expression"] == "mass > 5"
    with pytest.raises(ConfigError):
        resolve_filter({"rule_name": "loop"}, stores)
    with pytest.warns(UserWarning):
        resolve_filter({"rule_name": "over", "error_code": "X"}, stores)


def test_bad_configuration_is_refused():
    for spec in ({"operation": "nothing"}, {"operation": "add", "entity": "a", "colum": 1}, {"operation": "add", "entity": "a"}):
        with pytest.raises(ConfigError):
            build_step(spec)
    with pytest.raises(ConfigError):
        DatasetConfig.from_json({"transformations": {"complex_rules": [{"rule_name": "x"}]}})


def test_program_check_names_missing_entities():
    config = DatasetConfig.from_json({"transformations": {"rules": [{"operation": "rename_entity", "entity": "a", "new_entity_name": "b"}], "filters": [{"entity": "a", "expression": "true"}]}})
    assert check_program(config.rules, {"a"}, {}) == ["root: a"]


def test_templates():
    assert render({"{{k}}": ["{{ day | add_months(1) }}", "{{ day | days_until('2024-02-01') }}"]}, {"k": "x", "day": "2024-01-31"}) == {"x": ["2024-02-29", "1"]}
    assert render("{{ repr(s) }} {{a.b[1]}} {{ c.d }}", {"s": "q", "a": {"b": [1, 2]}}) == "'q' 2 {{c.d}}"
    with pytest.raises(TemplateError):
        render("{{ raise('no') }}", {})
    with pytest.raises(TemplateError):
        render("{{ __import__('os') }}", {})


def test_severity_and_location():
    assert [severity("record"), severity("group"), severity("integrity"), severity("integrity", "True")] == ["record_failure", "submission_failure", "critical_failure", "warning"]
    assert parse_location("s.{f, g}") == ("s", ["f", "g"]) and parse_location("s.*") == ("s", None) and parse_location("a, b") == (None, ["a", "b"])
    with pytest.raises(ValueError):
        parse_location("a.b.c")
