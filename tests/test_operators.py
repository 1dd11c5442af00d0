import pytest
from pyspark.sql import functions as F

from lakewarden.operators import steps
from lakewarden.operators.catalog import RECORD_INDEX, Catalog, ConstraintError, MissingEntity, MissingReferenceData
from lakewarden.operators.expressions import literal, split_expressions
from lakewarden.operators.index import add_record_index


@pytest.fixture(scope="module")
def state(spark):
    planets = spark.createDataFrame([("earth", 5.97, 1), ("mars", 0.64, 2), ("venus", 4.87, 0)], "planet string, mass double, moons int")
    moons = spark.createDataFrame([("earth", "moon", 3.3), ("mars", "phobos", 1.9), ("mars", "deimos", 1.5)], "planet string, name string, density double")
    return Catalog({"planets": planets, "moons": moons, "one": spark.createDataFrame([(7,)], "Value int")}, {"sizes": planets}.get)


def test_catalog_guards(state):
    with pytest.raises(MissingEntity):
        state["absent"]
    with pytest.raises(MissingReferenceData):
        state["refdata_absent"]
    assert state["refdata_sizes"].count() == 3
    with pytest.raises(ConstraintError):
        state.put("refdata_sizes", state["planets"])
    with pytest.raises(ConstraintError):
        Catalog({"refdata_x": state["planets"]})
    assert "moons" not in state.drop("moons") and "moons" in state


def test_split_expressions():
    assert split_expressions("a, max(b, c) AS m, 'x,y', d[1, 2]") == ["a", "max(b, c) AS m", "'x,y'", "d[1, 2]"]
    assert split_expressions(r"'it\'s, fine', b") == [r"'it\'s, fine'", "b"]
    for bad in ("a)", "(a", "'a"):
        with pytest.raises(ValueError):
            split_expressions(bad)


def test_literal_rejects_mixed_lists(spark):
    assert spark.range(1).select(literal({"a": [1, 2], "b": None}).alias("x")).first().x.a == [1, 2]
    with pytest.raises(ValueError):
        literal([1, "a"])


def test_left_join_overrides_in_place_and_keeps_unmatched(state, rows):
    step = steps.LeftJoin(entity="planets", target="moons", join_condition="planets.planet = moons.planet", new_columns={"moons.name": "MASS"})
    out = step.run(state)["planets"]
    assert out.columns == ["planet", "MASS", "moons"]
    assert rows(out) == [("earth", "moon", 1), ("mars", "deimos", 2), ("mars", "phobos", 2), ("venus", None, 0)]


def test_one_to_one_refuses_many_before_changing_the_catalog(state):
    options = dict(entity="planets", target="moons", join_condition="planets.planet = moons.planet", new_columns={"moons.name": "n"})
    with pytest.raises(ConstraintError):
        steps.OneToOneJoin(**options).run(state)
    assert steps.OneToOneJoin(**options, perform_integrity_check=False).run(state)["planets"].count() == 4


def test_has_match_keeps_one_row_each(state, rows):
    options = dict(entity="planets", target="moons", join_condition="planets.planet = moons.planet AND moons.density > 1.6", column_name="dense")
    assert rows(steps.HasMatch(**options).run(state)["planets"], "planet", "dense") == [("earth", True), ("mars", True), ("venus", False)]
    many = dict(options, join_condition="planets.planet = moons.planet")
    with pytest.raises(ConstraintError):
        steps.HasMatch(**many).run(state)
    loose = steps.HasMatch(**many, perform_integrity_check=False).run(state)["planets"]
    assert rows(loose, "planet", "dense") == [("earth", True), ("mars", True), ("venus", False)]


def test_has_match_plans_to_one_existence_join(state):
    out = steps.HasMatch(entity="planets", target="moons", join_condition="planets.planet = moons.planet", column_name="m", perform_integrity_check=False).run(state)["planets"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan


def test_orphans_chain(state, rows):
    one = steps.IdentifyOrphans(entity="planets", target="moons", join_condition="planets.planet = moons.planet").run(state)
    assert rows(one["planets"], "planet", "IsOrphaned") == [("earth", False), ("mars", False), ("venus", True)]
    two = steps.IdentifyOrphans(entity="planets", target="moons", join_condition="planets.planet = moons.planet AND moons.name = 'moon'").run(one)
    assert rows(two["planets"], "planet", "IsOrphaned") == [("earth", False), ("mars", True), ("venus", True)]


def test_header_needs_one_row(state):
    out = steps.JoinHeader(entity="planets", target="one").run(state)["planets"]
    assert out.select("_Header.Value").distinct().collect()[0][0] == 7
    for bad in ("moons", "empty"):
        with pytest.raises(ConstraintError):
            steps.JoinHeader(entity="planets", target=bad).run(state.put("empty", state["one"].limit(0)))


def test_union_by_name_in_any_case(state, rows):
    other = state["planets"].select(F.col("planet").alias("PLANET"), F.lit("x").alias("extra")).limit(1)
    out = steps.Union(entity="planets", target="other").run(state.put("other", other))["planets"]
    assert out.columns == ["planet", "mass", "moons", "extra"] and out.count() == 4


def test_group_by_pivot(state):
    out = steps.GroupBy(entity="moons", group_by="planet", pivot_column="name", pivot_values=("moon",), agg_columns={"max(density)": "d"}).run(state)["moons"]
    assert out.columns == ["planet", "moon"]
    with pytest.raises(ValueError):
        steps.GroupBy(entity="moons", agg_columns="count(*)", pivot_values=(1,))


def test_data_flow_sets():
    rename = steps.RenameEntity(entity="a", new_entity_name="b")
    assert (rename.needs(), rename.makes(), rename.removes()) == ({"a"}, {"b"}, {"a"})
    gone = steps.RemoveEntities(entity=("a", "b"))
    assert (gone.needs(), gone.makes(), gone.removes()) == (set(), set(), {"a", "b"})


def test_record_index_is_dense_and_idempotent(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    out = add_record_index(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r[0] for r in out.select(RECORD_INDEX).collect()) == list(range(1, 1001))
    assert add_record_index(out) is out
    assert add_record_index(spark.range(0)).count() == 0
