import json
import zipfile

import pytest
from pyspark.sql import types as T

from lakewarden.operators.catalog import RECORD_INDEX
from lakewarden.plans.audit import AuditLog
from lakewarden.plans.config import DatasetConfig
from lakewarden.plans.engine import Engine, Pipeline, discover
from lakewarden.plans.messages import from_mapping
from lakewarden.plans.report import ACCEPTED, ACCEPTED_WITH_REJECTIONS, PROCESSING_FAILED, REJECTED, verdict, write_report, write_xlsx
from lakewarden.sources import readers
from lakewarden.sources.reference import loader
from lakewarden.streaming.ingest import ingest


def strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def test_csv_guards_and_cleaning(spark, tmp_path, rows):
    good = tmp_path / "good.csv"
    good.write_text('B,a,extra\n" x ",NULL,1\n,"2,3",2\n')
    assert rows(readers.read_csv(spark, str(good), strings("a", "b", "c"))) == [("2,3", None, None), (None, "x", None)]
    with pytest.raises(readers.SubmissionRejected) as error:
        readers.read_csv(spark, str(good), strings("a", "b", "c"), field_check=True)
    assert error.value.value == "Missing fields: c; Additional fields: extra"
    bare = tmp_path / "bare.csv"
    bare.write_text("1|2\n")
    assert rows(readers.read_csv(spark, str(bare), strings("a", "b"), header=False, delimiter="|")) == [("1", "2")]
    with pytest.raises(readers.SubmissionRejected):
        readers.read_csv(spark, str(bare), strings("a"), header=False, delimiter="|")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(readers.EmptyFileError):
        readers.read_csv(spark, str(tmp_path / "empty.csv"), strings("a"))
    (tmp_path / "null.csv").write_bytes(b"a\n\x00\n")
    with pytest.raises(readers.SubmissionRejected):
        readers.read_csv(spark, str(tmp_path / "null.csv"), strings("a"))
    with pytest.raises(readers.ReaderError):
        readers.get_reader("nothing")


def test_repeating_header(spark, tmp_path):
    place = tmp_path / "h.csv"
    place.write_text("org,x\nA,1\nA,2\n")
    assert [tuple(r) for r in readers.read_repeating_header(spark, str(place), strings("org")).collect()] == [("A",)]
    place.write_text("org,x\nA,1\nB,2\n")
    with pytest.raises(readers.SubmissionRejected) as error:
        readers.read_repeating_header(spark, str(place), strings("org"))
    assert error.value.value == "org: A, B"


def test_xml_with_namespace_nesting_and_xsd(spark, tmp_path, rows):
    place = tmp_path / "b.xml"
    place.write_text('<n:store xmlns:n="u"><n:author><n:name> A\n  B </n:name><n:book><n:title>T1</n:title></n:book><n:book><n:title>T2</n:title></n:book></n:author></n:store>')
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("book", T.ArrayType(strings("title")))])
    row = readers.read_xml(spark, str(place), schema, record_tag="author").first()
    assert row.name == "A B" and [b.title for b in row.book] == ["T1", "T2"]
    xsd = tmp_path / "s.xsd"
    xsd.write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="xs:int" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    (tmp_path / "ok.xml").write_text("<r><a>1</a></r>")
    (tmp_path / "bad.xml").write_text("<r><a>x</a></r>")
    flat = T.StructType([T.StructField("_VALUE", T.StringType())])
    assert readers.read_xml(spark, str(tmp_path / "ok.xml"), flat, record_tag="a", xsd_location=str(xsd)).count() == 1
    with pytest.raises(readers.SubmissionRejected):
        readers.read_xml(spark, str(tmp_path / "bad.xml"), flat, record_tag="a", xsd_location=str(xsd))


def test_reference_data(spark, tmp_path):
    import pyarrow as pa

    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as sink, pa.ipc.new_stream(sink, pa.schema([("x", pa.int64())])) as writer:
        writer.write_batch(pa.record_batch({"x": [1, 2]}))
    load = loader(spark, {"p": {"type": "filename", "filename": "p.parquet"}, "a": {"type": "uri", "uri": str(tmp_path / "a.arrow")}}, tmp_path)
    assert load("p").count() == 3 and load("a").count() == 2 and load("none") is None


DOCUMENT = {
    "contract": {
        "datasets": {"planets": {
            "fields": {"planet": "str", "mass": "PositiveFloat", "moons": "NonNegativeInt"}, "mandatory_fields": ["planet"], "reporting_fields": ["planet"],
            "reader_config": {".csv": {"reader": "SparkCSVReader", "kwargs_": {"field_check": True}}},
        }},
    },
    "transformations": {
        "parameters": {"entity": "planets"},
        "filters": [{"entity": "planets", "name": "moons", "expression": "over_5(moons) = false", "error_code": "MANY", "reporting_field": "moons", "failure_message": "{{planet}}"},
                    {"entity": "planets", "name": "light", "expression": "mass > 1", "error_code": "LIGHT", "is_informational": True}],
    },
}


def submission(folder, name, text):
    (folder / f"{name}.csv").write_text(text)
    (folder / f"{name}.metadata.json").write_text(json.dumps({"dataset_id": "planets", "submitting_org": "X"}))


def test_engine_end_to_end(spark, rows):
    engine = Engine(spark, DatasetConfig.from_json(DOCUMENT))
    raw = spark.createDataFrame([("earth", "5.9", "1"), ("saturn", "560", "82"), ("mars", "0.6", "2"), (None, "x", "0")], "planet string, mass string, moons string")
    out = engine.run({"planets": raw}, reject=True)
    assert rows(out.catalog["planets"], "planet", "moons") == [("earth", 1), ("mars", 2)]
    assert rows(out.messages, "ErrorCode", "RecordIndex") == [("BadValue", 4), ("FieldBlank", 4), ("LIGHT", 3), ("MANY", 2)]


def test_engine_writes_its_stages(spark, tmp_path, rows):
    engine = Engine(spark, DatasetConfig.from_json(DOCUMENT))
    raw = spark.createDataFrame([(f"p{k}", str(k), str(k % 9)) for k in range(200)], "planet string, mass string, moons string").repartition(7)
    out = engine.run({"planets": raw}, str(tmp_path / "w"), reject=True)
    kept = spark.read.parquet(f"{tmp_path}/w/outputs/planets")
    assert kept.columns == ["planet", "mass", "moons"] and kept.count() == out.catalog["planets"].count() == sum(k > 0 and k % 9 <= 5 for k in range(200))
    assert spark.read.json(f"{tmp_path}/w/errors/engine_errors.jsonl").count() == out.messages.count()
    numbered = spark.read.parquet(f"{tmp_path}/w/contract/planets")
    assert sorted(r[0] for r in numbered.select(RECORD_INDEX).collect()) == list(range(1, 201))


def test_pipeline_over_a_folder(spark, tmp_path, rows):
    inbox = tmp_path / "in"
    inbox.mkdir()
    submission(inbox, "good", "planet,mass,moons\nearth,5.9,1\n")
    submission(inbox, "mixed", "planet,mass,moons\nearth,5.9,1\nsaturn,560,82\nmars,0.6,2\n,x,0\n")
    submission(inbox, "header", "planet,weight\nearth,1\n")
    submission(inbox, "empty", "")
    (inbox / "lonely.csv").write_text("planet\n")
    for name in ("a.csv", "a.xml", "a.metadata.json"):
        (inbox / name).write_text("{}")
    assert len(discover(str(inbox))[0]) == 4 and len(discover(str(inbox))[1]) == 1
    audit = AuditLog(spark, pool="t1")
    pipeline = Pipeline(spark, {"planets": DatasetConfig.from_json(DOCUMENT)}, str(tmp_path / "work"), audit)
    pipeline.run_folder(str(inbox), max_workers=2, dead_letters=str(tmp_path / "dead"))
    names = {r.submission_id: r.file_name for r in audit.table("submission_info").collect()}
    results = {names[r.submission_id]: (r.processing_status, r.submission_result) for r in audit.latest_status().collect()}
    assert results == {"good": ("success", "success"), "mixed": ("success", "validation_failed"), "header": ("success", "validation_failed"), "empty": ("failed", "processing_failed")}
    numbers = {names[r.submission_id]: (r.record_count, r.number_submission_rejections, r.number_record_rejections, r.number_warnings) for r in audit.table("submission_statistics").collect()}
    assert numbers == {"good": (1, 0, 0, 0), "mixed": (4, 0, 3, 1)}
    key = next(k for k, v in names.items() if v == "mixed")
    assert rows(spark.read.parquet(f"{tmp_path}/work/{key}/business_rules/planets"), "planet") == [("earth",), ("mars",)]
    assert len(spark.read.parquet(f"{tmp_path}/work/{key}/business_rules/Originalplanets").collect()) == 4
    assert zipfile.is_zipfile(f"{tmp_path}/work/{key}/error_report.xlsx")
    broken = next(k for k, v in names.items() if v == "empty")
    failures = spark.read.json(f"{tmp_path}/work/{broken}/processing_errors/processing_errors.jsonl").collect()
    assert len(failures) == 1 and failures[0].step_name == "file_transformation" and "is empty" in failures[0].error_message
    said = spark.read.json(f"{tmp_path}/work/{broken}/errors/all_errors.jsonl").collect()
    assert [(r.FailureType, r.ErrorType) for r in said] == [("integrity", "EmptyFileError")]
    assert sorted(p.name for p in (tmp_path / "dead").iterdir() if not p.name.startswith(".")) == ["a.csv", "a.metadata.json", "a.xml"]
    assert audit.queue("failed").count() == 1 and audit.lookup("submission_info", [("file_name", "in", ["good", "mixed"])]).count() == 2
    assert sum(audit.downstream_pending(1, k, 3, ("success", "failed")).count() for k in range(3)) == 4
    audit.export(key, str(tmp_path / "export"))
    assert spark.read.parquet(str(tmp_path / "export" / "submission_statistics.parquet")).count() == 1


def test_pipeline_by_uri(spark, tmp_path, rows):
    """Documents, submissions and work through a URI of Spark's file systems."""
    base = f"file://{tmp_path}"
    for name in ("in", "cfg"):
        (tmp_path / name).mkdir()
    twice = json.loads(json.dumps(DOCUMENT))
    twice["contract"]["datasets"]["orbits"] = twice["contract"]["datasets"]["planets"]
    (tmp_path / "cfg" / "p.json").write_text(json.dumps(twice))
    submission(tmp_path / "in", "good", "planet,mass,moons\nearth,5.9,1\n")
    submission(tmp_path / "in", "bad", "planet,weight\nearth,1\n")
    pipeline = Pipeline(spark, {"planets": DatasetConfig.load(f"{base}/cfg/p.json")}, f"{base}/work")
    found, _ = discover(f"{base}/in", spark)
    results = {s.path.rsplit("/", 1)[1]: (s, pipeline.run(s).result) for s in found}
    assert {name: r for name, (_, r) in results.items()} == {"good.csv": "success", "bad.csv": "validation_failed"}
    # One file, read for two entities, is refused once.
    bad = results["bad.csv"][0].submission_id
    assert spark.read.json(f"{base}/work/{bad}/errors/all_errors.jsonl").count() == 1
    assert zipfile.is_zipfile(tmp_path / "work" / bad / "error_report.xlsx")


def test_xml_root_namespace_inference_and_cut_files(spark, tmp_path, rows):
    place = tmp_path / "x.xml"
    place.write_text(
        '<?xml version="1.0"?><!-- <nothing> --><f xmlns:n="u" xmlns:m="v"><old><r><a>0</a></r></old><new><r><a>1</a><p><q>x</q></p></r><r><a>2</a><p><q>y</q></p><p><q>z</q></p></r></new>'
        "<new><r><a> 3 </a></r></new><n:r><n:a>4</n:a><n:p><n:q>w</n:q></n:p></n:r><m:r><m:a>5</m:a></m:r></f>"
    )
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("p", T.ArrayType(strings("q"))), T.StructField("gone", T.StringType())])
    read = lambda **o: sorted((r.a, tuple(q.q for q in r.p or ()), r.gone) for r in readers.read_xml(spark, str(place), schema, record_tag="r", **o).collect())
    new = [("1", ("x",), None), ("2", ("y", "z"), None), ("3", (), None)]
    assert read(root_tag="new") == new == read(root_tag="new", infer_schema=True)
    assert read(root_tag="f") == read() == sorted([("0", (), None), *new, ("4", ("w",), None), ("5", (), None)])
    assert read(namespace="n") == [("4", ("w",), None)]
    assert read(root_tag="none") == []
    for wrong in ({"mode": "ANY"}, {"colour": "red"}):
        with pytest.raises(readers.ReaderError):
            read(**wrong)
    cut = tmp_path / "cut.xml"
    cut.write_text("<f><r><a>1</a></r><r><a>2</a></r><r><a>3</")
    assert [r.a for r in readers.read_xml(spark, str(cut), schema, record_tag="r").collect()] == ["1", "2"]


def test_reader_options_and_unreadable_csv(spark, tmp_path):
    place = tmp_path / "a.csv"
    place.write_bytes("\ufeffa,b\n1,é\n".encode())
    assert [tuple(r) for r in readers.read_csv(spark, str(place), strings("a", "b"), encoding="utf-8-sig").collect()] == [("1", "é")]
    with pytest.raises(readers.ReaderError):
        readers.read_csv(spark, str(place), strings("a"), colour="red")
    with pytest.raises(readers.ReaderError):
        readers.read_json(spark, str(place), strings("a"), colour="red")
    place.write_text(" \n1\n")
    with pytest.raises(readers.SubmissionRejected) as error:
        readers.read_csv(spark, str(place), strings("a"), field_check_error_code="X")
    assert error.value.code == "X" and "Unable to parse" in error.value.value
    place.write_text("org\nA\nB\n")
    with pytest.raises(readers.SubmissionRejected) as error:
        readers.read_repeating_header(spark, str(place), strings("org"), non_unique_header_error_code="Y", non_unique_header_error_message="differ")
    assert (error.value.code, error.value.text) == ("Y", "differ")


def test_report_verdicts_and_workbook(spark, tmp_path):
    assert verdict([]) == ACCEPTED and verdict(["Warning", "File Rejection"]) == REJECTED and verdict([], True) == PROCESSING_FAILED
    messages = from_mapping(spark, [{"Entity": "p", "FailureType": "record", "Status": "error", "ErrorCode": "E", "ReportingField": "f", "ErrorMessage": "<&>", "Category": "Bad value", "RecordIndex": 3}])
    assert write_report(str(tmp_path / "r.xlsx"), messages, ["p"], {"File": "f.csv"}) == ACCEPTED_WITH_REJECTIONS
    book = zipfile.ZipFile(tmp_path / "r.xlsx")
    assert b"&lt;&amp;&gt;" in book.read("xl/worksheets/sheet3.xml") and b"Error Summary" in book.read("xl/workbook.xml")


def test_workbook_sheets_overflow(tmp_path, monkeypatch):
    monkeypatch.setattr("lakewarden.plans.report.SHEET_ROWS", 2)
    write_xlsx(str(tmp_path / "o.xlsx"), {"Data": [(k,) for k in range(5)]})
    assert b'name="Data_3"' in zipfile.ZipFile(tmp_path / "o.xlsx").read("xl/workbook.xml")


def test_streaming_ingestion(spark, tmp_path, rows):
    engine = Engine(spark, DatasetConfig.from_json(DOCUMENT))
    source, target = tmp_path / "drop", tmp_path / "out"
    spark.createDataFrame([("earth", "5.9", "1"), ("saturn", "560", "82")], engine.raw_schema("planets")).write.parquet(str(source))
    ingest(engine, "planets", str(source), str(target), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert rows(spark.read.parquet(f"{target}/entities/planets"), "planet") == [("earth",)]
    assert rows(spark.read.parquet(f"{target}/messages"), "ErrorCode") == [("MANY",)]
    assert RECORD_INDEX not in spark.read.parquet(f"{target}/entities/planets").columns


def test_codes_of_an_item_are_the_least_and_clash_with_no_column(spark, rows):
    from lakewarden.plans.report import fill_codes

    report = spark.sql("SELECT * FROM VALUES ('i', 'c', NULL, NULL, 'x'), ('i', 'c', 'own', NULL, 'y'), ('j', 'c', NULL, 'e', 'z') t(Data_Item, Category, Error_Code, Error, least)")
    codes = spark.sql("SELECT * FROM VALUES ('i', 'c', 'B', 'b'), ('i', 'c', 'A', 'a2'), ('i', 'c', 'A', 'a1') t(Data_Item, Category, Error_Code, Error)")
    out = fill_codes(report, codes)
    assert out.columns == report.columns
    assert rows(out) == [("i", "c", "A", "a1", "x"), ("i", "c", "own", "a1", "y"), ("j", "c", None, "e", "z")]


def test_verdicts_of_many_submissions(spark, rows):
    from lakewarden.plans.report import ACCEPTED_WITH_WARNINGS, verdicts

    found = spark.sql("SELECT * FROM VALUES (1, 'Warning', 'x'), (1, 'File Rejection', 'x'), (2, 'Warning', 'x'), (3, NULL, 'x'), (NULL, 'Record Rejection', 'x'), (NULL, 'Warning', 'x') t(`a b`, Type, verdict)")
    said = verdicts(found, "a b")
    assert said.columns == ["a b", "verdict"]
    assert {r[0]: r[1] for r in said.collect()} == {1: REJECTED, 2: ACCEPTED_WITH_WARNINGS, 3: ACCEPTED, None: ACCEPTED_WITH_REJECTIONS}
    assert verdicts(found.limit(0), "a b").count() == 0
    # One exchange: what tasks found is combined before it.
    assert verdicts(found, "a b")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_of_iterators_are_made_by_tasks(spark, rows):
    def count(shard):
        import os

        for k in range(shard.first, shard.first + shard.n):
            yield {"k": str(k), "part": [{"pid": str(os.getpid())}]} if k % 3 else {}

    shards = spark.sql("SELECT * FROM VALUES (0, 5), (10, 0), (20, 2500) t(first, n)")
    schema = T.StructType([*strings("k"), T.StructField("part", T.ArrayType(strings("pid")))])
    made = readers.from_iterators(shards, count, schema, batch_rows=100)
    import os

    assert made.count() == 2505 and made.where("k IS NULL").count() == 2 + 833 and made.where("size(part) = 1").count() == 3 + 1667
    assert str(os.getpid()) not in {r.part[0].pid for r in made.where("k IS NOT NULL").collect()}
    assert readers.from_iterators(shards.limit(0), count, schema).collect() == []


def test_errors_and_refusals_as_messages(spark, tmp_path):
    from pyspark.sql import functions as F

    from lakewarden.plans.messages import messages_from, submission_message, submission_messages
    from lakewarden.sources import sinks

    frame = spark.sql("SELECT * FROM VALUES ('KeyError', 'no'), ('ValueError', NULL) t(kind, Key)")
    told = sinks.describe_errors(frame, F.col("kind"), F.col("Key"), F.lit("rules"))
    plain = from_mapping(spark, [sinks.describe_error(type(k, (Exception,), {})(*t), "rules") for k, t in (("KeyError", ["no"]), ("ValueError", []))])
    assert sorted(map(str, told.collect())) == sorted(map(str, plain.collect()))
    one = submission_messages(frame.limit(1), F.lit("C"), F.lit("t"), value=F.lit("v"))
    assert one.collect() == submission_message(spark, "C", "t", value="v").collect()
    with pytest.raises(ValueError):
        messages_from(frame, Colour=F.lit("red"))
    errors = spark.sql("SELECT 's' AS step_name, concat('e', id) AS error_message FROM range(50)")
    place = sinks.write_processing_errors(errors, str(tmp_path))
    sinks.write_processing_error(spark, str(tmp_path), "t", RuntimeError("last"))
    read = spark.read.json(place)
    assert read.count() == 51 and read.where("step_name = 't'").first().error_message == "last"
    assert set(read.columns) == {"step_name", "error_location", "error_level", "error_message", "error_traceback"}


def test_a_second_run_of_a_submission_doubles_no_message(spark, tmp_path):
    (tmp_path / "in").mkdir()
    submission(tmp_path / "in", "mixed", "planet,mass,moons\nearth,5.9,1\nsaturn,560,82\n")
    pipeline = Pipeline(spark, {"planets": DatasetConfig.from_json(DOCUMENT)}, str(tmp_path / "work"))
    found, _ = discover(str(tmp_path / "in"), spark)
    said = []
    for _ in range(2):
        pipeline.run(found[0])
        said.append(spark.read.json(f"{tmp_path}/work/{found[0].submission_id}/errors/all_errors.jsonl").count())
    assert said[0] == said[1] == 1
