"""Registered queries over what stands around the engine: sources and guards, sinks, audit, discovery and rule stores.

Each makes its files or tables from a given table, and reads them back. Audit tables and results that the driver holds
have one row for each nation or a given list.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.library import register_python
from lakewarden.operators.index import add_record_index
from lakewarden.plans import report
from lakewarden.plans.audit import AuditLog
from lakewarden.plans.config import ConfigError, DatasetConfig
from lakewarden.plans.contract import apply_contract
from lakewarden.plans.engine import discover
from lakewarden.plans.messages import distinct_messages, submission_messages
from lakewarden.plans.rules import check_program, evaluate, union_messages
from lakewarden.queries import _FILTERS, _PROGRAM, _REPORT_CTE, _contract, _filtered, _shared, _strings, catalog, query, table
from lakewarden.sources import arrowfiles, readers, sinks
from lakewarden.sources.files import Files, extension_of, name_of, stem_of
from lakewarden.sources.reference import loader

# Sources


@query("source_python_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(NULL AS VARCHAR) AS absent FROM nation")
def _python_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [{"k": str(r.n_nationkey), "name": r.n_name} for r in table(spark, sf_dir, "nation").collect()]
    return readers.from_rows(spark, rows, _strings("k", "name", "absent"))


@query("source_python_iterators", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(NULL AS VARCHAR) AS absent FROM customer")
def _python_iterators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of JSON lines, which tasks read by a Python iterator for each file."""
    place = _shared(spark, "iterated")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"), "c_name").repartition(4).write.json(place)
    files = spark.read.format("binaryFile").load(place).select("path")
    return readers.from_iterators(files, _json_lines, _strings("c_custkey", "c_name", "absent"))


def _json_lines(file):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(file.path.replace("file:/", "file:///", 1) if file.path.startswith("file:/") and not file.path.startswith("file://") else file.path)
    with io.BufferedReader(store.open_input_stream(place)) as lines:
        for line in lines:
            yield json.loads(line)


@query("source_reference_data", """SELECT 'table' AS kind, n_name AS name FROM nation UNION ALL SELECT 'filename', r_name FROM region
 UNION ALL SELECT 'uri', s_name FROM supplier UNION ALL SELECT 'arrow', n_name FROM nation WHERE n_regionkey = 1""")
def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    base = _shared(spark, "reference")
    table(spark, sf_dir, "nation").createOrReplaceTempView("lakewarden_reference_nation")
    table(spark, sf_dir, "region").select("r_name").write.parquet(f"{base}/regions.parquet")
    table(spark, sf_dir, "supplier").select("s_name").write.parquet(f"{base}/suppliers.parquet")
    names = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name").toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, names.schema) as writer:
        writer.write_table(names)
    with Files(spark).output(f"{base}/names.arrow") as out:
        out.write(sink.getvalue())
    config = {
        "t": {"type": "table", "table_name": "lakewarden_reference_nation"}, "f": {"type": "filename", "filename": "regions.parquet"},
        "u": {"type": "uri", "uri": f"{base}/suppliers.parquet"}, "a": {"type": "filename", "filename": "names.arrow"},
    }
    load = loader(spark, config, base)
    parts = [load(k).select(F.lit(kind).alias("kind"), F.col(name).alias("name")) for k, kind, name in (("t", "table", "n_name"), ("f", "filename", "r_name"), ("u", "uri", "s_name"), ("a", "arrow", "n_name"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("source_discovery", """SELECT CASE WHEN r_regionkey % 3 = 0 THEN 'submission' ELSE 'dead' END AS kind, 'file' || r_regionkey || '.csv' AS name,
 CASE WHEN r_regionkey % 3 = 0 THEN r_name END AS dataset FROM region WHERE r_regionkey % 3 <> 1
 UNION ALL SELECT 'dead', 'file' || r_regionkey || e, NULL FROM region, (VALUES ('.xml'), ('.metadata.json')) AS v(e) WHERE r_regionkey % 3 = 2""")
def _discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with its sidecar, a file alone, and three files of one stem, by region."""
    base, files = _shared(spark, "inbox"), Files(spark)
    for r in table(spark, sf_dir, "region").collect():
        kinds = {0: (".csv", ".metadata.json"), 1: (".csv",), 2: (".csv", ".xml", ".metadata.json")}[r.r_regionkey % 3]
        for kind in kinds:
            files.write_text(f"{base}/file{r.r_regionkey}{kind}", json.dumps({"dataset_id": r.r_name}))
    found, dead = discover(base, spark)
    rows = [("submission", name_of(s.path), s.dataset_id) for s in found] + [("dead", name_of(f), None) for group in dead for f in group]
    return spark.createDataFrame(rows, "kind string, name string, dataset string")


@query("source_files", """SELECT 'file' || n_nationkey || '.part.TXT' AS name, 'file' || n_nationkey || '.part' AS stem, '.txt' AS extension,
 CAST(length(n_name) AS BIGINT) AS size, n_name AS text, n_nationkey % 2 = 0 AS moved FROM nation""")
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, listed, moved, measured and read through Spark's file systems."""
    base, files, rows = _shared(spark, "files"), Files(spark), []
    for r in table(spark, sf_dir, "nation").collect():
        files.write_text(f"{base}/in/file{r.n_nationkey}.part.TXT", r.n_name)
    for k, place in enumerate(files.files(f"{base}/in")):
        if int(stem_of(place).removeprefix("file").removesuffix(".part")) % 2 == 0:
            files.move(place, f"{base}/out")
    for folder in ("in", "out"):
        for place in files.files(f"{base}/{folder}"):
            rows.append((name_of(place), stem_of(place), extension_of(place), files.size(place), files.read_text(place), folder == "out"))
    return spark.createDataFrame(rows, "name string, stem string, extension string, size long, text string, moved boolean")


@query("reader_guards", """SELECT kind, code, value, CASE WHEN kind = 'good' THEN (SELECT count(*) FROM supplier) END AS rows_read FROM (VALUES ('empty', 'EmptyFileError', NULL), ('null bytes', 'MalformedFile', NULL),
 ('header', 'FieldCountMismatch', 'Missing fields: name; Additional fields: extra'), ('no header', 'FieldCountMismatch', NULL), ('unreadable', 'CSVBroken', 'Unable to parse file. Please check the structure of the file.'),
 ('several headers', 'NonUniqueHeader', 'name: 0, 1'), ('unknown option', 'ReaderError', NULL), ('nested fields', 'ReaderError', NULL), ('good', NULL, NULL)) AS v(kind, code, value)""")
def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files that are refused, and as one that isn't."""
    base, rows, read = _shared(spark, "guards"), [], None
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    nested = T.StructType([T.StructField("name", T.ArrayType(T.StringType()))])
    cases = [
        ("empty", suppliers.where("false").select("name"), {}), ("null bytes", suppliers.selectExpr("concat(name, char(0)) AS line"), {}),
        ("header", suppliers.selectExpr("k", "name AS extra"), {"field_check": True}), ("no header", suppliers.select(F.col("k").cast("string")), {"header": False}),
        ("unreadable", suppliers.select(F.lit(" ").alias("line")), {"field_check_error_code": "CSVBroken"}), ("several headers", suppliers.selectExpr("1 AS k", "k % 2 AS name"), {"reader": "repeating_header_csv"}),
        ("unknown option", suppliers, {"colour": "red"}), ("nested fields", suppliers, {"schema": nested}), ("good", suppliers, {"field_check": True}),
    ]
    for number, (kind, frame, options) in enumerate(cases):
        place = f"{base}/{number}.csv"
        if len(frame.columns) == 1:
            frame.write.text(place)
        else:
            frame.write.option("header", True).csv(place)
        schema = options.pop("schema", _strings("k", "name"))
        try:
            read = readers.get_reader(options.pop("reader", "csv"))(spark, place, schema, **options)
        except readers.SubmissionRejected as error:
            rows.append((kind, error.code, error.value))
        except readers.ReaderError as error:
            rows.append((kind, type(error).__name__, None))
        else:
            rows.append((kind, None, None))
    refused = spark.createDataFrame(rows, "kind string, code string, value string")
    return refused.join(F.broadcast(read.agg(F.count(F.lit(1)).alias("rows_read"))), F.expr("kind = 'good'"), "left")


def _orders_xml(spark: SparkSession, sf_dir: str, place: str) -> T.StructType:
    """Customers with their orders as nested elements; returns the schema to read them with."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("order"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment")).alias("about"), "order").write.format("xml").options(rootTag="customers", rowTag="customer").save(place)
    return T.StructType([T.StructField("id", T.StringType()), T.StructField("about", _strings("segment", "gone")), T.StructField("order", T.ArrayType(_strings("o_orderkey", "o_orderstatus")))])


_NESTED_XML = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS gone, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey"""


def _flat(frame: DataFrame) -> DataFrame:
    return frame.select("id", "about.*", F.explode_outer("order").alias("o")).select("id", "segment", "gone", "o.*")


@query("reader_xml_nested", _NESTED_XML)
def _xml_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _shared(spark, "xml-nested")
    return _flat(readers.read_xml(spark, place, _orders_xml(spark, sf_dir, place), record_tag="customer"))


@query("reader_xml_inferred", _NESTED_XML)
def _xml_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a schema first: a single order is an element, several are a list, and both come out as lists."""
    place = _shared(spark, "xml-inferred")
    return _flat(readers.read_xml(spark, place, _orders_xml(spark, sf_dir, place), record_tag="customer", infer_schema=True))


def _nations_xml(spark: SparkSession, sf_dir: str, end: str = "</f>") -> str:
    """Nations under ``old`` and ``new`` by region, and those of region 4 with a prefix."""
    place, parts = f"{_shared(spark, 'xml-roots')}/nations.xml", {"old": [], "new": [], "n": []}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        kind = "old" if r.n_regionkey == 0 else "n" if r.n_regionkey == 4 else "new"
        p = "n:" if kind == "n" else ""
        parts[kind].append(f"<{p}nation><{p}k>{r.n_nationkey}</{p}k><{p}name>\n {r.n_name} </{p}name></{p}nation>")
    text = f'<?xml version="1.0"?><f xmlns:n="u"><old>{"".join(parts["old"])}</old>' + "".join(f"<new>{x}</new>" for x in parts["new"]) + "".join(parts["n"]) + end
    Files(spark).write_text(place, text)
    return place


@query("reader_xml_root_tag", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation WHERE n_regionkey NOT IN (0, 4)")
def _xml_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_xml(spark, _nations_xml(spark, sf_dir), _strings("k", "name"), record_tag="nation", root_tag="new")


@query("reader_xml_namespace", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation WHERE n_regionkey = 4")
def _xml_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_xml(spark, _nations_xml(spark, sf_dir), _strings("k", "name"), record_tag="nation", namespace="n")


@query("reader_xml_cut_short", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
def _xml_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that ends inside a record."""
    return readers.read_xml(spark, _nations_xml(spark, sf_dir, "<nation><k>99</k><na"), _strings("k", "name"), record_tag="nation")


@query("reader_xml_first_records", "SELECT least(count(*), 7) AS n FROM supplier")
def _xml_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _shared(spark, "xml-first")
    table(spark, sf_dir, "supplier").select("s_suppkey").write.format("xml").options(rootTag="suppliers", rowTag="supplier").save(place)
    read = readers.read_xml(spark, place, _strings("s_suppkey"), record_tag="supplier", n_records_to_read=7)
    return read.agg(F.count("s_suppkey").alias("n"))


@query("reader_xml_xsd", "SELECT * FROM (VALUES ('good', NULL), ('bad', 'NOTVALID')) AS v(kind, code)")
def _xml_xsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, files, rows = _shared(spark, "xml-xsd"), Files(spark), []
    files.write_text(f"{base}/s.xsd", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="k" type="xs:int" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    keys = "".join(f"<k>{r.n_nationkey}</k>" for r in table(spark, sf_dir, "nation").collect())
    for kind, text in (("good", keys), ("bad", keys + "<k>x</k>")):
        files.write_text(f"{base}/{kind}.xml", f"<r>{text}</r>")
        try:
            readers.read_xml(spark, f"{base}/{kind}.xml", _strings("_VALUE"), record_tag="k", xsd_location=f"{base}/s.xsd", xsd_error_code="NOTVALID")
            rows.append((kind, None))
        except readers.SubmissionRejected as error:
            rows.append((kind, error.code))
    return spark.createDataFrame(rows, "kind string, code string")


@query("reader_custom", "SELECT upper(n_name) AS line FROM nation")
def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader of the user's own, chosen by name from a document's configuration."""

    @readers.register_reader("upper_lines")
    def upper_lines(spark: SparkSession, path: str, schema: T.StructType, *, column: str) -> DataFrame:
        return spark.read.text(path).select(F.upper("value").alias(column))

    place = _shared(spark, "lines")
    table(spark, sf_dir, "nation").select("n_name").write.text(place)
    return readers.read_entity(spark, place, _strings("line"), {"reader": "upper_lines", "kwargs_": {"column": "line"}})


# Sinks


@query("sink_entities", "SELECT r_regionkey, r_name, (SELECT count(*) FROM nation) AS nations FROM region")
def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine outputs as Parquet, without the record index."""
    frames = {"region": add_record_index(table(spark, sf_dir, "region").select("r_regionkey", "r_name")), "nation": add_record_index(table(spark, sf_dir, "nation"))}
    written = sinks.write_entities(frames, _shared(spark, "outputs"))
    return written["region"].crossJoin(F.broadcast(written["nation"].agg(F.count(F.lit(1)).alias("nations"))))


@query("sink_strings", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS absent FROM nation")
def _stringified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transformed entity: every leaf a string, in the order of the contract."""
    shaped = readers.stringified(table(spark, sf_dir, "nation"), _strings("n_nationkey", "n_name", "absent"))
    return sinks.write_parquet(shaped, f"{_shared(spark, 'transform')}/nation")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _FILTERS).messages


@query("sink_messages", _REPORT_CTE + """SELECT CASE "Type" WHEN 'File Rejection' THEN 'submission' ELSE 'record' END AS "FailureType", "Error_Code" AS "ErrorCode", "Data_Item" AS "ReportingField" FROM m""")
def _message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    place = sinks.write_messages(messages, _shared(spark, "feedback"), "business_rules")
    return spark.read.schema(messages.schema).json(place).select("FailureType", "ErrorCode", "ReportingField")


@query("sink_error_aggregates", _REPORT_CTE + """SELECT "Type", "Error_Code", count(*) AS "Count" FROM m GROUP BY ALL""")
def _aggregate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = report.aggregates(report.project(_messages(spark, sf_dir)))
    return sinks.write_parquet(counted, f"{_shared(spark, 'audit')}/error_aggregates.parquet").select("Type", "Error_Code", "Count")


@query("sink_processing_errors", "SELECT 'data_contract' AS step_name, 'integrity' AS error_level, 'event ' || event_id AS error_message FROM events WHERE event_type = 'error'")
def _processing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("'data_contract' AS step_name", "concat('event ', event_id) AS error_message")
    return spark.read.json(sinks.write_processing_errors(failures, _shared(spark, "failures"))).select("step_name", "error_level", "error_message")


@query("report_workbook", _REPORT_CTE + """SELECT "Type", "Error_Code", "Data_Item", true AS in_order FROM m""")
def _workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the workbook's last sheet and those it goes on in, read back from the file by a task a sheet, and whether types ascend."""
    folder = _shared(spark, "workbook")
    report.write_report(f"{folder}/report.xlsx", _messages(spark, sf_dir), ["lineitem"], {"File": "lineitem"})
    book = spark.createDataFrame([(f"{folder}/report.xlsx",)], "path string").coalesce(1)
    sheets = readers.from_iterators(book, _sheets, T.StructType.fromDDL("path string, sheet int, type string, code string, item string")).collect()
    # One slice a sheet: a shuffle would hash several sheets to a task, or have small partitions (a row each) put together.
    shards = spark.sparkContext.parallelize([(s.path, s.sheet) for s in sheets], len(sheets)).toDF("path string, sheet int")
    texts = shards.mapInArrow(_row_texts, "sheet int, text string")
    row = F.regexp_extract("text", r'<row r="(\d+)"', 1)
    first = sheets[0]
    cells = texts.select("sheet", row.alias("row"), "text").select(
        "sheet", F.col("row").cast("int").alias("row"), _cell("Type", first.type), _cell("Error_Code", first.code), _cell("Data_Item", first.item)
    )
    place = f"{folder}/rows"
    cells.where(f"sheet > {first.sheet} OR row > 1").write.parquet(place)
    found = spark.read.schema(cells.schema).parquet(place)
    # One row a type: types ascend where each begins after the one before it has ended.
    at = F.struct("sheet", "row")
    by_type = found.groupBy("Type").agg(F.min(at).alias("begins"), F.max(at).alias("ends"))
    follows = F.coalesce(F.lag("ends").over(Window.orderBy("Type")) < F.col("begins"), F.lit(True))
    order = by_type.select(follows.alias("follows")).agg(F.bool_and("follows").alias("in_order"))
    return found.select("Type", "Error_Code", "Data_Item").crossJoin(F.broadcast(order))


def _cell(name: str, column: str) -> Column:
    """The text of a row's cell, null where the row has none."""
    text = F.regexp_extract("text", rf'<c r="{column}\d+"[^>]*>(?:<is><t[^>]*>|<v>)([^<]*)<', 1)
    for written, mark in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(written), F.lit(mark))
    return F.when(F.contains("text", F.concat(F.lit(f'<c r="{column}'), "row", F.lit('"'))), text).alias(name)


_SHEET_SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _row_texts(batches):
    """The rows of each sheet as they are written, those of a piece of its text at a time."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for path, sheet in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as source, zipfile.ZipFile(source) as book, book.open(f"xl/worksheets/sheet{sheet}.xml") as text:
                held = b""
                while piece := text.read(1 << 20):
                    *rows, held = (held + piece).split(b"</row>")
                    number = pa.repeat(pa.scalar(sheet, pa.int32()), len(rows))
                    yield pa.RecordBatch.from_arrays([number, pa.array(rows, pa.binary()).cast(pa.string())], names=["sheet", "text"])


def _first_row(path: str, sheet: int) -> dict[str, str]:
    """The texts of a sheet's first row by column name."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as source, zipfile.ZipFile(source) as book, book.open(f"xl/worksheets/sheet{sheet}.xml") as text:
        row = next(element for _, element in ElementTree.iterparse(text) if element.tag == f"{_SHEET_SPACE}row")
        return {c.get("r").rstrip("0123456789"): "".join(c.itertext()) for c in row}


def _sheets(book):
    """The sheets of messages in a workbook, and in which columns the fields are."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(book.path)
    with store.open_input_file(place) as source, zipfile.ZipFile(source) as archive:
        last = sum(name.startswith("xl/worksheets/sheet") for name in archive.namelist())
    header = {name: column for column, name in _first_row(book.path, 3).items()}
    for sheet in range(3, last + 1):
        yield {"path": book.path, "sheet": sheet, "type": header["Type"], "code": header["Error_Code"], "item": header["Data_Item"]}


_EVENT_TYPE = "CASE event_type WHEN 'error' THEN 'File Rejection' WHEN 'signup' THEN 'Record Rejection' WHEN 'click' THEN 'Warning' END"


@query("report_verdicts", f"""SELECT user_id, CAST(ts AS DATE) AS day, CASE max(CASE {_EVENT_TYPE} WHEN 'File Rejection' THEN 3 WHEN 'Record Rejection' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END)
 WHEN 3 THEN 'File has been rejected' WHEN 2 THEN 'File has been accepted with record rejections' WHEN 1 THEN 'File has been accepted, all records accepted with warnings'
 ELSE 'File has been accepted, no issues to report' END AS verdict FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what was found in submissions, one of a user a day."""
    found = table(spark, sf_dir, "events").selectExpr("user_id", "cast(ts AS date) AS day", f"{_EVENT_TYPE} AS Type")
    return report.verdicts(found, "user_id", "day")


# Messages


@query("messages_distinct", "SELECT 'E' || s_suppkey AS code, s_name AS text FROM supplier")
def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several readers say of each file, once each."""
    said = submission_messages(table(spark, sf_dir, "supplier"), F.expr("concat('E', s_suppkey)"), F.col("s_name"))
    return distinct_messages(union_messages([said, said])).select(F.col("ErrorCode").alias("code"), F.col("ErrorMessage").alias("text"))


@query("messages_of_errors", """SELECT event_type AS kind, 'integrity' AS failure, 'Unexpected error (' || event_type || ': event ' || event_id || ') in data_contract' AS text, 'user ' || user_id AS entity
 FROM events WHERE event_type IN ('error', 'click')""")
def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type IN ('error', 'click')")
    told = sinks.describe_errors(events, F.col("event_type"), F.expr("concat('event ', event_id)"), F.lit("data_contract"), F.expr("concat('user ', user_id)"))
    return told.select(F.col("ErrorType").alias("kind"), F.col("FailureType").alias("failure"), F.col("ErrorMessage").alias("text"), F.col("Entity").alias("entity"))


@query("messages_of_warnings", """SELECT CAST(n_nationkey AS VARCHAR) AS k, 'informational' AS status, 'Wrong format' AS category,
 'NHS number possibly invalid (NHS number starts with ''9'': this indicates a test number)' AS text FROM nation WHERE n_nationkey % 2 = 0""")
def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_record_index(table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) AS k", "if(n_nationkey % 2 = 0, '9434765919', '4010232137') AS number"))
    found = apply_contract(_contract({"k": "str", "number": "nhsnumber"}, keys=("k",)), "rows", rows).messages
    return found.select(F.substring_index("Key", ": ", -1).alias("k"), F.col("Status").alias("status"), F.col("Category").alias("category"), F.col("ErrorMessage").alias("text"))


@query("contract_quoted_names", """SELECT n_nationkey AS "select", n_name AS "two words", n_nationkey % 2 = 0 AS "a.b", n_nationkey % 3 = 0 AS bad FROM nation""")
def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that need quoting: a keyword, a space, a dot."""
    nations = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) AS `select`", "n_name AS `two words`", "if(n_nationkey % 2 = 0, 'yes', 'no') AS `a.b`", "if(n_nationkey % 3 = 0, 'x', '1') AS `from`")
    found = apply_contract(_contract({"select": "int", "two words": "str", "a.b": "bool", "from": "int"}), "rows", nations)
    return found.flagged.select("__typed__.select", "__typed__.`two words`", "__typed__.`a.b`", (F.size("__issues__") > 0).alias("bad"))


# Rules


@query("rules_sync_list", "SELECT n_nationkey, n_name, 'kept' AS note FROM nation WHERE n_regionkey < 3")
def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step list with ``sync`` in it: what stands before prepares the filters, what stands after follows them."""
    config = DatasetConfig.from_json({"transformations": {
        "rules": [{"operation": "add", "entity": "nation", "column_name": "low", "expression": "n_regionkey < 3"}, "sync", "sync",
                  {"operation": "add", "entity": "nation", "column_name": "note", "expression": "'kept'"}, {"operation": "select", "entity": "nation", "columns": ["n_nationkey", "n_name", "note"]}],
        "filters": [{"entity": "nation", "name": "low", "expression": "low", "error_code": "HIGH"}],
    }})
    return evaluate(catalog(spark, sf_dir, "nation"), config.rules).catalog["nation"]


_STORE = {
    "base": {"type": "complex_rule", "rule_config": {"rules": [{"operation": "add", "entity": "nation", "column_name": "a", "expression": "n_nationkey + 1"}]}},
    "after": {"type": "complex_rule", "rule_config": {"dependencies": ["base"], "rules": [{"operation": "add", "entity": "nation", "column_name": "b", "expression": "a * 2"}]}},
}


@query("rules_dependencies", """SELECT n_nationkey, (n_nationkey + 1) * 2 AS b, 'rule ''after'' depends on ''base'', which is not added before it' AS refused FROM nation""")
def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of their dependencies rules run; the other way round they are refused."""
    document = lambda *names: {"transformations": {"rule_stores": [{"rules": _STORE}], "complex_rules": [{"rule_name": n} for n in names]}}
    try:
        DatasetConfig.from_json(document("after", "base"))
        refused = None
    except ConfigError as error:
        refused = str(error)
    done = evaluate(catalog(spark, sf_dir, "nation"), DatasetConfig.from_json(document("base", "after")).rules).catalog["nation"]
    return done.select("n_nationkey", F.col("b").cast("bigint").alias("b"), F.lit(refused).alias("refused"))


@query("rules_data_flow", """SELECT 'with both' AS kind, NULL AS missing, c_mktsegment AS segment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey
 WHERE o_orderstatus IN ('O', 'F') AND coalesce(c_mktsegment <> 'MACHINERY', false) GROUP BY c_mktsegment
 UNION ALL SELECT *, NULL, NULL FROM (VALUES ('without customer', 'root: customer'), ('without any', 'dear_orders: orders'), ('without any', 'root: customer')) AS v(kind, missing)""")
def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a program's steps and filters need that no step before them makes, told before anything runs; it runs where nothing is missing."""
    config, parts = DatasetConfig.from_json(_PROGRAM), []
    for kind, have in (("with both", ("orders", "customer")), ("without customer", ("orders",)), ("without any", ())):
        missing = check_program(config.rules, set(have), config.parameters)
        if missing:
            parts.append(spark.createDataFrame([(kind, m, None, None) for m in missing], "kind string, missing string, segment string, n long"))
        else:
            made = evaluate(catalog(spark, sf_dir, *have), config.rules, config.parameters, {"orders": ("o_orderkey",)}).catalog["by_segment"]
            parts.append(made.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("missing"), "segment", "n"))
    return functools.reduce(DataFrame.unionByName, parts)


@query("rules_templating_runtime", """SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey
 WHERE o_orderstatus IN ('O', 'F') AND coalesce(c_mktsegment <> 'MACHINERY', false) GROUP BY c_mktsegment""")
def _runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = DatasetConfig.from_json({"transformations": {**_PROGRAM["transformations"], "templating_strategy": "runtime"}})
    found = evaluate(catalog(spark, sf_dir, "orders", "customer"), config.rules, config.parameters, {"orders": ("o_orderkey",)}, templating=config.templating)
    return found.catalog["by_segment"]


@query("udf_python", "SELECT n_name, reverse(n_name) || '!' AS turned, CAST(length(n_name) AS BIGINT) AS letters FROM nation")
def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's annotated function, called in expressions."""

    def turned(text: str) -> str:
        return text[::-1] + "!"

    def letters(text: str) -> int:
        return len(text)

    for function in (turned, letters):
        register_python(spark, function)
    return table(spark, sf_dir, "nation").selectExpr("n_name", "turned(n_name) AS turned", "letters(n_name) AS letters")


# Audit: one submission for each nation; regions 1 and 2 have succeeded, region 3 has failed, the others were received

_ID = "md5(CAST(n_nationkey AS VARCHAR))"
_STATUS = "CASE WHEN n_regionkey IN (1, 2) THEN 'success' WHEN n_regionkey = 3 THEN 'failed' ELSE 'received' END"


def _audited(spark: SparkSession, sf_dir: str, show) -> DataFrame:
    """What ``show`` returns of audit tables in a folder of their own; rows go from table to table."""
    audit = AuditLog(spark, location=_shared(spark, "audit"))
    nations = table(spark, sf_dir, "nation").withColumn("submission_id", F.expr("md5(cast(n_nationkey as string))"))
    audit.append("submission_info", nations.selectExpr("submission_id", "concat('d', n_regionkey) AS dataset_id", "n_name AS file_name", "n_nationkey AS file_size"))
    audit.append("processing_status", nations.selectExpr("submission_id", "'received' AS processing_status"))
    audit.append("processing_status", nations.where("n_regionkey IN (1, 2)").selectExpr("submission_id", "'success' AS processing_status", "'success' AS submission_result", "7 AS job_run_id"))
    audit.snapshot()
    audit.append("processing_status", nations.where("n_regionkey = 3").selectExpr("submission_id", "'failed' AS processing_status", "'processing_failed' AS submission_result"))
    transfers = nations.where("n_regionkey = 1").selectExpr("submission_id", "'errors' AS report_name", "concat('t', n_nationkey) AS transfer_id", "'mail' AS transfer_method", "n_name AS recipient")
    audit.append("transfers", transfers)
    audit.append("submission_statistics", nations.selectExpr("submission_id", "n_nationkey AS record_count", "1 AS number_warnings"))
    return show(audit, {k: hashlib.md5(str(k).encode()).hexdigest() for k in range(25)})


_EVENT_STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'received' ELSE 'failed' END"


def _event_audit(spark: SparkSession, sf_dir: str) -> AuditLog:
    """Events as marks of submissions (one a user) in four batches, of which two are in a snapshot; one batch is sent twice."""
    audit = AuditLog(spark, location=_shared(spark, "audit"))
    marks = table(spark, sf_dir, "events").selectExpr("event_id", "md5(cast(user_id as string)) AS submission_id", f"{_EVENT_STATUS} AS processing_status", "event_id AS job_run_id", "ts AS time_updated")
    for k in range(4):
        audit.append("processing_status", marks.where(f"event_id % 4 = {k}"), batch=f"marks-{k}")
        if k == 1:
            audit.snapshot()
    audit.append("processing_status", marks.where("event_id % 4 = 2"), batch="marks-2")
    return audit


@query("audit_events_latest", f"""SELECT md5(CAST(user_id AS VARCHAR)) AS submission_id, {_EVENT_STATUS} AS processing_status, event_id AS job_run_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, {_EVENT_STATUS} DESC, event_id DESC) = 1""")
def _event_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_audit(spark, sf_dir).latest_status().select("submission_id", "processing_status", "job_run_id")


@query("audit_events_history", f"SELECT md5(CAST(user_id AS VARCHAR)) AS submission_id, {_EVENT_STATUS} AS processing_status, event_id AS job_run_id FROM events")
def _event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_audit(spark, sf_dir).table("processing_status").select("submission_id", "processing_status", "job_run_id")


@query("source_arrow_batches", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def _arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as Arrow streams that tasks write, each read by tasks again."""
    place = _shared(spark, "arrow")
    columns = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    names = [r.name for r in columns.mapInArrow(functools.partial(_as_streams, place), "name string").collect()]
    found = [arrowfiles.read_arrow(spark, name, task_bytes=1 << 20) for name in names]
    return functools.reduce(DataFrame.unionByName, found)


def _as_streams(place, batches):
    """One Arrow stream for the rows of each partition."""
    import pyarrow as pa
    from pyarrow import fs
    from pyspark import TaskContext

    first = next(iter(batches), None)
    if first is None:
        return
    uri = place if "://" in place else f"file://{place}"
    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    name = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.arrows"
    with store.open_output_stream(f"{folder}/{name}") as out, pa.ipc.new_stream(out, first.schema) as writer:
        writer.write_batch(first)
        for batch in batches:
            writer.write_batch(batch)
    yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"])], names=["name"])


@query("messages_distinct_in_order", """SELECT l_returnflag AS "Entity", l_linestatus AS "Category", CAST(min(l_orderkey * 10 + l_linenumber) AS BIGINT) AS place FROM lineitem GROUP BY ALL""")
def _distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS Entity", "l_linestatus AS Category", "l_orderkey * 10 + l_linenumber AS place")
    return distinct_messages(messages, order=("place",))


@query("audit_marks", f"""SELECT {_ID} AS submission_id, {_STATUS} AS processing_status, CASE WHEN n_regionkey IN (1, 2) THEN 'success' WHEN n_regionkey = 3 THEN 'processing_failed' END AS submission_result,
 CASE WHEN n_regionkey IN (1, 2) THEN 7 END AS job_run_id FROM nation""")
def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir, lambda audit, _: audit.latest_status().select("submission_id", "processing_status", "submission_result", "job_run_id"))


@query("audit_history", f"""SELECT {_ID} AS submission_id, 'received' AS processing_status FROM nation UNION ALL SELECT {_ID}, {_STATUS} FROM nation WHERE n_regionkey IN (1, 2, 3)""")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir, lambda audit, _: audit.lookup("processing_status", [], newest_only=False).select("submission_id", "processing_status"))


@query("audit_queue", "SELECT n_name AS file_name, 'd' || n_regionkey AS dataset_id, CAST(n_nationkey AS BIGINT) AS file_size FROM nation WHERE n_regionkey IN (0, 4)")
def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir, lambda audit, _: audit.queue("received").select("file_name", "dataset_id", "file_size"))


@query("audit_transfers", "SELECT 't' || n_nationkey AS transfer_id, 'errors' AS report_name, 'mail' AS transfer_method, n_name AS recipient FROM nation WHERE n_regionkey = 1")
def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir, lambda audit, _: audit.lookup("transfers", [("report_name", "==", "errors")]).select("transfer_id", "report_name", "transfer_method", "recipient"))


@query("audit_lookup", "SELECT n_name AS file_name FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey >= 5 AND n_nationkey <> 8 AND n_nationkey < 20")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [("dataset_id", "in", ["d1", "d2"]), ("file_size", ">=", 5), ("file_size", "!=", 8), ("file_size", "<", 20), ("submitting_org", "is null", None)]
    return _audited(spark, sf_dir, lambda audit, _: audit.lookup("submission_info", tests).select("file_name"))


@query("audit_with_info", f"SELECT {_ID} AS submission_id, n_name AS file_name, CAST(n_nationkey AS BIGINT) AS record_count FROM nation")
def _with_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir, lambda audit, _: audit.with_info(audit.table("submission_statistics")).select("submission_id", "file_name", "record_count"))


@query("audit_pending", f"""SELECT CAST(CAST(concat('0x', substr({_ID}, 18, 15)) AS BIGINT) % 3 AS INTEGER) AS bucket, {_ID} AS submission_id FROM nation WHERE n_regionkey IN (0, 4)""")
def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    def show(audit: AuditLog, _) -> DataFrame:
        parts = [audit.downstream_pending(1, k, 3).select(F.lit(k).alias("bucket"), "submission_id") for k in range(3)]
        return parts[0].unionAll(parts[1]).unionAll(parts[2])

    return _audited(spark, sf_dir, show)


@query("audit_export", f"SELECT 'status' AS kind, count(*) AS n FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'success', count(*) FROM nation WHERE n_nationkey = 1")
def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    def show(audit: AuditLog, ids: dict[int, str]) -> DataFrame:
        places = audit.export(ids[1], _shared(spark, "export"))
        status = spark.read.parquet(next(p for p in places if "processing_status" in p))
        return status.select(F.when(F.col("processing_status") == "success", "success").otherwise("status").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    return _audited(spark, sf_dir, show)
