"""What only larger tables, more partitions or larger keys show."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.queries import ORACLE_SQL, QUERIES
from lakewarden.sources import readers

SMALLEST = Path("/root/testdata/sf0.001")


def strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def test_first_file_of_a_folder_is_empty(spark, tmp_path, rows):
    """A task without rows leaves an empty file, as Spark's XML and JSON writers do."""
    texts = {"xml": "<a><r><k>1</k></r></a>", "json": '[{"k": "1"}]', "csv": "k\n1\n"}
    for kind, text in texts.items():
        folder = tmp_path / kind
        folder.mkdir()
        (folder / f"part-0.{kind}").write_text("")
        (folder / f"part-1.{kind}").write_text(text)
    assert rows(readers.read_xml(spark, str(tmp_path / "xml"), strings("k"), record_tag="r", root_tag="a")) == [("1",)]
    assert rows(readers.read_json(spark, str(tmp_path / "json"), strings("k"))) == [("1",)]
    assert rows(readers.read_csv(spark, str(tmp_path / "csv"), strings("k"), multi_line=True)) == [("1",)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "part-0.xml").write_text("")
    with pytest.raises(readers.EmptyFileError):
        readers.read_xml(spark, str(tmp_path / "none"), strings("k"), record_tag="r")


def compared(spark, rows, folder, name, table):
    """The rows of a query and of its SQL over one table."""
    frame = QUERIES[name](spark, str(folder))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return rows(frame), sorted(connection.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)


def test_nhs_numbers_of_keys_that_make_eleven_digits(spark, tmp_path, rows):
    spark.range(1_136_000, 1_137_500).union(spark.range(9_000_000, 9_000_500)).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    found, expected = compared(spark, rows, tmp_path, "contract_type_nhs_number", "orders")
    assert found == expected and len(found) == 2000
    assert {len(v) for _, v, _ in found} == {10, 11} and {bad for _, _, bad in found} == {True, False}


@pytest.mark.parametrize("escape", ["\\", '"'])
def test_whole_records_are_found_as_line_by_line(escape):
    import random

    from lakewarden.sources.splitting import CsvScanner

    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(['"', '"', ",", "\n", "\\", "a", '","', '""', '"\n"']) for _ in range(draw.randint(0, 25))).encode() + b"\n"
        inside = draw.randint(0, 1)
        one, other = CsvScanner(inside, inside, escape=escape), CsvScanner(inside, inside, escape=escape)
        places, begins = one.edges(text)
        assert list(zip(places.tolist(), begins.tolist(), strict=True)) == list(other.scan(text))
        assert (one.mode, one.depth, one.lowest) == (other.mode, other.depth, other.lowest)


def test_files_of_one_split_are_cut_in_one_pass(spark, tmp_path, rows):
    from lakewarden.sources.splitting import CsvScanner, Records

    (tmp_path / "a.csv").write_text('1,"a\nb"\n2,"open\nend')
    (tmp_path / "b.csv").write_text("3,c\n")
    records = Records(spark, str(tmp_path), lambda mode, depth: CsvScanner(mode, depth, escape='"'))
    assert {r.alone for r in records.chunks.collect()} == {True}
    assert rows(records.frame(), "text") == [('1,"a\nb"\n',), ('2,"open\nend\n',), ("3,c\n",)]


def test_workbook_of_several_sheets_is_read_whole(spark, monkeypatch):
    if not SMALLEST.exists():
        pytest.skip("no test tables")
    whole = QUERIES["report_workbook"](spark, str(SMALLEST)).count()
    monkeypatch.setattr("lakewarden.plans.report.SHEET_ROWS", 700)
    monkeypatch.setattr("lakewarden.plans.report.FETCHED_ROWS", 300)
    found = QUERIES["report_workbook"](spark, str(SMALLEST))
    assert found.count() == whole > 2 * 700 and {r.in_order for r in found.select("in_order").distinct().collect()} == {True}


def test_workbook_rows_are_rendered_by_tasks(spark, tmp_path, monkeypatch):
    import zipfile
    from xml.etree import ElementTree

    from pyspark.sql import DataFrame

    from lakewarden.plans import report
    from lakewarden.plans.messages import from_mapping

    def fetched(self, *_):
        raise AssertionError("rows of the driver")

    # Frames of a classic session have a class of their own.
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", fetched)
    monkeypatch.setattr(DataFrame, "toLocalIterator", fetched)
    monkeypatch.setattr(report, "SHEET_ROWS", 40)
    monkeypatch.setattr(report, "FETCHED_ROWS", 15)
    texts = ["<&>]]>", "a\x01b\tc", "", None, "é\U0001f600", "&amp;"]
    messages = from_mapping(spark, [{"Entity": "p", "FailureType": "record", "Status": "error", "ErrorCode": "E", "ErrorMessage": texts[k % 6], "RecordIndex": k} for k in range(119)])
    report.write_report(str(tmp_path / "r.xlsx"), messages, ["p"], {})
    found = []
    with zipfile.ZipFile(tmp_path / "r.xlsx") as book:
        assert book.testzip() is None
        assert sum(n.startswith("xl/worksheets") for n in book.namelist()) == 5
        for sheet in (3, 4, 5):
            rows = ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml"))[0]
            assert [r.get("r") for r in rows] == [str(k) for k in range(1, 41)]
            assert all(c.get("r").lstrip("ABCDEFGHI") == r.get("r") for r in rows for c in r)
            found += [{c.get("r")[0]: "".join(c.itertext()) for c in r} for r in rows]
    assert [r["F"] for r in found] == ["Record_Index", *(str(k) for k in range(119))]
    assert [r.get("E") for r in found[1:]] == [("ab\tc" if k % 6 == 1 else texts[k % 6]) for k in range(119)]


def test_messages_are_built_by_generated_code(spark):
    from lakewarden.operators.filters import apply_filters
    from lakewarden.plans.config import build_filter

    specs = [{"entity": "t", "name": n, "expression": f"id > {n}", "error_code": f"E{n}", "failure_message": "id {{id}}"} for n in (1, 2)]
    messages = apply_filters(spark.range(4).toDF("id"), [build_filter(s) for s in specs], ("id",)).messages
    assert sorted((r.ErrorCode, r.ErrorMessage) for r in messages.collect()) == [("E1", "id 0"), ("E1", "id 1"), ("E2", "id 0"), ("E2", "id 1"), ("E2", "id 2")]
    generate = next(line for line in messages._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line)
    assert "*(" in generate and "concat" not in generate
