"""Records cut out of files by many tasks, against Spark's readers of one task."""

import csv
import json
import random

import pytest
from pyspark.sql import types as T

from lakewarden.sources import readers
from lakewarden.sources.splitting import CsvScanner, JsonScanner, Records, XmlScanner


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "1500")
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def cells(seed, n):
    draw = random.Random(seed)
    odd = ["\n", '"', ",", '",\n"', "ž", "{", "}", "[", "]", "\r\n", "'", ":"]
    return [("".join(draw.choice(odd) if draw.random() < 0.4 else draw.choice("abc ") for _ in range(draw.choice([0, 3, 12]))).strip(), str(k)) for k in range(n)]


def strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def test_quoted_line_breaks_at_the_borders_of_splits(spark, tmp_path, rows, small_splits):
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator="\n", delimiter=";", quotechar="'")
        writer.writerow(["u", "id"])
        writer.writerows(cells(1, 700))
        writer.writerow(["x" * 6000 + "\n" + "y" * 3000, "long"])  # over several splits
        writer.writerow(["last", "one"])
    frame = readers.read_csv(spark, path, strings("id", "u"), multi_line=True, delimiter=";", quote_char="'", escape_char="'", null_values=())
    assert frame.rdd.getNumPartitions() > 3
    with open(path, newline="", encoding="utf-8") as source:
        expected = [(r[1], r[0].replace("\r\n", "\n").strip(" ")) for r in list(csv.reader(source, delimiter=";", quotechar="'"))[1:]]
    assert sorted((a, (b or "").replace("\r\n", "\n")) for a, b in rows(frame)) == sorted(expected) and len(expected) == 702


@pytest.mark.parametrize("escape", ["\\", '"'])
def test_odd_quotes_are_read_as_by_spark(spark, tmp_path, rows, escape):
    path = str(tmp_path / "b.csv")
    lines = ['id,u,v', '1,"a""b', 'c",d', '2,"x""', 'y",z', '3,"p\\"', 'q",r', '4,"q" ', "w,5", '5,a"b', '6,"",""', '7,"k"l,m"', '8, "n', 'o",p', "", '9,"""a', 'b""",c', '10,"open', "end"]
    (tmp_path / "b.csv").write_text("\n".join(lines))
    options = {"escape": escape}
    whole = spark.read.csv(path, header=True, multiLine=True, nullValue="\x01", emptyValue="", **options)
    assert rows(readers._split_csv(spark, path, ["id", "u", "v"], True, options)) == rows(whole)


def test_objects_of_an_array_at_the_borders_of_splits(spark, tmp_path, rows, small_splits):
    content = [{"id": k, "n": {"u": u, "deep": [{"x": u}]}, "l": [u, "\\"]} for u, k in cells(2, 300)] + [{"id": "long", "l": ["{" * 5000]}, {}]
    schema = T._parse_datatype_string("id string, n struct<u: string, deep: array<struct<x: string>>>, l array<string>")
    for name, indent in (("a.json", None), ("b.json", 2)):
        (tmp_path / name).write_text(json.dumps(content, ensure_ascii=False, indent=indent), encoding="utf-8")
        frame = readers.read_json(spark, str(tmp_path / name), schema)
        assert frame.rdd.getNumPartitions() > 3
        assert rows(frame) == rows(spark.read.schema(schema).json(str(tmp_path / name), multiLine=True)) and frame.count() == 302
    (tmp_path / "cut.json").write_text('[{"id": "1"}, {"id": "2"}, {"id": "3", "l": ["a')
    assert rows(readers.read_json(spark, str(tmp_path / "cut.json"), strings("id"))) == [("1",), ("2",)]


def test_elements_at_the_borders_of_splits(spark, tmp_path, rows, small_splits, monkeypatch):
    draw = random.Random(3)
    inner = ["plain", "<![CDATA[ <rec> ]]>", "a &lt; b", "two\n lines", "<!-- </rec> > -->z", "", "<deep><rec2>1</rec2></deep>", "w" * 4000]
    parts = ['<?xml version="1.0"?>\n<root xmlns:n="u">\n<!-- <rec><id>no</id></rec> -->']
    for k in range(200):
        prefix, text = draw.choice(["", "n:"]), draw.choice(inner)
        parts.append(draw.choice([
            f"<{prefix}rec><id>{k}</id><v>{text}</v><l>1</l><l>{k}</l></{prefix}rec>\n", f'<rec a="1">\n <v>{text}</v><id>{k}</id></rec>', "<rec/>", '<rec a="/" />',
            "<other><id>9</id></other>", f"<!-- {'x' * draw.randint(0, 3000)} <rec> -->", "<?pi <rec> ?>",
        ]))
    (tmp_path / "a.xml").write_text("".join([*parts, "</root>"]))
    (tmp_path / "cut.xml").write_text("".join([*parts, "<rec><id>cut</id><v>x"]))
    schema = T._parse_datatype_string("id string, v string, l array<string>")
    for name in ("a.xml", "cut.xml"):
        frame = readers.read_xml(spark, str(tmp_path / name), schema, record_tag="rec")
        assert frame.rdd.getNumPartitions() > 3
        found = rows(frame)
        with monkeypatch.context() as patch:
            patch.setattr(readers, "_splits", lambda encoding: False)
            assert found == rows(readers.read_xml(spark, str(tmp_path / name), schema, record_tag="rec")) and len(found) > 100


def summed(scanner, data):
    marks = list(scanner.scan(data))
    return scanner.mode, scanner.depth, scanner.lowest, marks


@pytest.mark.parametrize("make, text", [
    (lambda mode=0, depth=0: CsvScanner(mode, depth, escape='"'), 'a,"b\nc",d\n"""x\n",y\nz\n'), (JsonScanner, '[{"a": "}{\\"", "b": [{}]}, {"c": "\\\\"}, {}]}'),
    (lambda mode=0, depth=0: XmlScanner(mode, depth, tag="r"), "<x><r a='1'><r/>t</r><!-- <r> > --><r/><![CDATA[>]]><r>u</r></x>"),
])
def test_a_scan_can_stop_at_any_chunk_and_go_on(make, text):
    data, separator = text.encode(), make().separator.encode()
    whole = summed(make(), data)
    assert sum(begins for _, begins in whole[3]) == sum(not begins for _, begins in whole[3]) >= 3
    for cut in [k + 1 for k in range(len(data)) if data[k : k + 1] == separator]:
        first = make()
        marks = list(first.scan(data[:cut]))
        second = make(first.mode, first.depth)
        marks += [(at + cut, begins) for at, begins in second.scan(data[cut:])]
        assert marks == whole[3] and (second.mode, second.depth) == whole[:2]
        # Depths of a scan that begins at 0 differ by a constant only.
        alone = make(first.mode, make().begin(first.mode))
        list(alone.scan(data[cut:]))
        assert (alone.mode, alone.depth - make().begin(first.mode)) == (second.mode, second.depth - first.depth)


def test_files_of_one_folder_are_apart(spark, tmp_path, rows, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("id,u\n" + "".join(f'{j},"a\n{k}"\n' for j in range(k * 300)))
    frame = readers.read_csv(spark, str(tmp_path), strings("id", "u"), multi_line=True)
    assert frame.groupBy("u").count().orderBy("u").collect() == [("a\n1", 300), ("a\n2", 600)]
    found = Records(spark, str(tmp_path), CsvScanner).frame()
    assert found.select("file", "block", "number").distinct().count() == found.count() == 903
