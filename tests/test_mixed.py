"""Feeds of all formats in one scan."""

import json

import pytest

from shelfwise.sources import mixed, readers


def records(kind, content):
    return [r[1:] for r in mixed._rows("s", kind, content if isinstance(content, bytes) else content.encode())]


@pytest.mark.parametrize(
    ("xml", "tag"),
    [
        ("<a><offer><attr/><attr/><attr/></offer><offer/></a>", "offer"),
        ("<a><x><o/><o/></x><p/><p/><p/><q/><q/></a>", "p"),
        ('<a xmlns="u:v"><o/><o/></a>', "o"),
        ("<a><b/></a>", None),
        ("<a><o/><o/><b>", "o"),
    ],
)
def test_record_tags(xml, tag):
    assert mixed.record_tag(xml.encode()) == tag


def test_records_of_each_format():
    xml = '<f xmlns:g="u"><o id="1"><g:n>A</g:n><i>x</i><i>y</i><p name="Kolor">biały</p></o><o><n/></o></f>'
    assert records("xml", xml) == [(0, "@id", "1"), (0, "n", "A"), (0, "i", "x"), (0, "i[2]", "y"), (0, "p:Kolor", "biały"), (1, "n", "")]
    assert records("json", json.dumps({"a": [1], "b": [{"x": None, "y": 2, "z": [3], "t": "é"}, 4, {"x": "q"}]})) == [(0, "x", ""), (0, "y", "2"), (0, "z", "[3]"), (0, "t", "é"), (1, "x", "q")]
    assert records("csv", "\ufeffa;b;\n1;2,5;9\n\"x\ny\";\n".encode()) == [(0, "a", "1"), (0, "b", "2,5"), (1, "a", "x\ny"), (1, "b", "")]


@pytest.mark.parametrize(("kind", "content"), [("xml", ""), ("xml", "<a>"), ("xml", "<a><b/></a>"), ("json", "{"), ("json", "{}"), ("json", "3"), ("json", "[]"), ("csv", ""), ("csv", "a;b")])
def test_faults_are_one_row(kind, content):
    rows = records(kind, content)
    assert len(rows) == 1 and rows[0][:2] == (-1, "!error") and rows[0][2]


def test_what_came_before_a_fault_stays():
    rows = records("xml", "<a><o><n>1</n></o><o><n>2</n></o><o><n>3")
    assert rows[:2] == [(0, "n", "1"), (1, "n", "2")] and rows[2][:2] == (-1, "!error") and len(rows) == 3


def test_a_folder_and_tabs(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.xml").write_text("  <a><o><n>1</n></o><o><n>2</n></o></a>")
    (tmp_path / "deep" / "two.txt").write_text('[{"n": "wymiary: 600x400x50 mm"}]')
    (tmp_path / "three.csv").write_bytes("n,m\nżółw,2\n".encode())
    (tmp_path / "bad.json").write_text("[{")
    cells = [("X", 1, ['<?xml version="1.0"?>']), ("X", 2, ["<o><n>5</n></o>"]), ("X", 3, [""]), ("X", 4, ["<o><n>6</n></o>"]), ("J", 1, ['{"n": 7}']), ("J", 2, ['{"n": "8"}']), ("T", 1, ["n", "m"]), ("T", 2, ["9"])]
    sheet = spark.createDataFrame(cells, "tab string, row_no long, cells array<string>")
    got = {(r.source, r.field, r.value) for r in mixed.scan(mixed.files(spark, str(tmp_path)), sheet).where("field <> '!error'").collect()}
    assert {("one", "n", "1"), ("one", "n", "2"), ("two", "n", "wymiary: 600x400x50 mm"), ("three", "n", "żółw"), ("three", "m", "2"), ("X", "n", "5"), ("X", "n", "6"), ("J", "n", "7"), ("J", "n", "8"), ("T", "n", "9"), ("T", "m", "")} <= got
    assert ("two", "n » wymiar 1", "60") in got
    bad = mixed.scan(mixed.files(spark, str(tmp_path))).where("field = '!error'").collect()
    assert [(r.source, r.rec) for r in bad] == [("bad", -1)]
    none = readers.with_format(spark.createDataFrame([], "path string, content binary"))
    assert mixed.records(none.withColumnRenamed("path", "source")).count() == 0


def test_rows_go_on_while_reading(spark, monkeypatch):
    feed = "<a>" + "".join(f"<o><n>{k}</n></o>" for k in range(20000)) + "</a>"
    docs = spark.createDataFrame([("s", "xml", bytearray(feed.encode()))], "source string, format string, content binary")
    assert mixed.records(docs).selectExpr("count(*)", "max(rec)", "count(distinct value)").first()[:] == (20000, 19999, 20000)


def test_queries_register_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=__file__.rsplit("/", 2)[0]).returncode == 0
