import io
import tracemalloc
import zipfile

import pytest

from segmentry.sources import inputs, xlsx
from segmentry.sources.bilingual import Rejected

SHARED = """<sst xmlns="m"><si><t>uno</t></si><si><r><t>o</t></r><r><t>ne</t></r><rPh><t>no</t></rPh></si></sst>"""
SHEET = """<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>source</t></is></c><c r="B1" t="str"><v>target</v></c></row>
<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2"><v>7.0</v></c></row><row r="3"/><row r="4"><c r="B4" t="b"><v>1</v></c></row></sheetData></worksheet>"""


def book(sheet=SHEET):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", SHARED)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet/>")
    return out.getvalue()


def test_read_rows_and_inputs():
    assert xlsx.read_rows(book()) == [["source", "target"], ["uno", "one", "", "7"], [], ["", "TRUE"]]
    assert inputs.glossary(book()) == [("uno", "one", None)]
    assert inputs.confusable_groups(book()) == [["source", "target"], ["uno", "one", "7"]]
    assert xlsx.column_number("A1") == 0 and xlsx.column_number("AA7") == 26
    for bad in ("<!DOCTYPE x><worksheet/>", "<worksheet>"):
        with pytest.raises(Rejected):
            xlsx.read_rows(book(bad))


def test_round_trip_of_any_text():
    rows = [["1", "=1+2", "a <b> & \"c\"\n\r\t"], ["007", "\x01 _x0041_ ￾", "ñ 😀"], ["12345678901234567890", "", " edge "]]
    data = xlsx.workbook(["segment", "b", "c"], rows, numbers=["segment"])
    assert xlsx.read_rows(data) == [["segment", "b", "c"], *rows]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<f>" not in sheet and "<c><v>1</v></c>" in sheet and "<v>007</v>" not in sheet
    with pytest.raises(ValueError, match="32767"):
        xlsx.workbook(["a"], [["x" * 32_768]])


def test_full_sheets_are_followed_by_others():
    data = xlsx.workbook(["a"], ([str(i)] for i in range(7)), sheet_rows=4)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [n for n in z.namelist() if "worksheets/" in n] == [f"xl/worksheets/sheet{k}.xml" for k in (1, 2, 3)]
        assert b'name="QA report 3"' in z.read("xl/workbook.xml")
        assert z.read("xl/worksheets/sheet3.xml").count(b"<row>") == 2
    assert xlsx.read_rows(xlsx.workbook(["a"], [])) == [["a"]]


def test_workbooks_of_a_table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", None) for i in range(25)], "segment long, source string, note string").repartitionByRange(3, "segment").sortWithinPartitions("segment")
    xlsx.write_xlsx(df, str(tmp_path / "out"))
    rows = []
    for p in sorted((tmp_path / "out").iterdir()):
        head, *body = xlsx.read_rows(p.read_bytes())
        assert head == ["segment", "source", "note"]
        rows += body
    assert rows == [[str(i), f"text {i}", ""] for i in range(25)]
    assert xlsx.workbooks(df.coalesce(1), book_rows=10).count() == 3 and xlsx.workbooks(df.where("false")).count() == 0


def test_workbooks_hold_no_book_of_rows_in_memory():
    """all rows of a book were held as lists before the first was written."""
    tracemalloc.start()
    data = xlsx.workbook(["a", "b"], ((str(i), "x" * 50) for i in range(100_000)), sheet_rows=60_001)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.reset_peak()
    assert xlsx.sheet_count(data) == 2
    assert [sum(1 for _ in xlsx.each_row(data, k)) for k in (0, 1)] == [60_001, 40_001]
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()


def test_fl_workbook_reads_every_sheet(spark, monkeypatch):
    """rows of a second sheet were not read again."""
    whole = xlsx.workbooks
    monkeypatch.setattr(xlsx, "workbooks", lambda rows: whole(rows, sheet_rows=50))
    from segmentry.plans.queries import QUERIES, issues

    assert QUERIES["fl_workbook"](spark, "/root/testdata/sf0.001").count() == issues(spark, "/root/testdata/sf0.001").count()
