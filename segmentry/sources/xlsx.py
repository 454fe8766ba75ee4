"""Workbooks in and out, with the standard library's zip and XML parsers only.

Reading streams one sheet's rows as texts. Writing makes one workbook for each task's share of a report: its rows go out
as they come, a full sheet is followed by another one, and the files are committed by ``binary_sink``. Cells are texts,
so translated content can never be a formula; a text that no cell can hold is an error and not cut.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_sink import write_files
from .bilingual import Rejected, open_word

#: What a sheet and a cell can hold.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767
#: Rows of a task's workbook, about; a further workbook follows.
BOOK_ROWS = 200_000
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def _parsed(data: bytes, start, end, text=None) -> None:
    for _ in _fed(io.BytesIO(data), start, end, text):
        pass


def _fed(file, start, end, text=None) -> Iterator[None]:
    """Parse a file piece by piece; yields after each piece."""
    def refuse(*_):
        raise Rejected("entities and document types are refused")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.StartDoctypeDeclHandler = refuse
    if text:
        parser.CharacterDataHandler = text
    try:
        while piece := file.read(1 << 16):
            parser.Parse(piece, False)
            yield
        parser.Parse(b"", True)
        yield
    except expat.ExpatError as e:
        raise Rejected(f"not well formed: {e}") from None


def column_number(place: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in place.rstrip("0123456789"):
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _shared(data: bytes) -> list[str]:
    """Shared strings: the texts of an entry's runs, phonetic ones left out."""
    out: list[str] = []
    state = {"on": False, "aside": 0}

    def start(name, _):
        local = name.rsplit(":", 1)[-1]
        if local == "si":
            out.append("")
        state["aside"] += local == "rPh"
        state["on"] = local == "t" and not state["aside"]

    def end(name):
        state["aside"] -= name.rsplit(":", 1)[-1] == "rPh"
        state["on"] = False

    def text(data):
        if state["on"]:
            out[-1] += data

    _parsed(data, start, end, text)
    return out


def _shown(kind: str, value: str, shared: Sequence[str]) -> str:
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(value, value)
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", value):
        return value.partition(".")[0]
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), value) if kind in ("inlineStr", "str") else value


def _sheets(z: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))


def sheet_count(data: bytes) -> int:
    with open_word(data) as (z, _):
        return len(_sheets(z))


def each_row(data: bytes, sheet: int = 0) -> Iterator[list[str]]:
    """The rows of a sheet as texts, as they are read; missing cells are empty, rows without cells too."""
    with open_word(data) as (z, _):
        shared = _shared(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = _sheets(z)
        if not sheets:
            raise Rejected("a workbook without sheets")
        rows: list[list[str]] = []
        cell = {"at": 0, "kind": "n", "value": [], "on": False}

        def start(name, attributes):
            local = name.rsplit(":", 1)[-1]
            if local == "row":
                rows.append([])
            elif local == "c":
                cell["at"] = column_number(attributes["r"]) if "r" in attributes else len(rows[-1])
                cell["kind"], cell["value"] = attributes.get("t", "n"), []
            cell["on"] = local == "v" or local == "t"

        def end(name):
            cell["on"] = False
            if name.rsplit(":", 1)[-1] == "c":
                rows[-1] += [""] * (cell["at"] + 1 - len(rows[-1]))
                rows[-1][cell["at"]] = _shown(cell["kind"], "".join(cell["value"]), shared)

        def text(data):
            if cell["on"]:
                cell["value"].append(data)

        with z.open(sheets[sheet]) as file:
            for _ in _fed(file, start, end, text):
                # the last row may go on in the next piece
                yield from rows[:-1]
                del rows[:-1]
        yield from rows


def read_rows(data: bytes) -> list[list[str]]:
    """The rows of the first sheet."""
    return list(each_row(data))


def _xml(text: str) -> str:
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = NOT_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", text.replace("\r", "_x000D_"))
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _row(values: Sequence[str], numbers: frozenset[int]) -> bytes:
    cells = []
    for i, v in enumerate(values):
        if len(v) > CELL_CHARS:
            raise ValueError(f"a cell of more than {CELL_CHARS} characters; use another format")
        if i in numbers and re.fullmatch("0|[1-9][0-9]{0,14}", v):
            cells.append(f"<c><v>{v}</v></c>")
        else:
            cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{_xml(v)}</t></is></c>')
    return f"<row>{''.join(cells)}</row>".encode()


def workbook(header: Sequence[str], rows: Iterable[Sequence[str]], title: str = "QA report", numbers: Iterable[str] = (), sheet_rows: int = SHEET_ROWS) -> bytes:
    """A workbook of texts; columns named in ``numbers`` are numbers where they are whole. A full sheet is followed by another."""
    out, sheets, left = io.BytesIO(), 0, iter(rows)
    number = frozenset(i for i, h in enumerate(header) if h in set(numbers))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        row = next(left, None)
        while row is not None or not sheets:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                f.write(_row(header, frozenset()))
                n = 1
                while row is not None and n < sheet_rows:
                    f.write(_row(row, number))
                    n, row = n + 1, next(left, None)
                f.write(b"</sheetData></worksheet>")
        names = [_xml(title if k == 1 else f"{title} {k}").replace('"', "&quot;") for k in range(1, sheets + 1)]
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                   + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, sheets + 1)) + "</Relationships>")
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, sheets + 1)) + "</Types>")
    return out.getvalue()


def workbooks(rows: DataFrame, title: str = "QA report", numbers: Sequence[str] = ("segment",), book_rows: int = BOOK_ROWS, sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """(name, content): the rows of each partition, in their order, as workbooks of at most about ``book_rows`` rows; empty partitions give none."""
    header = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, book = None, 0

        def all_rows() -> Iterator[tuple[str, ...]]:
            nonlocal part
            for batch in batches:
                part = int(batch["_part"].iloc[0]) if len(batch) else part
                yield from batch[header].itertuples(index=False, name=None)

        left = all_rows()
        first = next(left, None)
        while first is not None:
            content = workbook(header, itertools.chain([first], itertools.islice(left, book_rows - 1)), title, numbers, sheet_rows)
            yield pd.DataFrame([(f"report-{part:05d}-{book:03d}.xlsx", content)], columns=["name", "content"])
            first, book = next(left, None), book + 1

    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in header]
    return rows.select(*texts, F.spark_partition_id().alias("_part")).mapInPandas(run, "name string, content binary")


def write_xlsx(rows: DataFrame, path: str, title: str = "QA report", numbers: Sequence[str] = ("segment",)) -> None:
    """A folder of workbooks, one for each task's share of the rows."""
    write_files(workbooks(rows, title, numbers), path)
