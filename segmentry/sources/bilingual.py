"""TMX, XLIFF 1.2 and DOCX files as segments.

Files are read as binary rows and parsed in the tasks, one file at a time, by a pull parser that frees each unit when it
is done. Entities and document types are refused; ZIP members are counted and measured before they are opened.
"""

from __future__ import annotations

import contextlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..schema import SEGMENT

#: Limits at the boundary.
MOST_BYTES, MOST_EXPANDED, MOST_MEMBERS, MOST_RATIO = 100 << 20, 300 << 20, 20_000, 500
CODES = frozenset("ph x bpt ept it bx ex ut".split())
TAGS = frozenset("ph bpt ept it bx ex x g mrk sub".split())
LITERAL = re.compile(r"</?(?:ph|bpt|ept|it|bx|ex|x|g|mrk|sub)(?:\s[^<>]*)?/?>")


class Rejected(ValueError):
    """A file that is not read, and why."""


def plain_bytes(data: bytes) -> bytes:
    """UTF-8 without a mark."""
    if len(data) > MOST_BYTES:
        raise Rejected("larger than 100 MiB")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16")
        return re.sub(r"(<\?xml[^>]*?)\s+encoding=[\"'][^\"']*[\"']", r"\1", text, count=1).encode()
    return data.removeprefix(b"\xef\xbb\xbf")


def format_of(name: str, data: bytes) -> str:
    low = name.lower()
    for ending, kind in ((".tmx", "tmx"), (".docx", "docx"), (".doc", "doc"), (".mqxliff", "xliff"), (".xliff", "xliff"), (".xlf", "xliff")):
        if low.endswith(ending):
            return kind
    if data[:4] == b"PK\x03\x04" and b"word/" in data:
        return "docx"
    return "tmx" if b"<tmx" in data[:2048] else "xliff"


class Side:
    """One language's text of a unit: visible text, text with [id] marks, with marks of chips only, raw text, tags."""

    def __init__(self):
        self.text: list[str] = []
        self.display: list[str] = []
        self.edges: list[str] = []
        self.tags: list[dict] = []
        self.empty_code: list[str] = []

    def add(self, data: str, hidden: bool) -> None:
        if hidden:
            self.empty_code.append(data)
        else:
            for part in (self.text, self.display, self.edges):
                part.append(data)

    def open(self, name: str, attributes: dict) -> None:
        number = attributes.get("id") or attributes.get("i")
        style = (attributes.get("ctype") or "").lower()
        self.tags.append({"name": name, "id": number, "is_fmt": name in ("bpt", "ept") and any(k in style for k in ("bold", "italic", "underline"))})
        if name not in ("mrk", "sub"):
            mark = f"[{number}]" if number else f"[{name}#{sum(t['name'] == name for t in self.tags)}]"
            self.display.append(mark)
            if not self.tags[-1]["is_fmt"]:
                self.edges.append(mark)

    def close(self, name: str) -> None:
        if name in ("bpt", "ept") and "".join(self.empty_code) in ("", "{}"):
            for tag in reversed(self.tags):
                if tag["name"] == name:
                    if not tag["is_fmt"]:
                        tag["is_fmt"] = True
                        self.edges[:] = self.edges[: -1] if self.edges and self.edges[-1].startswith("[") else self.edges
                    break
        if name == "g":
            number = next((t["id"] for t in reversed(self.tags) if t["name"] == "g"), None)
            self.display.append(f"[/{number}]")
            self.edges.append(f"[/{number}]")

    def texts(self) -> tuple[str, str, str, str]:
        raw = "".join(self.text)
        clean = LITERAL.sub("", raw)
        return (re.sub(" {2,}", " ", clean) if clean != raw else raw), raw, "".join(self.display), "".join(self.edges)


def units(data: bytes, kind: str) -> Iterator[dict]:
    """Units with id, languages, sides and document id, as the parser meets them."""
    done: list[dict] = []
    state: dict = {"unit": None, "side": None, "hidden": 0, "lang": None, "stack": [], "pair": (None, None), "prop": None, "header": None}

    def start(name, attributes):
        name = name.rsplit(":", 1)[-1].rsplit("}", 1)[-1]
        attributes = {k.rsplit(":", 1)[-1]: v for k, v in attributes.items()}
        state["stack"].append(name)
        if len(state["stack"]) == 1 and name not in ("tmx", "xliff"):
            raise Rejected(f"root element {name}")
        if name == "header":
            state["header"] = attributes.get("srclang")
        elif name == "file":
            pair = (attributes.get("source-language"), attributes.get("target-language"))
            if state["pair"][0] not in (None, pair[0]) or state["pair"][1] not in (None, pair[1]):
                raise Rejected("files of different language pairs")
            state["pair"] = pair
        elif name in ("tu", "trans-unit"):
            state["unit"] = {"id": attributes.get("tuid") or attributes.get("id"), "sides": {}, "document": None}
        elif state["unit"] is not None and name == "tuv":
            state["lang"] = attributes.get("lang")
            if state["lang"] in state["unit"]["sides"]:
                raise Rejected("a language twice in one unit")
        elif state["unit"] is not None and name == "prop" and attributes.get("type") == "x-document":
            state["prop"] = []
        elif state["unit"] is not None and name in ("seg", "source", "target") and state["side"] is None and state["stack"][-2] in ("tuv", "trans-unit"):
            state["side"] = Side()
            state["unit"]["sides"][state["lang"] if name == "seg" else name] = state["side"]
        elif state["side"] is not None:
            if name in TAGS:
                state["side"].open(name, attributes)
            if name in CODES:
                state["hidden"] += 1
                state["side"].empty_code.clear()

    def end(name):
        name = name.rsplit(":", 1)[-1].rsplit("}", 1)[-1]
        state["stack"].pop()
        if name in ("seg", "source", "target") and state["side"] is not None and not state["hidden"]:
            state["side"] = None
        elif state["side"] is not None:
            if name in CODES:
                state["hidden"] -= 1
            if name in TAGS:
                state["side"].close(name)
        elif name == "prop" and state["prop"] is not None:
            state["unit"]["document"] = "".join(state["prop"])
            state["prop"] = None
        elif name in ("tu", "trans-unit") and state["unit"] is not None:
            done.append(state["unit"] | {"header": state["header"], "pair": state["pair"]})
            state["unit"] = None

    def text(data):
        if state["side"] is not None:
            state["side"].add(data, state["hidden"] > 0)
        elif state["prop"] is not None:
            state["prop"].append(data)

    def refuse(*_):
        raise Rejected("entities and document types are refused")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.EntityDeclHandler = parser.StartDoctypeDeclHandler = parser.ExternalEntityRefHandler = refuse
    try:
        for at in range(0, len(data), 1 << 16):
            parser.Parse(data[at : at + (1 << 16)], False)
            yield from done
            done.clear()
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        raise Rejected(f"not well formed: {e}") from None
    yield from done


@contextlib.contextmanager
def open_word(data: bytes) -> Iterator[tuple[zipfile.ZipFile, list[str]]]:
    """A Word file whose members are few, small and named once, and its text parts in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = z.infolist()
        if len(members) > MOST_MEMBERS or sum(m.file_size for m in members) > MOST_EXPANDED or len({m.filename for m in members}) < len(members):
            raise Rejected("too many, too large or repeated members")
        if any(m.file_size > MOST_RATIO * max(1, m.compress_size) for m in members):
            raise Rejected("compressed too well")
        yield z, sorted(m.filename for m in members if re.fullmatch(r"word/[^/]*\.xml", m.filename))


def paragraphs(data: bytes) -> Iterator[str]:
    """Paragraphs of all Word parts, cut at tabs and breaks; deleted text is no text, text boxes stand alone."""
    with open_word(data) as (z, parts):
        for name in parts:
            yield from _paragraphs(z.read(name))


def _paragraphs(data: bytes) -> Iterator[str]:
    out: list[str] = []
    stack: list[list[str]] = []
    reading = [False]

    def start(name, _):
        name = name.rsplit(":", 1)[-1]
        if name == "p":
            stack.append([""])
        elif stack and name in ("tab", "br", "cr"):
            stack[-1].append("")
        reading[0] = name == "t"

    def end(name):
        name = name.rsplit(":", 1)[-1]
        reading[0] = False
        if name == "p" and stack:
            out.extend(t for t in stack.pop() if t.strip())

    def text(data):
        if reading[0] and stack:
            stack[-1][-1] += data

    def refuse(*_):
        raise Rejected("entities and document types are refused")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, text, refuse
    parser.Parse(data, True)
    yield from out


def rows_of(name: str, data: bytes) -> Iterator[dict]:
    """Segments of one file, numbered from 1; ids across files are given by ``read_files``."""
    kind = format_of(name, data)
    if kind == "doc":
        raise Rejected("old Word files are not read")
    if kind == "docx":
        for i, text in enumerate(paragraphs(data), 1):
            yield {"local_id": i, "original_id": str(i), "source": ("", "", "", "", []), "target": (text, text, text, text, []), "document_id": None, "pair": (None, None)}
        return
    i = 0
    languages: set = set()
    for unit in units(plain_bytes(data), kind):
        if kind == "tmx":
            languages |= unit["sides"].keys()
            source = unit["header"]
            if not source or source == "*all*":
                raise Rejected("no source language")
            if len(languages) > 2:
                raise Rejected("more than two languages")
            other = next((x for x in unit["sides"] if x != source), None)
            sides = unit["sides"].get(source), unit["sides"].get(other)
            pair = (source, other)
        else:
            sides, pair = (unit["sides"].get("source"), unit["sides"].get("target")), unit["pair"]
        i += 1
        shown = [(*x.texts(), x.tags) if x else ("", "", "", "", []) for x in sides]
        yield {"local_id": i, "original_id": unit["id"] or str(i), "source": shown[0], "target": shown[1], "document_id": unit["document"], "pair": pair}
    if not i:
        raise Rejected("no units")


def file_name(path: str, root: str) -> str:
    """A file's name in the results: its path below ``root``, as equal base names may lie in several folders."""
    below = root.rstrip("/") + "/"
    at = path.find(below)
    if at >= 0:
        return path[at + len(below) :]
    return path.rsplit("/", 1)[-1] if path.endswith(root) else path


def root_of(path: str) -> str:
    """The folder below which files are named: a pattern's last folder without signs."""
    return re.split(r"[*?\[{]", path, maxsplit=1)[0].rsplit("/", 1)[0] if re.search(r"[*?\[{]", path) else path


def _parser(root: str):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = file_name(path, root)
                made = []
                for r in rows_of(name, bytes(content)):
                    s, t = r["source"], r["target"]
                    made.append((name, r["local_id"], r["local_id"], r["original_id"], s[0], t[0], s[0], t[0], s[1], t[1], s[2], t[2], t[3], s[4], t[4], bool(s[4] or t[4]), r["document_id"]))
                    if len(made) >= 2000:
                        yield pd.DataFrame(made, columns=SEGMENT.names)
                        made = []
                if made:
                    yield pd.DataFrame(made, columns=SEGMENT.names)

    return parse


def offsets(rows: DataFrame) -> DataFrame:
    """(file, _offset): how many rows the files before it have, in order of names."""
    return sums_before(rows.groupBy("file").agg(F.count("*").alias("_n")))


def sums_before(counts: DataFrame) -> DataFrame:
    """(file, _offset) of (file, _n): the sum of _n over the files before, in order of names.

    Running sums within ranges of names, then over the ranges' totals: one task sees a range's files or one row a range.
    """
    counts = durable(counts.repartitionByRange("file").withColumn("_range", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_range").agg(F.sum("_n").alias("_total"))
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before.orderBy("_range")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(before.partitionBy("_range").orderBy("file")), F.lit(0))
    return counts.withColumn("_inside", inside).join(starts, "_range").select("file", (F.col("_start") + F.col("_inside")).alias("_offset"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all files below a path. ``id`` is the file's offset (in order of names) plus the local number."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(_parser(root_of(path)), SEGMENT)
    return rows.join(offsets(rows), "file").withColumn("id", F.col("local_id") + F.col("_offset")).select(*SEGMENT.names)


FILES = "file string, format string, source_lang string, target_lang string, units long, error string"


def inspected(contents: DataFrame) -> DataFrame:
    """Files (file, content) looked through before a run: format, languages, number of units, or why a file is not read."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for name, content in zip(batch["file"], batch["content"]):
                data = bytes(content)
                kind, pair, n, error = format_of(name, data), (None, None), 0, None
                try:
                    for row in rows_of(name, data):
                        n += 1
                        pair = tuple(new or old for new, old in zip(row["pair"], pair))
                except (Rejected, expat.ExpatError, zipfile.BadZipFile, UnicodeDecodeError) as e:
                    error, n, pair = str(e), 0, (None, None)
                made.append((name, kind, *pair, n, error))
            # a frame for each small file would cost more than the file
            yield pd.DataFrame(made, columns=["file", "format", "source_lang", "target_lang", "units", "error"])

    return contents.select("file", "content").mapInPandas(look, FILES)


def checked(files: DataFrame) -> DataFrame:
    """The files of one run (``inspected``) with the offset of their ids: all readable, of one pair of languages, Word files by themselves.

    Otherwise an error that names a file; only the distinct pairs, two at most, come to the driver.
    """
    files = durable(files)
    broken = files.where("error is not null").orderBy("file").first()
    if broken:
        raise Rejected(f"{broken['file']}: {broken['error']}")
    word = F.col("format") == "docx"
    kinds = files.groupBy(word.alias("word"), F.when(~word, F.lower("source_lang")).alias("s"), F.when(~word, F.lower("target_lang")).alias("t")).agg(F.min("file").alias("file")).orderBy("file").limit(2).collect()
    if len(kinds) == 2:
        raise Rejected(f"{kinds[0]['file']} and {kinds[1]['file']} are of different languages or kinds")
    counts = files.groupBy("file").agg(F.sum("units").alias("_n"))
    return files.join(sums_before(counts).withColumnRenamed("_offset", "offset"), "file").drop("error")


def write_tmx(segments: list[tuple[str, str, str | None]], source: str, target: str) -> bytes:
    """A TMX file of (source, target, document id) rows."""
    from xml.sax.saxutils import escape, quoteattr

    out = [f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header srclang={quoteattr(source)} adminlang="en" datatype="plaintext" segtype="sentence" o-tmf="none" creationtool="none" creationtoolversion="1"/><body>']
    for s, t, document in segments:
        prop = f'<prop type="x-document">{escape(document)}</prop>' if document else ""
        out.append(f"<tu>{prop}<tuv xml:lang={quoteattr(source)}><seg>{escape(s)}</seg></tuv><tuv xml:lang={quoteattr(target)}><seg>{escape(t)}</seg></tuv></tu>")
    return ("\n".join(out) + "\n</body></tmx>\n").encode()
