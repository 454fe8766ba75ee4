"""Changed texts put back into the files that they came from, everything else byte for byte as it was.

A file is scanned once by a pull parser that tells at which byte each tag and text begins. Changes are then splices: pairs
of byte places with new bytes. Two kinds are made:

* ``corrected``: the whole target of a unit becomes a plain text (edits by hand). Targets with codes are refused, missing
  targets are made, ``<target/>`` is opened.
* ``rewritten``: source and target get new visible texts, spread over the text nodes that are there: equal stretches stay
  in their node, what replaces or is put in goes to the node where it begins, and codes do not move. If the nodes do not
  spell the new text afterwards, the file is refused. In DOCX files the nodes are the ``w:t`` of a paragraph's stretch.

Files and changes meet by a join on the file's name, one file a row, so neither passes the driver. Files that cannot
be changed come back with ``error`` and without content.
"""

from __future__ import annotations

import bisect
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import edits as edits_of
from .bilingual import CODES, Rejected, file_name, format_of, open_word, plain_bytes, root_of

#: Fixed value: the longest text that is rewritten.
MOST_CHARS = 200_000
FILES = "file string, name string, content binary, changed long, error string"


@dataclass
class Node:
    """A stretch of character data between two tags: its bytes, and what it spells."""

    begin: int
    end: int = -1
    text: str = ""
    tag: str = ""


@dataclass
class Side:
    """An element with a language's text: start tag, content, visible nodes, and whether it has children."""

    tag: tuple[int, int]
    empty: bool = False
    content_end: int = -1
    end: int = -1
    children: int = 0
    nodes: list[Node] = field(default_factory=list)

    def visible(self) -> str:
        return "".join(n.text for n in self.nodes)


@dataclass
class Unit:
    number: int
    sides: dict[str | None, Side] = field(default_factory=dict)
    end: int = -1
    prefix: str = ""


class Scan:
    """Byte places of a bilingual file's units. ``at`` is called with each event's first byte, which also ends what was before it."""

    def __init__(self, data: bytes, kind: str, wanted: Iterable[int] | None = None):
        self.data, self.kind = data, kind
        self.wanted = None if wanted is None else set(wanted)
        self.units: dict[int, Unit] = {}
        self.languages: dict[str | None, None] = {}
        self.source: str | None = None
        self.count = 0
        self._ends: Callable[[int], None] | None = None
        self._stack: list[str] = []
        self._unit: Unit | None = None
        self._side: Side | None = None
        self._depth = self._hidden = 0
        self._node: Node | None = None
        self._lang: str | None = None
        p = self._parser = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.CommentHandler = p.ProcessingInstructionHandler = self._child
        p.StartCdataSectionHandler = p.EndCdataSectionHandler = lambda: self._at()
        p.DefaultHandler = lambda _: self._at()
        p.EntityDeclHandler = p.StartDoctypeDeclHandler = p.ExternalEntityRefHandler = self._refuse
        try:
            p.Parse(data, True)
        except expat.ExpatError as e:
            raise Rejected(f"not well formed: {e}") from None
        if self._ends:
            self._ends(len(data))

    @staticmethod
    def _refuse(*_):
        raise Rejected("entities and document types are refused")

    def _at(self) -> int:
        at = self._parser.CurrentByteIndex
        if self._ends:
            ends, self._ends = self._ends, None
            ends(at)
        return at

    def _close_node(self, at: int) -> None:
        if self._node is not None:
            self._node.end = at
            self._node = None

    def _child(self, *_):
        at = self._at()
        self._close_node(at)
        if self._side is not None:
            self._side.children += 1

    def _start(self, name: str, attributes: dict) -> None:
        at = self._at()
        self._close_node(at)
        prefix, _, local = name.rpartition(":")
        self._stack.append(local)
        if self._side is not None:
            self._side.children += 1
            self._depth += 1
            self._hidden += local in CODES
        elif local == "header":
            self.source = attributes.get("srclang")
        elif local in ("tu", "trans-unit"):
            self.count += 1
            self._unit = Unit(self.count, prefix=prefix and prefix + ":")
        elif self._unit is not None and local == "tuv":
            self._lang = next((v for k, v in attributes.items() if k.rpartition(":")[2] == "lang"), None)
            self.languages.setdefault(self._lang)
        elif self._unit is not None and local in ("seg", "source", "target") and self._stack[-2:-1] in (["tuv"], ["trans-unit"]):
            side = self._side = Side((at, -1))
            if (key := self._lang if local == "seg" else local) in self._unit.sides:
                raise Rejected("a language twice in one unit")
            self._unit.sides[key] = side
            self._depth = self._hidden = 0

            def opened(end: int) -> None:
                side.tag = (at, end)

            self._ends = opened

    def _end(self, name: str) -> None:
        at = self._at()
        self._close_node(at)
        local = self._stack.pop()
        side = self._side
        if side is not None and not self._depth:
            side.empty, side.content_end = self.data[side.tag[0] : side.tag[1]].endswith(b"/>"), at

            def closed(end: int) -> None:
                side.end = end

            self._ends = closed
            self._side = None
        elif side is not None:
            self._depth -= 1
            self._hidden -= local in CODES
        elif local in ("tu", "trans-unit") and self._unit is not None:
            self._unit.end = at
            if self.wanted is None or self._unit.number in self.wanted:
                self.units[self._unit.number] = self._unit
            self._unit = None

    def _text(self, data: str) -> None:
        at = self._at()
        if self._side is None or self._hidden:
            return
        if self._node is None:
            # a CDATA section's own mark belongs to the text
            begin = at - 9 if self.data[at - 9 : at] == b"<![CDATA[" else at
            self._node = Node(begin)
            self._side.nodes.append(self._node)
        self._node.text += data

    def target(self, unit: Unit) -> tuple[str | None, Side | None]:
        if self.kind == "xliff":
            return "target", unit.sides.get("target")
        if not self.source or self.source == "*all*":
            raise Rejected("no source language")
        others = [x for x in self.languages if x != self.source]
        if len(others) != 1:
            raise Rejected("not exactly two languages")
        return others[0], unit.sides.get(others[0])

    def side(self, unit: Unit, which: str) -> Side | None:
        if which == "target":
            return self.target(unit)[1]
        return unit.sides.get("source" if self.kind == "xliff" else self.source)


def _ascii_only(data: bytes) -> bool:
    declared = re.match(rb"<\?xml[^>]*?encoding=[\"']([A-Za-z0-9._-]+)[\"']", data)
    return declared is not None and declared[1].lower() not in (b"utf-8", b"utf8")


def escaped(text: str, ascii_only: bool = False) -> bytes:
    """Character data; signs that XML cannot hold are refused, a return is written as a reference."""
    if re.search("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", text):
        raise Rejected("a text with signs that XML cannot hold")
    made = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
    return made.encode("ascii", "xmlcharrefreplace") if ascii_only else made.encode()


def spliced(data: bytes, splices: Iterable[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    view = memoryview(data)
    for begin, end, new in sorted(splices):
        if begin < at:
            raise Rejected("changes overlap")
        out += [view[at:begin], new]
        at = end
    return b"".join([*out, view[at:]])


def correct_bytes(data: bytes, kind: str, edits: dict[int, str]) -> bytes:
    """The file with the targets of these units (numbers from 1) replaced by plain texts."""
    data = plain_bytes(data)
    scan, ascii_only, splices = Scan(data, kind, edits), _ascii_only(data), []
    for number, text in edits.items():
        unit = scan.units.get(number)
        if unit is None:
            raise Rejected(f"no unit {number}")
        lang, side = scan.target(unit)
        new = escaped(text or "", ascii_only)
        if side is None and kind == "tmx":
            name = f'"{escaped(lang or "", ascii_only).decode().replace(chr(34), "&quot;")}"'.encode()
            p = unit.prefix.encode()
            splices.append((unit.end, unit.end, b"<%stuv xml:lang=%s><%sseg>%s</%sseg></%stuv>" % (p, name, p, new, p, p)))
        elif side is None:
            source = unit.sides.get("source")
            at, p = (source.end if source else unit.end), unit.prefix.encode()
            splices.append((at, at, b"<%starget>%s</%starget>" % (p, new, p)))
        elif side.children:
            raise Rejected(f"unit {number}: the target has codes")
        elif side.empty:
            tag = data[side.tag[0] : side.tag[1]]
            name = re.match(rb"<([^\s/>]+)", tag)[1]
            splices.append((*side.tag, tag.rstrip(b">").rstrip().rstrip(b"/").rstrip() + b">" + new + b"</" + name + b">"))
        else:
            splices.append((side.tag[1], side.content_end, new))
    return spliced(data, splices)


def spread(old: list[str], new: str) -> list[str]:
    """New texts of the nodes whose texts are ``old``, which together spell ``new``."""
    whole = "".join(old)
    if len(whole) > MOST_CHARS or len(new) > MOST_CHARS:
        raise Rejected("a text is too long to be rewritten")
    if whole == new:
        return list(old)
    starts = [sum(map(len, old[:k])) for k in range(len(old))] if len(old) < 50 else None
    if starts is None:
        starts, at = [], 0
        for t in old:
            starts.append(at)
            at += len(t)
    made: list[list[str]] = [[] for _ in old]
    for equal, i1, i2, j1, j2 in edits_of(whole, new, popular=False):
        if not equal:
            made[max(0, bisect.bisect_right(starts, i1) - 1)].append(new[j1:j2])
            continue
        k = bisect.bisect_right(starts, i1) - 1
        while i1 < i2:
            stop = min(i2, starts[k + 1] if k + 1 < len(starts) else i2)
            made[k].append(new[j1 : j1 + stop - i1])
            j1, i1, k = j1 + stop - i1, stop, k + 1
    out = ["".join(parts) for parts in made]
    if "".join(out) != new:
        raise Rejected("the nodes do not spell the new text")
    return out


def _node_splices(nodes: list[Node], new: str, ascii_only: bool) -> Iterator[tuple[int, int, bytes]]:
    for node, text in zip(nodes, spread([n.text for n in nodes], new)):
        if text != node.text:
            yield node.begin, node.end, escaped(text, ascii_only)


def rewrite_bytes(data: bytes, kind: str, texts: dict[int, tuple[str | None, str | None]]) -> bytes:
    """The file with new visible texts (source, target; null: as it is) of these units, codes where they were."""
    if kind == "docx":
        return rewrite_word(data, {n: t for n, (_, t) in texts.items()})
    data = plain_bytes(data)
    scan, ascii_only, splices = Scan(data, kind, texts), _ascii_only(data), []
    for number, pair in texts.items():
        unit = scan.units.get(number)
        if unit is None:
            raise Rejected(f"no unit {number}")
        for which, new in zip(("source", "target"), pair):
            if new is None:
                continue
            side = scan.side(unit, which)
            if side is not None and side.nodes:
                splices += _node_splices(side.nodes, new, ascii_only)
            elif new:
                raise Rejected(f"unit {number}: no text to rewrite")
    return spliced(data, splices)


class WordScan:
    """The ``w:t`` nodes of a Word part's stretches, in the order in which ``bilingual.paragraphs`` gives them."""

    def __init__(self, data: bytes):
        self.data, self.stretches = data, []
        self._stack: list[list[list[Node]]] = []
        self._node: Node | None = None
        p = self._parser = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.StartDoctypeDeclHandler = Scan._refuse
        p.DefaultHandler = p.CommentHandler = lambda _: self._at()
        self._ends: Callable[[int], None] | None = None
        p.Parse(data, True)

    def _at(self) -> int:
        at = self._parser.CurrentByteIndex
        if self._ends:
            ends, self._ends = self._ends, None
            ends(at)
        return at

    def _start(self, name: str, _) -> None:
        at = self._at()
        local = name.rsplit(":", 1)[-1]
        if local == "p":
            self._stack.append([[]])
        elif self._stack and local in ("tab", "br", "cr"):
            self._stack[-1].append([])
        self._node = None
        if local == "t" and self._stack:
            node = self._node = Node(-1, tag=f"{at}")
            self._stack[-1][-1].append(node)

            def opened(end: int) -> None:
                node.begin = end

            self._ends = opened

    def _end(self, name: str) -> None:
        at = self._at()
        if self._node is not None:
            self._node.end = at
            self._node = None
        if name.rsplit(":", 1)[-1] == "p" and self._stack:
            self.stretches += [nodes for nodes in self._stack.pop() if "".join(n.text for n in nodes).strip()]

    def _text(self, data: str) -> None:
        self._at()
        if self._node is not None:
            self._node.text += data

    def splices(self, nodes: list[Node], new: str) -> Iterator[tuple[int, int, bytes]]:
        """Texts with outer white space ask for it to be kept."""
        nodes = [n for n in nodes if n.text]
        for node, text in zip(nodes, spread([n.text for n in nodes], new)):
            if text == node.text:
                continue
            begin = int(node.tag)
            tag = self.data[begin : node.begin]
            if text != text.strip() and b"xml:space" not in tag:
                tag = tag[:-1] + b' xml:space="preserve">'
            yield begin, node.end, tag + escaped(text)


def rewrite_word(data: bytes, texts: dict[int, str | None]) -> bytes:
    """A DOCX file with new texts of these stretches (numbers from 1); members without changes keep their bytes."""
    out, left, number = io.BytesIO(), {n: t for n, t in texts.items() if t is not None}, 0
    with open_word(data) as (z, parts), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        changed: dict[str, bytes] = {}
        for name in parts:
            part = z.read(name)
            scan, splices = WordScan(part), []
            for nodes in scan.stretches:
                number += 1
                if number in left:
                    splices += scan.splices(nodes, left.pop(number))
            if splices:
                changed[name] = spliced(part, splices)
        if left:
            raise Rejected(f"no stretch {min(left)}")
        for member in z.infolist():
            made.writestr(member, changed.get(member.filename, z.read(member.filename)))
    return out.getvalue()


#: Files that a task turns into Python's objects at once.
FILES_AT_ONCE = 200


def _changed_files(files: DataFrame, changes: DataFrame, change: Callable[[bytes, str, list[dict]], bytes], prefix: str) -> DataFrame:
    """One row for each file that changes name: content, or why it has none. A file's changes are joined to it as one array."""

    def changed(file: str, content: bytes | None, rows: list[dict]) -> tuple:
        if content is None:
            return file, None, None, 0, "no such file"
        folder, _, base = file.rpartition("/")
        name = f"{folder}/{prefix}{base}" if folder else prefix + base
        try:
            return file, name, change(content, format_of(file, content), rows), len(rows), None
        except (Rejected, expat.ExpatError, zipfile.BadZipFile, UnicodeDecodeError) as e:
            return file, name, None, 0, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
        for batch in batches:
            for i in range(0, batch.num_rows, FILES_AT_ONCE):
                made = []
                for file, content, rows in zip(*(c.to_pylist() for c in batch.slice(i, FILES_AT_ONCE).columns)):
                    # rows come in the order of their files: of several files of one name the first counts
                    if file != last:
                        made.append(changed(file, content, rows))
                    last = file
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], names=["file", "name", "content", "changed", "error"])

    named = changes.where("file is not null")
    own = named.groupBy("file").agg(F.collect_list(F.struct(*[c for c in named.columns if c != "file"])).alias("rows"))
    return own.join(files.select("file", "content").hint("merge"), "file", "left").select("file", "content", "rows").mapInArrow(run, FILES)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """file (named as ``read_files`` names it) and content of all files below a path."""
    root = root_of(path)
    named = F.udf(lambda p: file_name(p, root), "string")
    return spark.read.format("binaryFile").load(path).select(named("path").alias("file"), "content")


def corrected(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files (file, content) with edits (file, local_id, text): file, name, content, changed, error; files without edits give no row.

    Equal local numbers twice in a file, with different texts, are an error of that file; a null text empties the target.
    """

    def change(content: bytes, kind: str, rows: list[dict]) -> bytes:
        if kind not in ("tmx", "xliff"):
            raise Rejected("only bilingual XML can be edited")
        wanted = {r["local_id"]: r["text"] for r in rows}
        if len({(r["local_id"], r["text"]) for r in rows}) > len(wanted):
            raise Rejected("two edits of one unit")
        return correct_bytes(content, kind, wanted)

    return _changed_files(files, edits.select("file", F.col("local_id").cast("long").alias("local_id"), F.coalesce("text", F.lit("")).alias("text")), change, "Corrected_")


def rewritten(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Files (file, content) with new visible texts (file, local_id, source_text, target_text; null: as it is), as ``corrected``."""

    def change(content: bytes, kind: str, rows: list[dict]) -> bytes:
        # both sides travel as one array, since a null text means something else than none
        return rewrite_bytes(content, kind, {r["local_id"]: tuple(r["pair"]) for r in rows})

    pairs = texts.select("file", F.col("local_id").cast("long").alias("local_id"), F.array("source_text", "target_text").alias("pair"))
    return _changed_files(files, pairs, change, "Redacted_")
