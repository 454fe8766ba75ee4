"""Small user inputs: term lists, glossaries, confusable groups and pattern files, parsed on the driver."""

from __future__ import annotations

import csv
import io
import unicodedata
from collections.abc import Iterable

import regex

from .xlsx import read_rows


def decoded(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16")
    else:
        text = data.decode("utf-8-sig")
    if "\0" in text:
        raise ValueError("not a text file")
    return text


def term_list(data: bytes) -> list[str]:
    """Distinct lines in order."""
    return list(dict.fromkeys(line.strip() for line in decoded(data).splitlines() if line.strip()))


def forbidden_terms(text: str) -> list[str]:
    """Distinct lines without regard to case, the first writing of each."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        if line.strip():
            found.setdefault(line.strip().lower(), line.strip())
    return list(found.values())


def glossary(data: bytes) -> list[tuple[str, str, str | None]]:
    """Rows of source, target and note, separated by tab, comma, semicolon or two blanks, or of a workbook's first sheet; a heading line is left out."""
    if data[:4] == b"PK\x03\x04":
        return _glossary_rows(read_rows(data))
    text = decoded(data)
    sign = max("\t;,", key=text.count)
    lines = ([p for p in line.replace("  ", "\t").split("\t") if p.strip()] for line in text.splitlines()) if not text.count(sign) else csv.reader(io.StringIO(text), delimiter=sign)
    return _glossary_rows(lines)


def _glossary_rows(lines: Iterable[list[str]]) -> list[tuple[str, str, str | None]]:
    rows, seen = [], set()
    for cells in lines:
        cells = [c.strip() for c in cells]
        if len(cells) < 2 or not cells[0] or not cells[1] or (not rows and cells[0].lower() in ("source", "origen", "term")):
            continue
        key = (cells[0].casefold(), cells[1].casefold())
        if key not in seen:
            seen.add(key)
            rows.append((cells[0], cells[1], cells[2] if len(cells) > 2 and cells[2] else None))
    return rows


def confusable_groups(text: str | bytes) -> list[list[str]]:
    """Lines of members between | or /; at least two members, no set twice; or a workbook's rows. A member of more than 500 characters and more than 10,000 groups are errors."""
    if isinstance(text, str) and len(text) > 2_000_000:
        raise ValueError("too long")
    out, seen = [], set()
    for line in [line.replace("/", "|").split("|") for line in text.splitlines()] if isinstance(text, str) else read_rows(text):
        members = list({m.casefold(): m for m in reversed([m.strip() for m in line if m.strip()])}.values())[::-1]
        if any(len(m) > 500 for m in members):
            raise ValueError("a member of more than 500 characters")
        key = frozenset(m.casefold() for m in members)
        if len(members) >= 2 and key not in seen:
            seen.add(key)
            out.append(members)
    if len(out) > 10_000:
        raise ValueError("more than 10,000 groups")
    return out


def patterns(text: str, case_sensitive: bool = False) -> tuple[list[tuple[None, str]], list[str]]:
    """One pattern a line, # begins a comment: (rules, errors)."""
    rules, errors = [], []
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        pattern = line.strip() if case_sensitive else f"(?i){line.strip()}"
        try:
            regex.compile(pattern)
            rules.append((None, pattern))
        except regex.error as e:
            errors.append(f"line {number}: {e}")
    return rules, errors


def _key(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name.strip().lower()) if not unicodedata.combining(c))


def pattern_table(data: bytes) -> tuple[list[tuple[str | None, str]], list[tuple[str, str]]]:
    """(forbidden, required) rules of a table with columns type, source, target and description, in English or Spanish."""
    text = decoded(data)
    head = text.splitlines()[0] if text else ""
    rows = list(csv.reader(io.StringIO(text), delimiter=max(";,\t", key=head.count)))
    forbidden, required = [], []
    for cells in rows[1:]:
        kind, source, target = (c.strip() for c in (cells + [""] * 3)[:3])
        kind = _key(kind)
        for p in filter(None, (source, target)):
            regex.compile(p)
        if kind in ("prohibido", "forbidden") and target:
            forbidden.append((source or None, target))
        elif kind in ("obligatorio", "required") and source and target:
            required.append((source, target))
        elif kind:
            raise ValueError(f"a row that is no rule: {cells}")
    return forbidden, required
