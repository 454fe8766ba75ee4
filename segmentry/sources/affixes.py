"""Affix dictionaries (the public .aff and .dic formats): which written words are forms of which stems.

The rules are parsed once into two tries, suffixes read from the end of a word and prefixes from its beginning, so that
all rules that a word can have been made by are met in one walk, with their conditions. ``Affixes.analyses`` names the
candidate stems with the flags that their entries need; ``known_forms`` explodes these candidates for the distinct words of
a corpus and joins them with the entries, so nothing is ever generated that no text holds. ``all_forms`` explodes the
entries instead, for a lexicon by itself.

Covered: flags of one sign, two signs, numbers and UTF-8, flag aliases, conditions, stripping, cross products, second
suffixes and suffixes on prefixes by continuation flags, circumfixes, words and affixes that need an affix, forbidden words,
words that keep their case. Not covered: compounds, replacement tables, and morphology beyond the stem.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the largest file that is read.
MOST_BYTES = 64 << 20
ENTRY = "word string, flags array<string>"


@dataclass(frozen=True)
class Rule:
    flag: str
    cross: bool
    strip: str
    add: str
    condition: tuple[tuple[bool, frozenset[str]], ...]
    more: frozenset[str]

    def meets(self, stem: str, suffix: bool) -> bool:
        n = len(self.condition)
        part = stem[len(stem) - n :] if suffix else stem[:n]
        return len(stem) >= n and all((c in signs) != negated for c, (negated, signs) in zip(part, self.condition))


def condition_of(text: str) -> tuple[tuple[bool, frozenset[str]], ...]:
    """One (negated, signs) for each place; a dot is any sign."""
    if text == ".":
        return ()
    return tuple((inside[:1] == "^", frozenset(inside.removeprefix("^"))) if inside or single == "" else (single == ".", frozenset() if single == "." else frozenset(single))
                 for inside, single in re.findall(r"\[([^\]]*)\]|(.)", text))


class Trie:
    """Rules by what they add, read from the word's end (suffixes) or beginning."""

    def __init__(self, suffix: bool):
        self.suffix, self.root = suffix, {}

    def add(self, rule: Rule) -> None:
        node = self.root
        for c in reversed(rule.add) if self.suffix else rule.add:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(rule)

    def stems(self, word: str, full: bool) -> Iterator[tuple[str, Rule]]:
        """(stem, rule) of every rule that makes ``word`` of a stem that meets its condition."""
        node, n = self.root, 0
        while True:
            for rule in node.get("", ()):
                rest = word[: len(word) - n] if self.suffix else word[n:]
                if rest or full and rule.strip:
                    stem = rest + rule.strip if self.suffix else rule.strip + rest
                    if rule.meets(stem, self.suffix):
                        yield stem, rule
            if n == len(word):
                return
            node = node.get(word[-1 - n] if self.suffix else word[n])
            if node is None:
                return
            n += 1


@dataclass
class Affixes:
    encoding: str = "ISO8859-1"
    flags: str = "short"
    aliases: list[frozenset[str]] = field(default_factory=list)
    special: dict[str, str] = field(default_factory=dict)
    full: bool = False
    suffixes: Trie = field(default_factory=lambda: Trie(True))
    prefixes: Trie = field(default_factory=lambda: Trie(False))
    rules: dict[str, list[tuple[bool, Rule]]] = field(default_factory=dict)

    def flags_of(self, text: str) -> frozenset[str]:
        if self.aliases and text.isdigit():
            return self.aliases[int(text) - 1]
        if self.flags == "long":
            return frozenset(text[i : i + 2] for i in range(0, len(text), 2))
        return frozenset(filter(None, text.split(","))) if self.flags == "num" else frozenset(text)

    def has(self, name: str, flags) -> bool:
        return self.special.get(name) in flags if name in self.special else False

    def analyses(self, word: str) -> set[tuple[str, tuple[str, ...], bool]]:
        """(stem, flags that its entry must have, whether an affix was taken off) of every way to read ``word``."""
        found: set[tuple[str, tuple[str, ...], bool]] = {(word, (), False)}

        def add(stem: str, outer: Rule | None, *rules: Rule) -> None:
            """``rules`` hang on the stem itself; ``outer`` hangs on one of them by its continuation flags."""
            around = [r for r in (*rules, *((outer,) if outer else ())) if self.has("CIRCUMFIX", r.more)]
            if around and len(around) < 2:
                return
            found.add((stem, tuple(sorted({r.flag for r in rules})), True))

        complete = lambda r: not self.has("NEEDAFFIX", r.more)
        for stem, s in self.suffixes.stems(word, self.full):
            if complete(s):
                add(stem, None, s)
            for inner, first in self.suffixes.stems(stem, self.full):
                if s.flag in first.more and complete(s):
                    add(inner, s, first)
        for rest, p in self.prefixes.stems(word, self.full):
            if complete(p):
                add(rest, None, p)
            for stem, s in self.suffixes.stems(rest, self.full):
                if not (complete(p) or complete(s)):
                    continue
                if p.cross and s.cross:
                    add(stem, None, p, s)
                if p.flag in s.more:
                    add(stem, p, s)
                if s.flag in p.more:
                    add(stem, s, p)
                for inner, first in self.suffixes.stems(stem, self.full):
                    if s.flag in first.more and complete(s) and p.cross and first.cross:
                        add(inner, s, p, first)
        return found

    def forms(self, word: str, flags: frozenset[str]) -> set[str]:
        """All written forms of one entry."""
        if self.has("FORBIDDENWORD", flags):
            return set()
        out = set() if self.has("NEEDAFFIX", flags) else {word}
        around = lambda r: self.has("CIRCUMFIX", r.more)
        complete = lambda r: not self.has("NEEDAFFIX", r.more)

        def made(base: str, names, suffix: bool) -> Iterator[tuple[str, Rule]]:
            for name in names:
                for is_suffix, r in self.rules.get(name, ()):
                    fits = base.endswith(r.strip) if is_suffix else base.startswith(r.strip)
                    if is_suffix == suffix and fits and (self.full or len(base) > len(r.strip)) and r.meets(base, suffix):
                        yield (base[: len(base) - len(r.strip)] + r.add if suffix else r.add + base[len(r.strip) :]), r

        for one, s in made(word, flags, True):
            if complete(s) and not around(s):
                out.add(one)
            for two, second in made(one, s.more, True):
                if complete(second) and around(s) == around(second):
                    out.add(two)
                if s.cross and complete(second):
                    out |= {three for three, p in made(two, flags, False) if p.cross and sum(map(around, (s, second, p))) != 1}
            for two, p in made(one, flags | s.more, False):
                if (complete(s) or complete(p)) and around(s) == around(p) and (p.flag in s.more or p.cross and s.cross):
                    out.add(two)
        for one, p in made(word, flags, False):
            if complete(p) and not around(p):
                out.add(one)
            for two, s in made(one, p.more, True):
                if (complete(s) or complete(p)) and around(s) == around(p):
                    out.add(two)
        return out


def parse_affixes(data: bytes) -> Affixes:
    """Rules of an .aff file; the encoding is the one that it names."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    if len(data) > MOST_BYTES:
        raise ValueError("larger than 64 MiB")
    named = re.search(rb"^SET\s+(\S+)", data, re.M)
    out = Affixes(encoding=named[1].decode() if named else "ISO8859-1")
    heads: dict[tuple[str, str], bool] = {}
    left: dict[tuple[str, str], int] = {}
    aliases = None
    for number, line in enumerate(data.decode(out.encoding).splitlines(), 1):
        cells = line.split()
        if not cells or cells[0].startswith("#"):
            continue
        name = cells[0]
        if name == "FLAG":
            out.flags = {"long": "long", "num": "num"}.get(cells[1], "short")
        elif name == "FULLSTRIP":
            out.full = True
        elif name == "AF":
            if aliases is None:
                aliases = int(cells[1])
            else:
                given, out.aliases = out.aliases, []
                out.aliases = [*given, out.flags_of(cells[1])]
        elif name in ("NEEDAFFIX", "FORBIDDENWORD", "KEEPCASE", "CIRCUMFIX", "ONLYINCOMPOUND"):
            out.special[name] = next(iter(out.flags_of(cells[1])))
        elif name in ("PFX", "SFX"):
            key = (name, cells[1])
            if not left.get(key):
                if len(cells) < 4 or cells[2] not in "YN" or not cells[3].isdigit():
                    raise ValueError(f"line {number}: no head of rules: {line}")
                heads[key], left[key] = cells[2] == "Y", int(cells[3])
                continue
            left[key] -= 1
            added, _, more = cells[3].partition("/")
            rule = Rule(cells[1], heads[key], "" if cells[2] == "0" else cells[2], "" if added == "0" else added, condition_of(cells[4] if len(cells) > 4 else "."), out.flags_of(more) if more else frozenset())
            out.rules.setdefault(rule.flag, []).append((name == "SFX", rule))
            (out.suffixes if name == "SFX" else out.prefixes).add(rule)
    return out


def entry_of(line: str, affixes: Affixes) -> tuple[str, list[str]] | None:
    """(word, flags) of a line of a .dic file; morphology after white space is left out."""
    line = line.split("\t")[0].strip()
    line = re.sub(r"\s+[a-z]{2}:.*$", "", line)
    if not line or line.startswith("#"):
        return None
    parts = re.split(r"(?<!\\)/", line, maxsplit=1)
    word = parts[0].replace("\\/", "/")
    return (word, sorted(affixes.flags_of(parts[1].strip()))) if word and len(parts) > 1 else ((word, []) if word else None)


def read_entries(spark: SparkSession, path: str, affixes: Affixes) -> DataFrame:
    """(word, flags) of a .dic file, in the encoding of its .aff file; the first line is a count."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                if len(content) > MOST_BYTES:
                    raise ValueError("larger than 64 MiB")
                lines = bytes(content).removeprefix(b"\xef\xbb\xbf").decode(affixes.encoding).splitlines()
                if not lines or not lines[0].strip().split()[0:1] or not lines[0].split()[0].isdigit():
                    raise ValueError("no count in the first line of the dictionary")
                for i in range(1, len(lines), 20_000):
                    made = [e for e in (entry_of(x, affixes) for x in lines[i : i + 20_000]) if e]
                    yield pd.DataFrame(made, columns=["word", "flags"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, ENTRY)


def all_forms(entries: DataFrame, affixes: Affixes) -> DataFrame:
    """(form, stem) of all forms of all entries, distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(form, w) for w, flags in zip(batch["word"], batch["flags"]) for form in affixes.forms(w, frozenset(flags))]
            yield pd.DataFrame(rows, columns=["form", "stem"])

    return entries.mapInPandas(run, "form string, stem string").distinct()


def known_forms(words: DataFrame, entries: DataFrame, affixes: Affixes, column: str = "word") -> DataFrame:
    """(form, stem) for those of the given words that the dictionary knows, as they are written.

    A word in capitals may stand for a word in small letters or with one capital, one with a capital for one in small
    letters; entries that keep their case are met as they are only. Curly apostrophes count as straight ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word in batch["_word"]:
                plain = re.sub("[‘’ʼ]", "'", word)
                variants = {plain: True, plain.lower(): plain.islower()} | ({plain.capitalize(): False} if plain.isupper() else {})
                variants[plain] = True
                rows += [(word, stem, list(need), affix, same) for v, same in variants.items() for stem, need, affix in affixes.analyses(v)]
            yield pd.DataFrame(rows, columns=["form", "stem", "need", "affix", "same"])

    distinct = words.select(F.col(column).alias("_word")).where("_word is not null").distinct()
    tried = distinct.mapInPandas(run, "form string, stem string, need array<string>, affix boolean, same boolean")
    flag = lambda name: F.array_contains("flags", affixes.special[name]) if name in affixes.special else F.lit(False)
    own = entries.where(~flag("FORBIDDENWORD") & ~flag("ONLYINCOMPOUND")).select(F.col("word").alias("stem"), "flags")
    met = tried.join(own, "stem").where((F.size(F.array_except("need", "flags")) == 0) & (F.col("affix") | ~flag("NEEDAFFIX")) & (F.col("same") | ~flag("KEEPCASE")))
    found = met.select("form", "stem").distinct()
    if "FORBIDDENWORD" in affixes.special:
        forbidden = entries.where(flag("FORBIDDENWORD")).select(F.col("word").alias("form"))
        found = found.join(forbidden.distinct(), "form", "left_anti")
    return found
