"""Redaction in ordered layers: each stage rewrites what the stage before left.

The formats are fixed values (``formats``). The hundred patterns of a run go over a text in one pass of Arrow batches, where
they were measured to be fastest; short chains are ``regexp_replace`` expressions. Terms that a document's rows reveal are gathered by document (distinct, summed) and applied
to all its rows in a second pass; unlike a sequential run, a row does not depend on the order of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.term_positions import WESTERN, Terms, replaced
from ..functions.text import SPACE, whole
from ..plans.durable import spread
from . import formats
from .dedup import TOKEN, consolidated

B0, B1 = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"


def word(pattern: str) -> str:
    return f"{B0}(?:{pattern}){B1}"


def java(pattern: str, any_case: bool) -> str:
    """For Spark's matcher: white space, digits and word signs as in Unicode, said one by one, as the flag for all of them slows every border down."""
    for short, full in (("\\s", "\\p{IsWhite_Space}"), ("\\d", "\\p{Nd}"), ("\\w", "[\\p{L}\\p{N}_]")):
        pattern = pattern.replace(short, full)
    return ("(?iu)" if any_case else "") + pattern


EMAIL, URL = java(formats.SAFE["identifiers"]["email"], True), java(formats.SAFE["identifiers"]["url"], True)
LAYERS: dict[str, list[str]] = {
    group: [java(p, group in formats.ANY_CASE) for p in own.values()] for group, own in formats.SAFE.items()
} | {"email": [EMAIL], "url": [URL, java(formats.SAFE["identifiers"]["domain"], True), java(formats.SAFE["identifiers"]["ip"], True)]}
CLINICAL = [java(p, True) for p in formats.CLINICAL.values()] + [java(p, False) for p in formats.CODES.values()]
HOSPITALS = [java(p, False) for p in formats.HOSPITALS.values()]
AUDIT = {kind: java(p, True) for kind, p in formats.CRITICAL.items()}


@dataclass
class Layers:
    safe: bool = True
    clinical: bool = False
    names: bool = False
    token: str = TOKEN
    dictionary: Sequence[str] = ()
    whitelist: Sequence[str] = ()
    #: Whether, without the safe layers, an address that holds a dictionary term goes as a whole; else the term alone does.
    whole_addresses: bool = True
    #: Words in capitals that are no identifiers, and lists of first and last names (lower case).
    acronyms: Sequence[str] = ()
    first_names: Sequence[str] = ()
    surnames: Sequence[str] = ()

    def __post_init__(self):
        if not self.token.strip() or re.search(r"[\x00-\x1f\x7f\ue000-\uf8ff]", self.token):
            raise ValueError("the token must be visible and without control or private-use characters")


def applied(text: Column, patterns: Iterable[str], token: str) -> tuple[Column, Column]:
    """(rewritten text, replacements), counted stage by stage."""
    count = F.lit(0)
    for p in patterns:
        count = count + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, token.replace("\\", "\\\\").replace("$", "\\$"))
    return text, count


#: Signs that a letter may match without regard to case in one matcher and not in the other.
ODD_CASE = "[\u0130\u0131\u017f\u1e9e\u2126\u212a\u212b]"


def relaxed(pattern: str) -> str | None:
    """A pattern for Arrow's automaton that each text with a match of ``pattern`` meets, and some others do; None: there is none.

    Looks around go, white space and digits are as in Unicode, and of borders only that before an ASCII letter or a digit is
    kept, as that such a sign does not stand before.
    """
    plain, i = "", 0
    while i < len(pattern):
        if re.match(r"\(\?<?[!=]", pattern[i:]):
            depth, within = 1, False
            i += 3
            while depth:
                c = pattern[i]
                i += 2 if c == "\\" else 1
                within = c == "[" or (within and c != "]")
                depth += 0 if within or c not in "()" else 1 if c == "(" else -1
            continue
        plain += pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += 2 if pattern[i] == "\\" else 1
    border = re.compile(r"(?:\\d|\[A-Z\])")
    out, i, inside = "", 0, None
    while i < len(plain):
        two = plain[i : i + 2]
        if two[0] == "\\":
            i += 2
            if two == "\\b":
                out += "(?:^|[^0-9A-Za-z_])" if not out and border.match(plain, i) else ""
            elif two == "\\d":
                out += "0-9" if inside == "not" else "\\p{Nd}"
            elif two == "\\s":
                every = "\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}"
                out += "\\s" if inside == "not" else every if inside else f"[{every}]"
            elif two == "\\w":
                return None
            else:
                out += two
            continue
        if two[0] == "[" and not inside:
            inside = "not" if two == "[^" else "in"
        elif two[0] == "]" and inside:
            inside = None
        out += two[0]
        i += 1
    try:
        pc.match_substring_regex(pa.array([""]), out)
    except pa.ArrowInvalid:
        return None
    return out


class Chain:
    """(pattern, whether case does not count) one after the other, each on what the ones before it left."""

    def __init__(self, patterns: Sequence[tuple[str, bool]], token: str):
        self.token = token
        self.steps = [(re.compile(p, re.I if any_case else 0), relaxed(p), any_case) for p, any_case in patterns]

    def run(self, texts: list[str]) -> tuple[list[str], list[int]]:
        texts, counts = list(texts), [0] * len(texts)
        now = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(now, ODD_CASE)
        for exact, guard, any_case in self.steps:
            may = pa.array([True] * len(texts)) if guard is None else pc.match_substring_regex(now, guard, ignore_case=any_case)
            changed = []
            for i in np.flatnonzero((pc.or_(may, odd) if any_case else may).to_numpy(zero_copy_only=False)).tolist():
                text, k = exact.subn(lambda _: self.token, texts[i])
                if k:
                    texts[i] = text
                    counts[i] += k
                    changed.append(i)
            if changed:
                mask = np.zeros(len(texts), dtype=bool)
                mask[changed] = True
                now = pc.replace_with_mask(now, pa.array(mask), pa.array([texts[i] for i in changed], pa.large_string()))
        return texts, counts


#: Texts that a task's chain holds at once.
TEXTS_AT_ONCE = 1_000


def matched(rows: DataFrame, text: str, count: str, patterns: Sequence[tuple[str, bool]], token: str) -> DataFrame:
    """Apply (pattern, whether case does not count) one after the other in one pass of Arrow batches.

    Measured on whole documents, Python's matcher, which looks for a pattern's first signs before anything else, takes less
    than an eighth of what the same chain of ``regexp_replace`` takes; short chains stay expressions (``applied``). A pattern
    is looked for only in the texts of a batch that meet its relaxed form, by an automaton that reads a text once.
    """

    @F.pandas_udf("struct<text:string,n:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = Chain(patterns, token)
        for texts in batches:
            made = [chain.run(texts.iloc[i : i + TEXTS_AT_ONCE].tolist()) for i in range(0, len(texts), TEXTS_AT_ONCE)]
            yield pd.DataFrame({"text": [t for m in made for t in m[0]], "n": [n for m in made for n in m[1]]})

    made = rows.withColumn("_m", run(F.col(text)))
    return made.withColumns({count: F.col(count) + F.col("_m.n"), text: F.col("_m.text")}).drop("_m")


#: Addresses that are replaced whole if a dictionary term stands in them, though addresses as such stay.
ADDRESS_SHAPES = tuple(re.compile(p) for p in (r"(?<!\w)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)", r"https?://\S+", r"(?<!\w)www\.[^\s,.)]+(?:\.[^\s,.)]+)+"))


def without_terms(text: str, terms: Terms, token: str, addresses: bool) -> tuple[str, int]:
    """(text, replacements): dictionary terms as whole words; ``addresses``: first, addresses that hold one, as a whole."""
    n = 0
    for shape in ADDRESS_SHAPES if addresses else ():
        places = [m.span() for m in shape.finditer(text) if terms.everywhere(m[0])]
        text, n = replaced(text, places, token), n + len(places)
    places = terms.taken(text)
    return replaced(text, places, token), n + len(places)


def _with_dictionary(rows: DataFrame, text: str, count: str, layers: Layers) -> DataFrame:
    """The automaton goes to the tasks once, whatever its size: a dictionary is what a user keeps in a file."""
    sent = rows.sparkSession.sparkContext.broadcast(sorted({t.strip() for t in layers.dictionary if t.strip()}))
    token, addresses = layers.token, layers.whole_addresses and not layers.safe

    @F.pandas_udf("struct<text:string,n:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = Terms(sent.value)
        for texts in batches:
            yield pd.DataFrame([without_terms(t, terms, token, addresses) for t in texts], columns=["text", "n"])

    made = rows.withColumn("_m", run(F.col(text)))
    return made.withColumns({count: F.col(count) + F.col("_m.n"), text: F.col("_m.text")}).drop("_m")


def _held(index: int) -> str:
    return chr(0xE000 + index // 1000) + chr(0xE100 + index % 1000)


def redact(rows: DataFrame, layers: Layers | None = None, columns: Sequence[str] = ("text",)) -> DataFrame:
    """Add <column>_after and counts <column>_n_safe, _n_clinical, _n_names, _n_dictionary; with names, <column>_names too.

    Order: whitelist held; e-mails and URLs whole, or without the safe layers those that hold a dictionary term; dictionary; safe layers; clinical codes and capitals; names; whitelist
    restored; runs of tokens joined.
    """
    layers = layers or Layers()
    rows = spread(rows)
    held = {t: _held(i) for i, t in enumerate(sorted({w for w in layers.whitelist if w}, key=lambda t: (-len(t), t)))}
    for c in columns:
        out, n = f"{c}_after", {k: f"{c}_n_{k}" for k in ("safe", "clinical", "names", "dictionary")}
        rows = rows.withColumns({out: whole(F.col(c)), **{v: F.lit(0) for v in n.values()}})
        for term, mark in held.items():
            rows = rows.withColumn(out, F.regexp_replace(out, "(?iu)" + word("(" + re.escape(term) + ")"), mark))
        if layers.safe:
            rows = matched(rows, out, n["safe"], [(formats.SAFE["identifiers"][k], True) for k in ("email", "url")], layers.token)
        if any(t.strip() for t in layers.dictionary):
            rows = _with_dictionary(rows, out, n["dictionary"], layers)
        if layers.safe:
            rows = matched(rows, out, n["safe"], [(p, group in formats.ANY_CASE) for group, own in formats.SAFE.items() for p in own.values()], layers.token)
        if layers.clinical:
            safe = "|".join(re.escape(a) for a in layers.acronyms)
            capitals = (rf"\b(?!(?:{safe})\b)" if safe else r"\b") + r"[A-ZÀ-Þ]{3,}\b"
            codes = [(p, True) for p in formats.CLINICAL.values()] + [(p, False) for p in formats.CODES.values()] + [(capitals, False)] + [(p, True) for p in formats.WITH_VALUE.values()]
            rows = matched(rows, out, n["clinical"], codes, layers.token)
        if layers.names:
            rows = _with_names(rows, out, n["names"], f"{c}_names", layers)
            rows = matched(rows, out, n["names"], [(p, False) for p in formats.HOSPITALS.values()], layers.token)
        for term, mark in held.items():
            rows = rows.withColumn(out, F.replace(out, F.lit(mark), F.lit(term)))
        if layers.safe:
            rows = rows.withColumn(out, consolidated(F.col(out), layers.token))
    return rows


#: Particles inside names, titles before one, words around eponyms, and units named after people.
PARTICLES = frozenset("de del la las los da das do dos di van von der den du le bin al el y e".split())
TITLE_BEFORE = re.compile(r"(?:Dr|Dra|Prof|Mr|Mrs|Ms|Sr|Sra|Herr|Frau|Mme|M)\.?\s*$")
EPONYM_BEFORE = re.compile(r"(?:syndrome|disease|test|scale|score|síndrome|enfermedad|escala|prueba|maladie|Syndrom|Krankheit)\s+(?:of|de|von|d')?\s*$", re.I)
EPONYM_AFTER = re.compile(r"\s*(?:['’]s)?\s*(?:syndrome|disease|test|scale|score|index|criteria|síndrome|enfermedad|escala|índice|Syndrom|Krankheit)\b", re.I)
UNITS = frozenset("kelvin newton pascal joule watt volt ampere ohm hertz tesla weber henry farad coulomb becquerel gray sievert celsius fahrenheit".split())
CANDIDATE = re.compile(r"\b[A-ZÀ-Þ][a-zß-ÿ]+(?:\s+(?:(?:de|del|la|da|di|van|von|der|du|le)\s+)*[A-ZÀ-Þ][a-zß-ÿ]+){1,3}\b")


def name_score(tokens: Sequence[str], before: str, at_start: bool, first: frozenset, last: frozenset) -> int:
    """Evidence that capitalised words are a person's name; six is enough."""
    named = [t for t in tokens if t.lower() not in PARTICLES]
    if not named:
        return 0
    score = 4 if len(named) >= 3 else 3
    listed = named[0].lower() in first
    score += 2 * listed + 2 * (named[-1].lower() in last) + (len(named) < len(tokens))
    if not listed:
        score -= 3 * (TITLE_BEFORE.search(before[-30:]) is None) + 2 * at_start
    return score


def without_names(text: str, token: str, first: frozenset, last: frozenset) -> tuple[str, list[str]]:
    """(text, names that were replaced, in order)."""
    out, at, found = [], 0, []
    for m in CANDIDATE.finditer(text):
        before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 40]
        if EPONYM_BEFORE.search(before) or EPONYM_AFTER.match(after):
            continue
        tokens = m[0].split()
        if any(t.lower() in UNITS for t in tokens) and (re.search(r"\d[\d.,]*\s*$", before[-20:]) or re.match(r"\s*\d", after[:20])):
            continue
        shown = m.start()
        while shown and text[shown - 1].isspace():
            shown -= 1
        if name_score(tokens, before, not shown or text[shown - 1] in ".!?", first, last) >= 6:
            out += [text[at : m.start()], token]
            at = m.end()
            found.append(m[0])
    return "".join(out) + text[at:], found


def _with_names(rows: DataFrame, text: str, count: str, names: str, layers: Layers) -> DataFrame:
    first, last, token = frozenset(layers.first_names), frozenset(layers.surnames), layers.token

    @F.pandas_udf("struct<text:string,names:array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without_names(t, token, first, last) for t in texts], columns=["text", "names"])

    made = rows.withColumn("_m", run(F.col(text)))
    return made.withColumns({count: F.col(count) + F.size("_m.names"), names: F.col("_m.names"), text: F.col("_m.text")}).drop("_m")


def admitted(term: Column) -> Column:
    """Whether a detected term is safe to replace everywhere: no common word would be."""
    words = F.split(F.trim(term), f"{SPACE}+")
    titled = F.size(F.filter(words, lambda w: w.rlike("^\\p{Lu}\\p{Ll}+$")))
    strong = term.rlike("[0-9_-]") | term.rlike("^[^\\p{Ll}]{3,}$")
    return (F.length(F.trim(term)) >= 4) & F.when(F.size(words) >= 2, (titled >= 2) | strong).otherwise(strong)


def document_terms(rows: DataFrame, patterns: Sequence[str], text: str = "text", document: str = "file", names: str | None = None) -> DataFrame:
    """(document, term): distinct lower-case terms that the patterns find in a document, or that the column ``names`` holds, and that are admitted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(whole(F.col(text)), F.lit(p), F.lit(0)) for p in patterns], *([F.coalesce(F.col(names), F.array().cast("array<string>"))] if names else [])))
    terms = rows.select(document, F.explode(F.array_distinct(found)).alias("term"))
    return terms.where(admitted(F.col("term"))).select(document, F.lower(F.trim("term")).alias("term")).distinct()


def lowercase_words(rows: DataFrame, text: str = "text", document: str = "file") -> DataFrame:
    """(document, word): words of more than two letters that a document writes in lower case somewhere."""
    plain = F.regexp_replace(F.regexp_replace(whole(F.col(text)), EMAIL, " "), URL, " ")
    return rows.select(document, F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(f"{B0}\\p{{Ll}}{{3,}}{B1}"), F.lit(0)))).alias("word")).distinct()


#: Rows of one document that a task handles together, about, and how many documents may be dealt out to shares.
ROWS_OF_SHARE, DEALT_DOCUMENTS = 20_000, 100_000


def swapped(text: str, terms: Terms, kept: Terms, usual: set[str], token: str) -> str:
    """The text with its document's terms replaced, but for those in lower case, those of usual words, and what is kept."""

    def swap(found: str) -> str:
        words = [w for w in re.findall(r"[^\W\d_]+", found.lower()) if len(w) > 2]
        return found if found.islower() or (words and usual and all(w in usual for w in words)) else token

    return replaced(text, terms.taken(text, kept.taken(text)), swap)


def propagate(rows: DataFrame, terms: DataFrame, lower: DataFrame | None = None, text: str = "text_after", document: str = "file", token: str = TOKEN, whitelist: Sequence[str] = ()) -> DataFrame:
    """Second pass: replace each document's terms in all its rows, longest first.

    Matches in lower case stay, and so do those made of words that the document also writes in lower case; terms of the
    whitelist are none, and its occurrences are not touched. A document's terms and words go ahead of its rows in one
    sorted stream, so each is sent once for a share of some ``ROWS_OF_SHARE`` rows and no row carries them; a document of
    very many rows is dealt out to shares. Null texts stay null, and rows without a document have no terms.
    """
    spark = rows.sparkSession
    gone = frozenset(w.strip().lower() for w in whitelist if w.strip())
    counts = rows.groupBy(F.col(document).alias("_d")).agg(F.count("*").alias("_n"))
    # so that at most ``DEALT_DOCUMENTS`` are in the list that goes to all tasks
    most = max(ROWS_OF_SHARE, (counts.agg(F.sum("_n")).first()[0] or 0) // DEALT_DOCUMENTS)
    shares = counts.select("_d", F.ceil(F.col("_n") / most).cast("int").alias("_shares"))
    fields = [f"`{c}`" for c in rows.columns]
    head = terms.select(F.col(document).cast("string").alias("_d"), F.lit(0).alias("_kind"), F.col("term").alias("_word"))
    if lower is not None:
        head = head.union(lower.select(F.col(document).cast("string"), F.lit(1), F.col("word")))
    named = shares.where("_d is not null").select(F.col("_d").cast("string").alias("_d"), "_shares")
    sent = head.join(named, "_d").select("_d", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), "_kind", "_word", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    own = rows.join(F.broadcast(shares.where("_shares > 1")), F.col(document) == F.col("_d"), "left")
    share = F.pmod(F.monotonically_increasing_id(), F.coalesce("_shares", F.lit(1))).cast("int")
    own = own.select(F.col(document).cast("string").alias("_d"), share.alias("_share"), F.lit(2).alias("_kind"), F.lit(None).cast("string").alias("_word"), *fields)
    at, kept = rows.columns.index(text) + 4, spark.sparkContext.broadcast(sorted(gone))
    schema = T.StructType(rows.schema.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white, now, words, made = Terms(kept.value), None, ([], []), None
        # a piece of a batch at a time, as its texts become objects of Python's
        for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, TEXTS_AT_ONCE)):
            names, number, kinds, said, texts = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, at))
            out = []
            for d, share, kind, word, t in zip(names, number, kinds, said, texts):
                if (d, share) != now:
                    now, words, made = (d, share), ([], []), None
                if kind < 2:
                    words[kind].append(word)
                elif t is None or not words[0]:
                    out.append(t)
                else:
                    made = made or (Terms((w for w in words[0] if w not in gone), WESTERN), set(words[1]))
                    out.append(swapped(t, made[0], white, made[1], token))
            left = batch.filter(pa.array([k == 2 for k in kinds]))
            if left.num_rows:
                columns = [pa.array(out, arrow.field(i).type) if i + 4 == at else left.column(i + 4) for i in range(len(arrow))]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    return own.union(sent).repartition("_d", "_share").sortWithinPartitions("_d", "_share", "_kind").mapInArrow(run, schema)


def mask(value: Column, kind: str) -> Column:
    """An example that shows no more than its form."""
    if kind == "email":
        return F.regexp_replace(value, "^(.)[^@]*@(.)[^@]*\\.([^.@]*)$", "$1***@$2***.$3")
    if kind == "phone":
        return F.concat(F.lit("***"), F.right(F.regexp_replace(value, "\\D", ""), F.lit(3)))
    if kind == "url":
        return F.regexp_replace(value, "^(https?://)?([^/]{1,10}).*$", "$1$2***")
    return F.concat(F.lit("***"), F.right(value, F.lit(4)))


def audit(rows: DataFrame, text: str = "text_after", document: str = "file", strict: bool = False) -> DataFrame:
    """What is left of the critical kinds by document: (document, kind, n, the first and the last masked example)."""
    def hits(kind: str, pattern: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.transform(F.regexp_extract_all(whole(F.col(text)), F.lit(pattern), F.lit(0)), lambda v: mask(v, kind)).alias("hits"))

    found = F.array(*[hits(k, p) for k, p in AUDIT.items()])
    left = rows.select(document, F.explode(found).alias("f")).where("size(f.hits) > 0").select(document, "f.kind", F.explode("f.hits").alias("hit"))
    counted = left.groupBy(document, "kind", "hit").count().groupBy(document, "kind").agg(F.sum("count").alias("n"), F.min("hit").alias("example"), F.max("hit").alias("other_example"))
    if strict:
        counted = counted.withColumn("n", F.when(F.assert_true(F.lit(False), F.concat(F.lit("left in "), F.col(document).cast("string"))).isNull(), F.col("n")))
    return counted
