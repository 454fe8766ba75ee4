"""Row-local checks: each is one Catalyst expression that gives an array of findings; no check shuffles.

A finding has the spans of source and target and a note. ``check_segments`` evaluates the enabled checks in one
projection and explodes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, more_of, only_in, same_multiset
from ..functions.text import SPACE, WORD, find_all, strip, whole
from ..schema import DEFAULT_CHECKS, category_column

FINDING = "array<struct<span_source:array<string>,span_target:array<string>,note:string>>"
NONE = F.array

#: Fixed values.
INVISIBLE = "[\\x7f\\xad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]"
SYMBOLS = "[<>≤≥≠±×÷√∞‰$€£¥]"
FINAL = ".!?…。．！？"
ACRONYMS = (
    "FDA EMA NCT CDC IRB WHO EU US USA UK ID PDF HTML XML URL API HIV DNA RNA PCR MRI EKG ECG HIPAA GDPR ICH GCP AE SAE ADR BMI SAP TMF CRF PK PD COVID SARS OMS AEMPS BOE DOUE UE PCT ISO IEC NIH"
).split()
NEGATIONS = {
    "en": "not no never none nothing nobody neither nor without cannot isn't aren't wasn't weren't don't doesn't didn't won't wouldn't shouldn't can't couldn't hasn't haven't hadn't mustn't mightn't needn't shan't",
    "de": "nicht kein keine keinen keiner keinem keines niemals nie niemand weder ohne nichts nirgends nirgendwo",
    "es": "no nunca ningún ninguna ningunos ningunas ninguno nadie nada ni sin jamás tampoco",
    "fr": "pas non jamais aucun aucune rien personne sans ni nul nulle nullement guère plus",
    "it": "non no mai nessuno nessuna niente nulla né senza neanche neppure nemmeno",
    "pt": "não nao nunca nenhum nenhuma nenhuns nenhumas ninguém ninguem nada nem sem jamais tampouco",
    "nl": "niet geen nooit niets niemand noch zonder nergens",
    "pl": "nie nigdy nikt nic ani bez żaden żadna żadne żadnego żadnej",
}
URL = f"(?i)(?<!{WORD})(?:https?://|www\\.)[^\\s<>\"']+"
EMAIL = f"(?<!{WORD})[\\p{{L}}\\p{{N}}_.%+\\-]+@[\\p{{L}}\\p{{N}}_.\\-]+\\.\\p{{L}}{{2,}}(?!{WORD})"
#: printf, mustache, named, template and self-closing forms.
PLACEHOLDER = "|".join(("%[0-9]*\\$?[sdifoxX]", "\\{\\{[^{}]+\\}\\}", "\\{[A-Za-z0-9_.\\-]+\\}", "\\$\\{[^}]+\\}", "<[A-Za-z]+/>"))
NUMBER = f"(?<!{WORD})(?:[+\\-−]\\s*)?\\d+(?:[.,]\\d+)*(?:[eE][+\\-]?\\d+|[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+|\\^[+\\-]?\\d+)?|(?<=[A-Za-z])\\d+"
TAG_TEXT = "</?(?:ph|bpt|ept|it|bx|ex|x|g|mrk|sub)(?:\\s[^<>]*)?/?>"
#: Latin letters, Cyrillic and Greek.
LATIN, CYRILLIC, GREEK = "[A-Za-z\\u00c0-\\u024f\\u1e00-\\u1eff]", "[\\u0400-\\u052f]", "[\\u0370-\\u03ff\\u1f00-\\u1fff]"


@dataclass
class Config:
    checks: frozenset = DEFAULT_CHECKS
    source_lang: str = ""
    target_lang: str = ""
    length_ratio_min_chars: int = 20
    length_ratio_low: float = 0.3
    length_ratio_high: float = 3.0
    decimal_policy: str = "locale"
    consistency_threshold: float = 1.0
    consistency_min_chars: int = 8
    custom_forbidden: list = field(default_factory=list)
    custom_required: list = field(default_factory=list)
    regex_timeout: float = 0.25


def _list(c: Column | None) -> Column:
    return c if c is not None else F.lit(None).cast("array<string>")


def finding(source: Column | None = None, target: Column | None = None, note: Column | None = None) -> Column:
    return F.struct(_list(source).alias("span_source"), _list(target).alias("span_target"), (note if note is not None else F.lit(None)).cast("string").alias("note"))


def one_if(condition: Column, source: Column | None = None, target: Column | None = None, note: Column | None = None) -> Column:
    """One finding where the condition holds."""
    return F.when(condition, F.array(finding(source, target, note))).otherwise(F.array().cast(FINDING))


def each(values: Column, on_target: bool = True, note: Column | None = None) -> Column:
    """One finding for each value."""
    return F.transform(values, lambda v: finding(None if on_target else F.array(v), F.array(v) if on_target else None, note))


def S() -> Column:
    return whole(F.col("source_text"))


def D() -> Column:
    return whole(F.col("target_text"))


def found_if(condition: Column, found: Column) -> Column:
    """What a dear pattern finds, looked for only where a cheap condition that all its matches need holds."""
    return F.when(condition, found).otherwise(F.array().cast("array<string>"))


def empty_target(cfg: Config) -> Column:
    return one_if((strip(S()) != "") & (strip(D()) == ""))


def untranslated_segment(cfg: Config) -> Column:
    return one_if((strip(S()) == strip(D())) & (F.length(strip(S())) >= 8) & strip(S()).rlike("\\p{L}"))


def control_characters(cfg: Config) -> Column:
    return let(F.array_sort(F.array_distinct(find_all(D(), INVISIBLE))), lambda found: one_if(F.size(found) > 0, None, found))


def mixed_scripts(cfg: Config) -> Column:
    mixed = lambda w: w.rlike(CYRILLIC) & (w.rlike(LATIN) | w.rlike(GREEK))
    return each(found_if(D().rlike(CYRILLIC), F.filter(F.array_distinct(find_all(D(), "\\p{L}+")), mixed)))


def length_ratio(cfg: Config) -> Column:
    s, d = F.length(strip(S())), F.length(strip(D()))
    return one_if((s >= cfg.length_ratio_min_chars) & (d > 0) & ((d / s < cfg.length_ratio_low) | (d / s > cfg.length_ratio_high)))


def repeated_words(cfg: Config) -> Column:
    # a long line may hold thousands: the first of each word is told by a map, not by looking back from each
    hits = find_all(D(), f"(?iu)(?<!{WORD})(\\p{{L}}{{2,}}){SPACE}+\\1(?!{WORD})")
    first = lambda h: F.lower(F.split(h, f"{SPACE}+")[0])
    kept = lambda h: let(F.transform(h, first), lambda w: F.transform(F.array_distinct(w), lambda x: F.get(h, F.array_position(w, x).cast("int") - 1)))
    return let(hits, lambda h: let(kept(h), lambda found: one_if(F.size(found) > 0, None, found)))


def _unbalanced(text: Column) -> Column:
    """Brackets and quotes without a partner, by a stack; the stack and the strays are kept apart."""
    plain = F.regexp_replace(text, "(?<=[\\p{L}\\p{N}])[’‘](?=[\\p{L}\\p{N}])", "")
    signs = find_all(plain, "[()\\[\\]{}«»“”‘’]")
    pairs = F.create_map(*[F.lit(x) for p in (")(", "][", "}{", "»«", "”“", "’‘") for x in p])
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("bad"))

    def step(state: Column, c: Column) -> Column:
        opened = pairs[c]
        return F.when(opened.isNull(), F.struct(F.array_append(state["stack"], c).alias("stack"), state["bad"].alias("bad"))).when(
            (F.size(state["stack"]) > 0) & (F.try_element_at(state["stack"], F.lit(-1)) == opened),
            F.struct(F.slice(state["stack"], F.lit(1), F.greatest(F.lit(0), F.size(state["stack"]) - 1)).alias("stack"), state["bad"].alias("bad")),
        ).otherwise(F.struct(state["stack"].alias("stack"), F.array_append(state["bad"], c).alias("bad")))

    strays = F.aggregate(signs, start, step, lambda s: F.concat(s["bad"], s["stack"]))
    quotes = F.size(find_all(plain, '"')) % 2 == 1
    return F.array_sort(F.array_distinct(F.concat(strays, F.when(quotes, F.array(F.lit('"'))).otherwise(F.array().cast("array<string>")))))


def bracket_balance(cfg: Config) -> Column:
    side = lambda text, on_target: let(_unbalanced(text), lambda x: one_if(F.size(x) > 0, None if on_target else x, x if on_target else None))
    return F.concat(side(S(), False), side(D(), True))


def _content_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~t["name"].isin("mrk", "sub") & ~F.coalesce(t["is_fmt"], F.lit(False)))


def _marks(tags: Column) -> Column:
    return F.transform(_content_tags(tags), lambda t: F.concat(t["name"], F.lit("#"), whole(t["id"])))


def tag_count(cfg: Config) -> Column:
    s, d = _marks(F.col("source_tags")), _marks(F.col("target_tags"))
    return one_if(~same_multiset(s, d), more_of(s, d), more_of(d, s))


def _closes_early(tags: Column) -> Column:
    names = F.transform(tags, lambda t: F.concat(t["name"], F.lit("#"), whole(t["id"])))
    ids = F.array_distinct(F.transform(F.filter(tags, lambda t: t["name"] == "ept"), lambda t: whole(t["id"])))
    return F.exists(ids, lambda i: (F.array_position(names, F.concat(F.lit("bpt#"), i)) > 0) & (F.array_position(names, F.concat(F.lit("ept#"), i)) < F.array_position(names, F.concat(F.lit("bpt#"), i))))


def tag_order(cfg: Config) -> Column:
    s, d = F.col("source_tags"), F.col("target_tags")
    return one_if((F.size(s) == F.size(d)) & _closes_early(d) & ~_closes_early(s), _marks(s), _marks(d))


def tag_malformed(cfg: Config) -> Column:
    s, d = find_all(whole(F.col("source_raw")), TAG_TEXT), find_all(whole(F.col("target_raw")), TAG_TEXT)
    return F.when(F.size(s) > 0, F.array(finding(F.array_distinct(s)))).otherwise(one_if(F.size(d) > 0, None, F.array_distinct(d)))


def _multisets(s: Column, d: Column) -> Column:
    return let(s, lambda s: let(d, lambda d: one_if(~same_multiset(s, d), only_in(s, d), only_in(d, s))))


def _lists_differ(pattern: str, needs: Callable[[Column], Column], clean: Callable[[Column], Column] = lambda c: c) -> Column:
    tokens = lambda c: F.transform(found_if(needs(c), find_all(c, pattern)), clean)
    return _multisets(tokens(S()), tokens(D()))


def urls(cfg: Config) -> Column:
    return _lists_differ(URL, lambda c: F.contains(c, F.lit("://")) | F.contains(F.lower(c), F.lit("www.")), lambda u: F.regexp_replace(u, "[.,;:!?)\\]}]+$", ""))


def emails(cfg: Config) -> Column:
    return _lists_differ(EMAIL, lambda c: F.contains(c, F.lit("@")))


def placeholders(cfg: Config) -> Column:
    return _lists_differ(PLACEHOLDER, lambda c: F.contains(c, F.lit("%")) | F.contains(c, F.lit("{")) | F.contains(c, F.lit("<")))


def symbol_mismatch(cfg: Config) -> Column:
    """Counted sign by sign: a long line may hold thousands."""
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    signs = F.array(*[F.lit(c) for c in sorted(SYMBOLS[1:-1])])
    more = lambda a, b: F.filter(signs, lambda c: count(a, c) > count(b, c))
    shown = lambda s, d: one_if((F.size(s) > 0) | (F.size(d) > 0), F.slice(s, 1, 1), F.slice(d, 1, 1))
    # what else a text holds is no sign, and all 14 are looked for in what is left
    only = lambda t: F.array_join(find_all(t, SYMBOLS), "")
    return let(only(S()), lambda a: let(only(D()), lambda b: let(more(a, b), lambda s: let(more(b, a), lambda d: shown(s, d)))))


def alphanum_ids(c: Column) -> Column:
    plain = F.translate(c, "‑‐   ", "--   ")
    # a token without a digit is left at its first sign: the rest of it has none either
    tokens = found_if(c.rlike("[0-9]"), find_all(plain, "(?<![A-Za-z0-9])(?=[A-Za-z./_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9./_-]*[A-Za-z0-9]"))
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & t.rlike("[A-Za-z]") & t.rlike("[0-9]"))


def alphanum_id_mismatch(cfg: Config) -> Column:
    return _multisets(alphanum_ids(S()), alphanum_ids(D()))


def polarity_mismatch(cfg: Config) -> Column:
    """Skipped (no finding) for a language without a list; see ``notices``."""
    heads = [x.replace("_", "-").split("-")[0].lower() for x in (cfg.source_lang, cfg.target_lang)]
    if any(h not in NEGATIONS for h in heads):
        return F.array().cast(FINDING)
    tokens = lambda c: find_all(F.translate(F.lower(c), "’‘ʼ", "'''"), "\\p{L}+(?:['\\-]\\p{L}+)*")
    has = lambda c, h: F.exists(tokens(c), lambda w: w.isin(NEGATIONS[h].split()))
    return one_if(has(S(), heads[0]) != has(D(), heads[1]))


def repeated_punctuation(cfg: Config) -> Column:
    found = F.array_distinct(F.filter(find_all(D(), "\\.{2,}|!{2,}|\\?{2,}|,{2,}|;{2,}|:{2,}"), lambda r: r != "..."))
    return let(found, lambda found: one_if(F.size(found) > 0, None, found))


def final_punctuation_mismatch(cfg: Config) -> Column:
    last = lambda c: F.right(strip(c), F.lit(1))
    is_final = lambda c: c.isin(*FINAL)
    s, d = last(S()), last(D())
    shown = lambda c: F.when(is_final(c), F.translate(c, "。．！？", "..!?")).otherwise("")
    mark = lambda c: F.when(is_final(c), F.array(c))
    return one_if((s != "") & (d != "") & (shown(s) != shown(d)), mark(s), mark(d))


def first_letter_case(cfg: Config) -> Column:
    s, d = F.left(strip(S()), F.lit(1)), F.left(strip(D()), F.lit(1))
    turned = (s.rlike("\\p{Lu}") & d.rlike("\\p{Ll}")) | (s.rlike("\\p{Ll}") & d.rlike("\\p{Lu}"))
    return one_if(turned, F.array(s), F.array(d))


def camelcase_mismatch(cfg: Config) -> Column:
    tokens = found_if(S().rlike("[a-z][A-Z]"), F.array_distinct(find_all(S(), f"(?<!{WORD})[A-Za-z]*[a-z][A-Z][A-Za-z]*(?!{WORD})")))
    return let(F.filter(tokens, lambda t: ~F.contains(D(), t)), lambda missing: one_if((D() != "") & (F.size(missing) > 0), missing))


def double_spaces(cfg: Config) -> Column:
    return let(F.array_distinct(find_all(whole(F.col("target_display")), " {2,}")), lambda found: one_if(F.size(found) > 0, None, found))


def whitespace_edges(cfg: Config) -> Column:
    edges = whole(F.col("target_edges"))
    return one_if(edges.rlike("^[ \\u00a0]|[ \\u00a0]$"), None, None, F.concat_ws(" and ", F.when(edges.rlike("^[ \\u00a0]"), "leading"), F.when(edges.rlike("[ \\u00a0]$"), "trailing")))


RULES: dict[str, Callable[[Config], Column]] = {
    f.__name__: f
    for f in (
        empty_target, untranslated_segment, control_characters, mixed_scripts, length_ratio, repeated_words, bracket_balance, tag_count, tag_order, tag_malformed, urls, emails, placeholders,
        symbol_mismatch, alphanum_id_mismatch, polarity_mismatch, repeated_punctuation, final_punctuation_mismatch, first_letter_case, camelcase_mismatch, double_spaces, whitespace_edges)
}


def check_segments(segments: DataFrame, cfg: Config | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """Findings of the enabled row-local rules: file, id, category_id, severity, span_source, span_target, note."""
    cfg = cfg or Config()
    from .numbers import RULES as NUMERIC

    rules = {**RULES, **NUMERIC}
    chosen = [c for c in rules if c in (cfg.checks if only is None else set(only))]
    if not chosen:
        return segments.limit(0).select("file", "id", F.lit("").alias("category_id"), F.lit("").alias("severity"), F.array().cast("array<string>").alias("span_source"), F.array().cast("array<string>").alias("span_target"), F.lit(None).cast("string").alias("note"))
    def named(category: str) -> Column:
        return F.transform(rules[category](cfg), lambda f: F.struct(F.lit(category).alias("category_id"), f.alias("f")))

    tagged = [named(c) for c in chosen]
    found = segments.select("file", "id", F.explode(F.flatten(F.array(*tagged))).alias("x"))
    return found.select("file", "id", "x.category_id", category_column(F.col("x.category_id"), 2).alias("severity"), "x.f.span_source", "x.f.span_target", "x.f.note")
