"""Checks against tables of terms: joins on a term's first word, then an exact whole-word match.

Each segment's distinct lower-case words are exploded and joined with the terms by the term's first word (or, if a term
begins with no letter or digit, its first sign), so the work follows the hits and not segments x terms; a broadcast is
left to the optimizer, which checks the size. A segment is known by its file and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, find_all, quoted, whole
from ..schema import category_column


def _hits(segments: DataFrame, terms: DataFrame, text: Column, sensitive: Column | None = None) -> DataFrame:
    """(file, id, _no, _text) of the terms (_no, term) that are whole words of the text."""
    first = F.regexp_extract(F.lower("term"), f"^(?:{WORD}+|(?s:.))", 0)
    keyed = terms.withColumn("_w", first)
    base = segments.select("file", "id", text.alias("_text"))
    # ids and words travel, texts only to the hits
    low = F.lower("_text")
    words = base.select("file", "id", F.explode(F.array_distinct(find_all(low, f"{WORD}+"))).alias("_w"))
    signs = base.select("file", "id", F.explode(F.array_distinct(find_all(low, f"(?!{WORD})(?s:.)"))).alias("_w"))
    met = words.union(signs).join(keyed, "_w").drop("_w")
    joined = met.join(base, ["file", "id"])
    near = joined.where(F.lower("_text").contains(F.lower("term")))
    pattern = F.concat(F.lit(f"(?<!{WORD})"), quoted(F.col("term")), F.lit(f"(?!{WORD})"))
    exact = near.where(F.when(sensitive if sensitive is not None else F.lit(False), F.rlike("_text", pattern)).otherwise(F.rlike("_text", F.concat(F.lit("(?iu)"), pattern))))
    return exact


def term_list(terms: DataFrame, column: str = "term") -> DataFrame:
    """Distinct terms without regard to case, the first of each kept, with their number."""
    from pyspark.sql import Window

    order = F.col("no") if "no" in terms.columns else F.monotonically_increasing_id()
    numbered = terms.where(F.trim(column) != "").select(F.trim(column).alias("term"), order.alias("_no"))
    first = numbered.withColumn("_k", F.row_number().over(Window.partitionBy(F.lower("term")).orderBy("_no")))
    return first.where("_k = 1").drop("_k")


def _issues(found: DataFrame, category: str, source: Column, target: Column, note: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("array<string>")
    return found.select("file", "id", F.lit(category).alias("category_id"), category_column(F.lit(category), 2).alias("severity"), (source if source is not None else null).alias("span_source"),
                        (target if target is not None else null).alias("span_target"), (note if note is not None else F.lit(None)).cast("string").alias("note"))


def forbidden_terms(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """One finding for each segment and forbidden term in its target."""
    found = _hits(segments, term_list(terms), whole(F.col("target_text")))
    return _issues(found, "forbidden_terms", None, F.array("term"))


def _forms(terms: DataFrame, stems: DataFrame) -> DataFrame:
    """(_no, term) of the inflected forms of single-word terms that are no acronyms."""
    single = terms.select("_no", F.col("term").alias("_t")).where(F.col("_t").rlike("^\\p{L}+(?:['’-]\\p{L}+)*$") & ~F.col("_t").rlike("^(?=(?:.*\\p{L}){2})[^\\p{Ll}]+$"))
    own = stems.select(F.lower("form").alias("form"), F.lower("stem").alias("stem")).distinct()
    met = single.join(own, F.lower("_t") == own.stem).where("form <> stem")
    return met.join(own.where("form = stem").select("form"), "form", "left_anti").select("_no", F.col("form").alias("term"))


def glossary_violation(segments: DataFrame, glossary: DataFrame, case_sensitive: bool = False, stems: DataFrame | None = None, source_stems: DataFrame | None = None) -> DataFrame:
    """One finding for each segment and source term whose targets are all missing.

    Alternatives are all targets of source terms that are equal without case. Terms in capitals are always matched with
    case. ``stems`` and ``source_stems`` (form, stem), of the target's and of the source's language, let single-word terms
    match inflected forms whose stems contain the term and that are not a stem of themselves (``sources.affixes``).
    """
    entries = glossary.where((F.trim("source") != "") & (F.trim("target") != "")).select(F.trim("source").alias("source"), F.trim("target").alias("target"), F.col("note") if "note" in glossary.columns else F.lit(None).cast("string").alias("note"))
    sources = entries.groupBy(F.lower("source").alias("_no")).agg(F.min_by("source", F.struct("source", "target")).alias("term"), F.concat_ws(" | ", F.array_sort(F.collect_set("target"))).alias("_targets"), F.max("note").alias("note"))
    exact = lambda c: F.lit(case_sensitive) | c.rlike("^(?=(?:.*\\p{L}){2})[^\\p{Ll}]+$")
    if source_stems is not None:
        shown = sources.select("_no", "term", "_targets", "note")
        sources = sources.select("_no", "term", F.col("term").alias("_shown"), "_targets", "note").union(
            _forms(shown.select("_no", "term"), source_stems).join(shown.withColumnRenamed("term", "_shown"), "_no").select("_no", "term", "_shown", "_targets", "note"))
    else:
        sources = sources.withColumn("_shown", F.col("term"))
    in_source = _hits(segments, sources, whole(F.col("source_text")), exact(F.col("term")))
    if source_stems is not None:
        # the term and its forms are one finding
        in_source = in_source.dropDuplicates(["file", "id", "_no"])
    targets = entries.select(F.lower("source").alias("_no"), F.col("target").alias("term"))
    if stems is not None:
        targets = targets.union(_forms(targets, stems))
    in_target = _hits(segments, targets, whole(F.col("target_text")), exact(F.col("term"))).select("file", "id", "_no").distinct()
    missing = in_source.join(in_target, ["file", "id", "_no"], "left_anti")
    return _issues(missing, "glossary_violation", F.array("_shown"), F.array("_targets"), F.col("note"))


def confusable_pairs(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups are arrays (column members) of at least two words; one finding for each segment and member in its target."""
    members = groups.where("size(members) >= 2").select(F.explode("members").alias("term"), F.array_join("members", ", ").alias("_group"))
    distinct = members.where(F.trim("term") != "").groupBy(F.lower("term").alias("_no")).agg(F.min("term").alias("term"), F.min("_group").alias("_group"))
    found = _hits(segments, distinct, whole(F.col("target_text")))
    return _issues(found, "confusable_pairs", None, F.array("term"), F.col("_group"))


def spellcheck(segments: DataFrame, lexicon: DataFrame, ignore: DataFrame | None = None, shown: int = 20) -> DataFrame:
    """Target words that the lexicon (column form) has neither as written nor in lower case; at most ``shown`` are listed."""
    token = "\\p{L}+(?:['’\\-]\\p{L}+)*"
    words = segments.select("file", "id", F.posexplode(F.array_distinct(find_all(whole(F.col("target_text")), token))).alias("pos", "word")).where("length(word) >= 2")
    plain = F.translate("word", "’", "'")
    known = lexicon.select(F.translate("form", "’", "'").alias("_f")).distinct()
    if ignore is not None:
        words = words.join(ignore.select(F.lower("term").alias("_i")).distinct(), F.lower("word") == F.col("_i"), "left_anti")
    for form in (plain, F.lower(plain)):
        words = words.join(known, form == F.col("_f"), "left_anti")
    found = words.groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return _issues(found, "spellcheck", None, F.slice(F.transform("w", lambda x: x["word"]), 1, shown))
