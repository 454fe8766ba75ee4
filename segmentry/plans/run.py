"""Whole runs: all checks over segments, redaction of documents, and the cleaning of a memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, cross, redact, similarity, terms
from ..schema import MONOLINGUAL_CHECKS, category_column


def _cross(found: DataFrame, category: str, span=None) -> DataFrame:
    null = F.lit(None).cast("array<string>")
    return found.select("file", "id", F.lit(category).alias("category_id"), category_column(F.lit(category), 2).alias("severity"), null.alias("span_source"), (span if span is not None else null).alias("span_target"), F.lit(None).cast("string").alias("note"))


def run_checks(segments: DataFrame, cfg: checks.Config | None = None, forbidden: DataFrame | None = None, glossary: DataFrame | None = None, confusable: DataFrame | None = None, lexicon: DataFrame | None = None, monolingual: bool = False) -> DataFrame:
    """All enabled checks as one table of findings; monolingual text gets only the checks that need no source."""
    cfg = cfg or checks.Config()
    on = cfg.checks & MONOLINGUAL_CHECKS if monolingual else cfg.checks
    parts = [checks.check_segments(segments, cfg, on)]
    if forbidden is not None and "forbidden_terms" in on:
        parts.append(terms.forbidden_terms(segments, forbidden))
    if glossary is not None and "glossary_violation" in on:
        parts.append(terms.glossary_violation(segments, glossary))
    if confusable is not None and "confusable_pairs" in on:
        parts.append(terms.confusable_pairs(segments, confusable))
    if lexicon is not None and "spellcheck" in on:
        parts.append(terms.spellcheck(segments, lexicon))
    if "inconsistent_translation" in on:
        for axis in ("target", "source"):
            parts.append(_cross(cross.exact_consistency(segments, axis, cfg.consistency_min_chars), "inconsistent_translation"))
        files = segments.select("id", "file")
        parts.append(_cross(cross.hyphenation(segments).join(files, "id"), "inconsistent_translation", F.array("hyphenated", "plain")))
        if cfg.consistency_threshold < 1:
            pairs = similarity.fuzzy_consistency(segments, max(0.5, cfg.consistency_threshold), cfg.consistency_min_chars)
            parts.append(_cross(pairs.select(F.col("b").alias("id")).join(files, "id"), "inconsistent_translation"))
    for mode in ("date", "number"):
        if f"{mode}_format_mismatch" in on:
            odd = cross.convention_majority(segments, mode)
            parts.append(_cross(odd, f"{mode}_format_mismatch", F.col("span_target")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def notices(segments: DataFrame, cfg: checks.Config) -> list[str]:
    """What a run could not compare, in words; empty if everything was compared."""
    from ..operators.numbers import ambiguous_dates

    said = []
    heads = {x.replace("_", "-").split("-")[0].lower() for x in (cfg.source_lang, cfg.target_lang)}
    if "polarity_mismatch" in cfg.checks and heads - checks.NEGATIONS.keys():
        said.append("negation was not compared: no word list for " + ", ".join(sorted(heads - checks.NEGATIONS.keys())))
    if "date_format_mismatch" in cfg.checks:
        langs = (cfg.source_lang, cfg.target_lang)

        def run(batches):
            import pandas as pd

            for b in batches:
                yield pd.DataFrame({"n": [int(any(ambiguous_dates(s or "", t or "", langs) for s, t in zip(b["source_text"], b["target_text"])))]})

        if segments.select("source_text", "target_text").mapInPandas(run, "n int").agg(F.max("n")).first()[0]:
            said.append("dates of unclear order were not compared")
    return said


def redact_documents(rows: DataFrame, layers: redact.Layers | None = None, document: str = "file", text: str = "text") -> DataFrame:
    """Both passes: layers by row, then the terms that a document revealed in all of its rows."""
    layers = layers or redact.Layers()
    made = redact.redact(rows, layers, (text,))
    if not (layers.clinical or layers.names):
        return made
    patterns = (redact.CLINICAL if layers.clinical else []) + (redact.HOSPITALS if layers.names else [])
    found = redact.document_terms(made, patterns, text, document, f"{text}_names" if layers.names else None)
    lower = redact.lowercase_words(rows, text, document) if layers.clinical else None
    return redact.propagate(made, found, lower, f"{text}_after", document, layers.token, layers.whitelist)
