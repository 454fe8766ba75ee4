"""Issue tables: counts, pages, context, tag signatures, edits and a report's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape, safe_cell, whole
from ..schema import CATEGORIES, GROUPS, category_column


def by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category_id").agg(F.count("*").alias("n"), F.count_distinct("file", "id").alias("n_segments"))


def by_group(issues: DataFrame) -> DataFrame:
    """By group and severity, with subtotals (null)."""
    named = issues.select(category_column(F.col("category_id"), 1).alias("grp"), category_column(F.col("category_id"), 2).alias("severity"))
    return named.rollup("grp", "severity").agg(F.count("*").alias("n"))


def ranks(category: Column) -> tuple[Column, Column]:
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c[0], i)])[category]
    group = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c[0], GROUPS.index(c[1]))])[category]
    return group, rank


def report_order(issues: DataFrame) -> DataFrame:
    group, rank = ranks(F.col("category_id"))
    return issues.orderBy(group, rank, "file", "id", "span_source", "span_target")


def page(issues: DataFrame, number: int = 0, size: int = 50, category: str | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """One page of the issues, without ignored ones (file, id, category_id)."""
    shown = issues if category is None else issues.where(F.col("category_id") == category)
    if ignored is not None:
        shown = shown.join(ignored, ["file", "id", "category_id"], "left_anti")
    return shown.orderBy("file", "id", "category_id", "span_source", "span_target").offset(number * size).limit(size)


def context(segments: DataFrame, around: int = 2) -> DataFrame:
    """Ids and targets of the neighbours within a file."""
    w = Window.partitionBy("file").orderBy("id").rowsBetween(-around, around)
    return segments.select("file", "id", F.collect_list("id").over(w).alias("ids"), F.collect_list(whole(F.col("target_text"))).over(w).alias("texts"))


def signatures(issues: DataFrame) -> DataFrame:
    """Tag findings with equal missing and extra marks: one row for each, its number and its first segment."""
    tags = issues.where(F.col("category_id").isin("tag_count", "tag_order", "placeholders"))
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|")
    return tags.groupBy("category_id", join(F.col("span_source")).alias("missing"), join(F.col("span_target")).alias("extra")).agg(F.count("*").alias("n"), F.min(F.struct("file", "id")).alias("first")).select("category_id", "missing", "extra", "n", "first.file", "first.id")


def search(segments: DataFrame, text: str) -> DataFrame:
    """Segments that hold the text in any of their texts, without case."""
    columns = [c for c in ("source_text", "target_text", "source_before", "source_after", "target_before", "target_after") if c in segments.columns]
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(whole(F.col(c))), F.lit(text.lower()))
    return segments.where(found)


def segment_filter(ranges: str, column: str = "id") -> Column:
    """"1,5-9" as a predicate; parts that cannot be read are ignored, none readable: everything."""
    parts = [p.strip().partition("-") for p in ranges.split(",")]
    spans = [(int(a), int(b or a)) for a, dash, b in parts if a.strip().isdigit() and (not dash or b.strip().isdigit())]
    if not spans:
        return F.lit(True)
    chosen = F.lit(False)
    for a, b in spans:
        chosen = chosen | F.col(column).between(min(a, b), max(a, b))
    return chosen


def flattened(issues: DataFrame, segments: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """One line for each issue with its texts; ``edits`` (file, id, edited_target) mark and replace targets of untagged rows."""
    texts = segments.select("file", "id", "original_id", "source_text", "target_text", "has_tags")
    rows = issues.join(texts, ["file", "id"], "left")
    if edits is not None:
        rows = rows.join(edits.select("file", "id", "edited_target"), ["file", "id"], "left")
        use = F.col("edited_target").isNotNull() & ~F.coalesce("has_tags", F.lit(False))
        rows = rows.withColumn("is_edited", use).withColumn("target_text", F.when(use, F.col("edited_target")).otherwise(F.col("target_text"))).drop("edited_target")
    else:
        rows = rows.withColumn("is_edited", F.lit(False))
    return rows.orderBy("file", "id", "category_id", "span_source", "span_target")


def with_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments as a repeated run would see them: edited targets in place, tagged rows as they are."""
    chosen = edits.select("file", "id", F.col("edited_target").alias("_e"))
    joined = segments.join(chosen, ["file", "id"], "left")
    new = F.when(~F.coalesce("has_tags", F.lit(False)), F.col("_e"))
    texts = ("target_text", "target_glossary", "target_raw", "target_display", "target_edges")
    return joined.select(*[F.coalesce(new, F.col(c)).alias(c) if c in texts else F.col(c) for c in segments.columns])


def csv_lines(flat: DataFrame, with_file: bool = True) -> DataFrame:
    """Text cells that no spreadsheet takes for a formula, in a report's columns."""
    join = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " | ")
    cells = [F.col("file")] * with_file + [F.col("id").cast("string").alias("segment"), F.col("category_id"), F.col("severity"), whole(F.col("source_text")).alias("source"), whole(F.col("target_text")).alias("target"),
                                           join("span_source").alias("span_source"), join("span_target").alias("span_target"), whole(F.col("note")).alias("note")]
    names = ["file"] * with_file + ["segment", "category_id", "severity", "source", "target", "span_source", "span_target", "note"]
    return flat.select(*[safe_cell(c).alias(n) for c, n in zip(cells, names)])


def html_rows(flat: DataFrame) -> DataFrame:
    """Table rows with the listed spans of the target marked wherever they occur."""
    from ..functions.text import quoted

    spans = F.filter(F.coalesce("span_target", F.array().cast("array<string>")), lambda s: s != "")
    pattern = F.array_join(F.transform(spans, lambda s: quoted(html_escape(s))), "|")
    target = html_escape(whole(F.col("target_text")))
    marked = F.when(F.size(spans) > 0, F.regexp_replace(target, pattern, F.lit("<mark>$0</mark>"))).otherwise(target)
    return flat.select("file", "id", F.concat(F.lit("<tr><td>"), F.col("id").cast("string"), F.lit("</td><td>"), F.col("category_id"), F.lit("</td><td>"), html_escape(whole(F.col("source_text"))), F.lit("</td><td>"), marked, F.lit("</td></tr>")).alias("row"))
