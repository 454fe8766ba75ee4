"""Reports as files. Tables are written by the tasks; only one page of a report is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import csv_lines, html_rows


def write_csv(flat: DataFrame, path: str, with_file: bool = True) -> None:
    csv_lines(flat, with_file).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', encoding="UTF-8")


def write_html(flat: DataFrame, path: str) -> None:
    """A folder of table rows as text, a line for each finding."""
    html_rows(flat).select("row").write.mode("overwrite").text(path)


def write_clean_tmx(kept: DataFrame, path: str, source_lang: str, target_lang: str) -> None:
    """Each task writes the units of its rows as one file's lines; ``kept`` has source, target and, if any, document_id."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    document = F.col("document_id") if "document_id" in kept.columns else F.lit(None).cast("string")
    prop = F.when(document.isNotNull(), F.concat(F.lit('<prop type="x-document">'), escape(document), F.lit("</prop>"))).otherwise("")
    unit = F.concat(F.lit("<tu>"), prop, F.lit(f'<tuv xml:lang="{source_lang}"><seg>'), escape(F.col("source")), F.lit(f'</seg></tuv><tuv xml:lang="{target_lang}"><seg>'), escape(F.col("target")), F.lit("</seg></tuv></tu>"))
    kept.select(F.regexp_replace(unit, "\n", " ").alias("value")).write.mode("overwrite").text(path)
