"""Queries that change files: each document becomes a TMX or XLIFF file, is changed as a file, and is read again."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import marked_words
from ..operators import pairing
from ..operators.dedup import TOKEN
from ..sources import spliced, tables, xlsx
from ..sources.bilingual import checked, inspected, rows_of


#: E-mail addresses without regard to what is beside them, as the SQL beside says them too.
ADDRESS = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


def read_contents(files: DataFrame) -> DataFrame:
    """(file, local_id, source_text, target_text, target_display) of files that are rows (file, content); texts as they stand."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, made = ["file", "local_id", "source_text", "target_text", "target_display"], []
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                made += [(name, r["local_id"], r["source"][1], r["target"][1], r["target"][2]) for r in rows_of(name, bytes(content))]
                # a frame for each small file would cost more than the file
                if len(made) >= 2_000:
                    yield pd.DataFrame(made, columns=columns)
                    made = []
        yield pd.DataFrame(made, columns=columns)

    return files.select("file", "content").mapInPandas(parse, "file string, local_id long, source_text string, target_text string, target_display string")


def fl_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a run before it: format, languages, units, and where their ids begin."""
    return checked(inspected(tables.bilingual_files(spark, sf)))


def _edits(units: DataFrame) -> DataFrame:
    """Every third unit's target: its line in capitals, with signs that need escaping."""
    capitals = F.translate("line", tables.LOWER, tables.UPPER)
    return units.where("local_id % 3 = 0").select("file", "local_id", F.concat(F.lit("<"), capitals, F.lit(" & \"é\">")).alias("text"))


def fl_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Edited targets in the files that were written; units without an edit are as they were."""
    made = spliced.corrected(tables.bilingual_files(spark, sf), _edits(tables.units(spark, sf)))
    return read_contents(made.where("error is null")).select("file", "local_id", "source_text", "target_text")


def _redacted(units: DataFrame) -> DataFrame:
    # a line without the sign holds no address, and is not tried at each of its characters
    without = F.when(F.contains("line", F.lit("@")), F.regexp_replace("line", ADDRESS, TOKEN)).otherwise(F.col("line"))
    after = F.regexp_replace(without, "[0-9]{2,}", TOKEN)
    return units.select("file", "local_id", after.alias("source_text"), after.alias("target_text"))


def fl_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted texts inside files with codes: both sides' new texts, and whether the target still has its codes."""
    made = spliced.rewritten(tables.bilingual_files(spark, sf, codes=True), _redacted(tables.units(spark, sf)))
    return read_contents(made.where("error is null")).select(
        "file", "local_id", "source_text", "target_text", (F.size(F.regexp_extract_all("target_display", F.lit("\\[1\\]\\[2\\]"), F.lit(0))) == 1).alias("has_codes"))


def fl_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Originals and redacted units paired by number; every second redacted unit gets its text back."""
    before = tables.units(spark, sf).select("file", "local_id", F.col("line").alias("source_text"), F.col("line").alias("target_text"))
    previews = pairing.paired(before, _redacted(tables.units(spark, sf)))
    back = pairing.restored(previews, previews.where("changed and local_id % 2 = 0"))
    return back.where("changed or restored").select("file", "local_id", "target_after", "changed", "restored")


def rp_word_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted lines before and after, with the words that differ marked."""

    @F.pandas_udf("struct<before:string,after:string>")
    def mark(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marked_words(x, y) for x, y in zip(a, b)], columns=["before", "after"])

    rows = tables.previews(spark, sf).where("changed")
    return rows.withColumn("m", mark("target_before", "target_after")).select(F.col("key").alias("id"), F.col("m.before").alias("marked_before"), F.col("m.after").alias("marked_after"))


def fl_workbook(spark: SparkSession, sf: str) -> DataFrame:
    """Findings written as workbooks and read again; texts as digests, as some lines are longer than a cell may be."""
    from ..operators import reports
    from ..schema import segments
    from .queries import issues

    flat = reports.flattened(issues(spark, sf), segments(tables.mutated(spark, sf)))
    books = xlsx.workbooks(flat.select(F.col("id").alias("segment"), "category_id", "severity", F.md5("source_text").alias("source_md5"), F.md5("target_text").alias("target_md5")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = bytes(content)
                for sheet in range(xlsx.sheet_count(data)):
                    rows = xlsx.each_row(data, sheet)
                    head = next(rows)
                    while piece := list(itertools.islice(rows, 20_000)):
                        yield pd.DataFrame(piece, columns=head).astype({"segment": "int64"})

    return books.mapInPandas(parse, "segment long, category_id string, severity string, source_md5 string, target_md5 string").select(F.col("segment").alias("id"), "category_id", "source_md5", "target_md5")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fl_files": fl_files, "fl_corrected": fl_corrected, "fl_rewritten": fl_rewritten, "fl_restored": fl_restored, "rp_word_diff": rp_word_diff, "fl_workbook": fl_workbook,
}

_UNITS = r"""units as (
  select doc_id::varchar || case when doc_id % 2 = 0 then '.tmx' else '.xliff' end as file, unnest(lines) as line, generate_subscripts(lines, 1)::bigint as local_id from (
    select doc_id, list_filter(string_split(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', '', 'g'), chr(10)), lambda x: trim(x) <> '') as lines from documents))"""
_AFTER = f"regexp_replace(regexp_replace(line, '{ADDRESS}', '{TOKEN}', 'g'), '[0-9]{{2,}}', '{TOKEN}', 'g')"

ORACLE_SQL: dict[str, str] = {
    "fl_files": f"""with {_UNITS}, counted as (select file, count(*) as units from units group by file)
select file, case when file like '%.tmx' then 'tmx' else 'xliff' end as format, 'en' as source_lang, 'es' as target_lang, units,
  cast(coalesce(sum(units) over (order by file rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from counted""",
    "fl_corrected": f"""with {_UNITS}
select file, local_id, line as source_text, case when local_id % 3 = 0 then '<' || translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' & "é">'
    when local_id > 1 and local_id % 4 in (0, 3) then '' else line end as target_text
from units where file in (select file from units where local_id = 3)""",
    "fl_rewritten": f"""with {_UNITS}
select file, local_id, {_AFTER} as source_text, {_AFTER} as target_text, true as has_codes from units""",
    "fl_restored": f"""with {_UNITS}
select file, local_id, case when local_id % 2 = 0 then line else {_AFTER} end as target_after, local_id % 2 = 1 as changed, local_id % 2 = 0 as restored
from units where line <> {_AFTER}""",
}
