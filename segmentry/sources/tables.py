"""Adapters: the driver's tables as monolingual and bilingual segments. Each is one narrow plan over its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of the documents: file, id, lang, line."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.where(F.trim("line") != "").select(F.col("doc_id").cast("string").alias("file"), (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), "lang", "line")


def monolingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("file", "id", F.lit("").alias("source_text"), F.col("line").alias("target_text"), "lang")


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sources; targets are deterministic edits chosen by id % 20; one source gets a word in camel case."""
    line, k = F.col("line"), F.col("id") % 20
    edits = {
        0: line, 1: F.lit(""), 2: F.replace(line, F.lit(" "), F.lit("  ")), 3: F.concat(line, F.lit("  ")), 4: F.translate(line, LOWER, UPPER), 5: F.regexp_replace(line, "[0-9]", ""),
        6: F.replace(line, F.lit("."), F.lit(",")), 7: F.replace(line, F.lit("e"), F.lit("€")), 8: F.replace(line, F.lit("."), F.lit("")), 9: F.concat(line, F.lit(" same same")),
        10: F.concat(line, F.lit(" mail ann@x.org http://a.example.com/x.")), 11: F.concat(line, F.lit(" {name} %s AB-1234")), 12: F.concat(line, F.lit(" (open [x)")),
        13: F.concat(line, F.lit(" NASA!! ?? ..")), 14: F.substring(line, F.lit(1), F.floor(F.length(line) / 4).cast("int")), 15: F.lower(line),
        16: F.concat(line, F.lit(" zero\u200bwidth")), 17: F.concat(line, F.lit(" p\u0430ypal")), 18: line, 19: F.concat(line, F.lit(" in 10-20 of 3:4 cases")),
    }
    target = F.lit(None).cast("string")
    for i, e in edits.items():
        target = F.when(k == i, e).otherwise(target)
    return lines(spark, sf_dir).select("file", "id", F.when(k == 18, F.concat(line, F.lit(" someCamelCase"))).otherwise(line).alias("source_text"), target.alias("target_text"), "lang")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turns that follow them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return rows.where("role = 'user' and r2 = 'assistant'").select(F.col("conv_id").cast("string").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("source_text"), F.col("t2").alias("target_text"))


def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document with the next one."""
    w = Window.partitionBy("file").orderBy("id")
    return lines(spark, sf_dir).select("file", "id", F.col("line").alias("source_text"), F.lead("line").over(w).alias("target_text")).where("target_text is not null")


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutated segments before and after the redaction of e-mail addresses."""
    from ..operators.dedup import TOKEN

    after = lambda c: F.when(F.contains(F.col(c), F.lit("@")), F.regexp_replace(c, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", TOKEN)).otherwise(F.col(c))
    rows = mutated(spark, sf_dir).select("file", F.col("id").alias("key"), F.col("source_text").alias("source_before"), F.col("target_text").alias("target_before"), after("source_text").alias("source_after"), after("target_text").alias("target_after"))
    return rows.withColumn("changed", (F.col("source_before") != F.col("source_after")) | (F.col("target_before") != F.col("target_after")))


#: Signs that XML cannot hold, and returns, which parsers change.
NOT_XML = "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as units of bilingual files: file, local_id (from 1), line (without signs that XML cannot hold)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", NOT_XML, "").alias("text"))
    kept = docs.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines")).where("size(lines) > 0")
    return kept.select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".tmx").otherwise(".xliff")).alias("file"), F.posexplode("lines").alias("pos", "line")).select("file", (F.col("pos") + 1).cast("long").alias("local_id"), "line")


def bilingual_files(spark: SparkSession, sf_dir: str, codes: bool = False) -> DataFrame:
    """Each document as one TMX or XLIFF file (file, content) whose units have the same line on both sides.

    The targets of units 4, 8, ... are missing, those of units 3, 7, ... empty tags, but for the first of a file. ``codes``:
    every side has a code after its first half and a bold run behind it, and no target is missing.
    """
    half = F.floor(F.length("line") / 2).cast("int")
    if codes:
        inside = F.concat(_xml(F.substring("line", F.lit(1), half)), F.lit('<ph id="1">{&lt;x&gt;}</ph><bpt i="2" ctype="bold">{b}</bpt>'), _xml(F.substr(F.col("line"), half + 1)), F.lit('<ept i="2">{/b}</ept>'))
    else:
        inside = _xml(F.col("line"))
    first = F.lit(codes) | (F.col("local_id") == 1)
    empty, missing = ~first & (F.col("local_id") % 4 == 3), ~first & (F.col("local_id") % 4 == 0)
    seg = F.concat(F.lit("<seg>"), inside, F.lit("</seg>"))
    variant = lambda lang, text: F.concat(F.lit(f'<tuv xml:lang="{lang}">'), text, F.lit("</tuv>"))
    tu = F.concat(F.lit("<tu>"), variant("en", seg), F.when(missing, "").otherwise(variant("es", F.when(empty, "<seg/>").otherwise(seg))), F.lit("</tu>"))
    target = F.when(missing, "").when(empty, '<target state="new"/>').otherwise(F.concat(F.lit("<target>"), inside, F.lit("</target>")))
    unit = F.concat(F.lit('<trans-unit id="'), F.col("local_id").cast("string"), F.lit('"><source>'), inside, F.lit("</source>"), target, F.lit("</trans-unit>"))
    rows = units(spark, sf_dir).withColumn("xml", F.when(F.col("file").endswith(".tmx"), tu).otherwise(unit))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local_id", "xml"))), lambda u: u["xml"]), "\n")
    files = rows.groupBy("file").agg(body.alias("body"))
    content = F.when(F.col("file").endswith(".tmx"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header srclang="en"/><body>\n'), "body", F.lit("\n</body></tmx>\n"))).otherwise(
        F.concat(F.lit('<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file source-language="en" target-language="es"><body>\n'), "body", F.lit("\n</body></file></xliff>\n")))
    return files.select("file", F.encode(content, "UTF-8").alias("content"))
