"""Duplicate sections and the cleaning funnel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import similarity
from ..functions.arrays import let, settled
from ..functions.text import has_words, strip, whole, words
from .similarity import accepted_leaders, leaders, similar_pairs

TOKEN = "███"
INLINE = "(?i)</?(?:ph|bpt|ept|it|x|bx|ex|g|hi|ut|mrk)(?:\\s+[^<>]*?)?\\s*/?>"
SIGNS_ONLY = "^[\\d\\s\\-.,;:!?¿¡()\\[\\]{}/\\\\|@#$%^&*+=<>~`\"'°ºª•–—…]+$"


def plain(c: Column) -> Column:
    """Without serialised inline codes."""
    return strip(let(whole(c), lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, INLINE, "")).otherwise(x)))


def consolidated(c: Column, token: str = TOKEN) -> Column:
    """Runs of tokens that only marks, blanks or brackets part become one token."""
    t = "\\Q" + token + "\\E"
    runs = f"{t}(?:\\s*[,;.\\-–—/|]\\s*{t}|\\s+{t}|\\s*\\(\\s*{t}\\s*\\))+"
    return let(c, lambda x: F.when(F.contains(x, F.lit(token)), F.regexp_replace(x, runs, token)).otherwise(x))


def word_count(c: Column) -> Column:
    return F.size(words(plain(c)))


def is_junk(min_words: int = 2, source: str = "source_before", target: str = "target_before") -> Column:
    """Both sides empty, or a side that is signs and digits only or has too few words."""
    s, d = strip(whole(F.col(source))), strip(whole(F.col(target)))
    poor = lambda c: let(plain(c), lambda p: (p != "") & (p.rlike(SIGNS_ONLY) | ~has_words(p, min_words)))
    return ((s == "") & (d == "")) | poor(s) | poor(d)


def final_texts(previews: DataFrame, token: str = TOKEN) -> DataFrame:
    """Add source and target as they would be kept."""
    pick = lambda side: consolidated(plain(strip(whole(F.when(F.col("changed"), F.col(f"{side}_after")).otherwise(F.col(f"{side}_before"))))), token)
    return settled(previews, {"source": pick("source"), "target": pick("target")})


def left_short(min_words: int, token: str = TOKEN) -> Column:
    """Whether no side has as many words without the tokens."""
    side = lambda s: has_words(plain(F.replace(whole(F.coalesce(f"{s}_after", f"{s}_before")), F.lit(token), F.lit(" "))), min_words)
    return ~side("source") & ~side("target")


def redacted_share(token: str = TOKEN) -> Column:
    """Percent of a side's characters that went, the larger of the two."""
    def side(s: str) -> Column:
        before, after = whole(F.col(f"{s}_before")), whole(F.col(f"{s}_after"))
        return F.when(before == "", 0.0).otherwise((1 - F.length(F.replace(after, F.lit(token), F.lit(""))) / F.greatest(F.length(before), F.lit(1))) * 100)

    return F.greatest(side("source"), side("target"))


def same_source_groups(rows: DataFrame) -> DataFrame:
    """Each row of a source that occurs twice: section identical (one target) or conflict, and whether it is kept (the first)."""
    # digests of 256 bits stand for the texts, so that groups are summed before the shuffle and no text is sorted
    rows = settled(rows, {"_s": F.sha2("source", 256)})
    marks = [F.xxhash64("target"), F.xxhash64(F.reverse("target"), "target")]
    same = [f(m).alias(f"_{f.__name__}{i}") for i, m in enumerate(marks) for f in (F.min, F.max)]
    groups = rows.groupBy("_s").agg(F.count("*").alias("n"), *same, F.min("key").alias("first")).where("n > 1")
    joined = rows.join(groups, "_s")
    identical = (F.col("_min0") == F.col("_max0")) & (F.col("_min1") == F.col("_max1"))
    return joined.select("key", "source", "target", F.when(identical, "identical").otherwise("conflict").alias("section"), "n", (F.col("key") == F.col("first")).alias("kept"))


def source_variants(rows: DataFrame, threshold: float = 0.85, most_alike: float = 1.0) -> DataFrame:
    """Clusters of similar sources among sources that occur once: (key, leader), leaders in key order.

    ``most_alike`` below 1 keeps only clusters in which a member's target is alike its leader's to that degree at most
    (popular characters of long targets begin no match); the sources of others stay free for later leaders.
    """
    single = rows.groupBy("source").agg(F.count("*").alias("n"), F.min("key").alias("id"), F.min("target").alias("target")).where("n = 1").select("id", F.col("source").alias("text"), "target")
    pairs = similar_pairs(single.select("id", "text"), threshold)
    if most_alike >= 1:
        return leaders(pairs).select(F.col("member").alias("key"), "leader")

    @F.pandas_udf("boolean")
    def differs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x or "", y or "") <= most_alike for x, y in zip(a, b)])

    target = lambda k: single.select(F.col("id").alias(k), F.col("target").alias(f"target_{k}"))
    judged = pairs.select("a", "b").join(target("a"), "a").join(target("b"), "b").select("a", "b", differs("target_a", "target_b").alias("differs"))
    return accepted_leaders(judged).select(F.col("member").alias("key"), "leader")


def funnel(previews: DataFrame, discarded: DataFrame | None = None, min_words_junk: int = 2, min_words: int = 5, most_redacted: float = 50.0, token: str = TOKEN) -> DataFrame:
    """Each row with the first reason that excludes it (null: kept), its final texts and its share of redaction.

    Order: junk, no_anon (column no_anon, if any), short, empty, heavy, dedup (keys in ``discarded``).
    """
    made = final_texts(previews, token)
    no_anon = F.coalesce(F.col("no_anon"), F.lit(False)) if "no_anon" in previews.columns else F.lit(False)
    has_token = F.contains(whole(F.col("source_after")), F.lit(token)) | F.contains(whole(F.col("target_after")), F.lit(token))
    reason = (
        F.when(is_junk(min_words_junk), "junk").when(no_anon, "no_anon").when(left_short(min_words, token), "short")
        .when((F.col("source") == "") | (F.col("target") == ""), "empty").when(has_token & (redacted_share(token) >= most_redacted), "heavy"))
    # found before the join, so that no text travels that is not asked for
    made = settled(made, {"reason": reason}).withColumn("redacted_percent", redacted_share(token))
    if discarded is not None:
        made = made.join(discarded.select(F.col("key").alias("_gone")).distinct(), F.col("key") == F.col("_gone"), "left")
        made = made.withColumn("reason", F.coalesce("reason", F.when(F.col("_gone").isNotNull(), "dedup"))).drop("_gone")
    return made


def document_id(existing: Column) -> Column:
    """An id in canonical form stays; any other becomes doc- and 16 digits of its SHA-256."""
    return F.when(existing.rlike("^doc-[0-9a-f]{16}$"), existing).otherwise(F.concat(F.lit("doc-"), F.left(F.sha2(existing, 256), F.lit(16))))


def metrics(funnelled: DataFrame) -> DataFrame:
    """By file and in total (file null): rows, kept, each reason, and the percentage kept."""
    reasons = ("junk", "no_anon", "short", "empty", "heavy", "dedup")
    return funnelled.rollup("file").agg(
        F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("kept"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
        F.count_if(F.col("changed")).alias("changed_rows")).withColumn("retention_percent", F.round(F.col("kept") * 100.0 / F.col("raw"), 2))
