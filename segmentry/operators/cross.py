"""Checks across segments: consistency, hyphenation, majorities. Groups are summed, never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import settled
from ..functions.text import SPACE, WORD, collapse, find_all, strip, whole
from ..plans.durable import durable
from .checks import NUMBER

DATE = "(?<![\\p{L}\\p{N}_])[0-9]{1,4}([/.\\-])[0-9]{1,2}\\1[0-9]{2,4}(?![\\p{L}\\p{N}_])"


def derived(segments: DataFrame) -> DataFrame:
    """id with sn, tn (white space collapsed) and sl, tl (stripped lengths)."""
    s, d = whole(F.col("source_text")), whole(F.col("target_text"))
    return segments.select("file", "id", collapse(s).alias("sn"), collapse(d).alias("tn"), F.length(strip(s)).alias("sl"), F.length(strip(d)).alias("tl"))


#: What consistency findings carry besides the finding itself.
CONSISTENCY = ("file", "id", "kind", "mismatch_axis", "reference_id", "reference_file", "reference_source", "reference_target", "sibling_ids", "group_size", "note")


def consistency_findings(segments: DataFrame, threshold: float = 1.0, min_chars: int = 8) -> DataFrame:
    """Every segment that disagrees with an earlier one, with its reference: columns ``CONSISTENCY``.

    Exact kinds (equal source or equal target, the other side differs) refer to the least id of their group; below a
    threshold of 1 fuzzy kinds follow, between the representatives of classes of equal pairs. A pair of segments is found
    by one kind only: exact kinds share a side, fuzzy ones share none. Groups are formed by digests; the texts, stripped,
    are looked up by id for the references of findings only.
    """
    base = segments.select("file", "id", strip(whole(F.col("source_text"))).alias("s"), strip(whole(F.col("target_text"))).alias("t"))
    keys = durable(_keys(segments))
    parts = []
    for axis in ("target", "source"):
        parts.append(_disagreeing(keys, axis, min_chars).select("file", "id", F.lit(f"exact-{axis}").alias("kind"), F.lit(axis).alias("mismatch_axis"), "reference_id", "group_size"))
    first = base.select(F.col("id").alias("reference_id"), F.col("file").alias("reference_file"), F.col("s").alias("reference_source"), F.col("t").alias("reference_target"))
    exact = parts[0].union(parts[1]).join(first, "reference_id")
    parts = [exact.select("file", "id", "kind", "mismatch_axis", "reference_id", "reference_file", "reference_source", "reference_target", "group_size")]
    if threshold < 1:
        from .similarity import fuzzy_consistency

        pairs = fuzzy_consistency(segments, max(0.5, threshold), min_chars)
        first = base.select(F.col("id").alias("a"), F.col("file").alias("reference_file"), F.col("s").alias("reference_source"), F.col("t").alias("reference_target"))
        found = pairs.join(first, "a").join(base.select(F.col("id").alias("b"), "file"), "b")
        parts.append(found.select("file", F.col("b").alias("id"), "kind", F.substring_index("kind", "-", -1).alias("mismatch_axis"), F.col("a").alias("reference_id"), "reference_file", "reference_source", "reference_target", F.lit(2).cast("long").alias("group_size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    note = F.concat(F.lit("Consistency ("), "kind", F.lit("): compare with segment "), F.col("reference_id").cast("string"), F.lit("; group size "), F.col("group_size").cast("string"), F.lit("."))
    return out.withColumns({"sibling_ids": F.array("reference_id", "id"), "note": note}).select(*CONSISTENCY)


def _keys(segments: DataFrame) -> DataFrame:
    """file, id, digests of 256 bits of both texts with white space collapsed (sk, tk), stripped lengths (sl, tl)."""
    s, d = strip(whole(F.col("source_text"))), strip(whole(F.col("target_text")))
    digest = lambda c: F.unhex(F.sha2(F.regexp_replace(c, f"{SPACE}+", " "), 256))
    return settled(segments.select("file", "id", s.alias("s"), d.alias("t")), {"sk": digest(F.col("s")), "tk": digest(F.col("t")), "sl": F.length("s"), "tl": F.length("t")}).drop("s", "t")


def _disagreeing(keys: DataFrame, axis: str, min_chars: int) -> DataFrame:
    """(file, id, reference_id, group_size) of rows that share a text with an earlier row and differ in the other one."""
    same, other, size = ("sk", "tk", "sl") if axis == "target" else ("tk", "sk", "tl")
    groups = keys.where(f"sl > 0 and tl > 0 and {size} >= {min_chars}").groupBy(same).agg(F.min(F.struct("id", other)).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = keys.join(groups, same).where((F.col("id") > F.col("first.id")) & (F.col(other) != F.col(f"first.{other}")))
    return later.select("file", "id", F.col("first.id").alias("reference_id"), F.col("n").alias("group_size"))


def exact_consistency(segments: DataFrame, axis: str = "target", min_chars: int = 8, texts: bool = True) -> DataFrame:
    """Rows whose source (axis "target") occurred before with another target; the reference is the least id of the group.

    The group is formed by rows with both texts and enough length; rows with an empty other side are reported too, as
    they differ from the reference. Axis "source" swaps the sides. Without ``texts`` none is looked up.
    """
    found = _disagreeing(durable(_keys(segments)), axis, min_chars).withColumn("mismatch_axis", F.lit(axis))
    if not texts:
        return found
    same, other = ("sn", "tn") if axis == "target" else ("tn", "sn")
    rows = derived(segments)
    own, first = rows.select("id", F.col(same).alias("common_text"), F.col(other).alias("text")), rows.select(F.col("id").alias("reference_id"), F.col(other).alias("reference_text"))
    return found.join(own, "id").join(first, "reference_id").select("file", "id", "reference_id", "group_size", "mismatch_axis", "common_text", "text", "reference_text")


def hyphenation(segments: DataFrame) -> DataFrame:
    """Plain words that another segment writes with a hyphen; the reference is the first segment that does so."""
    text = whole(F.col("target_text"))
    hyphened = segments.select("id", F.posexplode(find_all(text, "\\p{L}{2,}(?:-\\p{L}{2,})+")).alias("pos", "token")).withColumn("norm", F.lower(F.replace("token", F.lit("-"), F.lit("")))).where("length(norm) >= 6")
    plain = segments.select("id", F.posexplode(find_all(text, "\\p{L}{4,}")).alias("pos", "token")).where("length(token) >= 6").withColumn("norm", F.lower("token"))
    first = hyphened.groupBy("norm").agg(F.min(F.struct("id", "pos", "token")).alias("h"))
    words = plain.groupBy("norm", "id").agg(F.min(F.struct("pos", "token")).alias("p"))
    both = words.join(first, "norm").join(hyphened.select("norm", "id").distinct(), ["norm", "id"], "left_anti")
    return both.select("norm", F.least("id", "h.id").alias("reference_id"), F.greatest("id", "h.id").alias("id"), F.col("h.token").alias("hyphenated"), F.col("p.token").alias("plain"))


def date_signs(text: Column) -> Column:
    """Structs (sign, raw) of date-like tokens."""
    return F.transform(find_all(text, DATE), lambda d: F.struct(F.regexp_extract(d, "[/.\\-]", 0).alias("sign"), d.alias("raw")))


def number_signs(text: Column) -> Column:
    """Structs (sign, raw) of numbers whose decimal sign is certain; dates are left out."""
    plain = F.regexp_replace(text, DATE, " ")

    def sign(t: Column) -> Column:
        last = F.regexp_extract(t, "([.,])[0-9]+$", 1)
        digits = F.length(F.regexp_extract(t, "[.,]([0-9]+)$", 1))
        return F.when(last == "", None).when((t.contains(".") & t.contains(",")) | (digits != 3), last)

    return F.filter(F.transform(find_all(plain, NUMBER), lambda t: F.struct(sign(t).alias("sign"), t.alias("raw"))), lambda x: x["sign"].isNotNull())


def convention_majority(segments: DataFrame, mode: str = "date") -> DataFrame:
    """Segments with tokens of a minority convention. Without a strict winner among two kinds at least: none."""
    signs = date_signs if mode == "date" else number_signs
    tokens = segments.select("file", "id", signs(whole(F.col("target_text"))).alias("t")).where("size(t) > 0")
    counts = tokens.select(F.explode("t.sign").alias("sign")).groupBy("sign").count()
    # a handful of signs at most: the patterns allow three
    top = counts.groupBy().agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "sign")), asc=False), 1, 2).alias("top")).where("size(top) = 2 and top[0].count > top[1].count").select(F.col("top")[0]["sign"].alias("majority"))
    return tokens.crossJoin(F.broadcast(top)).select("file", "id", "majority", F.transform(F.filter("t", lambda x: x["sign"] != F.col("majority")), lambda x: x["raw"]).alias("span_target")).where("size(span_target) > 0")
