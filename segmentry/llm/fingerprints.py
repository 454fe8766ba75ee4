"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the ``K`` least distinct XXH64 values (as signed longs) of a text's shingles: five
words joined by blanks (fewer words: the whole sequence; none: no shingle). The K least values of a union are among the
K least of its parts, so sketches of parts merge exactly (``merge_sketches`` for two, ``sketches_by`` for groups).

From two sketches: resemblance (Jaccard) is the share of common values among the K least of their union; two texts
without shingles have resemblance 1, one without and one with have 0. Distinct shingles: exact below K values, else
(K - 1) divided by the K-th value's rank in the range of hashes. Containment: resemblance times the estimated size of
the union, divided by the first one's size.

The string form is the base64 text of the values as big-endian bytes, so equal texts have equal fingerprints.

Edge cases: null texts count as empty; repeated rows and ids are kept as rows (ordered by id, then text); a null id
comes first; one row alone is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
#: Rows in a range of ids that one task orders, about, and the most ranges.
ROWS_IN_RANGE = 10_000
MOST_RANGES = 20_000
SPACE = 2.0**64


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Ascending array of the k least distinct shingle hashes."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    several = F.regexp_extract_all(flat, F.lit(rf"(?<!\S)(?=(\S+(?: \S+){{{words - 1}}})(?!\S))\S"), F.lit(1))
    shingles = F.when(flat == "", F.array().cast("array<string>")).when(
        F.length(flat) - F.length(F.replace(flat, F.lit(" "))) < words - 1, F.array(flat)
    ).otherwise(several)
    return F.slice(F.array_sort(F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s)))), 1, k)


def merge_sketches(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def sketches_by(parts: DataFrame, by: list[str], sketch_column: str, k: int = K) -> DataFrame:
    """The sketch of each group's parts, in two rounds of ranks over single values: no group's parts are gathered.

    ``by`` columns and ``sketch_column``; a group whose parts are all empty has an empty sketch. Values are distinct
    before they are ranked, and salted shares of a group are cut to k values before they meet.
    """
    values = parts.select(*by, F.explode_outer(sketch_column).alias("_h")).distinct()
    share = Window.partitionBy(*by, F.pmod("_h", F.lit(64))).orderBy("_h")
    few = values.withColumn("_n", F.row_number().over(share)).where(F.col("_n") <= k)
    return few.groupBy(*by).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias(sketch_column))


def distinct_shingles(a: Column, k: int = K) -> Column:
    rank = (F.element_at(a, k).cast("double") + F.lit(SPACE / 2)) / F.lit(SPACE)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / rank)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merge_sketches(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has too."""
    share = resemblance(a, b, k) * distinct_shingles(merge_sketches(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_text(a: Column) -> Column:
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\r\n", "")


def _ranges(docs: DataFrame, key: str) -> list[int]:
    """Least keys of ranges of about equal numbers of rows; at most ``MOST_RANGES`` numbers come to the driver."""
    rows = docs.agg(F.count("*")).first()[0]
    wanted = max(1, min(MOST_RANGES, rows // ROWS_IN_RANGE))
    steps = [i / wanted for i in range(wanted)]
    found = docs.agg(F.percentile_approx(key, steps, 100 * wanted)).first()[0] or []
    return sorted(set(found))


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with the row that follows in ascending key order (the first after the last), as next_<column>.

    Rows are dealt out by ranges of keys. The first rows of a range also go to the range before, as guests, so that a
    window over each range alone sees every successor; no task orders all rows.
    """
    starts = _ranges(docs, key)
    ids = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    bounds = F.array(*[F.lit(s).cast("long") for s in starts])
    placed = docs.withColumn("_range", _spot(ids, bounds, len(starts)))
    firsts = {r[0]: r[1] for r in placed.groupBy("_range").agg(F.min(F.coalesce(key, F.lit(-(1 << 63))))).collect()}
    order = sorted(firsts)
    # a range's number tells its place in this list, and its first key the range before (the last one before the first)
    number = F.col("_range") - 1
    begins, before = (F.array(*[F.lit(v.get(r)).cast("long") for r in range(1, max(order, default=0) + 1)]) for v in (firsts, {r: order[i - 1] for i, r in enumerate(order)}))
    guest = F.when(F.get(begins, number) == ids, F.get(before, number).cast("int"))
    homes = F.array_compact(F.array(
        F.struct("_range", F.lit(0).alias("guest")),
        F.when(guest.isNotNull(), F.struct(guest.alias("_range"), F.lit(1).alias("guest"))),
    ))
    dealt = placed.withColumn("_home", F.explode(homes)).withColumn("_range", F.col("_home._range")).withColumn("_guest", F.col("_home.guest")).drop("_home")
    window = Window.partitionBy("_range").orderBy("_guest", F.asc_nulls_first(key), *columns)
    return dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])


def _spot(ids: Column, bounds: Column, n: int) -> Column:
    """Binary search: how many of the ascending bounds are at most the id, one at least."""
    steps = F.array(*[F.lit(1 << s) for s in range(n.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= ids), at + s).otherwise(at))
    return F.greatest(F.lit(1), found)


def edited(text: Column, after: Column) -> Column:
    """The last quarter (rounded down) of the code points replaced by as many first ones of the next text."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(after, F.lit(1), cut))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near the edited and the next text are."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = with_next(base, "doc_id", ["text"])
    drawn = placed.withColumn("edited_text", edited(F.col("text"), F.col("next_text"))).select(
        "doc_id", "text", "_range", "_guest", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("a"), sketch(F.col("edited_text"), k).alias("b"),
    )
    window = Window.partitionBy("_range").orderBy("_guest", F.asc_nulls_first("doc_id"), "text")
    both = drawn.withColumn("c", F.lead("a").over(window)).where("_guest = 0")
    return both.select(
        F.col("doc_id").alias(key), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("c"), k).alias("near_next"), distinct_shingles(F.col("a"), k).alias("n_shingles"),
        containment(F.col("a"), F.col("b"), k).alias("contained_in_edited"),
    )
