"""Benchmark decontamination with DataFrame functions only.

A-Z are lower-cased; words are runs of 0-9, a-z and non-ASCII characters. The benchmark's windows (10 consecutive words of
an item; all words of a shorter one) are a hash set that is broadcast, in blocks of at most ``MOST_SENT`` bytes, so a
benchmark of any size is covered. Training texts are cut into stretches of words, each stretch into its windows of every
length that the benchmark has; a window meets the set by its words' hashes, and a hit is verified word by word. All hits of
one text are gathered (sums in the map tasks first: copies of a text send one row a task), which is bounded by the text.

``hits`` has one row for each distinct text with a hit; ``judge`` joins them to the documents, texts with very many copies
dealt out; ``clean`` removes the hit spans, or the whole documents.

Edge cases: null, empty and wordless texts have no words and no hits; wordless or null items have no windows; items of a
null id have windows, but are no items to list (``n_hit`` counts them); equal items, equal ids and equal rows count once as items and
each as rows; very long texts go through in stretches; empty tables give no hits; extra columns pass through, those
with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LEAST_HOT, durable, join_uneven, spare

WINDOW = 10
#: Bytes of windows that a task holds at a time.
MOST_SENT = 32 << 20
#: Words that are cut into windows at a time.
STRETCH = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, capitals counting as letters; a word's signs; and what may stand before it.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD, NO_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def split_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def words_of(text: Column) -> Column:
    """Words with A-Z in small letters; for a text of ASCII only, ``lower`` says the same and is faster."""
    return split_of(F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)))


def hash_of(each: str, first: str, k: int) -> str:
    """The hash of k words from one on, by their hashes; what is beyond the array does not count."""
    return f"xxhash64({', '.join(f'get({each}, {first} + {j})' for j in range(k))})"


def key_of(text: Column) -> Column:
    """Names a text: 128 bits, the same for null and empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """hash, window (its words joined by blanks), k (words), items (sorted ids as strings) for each distinct window."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where("size(words) > 0")
    cut = rows.select("item", F.least(F.size("words"), F.lit(window)).alias("k"), "words").select(
        "item", "k", F.explode(F.expr("transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))")).alias("window"))
    return cut.groupBy("k", "window").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.expr(hash_of("transform(window, w -> xxhash64(w))", "0", window)).alias("hash"), F.array_join("window", " ").alias("window"), "k", "items")


def _windows(docs: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """key, at (number of the first word), k, hash, words (of the stretch), i (the window's place there) of all of the texts' windows of these lengths.

    What is exploded is a plain column of word hashes, so that the explosion, the windows' hashes and the join behind them
    are one compiled loop in which nothing is copied; ``inline`` keeps the words' hashes from being worked out anew.
    """
    longest = max(lengths)
    words = docs.select(key_of(F.col(text)).alias("key"), words_of(F.col(text)).alias("words"))
    # outer explosions, as the others would look into each array twice
    stretches = words.select("key", F.posexplode_outer(F.expr(f"transform(sequence(1, greatest(1, size(words)), {STRETCH}), b -> slice(words, b, {STRETCH + longest - 1}))")).alias("number", "words"))
    hashed = stretches.select("key", "number", F.inline_outer(F.array(F.struct("words", F.transform("words", lambda w: F.xxhash64(w)).alias("each")))))
    placed = hashed.select("key", "number", "words", "each", F.posexplode_outer("each").alias("place", "first")).where(f"place < {STRETCH}")
    one = lambda k: F.when(F.col("place") + k <= F.size("each"), F.expr(hash_of("each", "place", k)))
    if len(lengths) == 1:
        made = placed.withColumn("k", F.lit(lengths[0])).withColumn("hash", one(lengths[0]))
    else:
        made = placed.select("key", "number", "words", "place", F.inline_outer(F.array(*[F.struct(F.lit(k).alias("k"), one(k).alias("hash")) for k in lengths])))
    return made.select("key", (F.col("number") * STRETCH + F.col("place")).alias("at"), "k", "hash", "words", (F.col("place") + 1).alias("i"))


def hits(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """key, spans (distinct hits: first and past-the-last word, in order), n_hit (words hit), items (sorted): one row for each distinct text with a hit."""
    windows = durable(windows)
    sizes = windows.groupBy("k").agg(F.sum(F.length("window") + F.size("items") * 24 + 64).alias("bytes")).collect()
    blocks = max(1, -(-sum(r["bytes"] for r in sizes) // MOST_SENT))
    lengths = sorted(r["k"] for r in sizes) or [WINDOW]
    found = None
    for i in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod("hash", F.lit(blocks)) == i)
        sent = F.broadcast(block.select("hash", "window", F.col("k").alias("size"), "items"))
        # said so that it is looked at for equal hashes only, and not a key of the join
        same = "k = size and instr(array_join(slice(words, i, k), ' '), window) = 1 and length(array_join(slice(words, i, k), ' ')) - length(window) = 0"
        met = _windows(docs, text, lengths).join(sent, "hash").where(same)
        own = met.groupBy("key").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("k")).alias("end"))).alias("spans"), F.collect_set("items").alias("items"))
        if blocks > 1:
            own = durable(own)
        found = own if found is None else found.union(own)
    if blocks > 1:
        found = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    # words before ``till`` are counted already
    counted = """aggregate(spans, named_struct('till', 0L, 'n', 0L), (done, s) -> named_struct(
        'till', greatest(done.till, s.end), 'n', done.n + greatest(0L, s.end - greatest(s.at, done.till))), done -> done.n)"""
    return found.select("key", F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")).select(
        "key", "spans", F.expr(counted).alias("n_hit"), "items")


def runs(found: DataFrame) -> DataFrame:
    """key, runs: the spans of each text with overlapping and adjoining ones merged, in order."""
    spans = found.select("key", F.explode("spans").alias("s")).select("key", "s.at", "s.end")
    before = Window.partitionBy("key").orderBy("at", "end")
    begun = spans.withColumn("new", F.coalesce(F.col("at") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("long"))
    numbered = begun.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("key", "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    return merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("runs"))


def _joined(keyed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows with a ``key`` and the columns of ``found``; texts with very many copies are dealt out."""
    counts = keyed.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LEAST_HOT)
    return join_uneven(keyed, durable(found.withColumnRenamed("key", key)), key, durable(counts), "left")


def judge(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without their text, with n_words, n_hit, items (ids as strings, sorted), spans (of words, from 0) and contaminated."""
    results = {"n_words", "n_hit", "items", "spans", "contaminated"}
    found = hits(docs, benchmark_windows(items, item_id, item_text, window), text)
    others = [c for c in docs.columns if c.lower() not in results | {text.lower()}]
    (key,) = spare(docs, "key")
    light = docs.select(*(f"`{c}`" for c in others), F.size(split_of(F.col(text))).cast("long").alias("n_words"), key_of(F.col(text)).alias(key))
    return _joined(light, found, key).select(
        *(f"`{c}`" for c in others), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<at:bigint,end:bigint>>")).alias("spans"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, whole: bool = False) -> DataFrame:
    """docs with hit words (and what stands before each of them) cut out of their texts; ``whole``: without contaminated documents.

    Texts without hits stay as they are, null included.
    """
    key, cut, part = spare(docs, "key", "runs", "part")
    found = runs(hits(docs, benchmark_windows(items, item_id, item_text, window), text)).withColumnRenamed("runs", cut)
    joined = _joined(docs.withColumn(key, key_of(F.col(text))), found, key)
    if whole:
        return joined.where(F.col(cut).isNull()).select([f"`{c}`" for c in docs.columns])
    parts = joined.withColumn(part, F.when(F.col(cut).isNotNull(), F.regexp_extract_all(F.col(text), F.lit(f"({NO_WORD}*{WORD}+)"), F.lit(1))))
    # what is kept lies between one run's end and the next run's beginning
    begins = f"concat(array(0L), transform({cut}, r -> r.end))"
    ends = f"concat(transform({cut}, r -> r.at), array(cast(size({part}) as bigint)))"
    kept = F.expr(f"array_join(zip_with({begins}, {ends}, (a, b) -> array_join(slice({part}, cast(a + 1 as int), cast(b - a as int)), '')), '')")
    tail = F.substr(F.col(text), F.length(F.array_join(part, "")) + 1)
    return parts.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.concat(kept, tail))).select([f"`{c}`" for c in docs.columns])
