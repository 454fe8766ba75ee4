"""Similarity joins by Ratcliff-Obershelp ratio, exact.

A ratio of t leaves at most (1 - t) * (la + lb) characters unmatched. At 0.85 two texts need not share any three letters, and at
0.95 pieces that they must share are so short that common ones join nearly all texts. So texts are compared in blocks of
bounded size within their length classes, one text against all of a block at once by bounds that no pair of the result fails
(``functions/alike.py``). Large blocks meet small ones as rows of a product: each task reads its blocks where they were
written, and none is copied for the blocks that it meets. The work grows with the square of a length class, disk and memory do not.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alike import Block, alike
from ..plans.durable import durable

#: Letters of a block of texts that one is held against at once, and of a block that meets it text by text, about; a text counts as so many more.
BLOCK, MEETING, TEXT = 1 << 23, 1 << 18, 64
#: Letters that one task reads for one side of the product, about.
SHARE = 1 << 25
#: Classes within the widest ratio of two lengths.
CLASSES = 2


def _blocks(rows: DataFrame, letters: dict[int, int], most: int) -> DataFrame:
    """Texts (id, text, class) as rows (class, ids, texts) of about ``most`` letters; ``letters`` are those of each class."""
    many = F.create_map(*[F.lit(x) for c, n in letters.items() for x in (c, -(-n // most))])[F.col("class")] if letters else F.lit(1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("long"))
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, sum(letters.values()) // SHARE)
    packed = dealt.repartition(parts, "class", "block").groupBy("class", "block").agg(F.collect_list(F.struct("id", "text")).alias("rows"))
    return durable(packed.select("class", F.col("rows.id").alias("ids"), F.col("rows.text").alias("texts"), "block"))


def similar_pairs(texts: DataFrame, threshold: float, either: bool = False) -> DataFrame:
    """(a, b, ratio) of distinct texts (id, text), a < b, with at least the threshold (below 1).

    ``either``: also pairs that reach it the other way round, as the ratio depends on which text is first; that ratio is ``back``.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold is from 0.5 to below 1")
    width = math.log(2 / threshold - 1) * (1 + 1e-9) / CLASSES
    size = F.length("text")
    rows = durable(texts.where(size > 0).select(F.col("id").cast("long").alias("id"), "text", F.floor(F.log(size.cast("double")) / width).cast("int").alias("class")))
    # a few dozen classes at any size
    letters = {r[0]: r[1] for r in rows.groupBy("class").agg(F.sum((size + TEXT).cast("long"))).collect()}
    x, y = (b.select(*[F.col(c).alias(f"{side}_{c}") for c in b.columns]) for side, b in (("x", _blocks(rows, letters, BLOCK)), ("y", _blocks(rows, letters, MEETING))))
    # within a class each text meets those after it; the hint keeps the other side off the driver
    met = x.join(y.hint("shuffle_replicate_nl"), (F.col("x_class") - F.col("y_class")).between(0, CLASSES))

    def compare(batches):
        # a block meets many in a row
        name = block = None
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                one = at("x_class"), at("x_block")
                if one != name:
                    name, block = one, Block(list(zip(at("x_ids"), at("x_texts"))), threshold)
                made = alike(block, list(zip(at("y_ids"), at("y_texts"))), after=one[0] == at("y_class"), either=either)
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["a", "b", "ratio", "back"])

    made = met.mapInArrow(compare, "a long, b long, ratio double, back double")
    return made if either else made.drop("back")


def fuzzy_consistency(segments: DataFrame, threshold: float, min_chars: int = 8) -> DataFrame:
    """Pairs of classes (equal source and target) that are alike: (a, b, kind), a and b the least ids of their classes.

    fuzzy-both: both sides alike; fuzzy-target: sources alike; fuzzy-source: targets alike. Both sides must differ (equal
    sides are the exact check's). Membership in classes is by (sn, tn).
    """
    from .cross import derived

    rows = derived(segments).where("sn <> '' and tn <> ''")
    # digests stand for the texts in every join; a text is looked at once more, by the id that stands for it
    marked = rows.select("id", "sn", "tn", "sl", "tl", F.sha2("sn", 256).alias("s"), F.sha2("tn", 256).alias("t"))
    classes = durable(marked.groupBy("s", "t").agg(F.min("id").alias("id"), F.max("sl").alias("sl"), F.max("tl").alias("tl")))

    # a text that is a source here and a target there is held against the others once
    def side(mark: str, size: str) -> DataFrame:
        return durable(classes.where(f"{size} >= {min_chars}").select("id", F.col(mark).alias("mark"), F.min("id").over(Window.partitionBy(mark)).alias("first")))

    def texts(of: DataFrame, text: str, odd: int) -> DataFrame:
        return marked.join(of.where("id = first").select("id", "mark"), "id").select("mark", F.col(text).alias("text"), (F.col("id") * 2 + odd).alias("key"))

    sources, targets = side("s", "sl"), side("t", "tl")
    all_texts = durable(texts(sources, "sn", 0).union(texts(targets, "tn", 1)).groupBy("mark").agg(F.min_by("text", "key").alias("text"), F.min("key").alias("key")))
    found = similar_pairs(all_texts.select(F.col("key").alias("id"), "text"), threshold, either=True)
    named = lambda k: all_texts.select(F.col("key").alias(k), F.col("mark").alias(f"mark_{k}"))
    pairs = durable(found.join(named("a"), "a").join(named("b"), "b"))

    def classes_alike(of: DataFrame) -> DataFrame:
        end = lambda k, to: of.select(F.col("mark").alias(f"mark_{k}"), F.col("first").alias(f"first_{k}"), F.col("id").alias(to))
        met = pairs.join(end("a", "x"), "mark_a").join(end("b", "y"), "mark_b")
        # the text that stands first on this side is the first of the ratio
        ratio = F.when(F.col("first_a") < F.col("first_b"), F.col("ratio")).otherwise(F.col("back"))
        return met.where(ratio >= threshold).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    s, d = classes_alike(sources).withColumn("by_s", F.lit(1)), classes_alike(targets).withColumn("by_t", F.lit(1))
    both = s.join(d, ["a", "b"], "full")
    named = both.join(classes.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("t").alias("ta")), "a").join(classes.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("t").alias("tb")), "b")
    kind = F.when(F.col("by_s").isNotNull() & F.col("by_t").isNotNull(), "fuzzy-both").when(F.col("by_s").isNotNull(), "fuzzy-target").otherwise("fuzzy-source")
    return named.where("sa <> sb and ta <> tb").select("a", "b", kind.alias("kind"))


def leaders(pairs: DataFrame) -> DataFrame:
    """Greedy leader clusters of an undirected graph (a < b, optional ratio) in id order: (member, leader).

    A node is a leader if no lower neighbour is one; others follow their lowest leader. Decided in rounds: a node is
    settled once all its lower neighbours are, so no component is gathered.
    """
    pairs = durable(pairs.select("a", "b").distinct())
    nodes = pairs.select(F.col("a").alias("n")).union(pairs.select(F.col("b").alias("n"))).distinct()
    state = durable(nodes.select("n", F.lit(None).cast("boolean").alias("leads")))
    while not state.where("leads is null").isEmpty():
        lower = pairs.join(state.select(F.col("n").alias("a"), "leads"), "a").groupBy(F.col("b").alias("n")).agg(F.max(F.coalesce("leads", F.lit(False))).alias("led"), F.max(F.col("leads").isNull()).alias("open"))
        joined = state.join(lower, "n", "left")
        now = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = durable(joined.select("n", now.alias("leads")))
    lead = state.where("leads").select(F.col("n").alias("a"))
    follow = pairs.join(lead, "a").groupBy("b").agg(F.min("a").alias("leader")).join(state.where("not leads").select(F.col("n").alias("b")), "b")
    return follow.select(F.col("b").alias("member"), "leader").union(follow.select(F.col("leader").alias("member"), "leader").distinct())


def accepted_leaders(pairs: DataFrame) -> DataFrame:
    """Greedy leader clusters of (a, b, differs), a < b, in id order, of which only those count whose leader differs from a member.

    Node by node: one that a leader took follows it; any other becomes a leader if among its higher neighbours that nobody
    took is one that differs, and then takes all of these; else they stay free for later leaders. In rounds: a node is
    settled once its lower neighbours are, and once it is the lowest open neighbour of each of its higher ones, so that
    what they were taken by before it is known. The lowest open node can always be settled. Result: (member, leader).
    """
    pairs = durable(pairs.select("a", "b", "differs").groupBy("a", "b").agg(F.max("differs").alias("differs")))
    nodes = pairs.select(F.col("a").alias("n")).union(pairs.select(F.col("b").alias("n"))).distinct()
    state = durable(nodes.select("n", F.lit(None).cast("string").alias("is")))
    while not state.where("is is null").isEmpty():
        # of each node: whether a leader took it, and its lowest open neighbour below it
        below = pairs.join(state.select(F.col("n").alias("a"), "is"), "a").groupBy("b").agg(F.max(F.coalesce(F.col("is") == "leads", F.lit(False))).alias("taken"), F.min(F.when(F.col("is").isNull(), F.col("a"))).alias("waits"))
        above = pairs.join(below, "b").groupBy(F.col("a").alias("n")).agg(F.max(F.col("waits") < F.col("a")).alias("early"), F.max(~F.col("taken") & F.col("differs")).alias("leads"))
        seen = state.join(below.select(F.col("b").alias("n"), "taken", "waits"), "n", "left").join(above, "n", "left")
        now = F.when(F.col("is").isNotNull(), F.col("is")).when(F.col("taken"), "taken").when(F.col("waits").isNotNull() | F.coalesce("early", F.lit(False)), F.lit(None)).when(F.coalesce("leads", F.lit(False)), "leads").otherwise("free")
        state = durable(seen.select("n", now.alias("is")))
    follow = pairs.join(state.where("is = 'leads'").select(F.col("n").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader")).join(state.where("is = 'taken'").select(F.col("n").alias("b")), "b")
    return follow.select(F.col("b").alias("member"), "leader").union(follow.select(F.col("leader").alias("member"), "leader").distinct())
