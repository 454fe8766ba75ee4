"""SimHash near-dedup at a resemblance: groups of texts whose shingle sets have a Jaccard index of ``LEAST`` or more.

Words are those of ``simhash``, shingles are ``WORDS`` words (fewer: the whole sequence) as hashes of 64 bits, made from
the words' hashes for a whole text at once (``shingles``). Texts of equal words are one node. Fingerprints of such texts differ in some 10 of 64 bits, too many for buckets of equal bits, so
candidates meet by shingles: of two texts at the least resemblance one must hold, among its first n - ceil(LEAST * n) + 1
shingles in any order common to all texts, a shingle that the other has among its own; so each node posts its prefix, rare
shingles first. The order comes from a table of fixed size of how often shingles occur; what is wrong in it (two shingles
in one place) costs time and no pair.

Nodes with a common posting and lengths that allow the resemblance are chained, and the chains' components are gathered.
Inside each of them a node's fingerprint is held against all others' bit planes (``simhash.near_one``), the shingle sets of
those within ``RADIUS`` bits are compared exactly, and what is reached goes on to the next. Sets are compared by what they
lack of, and hold besides, the shingles that most of the component hold, so a node costs what it differs by, not what it
holds. A large group of near copies is reached from its first node, so its pairs are never listed. Two texts at the least resemblance differ in 64 * acos(8 / 9)
/ pi = 9.7 bits with a deviation of 2.9, so ``RADIUS`` is more than six deviations away: the filter costs no link in
practice, and the tests hold it against all pairs. One task holds the texts of one component.

Edge cases: null and empty texts, and texts of white space only, are copies of each other; equal rows and ids are kept as
rows of one group; very long texts are one node like any other; of ties in the order of shingles the lesser hash comes
first; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import durable, join_uneven, release, spare, texts, with_arrow
from .components import components

LEAST = 0.8
WORDS = 5
#: Differing bits beyond which shingle sets are not compared.
RADIUS = 28
#: The table of how often shingles occur: so many ranges, and so many places in each.
RANGES, PLACES = 1 << 10, 1 << 14
#: Marks of the nodes that have candidates, for any number of nodes; two nodes with one mark cost time only.
MARKS = 1 << 27
#: Bytes that are hashed at once; a longer word is hashed by itself.
BLOCK = 1 << 15
#: Odd factors, 3 modulo 8: few low bits are lost where two powers are subtracted.
OF_BYTES, OF_WORDS = 0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B
#: A number for each byte, and the powers of ``OF_BYTES`` and of its inverse modulo 2 ** 64.
LETTERS = np.array([xxhash.xxh64_intdigest(bytes([b]), 42) for b in range(256)], dtype=np.uint64)
POWERS, INVERSES = (np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, f, dtype=np.uint64)]) for f in (OF_BYTES, pow(OF_BYTES, -1, 1 << 64)))


def _joined(text: str) -> bytes:
    """The words with a space between."""
    return b" ".join(text.encode("utf-8", "replace").lower().split())


def _node(joined: bytes) -> int:
    return xxhash.xxh3_128_intdigest(joined) % (1 << 64) - (1 << 63)


def node(text: str) -> int:
    return _node(_joined(text))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bijective; every bit of the outcome depends on all bits."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _hashes(joined: bytes) -> np.ndarray:
    """A hash of each word, by its bytes alone: a polynomial in them, as a difference of running sums."""
    held = np.frombuffer(joined, dtype=np.uint8)
    ends = np.append(np.flatnonzero(held == 32), len(held))
    starts = np.r_[0, ends[:-1] + 1]
    out = np.empty(len(ends), dtype=np.uint64)
    at = 0
    while at < len(ends):
        begin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        end = int(ends[to - 1])
        if end - begin > BLOCK:
            out[at] = xxhash.xxh64_intdigest(joined[begin:end], 42)
        else:
            sums = np.zeros(end - begin + 1, dtype=np.uint64)
            np.cumsum(LETTERS[held[begin:end]] * POWERS[: end - begin], out=sums[1:])
            first = starts[at:to] - begin
            out[at:to] = (sums[ends[at:to] - begin] - sums[first]) * INVERSES[first]
        at = to
    return _mixed(out)


def _shingles(joined: bytes) -> np.ndarray:
    if not joined:
        return np.zeros(0, dtype=np.uint64)
    words = _hashes(joined)
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(OF_WORDS)
        out += words[k : k + n]
    out = _mixed(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def shingles(text: str) -> np.ndarray:
    """Ascending distinct hashes."""
    return _shingles(_joined(text))


def enough(common, a, b):
    """Whether so many common shingles of a and b ones reach the resemblance; in integers, as LEAST is 4 / 5."""
    return 5 * common >= 4 * (a + b - common)


def prefix(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _slots(batches):
    """The 32 first bits of the shingles of each batch of texts, by range."""
    release()
    for batch in batches:
        held, seen = [], set()
        for text in texts(batch.column(0)):
            joined = _joined(text)
            own = _node(joined)
            if own not in seen:
                seen.add(own)
                held.append((_shingles(joined) >> np.uint64(32)).astype("<u4"))
        if not held:
            continue
        slots = np.sort(np.concatenate(held))
        cuts = np.searchsorted(slots, np.arange(1, RANGES, dtype=np.uint64) << np.uint64(22))
        # a range's number says the first 10 bits, so 3 bytes hold the rest
        parts = [(i, p.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()) for i, p in enumerate(np.split(slots, cuts)) if len(p)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["range", "slots"])


def _levels(slots: list[bytes]) -> bytes:
    """For each place of a range the logarithm of the most occurrences of a slot there."""
    held = np.frombuffer(b"".join(slots), dtype=np.uint8).reshape(-1, 3)
    wide = np.zeros((len(held), 4), dtype=np.uint8)
    wide[:, :3] = held
    found, often = np.unique(wide.view("<u4").reshape(-1) & 0x3FFFFF, return_counts=True)
    levels = np.zeros(PLACES, dtype=np.uint8)
    np.maximum.at(levels, found >> 8 & (PLACES - 1), np.log2(often).astype(np.uint8))
    return levels.tobytes()


def _by_range(batches):
    held: list[bytes] = []
    now = None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_levels(held)], pa.binary())], names=["range", "levels"])

    for batch in batches:
        for r, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if r != now and held:
                yield done()
                held = []
            now = r
            held.append(s)
    if held:
        yield done()


def table(docs: DataFrame, text: str) -> np.ndarray:
    """How often shingles occur, ``RANGES`` x ``PLACES`` bytes for any number of texts."""
    dealt = docs.select(text).mapInArrow(_slots, "range int, slots binary").repartition("range").sortWithinPartitions("range")
    out = np.zeros((RANGES, PLACES), dtype=np.uint8)
    for r in dealt.mapInArrow(_by_range, "range int, levels binary").collect():
        out[r[0]] = np.frombuffer(r[1], dtype=np.uint8)
    return out.reshape(-1)


def _postings(levels):
    def run(batches):
        release()
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for text in texts(batch.column(0)):
                joined = _joined(text)
                own = _node(joined)
                if own in seen:
                    continue
                seen.add(own)
                found = _shingles(joined)
                if len(found):
                    first = found[np.argsort(levels.value[found >> np.uint64(40)], kind="stable")[: prefix(len(found))]]
                    keys.append(first.view(np.int64))
                    nodes.append(np.full(len(first), own))
                    sizes.append(np.full(len(first), len(found), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, sizes)], names=["key", "node", "n"])

    return run


def _chains(batches):
    """Rows in order of key, n and node: neighbours with the same key whose lengths allow the resemblance."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, own, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if last is not None:
            key, own, n = (np.concatenate([[a], b]) for a, b in zip(last, (key, own, n)))
        last = key[-1], own[-1], n[-1]
        hit = (key[1:] == key[:-1]) & (own[1:] != own[:-1]) & (5 * n[:-1].astype(np.int64) >= 4 * n[1:].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(own[:-1][hit]), pa.array(own[1:][hit])], names=["u", "v"])


def bits(found: np.ndarray) -> int:
    """The fingerprint of a shingle set: a bit is 1 if it is set in over half of the hashes."""
    ones = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


class Differences:
    """Shingle sets by how each differs from the core, the shingles that over half of the sets hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        n = len(sets)
        _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), self.size)
        is_core = 2 * often > n
        self.core = int(is_core.sum())
        # at most twice as many cells as all sets have shingles
        in_core, place = is_core[ids], np.cumsum(is_core) - 1
        lacks = np.ones((n, self.core), dtype=bool)
        lacks[owner[in_core], place[ids[in_core]]] = False
        self.lacking = lacks.sum(axis=1)
        lacker, lacked = np.nonzero(lacks)
        # what a single set holds besides is common to no two
        besides = ~in_core & (often[ids] > 1)
        what, who = np.r_[ids[besides], len(often) + lacked], np.r_[owner[besides], lacker]
        _, what = np.unique(what, return_inverse=True)
        self.holders = who[np.argsort(what, kind="stable")]
        self.of_what = np.r_[0, np.cumsum(np.bincount(what))]
        self.what = what[np.argsort(who, kind="stable")]
        self.of_who = np.r_[0, np.cumsum(np.bincount(who, minlength=n))]

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles x has in common with each of the others."""
        lists = [self.holders[self.of_what[w] : self.of_what[w + 1]] for w in self.what[self.of_who[x] : self.of_who[x + 1]].tolist()]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.size))[others] if lists else 0
        return self.core - self.lacking[x] - self.lacking[others] + shared


def groups(nodes: list[int], sets: list[np.ndarray]) -> list[int]:
    """The least node that each node reaches over links."""
    fps = np.array([bits(s) for s in sets], dtype="<u8")
    by = Differences(sets)
    size = by.size
    out = [0] * len(nodes)
    alive, left = np.ones(len(nodes), dtype=bool), len(nodes)
    rows = np.arange(len(nodes))
    planes = simhash.planes_of(fps)
    for begin in range(len(nodes)):
        if not alive[begin]:
            continue
        alive[begin] = False
        left -= 1
        todo, reached = [begin], [begin]
        while todo and left:
            x = todo.pop()
            if 2 * left < len(rows):
                rows = np.flatnonzero(alive)
                planes = simhash.planes_of(fps[rows])
            lanes = simhash.near_one(planes, int(fps[x]), RADIUS)
            close = rows[lanes[lanes < len(rows)]]
            close = close[alive[close]]
            if not len(close):
                continue
            near = close[enough(by.common(x, close), size[close], size[x])]
            alive[near] = False
            left -= len(near)
            todo += near.tolist()
            reached += near.tolist()
        least = min(nodes[i] for i in reached)
        for i in reached:
            out[i] = least
    return out


def _compare(batches):
    nodes, sets, now = [], [], None

    def done():
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(groups(nodes, sets), pa.int64())], names=["node", "least"])

    for batch in batches:
        for root, own, text in zip(batch.column("root").to_pylist(), batch.column("node").to_pylist(), texts(batch.column("text"))):
            if root != now and nodes:
                yield done()
                nodes, sets = [], []
            now = root
            nodes.append(own)
            sets.append(shingles(text))
    if nodes:
        yield done()


def _marks(nodes: DataFrame) -> np.ndarray:
    """``MARKS`` bits: those of the nodes' values."""
    at = F.pmod("node", F.lit(MARKS))
    words = nodes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(node, {MARKS}) & 63))")).alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, dtype="<i8")
    if words.num_rows:
        out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _marked(marks):
    def run(batches):
        release()
        seen: set[int] = set()
        for batch in batches:
            nodes, held = [], []
            for text in texts(batch.column(0)):
                own = node(text)
                at = own % MARKS
                if marks.value[at >> 3] >> (at & 7) & 1 and own not in seen:
                    seen.add(own)
                    nodes.append(own)
                    held.append(text)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(held, pa.string())], names=["node", "text"])

    return run


def _named(docs: DataFrame, text: str, own: str) -> DataFrame:
    return with_arrow(docs, [text], [T.StructField(own, T.LongType())], lambda: lambda c: [[node(t) for t in texts(c)]])


def reached(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, least): the least node that a text's node reaches over links, for nodes that share postings with others."""
    levels = docs.sparkSession.sparkContext.broadcast(table(docs, text))
    dealt = docs.select(text).mapInArrow(_postings(levels), "key long, node long, n int").repartition("key").sortWithinPartitions("key", "n", "node")
    chained = durable(components(dealt.mapInArrow(_chains, "u long, v long")))
    # only texts with candidates are shuffled, one of each node
    marks = docs.sparkSession.sparkContext.broadcast(_marks(chained))
    one = docs.select(text).mapInArrow(_marked(marks), "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
    return durable(one.join(chained, "node").repartition("root").sortWithinPartitions("root", "node").mapInArrow(_compare, "node long, least long"))


def with_group(docs: DataFrame, text: str = "text", out: str = "group") -> DataFrame:
    """Add a number that rows share if links lead from one's text to the other's."""
    own, least = spare(docs, "_node", "_least")
    named = _named(docs, text, own)
    counts = durable(named.groupBy(own).agg(F.count("*").alias("n")))
    group = counts.join(reached(docs, text).withColumnsRenamed({"node": own}), own, "left").select(own, F.coalesce("least", own).alias(least))
    return join_uneven(named, group, own, counts).withColumn(out, F.col(least)).select(*[c for c in docs.columns if c != out], out)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that of the least key (null last), then of the least hash of text and row; of equal rows one.

    A group's rows never meet: the first row of each text is found by a minimum, then the first of each group. Whole rows
    are shuffled once, by text and place in the order, so copies of one text spread; equal rows become one on the way.
    """
    own, order, best = spare(docs, "_node", "_order", "_best")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = _named(docs, text, own).withColumn(order, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("of_text"), F.xxhash64(*columns).alias("of_row")))
    first = durable(named.groupBy(own).agg(F.min(order).alias(best)))
    group = first.join(reached(docs, text).withColumnsRenamed({"node": own}), own, "left").withColumn("least", F.coalesce("least", own))
    stay = group.groupBy("least").agg(F.min_by(F.struct(own, best), best).alias("row")).select(f"row.{own}", F.col(f"row.{best}").alias(order))
    rows = named.groupBy(own, order).agg(F.first(F.struct(*columns)).alias("row"))
    return rows.join(stay, [own, order]).select("row.*")
