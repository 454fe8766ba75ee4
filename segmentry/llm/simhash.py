"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: A-Z are lower-cased, words are runs of bytes other than blank and \\t..\\r, shingles are three words (fewer:
the whole sequence) joined by blanks, and a bit is set if more than half of the shingles' XXH64 values have it.

Links (at most ``RADIUS`` = 2 differing bits) are looked for between distinct fingerprints. Of three blocks of bits one
must agree, so each fingerprint joins three buckets. A bucket of more than ``LARGE`` fingerprints is divided again by
the same argument over the bits that are still free, at most five times; then 9 bits are left and a bucket has 512
members at most. No pair is lost and no bucket is ever compared that could not be divided further.

Inside a task the buckets lie one after another, the larger first, and the fingerprints are stored as 64 vertical bit
planes of packed lanes. Lane i is compared with lane i + s for s = 1, 2, ...: the planes' differences go into two
carry-save counter planes and an overflow plane, and a block of lanes is abandoned once all of its lanes exceed the
radius. Links become a spanning forest right there, so that dense groups send one edge for each member and not one for
each pair.

Edge cases: null and empty texts, and texts of white space only, have fingerprint zero and are linked like any other;
equal rows and equal ids are kept as rows; a null doc_id is never a component's id unless all of its ids are null.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, join_uneven, texts, with_arrow
from .components import components

RADIUS = 2
SHINGLE = 3
LARGE = 256
DEPTH = 5
#: Shingles whose bits are counted at a time.
AT_ONCE = 1 << 15
LANES = 1024


def fingerprint(text: str, words_in_shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)][:n]
    last = ends[words_in_shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + AT_ONCE], last[at : at + AT_ONCE])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Add the 64-bit fingerprint of each whole text as a signed long."""

    def start():
        return lambda column: [[fingerprint(t) for t in texts(column)]]

    return with_arrow(docs, [text], [T.StructField(out, T.LongType())], start, keep)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _divisions(free: list[int]) -> list[list[int]]:
    """Three parts of the free bits, dealt out in turn."""
    return [free[i :: RADIUS + 1] for i in range(RADIUS + 1)]


def _paths(depth: int) -> list[tuple[int, list[int]]]:
    """(number, fixed bits) of each way to choose one part at each of ``depth`` levels."""
    paths: list[tuple[int, list[int]]] = [(0, [])]
    for _ in range(depth):
        paths = [
            (number * (RADIUS + 1) + i, fixed + part)
            for number, fixed in paths
            for i, part in enumerate(_divisions([b for b in range(64) if b not in fixed]))
        ]
    return paths


def _buckets(fps: DataFrame, depth: int) -> DataFrame:
    """(path, bucket, fp): the buckets of a level below ``path`` (the level above's number), or all of them at level 1."""
    ways = _paths(depth)
    choices = F.array(*[
        F.struct(F.lit(number).alias("path"), F.lit(_signed(sum(1 << b for b in fixed))).alias("mask")) for number, fixed in ways
    ])
    if depth > 1:
        choices = F.slice(choices, F.col("path") * (RADIUS + 1) + 1, RADIUS + 1)
    made = fps.select("fp", F.explode(choices).alias("w"))
    return made.select(F.col("w.path").alias("path"), F.col("fp").bitwiseAND(F.col("w.mask")).alias("bucket"), "fp")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits, lane i at bit i % 64 of word i // 64."""
    n = -(-len(fps) // LANES) * LANES
    padded = np.zeros(n, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _ahead(words: np.ndarray, shift: int) -> np.ndarray:
    """Lane i takes what lane i + shift has."""
    jump, bits = divmod(shift, 64)
    out = np.zeros_like(words)
    kept = words[jump:]
    out[: len(kept)] = kept >> np.uint64(bits) if bits else kept
    if bits and len(kept) > 1:
        out[: len(kept) - 1] |= kept[1:] << np.uint64(64 - bits)
    return out


def _pack(flags: np.ndarray, n: int) -> np.ndarray:
    padded = np.zeros(n, dtype=np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def near_lanes(planes: np.ndarray, shift: int, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The lanes i among ``wanted`` (packed) whose distance to lane i + shift is at most ``radius`` (0 to 2)."""
    size = LANES // 64
    over = (~wanted).reshape(-1, size).copy()
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    alive = np.flatnonzero((~over).any(axis=1))
    for at in range(0, 64, 4):
        if not len(alive):
            break
        o, a, b = over[alive], ones[alive], twos[alive]
        for plane in planes[at : at + 4]:
            differ = (plane ^ _ahead(plane, shift)).reshape(-1, size)[alive]
            carry = a & differ
            a = a ^ differ
            o = o | (b & carry)
            b = b ^ carry
        o = o | (a & b if radius == 2 else b if radius == 1 else a | b)
        over[alive], ones[alive], twos[alive] = o, a, b
        alive = alive[(~o).any(axis=1)]
    return np.flatnonzero(np.unpackbits((~over).reshape(-1).view(np.uint8), bitorder="little"))


def near_one(planes: np.ndarray, fp: int, radius: int) -> np.ndarray:
    """The lanes whose distance to ``fp`` is at most ``radius``: one fingerprint against all, any radius below 64.

    Each plane is added to all lanes' counters at once, which are bit planes too; blocks of lanes that all exceed the
    radius are abandoned after every 16 planes.
    """
    size = LANES // 64
    alive = np.arange(planes.shape[1] // size)
    counters = [np.zeros((len(alive), size), dtype="<u8") for _ in range(7)]
    for at in range(0, 64, 16):
        for bit in range(at, at + 16):
            plane = planes[bit].reshape(-1, size)[alive]
            carry = ~plane if fp >> bit & 1 else plane
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
                if k > 3 and not carry.any():
                    break
        over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
        for k in range(6, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                over |= equal & counters[k]
                equal &= ~counters[k]
        left = (~over).any(axis=1)
        alive, counters, over = alive[left], [c[left] for c in counters], over[left]
        if not len(alive):
            return np.zeros(0, dtype=np.int64)
    hits = np.flatnonzero(np.unpackbits((~over).reshape(-1).view(np.uint8), bitorder="little"))
    return alive[hits // LANES] * LANES + hits % LANES


def forest(group: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links connect, for rows sorted by group."""
    sizes = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])) if len(group) else np.array([], dtype=int)
    begins = np.cumsum(np.r_[0, sizes])[:-1]
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    rows = np.concatenate([np.arange(b, b + s) for b, s in zip(begins[order], sizes)]) if len(sizes) else np.array([], dtype=int)
    lanes, left = fps[rows].astype("<u8"), np.concatenate([np.arange(s, 0, -1) for s in sizes]) if len(sizes) else rows
    planes = planes_of(lanes)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    edges = []
    for shift in range(1, int(sizes[0]) if len(sizes) else 0):
        reach = int(sizes[sizes > shift].sum())
        width = -(-reach // LANES) * LANES
        # one block more, for the lanes ahead
        part = planes[:, : min(planes.shape[1], (width + shift) // 64 + LANES // 64)]
        part = part[:, : part.shape[1] // (LANES // 64) * (LANES // 64)]
        wanted = _pack(left[:reach] > shift, part.shape[1] * 64)
        for i in near_lanes(part, shift, wanted).tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(lanes[i].view("<i8")), int(lanes[i + shift].view("<i8"))))
    return edges


#: Rows of whole buckets that a task compares at a time.
ROWS_AT_ONCE = 1 << 16


def _compare(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def done(group, fps):
        edges = forest(group, fps)
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], type=pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        group = path * np.uint64(0x9E3779B97F4A7C15) ^ batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        held.append((group, batch.column(2).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            group, fps = (np.concatenate(x) for x in zip(*held))
            whole = int(np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[-1])
            if whole:
                yield done(group[:whole], fps[:whole])
            held, rows = [(group[whole:], fps[whole:])], len(group) - whole
    if held:
        yield done(*(np.concatenate(x) for x in zip(*held)))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) to edges (u, v) that connect the same fingerprints as all links do."""
    found, level = None, _buckets(fps, 1)
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("path", "bucket").count()
        several = sizes.where("count > 1" if depth == DEPTH else f"count between 2 and {LARGE}")
        small = level.join(several.drop("count"), ["path", "bucket"]).select("path", "bucket", "fp")
        found = small if found is None else found.union(small.select(F.col("path") + sum(3**d for d in range(1, depth)), "bucket", "fp"))
        if depth == DEPTH:
            break
        large = durable(level.join(sizes.where(f"count > {LARGE}").drop("count"), ["path", "bucket"]).select("path", "fp"))
        if large.isEmpty():
            break
        level = _buckets(large.distinct(), depth + 1)
    dealt = found.repartition("path", "bucket").sortWithinPartitions("path", "bucket")
    return dealt.mapInArrow(_compare, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, fp (long), component_id (the least key that it reaches over links)."""
    fps = durable(with_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "fp", ["doc_id"]))
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    joined = durable(components(links(nodes.select("fp"))))
    least = durable(joined.join(nodes, joined.node == nodes.fp).select("node", "root", "rep"))
    ids = least.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n"))
    of_node = join_uneven(least.select("node", "root"), ids.drop("n"), "root", ids.select("root", "n")).select(F.col("node").alias("fp"), "component")
    ids_of_fps = nodes.join(of_node, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return join_uneven(fps, ids_of_fps, "fp", nodes.select("fp", "n")).select(F.col("doc_id").alias(key), "fp", "component_id")
