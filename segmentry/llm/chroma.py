"""Chroma audio fingerprints and their alignment.

A recording becomes pitch-class frames (12 bins, octaves folded), an integral image over them, and 16 rectangle filters
at each frame; each filter's quantised log ratio is a 2-bit Gray code, so a frame gives one packed 32-bit item. Two
recordings are aligned by the histogram of offsets at which they hold equal items, then judged by the share of differing
bits over the overlap at the best offset.

Recordings with equal items form a class, and classes are matched through their representatives (the least id), so copies
cost nothing. The queries' items form inverted indexes, a block of queries at a time, and every recording is held against
every block: each equal item counts once, however frequent it is, and only links leave a task.

Edge cases: null, broken, empty or too short recordings have no items, form one class and align with nothing; silence
gives items of zeros; equal ids are kept as rows, and recordings of one id that differ are matched by their own items
(a class is named by its least id); of equally high histogram columns the one nearest to offset 0 counts, then the later;
classes of null ids only are not matched; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, join_uneven, with_arrow

RATE, FRAME, HOP = 4000, 1024, 128
FILTERS = 16
WIDEST = 16
#: A match: so many equal items at one offset, so many frames of overlap, and at most this share of differing bits.
LEAST_HITS, LEAST_OVERLAP, MOST_ERROR = 5, 32, 0.25
QUERIES_OF = 20
#: Items of queries that a task holds, about, and items of recordings in a task.
BLOCK_PLACES, PLACES_IN_TASK = 1 << 20, 1 << 22
#: Hits, and pairs of a recording and a query, that are counted at a time.
HITS_AT_ONCE, PAIRS_AT_ONCE = 1 << 21, 1 << 22


def decode_wav(data: bytes | None) -> np.ndarray:
    """Mono samples at ``RATE``; whatever cannot be read is empty."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()).mean(axis=1)
            rate = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    n = int(len(raw) * RATE / rate)
    return np.interp(np.arange(n) * rate / RATE, np.arange(len(raw)), raw) if len(raw) and rate != RATE else raw


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(samples, -32767, 32767).astype("<i2").tobytes())
    return out.getvalue()


def sonified(vector: list[float] | None) -> np.ndarray:
    """A vector as a recording: one eighth of a second for each value, its size as the pitch."""
    if not vector:
        return np.zeros(0)
    v = np.nan_to_num(np.array(vector, dtype=float))
    pitch = 220.0 * 2 ** (np.clip(np.rint(v * 48), -18, 18) / 12)
    phase = np.cumsum(np.repeat(pitch, RATE // 8)) * (2 * np.pi / RATE)
    return np.rint(9000 * (np.sin(phase) + 0.5 * np.sin(2 * phase)))


@lru_cache(1)
def _bins() -> tuple[np.ndarray, np.ndarray]:
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    weight = np.zeros((len(hertz), 12))
    used = (hertz >= 55) & (hertz <= 1800)
    weight[used, np.rint(12 * np.log2(hertz[used] / 220.0)).astype(int) % 12] = 1
    return np.hanning(FRAME), weight


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, each of length one (silent: zeros)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    window, weight = _bins()
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 512] * window, axis=1)) @ weight for i in range(0, len(frames), 512)])
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)


def rectangles(i: int) -> tuple[int, int, int, int]:
    """Filter i: kind (split by time, by pitch, in thirds by time, in thirds by pitch), first bin, bins, frames."""
    return i % 4, (5 * i) % 7, 3 + i % 4, (4, 8, 12, WIDEST)[i // 4]


def items(samples: np.ndarray) -> np.ndarray:
    """Packed 32-bit items, one for each frame that has ``WIDEST`` frames from it on."""
    c = chroma(samples)
    n = len(c) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    area = lambda t, y, w, h: image[t + w : t + w + n, y + h] - image[t : t + n, y + h] - image[t + w : t + w + n, y] + image[t : t + n, y]
    packed = np.zeros(n, dtype=np.uint32)
    for i in range(FILTERS):
        kind, y, h, w = rectangles(i)
        whole = area(0, y, w, h)
        if kind == 0:
            part = area(w // 2, y, w - w // 2, h)
        elif kind == 1:
            part = area(0, y + h // 2, w, h - h // 2)
        elif kind == 2:
            part = area(w // 3, y, max(1, w // 3), h)
        else:
            part = area(0, y + h // 3, w, max(1, h // 3))
        ratio = np.log((1e-2 + part) / (1e-2 + whole - part))
        level = (ratio > -0.7).astype(np.uint32) + (ratio > 0) + (ratio > 0.7)
        packed |= (level ^ level >> 1).astype(np.uint32) << np.uint32(2 * i)
    return packed.view(np.int32)


def with_items(media: DataFrame, column: str = "audio", out: str = "items", decode: Callable = decode_wav, keep: list[str] | None = None) -> DataFrame:
    """Add the items of each recording; ``decode`` turns a value of the column into samples."""
    start = lambda: lambda c: [[items(decode(x)).tolist() for x in c.to_pylist()]]
    return with_arrow(media, [column], [T.StructField(out, T.ArrayType(T.IntegerType(), False))], start, keep)


class Block:
    """An inverted index over the items of some queries."""

    def __init__(self, ids: list[int], lists: list[np.ndarray]):
        self.ids, self.lists = np.array(ids, dtype=np.int64), lists
        sizes = np.array([len(x) for x in lists])
        flat = np.concatenate(lists)
        order = np.argsort(flat, kind="stable")
        self.items, self.begins, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(lists)), sizes)[order]
        self.place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        self.longest = int(sizes.max())

    def _postings(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each item its number in the index, and how many postings it has."""
        spot = np.minimum(np.searchsorted(self.items, flat), len(self.items) - 1)
        return spot, np.where(self.items[spot] == flat, self.counts[spot], 0)

    def histogram(self, lists: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(number of the recording, number of the query, offset) at the highest column of each pair's histogram."""
        sizes = np.array([len(x) for x in lists])
        flat = np.concatenate(lists)
        spot, n = self._postings(flat)
        whose = np.repeat(np.arange(len(lists)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hits = np.repeat(np.arange(len(flat)), n)
        posting = self.begins[spot[hits]] + np.arange(len(hits)) - np.repeat(np.cumsum(n) - n, n)
        pair = whose[hits] * len(self.lists) + self.owner[posting]
        # fewer hits than needed, whatever their offsets
        enough = np.bincount(pair, minlength=1)[pair] >= LEAST_HITS
        span = self.longest + int(sizes.max())
        column, height = np.unique(pair[enough] * span + (at[hits] - self.place[posting])[enough] + self.longest, return_counts=True)
        column, height = column[height >= LEAST_HITS], height[height >= LEAST_HITS]
        pair, offset = column // span, column % span - self.longest
        order = np.lexsort((offset, -np.abs(offset), height, pair))
        last = order[np.r_[pair[order][1:] != pair[order][:-1], True]] if len(order) else order
        return list(zip((pair[last] // len(self.lists)).tolist(), (pair[last] % len(self.lists)).tolist(), offset[last].tolist()))

    def long_histogram(self, items_of: np.ndarray) -> list[tuple[int, int, int]]:
        """The same for one recording with very many hits, a query at a time; memory follows the lengths of the two."""
        order = np.argsort(items_of, kind="stable")
        own, begins, counts = np.unique(items_of[order], return_index=True, return_counts=True)
        out = []
        for q, asked in enumerate(self.lists):
            spot = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            n = np.where(own[spot] == asked, counts[spot], 0)
            if n.sum() < LEAST_HITS:
                continue
            columns = np.zeros(len(items_of) + len(asked), dtype=np.int64)
            for i in np.flatnonzero(n).tolist():
                columns[order[begins[spot[i]] : begins[spot[i]] + n[i]] - i + len(asked)] += 1
            best = np.flatnonzero(columns == columns.max()) - len(asked)
            if columns.max() >= LEAST_HITS:
                out.append((0, q, max(best.tolist(), key=lambda d: (-abs(d), d))))
        return out

    def matches(self, ids: list[int], lists: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(query, other, offset, error) of the links between the queries and these recordings."""
        totals = [int(self._postings(x)[1].sum()) for x in lists]
        most = max(1, PAIRS_AT_ONCE // len(self.lists))
        out, begin = [], 0
        while begin < len(lists):
            end, hits = begin + 1, totals[begin]
            while end < len(lists) and end - begin < most and hits + totals[end] <= HITS_AT_ONCE:
                hits += totals[end]
                end += 1
            found = self.long_histogram(lists[begin]) if hits > HITS_AT_ONCE else self.histogram(lists[begin:end])
            for r, q, offset in found:
                if ids[begin + r] != self.ids[q]:
                    n, error = compare(self.lists[q], lists[begin + r], offset)
                    if n >= LEAST_OVERLAP and error <= MOST_ERROR:
                        out.append((int(self.ids[q]), ids[begin + r], offset, error))
            begin = end
        return out


def compare(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Frames of overlap if a's frame t meets b's frame t + offset, and the share of bits that differ there."""
    begin = max(0, -offset)
    n = min(len(a) - begin, len(b) - begin - offset)
    if n <= 0:
        return 0, 1.0
    differ = np.bitwise_count((a[begin : begin + n] ^ b[begin + offset : begin + offset + n]).view(np.uint32))
    return n, int(differ.sum()) / (32 * n)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Views of the numbers of each list."""
    edges = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


def links(recordings: DataFrame) -> DataFrame:
    """From (rep, asked, items): (query, other, offset, error) for all that are asked against all recordings.

    The queries go out in blocks of about ``BLOCK_PLACES`` items, so what a task holds does not grow with the table; each
    block is held against every recording, and a task sees all items of a recording together, so only links leave it.
    """
    context = recordings.sparkSession.sparkContext
    asked = recordings.where("asked").select("rep", "items")
    places, all_places = (df.agg(F.sum(F.size("items").cast("long"))).first()[0] or 0 for df in (asked, recordings))
    blocks = -(-places // BLOCK_PLACES)
    dealt = durable(recordings.select("rep", "items").repartition(max(context.defaultParallelism, -(-all_places // PLACES_IN_TASK))))

    def scan(held):
        def run(batches):
            block = Block(*held.value)
            for batch in batches:
                if batch.num_rows:
                    found = block.matches(batch.column(0).to_pylist(), _lists(batch.column(1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["query", "other", "offset", "error"])

        return run

    shape, out = "query long, other long, offset int, error double", None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == i).toArrow()
        if not rows.num_rows:
            continue
        held = context.broadcast((rows.column(0).to_pylist(), [np.array(x, dtype=np.int32) for x in rows.column(1).to_pylist()]))
        found = durable(dealt.mapInArrow(scan(held), shape))
        held.unpersist()
        out = found if out is None else out.union(found)
    return recordings.sparkSession.createDataFrame([], shape) if out is None else out


def align(recordings: DataFrame, key: str = "vec_id", items_column: str = "items", queries_of: int = QUERIES_OF) -> DataFrame:
    """One row for each recording: key, n_items, class_id, fingerprint (digest), and of its class: n_links, the best
    aligned class (best_id), best_offset (frames) and best_error.

    Queries are the classes that hold an id divisible by ``queries_of``; each is searched in all classes, and both ends of
    a match are told about it.
    """
    base = recordings.select(F.col(key).alias("id"), F.coalesce(F.col(items_column), F.array().cast("array<int>")).alias("items"))
    base = durable(base.withColumn("digest", F.sha2(F.array_join("items", ","), 256)))
    # the items are a function of the digest, so any of them will do
    reps = durable(base.groupBy("digest").agg(
        F.min("id").alias("rep"), F.max(F.coalesce(F.col("id") % queries_of == 0, F.lit(False))).alias("asked"), F.first("items").alias("items"), F.count("*").alias("n")))
    judged = links(reps.where(f"size(items) >= {LEAST_OVERLAP} and rep is not null").select("rep", "asked", "items"))
    ends = judged.select(F.col("query").alias("rep"), F.col("other").alias("id2"), "offset", "error").union(
        judged.select(F.col("other").alias("rep"), F.col("query").alias("id2"), (-F.col("offset")).alias("offset"), "error"))
    summary = ends.groupBy("rep").agg(F.count_distinct("id2").alias("n_links"), F.min(F.struct("error", "id2", "offset")).alias("best"))
    classes = durable(reps.select("digest", "rep", "n").join(summary, "rep", "left"))
    rows = base.select("id", "digest", F.size("items").alias("n_items"))
    return join_uneven(rows, classes.drop("n"), "digest", classes.select("digest", "n")).select(
        F.col("id").alias(key), "n_items", F.col("rep").alias("class_id"), F.col("digest").alias("fingerprint"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("best.id2").alias("best_id"), F.col("best.offset").alias("best_offset"), F.col("best.error").alias("best_error"))
