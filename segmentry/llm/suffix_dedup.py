"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` = 200 bytes that covers it starts anywhere else too. The suffixes, cut to 200 bytes,
are sorted one bucket at a time, so no task holds more than a few buckets:

1. Buckets. A 200-byte string's bucket is its least hashed 32-byte gram (leftmost of equals) and that gram's place in it,
   so equal strings share a bucket, whatever document they are in. Neighbouring strings of a document with the same gram
   travel as one stretch of text.
2. Only grams that occur twice matter. Their counts are summed before the shuffle; all other stretches stay where they are.
3. Frequent grams. A stretch whose gram is frequent is cut by the place of the gram into 8 or 64 parts, and a part's key
   is all the bytes that its strings have in common. A common line or licence is thereby divided among as many keys as
   it has different surroundings. Nothing is dropped.
4. Equal stretches are merged in each task before the shuffle and count once with their number.
5. Within a key the strings of a bucket are sorted by their first 32 bytes; ties are resolved by the ranks of the suffixes
   at a difference cover of 0..31, relative to the gram: one look at the next cover place instead of a comparison of up
   to 200 bytes. The ranks are made once for a block of buckets, for those cover places that its ties meet, before the
   ties are resolved. Sorted neighbours that agree in 200 bytes are repeats (compared byte for byte).

Memory: texts are read in pieces of 1 MiB, and buckets sorted 1 MiB at a time; a larger key is sorted in shares. Of a gram
that is cut into 64 parts a key's stretches share 198 of at most 202 bytes, so its different ones are few.

Edge cases: null texts count as empty; texts shorter than 200 bytes lose nothing; rows that are equal in id and text
are repeats of each other and all stay as rows; any length of text; extra columns are ignored, also those named like an
output; ties: all copies of a string go, the first one too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, join_uneven, with_arrow

LENGTH = 200
GRAM = 32
GRAMS = LENGTH - GRAM + 1
#: A difference cover of 0..31: every difference modulo 32 is one of two of its members.
COVER, PERIOD = (0, 1, 2, 4, 8, 13, 18), 32
#: Strings that are sorted at a time, and bytes of text that a task reads or buckets hold at a time.
AT_ONCE = 200_000
BYTES_AT_ONCE = 1 << 20
#: Grams that occur more often are cut into 8 or 64 parts: all stretches of a gram, or of a part, are to fit in memory.
OFTEN = BYTES_AT_ONCE // (LENGTH + GRAMS)
VERY_OFTEN = 8 * OFTEN
#: Stretches that a task remembers to have sent.
MOST_SENT = 200_000
#: Rows of an Arrow batch that become Python objects at a time.
ROWS_AT_ONCE = 256
LOW = (1 << 31) - 1


def cover_steps(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """For each residue the steps to the next place in the cover."""
    return np.array([next(s for s in range(period) if (r + s) % period in cover) for r in range(period)])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the grams at each place, by doubling."""
    h = data.astype(np.uint64)
    h += np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + h[step:] * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(text number, begin in text, strings, gram's place from the begin, gram's hash) of each stretch of joined texts."""
    none = np.zeros(0, dtype=np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none
    hashes = gram_hashes(data)
    tagged = (hashes >> np.uint64(33)).astype(np.int64) << 31 | np.arange(len(hashes), dtype=np.int64)
    # least of each GRAMS neighbours: from block begins and from block ends
    size = -(-len(tagged) // GRAMS) * GRAMS
    padded = np.full(size, np.iinfo(np.int64).max)
    padded[: len(tagged)] = tagged
    blocks = padded.reshape(-1, GRAMS)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = np.minimum(backward[:n], forward[GRAMS - 1 : GRAMS - 1 + n]) & LOW
    whole = np.zeros(n + 1, dtype=np.int8)
    for a, b in zip(starts, ends):
        if b - a >= LENGTH:
            whole[a : b - LENGTH + 1] = 1
    whole = whole[:n].astype(bool)
    changed = np.ones(n, dtype=bool)
    changed[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    begins = np.flatnonzero(changed & whole)
    if not len(begins):
        return none, none, none, none, none
    # a stretch ends before the next one or where its text has no more strings
    text = np.searchsorted(starts, begins, side="right") - 1
    last = np.minimum(np.r_[begins[1:], n], ends[text] - LENGTH + 1)
    place = anchor[begins] - begins
    return text, begins - starts[text], last - begins, place, hashes[anchor[begins]].view(np.int64)


def _joined(column: pa.Array):
    """Groups of about ``BYTES_AT_ONCE`` at most: (row, begin in its text, bytes) of texts, longer ones cut into pieces.

    Pieces overlap by a string less one byte, so each string lies in one of them. Texts without strings are left out.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(column):
        text = t.as_py() or b""
        for begin in range(0, len(text) - LENGTH + 1, BYTES_AT_ONCE):
            piece = text[begin : begin + BYTES_AT_ONCE + LENGTH - 1]
            if held and size + len(piece) > BYTES_AT_ONCE + LENGTH:
                yield held
                held, size = [], 0
            held.append((i, begin, piece))
            size += len(piece)
    if held:
        yield held


def _buffer(held: list[bytes]):
    """Joined texts, and where each starts and ends."""
    lengths = np.array([len(t) for t in held], dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(held), dtype=np.uint8), ends - lengths, ends


def _slices(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def _places(batches):
    """(id, tk, text) to one row for each stretch: id, tk, where (begin, strings and place in one number), gram."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for held in _joined(batch.column(2)):
            text, begin, strings, place, gram = stretches(*_buffer([h[2] for h in held]))
            rows, begins = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            row = pa.array(rows[text])
            arrays = [batch.column(0).take(row), batch.column(1).take(row), pa.array(begin + begins[text] << 16 | strings << 8 | place), pa.array(gram)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "tk", "where", "gram"])


def _grams(batches):
    """Only the grams, for counting."""
    for batch in _places(batches):
        yield batch.select(["gram"])


def _cut(batches):
    """(id, tk, text, stretches) to occurrences: ident, key, place, id, tk, begin, strings.

    One row of a batch for each ident has its number there, and the bytes, which are empty if the task has sent them
    before; the others' are null.
    """
    sent: set[bytes] = set()
    names = ["ident", "key", "place", "id", "tk", "begin", "strings", "number", "bytes"]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    for batch in (part for whole in batches for part in _slices(whole)):
        rows: list[list] = []
        seen: dict[bytes, int] = {}
        size = 0
        for doc, tk, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for where, parts in {(w["where"], w["parts"]) for w in wanted}:
                begin, strings, place = where >> 16, where >> 8 & 255, where & 255
                anchor = begin + place
                width = -(-GRAMS // parts)
                # string j of the stretch has the gram at place - j; parts are intervals of that place
                j = 0
                while j < strings:
                    part = (place - j) // width
                    low, high = part * width, min(GRAMS, (part + 1) * width) - 1
                    n = min(strings - j, place - j - low + 1)
                    piece = text[begin + j : begin + j + n - 1 + LENGTH]
                    core = text[anchor - low : anchor - high + LENGTH]
                    key = hashlib.blake2b(core, digest_size=8, salt=b"%d.%d" % (parts, part)).digest()
                    ident = hashlib.blake2b(piece, digest_size=16, key=key, salt=b"%d" % (place - j)).digest()
                    known = seen.get(ident)
                    if known is None:
                        seen[ident] = len(rows)
                        if ident in sent:
                            piece = b""
                        elif len(sent) < MOST_SENT:
                            sent.add(ident)
                        rows.append([ident, int.from_bytes(key, "big", signed=True), place - j, doc, tk, begin + j, n, 1, piece])
                        size += len(piece)
                    else:
                        rows[known][7] += 1
                        rows.append([ident, rows[known][1], place - j, doc, tk, begin + j, n, 0, None])
                    size += 100
                    j += n
            if size > BYTES_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
                rows, seen, size = [], {}, 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


def repeated(pieces: list[bytes], places: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """For each stretch which of its strings also start in another stretch of the same key at the same gram place."""
    counts = np.array([len(p) - LENGTH + 1 for p in pieces], dtype=np.int64)
    # the gram of each stretch lies at a multiple of the period, so a bucket's strings have the cover at equal steps
    base = np.zeros(len(pieces), dtype=np.int64)
    at, chunks = 0, []
    for i, p in enumerate(pieces):
        pad = -(at + int(places[i])) % PERIOD
        base[i] = at + pad
        chunks += [bytes(pad), p]
        at += pad + len(p)
    data = np.frombuffer(b"".join(chunks) + bytes(2 * LENGTH + PERIOD + 8), dtype=np.uint8)
    words = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | data[k : len(data) - 7 + k]
    owner = np.repeat(np.arange(len(pieces)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    spot, place = base[owner] + inner, places[owner] - inner
    found = np.zeros(len(owner), dtype=bool)
    _, key_number = np.unique(keys, return_inverse=True)
    bucket = key_number[owner] * np.int64(LENGTH + 1) + place
    steps = cover_steps()
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    # whole buckets, one after another, up to AT_ONCE strings together
    begin = 0
    while begin < len(edges) - 1:
        end = begin + 1
        while end < len(edges) - 1 and edges[end + 1] - edges[begin] <= AT_ONCE:
            end += 1
        rows = order[edges[begin] : edges[end]]
        begin = end
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[rows]) != 0]), len(rows)])
        rows = rows[np.repeat(sizes, sizes) > 1]
        if not len(rows):
            continue
        p, b = spot[rows], bucket[rows]
        sort = np.lexsort((words[p + 24], words[p + 16], words[p + 8], words[p], b))
        rows, p, b = rows[sort], p[sort], b[sort]
        tied = (b[1:] == b[:-1]) & (words[p[1:]] == words[p[:-1]]) & (words[p[1:] + 8] == words[p[:-1] + 8]) & (words[p[1:] + 16] == words[p[:-1] + 16]) & (words[p[1:] + 24] == words[p[:-1] + 24])
        tie = np.cumsum(np.r_[True, ~tied])
        within = np.r_[False, tied] | np.r_[tied, False]
        rows, p, tie = rows[within], p[within], tie[within]
        if not len(rows):
            continue
        # ranks of the cover suffixes that these strings meet first
        meets = p + steps[p % PERIOD]
        sample, back = np.unique(meets, return_inverse=True)
        ranks = np.zeros(len(sample), dtype=np.int64)
        suffix = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[sample]
        suffix_order = np.argsort(np.ascontiguousarray(suffix).view(f"V{LENGTH}").reshape(-1), kind="stable")
        ranks[suffix_order] = np.arange(len(sample))
        del suffix
        sort = np.lexsort((ranks[back], tie))
        rows, p, tie = rows[sort], p[sort], tie[sort]
        same = np.flatnonzero(tie[1:] == tie[:-1])
        for k in range(32, LENGTH, 8):
            same = same[words[p[same] + k] == words[p[same + 1] + k]]
        found[rows[same]] = True
        found[rows[same + 1]] = True
    return np.split(found, np.cumsum(counts)[:-1]) if len(counts) else []


def repeated_in_large_key(pieces: list[bytes], places: np.ndarray) -> list[np.ndarray]:
    """``repeated`` for one key of any size: a place at a time, and its strings in shares by their checksum."""
    found = [np.zeros(len(p) - LENGTH + 1, dtype=bool) for p in pieces]
    for place in range(GRAMS):
        here = [i for i, p in enumerate(pieces) if 0 <= places[i] - place < len(found[i])]
        strings = [pieces[i][places[i] - place : places[i] - place + LENGTH] for i in here]
        n = -(-len(here) * LENGTH // BYTES_AT_ONCE)
        share = np.array([zlib.crc32(x) % n for x in strings], dtype=np.int64)
        for k in range(n):
            rows = np.flatnonzero(share == k)
            if len(rows) > 1:
                for r, hit in zip(rows, repeated([strings[r] for r in rows], np.full(len(rows), place), np.zeros(len(rows), dtype=np.int64))):
                    found[here[r]][places[here[r]] - place] = hit[0]
    return found


def _sorted_buckets(batches):
    """(key, ident, place, number, bytes), sorted by key and ident, to (ident, mask) of stretches with repeated strings.

    Equal stretches follow each other, so they are merged as they come. Keys are sorted together up to ``BYTES_AT_ONCE``;
    what a key has beyond that (different stretches of one core) is sorted in shares.
    """
    keys: list[int] = []
    held: list[list] = []  # ident, place, number, piece
    size, begin = 0, 0  # of all that is held; where the last key begins

    def settle(keys, held):
        several = Counter(keys)
        masks = {ident: np.ones(len(piece) - LENGTH + 1, dtype=bool) for ident, _, number, piece in held if number > 1}
        some = [i for i, k in enumerate(keys) if several[k] > 1]
        if some:
            pieces, places = [held[i][3] for i in some], np.array([held[i][1] for i in some], dtype=np.int64)
            large = len(several) == 1 and sum(map(len, pieces)) > BYTES_AT_ONCE
            parts = repeated_in_large_key(pieces, places) if large else repeated(pieces, places, np.array([keys[i] for i in some], dtype=np.int64))
            for i, part in zip(some, parts):
                if held[i][0] not in masks and part.any():
                    masks[held[i][0]] = part
        return pa.RecordBatch.from_arrays([pa.array(list(masks), type=pa.binary()), pa.array([np.packbits(m).tobytes() for m in masks.values()], type=pa.binary())], names=["ident", "mask"])

    for batch in (part for whole in batches for part in _slices(whole)):
        for key, ident, place, number, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held and held[-1][0] == ident:
                held[-1][2] += number
                if not held[-1][3]:
                    held[-1][3] = piece
                    size += len(piece)
                continue
            if not keys or key != keys[-1]:
                if size > BYTES_AT_ONCE:
                    # the last key alone if it is the one that is too large
                    for part in (slice(0, begin), slice(begin, None)):
                        if keys[part]:
                            yield settle(keys[part], held[part])
                    keys, held, size = [], [], 0
                begin = len(keys)
            keys.append(key)
            held.append([ident, place, number, piece])
            size += len(piece)
    for part in (slice(0, begin), slice(begin, None)):
        if keys[part]:
            yield settle(keys[part], held[part])


def without(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs."""
    if not spans:
        return text, 0, 0
    begins = np.zeros(len(text) + 1, dtype=np.int32)
    for s in spans:
        n = s["strings"]
        begins[s["begin"] + 1 : s["begin"] + 1 + n] |= np.unpackbits(np.frombuffer(s["mask"], dtype=np.uint8), count=n)
    begun = np.cumsum(begins, dtype=np.int32)
    # a byte is covered if a repeated string began at it or at one of the LENGTH - 1 places before
    gone = begun[1:] > np.concatenate([np.zeros(LENGTH - 1, dtype=np.int32), begun])[: len(text)]
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def find_repeats(docs: DataFrame) -> DataFrame:
    """From (id, tk, bytes): (id, tk, spans), an array of (begin, strings, mask) for each text with repeated strings."""
    read = docs.select("id", "tk", "bytes")
    shape = "id long, tk long, where long, gram long"
    grams = read.mapInArrow(_grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    # the few that are frequent tell how each gram's stretches are cut; their rows are dealt out
    grams = durable(grams)
    parts = F.when(F.col("n") > VERY_OFTEN, 64).when(F.col("n") > OFTEN, 8).otherwise(1).alias("parts")
    wanted = join_uneven(read.mapInArrow(_places, shape), grams, "gram", grams).select("id", "tk", F.struct("where", parts).alias("w"))
    lists = wanted.groupBy("id", "tk").agg(F.collect_list("w").alias("wanted"))
    cut_shape = "ident binary, key long, place int, id long, tk long, begin int, strings int, number long, bytes binary"
    cut = docs.join(lists, (docs.id.eqNullSafe(lists.id)) & (docs.tk == lists.tk)).select(docs.id, docs.tk, "bytes", "wanted").mapInArrow(_cut, cut_shape)
    once = cut.where("bytes is not null").select("key", "ident", "place", "number", "bytes")
    masks = once.repartition("key").sortWithinPartitions("key", "ident").mapInArrow(_sorted_buckets, "ident binary, mask binary")
    back = cut.select("ident", "id", "tk", "begin", "strings").join(masks, "ident")
    return back.groupBy("id", "tk").agg(F.collect_set(F.struct("begin", "strings", "mask")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    base = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tk"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    spans = find_repeats(base)
    joined = base.join(spans, (base.id.eqNullSafe(spans.id)) & (base.tk == spans.tk), "left").select(base.id.alias(key), base.bytes, "spans")

    def start():
        def run(texts, spans):
            whole = texts.to_pylist()
            made = [without(t, s or []) for t, s in zip(whole, spans.to_pylist())]
            return [[m[0] for m in made], [len(t) for t in whole], [m[1] for m in made], [m[2] for m in made], [hashlib.sha256(m[0]).hexdigest() for m in made]]

        return run

    fields = [T.StructField("kept", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    return with_arrow(joined, ["bytes", "spans"], fields, start, keep=[key])
