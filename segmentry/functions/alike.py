"""Which texts of two blocks reach a ratio of matched characters: all pairs, by bounds that are cheap for many texts at once.

What an order-preserving match of two texts can take is at most what their characters have in common; and if the alphabet is
divided into groups, at most the sum over the groups of the longest common subsequences of the two texts without all other
characters. So one text is held against a whole block by common characters first (the kinds in which texts differ most,
then all); for those left, group by group, common characters are replaced by the common subsequence of what belongs to the
group, some 60 characters in one machine word of a text, until the bound falls below the threshold. Only pairs that stay
above it are given to the whole longest common subsequence, and only what passes this one to the exact ratio. A call costs as
much for hundreds of texts as for one, so blocks are large, and few long texts lie side by side in one number. Rare characters
share a kind, and what goes beyond the words counts as matched: both raise bounds and lose no pair.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np

from .matching import similarity

#: Kinds of characters that are told apart.
KINDS = 32
ONES, HELD, TOP, FREE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x7FFFFFFFFFFFFFFF), np.uint64(63), 0xFFFFFFFF
#: Characters of a group in one text, on average, that a word takes; words of a group at most.
FILL, WORDS = 54, 8
#: Kinds that are compared first, for so many texts at once.
HEAD, STRETCH = 11, 4096
#: Characters of texts that lie side by side in one number.
LANES = 1 << 15
#: So many texts of several words, and more, are compared word by word.
MANY = 1_000


class Group:
    """What texts hold of some kinds of characters, as bits in order."""

    def __init__(self, kinds: list[int], words: int, kind: np.ndarray, owner: np.ndarray, n: int):
        self.kinds, self.words = kinds, words
        row = np.full(KINDS, -1)
        row[kinds] = np.arange(len(kinds))
        mine = row[kind] >= 0
        row, owner = row[kind[mine]], owner[mine]
        row = row.astype(np.int64)
        sizes = np.bincount(owner, minlength=n)
        place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        width = 63 if words > 1 else 64
        held = place < words * width
        bits = np.zeros(len(kinds) * n * words, dtype=np.uint64)
        np.add.at(bits, (row[held] * n + owner[held]) * words + place[held] // width, np.uint64(1) << (place[held] % width).astype(np.uint64))
        self.bits = bits.reshape(len(kinds), n, words)
        self.beyond = np.maximum(sizes - words * width, 0)
        self.row = {k: i for i, k in enumerate(kinds)}

    def common(self, kinds: list[int], found: np.ndarray) -> np.ndarray:
        """At least the longest common subsequence of a text's kinds and each of the texts found, in this group."""
        rows = [self.row[k] for k in kinds if k in self.row]
        near = self.bits.take(found, axis=1)
        if self.words > 1 and len(found) < MANY:
            step = max(1, LANES // (64 * self.words))
            return np.concatenate([self._at_once(rows, near[:, i : i + step]) for i in range(0, len(found), step)]) + self.beyond[found]
        near = np.ascontiguousarray(near.transpose(0, 2, 1))
        full = HELD if self.words > 1 else ONES
        left = [np.full(len(found), full) for _ in range(self.words)]
        hit, total, carry = (np.empty_like(left[0]) for _ in range(3))
        for r in rows:
            for w, v in enumerate(left):
                np.bitwise_and(v, near[r, w], out=hit)
                np.add(v, hit, out=total)
                if w:
                    np.add(total, carry, out=total)
                if w + 1 < self.words:
                    # the highest bit of a word takes the carry
                    np.right_shift(total, TOP, out=carry)
                np.bitwise_xor(v, hit, out=v)
                np.bitwise_or(v, total, out=v)
                if self.words > 1:
                    np.bitwise_and(v, HELD, out=v)
        return sum(np.bitwise_count(v ^ full).astype(np.int64) for v in left) + self.beyond[found]

    def _at_once(self, rows: list[int], near: np.ndarray) -> np.ndarray:
        """Texts of several words side by side in one number: a text's last bit is free, those of its other words pass a sum on."""
        places = [int.from_bytes(k.tobytes(), "little") for k in near]
        start = np.full(near.shape[1:], ONES)
        start[:, -1] = HELD
        whole = left = int.from_bytes(start.tobytes(), "little")
        for r in rows:
            hit = left & places[r]
            left = (left + hit | left - hit) & whole
        taken = np.frombuffer((whole ^ left).to_bytes(start.nbytes, "little"), dtype=np.uint64)
        return np.bitwise_count(taken).reshape(start.shape).sum(axis=1, dtype=np.int64)


def _common(wanted: Sequence[int], flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The longest common subsequence of a sequence and each of those that lie side by side, each with ``FREE`` behind it.

    All lie in one number: what a sum carries beyond a sequence goes to its free bit.
    """
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    places = {c: number(flat == c) for c in set(wanted)}
    whole = left = number(flat != FREE)
    for c in wanted:
        if at := places[c]:
            hit = left & at
            left = (left + hit | left - hit) & whole
    taken = np.unpackbits(np.frombuffer((whole ^ left).to_bytes(len(flat) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    return np.add.reduceat(taken[: len(flat)], np.append(0, ends[:-1]), dtype=np.int64)


class Block:
    """Texts side by side, by length and id; ``rows`` are (id, text), no text empty."""

    def __init__(self, rows: list[tuple], threshold: float):
        self.rows = sorted(rows, key=lambda r: (len(r[1]), r[0]))
        self.threshold = threshold
        self.sizes = sizes = np.array([len(t) for _, t in self.rows], dtype=np.int64)
        n = len(rows)
        flat = codes("".join(t for _, t in self.rows))
        often = np.bincount(flat)
        letters = np.flatnonzero(often)
        rank = np.empty(len(letters), dtype=np.int64)
        rank[np.argsort(-often[letters], kind="stable")] = np.arange(len(letters))
        # the commonest have a kind of their own; one more is for what no text holds
        self.kinds = np.full(len(often) + 1, KINDS, dtype=np.int64)
        self.kinds[letters] = np.where(rank < KINDS * 3 // 4, rank, KINDS * 3 // 4 + rank % (KINDS // 4))
        self.kind = self.kinds[flat].astype(np.uint8)
        self.owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        self.number = np.uint16 if sizes[-1] < 1 << 15 else np.int64
        counts = np.bincount(self.kind * np.int64(n) + self.owner, minlength=KINDS * n).reshape(KINDS, n)
        # kinds in which texts differ most come first, with the sum of the others
        share = sizes / sizes.sum()
        apart = np.array([np.abs(c - c.sum() * share).sum() for c in counts])
        self.order = np.argsort(-apart, kind="stable")
        counts = counts[self.order]
        self.head = np.ascontiguousarray(np.concatenate([counts[:HEAD], [counts[HEAD:].sum(axis=0)]]).astype(self.number))
        self.counts = np.ascontiguousarray(counts.astype(self.number))
        self.room = np.empty((HEAD + 1, min(n, STRETCH)), dtype=self.number)
        # whole numbers that are no more than what a text adds to the characters that a pair must match
        self.least = np.floor(threshold / 2 * sizes - 1e-6).astype(self.number)
        self.place = np.empty(KINDS, dtype=np.int64)
        self.place[self.order] = np.arange(KINDS)

    @cached_property
    def groups(self) -> list[Group]:
        # rarer kinds first, as many as fill a word of most texts: the more kinds, the less two texts share in order; three at least
        mean = self.counts.mean(axis=1, dtype=np.float64)[self.place]
        groups: list[list[int]] = [[]]
        for k in np.argsort(mean, kind="stable").tolist():
            if mean[k]:
                if len(groups[-1]) >= 3 and mean[groups[-1]].sum() + mean[k] > FILL:
                    groups.append([])
                groups[-1].append(k)
        return [Group(g, int(min(WORDS, 1 + mean[g].sum() // (FILL + 6))), self.kind, self.owner, len(self.rows)) for g in groups if len(g) > 1]

    def _shared(self, own: np.ndarray, counts: np.ndarray, room: np.ndarray) -> np.ndarray:
        np.minimum(counts, own[:, None], out=room)
        return np.add.reduce(room, axis=0, dtype=self.number)

    def may_reach(self, text: str, lo: int) -> np.ndarray:
        """Places, from ``lo`` on, of the texts that may reach the threshold with ``text``."""
        la, t = len(text), self.threshold
        lo = max(lo, int(np.searchsorted(self.sizes, la * t / (2 - t) - 1e-6)))
        hi = int(np.searchsorted(self.sizes, la * (2 - t) / t + 1e-6, "right"))
        if lo >= hi:
            return np.empty(0, dtype=np.int64)
        kinds = self.kinds.take(codes(text), mode="clip")
        own = np.bincount(kinds, minlength=KINDS + 1)[:KINDS]
        # a kind that no count can exceed is cut to the width of the counts
        own = np.minimum(own, np.iinfo(self.number).max)
        ordered = own[self.order].astype(self.number)
        first = np.append(ordered[:HEAD], min(int(own[self.order[HEAD:]].sum()), np.iinfo(self.number).max)).astype(self.number)
        least = self.number(max(0, math.floor(t / 2 * la - 1e-6)))
        near = []
        for at in range(lo, hi, STRETCH):
            end = min(hi, at + STRETCH)
            shared = self._shared(first, self.head[:, at:end], self.room[:, : end - at])
            near.append(np.flatnonzero(shared >= self.least[at:end] + least) + at)
        found = np.concatenate(near)
        if not len(found):
            return found
        counts = self.counts.take(found, axis=1)
        shared = self._shared(ordered, counts, counts).astype(np.int64)
        # how many characters a pair must match
        need = t / 2 * (la + self.sizes[found]) - 1e-6
        here = np.flatnonzero(shared >= need)
        found, shared, need = found[here], shared[here], need[here]
        letters = kinds.tolist()
        for g in self.groups if len(found) * la >= 10 * FILL else ():
            # in microseconds, about; a group may leave half of the texts
            n, size = len(found), int(own[g.kinds].sum())
            if not n or la * (0.4 + 7e-5 * n * la) + 150 < 2 * size * (4 + 1.6e-3 * n if g.words == 1 else 0.5 + 9e-3 * n * g.words if n < MANY else g.words * (8 + 4e-3 * n)):
                break
            rows = self.place[g.kinds]
            counts = self.counts[rows].take(found, axis=1) if len(found) * 4 > len(self.rows) else self.counts[rows[:, None], found]
            now = shared - self._shared(ordered[rows], counts, counts).astype(np.int64) + g.common(letters, found)
            here = np.flatnonzero(now >= need)
            found, shared, need = found[here], now[here], need[here]
        return found


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def common_length(places: dict, whole: int, other: str) -> int:
    """The length of the longest common subsequence of a text (``placed``) and another."""
    left = whole
    for c in other:
        at = places.get(c)
        if at is not None:
            hit = left & at
            left = (left + hit | left - hit) & whole
    return whole.bit_count() - left.bit_count()


def placed(text: str) -> tuple[dict, int]:
    places: dict = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places, (1 << len(text)) - 1


def common_lengths(text: str, others: list[str]) -> np.ndarray:
    """``common_length`` of a text and each of others, which lie side by side in one number with a free bit between them."""
    ends = np.cumsum([len(o) + 1 for o in others])
    flat = codes("\0".join([*others, ""])).copy()
    flat[ends - 1] = FREE
    return _common(list(map(ord, text)), flat, ends)


def _reaching(block: Block, text: str, found: list[int]) -> Iterator[int]:
    """Those of the texts found whose common subsequence with ``text`` allows the threshold."""
    enough = lambda n, other: 2 * n >= block.threshold * (len(text) + len(other)) - 1e-9
    if len(found) * len(text) < 1_000:
        places, whole = placed(text)
        yield from (k for k in found if enough(common_length(places, whole, block.rows[k][1]), block.rows[k][1]))
        return
    step = max(1, LANES // (len(text) + 1))
    for i in range(0, len(found), step):
        some = found[i : i + step]
        others = [block.rows[k][1] for k in some]
        yield from (k for k, n, other in zip(some, common_lengths(text, others).tolist(), others) if enough(n, other))


def alike(block: Block, others: list[tuple] | None, after: bool = False, either: bool = False) -> list[tuple]:
    """(a, b, ratio, ratio of b and a if ``either``) of pairs of (id, text) that reach the block's threshold, a < b; ``others`` None: within the block.

    ``after``: a text meets only those of the block that are longer, or as long and of a higher id.
    """
    out = []
    keys = [(len(t), i) for i, t in block.rows] if after else []
    for i, (one, text) in enumerate(block.rows if others is None else others):
        lo = i + 1 if others is None else bisect.bisect_right(keys, (len(text), one)) if after else 0
        for k in _reaching(block, text, block.may_reach(text, lo).tolist()):
            (a, x), (b, y) = sorted([(one, text), block.rows[k]])
            ratio = similarity(x, y, popular=False)
            back = similarity(y, x, popular=False) if either else None
            if max(ratio, back or 0) >= block.threshold:
                out.append((a, b, ratio, back))
    return out
