"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

Encoding. A token sequence is what the merges give for its bytes exactly if every token encodes to itself and every two
neighbours t, u satisfy encode(t + u) = [t, u]. That makes encoding a rational relation: the states of a
nondeterministic machine are (last token, prefix of the next token). The machine is determinised lazily, by the subset
construction for subsequential transducers: a state holds all live threads with the tokens that not all threads agree on
yet, and a transition emits the tokens that all of them share. A thread dies once its prefix is no prefix of a token, so
the lookahead is bounded by the longest token. Tokens that have been emitted are known to a state only by what they still
say about the next token (see ``Transducer``), so states of different histories are one. States and transitions are made
when text first needs them; once there are ``MAX_STATES`` the table starts anew from the state that is reached, as lazy
automata do: that bounds memory, and every match goes through the machine.

With the pattern of ``public_tokenizers`` a single space between two other characters always starts a new match, so texts
are cut there first and the ids of the short stretches between are remembered; other patterns are matched as they are.

Decoding. Tokens may split characters. The decoder is an incremental UTF-8 machine over tokens: its state is the bytes of
an unfinished character, a transition emits whole characters only.

Edge cases: null and empty texts have no tokens; repeated rows are encoded alike; a text of any length is read match by
match, so memory holds its tokens but never a table over its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Sequence

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept, texts, with_arrow

MAX_STATES = 250_000
MAX_KNOWN = 500_000
MAX_PAIRS = 60_000
#: Above all ranks; and the guard of a border that no token is left of.
NEVER = 1 << 40
OPEN: tuple = ((), ())
#: Longer stretches are encoded each time and not remembered.
LONGEST_PIECE = 64
#: Marks that follow a word and are one match then.
MARKS = frozenset(".,;:!?")
#: A space beside other white space, or at an end, where a text cannot be cut at single spaces.
SPACES = re.compile(r" \s|\s |^ | $")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Bytes of one match of the pattern in, ids out.

    Whether a token may follow another is a matter of the pieces at their border. The right spine of the first one is
    the token itself, the right half of its last merge, that one's right half, and so on; the left spine of the second
    one likewise. A piece is at the border from its own merge until the merge of the piece above it. Two pieces x and y
    that are there at the same time, and whose joint x + y is a token, would have been merged before. So all that a token
    tells its followers is a list: for each y the least bound that the piece above y must stay below. This list,
    restricted to what the bytes read since then allow, is the guard of a state and stands for the token.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int | None = None):
        self.ranks, self.most_states = ranks, most_states or MAX_STATES
        self.spelled = {i: b for b, i in ranks.items()}
        # what a begun token may become: its id (or -1), and whether a longer token begins with it
        begun = {t[:n] for t in ranks for n in range(1, len(t))}
        self.grows = {t: (ranks.get(t, -1), t in begun) for t in begun | ranks.keys()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.lefts: dict[int, dict[int, int]] = {}  # of a token's left spine: length of the piece -> rank of the merge that ends it
        self.guards: dict[tuple[int, bytes], tuple] = {}
        # a state: (guard of the token emitted last, threads); a thread: (tokens not yet emitted, guard of the last of
        # them, bytes of the next token). The guard in front belongs to the thread without waiting tokens.
        self.start = (((), OPEN, b""),)
        self._forget()

    def _forget(self) -> None:
        """Begin with the start state alone; what is needed is made again."""
        self.numbers = {self.start: 0}
        self.states = [self.start]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` joins; (token, token) for one byte; (-1, -1) if merges of its
        bytes do not give it."""
        known = self.halves.get(token)
        if known is None:
            data, rank = self.spelled[token], self.ranks.get
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                found = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                at = min(found)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                known = (token, token)
            else:
                known = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
            self.halves[token] = known
        return known

    def spine(self, token: int, side: int) -> tuple[tuple[bytes, int, int], ...]:
        """(piece, rank of its merge, rank of the merge that ends it) at the token's left (0) or right (1) border."""
        known = self.spines[side].get(token)
        if known is None:
            out, at, ends = [], token, NEVER
            while True:
                piece = self.spelled[at]
                made = at if len(piece) > 1 else -1
                out.append((piece, made, ends))
                if made < 0:
                    break
                at, ends = self.split(at)[side], at
                if at >= ends:
                    raise ValueError("a token whose last merge joins tokens of higher rank")
            known = self.spines[side][token] = tuple(out)
        return known

    def _grown(self, guard: tuple, begun: bytes) -> tuple:
        """The guard when one byte more is read: (bounds as (length of y, bound), right pieces that may still matter)."""
        bounds, pieces = guard
        kept, bound, y = [], NEVER, -2
        for piece in pieces:
            joint = self.grows.get(piece[0] + begun)
            if joint is None:
                continue
            if joint[1]:
                kept.append(piece)
            if joint[0] >= 0:
                if y == -2:
                    y = self.ranks.get(begun, -2) if len(begun) > 1 else -1
                if (y >= 0 or len(begun) == 1) and max(joint[0], y) < piece[2]:
                    bound = min(bound, max(joint[0], piece[1]))
        if bound < NEVER:
            bounds = (*bounds, (len(begun), bound))
        return bounds, tuple(kept)

    def guard(self, last: int, begun: bytes) -> tuple:
        """What ``last`` still says about tokens that begin with ``begun``."""
        known = self.guards.get((last, begun))
        if known is None:
            known = self._grown(self.guard(last, begun[:-1]), begun) if begun else ((), self.spine(last, 1))
            if len(self.guards) >= max(MAX_PAIRS, self.most_states):
                self.guards.clear()
            self.guards[last, begun] = known
        return known

    def may_follow(self, guard: tuple, token: int) -> bool:
        """Whether no merge reaches over the border; ``guard`` is grown to the token's bytes."""
        if self.split(token)[0] < 0:
            return False
        bounds = guard[0]
        if bounds:
            lefts = self.lefts.get(token)
            if lefts is None:
                lefts = self.lefts[token] = {len(piece): ends for piece, _, ends in self.spine(token, 0)}
            for length, bound in bounds:
                if bound <= lefts.get(length, -1):
                    return False
        return True

    def follows(self, last: int, token: int) -> bool:
        return self.may_follow(self.guard(last, self.spelled[token]), token)

    def _move(self, at: tuple, byte: bytes) -> tuple[tuple, tuple[int, ...]]:
        grown = []
        grows = self.grows.get
        for waiting, guard, begun in at:
            begun += byte
            known = grows(begun)
            if known:
                guard = self.guard(waiting[-1], begun) if waiting else self._grown(guard, begun)
                if known[1]:
                    grown.append((waiting, guard, begun))
                if known[0] >= 0 and self.may_follow(guard, known[0]):
                    grown.append(((*waiting, known[0]), self.guard(known[0], b""), b""))
        shared = 0
        if grown:
            first = grown[0][0]
            least = min(len(g[0]) for g in grown)
            while shared < least and all(g[0][shared] == first[shared] for g in grown):
                shared += 1
        # guards of threads with waiting tokens follow from these; only the other one's is part of the state
        return tuple([(w[shared:], g if len(w) == shared else None, b) for w, g, b in grown]), first[:shared] if shared else ()

    def run(self, data: bytes) -> list[int]:
        number, out, known = 0, [], self.moves.get
        for n, byte in enumerate(data):
            move = known(number << 8 | byte)
            if move is None:
                at, tokens = self._move(self.states[number], data[n : n + 1])
                if len(self.states) >= self.most_states:
                    self._forget()
                    known = self.moves.get
                    number = self._number(at)
                    out += tokens
                    continue
                move = self.moves[number << 8 | byte] = (self._number(at), tokens)
            number = move[0]
            out += move[1]
        for waiting, _, begun in self.states[number]:
            if not begun:
                out += waiting
                return out
        raise ValueError("bytes without a token in the vocabulary")

    def _number(self, at: tuple) -> int:
        to = self.numbers.get(at)
        if to is None:
            to = self.numbers[at] = len(self.states)
            self.states.append(at)
        return to


class Remembered:
    """What was used lately: two generations of at most ``most`` entries; the older goes when the newer is full.

    The ids are held as tuples: the garbage collector walks over every list that lives, and over a tuple of numbers once.
    """

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def add(self, key: str, ids: Sequence[int]) -> tuple[int, ...]:
        ids = tuple(ids)
        if len(key) <= LONGEST_PIECE:
            if len(self.new) >= self.most:
                self.old = self.new.copy()
                self.new.clear()  # the same object: users hold its ``get``
            self.new[key] = ids
        return ids


class Encoder:
    """Texts to ids: each match of the pattern goes through the transducer.

    ``most_states`` and ``most_known`` bound its tables; smaller ones take less memory and more time, for the same ids.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_states: int | None = None, most_known: int | None = None):
        self.machine = Transducer(ranks, most_states)
        self.matches = regex.compile(pattern)
        self.pieces, self.words = (Remembered(most_known or MAX_KNOWN) for _ in range(2))
        self.cut_at_spaces = pattern == public_tokenizers.PATTERN

    def _stretch(self, stretch: str) -> list[int]:
        ids: list[int] = []
        pieces = self.pieces
        for match in self.matches.finditer(stretch):
            piece = match[0]
            found = pieces.new.get(piece)
            if found is None:
                found = pieces.add(piece, pieces.old.get(piece) or self.machine.run(piece.encode()))
            ids += found
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a space and then ``word``."""
        words = self.words
        ids = words.old.get(word)
        if ids is None:
            if word.isalpha():  # one match
                ids = self.machine.run(b" " + word.encode())
            elif word[-1] in MARKS and word[:-1].isalpha():  # two matches
                ids = (*(words.new.get(word[:-1]) or self._word(word[:-1])), *self._stretch(word[-1]))
            else:
                ids = self._stretch(" " + word)
        return words.add(word, ids)

    def encode(self, text: str) -> list[int]:
        if not self.cut_at_spaces or SPACES.search(text):
            return self._stretch(text)
        first, *words = text.split(" ")
        ids = self._stretch(first)
        known, make = self.words.new.get, self._word
        for word in words:
            ids += known(word) or make(word)
        return ids


def coders(path: str, pattern: str, most_states: int | None = None, most_known: int | None = None) -> tuple[Encoder, Decoder]:
    """This process's coders; Python workers serve many tasks."""

    def make():
        encoder = Encoder(load_ranks(path), pattern, most_states, most_known)
        return encoder, Decoder(encoder.machine.spelled)

    return kept((path, pattern, most_states, most_known), make)


class Decoder:
    """Ids to bytes of whole characters; ``feed`` may be called with any cut of the ids."""

    #: Bytes that follow a leading byte, by the leading byte's value.
    FOLLOWING = [0] * 192 + [0, 0] + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11

    def __init__(self, spelled: dict[int, bytes]):
        self.spelled = spelled
        self.tables: dict[bytes, dict[int, tuple[dict, bytes]]] = {b"": {}}
        self.names = {id(self.tables[b""]): b""}
        self.at = self.tables[b""]
        self.closed = {i: b for i, b in spelled.items() if self._move(self.at, i)[0] is self.at}

    def _move(self, table: dict, token: int) -> tuple[dict, bytes]:
        data = self.names[id(table)] + self.spelled[token]
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                if self.FOLLOWING[lead] >= back:
                    cut = len(data) - back
                break
            if lead < 0x80:
                break
        rest = data[cut:]
        if rest not in self.tables:
            self.tables[rest] = {}
            self.names[id(self.tables[rest])] = rest
        move = table[token] = (self.tables[rest], data[:cut])
        return move

    def feed(self, ids: Sequence[int]) -> bytes:
        table, out = self.at, []
        if table is self.tables[b""]:
            try:  # characters end with each token
                return b"".join(map(self.closed.__getitem__, ids))
            except KeyError:
                pass
        for token in ids:
            move = table.get(token) or self._move(table, token)
            table = move[0]
            out.append(move[1])
        self.at = table
        return b"".join(out)

    def finish(self) -> bytes:
        """The bytes of an unfinished last character, if any."""
        rest, self.at = self.names[id(self.at)], self.tables[b""]
        return rest

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.feed(ids) + self.finish()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text; ``out`` replaces a column of that name."""

    def start():
        encoder, _ = coders(path, pattern)
        return lambda column: [[encoder.encode(t) for t in texts(column)]]

    return with_arrow(docs, [text], [T.StructField(out, T.ArrayType(T.IntegerType(), False))], start, keeps=True)


def decode(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """Add the text of each list of ids (null: empty); malformed UTF-8 becomes U+FFFD."""

    def start():
        decoder = Decoder({i: b for b, i in load_ranks(path).items()})
        return lambda column: [[decoder.decode(x or ()).decode("utf-8", "replace") for x in column.to_pylist()]]

    return with_arrow(docs, [ids], [T.StructField(out, T.StringType())], start)


def decimal_digest(ids: list[int], written: dict[int, bytes]) -> str:
    """SHA-256 of the decimal ids joined by commas."""
    digest = hashlib.sha256()
    for part, begin in enumerate(range(0, len(ids), 1 << 16)):
        digest.update((b"," if part else b"") + b",".join(map(written.__getitem__, ids[begin : begin + (1 << 16)])))
    return digest.hexdigest()


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", most_states: int | None = None, most_known: int | None = None) -> DataFrame:
    """Encode each whole text, decode its ids again, and give count and digests of both.

    Returns ``key``, n_tokens, ids_sha256 and decoded_sha256. The ids stay in the Python worker: only the digests travel.
    """

    def start():
        encoder, decoder = coders(path, pattern, most_states, most_known)
        written = {i: b"%d" % i for i in encoder.machine.spelled}

        def run(column):
            counts, ids_digests, text_digests = [], [], []
            for t in texts(column):
                ids = encoder.encode(t)
                counts.append(len(ids))
                ids_digests.append(decimal_digest(ids, written))
                text_digests.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            return [counts, ids_digests, text_digests]

        return run

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_arrow(docs, [text], made, start, keep=[key], keeps=True)
