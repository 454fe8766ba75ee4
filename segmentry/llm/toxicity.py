"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a short fixed list and beginnings of words learned from labels: those of 4 to 8 letters, or whole words,
that occur in at least ``LEAST`` toxic texts of the sample and hardly in others; all of them are kept, as the sample is
bounded. Features count hits of both (plain, and
again after undoing obfuscation: digits and signs for letters, stretched and spelled-out words), their density, their
distance to second-person words, capitals, punctuation, signs inside words and length. Nothing but the text is an input.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those with the least hash of their id, among rows with
crc32(id) mod 3 <> 1; scoring reads every whole text. The trees are grown on histograms in numpy. The calibration is
fitted on out-of-fold margins: for each fold both the lexicon and the trees come from the other folds.

Edge cases: null and empty texts have all-zero features and a score like others; without labelled rows of both classes
the score is the share of toxic rows (0.5 without any); several labels of a document: the highest; equal texts score
alike, so ties stay ties; texts of any length are read whole; an empty table gives no rows; a column named like the output
is replaced, others pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, texts, with_arrow

TRAIN_ROWS = 12_000
LEAST = 8
FOLDS = 4
THRESHOLD = 0.7

#: Insults, and words of the second person, of four languages.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown idiota imbécile connard ordure arschloch dummkopf abschaum estúpido basura".split())
SECOND = frozenset("you your yours yourself du dich dir dein deine tu te toi ton ta vous votre tú ti usted vosotros".split())
#: Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"\b(?=\w*[^\W\d_])[\w@$!*]*[0-9@$!*][\w@$!*]*[^\W\d_]\b")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
SPELLED = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
NAMES = ("log_words", "hits", "hit_share", "kinds", "learned", "learned_share", "learned_kinds", "hidden", "near_you", "you_share", "capitals", "shouted", "marks", "exclamations", "mixed")


@dataclass
class Lexicon:
    words: frozenset = frozenset()
    starts: tuple[frozenset, ...] = tuple(frozenset() for _ in range(5))

    def __post_init__(self):
        self.used = [(n, s) for n, s in zip(range(4, 9), self.starts) if s]

    def has(self, word: str) -> bool:
        return word in self.words or any(word[:n] in s for n, s in self.used)


def undone(text: str) -> list[str]:
    """Words that obfuscated stretches of a lower-case text may stand for."""
    found = [w for m in MIXED.finditer(text) for w in WORD.findall(m[0].translate(SIGNS))]
    found += [re.sub(r"[ .\-_*]", "", m[0]) for m in SPELLED.finditer(text)]
    for m in STRETCHED.finditer(text):
        a, b = m.start(), m.end()
        while a and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        found += [STRETCHED.sub(r"\1", text[a:b]), STRETCHED.sub(r"\1\1", text[a:b])]
    return found


def features(text: str, *lexicons: Lexicon) -> list[float]:
    """The features of a text for one lexicon, or for several one after another."""
    if not text:
        return [0.0] * len(NAMES) * len(lexicons)
    low = text.lower()
    words = WORD.findall(low)
    n, kinds = max(1, len(words)), set(words)
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    maybe = undone(low)
    you = np.array([i for i, w in enumerate(words) if w in SECOND])
    data = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    capital, small = int(data[65:91].sum()), int(data[97:123].sum())
    marks = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
    size = len(text)
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if capital * 4 > small else 0
    mixed = sum(1 for _ in MIXED.finditer(low)) if data[48:58].any() or data[[33, 36, 42, 64]].any() else 0
    out: list[float] = []
    for lexicon in lexicons:
        own = {w for w in kinds if lexicon.has(w)}
        learned = [i for i, w in enumerate(words) if w in own] if own else []
        hidden = sum(w in INSULTS or lexicon.has(w) for w in maybe)
        near = 0
        if len(you) and (fixed or learned):
            hits = np.array(sorted({*fixed, *learned}))
            spot = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(spot, len(you) - 1)] - hits), np.abs(you[np.maximum(spot - 1, 0)] - hits))
            near = int((gap <= 5).sum())
        out += [
            float(np.log1p(len(words))), len(fixed), len(fixed) / n, len({words[i] for i in fixed}), len(learned), len(learned) / n,
            len(own), hidden, near, len(you) / n, capital / max(1, capital + small), shouted / n, marks / size, data[33] / size, mixed / n,
        ]
    return out


@dataclass
class Trees:
    """Boosted trees of depth 3 as arrays: feature and threshold of 7 inner nodes, value of 8 leaves."""

    base: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for which, cut, value in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(3):
                at = at * 2 + 1 + (x[rows, which[at]] > cut[at])
            out += value[at - 7]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 50, rate: float = 0.2, bins: int = 48, penalty: float = 2.0) -> Trees:
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model = Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins)[:-1])) if len(np.unique(c)) > bins else np.unique(c)[:-1] for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        which, cut, value = np.zeros(7, dtype=np.int64), np.full(7, np.inf), np.zeros(8)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(7):
            here = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(here) >= 20:
                whole_g, whole_h = g[here].sum(), h[here].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[here, f]
                    left_g, left_h = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[here], h[here]))
                    gain = left_g**2 / (left_h + penalty) + (whole_g - left_g) ** 2 / (whole_h - left_h + penalty) - whole_g**2 / (whole_h + penalty)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(c[k]))
            which[node], cut[node] = best[1], best[2]
            at[here] = node * 2 + 1 + (x[here, best[1]] > best[2])
        for leaf in range(8):
            here = at == leaf + 7
            value[leaf] = rate * g[here].sum() / (h[here].sum() + penalty)
        model.nodes.append((which, cut, value))
        margin += value[at - 7]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (centre of each block's scores, its share of ones, shrunk by one row of doubt)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate(np.array([(b[1] + 0.5 * y.mean()) / (b[2] + 0.5) for b in blocks]))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, batch: list[str]) -> np.ndarray:
        if not batch:
            return np.zeros(0)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in batch], dtype=float))
        shown = np.interp(margin, *self.knots) if len(self.knots[0]) else np.full(len(batch), 0.5)
        # rows of one block differ by so little that only their order shows
        return np.clip(shown + 1e-6 * (1 / (1 + np.exp(-margin)) - 0.5), 0.0, 1.0)


def _units(text: str) -> set[str]:
    """Whole words (marked by a full stop) and beginnings of longer ones."""
    words = set(WORD.findall(text.lower()))
    return {w + "." for w in words if len(w) > 2} | {w[:n] for w in words for n in range(4, 9) if len(w) > n}


def _lexicon(units: list[str]) -> Lexicon:
    starts = tuple(frozenset(u for u in units if len(u) == n and not u.endswith(".")) for n in range(4, 9))
    return Lexicon(frozenset(u[:-1] for u in units if u.endswith(".")), starts)


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From (text, toxic, fold): the lexicon of all rows, then for each fold that of the others.

    Terms count by how many toxic and other texts of each fold have them, summed in each task before the shuffle.
    """
    names = [f"{kind}{k}" for k in range(FOLDS) for kind in ("other", "toxic")]

    def count(batches):
        release()
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, fold in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for unit in _units(text):
                    found.setdefault(unit, [0] * (2 * FOLDS))[2 * fold + toxic] += 1
                if len(found) > 100_000:
                    yield made(found)
                    found = {}
        yield made(found)

    def made(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), type=pa.string()), *(pa.array([v[k] for v in found.values()], type=pa.int64()) for k in range(2 * FOLDS))], names=["unit", *names])

    units = rows.select("text", F.col("toxic").cast("int").alias("toxic"), "fold").mapInArrow(count, ", ".join(["unit string", *(f"{n} long" for n in names)]))
    total = {kind: sum((F.col(f"{kind}{k}") for k in range(1, FOLDS)), F.col(f"{kind}0")) for kind in ("other", "toxic")}
    told = [(total["toxic"] >= LEAST) & (total["toxic"] >= 12 * total["other"])]
    for k in range(FOLDS):
        other, toxic = (total[kind] - F.col(f"{kind}{k}") for kind in ("other", "toxic"))
        told.append((toxic >= LEAST) & (toxic >= 12 * other))
    found = units.groupBy("unit").agg(*[F.sum(n).alias(n) for n in names]).select("unit", F.array(*told).alias("told")).where(F.exists("told", lambda t: t)).collect()
    return [_lexicon(sorted(r["unit"] for r in found if r["told"][i])) for i in range(FOLDS + 1)]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("toxic"))
    sample = marked.orderBy(F.xxhash64(F.lit(11), "_key"), "_key").limit(TRAIN_ROWS)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    train = rows.join(sample, "_key").select("_key", "text", "toxic", F.pmod(F.xxhash64(F.lit(5), "_key"), F.lit(FOLDS)).cast("int").alias("fold")).persist()
    try:
        lexicons = learn_lexicons(train)
        start = lambda: lambda c: [[features(t, *lexicons) for t in texts(c)]]
        got = with_arrow(train, ["text"], [T.StructField("x", T.ArrayType(T.DoubleType()))], start, keep=["_key", "toxic", "fold"]).toArrow()
    finally:
        train.unpersist()
    order = np.argsort(np.array(got.column("_key").to_pylist(), dtype=object).astype(str), kind="stable") if got.num_rows else np.array([], dtype=int)
    y = np.array(got.column("toxic").to_pylist(), dtype=float)[order]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(lexicons[0], Trees(), (np.array([0.0]), np.array([share])))
    x = np.array(got.column("x").to_pylist(), dtype=float)[order].reshape(len(y), FOLDS + 1, len(NAMES))
    fold = np.array(got.column("fold").to_pylist())[order]
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            margin[fold == k] = grow(x[fold != k, k + 1], y[fold != k]).margin(x[fold == k, k + 1])
    return Model(lexicons[0], grow(x[:, 0], y), isotonic(margin, y))


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the calibrated score of each whole text."""
    return with_arrow(docs, [text], [T.StructField(out, T.DoubleType())], lambda: lambda c: [model.scores(texts(c)).tolist()])
