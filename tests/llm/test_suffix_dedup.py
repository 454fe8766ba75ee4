import hashlib
import random
from collections import Counter

import numpy as np

from segmentry.llm import suffix_dedup as S


def brute(rows):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(k) for k in (45, 50, 60, 90, 200)]
    line = prose(42)[:190]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 199), (4, "b" * 201), (5, "c" * 500), (6, "ab" * 300), (7, "x" * 150 + prose(60)), (8, "z" * 200), (9, "z" * 200), (10, "\0" * 230)]
    for i in range(n):
        t = prose(rnd.randint(5, 200))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(t))
            t = t[:at] + rnd.choice([*passages, line, line]) + t[at:]
        rows.append((100 + i, t))
    for i in range(12):
        t = list(rows[20 + i % 3][1])
        for _ in range(i % 4):
            t[rnd.randrange(len(t))] = "#"
        rows.append((300 + i, "".join(t)))
    return rows + [rows[-1], (None, rows[-1][1]), (None, "w" * 300)]


def same(spark, rows):
    got = S.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)).drop("kept").collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted([tuple(r) for r in got], key=key) == sorted(brute(rows), key=key)


def test_against_brute_force(spark):
    same(spark, corpus(1))


def test_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(S, "OFTEN", 3)
    monkeypatch.setattr(S, "VERY_OFTEN", 10)
    same(spark, corpus(2))


def test_small_blocks(monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 50)
    rnd = np.random.default_rng(1)
    common = rnd.integers(0, 3, 400, dtype=np.uint8).tobytes()
    pieces = [common[:150] + rnd.integers(0, 3, int(k), dtype=np.uint8).tobytes() + common[150 + int(k) : 330] for k in rnd.integers(0, 40, 30)]
    got = S.repeated(pieces, np.full(30, 60), np.arange(30) % 2)
    for a in range(30):
        for j in range(len(pieces[a]) - 199):
            want = any(b != a and b % 2 == a % 2 and pieces[b][j : j + 200] == pieces[a][j : j + 200] and len(pieces[b]) >= j + 200 for b in range(30))
            assert got[a][j] == want


def test_small_pieces_and_large_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "BYTES_AT_ONCE", 700)
    monkeypatch.setattr(S, "ROWS_AT_ONCE", 7)
    same(spark, corpus(5))
    monkeypatch.setattr(S, "OFTEN", 3)
    same(spark, corpus(6))


def test_key_in_shares(monkeypatch):
    rnd = np.random.default_rng(2)
    core = rnd.integers(0, 3, 190, dtype=np.uint8).tobytes()
    pieces = [rnd.integers(0, 2, 8, dtype=np.uint8).tobytes() + core + rnd.integers(0, 2, 8, dtype=np.uint8).tobytes() for _ in range(90)]
    places = np.full(len(pieces), 60)
    want = S.repeated(pieces, places, np.zeros(len(pieces), dtype=np.int64))
    monkeypatch.setattr(S, "BYTES_AT_ONCE", 1500)
    got = S.repeated_in_large_key(pieces, places)
    assert all((a == b).all() for a, b in zip(want, got)) and any(a.any() for a in want) and not all(a.all() for a in want)


def test_a_long_text():
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(7)
    text = rnd.integers(97, 105, 30_000_000, dtype=np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text], pa.binary())], names=["id", "tk", "bytes"])
    tracemalloc.start()
    strings = sum(int((b.column(2).to_numpy() >> 8 & 255).sum()) for b in S._places([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert strings == len(text) - 199 and peak < 250_000_000


def test_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_no_rows(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
