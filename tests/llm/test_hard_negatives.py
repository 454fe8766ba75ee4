import math
import random

import pytest
from pyspark.sql import functions as F

from segmentry.llm import hard_negatives as hn
from segmentry.llm.queries import op13_hard_negatives


def brute(rows, anchors_of=100, k=5):
    used = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used[(i, label, tuple(math.floor(256 * x) for x in v))] = 1
    used = list(used)
    out = []
    for a in used:
        if a[0] % anchors_of:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in used)
        first = [(-s, i) for s, i, label in scored if label == a[1] and i != a[0]][:k]
        for score, p in first:
            near = [(-s, i) for s, i, label in scored if label != a[1] and 80 * score <= -100 * s <= 100 * score][:k]
            out += [(a[0], p, rank + 1, i, score, s) for rank, (s, i) in enumerate(near)]
    return sorted(out)


def made(n, seed=1, ties=False):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        v = [round(x + rnd.gauss(0, 0.03), 1 if ties else 4) for x in c]
        rows.append((i, rnd.choice([0, 1, 1, 1, 2]), v))
    rows += [(None, 1, [0.1] * 8), (3000, None, [0.1] * 8), (3100, 1, None), (3200, 1, [0.1, None] + [0.1] * 6), (3300, 1, [float("nan")] * 8), (3400, 1, [float("inf")] * 8), (-100, 2, [0.1] * 8), rows[0], rows[0]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("ties", [False, True])
def test_equals_brute_force(spark, monkeypatch, ties):
    rows = made(600, ties=ties)
    want = brute(rows)
    assert want
    assert got(hn.mine(frame(spark, rows).withColumn("id", F.lit("extra")))) == want
    monkeypatch.setattr(hn, "FEW", 2)
    monkeypatch.setattr(hn, "DIGIT", 3)
    monkeypatch.setattr(hn, "BLOCK", 2)
    monkeypatch.setattr(hn, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", 3)
    assert got(hn.mine(frame(spark, rows))) == want


def test_copies_of_one_vector_and_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(hn, "FEW", 2)
    rows = made(250) + [(1000 + i, i % 3, [0.2] * 8) for i in range(600)] + [(100, 0, [0.2] * 8)] + [(77, 1, [0.1 + 0.01 * i] * 8) for i in range(6)]
    assert got(hn.mine(frame(spark, rows))) == brute(rows)


def test_edges(spark):
    assert hn.mine(frame(spark, [])).count() == 0
    assert got(hn.mine(frame(spark, [(100, 1, [0.5]), (101, 1, [0.5, 0.5]), (102, 2, [0.5, 0.1]), (103, 2, [])]))) == [(100, 101, 1, 102, 16384, 16384)]
    with pytest.raises(ValueError):
        hn.mine(frame(spark, [(100, 1, [1e30])]))


def test_query(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute(rows)
    assert got(op13_hard_negatives(spark, "/root/testdata/sf0.01")) == want and want
