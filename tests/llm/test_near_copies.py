import os
import random

import pytest
from pyspark.sql import functions as F

from segmentry.llm import near_copies


def brute(texts):
    """Classes of texts linked at 0.8 or more, over all pairs of five-word sets."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if not (sets[a] | sets[b]) or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


def classes(keys):
    of = {}
    for i, k in enumerate(keys):
        of.setdefault(k, set()).add(i)
    return sorted(map(sorted, of.values()))


def test_groups(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rnd.choice(words) for _ in range(30))
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 5, 6, 9, 40, 120]))] for _ in range(40)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", line]
    for _ in range(400):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w) + (" " + line if rnd.random() < 0.3 else ""))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in near_copies.with_group(df).collect()}
    want = brute(texts)
    assert classes([got[i] for i in range(len(texts))]) == classes(want)
    assert max(map(len, classes(want))) > 5


def test_stage_drops_edited_copies(spark):
    if not os.path.exists("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    first = {}
    for r, g in zip(rows, brute([r.text for r in rows])):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(first.values())


def test_stage_keeps_distinct_texts_of_equal_ids(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    long = [" ".join(f"w{rnd.randrange(500)}" for _ in range(40)) for _ in range(4)]
    rows = [(None, long[0]), (None, long[1]), (3, long[2]), (3, long[3]), (4, long[2]), (None, long[3]), (5, long[0]), (5, long[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, long[1]), (3, long[2]), (3, long[3]), (5, long[0])])


def test_hot_group_of_near_copies_and_names(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(900)}" for _ in range(80)]
    texts = [" ".join(f"v{rnd.randrange(900)}" for _ in range(60)) for _ in range(60)] + [" ".join(base)] * 50
    for _ in range(150):
        w = list(base)
        w[rnd.randrange(80)] = f"x{rnd.randrange(9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, _node string, group string").repartition(5)
    got = near_copies.with_group(df, out="g").collect()
    assert classes([r.g for r in sorted(got)]) == classes(brute(texts)) and {r.group for r in got} == {"b"}
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(60), 60]
    assert near_copies.keep_one(df.limit(0)).collect() == [] == near_copies.with_group(df.limit(0)).collect()


def test_one_against_all_bit_planes():
    import numpy as np

    from segmentry.llm import simhash

    rnd = np.random.default_rng(6)
    fps = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, 3000, dtype=np.uint64)
    fps[:500] = fps[0] ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64))
    planes = simhash.planes_of(fps)
    for radius in (0, 1, 2, 20, 28, 40, 63):
        got = simhash.near_one(planes, int(fps[7]), radius)
        want = [i for i, f in enumerate(fps) if (int(f) ^ int(fps[7])).bit_count() <= radius]
        assert got[got < len(fps)].tolist() == want


def test_hashes_of_words_and_blocks():
    import numpy as np

    rnd = random.Random(4)
    words = [b"a", b"b", b"ab", b"ba", b"\xc3\xa9", b"x" * near_copies.BLOCK, b"x" * (near_copies.BLOCK + 1), b"y" * (2 * near_copies.BLOCK)] + [b"%d" % rnd.randrange(10**9) for _ in range(500)]
    apart = {w: int(near_copies._hashes(w)[0]) for w in words}
    assert len(set(apart.values())) == len(set(words))
    for _ in range(5):
        own = [rnd.choice(words[8:] if rnd.random() < 0.999 else words) for _ in range(20000)]
        assert near_copies._hashes(b" ".join(own)).tolist() == [apart[w] for w in own]
    texts = ["", "a", "a a", "a b", "b a", "a b c d", "a b c d e", "A  b\tc\nd e ", "a b c d e a b c d e a b c d e f", " "]
    for t in texts:
        w = t.lower().split()
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        got = near_copies.shingles(t)
        assert len(got) == len(want) and (np.diff(got) > 0).all() if len(got) > 1 else len(got) == len(want)
    assert near_copies.shingles(texts[6]).tolist() == near_copies.shingles(texts[7]).tolist()
    assert len({near_copies.shingles(t)[0] for t in ("a", "a a", "a b", "b a", "ab", "b  c", "a b c d")}) == 7


def test_work_of_a_large_group(monkeypatch):
    """Bit planes are made anew only as the group halves, and a text is compared by what it differs by."""
    from segmentry.llm import simhash

    made, make = [], simhash.planes_of
    monkeypatch.setattr(simhash, "planes_of", lambda fps: made.append(len(fps)) or make(fps))
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randrange(2, 9)):
            w[rnd.randrange(150)] = f"x{rnd.randrange(900)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:60]), " ".join(base[::-1]), "one two"]
    sets = [near_copies.shingles(t) for t in texts]
    got = near_copies.groups(list(range(len(texts))), sets)
    assert classes(got) == classes(brute(texts)) and len(set(got)) > 20
    assert sum(made) <= 2 * len(texts)
    by = near_copies.Differences(sets)
    for x in range(0, len(sets), 7):
        others = [i for i in range(len(sets)) if i != x]
        assert by.common(x, others).tolist() == [len(set(sets[x].tolist()) & set(sets[i].tolist())) for i in others]
    met = sum(len(by.holders[by.of_what[w] : by.of_what[w + 1]]) for w in by.what)
    assert met < 0.2 * len(sets) * sum(map(len, sets))
