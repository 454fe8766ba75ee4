import random

import numpy as np

from segmentry.llm import chroma


def brute(rows):
    reps = {}
    for i, s in rows:
        reps.setdefault(tuple(s), []).append(i)
    reps = {min(v): (k, any(i % chroma.QUERIES_OF == 0 for i in v)) for k, v in reps.items()}
    links = {r: {} for r in reps}
    for q, (a, asked) in reps.items():
        for o, (b, _) in reps.items():
            if not asked or o == q or len(a) < chroma.LEAST_OVERLAP or len(b) < chroma.LEAST_OVERLAP:
                continue
            hist = {}
            for x, i in enumerate(a):
                for y, j in enumerate(b):
                    if i == j:
                        hist[y - x] = hist.get(y - x, 0) + 1
            if not hist:
                continue
            off = max(hist, key=lambda d: (hist[d], -abs(d), d))
            pairs = [(a[x], b[x + off]) for x in range(len(a)) if 0 <= x + off < len(b)]
            error = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in pairs) / 32 / max(1, len(pairs))
            if hist[off] >= chroma.LEAST_HITS and len(pairs) >= chroma.LEAST_OVERLAP and error <= chroma.MOST_ERROR:
                links[q][o] = links[o][q] = round(error, 9)
    return {i: (min(r for r in reps if reps[r][0] == tuple(s)), len(links[min(r for r in reps if reps[r][0] == tuple(s))])) for i, s in rows}, links


def melodies():
    rnd = np.random.default_rng(3)
    tunes = [rnd.normal(0, 0.15, 64) for _ in range(8)]
    rows = [(i, t.tolist()) for i, t in enumerate(tunes)]
    rows.append((20, np.concatenate([rnd.normal(0, 0.15, 12), tunes[2][:50]]).tolist()))  # later in the recording
    rows.append((40, tunes[5][16:].tolist()))  # a part
    noisy = tunes[6].copy()
    noisy[30] += 0.2
    return rows + [(60, noisy.tolist()), (80, tunes[7].tolist()), (81, tunes[7].tolist()), (100, []), (101, None), (120, [0.0] * 3)]


def test_alignment(spark):
    df = spark.createDataFrame(melodies(), "vec_id long, embedding array<double>")
    made = chroma.with_items(df, "embedding", decode=chroma.sonified, keep=["vec_id"])
    got = {r.vec_id: r for r in chroma.align(made).collect()}
    rows = [(r.vec_id, r["items"]) for r in made.collect()]
    want, links = brute(rows)
    for i in got:
        assert got[i].class_id == want[i][0]
        if got[i].n_items >= chroma.LEAST_OVERLAP:
            assert got[i].n_links == want[i][1], i
    assert got[20].best_id == 2 and got[40].best_id == 5 and got[60].best_id == 6 and got[80].class_id == got[81].class_id == 7
    assert got[20].best_offset < 0 < got[40].best_offset
    assert got[100].class_id == got[101].class_id and got[100].n_links == 0


def crowd():
    """Melodies, and many variants of one of them that share most of their items."""
    rnd = np.random.default_rng(9)
    one = rnd.normal(0, 0.15, 64)
    rows = melodies()
    for i in range(24):
        v = one.copy()
        v[rnd.integers(0, 64, 2)] += 0.3
        rows.append((200 + 5 * i, v.tolist()))
    return rows


def linked(spark, rows):
    made = chroma.with_items(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding", decode=chroma.sonified, keep=["vec_id"])
    got = {r.vec_id: r for r in chroma.align(made).collect()}
    want, links = brute([(r.vec_id, r["items"]) for r in made.collect()])
    for i, r in got.items():
        assert r.class_id == want[i][0]
        if r.n_items >= chroma.LEAST_OVERLAP:
            assert r.n_links == want[i][1], i
            if r.n_links:
                assert min(links[r.class_id].values()) == round(r.best_error, 9)


def test_all_links_at_any_block_size(spark, monkeypatch):
    linked(spark, crowd())
    monkeypatch.setattr(chroma, "BLOCK_PLACES", 600)
    monkeypatch.setattr(chroma, "HITS_AT_ONCE", 1500)
    linked(spark, crowd())


def test_one_query_at_a_time_gives_the_same_histogram():
    rnd = np.random.default_rng(4)
    lists = [rnd.integers(0, 9, n).astype(np.int32) for n in (40, 60, 33)]
    block = chroma.Block([1, 2, 3], lists)
    other = rnd.integers(0, 9, 80).astype(np.int32)
    assert sorted(block.histogram([other])) == sorted(block.long_histogram(other))


def test_no_rows_equal_ids_and_clashing_names(spark):
    shape = "vec_id long, items array<int>, query int, digest string"
    assert chroma.align(spark.createDataFrame([], shape)).collect() == []
    tune = list(range(50))
    rows = [(0, tune, 1, "x"), (0, tune, 1, "x"), (0, [0] * 50, 1, "x"), (7, [9, *tune], 1, "x"), (None, tune[1:], 1, "x"), (None, None, None, None)]
    got = chroma.align(spark.createDataFrame(rows, shape)).collect()
    assert len(got) == 6 and {(r.vec_id, r.n_links) for r in got if r.n_items == 51} == {(7, 1)}


def test_wav():
    tune = chroma.sonified([0.1, -0.2, 0.3] * 20)
    assert np.array_equal(chroma.items(chroma.decode_wav(chroma.encode_wav(tune))), chroma.items(tune))
    assert len(chroma.decode_wav(b"junk")) == len(chroma.decode_wav(None)) == 0 and len(chroma.items(np.zeros(100))) == 0
    assert len(set(chroma.items(np.zeros(9000)).tolist())) == 1
    louder = chroma.items(tune * 2)
    assert np.array_equal(louder, chroma.items(tune))
