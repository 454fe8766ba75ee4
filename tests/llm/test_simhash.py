import random

import xxhash

from segmentry.llm import simhash


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows):
    fps = {}
    for i, fp in rows:
        fps.setdefault(fp, []).append(i)
    left, out = set(fps), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        least = min(i for f in seen for i in fps[f])
        out.update({f: least for f in seen})
    return out


def test_fingerprints_and_components(spark):
    rnd = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "déjà", "É", "x", "y", "zeta"]
    base = [[rnd.choice(words) for _ in range(rnd.randint(20, 60))] for _ in range(20)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, "one two three")]
    for i in range(200):
        w = list(rnd.choice(base))
        if rnd.random() < 0.7:
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((len(rows), rnd.choice([" ", "\n", "  "]).join(w)))
    rows.append(rows[-1])
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [(i, brute_fp(t)) for i, t in rows]
    comp = brute_components(fps)
    assert sorted((r[0], r[1] % (1 << 64), r[2]) for r in got) == sorted((i, f, comp[f]) for i, f in fps)


def test_dense_buckets(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(3):
        centre = rnd.getrandbits(64)
        loose = rnd.sample(range(64), 14)
        for _ in range(1500):
            x = centre
            for b in loose:
                x ^= rnd.getrandbits(1) << b
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    from segmentry.llm.components import components

    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {n % (1 << 64): r % (1 << 64) for n, r in components(simhash.links(df)).collect()}
    comp = brute_components([(i, f) for i, f in enumerate(fps)])
    classes = lambda of: sorted(tuple(sorted(f for f in fps if of(f) == c)) for c in {of(f) for f in fps})
    sizes = lambda of: sorted(len(c) for c in classes(of))
    assert sizes(lambda f: comp[f]) == sizes(lambda f: got.get(f, f))
    assert classes(lambda f: comp[f]) == classes(lambda f: got.get(f, f))


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
