import base64
import hashlib
import random

import xxhash

from segmentry.llm import fingerprints as fp


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def sketch(text, k):
    return sorted(h - (1 << 64) if (h := xxhash.xxh64(s.encode(), seed=42).intdigest()) >> 63 else h for s in shingles(text))[:k]


def near(a, b, k):
    union = sorted({*a, *b})[:k]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 1.0


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_IN_RANGE", 7)
    rnd = random.Random(1)
    vocabulary = ["a", "bb", "ccc", "déjà", "x😀y", "éé", "w1", "w2", "w3", "w4"]
    rows = [(3, None), (10, ""), (11, "  \n"), (12, "one"), (13, "a b c d"), (14, "a b c d e"), (None, "null id here now or never")]
    rows += [(20 + 3 * i, rnd.choice(["", " "]) + rnd.choice([" ", "\n", "\t "]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 90)))) for i in range(60)]
    rows += [(500, "same text twice"), (500, "same text twice")]
    rnd.shuffle(rows)
    k = 16
    got = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k).collect()
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want = []
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        a, b, c = sketch(text, k), sketch(new, k), sketch(after, k)
        code = lambda s: base64.b64encode(b"".join((x % (1 << 64)).to_bytes(8, "big") for x in s)).decode()
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), code(a), code(b), round(near(a, b, k), 9), round(near(a, c, k), 9)))
    key = lambda r: (str(r[0]), r[3])
    assert sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in got], key=key) == sorted(want, key=key)


def test_estimates_and_merge(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b")).select(
        fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b")), fp.distinct_shingles(F.col("a"))).first()
    assert abs(row[0] - 0.5) < 0.15 and abs(row[1] - 0.667) < 0.2 and abs(row[2] / 2996 - 1) < 0.3
    parts = spark.createDataFrame([(1, " ".join(words[i : i + 204])) for i in range(0, 2000, 200)] + [(2, "")], "g int, t string")
    merged = {r[0]: r[1] for r in fp.sketches_by(parts.select("g", fp.sketch(F.col("t")).alias("s")), ["g"], "s").collect()}
    assert merged == {1: sketch(" ".join(words[:2004]), fp.K), 2: []}


def test_no_rows(spark):
    assert fp.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
