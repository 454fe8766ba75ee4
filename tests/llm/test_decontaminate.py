import random
import re

from pyspark.sql import functions as F

from segmentry.llm import decontaminate as dc
from segmentry.llm.queries import op12_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """doc -> (n_words, hit places, items)"""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= {x for x in own if x is not None}
        out.append((len(w), hit, sorted(map(str, found))))
    return out


def made(seed=5):
    rnd = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "déjà", "42", "x", "naïve", "日本", "É", "zeta"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(None, "one two three four five six seven eight nine ten eleven"), (7, None), (8, " -- "), (9, ""), (10, items[0][1]), (3, items[3][1])]
    docs = [(0, None), (1, ""), (2, " .,; "), (3, "x")]
    for i in range(60):
        w = [rnd.choice(vocabulary + ["filler%d" % rnd.randrange(50)] * 3) for _ in range(rnd.choice([5, 50, 700]))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w))
            w[at:at] = (rnd.choice(items)[1] or "").upper().split()
        docs.append((i % 40, ", ".join(w) + rnd.choice(["", "!", " \n"])))
    docs += [docs[10]] * 5 + [(None, "One two three four five six, seven eight nine TEN eleven twelve")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_judge_equals_brute_force(spark, monkeypatch):
    docs, items = made()
    d, b = frames(spark, docs, items)
    d = d.withColumn("key", F.lit("kept")).withColumn("Items", F.lit("replaced"))
    want = sorted((-1 if i is None else i, n, len(hit), tuple(found)) for (i, _), (n, hit, found) in zip(docs, brute(docs, items)))
    for most, stretch in ((dc.MOST_SENT, dc.STRETCH), (2000, 16)):
        monkeypatch.setattr(dc, "MOST_SENT", most)
        monkeypatch.setattr(dc, "STRETCH", stretch)
        got = dc.judge(d, b).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
        assert all(r["contaminated"] == (r["n_hit"] > 0) and r["key"] == "kept" for r in got)


def test_copies_are_dealt_out(spark, monkeypatch):
    from segmentry.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(dc, "LEAST_HOT", 3)
    docs, items = made()
    docs += [(500 + i, docs[12][1]) for i in range(200)]
    d, b = frames(spark, docs, items)
    want = sorted((-1 if i is None else i, len(hit)) for (i, _), (_, hit, _) in zip(docs, brute(docs, items)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_hit"]) for r in dc.judge(d, b).collect()) == want


def test_clean_cuts_spans_or_documents(spark):
    docs, items = made(9)
    d, b = frames(spark, docs, items)
    found = brute(docs, items)
    parts = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    want = []
    for (i, text), (_, hit, _) in zip(docs, found):
        if hit:
            pieces = parts.findall(text)
            text = "".join(p for j, p in enumerate(pieces) if j not in hit) + text[len("".join(pieces)) :]
        want.append((-1 if i is None else i, text))
    key = lambda r: (r[0], r[1] or "", r[1] is None)
    assert sorted(((-1 if r[0] is None else r[0], r[1]) for r in dc.clean(d, b).collect()), key=key) == sorted(want, key=key)
    kept = [(-1 if i is None else i, t) for (i, t), (_, hit, _) in zip(docs, found) if not hit]
    assert sorted(((-1 if r[0] is None else r[0], r[1]) for r in dc.clean(d, b, whole=True).collect()), key=key) == sorted(kept, key=key)


def test_empty_tables_and_long_text(spark):
    docs, items = made()
    d, b = frames(spark, docs, items)
    assert dc.judge(d.where("false"), b).count() == 0
    assert dc.judge(d, b.where("false")).where("n_hit > 0").count() == 0
    long = [(1, "word " * 40_000 + items[2][1] + " end" * 9_000)]
    assert dc.judge(*frames(spark, long, items)).first()["n_hit"] == len(brute(long, items)[0][1])


def test_query_has_no_python_and_equals_brute_force(spark):
    got = op12_decontamination(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = sorted((i, n, len(hit), len(found)) for (i, _), (n, hit, found) in zip(docs, brute(docs, items)))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()) == want
    assert sum(w[2] > 0 for w in want)
