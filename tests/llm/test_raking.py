import random

from segmentry.llm import raking


def table(spark, n=3000):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        s = "big" if rnd.random() < 0.5 else rnd.choice(["a", "b", "c", None])
        lang = rnd.choices(["en", "de", None], [6, 2, 1])[0]
        rows.append((i, " ".join(["w"] * rnd.choice([5, 50, 150, 1200] if lang == "en" else [5, 50, 150])), lang, s, "x"))
    rows += [(n, None, "en", "a", "x"), (n + 1, "  ", "en", "a", "x"), (n + 2, "w w", None, None, "x"), (n + 2, "w w", None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")


def test_expected_sample_meets_the_marginals(spark):
    got = raking.mix(table(spark)).collect()
    assert len(got) == 3004
    total = sum(r.n_tokens for r in got)
    for column in ("source", "lang", "topic"):
        have, expect, sampled = {}, {}, {}
        for r in got:
            k = r[column]
            have[k] = have.get(k, 0) + r.n_tokens
            expect[k] = expect.get(k, 0) + r.n_tokens * r.prob
            sampled[k] = sampled.get(k, 0) + r.n_tokens * r.sampled
        have = {k: v for k, v in have.items() if v}
        goal = sum(r.n_tokens * r.prob for r in got) if column != "source" else raking.SHARE * total
        for k, want in raking._targets(have, raking.TEMPER, None, goal).items():
            assert abs(expect[k] / want - 1) < 0.02, (column, k, expect[k], want)
            assert abs(sampled[k] / want - 1) < 0.25
    assert all(0 < r.prob <= 1 for r in got) and all(r.prob == 1 and r.topic == "empty" for r in got if r.n_tokens == 0)
    twins = [r.sampled for r in got if r.doc_id == 3002]
    assert twins[0] == twins[1]


def test_given_targets(spark):
    got = raking.mix(table(spark), share=0.2, sources={"a": 0.5, "big": 0.5}).collect()
    expect = {}
    for r in got:
        expect[r.source] = expect.get(r.source, 0) + r.n_tokens * r.prob
    assert abs(expect["a"] / expect["big"] - 1) < 0.05 and expect["b"] == expect["c"] == 0


def test_no_rows(spark):
    assert raking.mix(table(spark).limit(0)).collect() == []


def slow_rake(mass, shares, wanted_langs, sweeps=300):
    """Plain raking of a table {(source, lang): mass} without the bound of one, by loops."""
    weight = dict.fromkeys(mass, 1.0)
    for _ in range(sweeps):
        for i, want in ((0, shares), (1, wanted_langs)):
            for k, t in want.items():
                own = [c for c in mass if c[i] == k]
                m = sum(mass[c] * weight[c] for c in own)
                for c in own:
                    weight[c] *= t / m if m else 1.0
    return weight


def test_probabilities_equal_a_loop_over_cells(spark):
    from segmentry.llm import raking

    words = {("s1", "en"): 900, ("s1", "de"): 300, ("s2", "en"): 400, ("s2", "de"): 800}
    rows = [(i, "w " * 20, lang, source) for source, lang in words for i in range(words[source, lang] // 20)]
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {(r["source"], r["lang"]): r["prob"] for r in raking.mix(docs, share=0.3, sources={"s1": 0.4, "s2": 0.6}, langs={"en": 0.5, "de": 0.5}).collect()}
    total = 0.3 * sum(words.values())
    want = slow_rake(words, {"s1": 0.4 * total, "s2": 0.6 * total}, {"en": total / 2, "de": total / 2})
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 0.02 * want[c] for c in got)


def test_columns_that_clash_with_working_names(spark):
    from pyspark.sql import functions as F

    from segmentry.llm import raking

    docs = spark.createDataFrame([(i, "some words here", "en", f"s{i % 2}") for i in range(20)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({"_s": F.lit("own"), "_l": F.lit(1), "a": F.lit("x")})
    rows = raking.mix(docs).collect()
    assert len(rows) == 20 and all((r["_s"], r["_l"], r["a"]) == ("own", 1, "x") for r in rows)


def test_uneven_joins_with_clashing_names(spark):
    from pyspark.sql import functions as F

    from segmentry.llm.common import join_uneven

    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, _share int").withColumn("_hot", F.lit("own"))
    table = spark.createDataFrame([(k, f"t{k}") for k in range(3)], "k int, t string")
    got = join_uneven(rows, table, "k", rows.groupBy("k").agg(F.count("*").alias("n")), total=30).collect()
    assert sorted((r["_share"], r["t"], r["_hot"]) for r in got) == [(i, f"t{i % 3}", "own") for i in range(30)]
