import random

from segmentry.llm import url_rules as U

URLS = [None, "", "no scheme", "http://A.Example.COM/en/1?x#y", "http://www.example.com/en/2", "http://blog.www.example.com/en/", "http://example.com/fr/", "http://x.com",
        "http://com/", "http://a.net/es/1", "http://net/fr/", "http://a.net/frx", "http://a.net/en/#/es/", "ftp://h.org?://z.com/", "http://notexample.com/en/1", "http://É.com/"]


def brute(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([i for i, c in enumerate(rest) if c in "?#"] or [len(rest)])]
    fit = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, None)


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = sorted(U.judge(df, []).collect())
    for r, u in zip(got, URLS):
        host, path, rule, verdict = brute(u)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), u
    assert U.judge(df.limit(0), []).collect() == []


def test_mined_rules_and_index(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(2000):
        sub, kind, n = rnd.choice(["www", "blog", "m"]), rnd.choice(["news", "casino", "shop"]), rnd.randrange(1000)
        label = "block" if kind == "casino" and sub != "www" else "allow"
        rows.append((f"https://{sub}.site{rnd.randrange(5)}.org/{kind}/{n}.html?id={n}", label if rnd.random() < 0.97 else None))
    rules = U.mine(spark.createDataFrame(rows, "url string, label string"))
    index = U.Index(rules)
    blocks = [r for r in rules if r.label == "block"]
    assert blocks and all(any("casino" in t for t in r.tokens) for r in blocks)
    for url, _ in rows[:300]:
        own = U.tokens(url)
        brute_best = min([r for r in rules if r.tokens <= own], key=lambda r: (-r.confidence, -r.support, r.text), default=None)
        assert index.match(url) == brute_best
        assert (brute_best.label == "block") == ("casino" in url and "www" not in url)
    for a in rules:
        assert not any(b is not a and b.tokens < a.tokens and b.label == a.label and b.confidence > a.confidence for b in rules)
    assert U.mine(spark.createDataFrame([], "url string, label string")) == []


def test_merged_tokens_each_stand_for_the_rule(spark):
    rows = [(f"http://blog.cheap.example.com/{i}", "block") for i in range(60)] + [(f"http://www.good{i % 3}.org/{i}", "allow") for i in range(60)]
    index = U.Index(U.mine(spark.createDataFrame(rows, "url string, label string")))
    for url in ("http://blog.cheap.example.com/x", "http://m.cheap.example.com/x", "http://cheap.example.com/x"):
        assert index.match(url).label == "block", url


def test_many_rules_are_all_kept(spark):
    rows = [(f"http://s{k}.h{k}.org/p{k}", "block" if k % 2 else "allow") for k in range(12) for _ in range(20 + 20 * k)]
    index = U.Index(U.mine(spark.createDataFrame(rows, "url string, label string")))
    assert all(index.match(u).label == label for u, label in rows)


def test_columns_that_clash_with_working_names(spark):
    from pyspark.sql import functions as F

    names = ("_host", "_path", "_rule", "_verdict", "_mined", "_HOST_")
    df = spark.createDataFrame([("http://a.com/x",), (None,)], "url string").withColumns({n: F.lit("kept") for n in names})
    rows = U.judge(df, []).collect()
    assert all(r[n] == "kept" for r in rows for n in names) and {r["host"] for r in rows} == {"a.com", ""}
