"""What makes a query's cost grow with its input and no faster: texts are looked at once, and no row is found anew."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from segmentry.functions.arrays import settled
from segmentry.functions.text import BLANKS, SPACE, has_words, strip
from segmentry.operators import checks, dedup, formats, redact
from segmentry.plans import queries
from segmentry.plans.oracle import ORACLE_SQL
from segmentry.schema import segments

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_the_signs_of_the_pattern(spark):
    assert {c for c in map(chr, range(0x3100)) if re.fullmatch(SPACE.replace("\\s", "\t\n\x0b\x0c\r "), c)} == set(BLANKS)
    texts = ["", " ", "\x85a\u3000", " a b\n", "\n\u2003", "x", "\u200b a"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()] == [t.strip(BLANKS) for t in texts]


def test_has_words_counts(spark):
    rows = spark.createDataFrame([(t,) for t in ("", "  ", "a", " a  b ", "a\u3000b\tc", "one")], "t string")
    assert [list(r) for r in rows.select(*[has_words(F.col("t"), n) for n in (1, 2, 3)]).collect()] == [[len(t.split()) >= n for n in (1, 2, 3)] for t in ("", "  ", "a", " a  b ", "a\u3000b\tc", "one")]


def test_settled_keeps_filters_above(spark):
    made = settled(spark.range(3), {"x": F.sha2(F.col("id").cast("string"), 256)}).where("x > 'a' and x < 'f'")
    assert optimized(made).count("sha2") == 1


def test_funnel_finds_each_text_once(spark):
    """filters on the final texts were pushed below them with all their patterns, many times over."""
    for name in ("fn_funnel", "fn_metrics", "dd_same_source"):
        assert len(re.findall("regexp_replace|RegExpReplace", optimized(queries.QUERIES[name](spark, SF)))) < 60, name


def test_groups_do_not_shuffle_texts(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, "c", "z")], "key long, source string, target string")
    found = dedup.same_source_groups(rows).select("key", "section", "n", "kept")
    assert sorted(map(tuple, found.collect())) == [(1, "identical", 2, True), (2, "identical", 2, False), (3, "conflict", 2, True), (4, "conflict", 2, False)]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def checked(spark, rules, target, source="x"):
    rows = spark.createDataFrame([("f", 1, source, target)], "file string, id long, source_text string, target_text string")
    return [tuple(r) for r in checks.check_segments(segments(rows), None, rules).select("span_source", "span_target").collect()]


def test_long_lines_of_repeats_take_no_square(spark):
    """each of a line's repeats looked for all of them again (before: not done in minutes on this line)."""
    begin = time.time()
    assert checked(spark, ["repeated_words"], "For for " * 20_000 + "is Is") == [(None, ["For for", "is Is"])]
    assert checked(spark, ["repeated_words"], "to To, TO to; a b") == [(None, ["to To"])]
    assert time.time() - begin < 60


def test_guarded_patterns_find_what_they_found(spark):
    """Dear patterns only where a match is possible."""
    assert checked(spark, ["alphanum_id_mismatch"], "nothing", "ab-cd-12.x-; 12-34 x1y2 a1 -q_-7. 3a/") == [(["ab-cd-12.x", "q_-7", "x1y2"], [])]
    assert checked(spark, ["urls"], "WWW.a.org, HTTPS://b.org.", "no") == [([], ["HTTPS://b.org", "WWW.a.org"])]
    assert checked(spark, ["camelcase_mismatch"], "y", "iPhone aB x") == [(["iPhone", "aB"], None)]
    assert checked(spark, ["mixed_scripts"], "p\u0430ypal plain \u0430\u0431") == [(None, ["p\u0430ypal"])]


def test_rd_dictionary_leaves_the_rest_of_an_address(spark, tmp_path):
    """an address that held a term went as a whole, which the SQL beside does not say."""
    text = "The mail of the.44@mail4.example.com, http://a.org/same?x=un"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["rd_dictionary"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(ORACLE_SQL["rd_dictionary"]).fetchall())


def plain_chain(patterns, texts, token):
    out = []
    for t in texts:
        n = 0
        for p, any_case in patterns:
            t, k = re.subn(p, lambda _: token, t, flags=re.I if any_case else 0)
            n += k
        out.append((t, n))
    return out


def test_guarded_chain_is_the_plain_chain():
    """a pattern is looked for only where its relaxed form is met; the results are those of the patterns themselves."""
    chosen = random.Random(7)
    patterns = [(p, g in formats.ANY_CASE) for g, own in formats.SAFE.items() for p in own.values()] + [(p, True) for p in (*formats.CLINICAL.values(), *formats.WITH_VALUE.values())]
    patterns += [(p, False) for p in (*formats.CODES.values(), *formats.HOSPITALS.values())] + [(r"\b(?!(?:FDA|WHO)\b)[A-ZÀ-Þ]{3,}\b", False)]
    words = sorted({w for p, _ in patterns for w in re.findall(r"[^\W\d_]{2,}", p)})
    signs = ["1", "22", "333", "4444", "55555", "12345678", "A", "zz", "Né", "É", "\u0660\u0661", "dn\u0131", "\u017fSN", "\u212ait", "Ÿb", "-", ".", "/", " ", "\xa0", "\n", "\x1c", ":", ",", "(", ")", "@", "+", "_", "®", "©", "市", "县", "先生", "〒"]
    texts = ["".join(chosen.choice(words if chosen.random() < 0.3 else signs) for _ in range(chosen.randint(0, 60))) for _ in range(3000)] + ["", "\u0130P 1", "x" * 5000]
    for token in ("███", "NIF1"):
        assert list(zip(*redact.Chain(patterns, token).run(texts))) == plain_chain(patterns, texts, token)
    assert all(redact.relaxed(p) is not None for p, _ in patterns)


def test_guarded_chain_leaves_most_texts_alone():
    """The patterns themselves read no text that does not meet their relaxed form (before: every text, a hundred times)."""
    patterns = [(p, g in formats.ANY_CASE) for g, own in formats.SAFE.items() for p in own.values()]
    texts = ["plain words of a long line and no more of them " * 400] * 200
    begin = time.time()
    assert redact.Chain(patterns, "X").run(texts) == (texts, [0] * 200)
    assert time.time() - begin < 8


def test_names_take_no_square():
    """Each name cut the text before and after it."""
    text = "Anna Smith and " * 40_000
    begin = time.time()
    found = redact.without_names("Dr. " + text, "X", frozenset({"anna"}), frozenset({"smith"}))
    assert len(found[1]) == 40_000 and found[0] == "Dr. " + "X and " * 40_000
    assert time.time() - begin < 10


def test_consistency_shuffles_no_texts(spark):
    """each row's texts went through the groups' shuffles and sorts."""
    plan = queries.QUERIES["xs_consistency_target"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "line#" not in plan and "sn#" not in plan


def test_changed_files_are_no_groups_of_python(spark):
    """each file was a group with two pandas frames of its own."""
    for name in ("fl_corrected", "fl_rewritten"):
        assert "CoGroup" not in queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
