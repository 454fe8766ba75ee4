import random
import re

from pyspark.sql import functions as F

from segmentry.functions.term_positions import ANY_WORD, WESTERN, Terms, lowered, replaced
from segmentry.operators import redact
from segmentry.plans import run


def by_alternation(text, terms, border, new):
    own = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not own:
        return text
    return re.sub("|".join(rf"(?<!{border}){re.escape(t)}(?!{border})" for t in own), new, text, flags=re.I)


def test_automaton_equals_alternation():
    rnd = random.Random(3)
    pieces = ["ab", "a", "B", "é", " ", "-", "x1", "_", "ß", ".", "İ"]
    for _ in range(500):
        terms = {"".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 4))).strip() for _ in range(rnd.randrange(6))}
        terms = {t for t in terms if "İ" not in t}
        text = "".join(rnd.choice(pieces) for _ in range(30))
        for border, shown in ((ANY_WORD, r"\w"), (WESTERN, "[A-Za-z0-9À-ÿ]")):
            own = Terms(terms, border)
            assert replaced(text, own.taken(text), "#") == by_alternation(text, terms, shown, "#")
    assert len(lowered("İİ")) == 2 and Terms([]).taken("x") == [] and Terms(["", "a"]).taken("A a") == [(0, 1), (2, 3)]


def test_kept_stretches_are_not_touched():
    assert Terms(["new york", "york"]).taken("in New York city", Terms(["york city"]).taken("in New York city")) == []
    assert Terms(["b"]).taken("a b b", [(2, 3)]) == [(4, 5)]


def test_large_dictionary(spark):
    terms = [f"term{i} x{i % 7}" for i in range(100_000)] + ["acme"]
    rows = spark.createDataFrame([(i, f"see Term{i * 11} X{i * 11 % 7}, ACME and acmes") for i in range(300)], "id long, text string")
    got = redact.redact(rows, redact.Layers(safe=False, dictionary=terms)).orderBy("id").collect()
    assert all(r.text_after == f"see {redact.TOKEN}, {redact.TOKEN} and acmes" and r.text_n_dictionary == 2 for r in got)


def test_addresses_with_a_term_go_whole(spark):
    rows = spark.createDataFrame([(1, "write ann@acme.com or bob@x.org, see https://acme.example/x?y and www.acme.de/z. acme"), (2, None)], "id long, text string")
    off = {r.id: (r.text_after, r.text_n_dictionary) for r in redact.redact(rows, redact.Layers(safe=False, dictionary=["Acme"], token="#")).collect()}
    assert off == {1: ("write # or bob@x.org, see # and #. #", 4), 2: ("", 0)}


def test_names_and_codes_reach_all_rows_of_their_document(spark):
    rows = spark.createDataFrame([
        ("a", 1, "then M Karl Otto Meyer came"), ("a", 2, "later karl otto meyer and KARL OTTO MEYER and with Karl Otto Meyer"), ("a", 3, None), ("b", 2, "also Karl Otto Meyer"), (None, 1, "also Karl Otto Meyer"),
        ("a", 4, "the Karl Otto Meyer Stiftung stays")], "file string, id long, text string")
    layers = redact.Layers(safe=False, names=True, token="#", surnames=("meyer",), whitelist=("Karl Otto Meyer Stiftung",))
    got = {(r.file, r.id): r.text_after for r in run.redact_documents(rows, layers).collect()}
    # without a title before it the name has too little evidence by itself
    assert got == {("a", 1): "then M # came", ("a", 2): "later karl otto meyer and # and with #", ("a", 3): "", ("b", 2): "also Karl Otto Meyer", (None, 1): "also Karl Otto Meyer", ("a", 4): "the Karl Otto Meyer Stiftung stays"}


def slow_propagate(rows, terms, lower, gone=()):
    out = []
    for doc, text in rows:
        own = {t for d, t in terms if d == doc and t not in gone}
        usual = {w for d, w in lower if d == doc}

        def swap(m):
            words = [w for w in re.findall(r"[^\W\d_]+", m[0].lower()) if len(w) > 2]
            return m[0] if m[0].islower() or (words and usual and all(w in usual for w in words)) else redact.TOKEN

        out.append((doc, None if text is None else by_alternation(text, own, "[A-Za-z0-9À-ÿ]", swap) if own else text))
    return out


def test_propagation_equals_a_loop_over_rows(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["Alpha", "BETA", "NCT12345678", "Gamma Delta", "alpha", "gamma", "AB-12", "x"]
    rows = [(rnd.choice(["d1", "d1", "d1", "d2", None]), " ".join(rnd.choice(words) for _ in range(8))) for _ in range(120)] + [("d1", None)]
    terms = [("d1", "alpha"), ("d1", "nct12345678"), ("d2", "beta"), ("d1", "gamma delta"), ("d1", "gamma"), ("d3", "x")]
    lower = [("d1", "gamma"), ("d2", "alpha")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "file string, text_after string, extra int")
    shown = lambda rs: sorted(((d or "", t or "", t is None) for d, t in rs))
    for share, gone in ((redact.ROWS_OF_SHARE, ()), (7, ("NCT12345678",))):
        monkeypatch.setattr(redact, "ROWS_OF_SHARE", share)
        got = redact.propagate(df, spark.createDataFrame(terms, "file string, term string"), spark.createDataFrame(lower, "file string, word string"), whitelist=gone)
        assert got.columns == df.columns
        assert shown((r.file, r.text_after) for r in got.collect()) == shown(slow_propagate(rows, terms, lower, {g.lower() for g in gone}))
    assert redact.propagate(df, spark.createDataFrame([], "file string, term string")).where("text_after like '%BETA%'").count() > 0
    assert redact.propagate(df.where("false"), spark.createDataFrame(terms, "file string, term string")).count() == 0


def test_query_equals_a_loop_over_documents(spark):
    from segmentry.plans.queries import rd_propagate

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), "text")
    made = [(r.file, r.text_after) for r in redact.redact(docs).collect()]
    terms = [tuple(r) for r in redact.document_terms(docs, redact.CLINICAL).collect()]
    lower = [tuple(r) for r in redact.lowercase_words(docs).collect()]
    want = {d: t for d, t in slow_propagate(made, terms, lower)}
    import hashlib

    assert {r.file: r.text_md5 for r in rd_propagate(spark, "/root/testdata/sf0.001").collect()} == {d: hashlib.md5(t.encode()).hexdigest() for d, t in want.items()}
