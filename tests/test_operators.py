import difflib
import random

import pytest
from pyspark.sql import functions as F

from segmentry.operators import cross, dedup, redact, reports, similarity, terms
from segmentry.operators.checks import Config, check_segments
from segmentry.plans.run import notices, redact_documents, run_checks
from segmentry.schema import segments

PAIR = "file string, id long, source_text string, target_text string"


def table(spark, rows):
    return segments(spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows, 1)], PAIR))


def test_terms(spark):
    df = table(spark, [("the dose of NASA", "la dosis"), ("a nasa day", "dosis C++ mala"), ("dose", "dosage")])
    forbidden = spark.createDataFrame([(1, "Dosis"), (2, "dosis"), (3, "C++"), (4, "los")], "no int, term string")
    assert sorted((r.id, r.span_target[0]) for r in terms.forbidden_terms(df, forbidden).collect()) == [(1, "Dosis"), (2, "C++"), (2, "Dosis")]
    glossary = spark.createDataFrame([("dose", "dosis", "n"), ("Dose", "toma", None), ("NASA", "NASA", None)], "source string, target string, note string")
    assert sorted((r.id, r.span_source[0]) for r in terms.glossary_violation(df, glossary).collect()) == [(1, "NASA"), (3, "Dose")]
    stems = spark.createDataFrame([("dosage", "dosis")], "form string, stem string")
    assert [r.id for r in terms.glossary_violation(df, glossary, stems=stems).collect()] == [1]
    groups = spark.createDataFrame([(["mala", "bala"],), (["x"],)], "members array<string>")
    assert [r.id for r in terms.confusable_pairs(df, groups).collect()] == [2]
    lexicon = spark.createDataFrame([("la",), ("dosis",)], "form string")
    ignore = spark.createDataFrame([("Mala",)], "term string")
    assert [(r.id, r.span_target) for r in terms.spellcheck(df, lexicon, ignore).collect()] == [(3, ["dosage"])]


def test_consistency_and_hyphens(spark):
    df = table(spark, [("one source text", "a"), ("one  source text", "b"), ("one source text", ""), ("two", "same target"), ("three", "same target"), ("x", "well-being now"), ("x", "wellbeing too"), ("x", "wellbeing well-being")])
    assert sorted((r.id, r.reference_id, r.group_size) for r in cross.exact_consistency(df).collect()) == [(2, 1, 2), (3, 1, 2)]
    assert [(r.id, r.reference_id) for r in cross.exact_consistency(df, "source").collect()] == [(5, 4)]
    assert [(r.reference_id, r.id, r.hyphenated, r.plain) for r in cross.hyphenation(df).collect()] == [(6, 7, "well-being", "wellbeing")]


def test_majorities(spark):
    df = table(spark, [("", "on 01/02/2025 for 1.5"), ("", "on 01/03/2025 for 2.25"), ("", "on 01.02.2025 for 3,5 and 1.000")])
    assert [(r.id, r.span_target) for r in cross.convention_majority(df, "date").collect()] == [(3, ["01.02.2025"])]
    assert [(r.id, r.span_target) for r in cross.convention_majority(df, "number").collect()] == [(3, ["3,5"])]
    assert cross.convention_majority(df.where("id <> 2 and id <> 1"), "date").collect() == []
    assert cross.convention_majority(df.where("id <> 2"), "date").collect() == []


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_similar_pairs_are_all_pairs(spark, threshold):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 90))).strip() or "x" for _ in range(25)]
    texts = list(dict.fromkeys(base + ["".join(c if rnd.random() > 0.06 else rnd.choice("xyz") for c in rnd.choice(base)) for _ in range(35)]))
    got = {(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), threshold).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if difflib.SequenceMatcher(None, texts[i], texts[j], autojunk=False).ratio() >= threshold}
    assert got == want


def test_leaders_are_greedy(spark):
    rnd = random.Random(2)
    edges = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)})
    used, want = set(), set()
    for i in range(40):
        near = [b for a, b in edges if a == i and b not in used]
        if i not in used and near:
            used |= {i, *near}
            want |= {(n, i) for n in (i, *near)}
    got = {(r.member, r.leader) for r in similarity.leaders(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {g for g in got if g[0] != g[1]} == {w for w in want if w[0] != w[1]}


def test_fuzzy_kinds(spark):
    df = table(spark, [("the quick brown fox jumps", "uno dos tres cuatro cinco"), ("the quick brown fox jumped", "uno dos tres cuatro cincos"), ("something else altogether", "uno dos tres cuatro cinca"), ("the quick brown fox jumpt", "nada que ver con esto aqui")])
    assert sorted((r.a, r.b, r.kind) for r in similarity.fuzzy_consistency(df, 0.9).collect()) == [(1, 2, "fuzzy-both"), (1, 3, "fuzzy-source"), (1, 4, "fuzzy-target"), (2, 3, "fuzzy-source"), (2, 4, "fuzzy-target")]


def test_redaction(spark):
    rows = [(1, "Mail ann@x.org or see https://a.org/b now"), (2, "NCT01234567 and DNI 12345678Z, call +34 600 123 456"), (3, "Dr. Ann Smith at 12 Main Street"), (4, "nothing here"), (5, None), (6, "IP 10.0.0.1, 10.0.0.2 (10.0.0.3)"), (7, "keep info@keep.org")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in redact.redact(df, redact.Layers(whitelist=["info@keep.org"], dictionary=["main"])).collect()}
    t = dedup.TOKEN
    assert got[1].text_after == f"Mail {t} or see {t} now" and got[1].text_n_safe == 2
    assert "NCT" not in got[2].text_after and "12345678Z" not in got[2].text_after and "600" not in got[2].text_after
    assert "Smith" not in got[3].text_after and got[3].text_n_dictionary == 1
    assert got[4].text_after == "nothing here" and got[5].text_after == "" and got[6].text_after == f"IP {t}" and got[7].text_after == "keep info@keep.org"
    again = redact.redact(df.select("id", F.lit(got[1].text_after).alias("text")).limit(1)).first()
    assert again.text_n_safe == 0
    with pytest.raises(ValueError):
        redact.Layers(token=" ")


def test_names_and_propagation(spark):
    first, last = frozenset({"anna"}), frozenset({"meyer"})
    assert redact.without_names("met Anna Meyer today", "#", first, last) == ("met # today", ["Anna Meyer"])
    assert redact.without_names("has Anna Meyer syndrome", "#", first, last)[1] == []
    assert redact.without_names("The Green House", "#", first, last)[1] == []
    rows = spark.createDataFrame([("d", "Subject 12345 took XK-900234 here"), ("d", "again subject 12345"), ("e", "subject 12345")], "file string, text string")
    got = {(r.file, r.text): r.text_after for r in redact_documents(rows, redact.Layers(safe=False, clinical=True)).collect()}
    assert "12345" not in got["d", "Subject 12345 took XK-900234 here"]
    left = redact.audit(spark.createDataFrame([("d", "a@b.org c@d.org")], "file string, text_after string")).collect()
    assert [(r.kind, r.n, r.example) for r in left] == [("email", 2, "a***@b***.org")]


def test_dedup_and_funnel(spark):
    schema = "file string, key long, source_before string, target_before string, source_after string, target_after string, changed boolean"
    t = dedup.TOKEN
    full = "one two three four five six"
    rows = [("f", 1, full, full + " a", full, full + " a", False), ("f", 2, full, full + " a", full, full + " a", False), ("f", 3, "12 34", full, "12 34", full, False), ("f", 4, "one two", "uno dos", "one two", "uno dos", False),
            ("f", 5, "a b c d e f secret words here", "x", f"{t}", "x", True), ("f", 6, "mail me at the a@b.org now please", "escribe a a@b.org ahora por favor ya", f"{t}, {t}", f"escribe {t} ahora por favor ya mismo hoy", True), ("g", 7, full + " seven", full, full + " seven", full, False)]
    df = spark.createDataFrame(rows, schema)
    sections = dedup.same_source_groups(dedup.final_texts(df).where("key in (1, 2, 7)")).collect()
    assert sorted((r.key, r.section, r.kept) for r in sections) == [(1, "identical", True), (2, "identical", False)]
    reasons = {r.key: r.reason for r in dedup.funnel(df, spark.createDataFrame([(2,)], "key long")).collect()}
    assert reasons == {1: None, 2: "dedup", 3: "junk", 4: "short", 5: "junk", 6: "heavy", 7: None}
    total = [r for r in dedup.metrics(dedup.funnel(df)).collect() if r.file is None][0]
    assert (total.raw, total.kept, total.junk) == (7, 3, 2)
    assert dedup.consolidated(F.lit("x"), t) is not None
    ids = df.select(dedup.document_id(F.lit("doc-0123456789abcdef")), dedup.document_id(F.lit("x"))).first()
    assert ids[0] == "doc-0123456789abcdef" and len(ids[1]) == 20


def test_reports(spark):
    df = table(spark, [("Hello there.", "hola  hola"), ("=1+1", "=1+1 x"), ("Good.", "bien.")])
    found = check_segments(df, Config(), ["double_spaces", "final_punctuation_mismatch", "first_letter_case"])
    assert {r.category_id: r.n for r in reports.by_category(found).collect()} == {"double_spaces": 1, "final_punctuation_mismatch": 1, "first_letter_case": 2}
    assert len(reports.page(found, 0, 2).collect()) == 2 and len(reports.page(found, 1, 3).collect()) == 1
    edits = spark.createDataFrame([("f", 1, "Hola.")], "file string, id long, edited_target string")
    flat = reports.flattened(found, df, edits)
    assert {r.target_text for r in flat.where("id = 1").collect()} == {"Hola."}
    assert reports.with_edits(df, edits).where("id = 1").first().target_text == "Hola."
    shown = reports.csv_lines(reports.flattened(check_segments(df, Config(), ["length_ratio", "empty_target"]).union(found), df)).collect()
    assert not any(c.startswith("=") for r in shown for c in r if c)
    marked = [r.row for r in reports.html_rows(reports.flattened(found, df)).collect()]
    assert any("<mark>  </mark>" in r for r in marked)
    assert [r.id for r in df.where(reports.segment_filter("1,3-9")).orderBy("id").collect()] == [1, 3]
    assert [r.ids for r in reports.context(df, 1).orderBy("id").collect()] == [[1, 2], [1, 2, 3], [2, 3]]


def test_whole_run(spark):
    df = table(spark, [("The same source text", "uno"), ("The same source text", "dos  x"), ("03/04/2025", "x")])
    cfg = Config(source_lang="xx", target_lang="es", checks=Config().checks | {"polarity_mismatch"})
    got = {(r.category_id, r.id) for r in run_checks(df, cfg).collect()}
    assert {("inconsistent_translation", 2), ("double_spaces", 2)} <= got
    assert len(notices(df, cfg)) == 2 and notices(df.where("id < 3"), Config(source_lang="en", target_lang="es")) == []
    assert {c for c, _ in ((r.category_id, r.id) for r in run_checks(df, cfg, monolingual=True).collect())} <= {"double_spaces", "repeated_words"}


def test_variants_are_registered_at_the_reference_threshold(monkeypatch):
    from segmentry.plans import queries

    asked = {}

    def recorded(rows, threshold=dedup.source_variants.__defaults__[0]):
        asked["threshold"] = threshold

    monkeypatch.setattr(queries, "_kept_rows", lambda spark, sf: None)
    monkeypatch.setattr(queries.dedup, "source_variants", recorded)
    queries.QUERIES["dd_variants"](None, "")
    assert asked == {"threshold": 0.85}


def test_similar_pairs_against_all_pairs(spark, monkeypatch):
    import difflib
    import random

    from segmentry.operators import similarity

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rnd.choice([1, 2, 4, 9, 30]))) for _ in range(60)] + ["a", "b", "ab", "😀b"]
    for _ in range(90):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(["", "x", "ab"])
        texts.append("".join(t) or "z")
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for threshold, block in ((0.85, 200), (0.6, 1 << 16), (0.95, 150)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        want = {}
        for b in range(len(texts)):
            for a in range(b):
                r = difflib.SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio()
                if r >= threshold:
                    want[a, b] = round(r, 9)
        got = similarity.similar_pairs(df, threshold).collect()
        assert {(r.a, r.b): round(r.ratio, 9) for r in got} == want and len(got) == len(want)
    assert similarity.similar_pairs(df.limit(0), 0.85).collect() == []


def test_numbers_dates_and_structures_by_their_rules():
    from segmentry.operators import numbers as N

    same = lambda a, la, b, lb: N.number_value(a, la) == N.number_value(b, lb)
    assert same("1,000", "en", "1.000", "es") and same("1,5", "es", "1.5", "en") and not same("1,000", "es", "1,000", "en")
    assert same("1.234,50", "de", "1,234.5", "en") and same("2e3", "en", "2000", "de") and same("10²", "en", "100", "en") and same("10^-1", "en", "0.1", "en")
    assert same("−5", "en", "-5", "en") and not same("+5", "en", "5", "en") and not same("1.5", "en", "1.50001", "en")
    assert N.number_value("9^9999", "en") == N.number_value("9^9999", "de") != N.number_value("9^9998", "en")
    date_of = lambda t, lang: N.date_value(N.DATE_RE.search(t), lang)
    assert str(date_of("2024-02-29", "en")) == "2024-02-29" and date_of("31/02/2024", "es") == "invalid" and date_of("03/04/2025", "en") is None
    assert str(date_of("03/04/2025", "en-US")) == "2025-03-04" and str(date_of("03/04/25", "fr")) == "2025-04-03" and str(date_of("12/25/2020", "de")) == "2020-12-25" and date_of("15/20/2020", "") == "invalid"
    assert N.structures("3-5 and 1:30, at 12:30; 2 out of 10, 4 to 6; 1.5-2; v1-2; 03/04/2025") == ["3-5", "4-6", "1:30", "2:10"]
    assert N.structures("1 to 2 to 3") == ["1-2"] and N.structures("12345-6") == []
