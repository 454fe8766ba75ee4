import pytest

from segmentry.operators import checks
from segmentry.operators.checks import Config, check_segments
from segmentry.schema import segments

LONG = "This is a sentence of some length."
CASES = [
    ("empty_target", "a", " ", 1), ("empty_target", " ", "", 0), ("untranslated_segment", "abcdefgh", " abcdefgh ", 1), ("untranslated_segment", "abcdefg", "abcdefg", 0), ("untranslated_segment", "12345678", "12345678", 0),
    ("control_characters", "a", "a​b­", 1), ("control_characters", "a", "a b", 0), ("mixed_scripts", "", "pаyment αб ok", 2), ("mixed_scripts", "", "Latin αβγ", 0),
    ("length_ratio", "x" * 20, "y" * 5, 1), ("length_ratio", "x" * 20, "y" * 6, 0), ("length_ratio", "x" * 20, "y" * 60, 0), ("length_ratio", "x" * 20, "y" * 61, 1), ("length_ratio", "x" * 19, "y", 0),
    ("repeated_words", "", "the The cat cat", 1), ("repeated_words", "", "a a", 0), ("bracket_balance", "(a", "([)]", 2), ("bracket_balance", "(a)", "don’t «x»", 0), ("bracket_balance", "", 'a "b', 1),
    ("urls", "see http://a.com/x.", "see http://a.com/x", 0), ("urls", "www.a.com", "", 1), ("emails", "a@b.com", "a@b.org", 1), ("emails", "a@b.com c@d.com", "c@d.com a@b.com", 0),
    ("placeholders", "%s {x} {{y}} ${z} <br/>", "<br/> %s {x} {{y}} ${z}", 0), ("placeholders", "%1$s", "", 1), ("symbol_mismatch", "<3", ">3", 1), ("symbol_mismatch", "5%", "5", 0),
    ("alphanum_id_mismatch", "P20-05987", "P20‑05987", 0), ("alphanum_id_mismatch", "AB-12", "ab-12", 1), ("alphanum_id_mismatch", "12-34", "", 0), ("polarity_mismatch", "I don’t", "lo hago", 1), ("polarity_mismatch", "not", "nunca", 0),
    ("repeated_punctuation", "", "a.. b... c!! d,,", 1), ("repeated_punctuation", "", "a...", 0), ("final_punctuation_mismatch", "a.", "b。", 0), ("final_punctuation_mismatch", "a?", "b", 1), ("final_punctuation_mismatch", "a:", "b", 0),
    ("first_letter_case", "Ab", "ab", 1), ("first_letter_case", "(Ab", "(ab", 0), ("alluppercase_mismatch", "WARNING now", "warning now", 1), ("alluppercase_mismatch", "FDA now", "fda now", 0), ("alluppercase_mismatch", "Intro", "INTRODUCCIÓN", 1),
    ("camelcase_mismatch", "use memoQ", "usa memoq", 1), ("camelcase_mismatch", "use memoQ", "usa memoQ", 0), ("double_spaces", "", "a  b", 1), ("whitespace_edges", "", " a", 1), ("whitespace_edges", "", "\ta", 0),
    ("tag_malformed", "a <ph id='1'/> b", "", 1), ("tag_malformed", "a < b", "c > d", 0),
    ("number_mismatch", "5.5 and 1,000", "5,5 y 1.000", 0), ("number_mismatch", "1,000", "1,000", 1), ("number_mismatch", "10² m", "100 m", 0), ("number_mismatch", "1 1 2", "1 2 2", 1), ("number_mismatch", "call (555) 123-4567", "llame 555.123.4567", 0),
    ("range_ratio_mismatch", "1-3", "1 y 3", 1), ("range_ratio_mismatch", "1 to 3", "1-3", 0), ("range_ratio_mismatch", "1:3", "1 de cada 3", 0), ("range_ratio_mismatch", "12:30", "las doce", 0), ("range_ratio_mismatch", "1:30", "x", 1),
    ("unit_mismatch", "5 mg", "5 g", 1), ("unit_mismatch", "5 µg", "5 μg", 0), ("unit_mismatch", "5 mg and 10 mL", "10 mg y 5 mL", 1), ("number_format_mismatch", "", "5.5 y 1.000", 1), ("number_format_mismatch", "", "5,5", 0),
    ("date_format_mismatch", "2025-03-15", "15/03/2025", 0), ("date_format_mismatch", "2025-03-15", "15/04/2025", 1), ("date_format_mismatch", "31/02/2025", "31/02/2025", 1), ("date_format_mismatch", "03/04/2025", "04/03/2025", 0),
]


@pytest.fixture(scope="module")
def fired(spark):
    rows = [("f", i, s, t) for i, (_, s, t, _) in enumerate(CASES)] + [("f", 10_000, None, None)]
    df = segments(spark.createDataFrame(rows, "file string, id long, source_text string, target_text string"))
    names = {c for c, *_ in CASES}
    found = check_segments(df, Config(source_lang="en", target_lang="es"), names).collect()
    out = {}
    for r in found:
        out.setdefault((r.category_id, r.id), []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_truth_table(fired, i):
    category, source, target, n = CASES[i]
    assert len(fired.get((category, i), [])) == n, (category, source, target, fired.get((category, i)))


def test_spans_and_nulls(fired):
    find = lambda c, s: fired[c, next(i for i, x in enumerate(CASES) if x[0] == c and x[1] == s)][0]
    assert find("number_mismatch", "1 1 2").span_source == ["1"] and find("number_mismatch", "1 1 2").span_target == ["2"]
    assert find("unit_mismatch", "5 mg").note == "mg → g = ×1000" and find("symbol_mismatch", "<3").span_target == [">"]
    assert not any(i == 10_000 for _, i in fired)


def test_tags(spark):
    tag = lambda n, i, f=False: (n, i, f)
    rows = [("f", 1, "a", "b", [tag("ph", "1"), tag("mrk", "2")], [tag("ph", "1")]), ("f", 2, "a", "b", [tag("ph", "1")], [tag("ph", "2")]),
            ("f", 3, "a", "b", [tag("bpt", "1"), tag("ept", "1")], [tag("ept", "1"), tag("bpt", "1")]), ("f", 4, "a", "b", [tag("bpt", "1", True)], [])]
    t = "array<struct<name:string,id:string,is_fmt:boolean>>"
    df = segments(spark.createDataFrame(rows, f"file string, id long, source_text string, target_text string, source_tags {t}, target_tags {t}"))
    found = {(r.category_id, r.id) for r in check_segments(df, Config(), ["tag_count", "tag_order"]).collect()}
    assert found == {("tag_count", 2), ("tag_order", 3)}


def test_custom_patterns(spark):
    df = segments(spark.createDataFrame([("f", 1, "aaaa" * 10 + "!", "bad word"), ("f", 2, "x 12", "y")], "file string, id long, source_text string, target_text string"))
    cfg = Config(custom_forbidden=[(None, "bad"), ("x", "y")], custom_required=[(r"\d+", r"\d+"), ("(a+)+$", "q")], regex_timeout=0.05)
    found = sorted((r.id, r.category_id, r.note) for r in check_segments(df, cfg, ["custom_forbidden_regex", "custom_required_regex"]).collect())
    assert (1, "custom_forbidden_regex", None) in found and (2, "custom_forbidden_regex", None) in found and (2, "custom_required_regex", None) in found


def test_dimension():
    from segmentry.schema import CATEGORIES, DEFAULT_CHECKS, MONOLINGUAL_CHECKS

    assert len(CATEGORIES) == 35 and len(DEFAULT_CHECKS) == 31 and len(MONOLINGUAL_CHECKS) == 11
    assert set(checks.RULES) < {c[0] for c in CATEGORIES}
