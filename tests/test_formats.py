import random
import re

import pytest
from pyspark.sql import functions as F

from segmentry.operators import formats, numbers, redact

#: One text for each format that it must meet, and one that is near it and must stay.
SAMPLES = {
    ("identifiers", "nct"): ("see nct01234567 now", "NCT0123456"), ("identifiers", "ssn_us_alone"): ("123-45-6789", "123-45-678"), ("identifiers", "iban"): ("ES91 2100 0418 4502 0005 1332", "ES91 2100"),
    ("identifiers", "domain"): ("at example.org/x?y z", "end.Next"), ("identifiers", "trademark"): ("use Acme Pro® here", "Acme Pro"), ("identifiers", "parts"): ("AB-CD-EFG", "A-B-C"), ("phone", "plus"): ("+34 612 345 678", "+34"),
    ("address", "street_en"): ("12 Main Street", "12 main street"), ("address", "street_fr"): ("rue de la Paix", "rue de la"), ("address", "street_es"): ("calle Mayor, 5", "calle 5"), ("postal", "uk"): ("sw1a 1aa", "SW 1"),
    ("postal", "with_country"): ("28001 Madrid, Spain", "28001 madrid in"), ("titled", "academic"): ("Dr. Ana López", "dr. ana"), ("titled", "degree"): ("Ana López, PhD", "Ana López, DX"), ("titled", "role"): ("Medical Monitor: Ana", "Medical Monitor"),
    ("birth", "born"): ("nacida el 3/4/1990", "nacida el lunes"), ("birth", "japanese"): ("1990年4月3日生まれ", "1990年4月"), ("cjk", "chinese_titled"): ("王医生", "王"), ("cjk", "japanese_address"): ("東京都千代田区1-2", "東京都"),
}


def test_formats_as_spark_matches_them(spark):
    rows = [(g, n, good, bad) for (g, n), (good, bad) in SAMPLES.items()]
    df = spark.createDataFrame(rows, "g string, n string, good string, bad string")
    for g, n, good, bad in rows:
        p = redact.java(formats.SAFE[g][n], g in formats.ANY_CASE)
        got = df.where((F.col("g") == g) & (F.col("n") == n)).select(F.rlike("good", F.lit(p)), F.rlike("bad", F.lit(p))).first()
        assert tuple(got) == (True, False), (g, n, tuple(got))


def test_spark_and_python_replace_alike(spark):
    texts = [" ".join(x for pair in SAMPLES.values() for x in pair), "tel: 612 345 678 y 2024-01-02", "", "nada", "Protocol ID AB-123 MRN: A12 Lot B77"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for group, own in formats.SAFE.items():
        for name, pattern in own.items():
            p = redact.java(pattern, group in formats.ANY_CASE)
            text, n = redact.applied(F.col("text"), [p], "#")
            made = df.select("id", text.alias("text"), n.alias("n")).orderBy("id").collect()
            for r, t in zip(made, texts):
                assert (r.text, r.n) == re.subn(pattern, "#", t, flags=re.I if group in formats.ANY_CASE else 0), (group, name)


def test_long_chains_count_stage_by_stage(spark):
    df = spark.createDataFrame([("see https://x.org/ann@b.org or $1 a@b.org", 1), ("", 2)], "text string, id int").withColumn("n", F.lit(3))
    own = formats.SAFE["identifiers"]
    rows = redact.matched(df, "text", "n", [(own["email"], True), (own["url"], True)], "$#\\1").orderBy("id").collect()
    assert [(r.text, r.n) for r in rows] == [("see $#\\1 or $1 $#\\1", 6), ("", 3)]


@pytest.mark.parametrize("text, want", [
    ("call 555-123-4567 or (555) 123.4567", ["555-123-4567", "(555) 123.4567"]), ("+1 (555) 123-4567", ["+1 (555) 123-4567"]), ("1-555-123-4567", ["1-555-123-4567"]), ("15551234567", []), ("555123-4567", ["555123-4567"]),
    ("555 123 4567", []), ("9555-123-4567", []), ("555-123-45678", []), ("x1+1(555)123-4567", ["1(555)123-4567"]), ("2024-01-2345", [])])
def test_phones(text, want):
    assert [text[a:b] for a, b, _ in numbers.phone_places(text)] == want


def test_phones_in_blanks_only_if_known():
    assert numbers.phone_places("555 123 4567") == [] and numbers.phone_places("(555) 123 4567", {"5551234567"}) == [(0, 14, "5551234567")]
    assert [t[1] for t in numbers.number_tokens("1 555 123 4567, 3", "en", {"15551234567"})] == ["phone:15551234567", "3"]
    rnd = random.Random(2)
    for _ in range(2000):
        t = "".join(rnd.choice(["555", "1", "+1", "(555)", "4567", "123", " ", "-", ".", "x"]) for _ in range(rnd.randrange(9)))
        places = numbers.phone_places(t)
        assert all(a < b and (not a or not t[a - 1].isdigit()) and t[b : b + 1] not in set("0123456789") and len(d) in (10, 11) for a, b, d in places)
        assert all(x[1] <= y[0] for x, y in zip(places, places[1:]))
