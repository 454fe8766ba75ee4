import difflib
import io
import random
import zipfile

import pytest

from segmentry.functions import matching
from segmentry.operators import pairing
from segmentry.plans import file_queries
from segmentry.sources import bilingual, spliced
from segmentry.sources.binary_sink import write_files

TMX = """<?xml version="1.0"?>
<tmx version="1.4"><!-- kept --><header srclang="en"/><body>
<tu tuid="7" changeid='Bob'><tuv xml:lang="en"><seg>A  &amp; <![CDATA[b]]></seg></tuv><tuv xml:lang = "es" ><seg >Uno</seg></tuv></tu>
<tu><tuv xml:lang="en"><seg>Two</seg></tuv></tu>
<tu><tuv xml:lang="en"><seg>Three</seg></tuv><tuv xml:lang="es"><seg/></tuv></tu>
<tu><tuv xml:lang="en"><seg>Four</seg></tuv><tuv xml:lang="es"><seg>Cu<ph id="1">&lt;b&gt;</ph>atro</seg></tuv></tu>
</body></tmx>"""
XLIFF = """<x:xliff version="1.2" xmlns:x="urn:oasis:names:tc:xliff:document:1.2"><x:file source-language="en" target-language="es"><x:body>
<x:trans-unit id="a"><x:source>One <x:g id="1">two</x:g></x:source></x:trans-unit>
<x:trans-unit id="b"><x:source>Three</x:source><x:target state="new"  /><x:alt-trans><x:target>Other</x:target></x:alt-trans></x:trans-unit></x:body></x:file></x:xliff>"""
DOCX = """<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>First ann</w:t></w:r><w:r><w:t>@x.org end</w:t><w:tab/><w:t>cell</w:t></w:r></w:p><w:p><w:r><w:t>Out</w:t><w:txbx><w:p><w:r><w:t>Box</w:t></w:r></w:p></w:txbx></w:r></w:p></w:body></w:document>"""


def test_matching_equals_the_standard_matcher():
    rnd = random.Random(2)
    for _ in range(600):
        k = rnd.choice([2, 3, 8])
        a = "".join(rnd.choice("abcdefgh"[:k]) for _ in range(rnd.randrange(rnd.choice([6, 40, 300]))))
        b = list(a) if rnd.random() < 0.5 else [rnd.choice("abcdefgh"[:k]) for _ in range(rnd.randrange(rnd.choice([6, 40, 300])))]
        for _ in range(rnd.randrange(6)):
            b[rnd.randrange(len(b) + 1) : rnd.randrange(len(b) + 1)] = rnd.choice("abcxyz")
        b = "".join(b)
        for popular in (True, False):
            other = difflib.SequenceMatcher(None, a, b, autojunk=popular)
            assert matching.edits(a, b, popular) == [(tag == "equal", *rest) for tag, *rest in other.get_opcodes()]
            assert matching.similarity(a, b, popular) == pytest.approx(other.ratio(), abs=1e-12)


def test_marked_words():
    assert matching.marked_words("a <b> c d", "a c e") == ("a <mark>&lt;b&gt;</mark> c <mark>d</mark>", "a c <mark>e</mark>")
    assert matching.marked_words(None, "x y") == ("", "<mark>x y</mark>") and matching.marked_words("", None) == ("", "")
    many = " ".join(f"w{i % 3}" for i in range(300))
    assert matching.marked_words(many, many + " end")[1].endswith("<mark>end</mark>")


def test_corrected_targets_and_nothing_else():
    got = spliced.correct_bytes(TMX.encode(), "tmx", {1: 'Un "o" & <é>\r', 2: "Dos", 3: ""}).decode()
    assert got == TMX.replace("<seg >Uno</seg>", '<seg >Un "o" &amp; &lt;é&gt;&#13;</seg>').replace("Two</seg></tuv></tu>", 'Two</seg></tuv><tuv xml:lang="es"><seg>Dos</seg></tuv></tu>').replace("<seg/>", "<seg></seg>")
    read = [r["target"][0] for r in bilingual.rows_of("x.tmx", got.encode())]
    assert read == ['Un "o" & <é>\r', "Dos", "", "Cuatro"]
    made = spliced.correct_bytes(XLIFF.encode(), "xliff", {1: "Uno", 2: "Tres"}).decode()
    assert made == XLIFF.replace("</x:source></x:trans-unit>", "</x:source><x:target>Uno</x:target></x:trans-unit>").replace('<x:target state="new"  />', '<x:target state="new">Tres</x:target>')


@pytest.mark.parametrize("number, text, why", [(4, "x", "codes"), (9, "x", "no unit"), (1, "a\0b", "cannot hold")])
def test_refused(number, text, why):
    with pytest.raises(bilingual.Rejected, match=why):
        spliced.correct_bytes(TMX.encode(), "tmx", {number: text})


def test_other_encodings():
    latin = TMX.replace('version="1.0"', 'version="1.0" encoding="ISO-8859-1"', 1).replace("Two", "Twö").encode("latin-1")
    got = spliced.correct_bytes(latin, "tmx", {1: "é日"})
    assert got == latin.replace(b">Uno<", b">&#233;&#26085;<")
    assert [r["target"][0] for r in bilingual.rows_of("x.tmx", spliced.correct_bytes(TMX.encode("utf-16"), "tmx", {1: "é"}))][0] == "é"


def slow_spread(old, new):
    """By single characters: each goes to the node of the place at which its stretch begins, or of its equal."""
    whole = "".join(old)
    node_of = [k for k, t in enumerate(old) for _ in t]
    out = [""] * len(old)
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, whole, new, autojunk=False).get_opcodes():
        for n, c in enumerate(new[j1:j2]):
            out[node_of[min(i1 + (n if tag == "equal" else 0), len(whole) - 1)]] += c
    return out


def test_spread_equals_slow_reference():
    rnd = random.Random(4)
    for _ in range(300):
        old = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.choice([1, 2, 5, 60]))]
        new = list("".join(old))
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(new) + 1)
            new[at : at + rnd.randrange(4)] = rnd.choice(["", "[x]", "b", " a"])
        assert spliced.spread(old, "".join(new)) == slow_spread(old, "".join(new))
        assert "".join(spliced.spread(old, "".join(new))) == "".join(new)
    with pytest.raises(bilingual.Rejected):
        spliced.spread(["a" * 200_001], "b")


def test_rewritten_around_codes():
    got = spliced.rewrite_bytes(TMX.encode(), "tmx", {1: ("A  & B", None), 4: (None, "CuXtro & más")}).decode()
    assert got == TMX.replace("A  &amp; <![CDATA[b]]>", "A  &amp; B").replace('Cu<ph id="1">&lt;b&gt;</ph>atro', 'Cu<ph id="1">&lt;b&gt;</ph>Xtro &amp; más')
    same = spliced.rewrite_bytes(XLIFF.encode(), "xliff", {1: ("One two", "")})
    assert same == XLIFF.encode()
    with pytest.raises(bilingual.Rejected, match="no text"):
        spliced.rewrite_bytes(XLIFF.encode(), "xliff", {1: (None, "new")})


def word_file():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOCX)
        z.writestr("word/media/a.bin", b"\0\1")
        z.writestr("[Content_Types].xml", "<x/>")
    return out.getvalue()


def test_rewritten_word_file():
    data = word_file()
    got = spliced.rewrite_bytes(data, "docx", {1: (None, "First # end "), 3: (None, "B & x")})
    with zipfile.ZipFile(io.BytesIO(got)) as z:
        assert z.namelist() == ["word/document.xml", "word/media/a.bin", "[Content_Types].xml"] and z.read("word/media/a.bin") == b"\0\1"
        assert z.read("word/document.xml").decode() == DOCX.replace("<w:t>First ann</w:t>", '<w:t>First #</w:t>').replace(
            "<w:t>@x.org end</w:t>", '<w:t xml:space="preserve"> end </w:t>').replace("<w:t>Box</w:t>", "<w:t>B &amp; x</w:t>")
    assert [r["target"][0] for r in bilingual.rows_of("a.docx", got)] == ["First # end ", "cell", "B & x", "Out"]
    with pytest.raises(bilingual.Rejected):
        spliced.rewrite_bytes(data, "docx", {9: (None, "x")})


def test_files_meet_edits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tmx").write_text(TMX)
    (tmp_path / "in" / "b.xliff").write_text(XLIFF)
    (tmp_path / "in" / "c.docx").write_bytes(word_file())
    (tmp_path / "in" / "d.tmx").write_text(TMX)
    files = spliced.load_files(spark, str(tmp_path / "in"))
    edits = spark.createDataFrame([("a.tmx", 1, "Edit"), ("b.xliff", 1, None), ("c.docx", 1, "x"), ("gone.tmx", 1, "x"), ("d.tmx", 1, "x"), ("d.tmx", 1, "y"), (None, 1, "x")], "file string, local_id int, text string")
    got = {r["file"]: r for r in spliced.corrected(files, edits).collect()}
    assert {f: (r["name"], r["changed"], r["error"]) for f, r in got.items()} == {
        "a.tmx": ("Corrected_a.tmx", 1, None), "b.xliff": ("Corrected_b.xliff", 1, None), "c.docx": ("Corrected_c.docx", 0, "only bilingual XML can be edited"), "gone.tmx": (None, 0, "no such file"), "d.tmx": ("Corrected_d.tmx", 0, "two edits of one unit")}
    assert bytes(got["a.tmx"]["content"]).decode() == TMX.replace("Uno", "Edit")
    write_files(spliced.corrected(files, edits).where("error is null"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["Corrected_a.tmx", "Corrected_b.xliff"]
    assert bilingual.read_files(spark, str(tmp_path / "out")).where("target_text = 'Edit'").count() == 1
    with pytest.raises(Exception, match="one name twice"):
        write_files(spark.createDataFrame([("x", b"1"), ("x", b"2")], "name string, content binary"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 2
    assert spliced.corrected(files, edits.where("false")).count() == 0 and spliced.rewritten(files.where("false"), edits.where("false").selectExpr("file", "local_id", "text source_text", "text target_text")).count() == 0


def test_pairs_and_restores(spark):
    shape = "file string, local_id long, source_text string, target_text string"
    before = spark.createDataFrame([("a", 1, "s", "t"), ("a", 2, None, "u"), ("b", 1, "v", "w")], shape)
    after = spark.createDataFrame([("a", 1, "s", "T"), ("a", 2, None, "u"), ("b", 1, "V", "w")], shape)
    previews = pairing.paired(before, after)
    assert {(r.file, r.local_id, r.changed) for r in previews.collect()} == {("a", 1, True), ("a", 2, False), ("b", 1, True)}
    back = pairing.restored(previews, spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("z", 9)], "file string, local_id long"))
    assert {(r.file, r.local_id, r.target_after, r.changed, r.restored) for r in back.collect()} == {("a", 1, "t", False, True), ("a", 2, "u", False, False), ("b", 1, "w", True, False)}
    with pytest.raises(Exception, match="b unit 1"):
        pairing.paired(before, after.where("file = 'a'")).collect()


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = file_queries.fl_corrected(spark, sf).collect()
    assert sum(r.target_text.startswith("<") and r.target_text.endswith('& "é">') for r in rows) == sum(r.local_id % 3 == 0 for r in rows) > 0
    made = file_queries.fl_rewritten(spark, sf)
    assert made.where("not has_codes").count() == 0 and made.where("target_text like '%███%'").count() > 0
    assert file_queries.rp_word_diff(spark, sf).where("marked_before like '%<mark>%'").count() > 0


def test_files_of_a_run(spark):
    shape = "file string, content binary"
    word = word_file()
    good = spark.createDataFrame([("b.tmx", TMX.replace("C", "C").encode()), ("a.xliff", XLIFF.encode())], shape)
    got = [(r.file, r.format, r.source_lang, r.target_lang, r.units, r.offset) for r in bilingual.checked(bilingual.inspected(good)).orderBy("file").collect()]
    assert got == [("a.xliff", "xliff", "en", "es", 2, 0), ("b.tmx", "tmx", "en", "es", 4, 2)]
    looked = {r.file: (r.units, r.error) for r in bilingual.inspected(spark.createDataFrame([("x.tmx", b"<tmx>"), ("y.doc", b""), ("z.docx", b"PK\3\4"), ("w.docx", word)], shape)).collect()}
    assert looked["w.docx"] == (4, None) and all(looked[f][0] == 0 and looked[f][1] for f in ("x.tmx", "y.doc", "z.docx"))
    for other, why in ((("c.xliff", XLIFF.replace('"es"', '"fr"').encode()), "different languages"), (("c.docx", word), "different languages"), (("c.tmx", b"<tmx/>"), "c.tmx")):
        with pytest.raises(bilingual.Rejected, match=why):
            bilingual.checked(bilingual.inspected(good.union(spark.createDataFrame([other], shape))))
    assert bilingual.checked(bilingual.inspected(good.where("false"))).count() == 0


def test_equal_texts_are_not_compared(monkeypatch):
    """a text that stays as it is took an automaton of all its characters."""
    monkeypatch.setattr(spliced, "edits_of", lambda *_, **__: pytest.fail("compared"))
    assert spliced.spread(["one ", "two", ""], "one two") == ["one ", "two", ""]
    with pytest.raises(spliced.Rejected):
        spliced.spread(["a" * (spliced.MOST_CHARS + 1)], "a" * (spliced.MOST_CHARS + 1))
