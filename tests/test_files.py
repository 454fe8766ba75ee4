import zipfile

import pytest

from segmentry.sources import bilingual, inputs, sinks
from segmentry.streaming import checks as streaming

TMX = """<?xml version="1.0"?><tmx version="1.4"><header srclang="en"/><body>
<tu tuid="7"><prop type="x-document">doc-0123456789abcdef</prop><tuv xml:lang="en"><seg>Hello <bpt i="1" ctype="bold">{}</bpt>bold<ept i="1">{}</ept> <ph id="2">x</ph>world &lt;ph/> z</seg></tuv><tuv xml:lang="es"><seg>Hola <ph id="2"/> mundo</seg></tuv></tu>
<tu><tuv xml:lang="en"><seg>Only</seg></tuv><tuv xml:lang="es"><seg></seg></tuv></tu></body></tmx>"""
XLIFF = """<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file source-language="en" target-language="es"><body><trans-unit id="a"><source>One <g id="1">two</g></source><target>Uno <mrk>dos</mrk></target></trans-unit><trans-unit id="b"><source>Three</source></trans-unit></body></file></xliff>"""
DOCX = """<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>cell</w:t></w:r></w:p><w:p><w:r><w:delText>gone</w:delText><w:t> </w:t></w:r></w:p><w:p><w:r><w:t>Out</w:t><w:txbx><w:p><w:r><w:t>Box</w:t></w:r></w:p></w:txbx></w:r></w:p></w:body></w:document>"""


def test_formats(spark, tmp_path):
    (tmp_path / "a.tmx").write_text(TMX)
    (tmp_path / "b.mqxliff").write_bytes(XLIFF.encode("utf-16"))
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", DOCX)
    rows = bilingual.read_files(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.file, r.id, r.local_id) for r in rows] == [("a.tmx", 1, 1), ("a.tmx", 2, 2), ("b.mqxliff", 3, 1), ("b.mqxliff", 4, 2), ("c.docx", 5, 1), ("c.docx", 6, 2), ("c.docx", 7, 3), ("c.docx", 8, 4)]
    a = rows[0]
    assert a.source_text == "Hello bold world z" and a.target_text == "Hola  mundo" and a.target_display == "Hola [2] mundo" and a.original_id == "7" and a.document_id == "doc-0123456789abcdef"
    assert [(t["name"], t["is_fmt"]) for t in a.source_tags] == [("bpt", True), ("ept", True), ("ph", False)] and rows[1].target_text == ""
    assert rows[2].source_display == "One [1]two[/1]" and rows[2].target_text == "Uno dos" and rows[3].target_text == ""
    assert [r.target_text for r in rows[4:]] == ["First", "cell", "Box", "Out"]


def test_equal_base_names(spark, tmp_path):
    for folder in ("a", "b", "c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.tmx").write_text(TMX)
    rows = bilingual.read_files(spark, f"{tmp_path}/*/").orderBy("id").collect()
    assert [(r.file, r.id, r.local_id) for r in rows] == [(f"{f}/x.tmx", 2 * k + i, i) for k, f in enumerate("abc") for i in (1, 2)]
    assert {r.file for r in bilingual.read_files(spark, f"{tmp_path}/a/x.tmx").collect()} == {"x.tmx"}


@pytest.mark.parametrize("bad", [
    TMX.replace(' srclang="en"', ""), TMX.replace('xml:lang="es"><seg></seg>', 'xml:lang="de"><seg></seg>').replace('xml:lang="es"', 'xml:lang="fr"'), TMX.replace('xml:lang="es"', 'xml:lang="en"'), '<!DOCTYPE x [<!ENTITY y "z">]>' + TMX.split("?>", 1)[1], "<tmx><header srclang='en'/></tmx>", "<tmx>", "<html/>"])
def test_rejected(bad):
    with pytest.raises(bilingual.Rejected):
        list(bilingual.rows_of("x.tmx", bad.encode()))


def test_tmx_round_trip():
    data = bilingual.write_tmx([("a & <b>", "c", "doc-1"), ("d", "e", None)], "en", "es")
    got = [(r["source"][0], r["target"][0], r["document_id"]) for r in bilingual.rows_of("x.tmx", data)]
    assert got == [("a & <b>", "c", "doc-1"), ("d", "e", None)]


def test_inputs():
    assert inputs.term_list("a\n\na\nb".encode("utf-16")) == ["a", "b"] and inputs.forbidden_terms("A\na\nb") == ["A", "b"]
    assert inputs.glossary("source\ttarget\nuno\tone\tnote\nUno\tOne".encode()) == [("uno", "one", "note")] and inputs.glossary(b"uno  one") == [("uno", "one", None)]
    assert inputs.confusable_groups("a|b\nb/a\nc") == [["a", "b"]]
    assert inputs.patterns("# x\n(\na+")[1] and inputs.pattern_table("Tipo;Origen;Destino;D\nprohibido;;x;\nobligatorio;a;b;".encode()) == ([(None, "x")], [("a", "b")])
    with pytest.raises(ValueError):
        inputs.term_list(b"a\0b")
    assert inputs.confusable_groups("a|A|b\nB/a") == [["a", "b"]]
    for bad in ("a|" + "b" * 501, "\n".join(f"a{i}|b{i}" for i in range(10_001))):
        with pytest.raises(ValueError):
            inputs.confusable_groups(bad)


def test_sinks_and_stream(spark, tmp_path):
    from segmentry.operators import reports
    from segmentry.operators.checks import Config, check_segments
    from segmentry.schema import segments

    rows = spark.createDataFrame([("f", 1, "Hello.", "hola  x"), ("f", 2, "=a", "b")], "file string, id long, source_text string, target_text string")
    found = check_segments(segments(rows), Config())
    flat = reports.flattened(found, segments(rows))
    sinks.write_csv(flat, str(tmp_path / "csv"))
    sinks.write_html(flat, str(tmp_path / "html"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == flat.count()
    rows.write.parquet(str(tmp_path / "in"))
    streaming.run_available(streaming.check_stream(streaming.stream_of(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    key = lambda df: sorted((r.id, r.category_id) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(found)


def test_inspected_files_come_in_batches_and_offsets_from_counts(spark, monkeypatch):
    """each file was a frame of its own, and each unit became a row again to be counted."""
    import pandas as pd

    from segmentry.sources import bilingual

    made, frame = [], pd.DataFrame
    monkeypatch.setattr(bilingual.pd, "DataFrame", lambda *x, **y: made.append(1) or frame(*x, **y))

    class Contents:
        def select(self, *_):
            return self

        def mapInPandas(self, look, _):
            files = [(f"{i}.tmx", bilingual.write_tmx([("a", "b", None)] * (i + 1), "en", "es")) for i in range(50)]
            batch = frame(files, columns=["file", "content"])
            return list(look(iter([batch])))

    found = pd.concat(bilingual.inspected(Contents()))
    assert found["units"].tolist() == list(range(1, 51)) and found["error"].isna().all() and len(made) == 1
    monkeypatch.setattr(bilingual.pd, "DataFrame", frame)
    monkeypatch.setattr(bilingual.F, "explode", None)
    files = spark.createDataFrame([("b.tmx", "tmx", "en", "es", 3, None), ("a.tmx", "tmx", "en", "es", 2, None), ("c.tmx", "tmx", "en", "es", 10**12, None)], bilingual.FILES)
    assert sorted((r.file, r.units, r.offset) for r in bilingual.checked(files).collect()) == [("a.tmx", 2, 0), ("b.tmx", 3, 2), ("c.tmx", 10**12, 5)]
