import random

import pytest
from pyspark.sql import functions as F

from segmentry.operators import terms
from segmentry.schema import segments
from segmentry.sources import affixes as ax

AFF = """SET UTF-8
# rules of our own
NEEDAFFIX !
FORBIDDENWORD *
KEEPCASE k
CIRCUMFIX c

PFX U Y 1
PFX U 0 un .

PFX G Y 1
PFX G 0 ge/c .

SFX S Y 4
SFX S y ies [^aeiou]y
SFX S 0 s [aeiou]y
SFX S 0 es [sxz]
SFX S 0 s [^sxzy]

SFX D Y 3
SFX D 0 d e
SFX D y ied [^aeiou]y
SFX D 0 ed [^ey]

SFX R Y 2
SFX R 0 er/S [^e]
SFX R 0 r/S e

SFX T Y 1
SFX T en t/c .

SFX N Y 1
SFX N 0 ness/! .
"""
DIC = """9
study/SD
box/S
lock/USDR
boy/S
sagen/GT
pseud/!R
locked/*
iPod/kS
kind/N
"""


def slow_forms(word, flags, aff):
    """Every form by trying all rules on all forms so far, up to three affixes, and checking how they may meet."""
    rules = [(is_suffix, r) for own in aff.rules.values() for is_suffix, r in own]
    if aff.has("FORBIDDENWORD", flags):
        return set()
    out = set() if aff.has("NEEDAFFIX", flags) else {word}
    todo = [(word, ())]
    while todo:
        form, used = todo.pop()
        for is_suffix, r in rules:
            if len(used) == 3 or sum(k for k, _ in used) == 2 and is_suffix or any(not k for k, _ in used) and not is_suffix:
                continue
            ok = form.endswith(r.strip) if is_suffix else form.startswith(r.strip)
            if not ok or len(form) <= len(r.strip):
                continue
            base = form
            # a rule's condition is on what it hangs on; prefixes and suffixes do not see each other
            if not r.meets(base, is_suffix):
                continue
            made = form[: len(form) - len(r.strip)] + r.add if is_suffix else r.add + form[len(r.strip) :]
            todo.append((made, (*used, (is_suffix, r))))
            steps = (*used, (is_suffix, r))
            if allowed(steps, flags, aff):
                out.add(made)
    return out


def allowed(steps, flags, aff):
    around = sum(aff.has("CIRCUMFIX", r.more) for _, r in steps)
    if around == 1:
        return False
    if len(steps) == 1:
        (_, r), = steps
        return r.flag in flags and not aff.has("NEEDAFFIX", r.more)
    suffixes = [r for k, r in steps if k]
    prefixes = [r for k, r in steps if not k]
    if len(suffixes) == 2 and suffixes[1].flag not in suffixes[0].more:
        return False
    if suffixes[0].flag not in flags and not (prefixes and suffixes[0].flag in prefixes[0].more and prefixes[0].flag in flags):
        return False
    if len(suffixes) == 2 and aff.has("NEEDAFFIX", suffixes[1].more):
        return False
    if prefixes:
        p, s = prefixes[0], suffixes[0]
        direct = p.flag in flags and p.cross and s.cross and s.flag in flags
        if not (direct or p.flag in s.more and s.flag in flags or s.flag in p.more and p.flag in flags):
            return False
        if len(suffixes) == 1 and aff.has("NEEDAFFIX", p.more) and aff.has("NEEDAFFIX", s.more):
            return False
        if len(suffixes) == 2 and not direct:
            return False
    return True


def entries(aff):
    return [e for e in (ax.entry_of(line, aff) for line in DIC.splitlines()[1:]) if e]


def test_forms_by_hand():
    aff = ax.parse_affixes(b"\xef\xbb\xbf" + AFF.encode())
    made = {w: aff.forms(w, frozenset(f)) for w, f in entries(aff)}
    assert made["study"] == {"study", "studies", "studied"} and made["box"] == {"box", "boxes"} and made["boy"] == {"boy", "boys"}
    assert made["lock"] == {"lock", "locks", "locked", "locker", "lockers", "unlock", "unlocks", "unlocked", "unlocker", "unlockers"}
    assert made["pseud"] == {"pseuder", "pseuders"} and made["locked"] == set() and made["iPod"] == {"iPod", "iPods"} and made["kind"] == {"kind"} and made["sagen"] == {"sagen", "gesagt"}


def test_forms_and_analyses_agree_with_trying_all_rules():
    aff = ax.parse_affixes(AFF.encode())
    for word, flags in entries(aff):
        forms = aff.forms(word, frozenset(flags))
        assert forms == slow_forms(word, frozenset(flags), aff)
        for form in forms:
            assert any(stem == word and set(need) <= set(flags) for stem, need, _ in aff.analyses(form)), (word, form)
    rnd = random.Random(1)
    own = {w: frozenset(f) for w, f in entries(aff)}
    forms = {f: w for w, flags in own.items() for f in aff.forms(w, flags)}
    for _ in range(3000):
        word = rnd.choice(["un", "ge", ""]) + rnd.choice([w[: rnd.randrange(2, len(w) + 1)] for w in own]) + rnd.choice(["", "s", "es", "ies", "ied", "ed", "er", "ers", "t", "ness", "d"])
        read = {stem for stem, need, affix in aff.analyses(word) if stem in own and set(need) <= own[stem] and not aff.has("FORBIDDENWORD", own[stem]) and (affix or not aff.has("NEEDAFFIX", own[stem]))}
        assert bool(read) == (word in forms), (word, read)


def test_flags_and_faults():
    assert ax.parse_affixes(b"FLAG long\nSFX Aa Y 1\nSFX Aa 0 s .\n").flags_of("AaBb") == {"Aa", "Bb"}
    assert ax.parse_affixes(b"FLAG num\nAF 1\nAF 12,7\n").flags_of("1") == {"12", "7"}
    assert ax.condition_of("[^ab].c") == ((True, frozenset("ab")), (True, frozenset()), (False, frozenset("c")))
    assert ax.entry_of("and\\/or/S\tpo:x", ax.Affixes()) == ("and/or", ["S"]) and ax.entry_of("", ax.Affixes()) is None and ax.entry_of("a b st:x", ax.Affixes()) == ("a b", [])
    with pytest.raises(ValueError, match="no head"):
        ax.parse_affixes(b"SFX A 0 s\n")


def test_files_spelling_and_glossary(spark, tmp_path):
    (tmp_path / "x.dic").write_bytes(DIC.encode())
    aff = ax.parse_affixes(AFF.encode())
    dic = ax.read_entries(spark, str(tmp_path / "x.dic"), aff)
    assert sorted((r.word, r.flags) for r in dic.collect()) == sorted((w, f) for w, f in entries(aff))
    every = {(r.form, r.stem) for r in ax.all_forms(dic, aff).collect()}
    assert every == {(f, w) for w, flags in entries(aff) for f in aff.forms(w, frozenset(flags))}
    words = spark.createDataFrame([(w,) for w in ("Studies", "UNLOCKS", "locked", "ipods", "iPods", "IPODS", "boxs", "kindness", "pseud", "Boy", None, "Boy")], "word string")
    assert sorted((r.form, r.stem) for r in ax.known_forms(words, dic, aff).collect()) == [("Boy", "boy"), ("Studies", "study"), ("UNLOCKS", "lock"), ("iPods", "iPod")]
    rows = segments(spark.createDataFrame([("f", 1, "two studies", "las cajas"), ("f", 2, "a study", "una caja"), ("f", 3, "the study", "nada"), ("f", 4, "studying", "nada")], "file string, id long, source_text string, target_text string"))
    glossary = spark.createDataFrame([("study", "caja", None)], "source string, target string, note string")
    target = spark.createDataFrame([("caja", "caja"), ("cajas", "caja")], "form string, stem string")
    source = ax.known_forms(rows.select(F.explode(F.split("source_text", " ")).alias("word")), dic, aff)
    assert [r.id for r in terms.glossary_violation(rows, glossary, stems=target, source_stems=source).collect()] == [3]
    assert sorted(r.id for r in terms.glossary_violation(rows, glossary).collect()) == [3]
    assert sorted(r.id for r in terms.glossary_violation(rows, glossary, source_stems=source).collect()) == [1, 3]
    lexicon = ax.known_forms(rows.select(F.explode(F.split("source_text", " ")).alias("word")), dic, aff)
    found = terms.spellcheck(rows.select("file", "id", F.col("source_text").alias("target_text"), F.lit("").alias("source_text")), lexicon, spark.createDataFrame([("two",), ("the",)], "term string"))
    assert {(r.id, tuple(r.span_target)) for r in found.collect()} == {(4, ("studying",))}
    (tmp_path / "y.dic").write_text("word/S\n")
    with pytest.raises(Exception, match="no count"):
        ax.read_entries(spark, str(tmp_path / "y.dic"), aff).collect()
