import difflib
import random

from segmentry.operators import dedup
from segmentry.operators.similarity import accepted_leaders


def greedy(n, edges):
    """Node by node, as a single loop does it."""
    used, out = set(), {}
    for i in range(n):
        if i in used:
            continue
        members = [j for j in range(i + 1, n) if j not in used and (i, j) in edges]
        if any(edges[i, j] for j in members):
            used |= {i, *members}
            out |= {i: i} | {j: i for j in members}
    return out


def test_accepted_leaders_equal_a_loop(spark):
    rnd = random.Random(6)
    for n, p in ((8, 0.5), (14, 0.3), (12, 0.15)):
        edges = {(i, j): rnd.random() < 0.4 for i in range(n) for j in range(i + 1, n) if rnd.random() < p}
        df = spark.createDataFrame([(i, j, d) for (i, j), d in edges.items()], "a long, b long, differs boolean")
        assert {r.member: r.leader for r in accepted_leaders(df).collect()} == greedy(n, edges)
    assert accepted_leaders(df.where("false")).count() == 0


def test_target_filter_equals_all_pairs(spark):
    rnd = random.Random(1)
    base = ["the quick brown fox jumps over the dog", "a lazy afternoon in the summer garden"]
    rows = []
    for i in range(24):
        s = list(rnd.choice(base))
        s[rnd.randrange(len(s))] = rnd.choice("xyz")
        rows.append((i, "".join(s), rnd.choice(["same target text here", "same target text hers", "something else altogether"]) * rnd.choice([1, 14])))
    rows = list({s: (i, s, t) for i, s, t in reversed(rows)}.values())
    ids = sorted(i for i, _, _ in rows)
    at = {i: (s, t) for i, s, t in rows}
    alike = lambda a, b, junk: difflib.SequenceMatcher(None, a, b, autojunk=junk).ratio()
    edges = {(x, y): alike(at[ids[x]][1], at[ids[y]][1], True) <= 0.9 for x in range(len(ids)) for y in range(x + 1, len(ids)) if alike(at[ids[x]][0], at[ids[y]][0], False) >= 0.85}
    want = {ids[k]: ids[v] for k, v in greedy(len(ids), edges).items()}
    df = spark.createDataFrame(rows, "key long, source string, target string")
    assert {r.key: r.leader for r in dedup.source_variants(df, most_alike=0.9).collect()} == want


def test_consistency_findings_carry_their_reference(spark):
    from segmentry.operators import cross
    from segmentry.schema import segments

    rows = [("f", 1, " same source text ", "one target here"), ("f", 2, "same source text", "another target here"), ("g", 3, "other source text", "one target here"), ("g", 4, "wholly different", "nothing alike"), ("g", 5, "the very long source sentence", "the very long target sentence"), ("g", 6, "the very long source sentences", "the very long target sentencez")]
    df = segments(spark.createDataFrame(rows, "file string, id long, source_text string, target_text string"))
    got = {(r.id, r.kind): r for r in cross.consistency_findings(df, 0.9).collect()}
    assert set(got) == {(2, "exact-target"), (3, "exact-source"), (6, "fuzzy-both")}
    r = got[2, "exact-target"]
    assert (r.reference_id, r.reference_file, r.reference_source, r.reference_target, r.sibling_ids, r.group_size, r.mismatch_axis) == (1, "f", "same source text", "one target here", [1, 2], 2, "target")
    assert got[6, "fuzzy-both"].note == "Consistency (fuzzy-both): compare with segment 5; group size 2." and got[6, "fuzzy-both"].mismatch_axis == "both"
    assert cross.consistency_findings(df.where("false")).count() == 0


def test_sources_and_targets_are_compared_once(spark, monkeypatch):
    """lines that are a source and a target were compared on both sides."""
    from segmentry.operators import similarity
    from segmentry.schema import segments

    rnd, base = random.Random(12), ["some longer sentence of a text", "another sentence of that text"]
    lines = ["".join(c if rnd.random() > 0.06 else rnd.choice("xy") for c in rnd.choice(base)) for _ in range(30)]
    rows = [("f", i, lines[i], lines[i + 1]) for i in range(29)]
    asked, pairs = [], similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda texts, *x, **y: asked.append(texts.count()) or pairs(texts, *x, **y))
    got = {(r.a, r.b, r.kind) for r in similarity.fuzzy_consistency(segments(spark.createDataFrame(rows, "file string, id long, source_text string, target_text string")), 0.85).collect()}
    assert asked == [len(set(lines))]
    first: dict = {}
    for _, i, s, t in rows:
        first.setdefault((s, t), i)
    lead = [{}, {}]
    for (s, t), i in first.items():
        lead[0].setdefault(s, i), lead[1].setdefault(t, i)

    def alike(k, x, y):
        if x == y:
            return False
        x, y = sorted((x, y), key=lead[k].get)
        return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.85

    want = set()
    for (p, i) in first.items():
        for (q, j) in first.items():
            if i < j and p[0] != q[0] and p[1] != q[1]:
                by = alike(0, p[0], q[0]), alike(1, p[1], q[1])
                if any(by):
                    want.add((i, j, "fuzzy-both" if all(by) else "fuzzy-target" if by[0] else "fuzzy-source"))
    assert got == want and got
