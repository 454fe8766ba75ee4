import gc
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from segmentry.llm import bpe_fst


@pytest.fixture(scope="module")
def ranks():
    return bpe_fst.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def sample(n=1500, seed=1):
    rnd = random.Random(seed)
    pool = "aeiouthsABC'st   \n\t\x1c\x85\xa0.,-!0123éçß漢字😀́²½"
    return ["", " ", "  ", "a b", " lead", "trail ", "-" * 3000, "ab" * 2000, "\n" * 500] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_like_the_library(ranks, monkeypatch):
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = sample()
    encoder = bpe_fst.Encoder(ranks, P.PATTERN)
    assert [encoder.encode(t) for t in texts] == [want(t) for t in texts]
    monkeypatch.setattr(bpe_fst, "MAX_STATES", 50)
    monkeypatch.setattr(bpe_fst, "MAX_KNOWN", 20)
    encoder = bpe_fst.Encoder(ranks, P.PATTERN)
    assert [encoder.encode(t) for t in texts] == [want(t) for t in texts]


def naive(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_small_vocabularies_and_few_states(monkeypatch):
    rnd = random.Random(5)
    for seed in range(30):
        small = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(small) < 25:
            a, b = rnd.choice(list(small)), rnd.choice(list(small))
            if len(a + b) < 9 and len(naive(a + b, small)) == 2:  # what training could add
                small.setdefault(a + b, len(small))
        monkeypatch.setattr(bpe_fst, "MAX_STATES", 5 if seed % 2 else 1000)
        machine = bpe_fst.Transducer(small)
        for _ in range(60):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 30)))
            assert machine.run(data) == naive(data, small)


def test_another_pattern(ranks):
    pattern = r"\S+ \S+|\s+|\S+"
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["the cat sat on the mat.", *sample(200, 3)]
    encoder = bpe_fst.Encoder(ranks, pattern)
    assert [encoder.encode(t) for t in texts] == [want(t) for t in texts]


def test_streaming_decoder(ranks):
    encoder = bpe_fst.Encoder(ranks, P.PATTERN)
    decoder = bpe_fst.Decoder(encoder.machine.spelled)
    for t in sample(300, 2):
        ids = encoder.encode(t)
        assert decoder.decode(ids) == t.encode()
        parts = [decoder.feed([i]) for i in ids] + [decoder.finish()]
        assert b"".join(parts) == t.encode() and all(p.decode() is not None for p in parts)
    assert decoder.decode([ranks[b"\xe6"]]) == b"\xe6"


def test_operators(spark):
    rows = [(1, "Hello world 漢字", "x"), (1, "Hello world 漢字", "x"), (2, None, "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = sorted(bpe_fst.round_trip(df, path, P.PATTERN).collect())
    assert [r.doc_id for r in got] == [1, 1, 2, 3] and got[2].n_tokens == 0 and got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0].decoded_sha256 == hashlib.sha256("Hello world 漢字".encode()).hexdigest()
    back = bpe_fst.decode(bpe_fst.encode(df, path, P.PATTERN), path).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(1, "Hello world 漢字"), (1, "Hello world 漢字"), (2, ""), (3, "")]
    assert bpe_fst.round_trip(df.limit(0), path, P.PATTERN).collect() == []


def test_tables_are_no_work_for_the_garbage_collector(ranks):
    encoder = bpe_fst.Encoder(ranks, P.PATTERN)
    for t in sample(300, 4) + ["the cat, sat. on 12 mats"]:
        encoder.encode(t)
    for _ in range(4):  # nested tuples, from the innermost
        gc.collect()
    held = [ids for known in (encoder.pieces, encoder.words) for ids in known.new.values()]
    assert len(held) > 100 and not any(map(gc.is_tracked, held))
    assert len(encoder.machine.moves) > 100 and not any(map(gc.is_tracked, encoder.machine.moves.values()))
