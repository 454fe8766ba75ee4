import os

import public_tokenizers as P
import pytest
import tiktoken

SF = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version over the rows that the stage before kept."""
    if not os.path.exists(SF):
        pytest.skip("no tables")
    import corpus_pipeline
    from segmentry.llm import bpe_fst, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        docs = spark.createDataFrame(made.collect(), made.schema)
        kept.append({r.doc_id: r for r in docs.collect()})
    first = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(first)
    scores = dict(zip(ids, model.scores([first[i].text or "" for i in ids])))
    assert set(kept[0]) == {i for i in ids if scores[i] < toxicity.THRESHOLD}
    from tests.llm.test_near_copies import brute

    rows = [kept[0][i] for i in sorted(kept[0])]
    least = {}
    for r, g in zip(rows, brute([r.text for r in rows])):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    stay = set(least.values())
    assert set(kept[1]) == stay and set(kept[2]) == stay
    assert all(kept[2][i].n_chars == len(kept[2][i].text) for i in stay)
    assert set(kept[3]) <= stay and all(kept[3][i] == kept[2][i] for i in kept[3])
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}).encode_ordinary
    assert {i: r.n_tokens for i, r in kept[4].items()} == {i: len(encode(r.text)) for i, r in kept[3].items()}


def test_nulls_equal_ids_other_columns_and_no_rows(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"word{k}x{j}" for j in range(30))
    rows = [(None, text(0), "en", "a", 1, "p"), (None, text(1), None, "a", 1, "q"), (7, text(2), "de", None, 1, "r"), (7, text(3), "de", "b", 1, "s"), (7, text(3), "de", "b", 1, "s"), (8, None, None, None, None, None), (9, "", "en", "a", 0, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _toxicity string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
        got = made.collect()
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        if name == "simhash_near_dedup":
            assert sorted(str(r[0]) + str(r[1])[:7] for r in got) == sorted(["None" + text(0)[:7], "None" + text(1)[:7], "7" + text(2)[:7], "7" + text(3)[:7], "8None"])
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == len(rows) and sum(r.n_tokens == 0 for r in tokens) == 2
