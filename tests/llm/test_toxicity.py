import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    if not os.path.exists(SF):
        pytest.skip("no tables")
    from segmentry.llm.queries import op4_toxicity

    got = op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    score, y = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    shown = np.array([r.predicted for r in got])
    recall, precision = shown[y == 1].mean(), y[shown == 1].mean()
    print(auc, recall, precision)
    assert auc > 0.95 and recall > 0.85 and precision > 0.9
    assert ((0 <= score) & (score <= 1)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"{'you stupid idiot' if i % 3 == 0 else 'a fine day'} {i}", "x") for i in range(600)] + [(700, None, "x"), (701, "", "x"), (None, "text", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 603 and got[0] > 0.9 > 0.1 > got[1] and got[700] == got[701] < 0.5
    assert toxicity.score(docs.limit(0), model).collect() == []
    none = toxicity.fit(docs, labels.limit(0))
    assert all(abs(r.score - 0.5) < 0.1 for r in toxicity.score(docs, none).collect())


def test_obfuscation():
    assert {"idiot", "stupid"} <= set(toxicity.undone("an 1d10t and s.t.u.p.i.d one")) and "moron" in toxicity.undone("a moooron")


def test_isotonic_is_monotone():
    rnd = np.random.default_rng(1)
    s = rnd.random(500)
    x, v = toxicity.isotonic(s, (rnd.random(500) < s).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(v) >= 0).all()
