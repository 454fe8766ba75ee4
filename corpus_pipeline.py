"""A training corpus from ``documents``: toxicity, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``. Rows of one doc_id, or of none, but of different texts are different documents; extra columns
pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm import bpe_fst, near_copies, pii_fpe, raking, toxicity
from segmentry.llm.common import durable, read, spare
from segmentry.llm.queries import VOCABULARY


#: The encoder shares its executors' memory with what the earlier stages left there, so its tables are smaller than by itself.
ENCODER_STATES, ENCODER_KNOWN = 40_000, 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity reaches the threshold go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    (out,) = spare(docs, "_toxicity")
    return toxicity.score(docs, model, out=out).where(F.col(out) < toxicity.THRESHOLD).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by resemblance (five words, 0.8 or more) one row stays: the least id, then the least text hash."""
    return near_copies.keep_one(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their own format; n_chars follows the text."""
    (count,) = spare(docs, "_n_pseudonyms")
    made = pii_fpe.pseudonymise(docs, pii_fpe.DEMO_KEY, count=count)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with probabilities raked to source, language and topic targets."""
    return raking.mix(docs).where("sampled").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return bpe_fst.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN, most_states=ENCODER_STATES, most_known=ENCODER_KNOWN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: Fitted trees, SHA-keyed permutations and XXH64 are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
