"""The thin queries over the driver's tables, with production parameters; whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_fst, chroma, decontaminate, fingerprints, hard_negatives, html_extract, pii_fpe, raking, simhash, suffix_dedup, token_alignment, toxicity, url_rules
from .common import read

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    mined = url_rules.mine(url_rules.labelled(pages, read(spark, sf_dir, "labels")))
    return url_rules.judge(pages.select("page_id", "url"), mined).drop("url")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.round_trip(read(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_fpe.pseudonymise(read(spark, sf_dir, "documents"), pii_fpe.DEMO_KEY).select("doc_id", "text", "n_pseudonyms")


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: each embedding is played as one (``chroma.sonified``)."""
    media = read(spark, sf_dir, "embeddings")
    return chroma.align(chroma.with_items(media, "embedding", decode=chroma.sonified, keep=["vec_id"]))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(read(spark, sf_dir, "documents")).drop("text", "n_chars")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"), *ALIGNED, public_tokenizers.PATTERN, keep=["doc_id"])


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label is moved on by one, as the contract has it."""
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_url_rules": op2_url_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_chroma": op9_chroma,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_decontamination": op12_decontamination,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op12_decontamination": f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
items as (select item_id, w, least(len(w), 10) as k from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
windows as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as win from items),
places as (select r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 'win': array_to_string(w[i:i + k - 1], ' ')}})) as p
    from docs, (select distinct k from windows) where len(w) >= k),
hits as (select r, p.i as i, places.k as k, item_id from places join windows on places.k = windows.k and p.win = windows.win),
words as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + k)) as place from hits) group by r),
named as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (r) left join named using (r)""",
    "op13_hard_negatives": """
with used as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor, a.label = r.label as same, r.vec_id as id, list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])) as score
    from used a join used r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positives as (
    select anchor, id, score from (select *, row_number() over (partition by anchor order by score desc, id) as place from scored where same) where place <= 5),
negatives as (
    select p.anchor, p.id as positive, p.score as positive_score, s.id as negative, s.score as negative_score,
        row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) as place
    from positives p join scored s on s.anchor = p.anchor and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor as anchor_id, positive as positive_id, cast(place as integer) as rank, negative as negative_id, cast(positive_score as bigint) as positive_score, cast(negative_score as bigint) as negative_score
from negatives where place <= 5""",
}
