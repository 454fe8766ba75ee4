"""Row types and the dimension of check categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.StringType()), T.StructField("is_fmt", T.BooleanType())])
TEXTS = ("source_text", "target_text", "source_glossary", "target_glossary", "source_raw", "target_raw", "source_display", "target_display", "target_edges")
SEGMENT = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("id", T.LongType()), T.StructField("local_id", T.LongType()), T.StructField("original_id", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in TEXTS]
    + [T.StructField("source_tags", T.ArrayType(TAG)), T.StructField("target_tags", T.ArrayType(TAG)), T.StructField("has_tags", T.BooleanType()), T.StructField("document_id", T.StringType())])
SPANS = T.StructType([T.StructField("span_source", T.ArrayType(T.StringType())), T.StructField("span_target", T.ArrayType(T.StringType())), T.StructField("note", T.StringType())])

#: Category, group, severity, opt-in, applies to monolingual text; in display order.
CATEGORIES = (
    ("empty_target", "Content", "high", False, False), ("untranslated_segment", "Content", "high", False, False), ("inconsistent_translation", "Content", "high", False, False),
    ("repeated_words", "Content", "high", False, True), ("length_ratio", "Content", "high", False, False), ("polarity_mismatch", "Content", "high", True, False),
    ("urls", "Content", "high", False, False), ("emails", "Content", "high", False, False), ("first_letter_case", "Content", "high", False, False),
    ("alluppercase_mismatch", "Content", "high", False, False), ("camelcase_mismatch", "Content", "high", False, False), ("bracket_balance", "Content", "high", False, True),
    ("repeated_punctuation", "Content", "high", False, True), ("final_punctuation_mismatch", "Content", "high", False, False), ("double_spaces", "Content", "high", False, True),
    ("whitespace_edges", "Content", "high", False, True), ("control_characters", "Content", "high", False, True), ("mixed_scripts", "Content", "high", False, True),
    ("custom_forbidden_regex", "Content", "high", True, True), ("custom_required_regex", "Content", "high", True, False),
    ("number_mismatch", "Numeric Elements", "high", False, False), ("range_ratio_mismatch", "Numeric Elements", "high", False, False), ("unit_mismatch", "Numeric Elements", "high", False, False),
    ("symbol_mismatch", "Numeric Elements", "high", False, False), ("alphanum_id_mismatch", "Numeric Elements", "high", False, False),
    ("number_format_mismatch", "Numeric Elements", "low", False, False), ("date_format_mismatch", "Numeric Elements", "high", False, False),
    ("tag_count", "Tags", "high", False, False), ("tag_malformed", "Tags", "high", False, False), ("placeholders", "Tags", "high", False, False), ("tag_order", "Tags", "high", False, False),
    ("forbidden_terms", "Terminology", "high", False, True), ("glossary_violation", "Terminology", "high", False, False),
    ("spellcheck", "Spelling", "low", False, True), ("confusable_pairs", "Spelling", "low", True, True),
)
GROUPS = ("Content", "Numeric Elements", "Tags", "Terminology", "Spelling")
DEFAULT_CHECKS = frozenset(c[0] for c in CATEGORIES if not c[3])
MONOLINGUAL_CHECKS = frozenset(c[0] for c in CATEGORIES if c[4])


def check_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, g, s, GROUPS.index(g), i, o, m) for i, (c, g, s, o, m) in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "category_id string, grp string, severity string, grp_rank int, cat_rank int, opt_in boolean, monolingual boolean")


def category_column(category: Column, field: int) -> Column:
    """Group (1) or severity (2) of a category as an expression; 35 entries, no join."""
    return F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c[0], c[field])])[category]


def segments(df: DataFrame) -> DataFrame:
    """Complete a table that has at least id, source_text and target_text to SEGMENT."""
    have = set(df.columns)
    text = {"source_glossary": "source_text", "target_glossary": "target_text", "source_raw": "source_text", "target_raw": "target_text",
            "source_display": "source_text", "target_display": "target_text", "target_edges": "target_text"}
    made = []
    for f in SEGMENT.fields:
        if f.name in have:
            c = F.col(f.name)
        elif f.name in text:
            c = F.col(text[f.name])
        elif f.name == "local_id":
            c = F.col("id")
        elif f.name == "original_id":
            c = F.col("id").cast("string")
        elif f.name == "has_tags":
            c = F.lit(False)
        elif f.name.endswith("_tags"):
            c = F.array().cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        made.append(c.cast(f.dataType).alias(f.name))
    return df.select(*made)
