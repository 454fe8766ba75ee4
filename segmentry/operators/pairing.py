"""Originals and their redacted versions, unit by unit, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(original: DataFrame, redacted: DataFrame) -> DataFrame:
    """Previews (file, local_id, *_before, *_after, changed) from two readings of files (file, local_id, source_text, target_text).

    Units pair by their number inside the file, so nothing is sorted across files. A unit that only one of the two has
    means that the files do not belong together: reading it is an error that names the file.
    """
    side = lambda rows, name: rows.select("file", "local_id", F.col("source_text").alias(f"source_{name}"), F.col("target_text").alias(f"target_{name}"), F.lit(True).alias(f"_{name}"))
    met = side(original, "before").join(side(redacted, "after"), ["file", "local_id"], "full")
    whole = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    odd = F.raise_error(F.concat(F.lit("original and redacted file differ in their units: "), F.col("file"), F.lit(" unit "), F.col("local_id").cast("string")))
    differs = ~(F.col("source_before").eqNullSafe(F.col("source_after")) & F.col("target_before").eqNullSafe(F.col("target_after")))
    return met.select("file", F.when(whole, F.col("local_id")).otherwise(odd.cast("long")).alias("local_id"), "source_before", "source_after", "target_before", "target_after", differs.alias("changed"))


def restored(previews: DataFrame, chosen: DataFrame) -> DataFrame:
    """Previews in which the chosen units (file, local_id) have their original texts back; ``restored`` marks those that changed by it."""
    marks = chosen.select("file", "local_id").distinct().withColumn("_back", F.lit(True))
    back = F.coalesce(F.col("_back"), F.lit(False))
    made = previews.join(marks, ["file", "local_id"], "left")
    return made.select(
        "file", "local_id", "source_before", F.when(back, F.col("source_before")).otherwise(F.col("source_after")).alias("source_after"),
        "target_before", F.when(back, F.col("target_before")).otherwise(F.col("target_after")).alias("target_after"),
        (F.col("changed") & ~back).alias("changed"), (F.col("changed") & back).alias("restored"))
