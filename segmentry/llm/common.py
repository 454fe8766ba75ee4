"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.durable import durable


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key is hot if it holds more than a thousandth of all rows, and this many; its rows are dealt out to so many shares.
LEAST_HOT, SHARES = 1000, 64


def join_uneven(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key, where some keys may hold very many rows.

    ``counts`` has each key's number of rows as ``n``. The rows of hot keys are dealt out in turn and the table's row goes
    to each share; at most a thousand keys are hot, so their list is small for any input. ``total``: the number of rows, if known.
    """
    total = (counts.agg(F.sum("n")).first()[0] or 0) if total is None else total
    taken = {c.lower() for c in rows.columns + table.columns}
    is_hot, share = ("_hot", "_share") if not taken & {"_hot", "_share"} else (f"_hot_{len(''.join(taken))}", f"_share_{len(''.join(taken))}")
    hot = F.broadcast(counts.where(F.col("n") > max(LEAST_HOT, total // 1000)).select(key, F.lit(True).alias(is_hot)))
    dealt = rows.join(hot, key, "left").withColumn(share, F.when(F.col(is_hot), F.pmod(F.monotonically_increasing_id(), F.lit(SHARES))).otherwise(F.lit(0)).cast("int")).drop(is_hot)
    sent = table.join(hot, key, "left").withColumn(share, F.explode(F.when(F.col(is_hot), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0))))).drop(is_hot)
    return dealt.join(sent, [key, share], how).drop(share)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What this Python process keeps for later tasks of one operator. Tasks of others drop it: ``release``."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what is kept, and give the memory that this process has freed back to the machine: workers live through many stages."""
    _KEPT.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Arrow's pool and the C library hold on to freed memory unless asked."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def with_arrow(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: Sequence[T.StructField],
    start: Callable[[], Callable[..., list]],
    keep: Sequence[str] | None = None,
    keeps: bool = False,
) -> DataFrame:
    """Add columns computed from Arrow arrays of ``inputs``, batch by batch.

    ``start()`` is called once in each task and returns the function of the input arrays. Columns named in ``keep`` (all
    by default) pass through; an existing column with the name of an output is replaced. ``keeps``: the function uses ``kept``.
    """
    new = {f.name for f in outputs}
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    sent = list(dict.fromkeys([f.name for f in kept] + list(inputs)))
    schema = T.StructType(kept + list(outputs))
    arrow = to_arrow_schema(schema)
    kept_names, in_names = [f.name for f in kept], list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        if keeps:
            give_back()
        else:
            release()
        for batch in batches:
            if not batch.num_rows:
                continue
            function = function or start()
            made = function(*(batch.column(n) for n in in_names))
            arrays = [batch.column(n) for n in kept_names] + list(made)
            cast = [a if a.type == f.type else pa.array(a, type=f.type) if not isinstance(a, pa.Array) else a.cast(f.type) for a, f in zip(
                (a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, arrow)), arrow)]
            yield pa.RecordBatch.from_arrays(cast, names=arrow.names)

    return df.select(*[f"`{n}`" for n in sent]).mapInArrow(run, schema)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Working names that no column of ``df`` has (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty string."""
    return [t or "" for t in column.to_pylist()]
