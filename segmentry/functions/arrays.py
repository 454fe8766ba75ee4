"""Multisets as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value found once for a row, however often the body, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are found once for a row: no filter above is pushed below them with their expressions in it."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    return rows.select(*[f"`{c}`" for c in rows.columns if c not in columns], one).select("*", "_settled.*").drop("_settled")


def same_multiset(a: Column, b: Column) -> Column:
    return F.sort_array(a) == F.sort_array(b)


def numbered(a: Column) -> Column:
    """Structs (value, how often it came before): a multiset as a set."""
    return F.transform(a, lambda x, i: F.struct(x.alias("v"), F.size(F.filter(F.slice(a, 1, i), lambda y: y == x)).alias("n")))


def more_of(a: Column, b: Column) -> Column:
    """The multiset a without b, in the order of a."""
    return F.transform(F.array_except(numbered(a), numbered(b)), lambda x: x["v"])


def only_in(a: Column, b: Column) -> Column:
    """The values of a that b has not, sorted."""
    return F.array_sort(F.array_except(a, b))


def first_raw(raw: Column, values: Column, others: Column) -> Column:
    """The raw tokens (parallel to values) of the values that exceed ``others``, the first ones of each value."""
    extra = F.sort_array(more_of(values, others))
    count = lambda a, v: F.size(F.filter(a, lambda y: y == v))
    kept = F.filter(
        F.transform(raw, lambda r, i: F.struct(r.alias("r"), F.get(values, i).alias("v"), i.alias("i"))),
        lambda t: F.size(F.filter(F.slice(values, 1, t["i"]), lambda y: y == t["v"])) < count(extra, t["v"]))
    return F.transform(kept, lambda t: t["r"])
