"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot from this many rows on, and from 1/HOT_KEYS of all rows: so there are at most HOT_KEYS hot keys, whatever the size.
HOT_ROWS, HOT_KEYS, SALTS = 50_000, 1000, 64


def hot_keys(left: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """The keys of `left` that hold at least max(hot_rows, rows / HOT_KEYS) rows. Counted with map-side partial sums,
    so a hot group is never gathered; the sum of all counts comes from the same counts, in the same query. At most
    HOT_KEYS rows come out, which bounds the broadcast of the result."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = F.greatest(F.lit(HOT_ROWS if hot_rows is None else hot_rows).cast("bigint"), F.expr(f"_all div {HOT_KEYS}"))
    return counts.crossJoin(counts.agg(F.sum("_n").alias("_all"))).filter(F.col("_n") >= least).select(*keys)  # one row beside the counts


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, also: Column | None = None, hot: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """`left` join `right` on equal `keys` (and the condition `also`), how in inner, left, left_semi, left_anti.

    Rows of hot keys are spread over `salts` parts by a hash of the whole left row; only the right rows of those keys
    are repeated, once for each part. All other rows have salt 0. No row is dropped or joined twice. The key columns
    of the right side come out as `_r_<key>` in inner and left joins.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    mark = F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).withColumn("_hot", F.lit(True)))  # at most HOT_KEYS rows
    cols = left.columns
    same = lambda side: [F.col(f"{side}{k}") == F.col(f"_h_{k}") for k in keys]
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts)).cast("int")
    a = left.join(mark, same(""), "left").select(*cols, F.when(F.col("_hot"), spread).otherwise(F.lit(0)).alias("_salt"))
    b = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    rest = b.columns
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    b = b.join(mark, same("_r_"), "left").select(*rest, F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))).alias("_r_salt"))
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_salt") == F.col("_r_salt")] + ([also] if also is not None else [])
    out = a.join(b, on, how)
    return out.drop("_salt", "_r_salt")


def first_rows(df: DataFrame, keys: list[str], order: list, limit: int, place: str = "place", parts: int = 32) -> DataFrame:
    """The first `limit` rows of each key in a total order, with their place from 1. Ranks are taken within `parts` parts of
    each key first, then over the at most parts * limit rows that these leave: no task sorts all rows of a hot key."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    rank = lambda d, *more: d.withColumn(place, F.row_number().over(Window.partitionBy(*keys, *more).orderBy(*by))).filter(F.col(place) <= limit)
    spread = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(parts)))
    return rank(rank(spread, "_part").drop(place)).drop("_part")
