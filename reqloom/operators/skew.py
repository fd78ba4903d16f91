"""Joins and aggregations that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.session import Scratch

#: At most this many keys can hold 1/HOT_LIMIT of the rows each, so a table of hot keys never has more rows.
HOT_LIMIT = 1000


def find_hot(scratch: Scratch, counts: DataFrame, key: str, total: int, limit: int = HOT_LIMIT, floor: int = 2000) -> DataFrame | None:
    """Keys with at least ``total / limit`` rows (and ``floor``) of a table (key, count): at most ``limit``; None if none."""
    if total < floor:
        return None
    hot = scratch.put(counts.filter(F.col("count") >= max(total / limit, floor)).select(key).coalesce(1), "hot")
    return None if hot.isEmpty() else hot


def hot_part(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The rows of hot keys (``hot`` as found by ``find_hot``; not None)."""
    h = hot.select(F.col(hot.columns[0]).alias("_hk"))
    return rows.join(F.broadcast(h), F.col(key) == F.col("_hk"), "left_semi")


def cold_part(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """All other rows, those with a null key among them."""
    if hot is None:
        return rows
    h = hot.select(F.col(hot.columns[0]).alias("_hk"))
    return rows.join(F.broadcast(h), F.col(key) == F.col("_hk"), "left_anti")


def lookup_join(rows: DataFrame, dim: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``dim`` (at most one row per key).

    Rows of hot keys (``hot``: a table of at most HOT_LIMIT keys, as found by ``find_hot``) meet a broadcast of the few
    matching rows of ``dim``; all other rows are shuffled by key. Null keys match nothing.
    """
    cold = cold_part(rows, key, hot).join(dim, key, how)
    if hot is None:
        return cold
    return hot_part(rows, key, hot).join(F.broadcast(hot_part(dim, key, hot)), key, how).unionByName(cold)


def salted(df: DataFrame, by: list[str], salts: int, aggs: list[Column], merge: list[Column], on: Column) -> DataFrame:
    """Two-level aggregation: first by key and a salt drawn from ``on``, then by key."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(on), F.lit(salts))).groupBy(*by, "_salt").agg(*aggs)
    return part.groupBy(*by).agg(*merge)
