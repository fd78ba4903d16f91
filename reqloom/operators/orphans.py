"""Problem 4: references to records that do not exist.

Parents are range-partitioned by key and stored as sorted arrays, one row per range of at most ``chunk`` entries: key,
start of validity, and the latest end of validity among this and all earlier entries of the key. The starts of the
ranges (one per ``chunk`` parents) go to the driver. References find their range by binary search there; ranges with
many references are salted, their arrays repeated for each salt. A task then streams: the arrays of a range come first,
then its references in batches, probed by vectorised binary search. Misses are aggregated.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators.hierarchy import clean_id
from reqloom.operators.skew import find_hot, lookup_join
from reqloom.session import Scratch

CHUNK = 50_000
#: References of one range and salt.
PER_SALT = 200_000
FOREVER = 2**62


def _chunks(chunk: int):
    """Sorted (key, start, until) to rows (lo_key, lo_start, keys, starts, ends); the latest end is carried along."""
    schema = pa.schema([("lo_key", pa.string()), ("lo_start", pa.int64()), ("keys", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, ends, last, best = [], [], [], None, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"lo_key": keys[0], "lo_start": starts[0], "keys": keys, "starts": starts, "ends": ends}], schema=schema)

        for b in batches:
            for k, s, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                best = max(best, e) if k == last else e
                last = k
                if len(keys) >= chunk:
                    yield row()
                    keys, starts, ends = [], [], []
                keys.append(k)
                starts.append(s)
                ends.append(best)
        if keys:
            yield row()

    return run


def probe(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each (key, at) has an entry that holds: the last one of the key with start <= at, whose end is after at."""
    if not len(keys):
        return np.zeros(len(key), bool)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    uniq = keys[first]
    edge = np.append(first, len(keys))
    i = np.searchsorted(uniq, key)
    there = i < len(uniq)
    j = np.where(there, i, 0)
    there &= uniq[j] == key
    lo, hi = edge[j].copy(), edge[j + 1].copy()  # invariant: entries before lo start at or before ``at``
    begin = edge[j]
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        low = open_ & (starts[np.minimum(mid, len(starts) - 1)] <= at)
        lo = np.where(low, mid + 1, lo)
        hi = np.where(open_ & ~low, mid, hi)
    return there & (lo > begin) & (ends[np.maximum(lo - 1, 0)] > at)


def _misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, keys, starts, ends = None, np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        rng = np.asarray(b.column("rng"))
        kind = np.asarray(b.column("kind"))
        cut = [0, *(np.flatnonzero((rng[1:] != rng[:-1]) | (kind[1:] == 0) | (kind[:-1] == 0)) + 1).tolist(), len(rng)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi == lo:
                continue
            if kind[lo] == 0:
                got = [b.column(c)[lo].as_py() for c in ("keys", "starts", "ends")]
                at, keys, starts, ends = rng[lo], np.array(got[0], object), np.array(got[1], np.int64), np.array(got[2], np.int64)
                continue
            part = b.slice(lo, hi - lo)
            if at != rng[lo]:
                held = np.zeros(hi - lo, bool)
            else:
                held = probe(keys, starts, ends, np.array(part.column("key").to_pylist(), object), np.asarray(part.column("at")))
            out = part.filter(pa.array(~held)).select(["ref_id", "ref_field", "key", "at"])
            if out.num_rows:
                yield out


def micros(c: Column) -> Column:
    return F.unix_micros(c)


def orphan_references(references: DataFrame, parents: DataFrame, chunk: int = CHUNK, per_salt: int = PER_SALT) -> DataFrame:
    """Rows (ref_id, ref_field, key, at) of ``references`` (those columns) without a parent that holds at that time.

    ``parents``: (key, start, until) in microseconds, ``until`` null for ever. Null keys and times are no reference and
    no parent; repeated parents count once; without parents every reference is an orphan.
    """
    spark = references.sparkSession
    scratch = Scratch(spark, "orphans")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = parents.filter("key IS NOT NULL AND start IS NOT NULL").select("key", "start", F.coalesce("until", F.lit(FOREVER)).alias("until")).distinct()
    ranged = p.repartitionByRange(parts, "key").sortWithinPartitions("key", "start", "until")
    arrays = scratch.put(ranged.mapInArrow(_chunks(chunk), "lo_key string, lo_start long, keys array<string>, starts array<long>, ends array<long>"), "ranges")
    # one row per range: the number of parents divided by ``chunk``
    bounds = sorted((r.lo_key, r.lo_start) for r in arrays.select("lo_key", "lo_start").collect())

    @F.pandas_udf("int")
    def range_of(key: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) - 1 for x in zip(key, at, strict=True)], dtype="int32")

    refs = references.filter("key IS NOT NULL AND at IS NOT NULL").select("ref_id", "ref_field", "key", "at")
    refs = scratch.put(refs.withColumn("rng", range_of("key", "at")), "refs")
    salts = {r.rng: -(-r["count"] // per_salt) for r in refs.groupBy("rng").count().collect()}  # one row per range

    @F.pandas_udf("int")
    def salt_of(rng: pd.Series, h: pd.Series) -> pd.Series:
        return (h % rng.map(salts)).astype("int32")

    @F.pandas_udf("array<int>")
    def all_salts(rng: pd.Series) -> pd.Series:
        return rng.map(lambda r: list(range(salts.get(r, 0))))

    none = F.lit(None)
    side = arrays.withColumn("rng", range_of("lo_key", "lo_start")).withColumn("salt", F.explode(all_salts("rng")))
    side = side.select("rng", "salt", F.lit(0).alias("kind"), none.cast("long").alias("ref_id"), none.cast("string").alias("ref_field"), none.cast("string").alias("key"), none.cast("long").alias("at"), "keys", "starts", "ends")
    asked = refs.withColumn("salt", salt_of("rng", F.pmod(F.xxhash64("ref_id", "ref_field"), F.lit(2**31 - 1))))
    asked = asked.select("rng", "salt", F.lit(1).alias("kind"), "ref_id", "ref_field", "key", "at", none.cast("array<string>").alias("keys"), none.cast("array<bigint>").alias("starts"), none.cast("array<bigint>").alias("ends"))
    both = side.unionByName(asked).repartition(parts, "rng", "salt").sortWithinPartitions("rng", "salt", "kind")
    return both.mapInArrow(_misses, "ref_id long, ref_field string, key string, at long")


def relation_references(relations: DataFrame) -> DataFrame:
    """(ref_id, ref_field, key, at): both ends of every relation; null and blank ends are no reference."""
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), clean_id(F.col(f)).alias("key")) for f in ("source_id", "target_id")))).alias("r")
    return relations.select(F.col("ord").alias("ref_id"), one, micros(F.col("loaded_at")).alias("at")).select("ref_id", "r.ref_field", "r.key", "at").filter("key IS NOT NULL")


def element_validity(elements: DataFrame) -> DataFrame:
    """(key, start, until) of model elements."""
    return elements.select(clean_id(F.col("xmi_id")).alias("key"), micros(F.col("loaded_at")).alias("start"), micros(F.col("deleted_at")).alias("until"))


def orphan_report(references: DataFrame, parents: DataFrame, **sizes: int) -> DataFrame:
    """(ref_field, month, reason, n_references, n_keys): misses by field and month of the reference.

    ``reason``: "never exported" (no parent row has the key), "loaded later" (all of them start after the reference) or
    "deleted" (one was there before, none holds any more).
    """
    scratch = Scratch(references.sparkSession, "orphan-report")
    miss = scratch.put(orphan_references(references, parents, **sizes).withColumn("month", F.date_format(F.timestamp_micros("at"), "yyyy-MM")), "misses")
    first = parents.filter("key IS NOT NULL AND start IS NOT NULL").groupBy("key").agg(F.min("start").alias("first"))
    hot = find_hot(scratch, miss.groupBy("key").count(), "key", miss.count())
    known = lookup_join(miss, first, "key", hot, "left")
    reason = F.when(F.col("first").isNull(), "never exported").when(F.col("first") > F.col("at"), "loaded later").otherwise("deleted")
    per_key = known.groupBy("ref_field", "month", reason.alias("reason"), "key").count()
    return per_key.groupBy("ref_field", "month", "reason").agg(F.sum("count").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))
