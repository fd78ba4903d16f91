"""Problem 6: filling containers of fixed capacity, by bin completion.

Texts larger than a container are divided at multiples of its capacity: full pieces are containers of their own, the
last piece is an item like any other; nothing else is divided. Items are drawn by hash into groups of bounded size,
and each group is packed on its own:

* A best-fit solution is the first incumbent. If it needs no more containers than the sum of sizes demands, it is best.
* Else a branch-and-bound search completes one container at a time: around the largest item left it enumerates the
  fillings that no other filling dominates, those that leave least space first, and gives up a branch when the space
  wasted so far leaves no room for fewer containers than the incumbent.

The search has one bound, ``steps``: items put into or taken out of a container in a group. When they are used up the
incumbent stands, so every item is packed in any case; with ``steps`` None the search is exhaustive and the result is
the least number of containers of the group.

Containers that are left emptier than ``refill`` are emptied, their items drawn into new groups and packed again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.llm.tokens import n_tokens
from reqloom.session import Scratch

#: Items of a group, about.
GROUP = 4000
STEPS = 40_000
REFILL = 0.97


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` by container: largest first, each where it leaves the least space."""
    space: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(space, (sizes[i], -1))
        if at == len(space):
            bins.append([i])
            b, left = len(bins) - 1, capacity - sizes[i]
        else:
            left, b = space.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        insort(space, (left, b))
    return bins


class _Spent(Exception):
    """The steps of a search are used up."""


class _Search:
    """Bin completion over a multiset of sizes. Items in a container are taken out of ``count`` while it is open."""

    def __init__(self, sizes: list[int], capacity: int, steps: int | None):
        self.sizes = sorted(set(sizes), reverse=True)
        self.up = [-s for s in self.sizes]  # ascending, for bisection
        place = {s: i for i, s in enumerate(self.sizes)}
        self.count = [0] * len(self.sizes)
        for s in sizes:
            self.count[place[s]] += 1
        self.there = sum(1 << s for s in self.sizes)  # bit s: an item of size s is left
        self.capacity, self.steps = capacity, inf if steps is None else steps

    def take(self, i: int) -> None:
        self.steps -= 1
        if self.steps < 0:
            raise _Spent
        self.count[i] -= 1
        if not self.count[i]:
            self.there &= ~(1 << self.sizes[i])

    def give(self, i: int) -> None:
        if not self.count[i]:
            self.there |= 1 << self.sizes[i]
        self.count[i] += 1

    def next_fit(self, i: int, room: int) -> int:
        """The first size from place ``i`` on that is left and fits; the number of sizes for none."""
        fits = self.there & ((1 << (min(room, self.sizes[i] if i < len(self.sizes) else 0) + 1)) - 1)
        return bisect_left(self.up, 1 - fits.bit_length()) if fits else len(self.sizes)

    def dominated(self, chosen: list[int], room: int) -> bool:
        """Whether some of the chosen items could give way to one larger item that is left and still fits."""
        sums = 1
        for i in chosen:
            sums |= sums << self.sizes[i]
        larger, reach = (sums & ~1) << 1, 1  # what is more than such a sum by up to ``reach``
        while reach < room:
            d = min(reach, room - reach)
            larger |= larger << d
            reach += d
        return bool(larger & self.there)

    def fillings(self, room: int, least: int, most: int) -> Iterator[tuple[int, list[int]]]:
        """(space left, places of sizes) of undominated fillings of ``room`` that leave ``least`` to ``most``.

        While one is looked at its items are taken; going on gives back what the next one does not share.
        """
        chosen: list[int] = []
        i = 0
        while True:
            j = self.next_fit(i, room) if i < len(self.sizes) else len(self.sizes)
            if j < len(self.sizes):
                self.take(j)
                chosen.append(j)
                room -= self.sizes[j]
                i = j
                continue
            full = not self.there & ((1 << (room + 1)) - 1)
            if least <= room <= most and full and not (room and self.dominated(chosen, room)):
                yield room, chosen
            if not chosen:
                return
            last = chosen.pop()
            self.give(last)
            room += self.sizes[last]
            i = last + 1  # the same size again is the same choice

    def completions(self, slack: int) -> Iterator[tuple[int, list[int]]]:
        """Fillings around the largest item left, which stays taken; bands of growing space up to ``slack``."""
        largest = bisect_left(self.up, 1 - self.there.bit_length())
        self.take(largest)
        least, most = 0, 0
        while least <= slack:
            for left, chosen in self.fillings(self.capacity - self.sizes[largest], least, min(most, slack)):
                yield left, [largest, *chosen]
            least, most = most + 1, 2 * most + 2
        self.give(largest)

    def solve(self, n_bins: int) -> list[list[int]] | None:
        """Containers as lists of sizes, at most ``n_bins``; None if there is no such packing."""
        slack = n_bins * self.capacity - sum(s * c for s, c in zip(self.sizes, self.count, strict=True))
        if slack < 0:
            return None
        if not self.there:
            return []
        open_ = [(slack, self.completions(slack))]
        bins: list[list[int]] = []
        while open_:
            slack, options = open_[-1]
            del bins[len(open_) - 1 :]
            got = next(options, None)
            if got is None:
                open_.pop()
                continue
            left, chosen = got
            bins.append([self.sizes[i] for i in chosen])
            if not self.there:
                return bins
            open_.append((slack - left, self.completions(slack - left)))
        return None


def pack(sizes: list[int], capacity: int, steps: int | None = STEPS) -> list[list[int]]:
    """Positions of ``sizes`` (each between 1 and ``capacity``) by container."""
    best = best_fit(sizes, capacity)
    least = -(-sum(sizes) // capacity)
    left = steps
    while len(best) > least and left != 0:
        search = _Search(sizes, capacity, left)
        try:
            found = search.solve(len(best) - 1)
        except _Spent:
            break
        if found is None:
            break
        where: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):
            where.setdefault(s, []).append(i)
        best = [[where[s].pop() for s in b] for b in found]
        left = None if steps is None else max(0, int(search.steps))
    return best


def _pack_groups(steps: int | None):
    """Arrow kernel over rows (pack_name, capacity, grp, doc_id, piece, first_token, size), sorted by pack and group.

    A group is held until the next one begins; its rows stay columns, only sizes become numbers for the search.
    """

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = rows.column("size").to_numpy().tolist()
        capacity = rows.column("capacity")[0].as_py()
        bins = pack(sizes, capacity, steps)
        number = np.empty(len(sizes), np.int32)
        for b, members in enumerate(bins):
            number[members] = b
        fill = np.bincount(number, sizes, len(bins)) / capacity
        out = rows.append_column("bin", pa.array(number)).append_column("fill", pa.array(fill[number]))
        return out.select([c.split()[0] for c in _PACKED.split(", ")]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i) for i in range(3)]
            grp = np.asarray(keys[2])
            name = np.asarray(keys[0].dictionary_encode().indices.to_numpy(zero_copy_only=False))
            cut = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (name[1:] != name[:-1])) + 1).tolist(), len(grp)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                key = tuple(k[lo].as_py() for k in keys)
                if key != at and held:
                    yield solve(held)
                    held = []
                at = key
                held.append(b.slice(lo, hi - lo))
        if held:
            yield solve(held)

    return run


_PACKED = "pack_name string, capacity long, grp long, bin int, fill double, doc_id long, piece long, first_token long, size long"


def _packed(items: DataFrame, n: int, group: int, steps: int | None, seed: int) -> DataFrame:
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // group))
    drawn = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), F.lit(groups)))
    drawn = drawn.select("pack_name", "capacity", "grp", "doc_id", "piece", "first_token", "size")
    # groups cost about the same, as each has as many steps
    spread = drawn.repartition(max(parts, min(3 * groups, 8 * parts)), "pack_name", "grp").sortWithinPartitions("pack_name", "capacity", "grp", F.desc("size"), "doc_id", "piece")
    return spread.mapInArrow(_pack_groups(steps), _PACKED)


def sized(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, size) of documents (doc_id, text); texts without a token are left out."""
    return documents.select("doc_id", n_tokens(F.col("text"), ranks).alias("size")).filter("size > 0")


def fill_containers(sizes: DataFrame, packs: DataFrame, group: int = GROUP, steps: int | None = STEPS, refill: float = REFILL) -> DataFrame:
    """(pack_name, capacity, bin_id, doc_id, piece, first_token, n_tokens): every token of every document in a container
    of each capacity.

    ``sizes`` (doc_id unique, size), ``packs`` (pack_name, capacity: a handful of rows, broadcast). Documents without a
    size or of size 0 need no container; capacities that are null or not positive are left out.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = scratch.put(sizes.filter("size > 0").select("doc_id", F.col("size").cast("long").alias("size")).repartition(parts), "sizes")
    n = docs.count()
    wanted = packs.filter("capacity > 0").select("pack_name", F.col("capacity").cast("long").alias("capacity")).distinct().collect()
    each = F.explode(F.array(*(F.struct(F.lit(p.pack_name).alias("pack_name"), F.lit(p.capacity).cast("long").alias("capacity")) for p in wanted)))
    if not wanted:
        return docs.select(F.lit("").alias("pack_name"), F.lit(0).cast("long").alias("capacity"), F.lit("").alias("bin_id"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first_token"), F.col("size").alias("n_tokens")).limit(0)
    by_pack = docs.select("doc_id", "size", each.alias("p")).select("doc_id", "size", "p.pack_name", "p.capacity")
    last: Column = F.floor((F.col("size") - 1) / F.col("capacity"))
    pieces = by_pack.select("pack_name", "capacity", "doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * F.col("capacity")
    pieces = pieces.select("pack_name", "capacity", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity"), F.col("size") - first).alias("size"))
    full = pieces.filter("size = capacity").select("pack_name", "capacity", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", "first_token", F.col("size").alias("n_tokens"))
    once = scratch.put(_packed(pieces.filter("size < capacity"), n, group, steps, 1), "once")
    loose = once.filter(F.col("fill") < refill)
    again = scratch.put(_packed(loose, max(1, loose.count() // max(1, len(wanted))), group, steps, 2), "again")

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select("pack_name", "capacity", F.concat_ws("-", F.lit(tag), "grp", "bin").alias("bin_id"), "doc_id", "piece", "first_token", F.col("size").alias("n_tokens"))

    return full.unionByName(named(once.filter(F.col("fill") >= refill), "a")).unionByName(named(again, "b"))


def fill_report(packed: DataFrame) -> DataFrame:
    """(pack_name, capacity, n_bins, n_least, n_documents, n_divided, n_tokens, fill) per capacity."""
    by_doc = packed.groupBy("pack_name", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n_tokens"))
    docs = by_doc.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("n_documents"), F.sum((F.col("pieces") > 1).cast("long")).alias("n_divided"), F.sum("n_tokens").alias("n_tokens"))
    bins = packed.groupBy("pack_name", "bin_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_bins"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    fill = F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))
    return docs.join(bins, "pack_name").select("pack_name", "capacity", "n_bins", least.alias("n_least"), "n_documents", "n_divided", "n_tokens", fill.alias("fill"))
