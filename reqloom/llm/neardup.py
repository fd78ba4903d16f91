"""Problem 3: near-duplicates by Jaccard similarity of word sets, exactly, by vertical partitioning.

Records with the same word set are one class. The global order of words, rare to common, is cut into fragments, and a
class into one segment for each fragment: a row (frag, cls, n, words), stored and joined by fragment.

* Seeds. The first common words of a pair come after few words that only one of the two has. Each class emits the
  sequences of words that can be the first common ones of some pair, each as long as it takes for few classes to have
  it (by estimate ``WIDE`` times ``spread``), with all its words as codes of one or two bytes. In the task that gets a
  seed's classes, sequences go on by codes where classes go the same way, until at most ``spread`` are left to compare;
  lengths, bitmaps and common codes must allow the overlap that two lengths demand. No candidate is dropped for being
  frequent: the classes of seeds that very many have are cut into parts, and all parts meet. Seeds that would take much
  more disk than the input come in several passes.
* Partial overlaps. Candidates meet the segments of each fragment in that fragment's rows and give one partial count
  for each fragment, one fragment after the other; the partial counts are summed per pair and compared with what the
  lengths demand.

Shuffle files go as soon as what is made of them is written, as disk is what runs out first.

No join here is left to automatic broadcasting, as the sizes of tables that Python makes are not known beforehand.

The words whose frequencies are known to the tasks are those with at least 1/200,000 of all occurrences, so at most
200,000; rarer ones count as if they had that share, which only makes seeds longer than they need be.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.llm.grouping import components
from reqloom.operators.skew import find_hot, lookup_join
from reqloom.session import Scratch

THRESHOLD = Fraction(7, 10)
MIN_WORDS = 8
SPREAD = 150
KNOWN = 200_000
FRAGMENTS = 3
#: Words in less than this share of the classes make the first fragment.
RARE = 0.01

#: A seed goes on until an estimated ``spread`` times this many classes have it; in a task, until ``spread`` have it.
WIDE = 500
#: Bytes of seeds on disk at a time, about, for each word of a class; beyond it they come in several passes.
PASS_BYTES = 20
#: So many of the commonest words have codes of one byte.
SHORT = 256

#: A seed with this part of all seeds (and at least HOT_ROWS) is salted, so at most 1/HOT_SHARE of them are.
HOT_SHARE = 1 / 10_000
HOT_ROWS = 100_000
#: Hot seeds are looked for among the classes of one in so many hashes; it changes where rows go, never which there are.
HOT_SAMPLE = 8
#: Most parts of the classes of one seed.
SALTS = 64
#: Records of one chunk of a class, about, when classes are written out as pairs of records.
CHUNK = 1000

_WORDS = 50_000
_ROWS = 100_000
_BLOCK = 50_000
_BYTES = 32_000_000
_STATES = 500_000
_PAIRS = 1_000_000
#: Comparisons of all longer sequences together, for one of the sequence itself, from which on it is not made longer.
_GAIN = 3
_CODES = SHORT + 2**16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _put(scratch: Scratch, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes a table of ``scratch`` and removes the shuffle files that it took; else they stay until the driver's garbage goes."""
    conf = scratch.spark.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return scratch.put(df, name, by)
    finally:
        conf.set(_CLEANUP, before)


def word_sets(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rec, key, words) of records (rec, text) with enough distinct runs of a-z and 0-9; words sorted."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))
    sets = records.select("rec", words.alias("words")).filter(F.size("words") >= min_words)
    return sets.select("rec", F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("key"), "words")


def need(n, m, t: Fraction):
    """Words that sets of n and m words must share to be similar enough; for numbers or columns."""
    num, both = t.numerator, t.numerator + t.denominator
    if isinstance(n, (int, np.ndarray)):
        return -(-num * (n + m) // both)
    return F.floor(((n + m) * num + (both - 1)) / both).cast("int")


class _Order:
    """The global order of words and its fragments. ``known``: sorted hashes of frequent words, ``share``: of classes."""

    def __init__(self, known: np.ndarray, share: np.ndarray, floor: float):
        self.known, self.floor = known, floor
        common = np.argsort(-share, kind="stable")
        #: place of each known word from the commonest on, and the shares by place; unknown words have the last
        self.place = np.empty(len(known), np.int64)
        self.place[common] = np.arange(len(known))
        self.by_place = np.append(share[common], floor)
        ranked = np.sort(share[share >= RARE])
        mass = np.cumsum(ranked)
        half = ranked[np.searchsorted(mass, mass[-1] / 2)] if len(ranked) else 1.0
        self.cuts = np.array([RARE, half])

    def places(self, words: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.place[at], len(self.known))

    def fragments(self, shares: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, shares, side="right")

    def sorted(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(size, rec, words, places) of a batch (cls, hashes), each class's words in global order."""
        size = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
        words = np.asarray(batch.column(1).flatten())
        rec = np.repeat(np.arange(len(size)), size)
        places = self.places(words)
        by = np.lexsort((words, -places, rec))
        return size, rec, words[by], places[by]

    def codes(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Numbers below SHORT for the commonest words, other numbers of 16 bits (beyond SHORT) for the rest; not unique."""
        rest = np.where(places < len(self.known), places - SHORT, _mix(words.view(np.uint64), np.uint64(2)).view(np.int64)) & 0xFFFF
        return np.where(places < min(SHORT, len(self.known)), places, SHORT + rest)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (cls, hashes) of about as many words each, so that one of very long texts holds few."""
    for b in batches:
        if b.num_rows:
            part = np.cumsum(np.asarray(b.column(1).value_lengths()).astype(np.int64)) // _WORDS
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                yield b.slice(lo, hi - lo)


def _segments(order: _Order):
    """Arrow kernel: (cls, hashes) to one row (frag, cls, n, words) for each fragment in which a class has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            size, rec, words, places = order.sorted(b)
            cls = np.asarray(b.column(0))
            cell = rec * FRAGMENTS + order.fragments(order.by_place[places])
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            at = cell[starts] // FRAGMENTS
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(words)], pa.int32()), pa.array(words))
            cols = [pa.array(cell[starts] % FRAGMENTS, pa.int32()), pa.array(cls[at]), pa.array(size[at], pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["frag", "cls", "n", "words"])

    return run


class _Salts:
    """Hot seeds (sorted) and the parts that the classes of each are cut into."""

    def __init__(self, seeds: np.ndarray, salts: np.ndarray):
        by = np.argsort(seeds)
        self.seeds, self.salts = seeds[by], salts[by]

    def of(self, seeds: np.ndarray) -> np.ndarray:
        if not len(self.seeds):
            return np.ones(len(seeds), np.int64)
        at = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
        return np.where(self.seeds[at] == seeds, self.salts[at], 1)


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _depth(t: Fraction, min_words: int) -> int:
    """Most words of a sequence: as many as any pair must share, as far as ``state`` has room."""
    return min(-(-t.numerator * min_words // t.denominator), 2047)


def _slacks(size: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Words that a class may skip: as the shorter one of a pair, and as the longer one."""
    return size - need(size, size, t), size - -(-t.numerator * size // t.denominator)


def _steps(i: np.ndarray, skip: np.ndarray, size: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences that have come to word ``i``: the one that each longer one is of, and the words it skips more."""
    ways = np.maximum(np.minimum(size - i, slack - skip + 1), 0)
    src = np.repeat(np.arange(len(i)), ways)
    return src, np.arange(len(src)) - np.repeat(np.cumsum(ways) - ways, ways)


def _packed(size: np.ndarray, codes: np.ndarray) -> pa.Array:
    """The codes of each class as bytes: two for those beyond SHORT, which come first, one for the others."""
    two = codes >= SHORT
    end = np.cumsum(1 + two)
    data = np.empty(end[-1] if len(end) else 0, np.uint8)
    data[end - 1] = np.where(two, (codes - SHORT) >> 8, codes)
    data[end[two] - 2] = (codes[two] - SHORT) & 255
    starts = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(size)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(starts), pa.py_buffer(data)])


def _unpacked(packed: pa.Array, size: np.ndarray) -> np.ndarray:
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)
    starts = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    two = np.repeat(np.diff(starts) - size, size)
    j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(starts[:-1], size) + j + np.minimum(j, two)
    codes = data[at].astype(np.int64)
    long_ = j < two
    codes[long_] += SHORT + (data[at[long_] + 1].astype(np.int64) << 8)
    return codes


_SEED = "sig long, cls long, state long, words binary"


def _seeds(order: _Order, total: int, t: Fraction, min_words: int, spread: float, hot: _Salts | None = None, turn: tuple[int, int] = (0, 1)):
    """Arrow kernel: (cls, hashes) to seeds (``_SEED``). ``state``: the class's words, those before the seed's end, those
    of the seed, and whether the row stands for the shorter (1) or the longer side (2) of pairs, or both (3).

    ``turn``: of so many passes, the one whose seeds are given (by their first word).
    Hot seeds: the classes are cut into parts, and each part as the shorter side meets each as the longer one.
    """
    depth = _depth(t, min_words)
    stop = np.log(WIDE * spread / max(total, 1))

    def spread_out(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Salted seeds, the row each is of, and its sides."""
        salts = hot.of(sig.view(np.int64)) if hot else np.ones(len(sig), np.int64)
        times = 2 * salts - 1
        rows = np.repeat(np.arange(len(sig)), times)
        k, r = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times), salts[rows]
        own = (_mix(cls[rows].view(np.uint64), np.uint64(1)) % r.astype(np.uint64)).astype(np.int64)
        other = (own + np.where(k < r, k, k - r + 1)) % r  # the part that it meets: itself first
        cell = np.where(k < r, own * r + other, other * r + own).astype(np.uint64)
        return np.where(r > 1, _mix(sig[rows], cell + np.uint64(1)), sig[rows]), rows, np.where(k == 0, 3, np.where(k < r, 1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            size, rec, words, places = order.sorted(b)
            cls = np.asarray(b.column(0))
            off = np.concatenate(([0], np.cumsum(size)))
            mixed = words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            packed = _packed(size, order.codes(words, places))
            logf = np.log(order.by_place[places])
            less, slack = _slacks(size, t)
            r = np.arange(len(size))
            i, skip, p, h = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64), np.zeros(len(r)), np.zeros(len(r), np.uint64)
            for k in range(1, depth + 1):
                src, step = _steps(i, skip, size[r], slack[r])
                r, j, skip = r[src], i[src] + step, skip[src] + step
                w = off[r] + j
                p = p[src] + logf[w]
                h = _mix(h[src], mixed[w])
                if k == 1 and turn[1] > 1:
                    mine = np.flatnonzero((h >> np.uint64(32)) % np.uint64(turn[1]) == turn[0])
                    r, j, skip, p, h = r[mine], j[mine], skip[mine], p[mine], h[mine]
                done = (p <= stop) | (k == depth)
                d = np.flatnonzero(done)
                for lo in range(0, len(d), _ROWS):
                    e = d[lo : lo + _ROWS]
                    sig, rows, side = spread_out(h[e], cls[r[e]])
                    e = e[rows]
                    side = np.where(skip[e] <= less[r[e]], side, side & 2)
                    sig, e, side = sig[side > 0], e[side > 0], side[side > 0]
                    state = ((size[r[e]] << 24 | j[e] + 1) << 11 | k) << 2 | side
                    part = np.cumsum(2 * size[r[e]]) // _BYTES
                    cuts = np.flatnonzero(np.diff(part, prepend=-1))
                    for a, z in zip(cuts, [*cuts[1:], len(e)], strict=True):
                        at = r[e[a:z]]
                        cols = [pa.array(sig[a:z].view(np.int64)), pa.array(cls[at]), pa.array(state[a:z]), packed.take(pa.array(at))]
                        yield pa.RecordBatch.from_arrays(cols, names=["sig", "cls", "state", "words"])
                go = np.flatnonzero(~done)
                if not len(go):
                    break
                r, i, skip, p, h = r[go], j[go] + 1, skip[go], p[go], h[go]

    return run


class _Meeting:
    """Rows of whole seeds (``_SEED``, sorted by seed), whose classes meet.

    Seeds of many classes go on word by word, by codes, as far as two classes go the same way, until few are left; these
    are compared two by two. Equal words have equal codes, so nothing is lost; unequal ones may have, so what is found
    may be too much.
    """

    def __init__(self, rows: pa.Table, t: Fraction, depth: int, few: float):
        self.t, self.depth, self.few = t, depth, few
        sig, cls, state = (rows.column(k).to_numpy() for k in range(3))
        self.cls, first, self.of = np.unique(cls, return_index=True, return_inverse=True)
        self.size = state[first] >> 37
        self.codes = _unpacked(rows.column(3).take(pa.array(first)).combine_chunks(), self.size)
        self.off = np.concatenate(([0], np.cumsum(self.size)))
        rec = np.repeat(np.arange(len(self.size)), self.size)
        mixed = self.codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.bits = np.zeros((len(self.size), 3), np.uint64)
        np.bitwise_or.at(self.bits, (rec, self.codes % 3), np.uint64(1) << (mixed >> np.uint64(58)))
        self.keys = np.sort(rec * _CODES + self.codes)
        self.less, self.slack = _slacks(self.size, t)
        i, k = state >> 13 & 0xFFFFFF, state >> 2 & 0x7FF
        self.first = self.of, i, i - k, k, state & 3, sig.view(np.uint64)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, shared) of classes."""
        stack = [self.first]
        while stack:
            r, i, skip, k, side, h = stack.pop()
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.diff(np.append(starts, len(h)))
            side = np.where(skip <= self.less[r], side, side & 2)
            live = (n > 1) & (np.add.reduceat(side & 1, starts) > 0) & (np.add.reduceat(side >> 1, starts) > 0)
            few = (n <= self.few) | (k[starts] >= self.depth)
            e = np.repeat(live & few, n)
            yield from self._compared(*(a[e] for a in (r, skip, side, h)))
            e = np.repeat(live & ~few, n)
            if not e.any():
                continue
            r, i, skip, k, side, h = (a[e] for a in (r, i, skip, k, side, h))
            part = np.cumsum(np.minimum(self.size[r] - i, self.slack[r] - skip + 1)) // _STATES
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            cuts = new[np.concatenate(([True], part[new[1:]] != part[new[:-1]]))]
            for lo, hi in zip(cuts, [*cuts[1:], len(h)], strict=True):
                src, step = _steps(i[lo:hi], skip[lo:hi], self.size[r[lo:hi]], self.slack[r[lo:hi]])
                src += lo
                j = i[src] + step
                g = _mix(h[src], self.codes[self.off[r[src]] + j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                by = np.argsort(g)
                src, j, step, g = src[by], j[by], step[by], g[by]
                # where all are much alike, longer sequences only bring the same classes together more often
                of = np.cumsum(np.concatenate(([0], h[lo + 1 : hi] != h[lo : hi - 1])))
                n = np.bincount(of)
                first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))[: len(g)]
                to = np.diff(np.append(first, len(g)))
                cost = np.bincount(of[src[first] - lo], np.where(to > 1, to.astype(float) ** 2, 0), len(n))
                alike = (cost >= _GAIN * n.astype(float) ** 2)[of]
                e = lo + np.flatnonzero(alike)
                yield from self._compared(r[e], skip[e], side[e], h[e])
                e = ~alike[src - lo]
                src, j, step, g = src[e], j[e], step[e], g[e]
                if len(src):
                    stack.append((r[src], j + 1, skip[src] + step, k[src] + 1, side[src], g))

    def _compared(self, r: np.ndarray, skip: np.ndarray, side: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(r):
            return
        g = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
        size = self.size[r]
        by = np.lexsort((self.cls[r], size, g))
        r, skip, side, g, size = r[by], skip[by], side[by], g[by], size[by]
        scale = int(self.size.max()) + 2
        end = np.searchsorted(g * scale + size, g * scale + np.minimum(size * self.t.denominator // self.t.numerator, scale - 2), side="right")
        a = np.flatnonzero(side & 1)
        n = end[a] - a - 1
        part = np.cumsum(n) // _PAIRS
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(a) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=True) if len(a) else ():
            x = np.repeat(a[lo:hi], n[lo:hi])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
            shared = need(size[x], size[y], self.t)
            ok = (side[y] > 1) & (r[x] != r[y]) & (skip[x] <= size[x] - shared) & (skip[y] <= size[y] - shared)
            x, y, shared = r[x[ok]], r[y[ok]], shared[ok]
            # differing bits are at most the words that only one of the two has
            apart = sum(np.bitwise_count(self.bits[x, k] ^ self.bits[y, k]).astype(np.int64) for k in range(3))
            ok = apart <= self.size[x] + self.size[y] - 2 * shared
            both, at = np.unique(x[ok] * len(self.size) + y[ok], return_index=True)
            x, y, shared = both // len(self.size), both % len(self.size), shared[ok][at]
            for k in range(0, len(x), _ROWS):
                yield self._overlapping(x[k : k + _ROWS], y[k : k + _ROWS], shared[k : k + _ROWS])

    def _overlapping(self, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.size[x]
        of = np.repeat(np.arange(len(x)), n)
        word = np.repeat(self.off[x] - np.cumsum(n) + n, n) + np.arange(len(of))
        key = y[of] * _CODES + self.codes[word]
        hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        ok = np.bincount(of[hit], minlength=len(x)) >= shared
        return self.cls[x[ok]], self.cls[y[ok]], shared[ok]


def _meet(t: Fraction, min_words: int, few: float):
    """Arrow kernel: seeds, sorted within a task, to candidates (x, y, shared); rows of a seed are taken together."""
    depth = _depth(t, min_words)

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            for x, y, shared in _Meeting(rows, t, depth, few).pairs():
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(shared, pa.int32())], names=["x", "y", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, size, most, heavy = [], 0, 0, _BLOCK, _BYTES
        for b in batches:
            kept.append(b)
            n += b.num_rows
            size += b.nbytes
            if n >= most or size >= heavy:
                rows = pa.Table.from_batches(kept)
                sig = rows.column(0).to_numpy()
                cut = int(np.searchsorted(sig, sig[-1]))
                yield from met(rows.slice(0, cut))
                kept, n = rows.slice(cut).to_batches(), len(sig) - cut
                size = sum(x.nbytes for x in kept)
                most, heavy = max(_BLOCK, 2 * n), max(_BYTES, 2 * size)  # a seed of very many classes isn't looked at again and again
        if kept:
            yield from met(pa.Table.from_batches(kept))

    return run


def _some(classes: DataFrame) -> DataFrame:
    """The classes of one in HOT_SAMPLE hashes."""
    return classes.filter(F.pmod(F.xxhash64("cls"), F.lit(HOT_SAMPLE)) == 0).select("cls", "hashes")


def _passes(classes: DataFrame, kernel) -> int:
    """Passes in which the seeds take about PASS_BYTES a word each; it changes when pairs are found, never which."""
    some = _some(classes)
    words = some.agg(F.sum(F.size("hashes"))).first()[0] or 0
    size = some.mapInArrow(kernel, _SEED).agg(F.sum(F.length("words") + 12)).first()[0] or 0
    return max(1, -(-size // max(1, PASS_BYTES * words)))


def _hot_seeds(classes: DataFrame, kernel) -> _Salts:
    """Seeds of very many classes, at most 1/HOT_SHARE of them."""
    counts = _some(classes).mapInArrow(kernel, _SEED).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(classes.sparkSession, "seeds")
    counts = _put(scratch, counts.filter("n > 1").select("sig", "n"), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(total * HOT_SHARE, HOT_ROWS / HOT_SAMPLE)
    hot = counts.filter(F.col("n") >= least).toPandas()
    scratch.drop(counts)
    seeds, n = hot["sig"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)
    return _Salts(seeds, np.clip(np.ceil(n / least).astype(np.int64) + 1, 2, SALTS))


def candidates(scratch: Scratch, classes: DataFrame, order: _Order, total: int, t: Fraction, min_words: int, spread: float) -> DataFrame:
    """(x, y, shared): pairs of classes that meet on a seed and whose codes allow ``shared`` common words; written."""
    kernel = _seeds(order, total, t, min_words, spread)
    hot, n = _hot_seeds(classes, kernel), _passes(classes, kernel)
    found = []
    for k in range(n):
        rows = classes.select("cls", "hashes").mapInArrow(_seeds(order, total, t, min_words, spread, hot, (k, n)), _SEED)
        met = rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(_meet(t, min_words, spread), "x long, y long, shared int")
        found.append(_put(scratch, met.distinct(), f"met-{k}"))
    if n == 1:
        return found[0]
    every = _put(scratch, reduce(DataFrame.unionByName, found).distinct(), "candidates")
    scratch.drop(*found)
    return every


def partial_overlaps(pairs: DataFrame, segments: DataFrame, frag: int) -> DataFrame:
    """(x, y, shared, part): the words that the two segments of a pair share in a fragment."""
    mine = segments.filter(F.col("frag") == frag)
    a = mine.select(F.col("cls").alias("x"), F.col("words").alias("a"))
    b = mine.select(F.col("cls").alias("y"), F.col("words").alias("b"))
    met = pairs.join(a.hint("merge"), "x").join(b.hint("merge"), "y")
    return met.select("x", "y", "shared", F.size(F.array_intersect("a", "b")).alias("part"))


def similar_classes(scratch: Scratch, classes: DataFrame, t: Fraction, min_words: int, spread: float) -> DataFrame:
    """(x, y): pairs of classes (cls, hashes; written) that are similar enough."""
    total = classes.count()
    df = classes.select(F.explode("hashes").alias("w")).groupBy("w").count()
    occurrences = classes.agg(F.sum(F.size("hashes"))).first()[0] or 0
    least = max(spread / 4, occurrences / KNOWN)
    frequent = df.filter(F.col("count") >= least).toPandas().sort_values("w")  # at most KNOWN rows
    order = _Order(frequent["w"].to_numpy(np.int64), frequent["count"].to_numpy(float) / max(total, 1), least / max(total, 1))
    met = candidates(scratch, classes, order, total, t, min_words, spread)
    rows = classes.select("cls", "hashes").mapInArrow(_segments(order), "frag int, cls long, n int, words array<bigint>")
    segments = _put(scratch, rows, "segments", by="frag")
    parts = [_put(scratch, partial_overlaps(met, segments, k), f"parts-{k}") for k in range(FRAGMENTS)]  # one fragment's join on disk at a time
    scratch.drop(segments, met)
    found = reduce(DataFrame.unionByName, parts).groupBy("x", "y").agg(F.sum("part").alias("overlap"), F.first("shared").alias("shared")).filter("overlap >= shared")
    found = _put(scratch, found.select("x", "y"), "pairs")
    scratch.drop(*parts)
    return found


def _prepare(records: DataFrame, t: Fraction, min_words: int, spread: float) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(records.sparkSession, "neardup")
    sets = word_sets(records, min_words).select("rec", "key", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    sets = _put(scratch, sets, "sets")
    groups = _put(scratch, sets.groupBy("key").agg(F.min("rec").alias("cls"), F.count(F.lit(1)).alias("count")), "classes")
    hot = find_hot(scratch, groups, "key", sets.count())
    members = _put(scratch, lookup_join(sets.select("rec", "key"), groups.select("key", "cls", "count"), "key", hot).select("rec", "cls", "count"), "members")
    heads = sets.join(groups.select(F.col("cls").alias("rec")).hint("merge"), "rec", "left_semi")
    classes = _put(scratch, heads.select(F.col("rec").alias("cls"), "hashes"), "words")
    scratch.drop(sets)
    pairs = similar_classes(scratch, classes, t, min_words, spread)
    scratch.drop(classes)
    return scratch, members, groups, pairs


def _n_chunks(count: Column) -> Column:
    return F.ceil(count / CHUNK).cast("int")


def near_pairs(records: DataFrame, t: Fraction = THRESHOLD, min_words: int = MIN_WORDS, spread: float = SPREAD) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: all pairs of records (rec unique, text) whose word sets are similar enough.

    Null texts and records with fewer than ``min_words`` words are left out; records with the same words are pairs
    like any other; an empty table gives an empty result; other columns are not read. The records of a class are kept
    in chunks of bounded size, and chunks meet chunks in tasks of their own, so a large class is never in one task.
    """
    scratch, members, groups, pairs = _prepare(records, t, min_words, spread)
    chunk = F.pmod(F.xxhash64("rec"), _n_chunks(F.col("count"))).cast("int")
    chunks = _put(scratch, members.groupBy("cls", chunk.alias("chunk")).agg(F.collect_list("rec").alias("recs"), F.first("count").alias("count")), "chunks")
    n = groups.select("cls", _n_chunks(F.col("count")).alias("n"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    def side(cls: str, recs: str) -> DataFrame:
        return chunks.select(F.col("cls").alias(cls), F.col("chunk").alias(f"chunk_{cls}"), F.col("recs").alias(recs)).hint("merge")

    cells = pairs.join(n.select(F.col("cls").alias("x"), F.col("n").alias("n_x")).hint("merge"), "x").join(n.select(F.col("cls").alias("y"), F.col("n").alias("n_y")).hint("merge"), "y")
    cells = cells.withColumn("chunk_x", every("n_x")).withColumn("chunk_y", every("n_y"))
    across = cells.join(side("x", "a"), ["x", "chunk_x"]).join(side("y", "b"), ["y", "chunk_y"]).select("a", "b")
    across = across.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    mine = chunks.filter("count > 1")
    left = mine.select("cls", F.col("chunk").alias("cell"), F.col("recs").alias("a"))
    right = mine.withColumn("n", _n_chunks(F.col("count"))).select("cls", every("n").alias("cell"), F.col("recs").alias("b"))
    same = left.join(right.hint("merge"), ["cls", "cell"]).select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).filter("a < b")
    return across.select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b")).unionByName(same.select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b")))


def near_groups(records: DataFrame, t: Fraction = THRESHOLD, min_words: int = MIN_WORDS, spread: float = SPREAD) -> DataFrame:
    """(rec, class_rec, group_rec, n_links): every record with the first record of its word set, the first record of
    its group of directly or indirectly similar records, and the number of other word sets it is similar to."""
    scratch, members, groups, pairs = _prepare(records, t, min_words, spread)
    edges = scratch.put(pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")), "edges")
    comp = components(scratch, edges)
    least = comp.groupBy("c").agg(F.min("x").alias("group_rec"))
    links = edges.select(F.explode(F.array("u", "v")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    known = scratch.put(comp.join(least.hint("merge"), "c").select(F.col("x").alias("cls"), "group_rec").join(links.hint("merge"), "cls"), "known")
    hot = find_hot(scratch, groups.select("cls", "count"), "cls", members.count())
    got = lookup_join(members.select("rec", "cls"), known, "cls", hot, "left")
    return got.select("rec", F.col("cls").alias("class_rec"), F.coalesce("group_rec", "cls").alias("group_rec"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
