"""Problem 7: a mixture of sources in target shares, in the order of a time-varying curriculum.

Each source has a weight schedule over training time, here a line through its target share whose slope all sources
balance. Its integral is the source's cumulative demand; inverted at the cumulative tokens of a document it gives the
document's position. Cumulative tokens come from a two-level prefix sum (buckets, then their totals; about as many
buckets as documents in one), so a source with most of the rows is never summed in one task. Documents are
range-sorted by position.

The mixture is as large as the corpus unless a size is given. Sources too small for their share, even repeated, are used
up; the others share what is missing in proportion, and the report shows the shares reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.llm.tokens import n_tokens
from reqloom.session import Scratch

#: Documents of one bucket of the prefix sum, about; their square root where that is more.
BUCKET = 5000
#: Steepest weight: the share at the end of training is up to so much more than on average.
STEEPEST = 0.5


def clean_source(c: Column) -> Column:
    return F.lower(F.trim(c))


def sized_sources(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with a source and at least one token."""
    sized = documents.select("doc_id", clean_source(F.col("source")).alias("source"), n_tokens(F.col("text"), ranks).alias("n_tokens"))
    return sized.filter("n_tokens > 0 AND source IS NOT NULL")


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to use of each source in a mixture of ``total`` tokens (None: as many as the target sources hold).

    Sources that run out are used up, each document as often as it may be, and the others share what is missing in
    proportion to their targets; if all run out, the mixture is smaller.
    """
    supply = {s: available.get(s, 0) * repeats for s, (share, repeats) in targets.items() if share > 0 and repeats > 0}
    supply = {s: x for s, x in supply.items() if x > 0}
    if not supply:
        return {}
    share = {s: targets[s][0] for s in supply}
    if total is None:
        total = sum(available[s] for s in supply)
    out: dict[str, float] = {}
    left, open_ = min(float(total), float(sum(supply.values()))), set(supply)
    while open_:
        scale = left / sum(share[s] for s in open_)
        short = {s for s in open_ if supply[s] <= scale * share[s]}
        if not short:
            return out | {s: scale * share[s] for s in open_}
        for s in short:
            out[s] = float(supply[s])
            left -= supply[s]
        open_ -= short
    return out


def slopes(used: dict[str, float], targets: dict[str, tuple[float, int]], steepest: float = STEEPEST) -> dict[str, float]:
    """Slope of each source's weight: sources that may be repeated more come later; weights sum to 1 at all times."""
    total = sum(used.values())
    if not total:
        return {}
    mean = sum(used[s] * targets[s][1] for s in used) / total
    raw = {s: targets[s][1] - mean for s in used}
    most = max(abs(x) for x in raw.values())
    return {s: steepest * x / most if most else 0.0 for s, x in raw.items()}


def position(x: Column, slope: Column) -> Column:
    """Time at which the share ``x`` of a source's tokens is used up: t + slope (t^2 - t) = x, solved for t."""
    back = 1 - slope
    return F.when(F.abs(slope) < 1e-9, x).otherwise((F.sqrt(back * back + 4 * slope * x) - back) / (2 * slope))


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, bucket: int = BUCKET, seed: int = 0) -> DataFrame:
    """(position, doc_id, source, use_no, n_tokens), range-sorted by position (from 0 to 1).

    ``sized``: (doc_id unique, source, n_tokens > 0). ``targets``: (source, target_share, max_repeats), a handful of
    rows. A document is used at most ``max_repeats`` times, ``use_no`` counting from 1, and never in part: of a source
    used in part the documents come in an order drawn by hash, and its last one is in if at least half of it is wanted.
    A document with less than half wanted even if it came first is passed over for others.
    Sources without a target or without documents give no row; an empty table gives an empty result.
    """
    spark = sized.sparkSession
    scratch = Scratch(spark, "mixing")
    docs = scratch.put(sized.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).filter("n_tokens > 0"), "sized")
    wanted = {r.source.strip().lower(): (float(r.target_share), int(r.max_repeats)) for r in targets.collect() if r.source is not None and r.target_share is not None and r.max_repeats is not None}
    have = {r.source: r.n for r in docs.filter(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    used = plan(have, wanted, total)
    slope = slopes(used, wanted)
    rows = [(s, used[s], slope[s], min(wanted[s][1], -int(-used[s] // have[s])), int(used[s] // have[s]), used[s] % have[s]) for s in used]
    # one row for each target, never more
    plan_ = F.broadcast(spark.createDataFrame(rows, "source string, used double, slope double, uses int, whole int, part double"))
    n = docs.count()
    buckets = max(1, -(-n // max(bucket, int(n**0.5))))
    each = docs.join(plan_, "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    each = each.withColumn("h", F.xxhash64("doc_id", "use_no", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    # in a use that takes only a part of the source, a document of more than twice this part can be in at no place
    each = each.filter((F.col("use_no") <= F.col("whole")) | (F.col("n_tokens") <= 2 * F.col("part")))
    keys = ["source", "use_no", "bucket"]
    sums = each.groupBy(*keys).agg(F.sum("n_tokens").alias("t"))
    by = Window.partitionBy("source").orderBy("use_no", "bucket")
    # a bucket's offset: what earlier uses and buckets of its source hold
    before = scratch.put(sums.withColumn("offset", F.sum("t").over(by) - F.col("t")).drop("t"), "offsets")
    inside = Window.partitionBy(*keys).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.withColumn("upto", F.sum("n_tokens").over(inside)).join(before.hint("merge"), keys)
    middle = F.col("offset") + F.col("upto") - F.col("n_tokens") / 2
    kept = summed.withColumn("x", middle / F.col("used")).filter("x <= 1")
    out = kept.select(position(F.col("x"), F.col("slope")).alias("position"), "doc_id", "source", "use_no", "n_tokens")
    return out.orderBy("position", "source", "doc_id", "use_no")


def mix_report(sized: DataFrame, targets: DataFrame, mixture: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share, most_uses), a row per target."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("use_no").alias("most_uses"))
    zero = F.lit(0).cast("long")
    rows = targets.withColumn("source", clean_source(F.col("source"))).join(have, "source", "left").join(got, "source", "left")
    total = F.sum(F.coalesce("used_tokens", zero)).over(Window.partitionBy(F.lit(0)))  # over the targets, a handful
    share = F.when(total > 0, F.coalesce("used_tokens", zero) / total).otherwise(F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", F.coalesce("available_tokens", zero).alias("available_tokens"), F.coalesce("used_tokens", zero).alias("used_tokens"), share.alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
