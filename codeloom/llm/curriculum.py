"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, piecewise linear over knots;
its integral up to t, as a share of its integral up to 1, times the source's target is the
demand for its words up to t. A source's documents stand one behind another in an order
that their content does not know (the MD5 of doc_id), which demand walks through, again from the
start at the end. A document is first taken when the demand reaches its first word: the
inverse of the cumulative demand, a quadratic in each stretch between knots, gives that time.
Documents are range-sorted by it.

Targets: each source gets words in proportion to its weight, but at most CAP times its own, and
what is cut off goes to the others by weight until none is above (`targets`). Such a level
is found by rounds of sums over sources; a source that is above in one round stays so.

A word is taken as often as the demand, whole words only, passes over it, so a source's words add
up to its target rounded down, and no document is taken more than CAP times; the last document that
demand reaches may be taken in part.

Everything is DataFrame functions. Places in a source are running sums over a table that is dealt
by range of (source, order), so a source of any size is spread over tasks; rows that are equal
in all of these are spread by a salt, and do not differ.

Odd rows: null, empty and blank texts have no words, so they are at their place with 0 taken; a null
source is the last one; null ids come first in their source; repeated rows stand side by side,
and each is taken for itself; long texts are counted whole; where no source has words, targets are 0;
other columns are ignored, whatever their names; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.kb import numbered

from .common import small_side, staged, words

#: Weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Knots of the schedules of these: (time, weight). Strong sources fade, weak ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
SALTS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text)."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, number (0-based, by code points, null last) and weight of each source."""
    each = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()), "sources")
    placed = numbered(each, ["_null", "source"], "number")
    return placed.select("source", "source_size", "number", F.get(F.array(*map(F.lit, weights)), (F.col("number") % len(weights)).cast("int")).cast("long").alias("weight"))


def targets(of: DataFrame, cap: int = CAP) -> DataFrame:
    """`of` (source_size, weight) with each source's target. The level is raised until no further source is above its cap."""
    level, above = 0.0, -1
    most = F.col("source_size") * cap
    while True:
        full = F.col("weight") * level >= most
        sums = of.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count_if(full)).first()
        if sums[2] == 0 or sums[3] == above:
            break
        above, level = sums[3], (sums[0] - sums[1]) / sums[2]
    return of.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), most.cast("double")))


def _stretches(number: Column, schedules: tuple) -> Column:
    """Of a source's schedule: (begin, long, rate, slope, before) of each stretch, in shares of its integral."""
    kinds = []
    for knots in schedules:
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        before, rows = 0.0, []
        for (t, w), (t2, w2) in zip(knots, knots[1:], strict=False):
            rows.append(F.struct(*(F.lit(float(x)).alias(n) for n, x in (("begin", t), ("long", t2 - t), ("rate", w / whole), ("slope", (w2 - w) / (t2 - t) / whole), ("before", before)))))
            before += (t2 - t) * (w + w2) / 2 / whole
        kinds.append(F.array(*rows))
    return F.get(F.array(*(F.struct(k.alias("k")) for k in kinds)), (number % len(schedules)).cast("int"))["k"]


def demand_reaches(share: Column, number: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches a share (0 to 1) of its target."""
    at = F.element_at(F.filter(_stretches(number, schedules), lambda s: s["before"] <= share), -1)
    # before + rate * x + slope * x * x / 2 = share, in the form that is exact for slope 0
    left = share - at["before"]
    x = 2 * left / (at["rate"] + F.sqrt(F.greatest(at["rate"] * at["rate"] + 2 * at["slope"] * left, F.lit(0.0))))
    return at["begin"] + F.least(F.when(left > 0, x).otherwise(0.0), at["long"])


def placed(sizes: DataFrame) -> DataFrame:
    """sizes with `place`: how many words of the source stand before the document."""
    turn = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sizes.select("doc_id", "source", "size", turn.alias("turn"), (F.monotonically_increasing_id() % SALTS).alias("salt"))
    order = ["source", "turn", "size", "salt"]
    dealt = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", "size", F.monotonically_increasing_id().alias("at")), "dealt")
    part = F.shiftright("at", 33)
    own = Window.partitionBy("part", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.withColumn("part", part)
    # one row for each source in each partition
    sums = staged(runs.groupBy("source", "part").agg(F.sum("size").alias("words")), "sums")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")), "offsets")
    inside = runs.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    met = inside.join(small_side(offsets), (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return met.select("doc_id", "source", "size", (F.col("inside") + F.col("offset")).alias("place"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and position: the training time of its first word, null if it is never reached.

    Sorted by position.
    """
    sizes = staged(sized(docs), "sizes")
    of = staged(sources(sizes, weights), "of")
    known = staged(targets(of, cap).withColumnRenamed("source", "_source"), "targets")
    met = placed(sizes).join(small_side(known), F.col("source").eqNullSafe(F.col("_source")))
    # passes over the whole source, and how far the last one comes
    demand = F.floor("target")
    rounds = F.coalesce(F.expr("cast(floor(target) as bigint) div nullif(source_size, 0L)"), F.lit(0))
    last = demand - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.least(F.greatest(last - F.col("place"), F.lit(0)), F.col("size"))
    reached = (F.col("taken") > 0) & (F.col("target") > 0)
    position = F.when(reached, F.round(demand_reaches(F.try_divide(F.col("place"), F.col("target")), F.col("number"), schedules), 9))
    return met.withColumn("taken", taken.cast("long")).select("doc_id", "size", "source_size", "target", "taken", position.alias("position")).orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc_id", "size"))


def visits(mixed: DataFrame, cap: int = CAP) -> DataFrame:
    """The training order: a row for each time that a document of mix() is taken, its words then, by round and position."""
    times = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    each = mixed.where("taken > 0").withColumn("round", times).withColumn("words", F.least(F.col("taken") - F.col("round") * F.col("size"), F.col("size"))).where("words > 0")
    return each.select("doc_id", "round", "words", "position").orderBy("round", "position", "doc_id")
