"""Ordered events: phase patterns, durations, trimmed statistics, nesting."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.kb import numbered
from codeloom.session import small_side, staged


def phase_matches(rows: DataFrame, key: str, phases: list[Column], order: list[str]) -> DataFrame:
    """Greedy, non-overlapping matches of phases 1..n in order, within each key.

    A row is in phase k if phases[k] holds. Rows are dealt by key and sorted; one walk over a
    partition takes a row if it is the awaited phase, and the last phase closes a match. Only the
    open match is held, however many rows a key has.
    Returns key, match (0-based) and t1..tn, the rows' `at`.
    """
    n = len(phases)
    phase = F.coalesce(*[F.when(p, F.lit(k + 1)) for k, p in enumerate(phases)])
    marks = rows.select(F.col(key), phase.alias("_phase"), "at", *order).where("_phase is not null")
    marks = marks.repartition(key).sortWithinPartitions(key, *order).select(key, "_phase", "at")
    kind, at = (marks.schema[c].dataType.simpleString() for c in (key, "at"))
    names = [key, "match", *(f"t{k + 1}" for k in range(n))]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, count, open_ = None, 0, []
        for part in batches:
            out = []
            for name, found, when in zip(part[key], part["_phase"], part["at"], strict=True):
                if name != current:
                    current, count, open_ = name, 0, []
                if found == len(open_) + 1:
                    open_.append(when)
                    if found == n:
                        out.append((name, count, *open_))
                        count, open_ = count + 1, []
            yield pd.DataFrame(out, columns=names)

    return marks.mapInPandas(walk, f"{key} {kind}, match int, " + ", ".join(f"t{k + 1} {at}" for k in range(n)))


def markers(line: Column, words: list[str], pattern: str) -> Column:
    """Which mark a line has: the number, from 1, of the first word in it, the next number for the pattern; null for none."""
    return F.coalesce(*[F.when(line.contains(w), F.lit(k + 1)) for k, w in enumerate(words)], F.when(line.rlike(pattern), F.lit(len(words) + 1)))


def seconds(a: Column, b: Column) -> Column:
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def durations(matches: DataFrame, n: int) -> DataFrame:
    """matches (t1..tn) with phase_1..phase_n-1 in seconds, and their total."""
    return matches.select("*", *(seconds(F.col(f"t{k}"), F.col(f"t{k + 1}")).alias(f"phase_{k}") for k in range(1, n)), seconds(F.col("t1"), F.col(f"t{n}")).alias("total"))


def percentiles(values: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles, between neighbours in proportion; null without values.

    Values are dealt by range and sorted, so each rank lies in one known partition; only the
    neighbours of the ranks asked for leave the tasks.
    """
    dealt = values.select(F.col(column).cast("double").alias("v")).where("v is not null").repartitionByRange("v").sortWithinPartitions("v")
    placed = staged(dealt.withColumn("at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min("v").alias("v")).select("v", "part", "n", "first").collect())  # one row for each partition
    total = sum(n for _, _, n, _ in sizes)
    if not total:
        return [None] * len(shares)
    wanted = {r for s in shares for r in (math.floor(s * (total - 1)), math.ceil(s * (total - 1)))}
    where, before = {}, 0
    for _, _, n, first in sizes:
        where |= {first + r - before: r for r in wanted if before <= r < before + n}
        before += n
    found = {where[r["at"]]: r["v"] for r in placed.where(F.col("at").isin(list(where))).collect()}  # two rows for each share
    between = lambda p: found[math.floor(p)] + (p - math.floor(p)) * (found[math.ceil(p)] - found[math.floor(p)])
    return [between(s * (total - 1)) for s in shares]


#: Statistics in the order they are given.
STATS = ["n", "mean", "median", "std", "min", "max", "p25", "p75", "cv"]


def _picked(placed: DataFrame, groups: DataFrame, shares: dict[str, Column], by: list[str]) -> DataFrame:
    """groups (by, first, n) with a column for each share: the exact percentile of n rows of placed from place `first` on."""
    wanted = groups.where("n > 0").select(*by, "first", "n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), share.cast("double").alias("share")) for name, share in shares.items()))).alias("s"))
    rank = F.col("s.share") * (F.col("n") - 1)
    wanted = wanted.select(*by, F.col("s.name").alias("name"), (rank - F.floor(rank)).alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("up"), (F.col("first") + F.floor(rank)).alias("row_index")), F.struct(F.lit(1).alias("up"), (F.col("first") + F.ceil(rank)).alias("row_index")))).alias("r"))
    wanted = wanted.select(*by, "name", "part", "r.up", "r.row_index")
    met = wanted.join(placed.select("row_index", "v"), "row_index").groupBy(*by, "name").agg(F.first("part").alias("part"), F.max(F.when(F.col("up") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("up") == 1, F.col("v"))).alias("high"))
    value = F.col("low") + F.col("part") * (F.col("high") - F.col("low"))
    wide = met.groupBy(*(F.col(c).alias(f"_w_{c}") for c in by)).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares))
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in by]
    return groups.join(wide, reduce(lambda a, b: a & b, same), "left").select(*groups.columns, *shares)


def grouped_statistics(values: DataFrame, by: list[str], trim: Column) -> DataFrame:
    """by, side (`original`, `trimmed`) and STATS of each group of (by, v), null values left out.

    trim: the share cut off at each side, an expression over `by`; values at the bounds stay. All groups are sorted at
    once, dealt by range; each percentile is a rank whose row is picked by a join, and trimmed values are a run of the same order.
    """
    placed = numbered(values.select(*by, F.col("v").cast("double").alias("v")).where("v is not null"), [*by, "v"])

    def plain(rows: DataFrame) -> DataFrame:
        return staged(rows.groupBy(*by).agg(F.min("row_index").alias("first"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.when(F.avg("v") != 0, F.stddev_pop("v") / F.avg("v")).alias("cv")), "sums")

    thirds = {"p25": F.lit(0.25), "median": F.lit(0.5), "p75": F.lit(0.75)}
    whole = staged(_picked(placed, plain(placed), thirds | {"_low": trim, "_high": 1 - trim}, by), "whole")
    bounds = whole.select(*(F.col(c).alias(f"_{c}") for c in by), "_low", "_high")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    kept = placed.join(small_side(bounds), same).where(F.col("v").between(F.col("_low"), F.col("_high"))).select(*placed.columns)
    less = _picked(placed, plain(kept), thirds, by)
    side = lambda df, name: df.select(*by, F.lit(name).alias("side"), *STATS)
    return side(whole, "original").unionByName(side(less, "trimmed"))


def _compared(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, stat, original, trimmed, pct_change), a row for each group and statistic; the change is infinite from 0."""
    tall = found.select(*by, "side", F.explode(F.array(*(F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("v")) for n in STATS))).alias("x")).select(*by, "side", "x.stat", "x.v")
    both = tall.groupBy(*by, "stat").agg(*(F.max(F.when(F.col("side") == name, F.col("v"))).alias(name) for name in ("original", "trimmed")))
    change = F.when(F.col("original") == 0, F.lit(float("inf"))).otherwise((F.col("trimmed") - F.col("original")) / F.col("original") * 100)
    return both.withColumn("pct_change", change)


def compared_statistics(values: DataFrame, column: str, share: float) -> DataFrame:
    """(stat, original, trimmed, pct_change) of one column, trimmed by a share on each side; of no values, counts of 0 and nulls."""
    found = grouped_statistics(values.select(F.lit(column).alias("phase"), F.col(column).alias("v")), ["phase"], F.lit(share))
    every = values.sparkSession.createDataFrame([(n,) for n in STATS], "_stat string")
    met = every.join(_compared(found, ["phase"]), F.col("_stat") == F.col("stat"), "left")
    zero = lambda c: F.when(F.col("_stat") == "n", F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)).alias(c)
    return met.select(F.col("_stat").alias("stat"), zero("original"), zero("trimmed"), "pct_change")


def phase_statistics(durations_: DataFrame, phases: list[str], total: str, share: float = 0.02, total_share: float = 0.03) -> DataFrame:
    """(phase, stat, original, trimmed, pct_change) of each phase, trimmed by share, and of the totals, by total_share: one sort for all."""
    tall = durations_.select(F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.col(p).cast("double").alias("v")) for p in [*phases, total]))).alias("x")).select("x.phase", "x.v")
    found = grouped_statistics(tall, ["phase"], F.when(F.col("phase") == total, total_share).otherwise(share))
    return _compared(found, ["phase"]).select("phase", "stat", "original", "trimmed", "pct_change")


def over_logs(logs: list[DataFrame], name: str = "log") -> DataFrame:
    """Results of several logs in one table, each with the number of its log."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(k)) for k, df in enumerate(logs)])


def duration_totals(durations_: DataFrame, phases: list[str]) -> DataFrame:
    """One row: the sum of each phase's seconds, and of all."""
    sums = [F.coalesce(F.sum(p), F.lit(0)) for p in phases]
    return durations_.agg(*(c.alias(f"{p}_sum") for c, p in zip(sums, phases, strict=True)), reduce(lambda a, b: a + b, sums).alias("all_sum"))


def nesting_runs(ranges: DataFrame, group: str) -> DataFrame:
    """(group, start, end, depth, owner): runs of lines under equal ranges. depth: how many half-open ranges (id, start, end) cover
    them; owner: the id of the last of these by start, of equal starts the greatest.

    A sweep line: each range gives an event at either end, events are dealt by group and sorted, and one walk holds the
    ranges that are open. Ranges are never spread over their lines; empty ones cover nothing. Nulls cover nothing.
    """
    real = ranges.where((F.col("end") > F.col("start")) & F.col("id").isNotNull()).select(F.to_json(F.struct(group)).alias("_g"), group, "id", "start", "end")
    place = ranges.schema["start"].dataType.simpleString()
    # the walk orders ids as Spark does: by their place among the group's ranges of one start
    known = real.withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy("start", "id")))
    known = staged(known, "ranges")
    events = known.select("_g", F.col("start").alias("at"), F.lit(1).alias("step"), "_k").unionByName(known.select("_g", F.col("end").alias("at"), F.lit(-1).alias("step"), "_k"))
    events = events.repartition("_g").sortWithinPartitions("_g", "at", "step")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, open_, heap, run = None, set(), [], None
        for part in batches:
            out = []
            for g, at, step, k in zip(part["_g"], part["at"], part["step"], part["_k"], strict=True):
                if g != current:
                    current, open_, heap, run = g, set(), [], None
                if run and at > run[0]:
                    out.append((g, run[0], at, run[1], run[2]))
                if step > 0:
                    open_.add(k)
                    heapq.heappush(heap, -k)
                else:
                    open_.discard(k)
                while heap and -heap[0] not in open_:
                    heapq.heappop(heap)
                run = (at, len(open_), -heap[0]) if open_ else None
            yield pd.DataFrame(out, columns=["_g", "start", "end", "depth", "_k"])

    runs = events.mapInPandas(walk, f"_g string, start {place}, end {place}, depth bigint, _k int")
    owned = runs.join(known.select(F.col("_g").alias("_h"), F.col("_k").alias("_j"), "id", F.col(group).alias("_group")), (F.col("_g") == F.col("_h")) & (F.col("_k") == F.col("_j")))
    # neighbours under equal depth and owner are one run
    order = Window.partitionBy("_g").orderBy("start")
    joins = (F.lag("end").over(order) == F.col("start")) & (F.lag("_k").over(order) == F.col("_k")) & (F.lag("depth").over(order) == F.col("depth"))
    numbered_ = owned.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return numbered_.groupBy("_g", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("depth").alias("depth"), F.first("id").alias("owner"), F.first("_group").alias("_group")).select(F.col("_group").alias(group), "start", "end", "depth", "owner")


def nesting(ranges: DataFrame, group: str) -> DataFrame:
    """nesting_runs by line: (group, line, depth, owner), one row for each line that a range covers."""
    return nesting_runs(ranges, group).select(group, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("line"), "depth", "owner")


def sampled_negatives(rows: DataFrame, group: str, key: str, n: int = 2) -> DataFrame:
    """n rows of each group, in the order of the MD5 of their keys."""
    window = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")
