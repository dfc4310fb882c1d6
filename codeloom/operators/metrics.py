"""Classification, line and coverage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return precision, recall, ratio(2 * precision * recall, precision + recall)


def confusion(rows: DataFrame, truth: Column, predicted: Column, drop_unknown: Column | None = None) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1. drop_unknown: rows to leave out."""
    rows = rows if drop_unknown is None else rows.where(~drop_unknown)
    counts = rows.agg(*(F.count_if(c).alias(n) for n, c in (("tp", truth & predicted), ("fp", ~truth & predicted), ("fn", truth & ~predicted), ("tn", ~truth & ~predicted))))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def own_line_counts(true: Column, predicted: Column, n_lines: Column) -> dict[str, Column]:
    """Counts over lists of own lines; a line that is predicted twice is a false positive once more."""
    tp = F.size(F.filter(true, lambda x: F.array_contains(predicted, x)))
    fp, fn = F.size(predicted) - tp, F.size(true) - tp
    return {"tp": tp, "fp": fp, "fn": fn, "tn": n_lines - tp - fp - fn}


def range_counts(start: Column, end: Column, p_start: Column, p_end: Column, n_lines: Column) -> dict[str, Column]:
    """Counts over half-open ranges, from their overlap."""
    size = lambda a, b: F.greatest(b - a, F.lit(0))
    tp = F.greatest(F.least(end, p_end) - F.greatest(start, p_start), F.lit(0))
    fp, fn = size(p_start, p_end) - tp, size(start, end) - tp
    return {"tp": tp, "fp": fp, "fn": fn, "tn": n_lines - tp - fp - fn}


def line_totals(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Sums of row counts, with precision, recall and f1."""
    totals = rows.agg(*(F.sum(c).cast("long").alias(n) for n, c in counts.items()))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return totals.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def includes_lines(own: Column, start: Column, end: Column) -> Column:
    """Whether all own lines lie in a predicted half-open range."""
    return F.forall(own, lambda x: (x >= start) & (x < end))


def includes_type(true: Column, predicted: Column) -> Column:
    """Whether a predicted `A|B` names any true type."""
    return F.arrays_overlap(true, F.flatten(F.transform(predicted, lambda p: F.split(p, r"\|"))))


def zone_coverage(rows: DataFrame) -> DataFrame:
    """One row: lines by zone (own, nested, outside) and whether predicted, start-line hits, and cases with half their own lines covered.

    rows: n_lines, start, end (the true range), own (its own lines), p_start, p_end. Counts come from the
    overlaps of ranges within each row, so no line is a row of its own and nothing but the totals is shuffled.
    """
    n, start, end, p_start, p_end = (F.col(c) for c in ("n_lines", "start", "end", "p_start", "p_end"))
    size = lambda *ranges: F.greatest(F.least(n, *(b for _, b in ranges)) - F.greatest(F.lit(0), *(a for a, _ in ranges)), F.lit(0)) if ranges else F.greatest(n, F.lit(0))
    own = F.filter(F.array_distinct("own"), lambda x: (x >= 0) & (x < n))
    among = lambda *ranges: F.size(F.filter(own, lambda x: F.lit(True) if not ranges else _all(*((x >= a) & (x < b) for a, b in ranges))))
    true, predicted = (start, end), (p_start, p_end)
    own_hit, nested_hit = among(predicted), size(true, predicted) - among(true, predicted)
    own_all, nested_all = among(), size(true) - among(true)
    hit, every = size(predicted), size()
    first = F.get("own", F.lit(0))
    per = rows.where("n_lines > 0").select(
        own_hit.alias("own_hit"), (own_all - own_hit).alias("own_miss"), nested_hit.alias("nested_hit"), (nested_all - nested_hit).alias("nested_miss"),
        (hit - own_hit - nested_hit).alias("outside_hit"), (every - hit - (own_all - own_hit) - (nested_all - nested_hit)).alias("outside_miss"),
        F.coalesce((first >= p_start) & (first < p_end) & (first >= 0) & (first < n), F.lit(False)).alias("start_hit"),
    )
    totals = [F.sum(f"{z}_{h}").cast("long").alias(f"{z}_{h}") for z in ("own", "nested", "outside") for h in ("hit", "miss")]
    covered = F.count_if((F.col("own_hit") + F.col("own_miss") > 0) & (2 * F.col("own_hit") >= F.col("own_hit") + F.col("own_miss")))
    return per.agg(*totals, F.count_if("start_hit").alias("start_hits"), covered.alias("half_covered"))


def _all(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def membership_counts(flags: Column) -> tuple[Column, Column]:
    """Of an array of truth values: whether none holds, whether some holds (a null holds not)."""
    return F.forall(flags, lambda x: ~F.coalesce(x, F.lit(False))), F.exists(flags, lambda x: F.coalesce(x, F.lit(False)))
