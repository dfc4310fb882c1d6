"""Hierarchies: ancestors, subtype and runtime tests, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import staged

RUNTIME = "java.lang.RuntimeException"


def _reached(edges: DataFrame, starts: DataFrame, label: str) -> DataFrame:
    """(child, ancestor, distance): what each start reaches over edges (child, parent), itself too, by doubling.

    `known` holds all pairs nearer than 2^k steps, `leaps` all pairs that a walk of just 2^k steps joins. Known pairs
    behind a leap are those nearer than 2^(k+1), so a chain of n takes log2(n) rounds. A round that finds no
    pair ends it, for then none is farther; so cycles end too.
    """
    known = staged(starts.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("distance")), label)
    leaps = staged(edges.select("child", "parent").distinct(), label)
    count, step = known.count(), 1
    while True:
        over = leaps.select(F.col("child").alias("_at"), "parent")
        farther = known.join(over, F.col("ancestor") == F.col("_at")).select("child", F.col("parent").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        known = staged(known.unionByName(farther).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")), label)
        now = known.count()
        if now == count:
            return known
        count, step = now, 2 * step
        leaps = staged(leaps.join(over.withColumnRenamed("parent", "_to"), F.col("parent") == F.col("_at")).select("child", F.col("_to").alias("parent")).distinct(), label)
        if leaps.isEmpty():
            return known


def ancestors(parents: DataFrame) -> DataFrame:
    """(child, ancestor, distance) of (child, parent) pairs, reflexive and transitive.

    There is no bound on rows or depth; a self-parent ends its chain, and cycles end. With several
    parents the shortest distance counts. Nulls are no names.
    """
    edges = staged(parents.where("child is not null and parent is not null and child != parent").select("child", "parent").distinct(), "edges")
    nodes = parents.select("child").unionByName(parents.select(F.col("parent").alias("child"))).where("child is not null").distinct()
    return _reached(edges, nodes, "closure")


def is_runtime(names: DataFrame, closure: DataFrame, root: str = RUNTIME) -> DataFrame:
    """(name, runtime): 1 below the root, 0 elsewhere in the hierarchy, -1 unknown."""
    known = closure.groupBy(F.col("child").alias("_name")).agg(F.max((F.col("ancestor") == root).cast("int")).alias("_flag"))
    return names.join(known, names["name"] == F.col("_name"), "left").select("name", F.coalesce("_flag", F.lit(-1)).alias("runtime"))


def chain_until(parents: DataFrame, known: DataFrame) -> DataFrame:
    """(start, node, distance): each unknown name's chain up to and with the first known one, or up to a name it has
    met already, so cycles end. Several parents give each node once, at its least distance. known: column name.
    """
    stop = known.select(F.col("name").alias("_known")).distinct()
    open_ = staged(parents.where("child != parent").distinct().join(stop, F.col("child") == F.col("_known"), "left_anti").select("child", "parent"), "open")
    return _reached(open_, open_.select("child").distinct(), "chain").select(F.col("child").alias("start"), F.col("ancestor").alias("node"), "distance")
