"""Call graphs: edges from call sites, bounded breadth-first trees, uncaught exceptions, pruning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import small_side, staged

DEPTH = 12
#: Findings of a case are pruned beyond MOST, by path lengths from LONGEST down to SHORTEST.
MOST, LONGEST, SHORTEST = 30, 10, 4


def edges_from_sites(sites: DataFrame) -> DataFrame:
    """One edge for each (caller, callee), with its call sites' sets of caught types."""
    return sites.groupBy("caller", "callee").agg(F.collect_list("catch_types").alias("sites"))


def edge_kinds(sites: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(caller, callee, kind) of each edge, and (kind, exception): what every call site of an edge of that kind catches, by itself or an ancestor.

    The kind of an edge is the set of the sets of types that its sites catch. Edges are many and kinds are few, so
    exceptions are met by kinds, and an edge is one row whatever it catches.
    """
    of_site = sites.groupBy("caller", "callee", F.xxhash64("site_id").alias("site")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("catch_types")))).alias("types"))
    edges = staged(of_site.groupBy("caller", "callee").agg(F.array_sort(F.collect_set("types")).alias("sets")), "edges")
    kinds = staged(edges.select("sets").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    above = closure.select("ancestor", F.col("child").alias("exception")).distinct()
    one = kinds.select("kind", F.size("sets").alias("n"), F.explode("sets").alias("types")).select("kind", "n", "types", F.explode("types").alias("ancestor"))
    met = one.join(small_side(staged(above, "above")), "ancestor").select("kind", "n", "types", "exception").distinct()
    caught = met.groupBy("kind", "n", "exception").agg(F.count(F.lit(1)).alias("hits")).where("hits = n").select("kind", "exception")
    return edges.join(small_side(kinds), "sets").select("caller", "callee", "kind"), staged(caught, "caught")


def edge_catches(sites: DataFrame, closure: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(caller, callee, exception) where every call site of the edge catches the exception or an ancestor of it.

    wanted: the (caller, callee, exception) to test; all exceptions of the hierarchy without it.
    """
    edges, caught = edge_kinds(sites, closure)
    if wanted is not None:
        return wanted.distinct().join(edges, ["caller", "callee"]).join(small_side(caught), ["kind", "exception"]).select("caller", "callee", "exception")
    lists = staged(caught.groupBy("kind").agg(F.collect_list("exception").alias("exceptions")), "caught")
    return edges.join(small_side(lists), "kind").select("caller", "callee", F.explode("exceptions").alias("exception"))


def spanning_trees(roots: DataFrame, edges: DataFrame, api: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """(case_id, node, parent, level, path): the breadth-first tree of each case. Ties go to the least parent.

    api (column name): nodes that are reached but not expanded. Each level joins only the
    front with the edges and drops what the case has visited.
    """
    known = roots.select("case_id", F.col("root").alias("node"), F.lit(None).cast(roots.schema["root"].dataType).alias("parent"), F.lit(0).alias("level"), F.array("root").alias("path"))
    known = staged(known.distinct(), "tree")
    links = staged(edges.select("caller", "callee").distinct(), "links")
    front = known
    for level in range(1, depth + 1):
        open_ = front if api is None else front.join(api.select(F.col("name").alias("node")), "node", "left_anti").select(*known.columns)
        step = open_.join(links, F.col("node") == F.col("caller")).groupBy("case_id", "callee").agg(F.min_by(F.struct("node", "path"), "node").alias("by"))
        step = step.select("case_id", F.col("callee").alias("node"), F.col("by.node").alias("parent"), F.lit(level).alias("level"), F.array_append("by.path", F.col("callee")).alias("path"))
        front = staged(step.join(known, ["case_id", "node"], "left_anti").select(*known.columns), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)  # DEPTH tables at most
    return known


def uncaught(trees: DataFrame, edges: DataFrame, throws: DataFrame, sites: DataFrame, closure: DataFrame, api: DataFrame | None = None) -> DataFrame:
    """(case_id, method, path, exception): what can leave the root of a case.

    A candidate is each edge (node, method) of an expanded node to a node not on its path, and the
    root itself; an exception of the candidate stays if no edge of its path catches it. What an edge's own sites
    catch goes before edges meet trees; what is caught above a node is a list beside its path, which all
    candidates below share. So edges are shuffled narrow, and paths are met once, by what stays.
    """
    expanded = trees if api is None else trees.join(api.select(F.col("name").alias("node")), "node", "left_anti")
    kinds, caught = edge_kinds(sites, closure)
    thrown = staged(throws.select("method", "exception").distinct(), "thrown")
    caught = small_side(staged(caught.join(thrown.select("exception").distinct(), "exception", "left_semi").select("kind", "exception"), "caught_thrown"))
    links = edges.select("caller", "callee").distinct().join(kinds, ["caller", "callee"], "left")
    own = links.join(small_side(thrown.withColumnRenamed("method", "callee")), "callee").join(caught, ["kind", "exception"], "left_anti").select(F.col("caller").alias("node"), F.col("callee").alias("method"), "exception")
    steps = trees.where("level > 0").select("case_id", "node", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("caller"), F.get("path", i + 1).alias("callee")))).alias("e")).select("case_id", "node", "e.caller", "e.callee")
    # an edge of a tree is met once, whatever lies below it
    of_tree = steps.select("caller", "callee").distinct().join(kinds, ["caller", "callee"]).join(caught, "kind").groupBy("caller", "callee").agg(F.collect_list("exception").alias("exceptions"))
    above = steps.join(of_tree, ["caller", "callee"]).groupBy("case_id", "node").agg(F.array_distinct(F.flatten(F.collect_list("exceptions"))).alias("above"))
    known = staged(expanded.select("case_id", "node", "path").join(above, ["case_id", "node"], "left"), "expanded")
    met = known.join(own, "node").where(~F.array_contains("path", F.col("method")) & (F.col("above").isNull() | ~F.array_contains("above", F.col("exception"))))
    found = met.select("case_id", "method", F.array_append("path", F.col("method")).alias("path"), "exception")
    return found.unionByName(trees.where("level = 0").select("case_id", F.col("node").alias("method"), "path").join(thrown, "method").select("case_id", "method", "path", "exception"))


def findings(found: DataFrame) -> DataFrame:
    """One row for each path, with its set of exceptions."""
    return found.groupBy("case_id", "method", "path").agg(F.array_sort(F.collect_set("exception")).alias("exceptions"))


def pruned(found: DataFrame, case: str = "case_id", length: Column | None = None) -> DataFrame:
    """Findings of each case; of a case with more than MOST, those whose path is not longer than the greatest
    length from LONGEST down to SHORTEST that leaves MOST at most, or than SHORTEST.
    """
    size = F.size("path") if length is None else length
    counts = [F.count_if(size <= n).alias(f"_{n}") for n in range(LONGEST, SHORTEST - 1, -1)]
    limit = F.coalesce(*[F.when(F.col(f"_{n}") <= MOST, F.lit(n)) for n in range(LONGEST, SHORTEST - 1, -1)], F.lit(SHORTEST))
    limits = found.groupBy(F.col(case).alias("_case")).agg(F.count(F.lit(1)).alias("_all"), *counts).select("_case", F.when(F.col("_all") > MOST, limit).alias("_limit"))
    return found.join(limits, found[case].eqNullSafe(F.col("_case"))).where(F.col("_limit").isNull() | (size <= F.col("_limit"))).select(*found.columns)


def depth_first(roots: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(case_id, node, path) of a true depth-first walk, callees in name order: for parity checks of small cases.

    edges: case_id, caller, callee. One case is one group of one task.
    """

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for caller, callee in sorted(part[["caller", "callee"]].dropna().drop_duplicates().itertuples(index=False)):
            below.setdefault(caller, []).append(callee)
        rows, seen = [], set()
        stack = [[r] for r in sorted(part["root"].dropna().unique(), reverse=True)]
        while stack:
            path = stack.pop()
            if path[-1] in seen:
                continue
            seen.add(path[-1])
            rows.append((part["case_id"].iloc[0], path[-1], path))
            if len(path) <= depth:
                stack += [[*path, x] for x in reversed(below.get(path[-1], [])) if x not in path]
        return pd.DataFrame(rows, columns=["case_id", "node", "path"])

    node = roots.schema["root"].dataType.simpleString()
    case = roots.schema["case_id"].dataType.simpleString()
    both = roots.select("case_id", "root", F.lit(None).cast(node).alias("caller"), F.lit(None).cast(node).alias("callee")).unionByName(edges.select("case_id", F.lit(None).cast(node).alias("root"), "caller", "callee"))
    return both.groupBy("case_id").applyInPandas(walk, f"case_id {case}, node {node}, path array<{node}>")
