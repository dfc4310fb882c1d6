"""Knowledge-base tables: write semantics, integrity, renames, lookups and k-hop queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import after_last_dot, strip_generics
from codeloom.session import staged

#: Bits of a word of a set of numbers; fewer than 63, so that no word is negative.
BITS = 60

_S = T.StringType()
#: Column types of the nine tables.
TABLES = {
    "classes": {"qualified_name": _S, "modifier": T.IntegerType(), "comment": _S, "class_type": _S},
    "exceptions": {"qualified_name": _S, "modifier": T.IntegerType(), "comment": _S, "exception_type": _S, "parent": _S},
    "methods": {"qualified_name": _S, "modifier": T.IntegerType(), "comment": _S, "content": _S},
    "throws": {"throw_key": _S, "method": _S, "exception": _S, "throw_way": _S, "throw_condition": _S},
    "belongs": {"method": _S, "class": _S},
    "calls": {"method": _S, "method_been_call": _S},
    "inherits": {"class": _S, "parent": _S, "relation": _S},
    "files": {"file_path": _S},
    "locates": {"file_path": _S, "class": _S},
}
#: Keys of the tables, on which the first write wins.
KEYS = {
    "classes": ["qualified_name"],
    "exceptions": ["qualified_name"],
    "methods": ["qualified_name"],
    "throws": ["throw_key"],
    "belongs": ["method", "class"],
    "calls": ["method", "method_been_call"],
    "inherits": ["class", "parent"],
    "files": ["file_path"],
    "locates": ["file_path", "class"],
}
#: Foreign keys: (table, column, parent table).
REFERENCES = [("throws", "method", "methods"), ("throws", "exception", "exceptions"), ("belongs", "method", "methods"), ("belongs", "class", "classes"), ("calls", "method", "methods"), ("calls", "method_been_call", "methods"), ("inherits", "class", "classes"), ("inherits", "parent", "classes"), ("locates", "file_path", "files"), ("locates", "class", "classes")]


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in TABLES[table].items()])


def throw_key(method: Column, exception: Column, way: Column) -> Column:
    return F.concat_ws("-", method, exception, way)


def first_write(rows: DataFrame, keys: list[str], order: list[str | Column], required: list[str] = ()) -> DataFrame:
    """One row of each key, the first by `order`; rows with a null in `required` are skipped. Aggregated, so a hot key combines map-side."""
    kept = reduce(lambda df, c: df.where(F.col(c).isNotNull()), [*keys, *required], rows)
    rest = [c for c in rows.columns if c not in keys]
    return kept.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, "first.*").select(*rows.columns) if rest else kept.distinct()


def insert_or_ignore(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[str | Column], required: list[str] = ()) -> DataFrame:
    """`existing` and those first writes whose key it lacks."""
    return existing.unionByName(first_write(rows, keys, order, required).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def last_write(table: DataFrame, updates: DataFrame, key: str, column: str, order: list[str | Column]) -> DataFrame:
    """`table` with `column` set to the last update of its key."""
    last = updates.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
    found = table.join(last, table[key] == F.col("_key"), "left")
    return found.withColumn(column, F.when(F.col("_last").isNotNull(), F.col(f"_last.{column}")).otherwise(F.col(column))).select(*table.columns)


def violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent (a null refers to nothing and is none)."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def migrate(child: DataFrame, references: list[tuple[str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows whose references all exist, and the others."""
    good = reduce(lambda df, r: df.join(r[1].select(F.col(r[2]).alias("_key")), df[r[0]] == F.col("_key"), "left_semi"), references, child)
    bad = reduce(DataFrame.unionByName, [violations(child, c, p, k) for c, p, k in references]).distinct()
    return good, bad


def numbered(rows: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """rows with their 0-based place in an order. Dealt by range and counted by partition, so no task sees all rows."""
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["first"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect())  # one row for each partition
    # the parts of a range-dealt table follow its order, but files may be read in another: each keeps its own partition's number
    before, shift = 0, []
    for first, n in sizes:
        shift.append((first >> 33, before - first))
        before += n
    offsets = rows.sparkSession.createDataFrame(shift or [(0, 0)], "_part bigint, _shift bigint")
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_at") + F.col("_shift")).select(*rows.columns, name)


def failures(child: DataFrame, references: list[tuple[str, DataFrame, str]], order: list[str]) -> DataFrame:
    """(row_index, column, value, json): rows that cannot be migrated, by their place in the old table, and the reference that fails."""
    placed = numbered(child, order)
    of = lambda c, p, k: violations(placed, c, p, k).select("row_index", F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.to_json(F.struct(*child.columns)).alias("json"))
    return reduce(DataFrame.unionByName, [of(*r) for r in references])


def like(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """Names that a `LIKE` pattern fits (`%`, `_`), without regard to case."""
    return names.where(F.col(column).ilike(pattern))


def only_row(rows: DataFrame) -> DataFrame:
    """rows, or an error if there are more than one."""
    n = rows.limit(2).count()
    if n > 1:
        raise ValueError("more than one row")
    return rows


def views(tables: dict[str, DataFrame]) -> None:
    """Make tables known by name to SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def select_sql(spark: SparkSession, query: str, **parameters: object) -> DataFrame | None:
    """Free SQL over the tables made known, with parameters (`:name`); null where it cannot be analysed."""
    try:
        return spark.sql(query, args=parameters)
    except (AnalysisException, ParseException):
        return None


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database whose driver the session has (`partitionColumn` and bounds among the options split the read)."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def rename(table: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """A cascading rename: `column` by mapping (old, new)."""
    named = mapping.groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new"))
    return table.join(named, table[column] == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)


def exact_then_erased(queries: DataFrame, names: DataFrame) -> DataFrame:
    """The name of each query: equal, else the first that is equal without type parameters. Two equality joins, no patterns."""
    q = queries.select("query").distinct()
    exact = q.join(names, q["query"] == names["name"]).select("query", "name", F.lit(0).alias("rank"))
    bare = names.select("name", strip_generics(F.col("name")).alias("_bare"))
    erased = q.withColumn("_bare", strip_generics(F.col("query"))).join(bare, "_bare").select("query", "name", F.lit(1).alias("rank"))
    return exact.unionByName(erased).groupBy("query").agg(F.min(F.struct("rank", "name")).alias("x")).select("query", "x.name", (F.col("x.rank") == 0).alias("is_exact"))


def resolve_simple(names: DataFrame, known: DataFrame, fallback: bool = True) -> DataFrame:
    """(name, qualified): the first known qualified name that ends in `.name`; else the name itself, or null."""
    table = known.select(F.col("qualified_name"), after_last_dot(F.col("qualified_name")).alias("_simple")).groupBy("_simple").agg(F.min("qualified_name").alias("qualified"))
    found = names.select("name").join(table, names["name"] == F.col("_simple"), "left")
    return found.select("name", F.coalesce("qualified", "name").alias("qualified") if fallback else F.col("qualified"))


def suffix_like(names: DataFrame, column: str, suffix: str, match: str = "segment") -> DataFrame:
    """Names that end in a suffix: at a dot (`segment`), or as `LIKE '%suffix'` without case (`like`)."""
    name = F.col(column)
    if match == "segment":
        return names.where((name == suffix) | name.endswith("." + suffix))
    escaped = suffix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return names.where(name.ilike("%" + escaped))


def skip_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not done yet; a null key never counts as done."""
    return todo.join(done.select(*keys), keys, "left_anti")


def present(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are known; a null key never is."""
    return rows.join(known.select(*keys), keys, "left_semi")


def khop(calls: DataFrame, hops: int) -> DataFrame:
    """(root, target): what each caller reaches in exactly `hops` calls. Distinct after each hop keeps the walk as wide as its result."""
    edges = calls.select("caller", "callee").distinct()
    found = edges.select(F.col("caller").alias("root"), F.col("callee").alias("target"))
    for _ in range(hops - 1):
        found = found.join(edges, found["target"] == edges["caller"]).select("root", F.col("callee").alias("target")).distinct()
    return found


@contextmanager
def _by_block(spark: SparkSession) -> Iterator[None]:
    """Here a join by (block, key) takes sides that were dealt by block alone as they lie."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _united(edges: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """(node, word, bits): of each caller the union of its callees' sets. edges: block, caller, callee; all edges of a caller in one block.

    A callee's set is sent to a block once, not to each caller, and all unions of a block are made where they meet.
    """
    spark = edges.sparkSession
    asked = edges.select("block", F.col("callee").alias("node")).distinct()
    sent = asked.join(sets, "node").select("block", F.col("node").alias("callee"), "word", "bits").repartition("block")
    with _by_block(spark):
        met = edges.repartition("block").join(sent.hint("merge"), ["block", "callee"])
        return staged(met.groupBy("block", F.col("caller").alias("node"), "word").agg(F.bit_or("bits").alias("bits")).select("node", "word", "bits"), label)


def khop_throws(calls: DataFrame, hops: int, throws: DataFrame) -> DataFrame:
    """(root, targets, exceptions, least): of each caller how many rows of `throws` (target, exception) it reaches in exactly
    `hops` calls, how many different exceptions these are of, and the least target.

    As khop() joined with throws, but what a node reaches is a set of bits, one for each row of throws and one for
    each exception (in words below 0), so a hop makes no row for each (root, target). Before the last hop only nodes
    that are called themselves are walked.
    """
    edges = calls.select("caller", "callee").repartitionByRange("caller").distinct()
    edges = staged(edges.withColumn("block", F.spark_partition_id()), "edges")
    called = staged(edges.select(F.col("callee").alias("node")).where("node is not null").distinct(), "called")
    reached = throws.select("target", "exception").join(called, F.col("target") == F.col("node"), "left_semi")
    rows = staged(numbered(reached, ["target"], "n"), "throws")
    kinds = numbered(rows.select("exception").where("exception is not null").distinct(), ["exception"], "n")
    bit = F.expr(f"shiftleft(1L, cast(n % {BITS} as int))")
    word = F.floor(F.col("n") / BITS)
    own = rows.select(F.col("target").alias("node"), word.alias("word"), bit.alias("bits"))
    of = rows.select("target", "exception").join(kinds, "exception").select(F.col("target").alias("node"), (-1 - word).alias("word"), bit.alias("bits"))
    sets = staged(own.unionByName(of).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "sets")
    inner = edges.join(called, F.col("caller") == F.col("node"), "left_semi")
    for _ in range(hops - 1):
        sets = _united(inner, sets, "sets")
    sets = _united(edges, sets, "reached")
    ones = F.bit_count("bits")
    # the lowest bit: those below it are as many as its place
    lowest = F.col("word") * BITS + F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bits") - 1)) - 1)
    counts = sets.groupBy(F.col("node").alias("root")).agg(F.sum(F.when(F.col("word") >= 0, ones)).alias("targets"), F.coalesce(F.sum(F.when(F.col("word") < 0, ones)), F.lit(0)).cast("long").alias("exceptions"), F.min(F.when(F.col("word") >= 0, lowest)).alias("n"))
    return counts.join(rows.select("n", F.col("target").alias("least")), "n").select("root", "targets", "exceptions", "least")
