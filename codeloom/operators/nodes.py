"""Methods as graph nodes: where a root is, what an API node throws, how nodes and edges read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import after_last_dot, caught_types, overlay, throws_tags
from codeloom.operators.kb import exact_then_erased, resolve_simple


def declared_file(class_name: Column) -> Column:
    """The file of a class, nested ones climbing to the outermost: `a.b.C.D` as `a/b/C.java` (a name's first capital starts a type)."""
    outer = F.regexp_extract(class_name, r"^((?:[^A-Z.][^.]*\.)*[A-Z][^.]*)", 1)
    return F.concat(F.replace(F.when(outer != "", outer).otherwise(class_name), F.lit("."), F.lit("/")), F.lit(".java"))


def class_file(classes: DataFrame, files: DataFrame) -> DataFrame:
    """(class, path): the first file whose path ends in the class's file. An equality join on the file's suffixes, not a scan for each class."""
    parts = F.split("path", "/")
    ends = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("file"))
    wanted = classes.select("class").distinct().withColumn("file", declared_file(F.col("class")))
    return wanted.join(ends, "file").groupBy("class").agg(F.min("path").alias("path"))


def resolve_signature(targets: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, name) of the last method of the target's file whose name ends in it, and the file's others as (target, negative).

    targets: file, target; methods: file, name, seq. Both meet by file, so no other file's names are tested.
    """
    met = targets.join(methods, "file").withColumn("_hit", F.col("name").endswith(F.col("target")))
    found = met.where("_hit").groupBy("file", "target").agg(F.max_by("name", "seq").alias("name"))
    return found, met.where("not _hit").select("file", "target", F.col("name").alias("negative"))


def roots_by_name(names: DataFrame, methods: DataFrame, files: DataFrame) -> DataFrame:
    """(query, name): methods found by a qualified name: its class's file, then the signature in it. names: query; methods: file, name, seq."""
    owner = F.regexp_extract(F.substring_index("query", "(", 1), r"^(.*)\.[^.]*$", 1)
    asked = names.select("query", owner.alias("class")).where("class != ''")
    at = asked.join(class_file(asked, files), "class").select(F.col("path").alias("file"), F.col("query").alias("target"))
    return resolve_signature(at, methods)[0].select(F.col("target").alias("query"), "name")


def roots_by_file(asked: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods found by full relative path and signature (file, target), and the negatives beside them."""
    return resolve_signature(asked.select("file", "target"), methods)


def first_in_method(facts: DataFrame, target: Column, kind: str) -> DataFrame:
    """The first fact of a kind inside each target method. facts: kind, owner, seq."""
    inside = facts.where((F.col("kind") == kind) & target)
    rest = [c for c in inside.columns if c != "owner"]
    return inside.groupBy("owner").agg(F.min_by(F.struct(*rest), "seq").alias("_f")).select("owner", "_f.*").select(*facts.columns)


def api_exceptions(methods: DataFrame, throws: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(method, exceptions): map of what an API method throws to the condition, from its throws rows (any way, no
    condition) and its comment's `@throws` tags, which win. Names become qualified by `known` (qualified_name) where it has them.

    methods: method, comment; throws: method, exception.
    """
    listed = throws.groupBy("method").agg(F.map_from_entries(F.transform(F.collect_set("exception"), lambda e: F.struct(e, F.lit("")))).alias("_listed"))
    none = F.create_map().cast("map<string,string>")
    merged = methods.join(listed, "method", "left").select("method", overlay(F.coalesce("_listed", none), F.coalesce(throws_tags(F.coalesce("comment", F.lit(""))), none)).alias("exceptions"))
    if known is None:
        return merged
    one = merged.select("method", F.explode("exceptions").alias("name", "condition"))
    names = resolve_simple(one.select("name").distinct(), known)
    # of two names that become one, the greater condition stays
    named = one.join(names, "name").groupBy("method", "qualified").agg(F.max("condition").alias("condition"))
    maps = named.groupBy("method").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qualified", "condition")))).alias("exceptions"))
    return methods.select("method").join(maps, "method", "left").select("method", F.coalesce("exceptions", none).alias("exceptions"))


def api_nodes(nodes: DataFrame, methods: DataFrame) -> DataFrame:
    """(node, true_name, is_api): a node is an API method if the knowledge base has its name, exactly or without type parameters."""
    found = exact_then_erased(nodes.select(F.col("node").alias("query")), methods.select("name")).select(F.col("query").alias("node"), F.col("name").alias("true_name"))
    return nodes.select("node").distinct().join(found, "node", "left").withColumn("is_api", F.col("true_name").isNotNull())


def caught_qualified(clauses: DataFrame, known: DataFrame) -> DataFrame:
    """(clause, types): the types of each catch clause `A | B`, qualified where known. clauses: clause, declared."""
    one = clauses.select("clause", F.posexplode(caught_types(F.col("declared"))).alias("at", "name"))
    names = resolve_simple(one.select("name").distinct(), known)
    listed = one.join(names, "name").groupBy("clause").agg(F.array_sort(F.collect_list(F.struct("at", "qualified"))).alias("_l"))
    return listed.select("clause", F.transform("_l", lambda x: x["qualified"]).alias("types"))


def throw_records(facts: DataFrame) -> DataFrame:
    """(method, statement, declaring_class, condition, catches): throw facts, `NO_BINDING` where no class is known."""
    return facts.where("kind = 'throw'").select(F.col("owner").alias("method"), F.concat(F.lit("throw new "), "name").alias("statement"), F.coalesce(F.nullif("name", F.lit("")), F.lit("NO_BINDING")).alias("declaring_class"), F.nullif("detail", F.lit("")).alias("condition"), F.get("catches", F.lit(0)).alias("innermost_catch"))


def declaration_class(parents: DataFrame, closure: DataFrame, throwable: str = "java.lang.Throwable", runtime: str = "java.lang.RuntimeException") -> DataFrame:
    """(name, kind): `runtime` or `checked` for subtypes of throwable, else `class`. closure: child, ancestor."""
    flags = closure.groupBy(F.col("child").alias("name")).agg(F.max((F.col("ancestor") == throwable).cast("int")).alias("t"), F.max((F.col("ancestor") == runtime).cast("int")).alias("r"))
    named = parents.select(F.col("child").alias("name")).distinct().join(flags, "name", "left")
    return named.select("name", F.when(F.col("r") == 1, "runtime").when(F.col("t") == 1, "checked").otherwise("class").alias("kind"))


def node_text(name: Column, throws: Column) -> Column:
    """How a node reads: its simple name and what it throws."""
    return F.concat(F.coalesce(F.nullif(after_last_dot(F.substring_index(name, "(", 1)), F.lit("")), name), F.lit(" ["), F.array_join(throws, ", "), F.lit("]"))


def edge_text(sites: Column) -> Column:
    """How an edge reads: the caught types of each call site."""
    return F.array_join(F.transform(sites, lambda s: F.concat(F.lit("{"), F.array_join(s, "|"), F.lit("}"))), " ")
