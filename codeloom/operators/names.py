"""Names of types, qualified by scopes: joins in place of a compiler's bindings.

A name means, in this order: a type of the enclosing types, from the inside out; a type that the
file imports by name; a type of the package; a type of a package that the file imports as a whole;
a type of java.lang. Its first part is looked up so, its other parts follow. A dotted name that is
a known type as it stands, or begins like a package (a small letter), is taken as it is.
What no scope tells has a null name, and `how` says unresolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.extract import THROWABLES
from codeloom.session import staged

# Types of java.lang besides its throwables.
LANG = "Appendable AutoCloseable Boolean Byte CharSequence Character Class ClassLoader Cloneable Comparable Deprecated Double Enum Float FunctionalInterface Integer Iterable Long Math Number Object Override Process ProcessBuilder Record Runnable Runtime Short StackTraceElement StrictMath String StringBuffer StringBuilder SuppressWarnings System Thread ThreadLocal Void".split()
#: Scopes in order.
HOW = ["enclosing", "import", "package", "wildcard", "java.lang", "written"]


def resolve(references: DataFrame, types: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, scope, name, qualified, how) of each different (path, scope, name).

    scope: the type or method that the name stands in. types: qualified_name; imports: path, name (`a.b.C`, `a.b.*`);
    packages: path, package. Each scope is an equality join; of those that fit the first wins.
    """
    known = staged(types.select(F.col("qualified_name").alias("type")).where("type is not null").distinct(), "types")
    asked = references.select("path", "scope", "name").where("name is not null and name != ''").distinct().join(packages.select("path", "package"), "path", "left")
    first = F.substring_index("name", ".", 1)
    asked = staged(asked.select("*", first.alias("first"), F.substring(F.col("name"), F.length(first) + 1, F.length("name")).alias("rest")), "names")
    key = ["path", "scope", "name"]

    def found(rows: DataFrame, how: str, rank: Column) -> DataFrame:
        return rows.select(*key, F.struct(F.lit(HOW.index(how)).alias("at"), rank.alias("rank"), F.concat("qualified", "rest").alias("qualified"), F.lit(how).alias("how")).alias("x"))

    whole = F.split(F.substring_index(F.coalesce("scope", F.lit("")), "(", 1), r"\.")
    inside = asked.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(whole)), lambda n: F.array_join(F.slice(whole, F.lit(1), n), "."))).alias("n", "outer")).where(F.length("outer") > F.length(F.coalesce("package", F.lit(""))))
    # the type itself, and one that it holds
    own = inside.where(F.substring_index("outer", ".", -1) == F.col("first")).select("*", F.col("outer").alias("qualified")).join(known, F.col("qualified") == F.col("type"), "left_semi")
    held = inside.select("*", F.concat_ws(".", "outer", "first").alias("qualified")).join(known, F.col("qualified") == F.col("type"), "left_semi")
    one = imports.where(~F.col("name").endswith(".*")).select(F.col("path").alias("_p"), F.col("name").alias("qualified"), F.substring_index("name", ".", -1).alias("_f"))
    by_name = asked.join(one, (F.col("path") == F.col("_p")) & (F.col("first") == F.col("_f")))
    neighbour = asked.select("*", F.concat_ws(".", F.nullif("package", F.lit("")), "first").alias("qualified")).join(known, F.col("qualified") == F.col("type"), "left_semi")
    all_of = imports.where(F.col("name").endswith(".*")).select(F.col("path").alias("_p"), F.regexp_replace("name", r"\.\*$", "").alias("_in"))
    wild = asked.join(all_of, F.col("path") == F.col("_p")).select("*", F.concat_ws(".", "_in", "first").alias("qualified")).join(known, F.col("qualified") == F.col("type"), "left_semi")
    lang = asked.where(F.col("first").isin([*LANG, *THROWABLES])).select("*", F.concat(F.lit("java.lang."), "first").alias("qualified"))
    as_is = asked.where(F.col("name").contains(".")).join(known, F.col("name") == F.col("type"), "left").where(F.col("type").isNotNull() | F.col("first").rlike("^[a-z]")).select("*", F.col("first").alias("qualified"))
    zero = F.lit("")
    # of two enclosing types the inner, of two wildcards the least: a rank that sorts first
    depth = F.lpad((F.lit(10_000) - F.col("n")).cast("string"), 6, "0")
    every = [found(own.unionByName(held), "enclosing", depth), found(by_name, "import", F.col("qualified")), found(neighbour, "package", zero), found(wild, "wildcard", F.col("qualified")), found(lang, "java.lang", zero), found(as_is, "written", zero)]
    best = reduce(DataFrame.unionByName, every).groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min("x").alias("x"))
    met = asked.join(best, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key)), "left")
    return met.select(*key, F.col("x.qualified").alias("qualified"), F.coalesce("x.how", F.lit("unresolved")).alias("how"))


def qualified(found: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """resolve() for the types that facts name: parents, declared and thrown exceptions, and each type of a catch clause.

    library: qualified_name of types known besides those of the facts, as the knowledge base has them.
    """
    types = found.where("kind = 'type'").select(F.col("name").alias("qualified_name"))
    if library is not None:
        types = types.unionByName(library.select("qualified_name"))
    whole = found.where("kind in ('extends', 'implements', 'declares', 'throw')").select("path", F.col("owner").alias("scope"), "name")
    caught = found.where("kind = 'catch'").select("path", F.col("owner").alias("scope"), F.explode(F.split("name", r"\|")).alias("name"))
    handlers = found.select("path", F.col("owner").alias("scope"), F.explode("catches").alias("name"))
    packages = found.where("kind = 'type'").groupBy("path").agg(F.min_by("owner", "seq").alias("package"))
    imports = found.where("kind = 'import' and detail = ''").select("path", "name")
    return resolve(whole.unionByName(caught).unionByName(handlers), types, imports, packages)


def with_qualified_catches(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Facts (path, owner, catches) whose catches are qualified where the names are; the order stays."""
    each = sites.withColumn("_id", F.monotonically_increasing_id())
    each = staged(each, "sites")
    one = each.select("_id", "path", F.col("owner").alias("scope"), F.posexplode("catches").alias("at", "name"))
    # shuffled: by its files' size Spark would broadcast the names, which are many times larger in memory
    met = one.join(names.select("path", "scope", "name", "qualified").hint("merge"), ["path", "scope", "name"], "left")
    lists = met.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("qualified", "name").alias("q")))), lambda x: x["q"]).alias("_c"))
    return each.join(lists, "_id", "left").withColumn("catches", F.coalesce("_c", "catches")).drop("_id", "_c")
