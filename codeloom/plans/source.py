"""Queries over facts from source text, on Java files made from orders: one class for each customer, a statement for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import extract, graph, names
from codeloom.plans.facts import table
from codeloom.session import staged


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer a class whose method has a statement for each order, by its status and priority: a throw under an
    `if`, a try (nested for priorities over 3) or a call with an anonymous class. Names, conditions and handlers follow the order.
    """
    key, n = F.col("o_orderkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    throws = F.concat(F.lit("    if (q > "), key, F.lit(" && (q & 1) != 0)\n      throw new E"), n, F.lit('("a } b {");\n'))
    plain = F.concat(F.lit("    try { p"), key, F.lit("(); } catch (final A"), n, F.lit(" | x.B e) { throw e; }\n"))
    nested = F.concat(F.lit("    try { /* } */ try { p"), key, F.lit("(); } catch (A"), n, F.lit(" e) { throw e; } } catch (x.B f) { } finally { }\n"))
    calls = F.concat(F.lit("    p"), key, F.lit("(new Object() { public String toString() { return s(); } }); // try {\n"))
    line = F.when(F.col("o_orderstatus") == "F", throws).when(F.col("o_orderstatus") == "P", calls).when(n > "3", nested).otherwise(plain)
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    own, package = F.col("o_custkey").cast("string"), (F.col("o_custkey") % 5).cast("string")
    wild = F.when(F.col("o_custkey") % 3 == 0, "import y.*;\n").otherwise("")
    parent = F.when(F.col("o_custkey") % 2 == 0, "RuntimeException").otherwise("Exception")
    text = F.concat(
        F.lit("package q.p"), package, F.lit(";\nimport x.E1;\n"), wild, F.lit("/** No "), own, F.lit(" { */\npublic abstract class C"), own, F.lit(" extends "), parent, F.lit(" implements java.io.Serializable, Comparable<C"), own,
        F.lit("> {\n  static { init(); }\n  Runnable r = () -> h();\n  static class A1 extends Exception { }\n  /** Runs. */\n  @Deprecated void run(final java.util.Map<String, List<Integer>> a, int... q) throws java.io.IOException, E2 {\n"), "lines",
        F.lit('    String t = """\n      class Fake { void f() { g(); } }\n""";\n  }\n  abstract int none();\n}\n'),
    )
    return per.select(F.concat(F.lit("q/p"), package, F.lit("/C"), own, F.lit(".java")).alias("path"), text.alias("content"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(extract.extract(files(spark, sf_dir)), "facts")


def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of the files, equal ones counted."""
    found = _facts(spark, sf_dir).withColumn("catches", F.array_join("catches", ","))
    return found.groupBy("path", "kind", "owner", "name", "detail", "catches", "handler").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("n_lines"))


def _library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("y.E2",), ("y.E3",), ("q.p1.E3",), ("q.p2.E4",)], "qualified_name string")


def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the names in the files mean: types of the class, the import by name, of the package, the import as a whole, java.lang, as written; or nothing known."""
    return names.qualified(_facts(spark, sf_dir), _library(spark)).groupBy("path", "name", "qualified", "how").agg(F.countDistinct("scope").alias("n_scopes"))


def knowledge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables that the facts fill, with qualified names, and the call edges with what all of their sites catch."""
    found = _facts(spark, sf_dir)
    known = staged(names.qualified(found, _library(spark)), "qualified")
    tables = extract.knowledge(found, known)
    shown = {
        "classes": F.concat_ws("|", "qualified_name", "class_type", "comment"), "exceptions": F.concat_ws("|", "qualified_name", "parent", "exception_type"), "methods": F.concat_ws("|", "qualified_name", "comment"), "belongs": F.concat_ws("|", "method", "class"),
        "throws": F.concat_ws("|", "method", "exception", "throw_way"), "inherits": F.concat_ws("|", "class", "parent", "relation"), "files": F.col("file_path"), "locates": F.concat_ws("|", "file_path", "class"),
    }
    rows = [tables[name].groupBy(text.alias("row")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("of"), "row", "n") for name, text in shown.items()]
    sites = names.with_qualified_catches(found.where("kind = 'call'"), known)
    edges = graph.edges_from_sites(extract.call_sites(sites)).select(F.lit("edges").alias("of"), F.concat("caller", F.lit(">"), "callee", F.lit(":"), F.array_join(F.array_sort(F.flatten("sites")), ",")).alias("row"), F.size("sites").cast("long").alias("n"))
    out = edges
    for r in rows:
        out = out.unionByName(r)
    return out


QUERIES = {f.__name__: f for f in (source_facts, type_names, knowledge_tables)}

_O = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, left(o_orderpriority, 1) AS n, CASE WHEN o_orderstatus = 'F' THEN 'throw' WHEN o_orderstatus = 'P' THEN 'call' WHEN left(o_orderpriority, 1) > '3' THEN 'nested' ELSE 'plain' END AS t FROM orders),
b AS (SELECT DISTINCT c, 'q/p' || c % 5 || '/C' || c || '.java' AS path, 'q.p' || c % 5 AS p, 'q.p' || c % 5 || '.C' || c AS class FROM o),
m AS (SELECT *, class || '.run(Map<String,List<Integer>>,int[])' AS run, class || '.Object{}' AS anon FROM b)"""
_FACTS = f"""{_O},
raw AS (
SELECT path, 'import' AS kind, p AS owner, 'x.E1' AS name, '' AS detail, '' AS catches, '' AS handler, 1 AS line FROM m
UNION ALL SELECT path, 'import', p, 'y.*', '', '', '', 2 FROM m WHERE c % 3 = 0
UNION ALL SELECT path, 'type', p, class, 'abstract class', '', '', 3 FROM m
UNION ALL SELECT path, 'type', class, class || '.A1', 'class', '', '', 4 FROM m
UNION ALL SELECT path, 'extends', class || '.A1', 'Exception', 'Inheritance', '', '', 4 FROM m
UNION ALL SELECT path, 'extends', class, CASE WHEN c % 2 = 0 THEN 'RuntimeException' ELSE 'Exception' END, 'Inheritance', '', '', 3 FROM m
UNION ALL SELECT path, 'implements', class, unnest(['java.io.Serializable', 'Comparable']), 'Realization', '', '', 3 FROM m
UNION ALL SELECT path, 'comment', class, '/** No ' || c || ' {{ */', 'type', '', '', 3 FROM m
UNION ALL SELECT path, 'comment', run, '/** Runs. */', 'method', '', '', 5 FROM m
UNION ALL SELECT path, 'method', class, unnest(['run(Map<String,List<Integer>>,int[])', 'none()']), '', '', '', 5 FROM m
UNION ALL SELECT path, 'declares', run, unnest(['java.io.IOException', 'E2']), '', '', '', 5 FROM m
UNION ALL SELECT path, 'throw', run, 'E' || n, 'q > ' || k || ' && (q & 1) != 0', '', '', k FROM m JOIN o USING (c) WHERE t = 'throw'
UNION ALL SELECT path, 'call', run, 'p' || k, '', CASE t WHEN 'call' THEN '' ELSE 'A' || n || ',x.B' END, '', k FROM m JOIN o USING (c) WHERE t <> 'throw'
UNION ALL SELECT path, 'throw', run, CASE t WHEN 'nested' THEN 'A' || n ELSE '' END, '', CASE t WHEN 'nested' THEN 'x.B' ELSE '' END, 'A' || n || CASE t WHEN 'nested' THEN '' ELSE '|x.B' END, k FROM m JOIN o USING (c) WHERE t IN ('plain', 'nested')
UNION ALL SELECT path, 'catch', run, 'A' || n || CASE t WHEN 'nested' THEN '' ELSE '|x.B' END, '', CASE t WHEN 'nested' THEN 'x.B' ELSE '' END, '', k FROM m JOIN o USING (c) WHERE t IN ('plain', 'nested')
UNION ALL SELECT path, 'catch', run, 'x.B', '', '', '', k FROM m JOIN o USING (c) WHERE t = 'nested'
UNION ALL SELECT path, 'method', anon, 'toString()', '', '', '', k FROM m JOIN o USING (c) WHERE t = 'call'
UNION ALL SELECT path, 'call', anon || '.toString()', 's', '', '', '', k FROM m JOIN o USING (c) WHERE t = 'call')"""
_NAMES = f"""{_FACTS},
asked AS (SELECT path, owner AS scope, name FROM raw WHERE kind IN ('extends', 'implements', 'declares', 'throw') AND name <> '' UNION SELECT path, owner, unnest(string_split(name, '|')) FROM raw WHERE kind = 'catch' UNION SELECT path, owner, unnest(string_split(catches, ',')) FROM raw WHERE catches <> ''),
q AS (SELECT path, scope, name, CASE WHEN name = 'A1' THEN class || '.A1' WHEN name = 'E1' THEN 'x.E1' WHEN p || '.' || name IN ('q.p1.E3', 'q.p2.E4') THEN p || '.' || name WHEN c % 3 = 0 AND name IN ('E2', 'E3') THEN 'y.' || name WHEN name IN ('Exception', 'RuntimeException', 'Comparable') THEN 'java.lang.' || name WHEN name LIKE '%.%' THEN name END AS qualified,
  CASE WHEN name = 'A1' THEN 'enclosing' WHEN name = 'E1' THEN 'import' WHEN p || '.' || name IN ('q.p1.E3', 'q.p2.E4') THEN 'package' WHEN c % 3 = 0 AND name IN ('E2', 'E3') THEN 'wildcard' WHEN name IN ('Exception', 'RuntimeException', 'Comparable') THEN 'java.lang' WHEN name LIKE '%.%' THEN 'written' ELSE 'unresolved' END AS how FROM asked JOIN m USING (path))"""

ORACLES = {
    "source_facts": f"WITH {_FACTS} SELECT path, kind, owner, name, detail, catches, handler, count(*) AS n, count(DISTINCT line) AS n_lines FROM raw GROUP BY ALL",
    "type_names": f"WITH {_NAMES} SELECT path, name, qualified, how, count(DISTINCT scope) AS n_scopes FROM q GROUP BY ALL",
    "knowledge_tables": f"""WITH {_NAMES},
named AS (SELECT raw.*, coalesce(q.qualified, raw.name) AS full_name FROM raw LEFT JOIN q ON q.path = raw.path AND q.scope = raw.owner AND q.name = raw.name),
every_ AS (
SELECT 'classes' AS of, concat_ws('|', t.name, t.detail, c.name) AS row FROM raw t LEFT JOIN raw c ON c.path = t.path AND c.kind = 'comment' AND c.owner = t.name WHERE t.kind = 'type'
UNION ALL SELECT 'exceptions', owner || '|' || full_name || CASE WHEN full_name LIKE '%Runtime%' THEN '|runtime' ELSE '|checked' END FROM named WHERE kind = 'extends'
UNION ALL SELECT 'methods', concat_ws('|', t.owner || '.' || t.name, c.name) FROM raw t LEFT JOIN raw c ON c.path = t.path AND c.kind = 'comment' AND c.owner = t.owner || '.' || t.name WHERE t.kind = 'method'
UNION ALL SELECT 'belongs', owner || '.' || name || '|' || owner FROM raw WHERE kind = 'method'
UNION ALL SELECT 'throws', owner || '|' || full_name || CASE kind WHEN 'throw' THEN '|throw statement' ELSE '|declaration' END FROM named WHERE kind IN ('throw', 'declares')
UNION ALL SELECT 'inherits', owner || '|' || full_name || '|' || detail FROM named WHERE kind IN ('extends', 'implements')
UNION ALL SELECT 'files', path FROM m
UNION ALL SELECT 'locates', path || '|' || name FROM raw WHERE kind = 'type'),
one AS (SELECT r.path, r.owner, r.name, r.line, coalesce(q.qualified, u.x) AS x FROM (SELECT *, unnest(string_split(catches, ',')) AS x FROM raw WHERE kind = 'call' AND catches <> '') u JOIN raw r ON r.path = u.path AND r.owner = u.owner AND r.name = u.name AND r.kind = 'call' AND r.line = u.line LEFT JOIN q ON q.path = u.path AND q.scope = u.owner AND q.name = u.x),
e AS (SELECT owner, name, count(*) AS n FROM raw WHERE kind = 'call' GROUP BY ALL)
SELECT of, row, count(*) AS n FROM every_ GROUP BY ALL
UNION ALL SELECT 'edges', e.owner || '>' || e.name || ':' || coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM one WHERE one.owner = e.owner AND one.name = e.name), ''), n FROM e""",
}
