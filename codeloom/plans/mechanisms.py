"""Queries over joins by suffix and pattern, sweep lines, large JSON arrays, ordered streams, repeated ingest, and functions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import registry
from codeloom.operators import enrich, lookup, sequence
from codeloom.plans.diffs import _folder, _versions
from codeloom.plans.facts import table
from codeloom.session import small_side, staged
from codeloom.sources import code
from codeloom.streaming import ingest


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "."), F.lit("."), F.col("p_partkey").cast("string")).alias("name"))


def _suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings of names (their last dots and what follows), numbers alone, and whole names of other letters."""
    parts = F.split("name", r"\.")
    tails = _names(spark, sf_dir).select(F.array_join(F.slice(parts, F.lit(-2), F.lit(2)), ".").alias("suffix"))
    keys = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 1000).cast("string").alias("suffix"))
    return tails.unionByName(keys).unionByName(_names(spark, sf_dir).select(F.upper("name").alias("suffix")))


def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each suffix, how many names end in it at a dot, and the least."""
    return lookup.suffix_join(_names(spark, sf_dir), _suffixes(spark, sf_dir)).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"))


def suffix_join_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each suffix, how many names end in it anywhere and without case."""
    return lookup.suffix_join(_names(spark, sf_dir), _suffixes(spark, sf_dir), "like").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"))


def pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns made of customers' and suppliers' numbers and market segments against all names."""
    long_ = table(spark, sf_dir, "customer").select(F.concat(F.lit("%"), F.substring("c_mktsegment", 1, 2), F.lit("%.%"), (F.col("c_custkey") % 400).cast("string")).alias("pattern"))
    short = table(spark, sf_dir, "supplier").select(F.concat(F.lit("%.WIDGET._"), (F.col("s_suppkey") % 100).cast("string"), F.lit("%")).alias("pattern"))
    odd = table(spark, sf_dir, "nation").select(F.concat(F.lit("%\\_"), F.lower("n_name"), F.lit("%")).alias("pattern"))
    return lookup.pattern_join(_names(spark, sf_dir), long_.unionByName(short).unionByName(odd)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"))


def nesting_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the lines of a part are under way, as runs: how many are, and the latest of them."""
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("id"), day(F.col("l_shipdate")).alias("start"), (day(F.col("l_shipdate")) + F.col("l_quantity").cast("int")).alias("end"))
    return sequence.nesting_runs(rows, "l_partkey").select("l_partkey", "start", "end", "depth", F.col("owner.l_orderkey").alias("owner"))


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples in JSON array files of some hundred, whose texts hold braces, quotes and line ends, read in splits."""
    at = _folder(spark, "arrays")
    odd = F.concat(F.lit('a } "b{" \\ ['), F.substring("text", 1, 300), F.lit("\\"))
    example = F.to_json(F.struct(F.col("source").alias("repo_id"), F.concat(F.lit("p"), "doc_id").alias("patch"), odd.alias("methodBefore"), F.array("lang", F.lit("}")).alias("exceptionTypes"), F.when(F.col("doc_id") % 2 == 0, 1).alias("label")))
    files = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 300).alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(example), ",\n  "), F.lit("\n]")).alias("value"))
    files.repartition("file").select("value").write.option("lineSep", "\n").text(at)
    back = code.examples_of_arrays(spark, at)
    return back.select("repo_id", "patch", F.md5("methodBefore").alias("text"), F.array_join("exceptionTypes", ",").alias("types"), "label", "changed")


def stream_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of users, out of order in two files of a stream, matched as the table's are in order."""
    source, target, state = (_folder(spark, x) for x in ("in", "out", "state"))
    phase = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2)
    events = table(spark, sf_dir, "events").select("user_id", phase.alias("phase"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie")).where("phase is not null")
    # the last event of all ends what waits: it lies far behind, under a user of its own
    end = events.agg((F.max("at") + F.expr("interval 1000 days")).alias("at")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(1).alias("phase"), "at", F.lit(-1).cast("long").alias("tie"))
    for part in (events.where("tie % 2 = 0"), events.where("tie % 2 = 1"), end):
        part.orderBy(F.md5(F.col("tie").cast("string"))).coalesce(1).write.mode("append").parquet(source)
    with ingest.rocks(spark):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest.ordered_phases(stream, "user_id", 2, "900 days").writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_timestamp("last") - F.unix_timestamp("first")).alias("total"))


def repeated_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken in by a stream, those of other priorities twice: each key once, whatever batch brought it."""
    source, target, state = (_folder(spark, x) for x in ("in", "out", "state"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    for part in (orders.where("o_orderpriority like '1%'"), orders.where("o_orderpriority not like '2%'"), orders):
        part.write.mode("append").parquet(source)
        ingest.ingest_once(spark, source, orders.schema, lambda df: df.withColumn("twice", F.col("o_custkey") * 2), target, state, ["o_orderkey"]).awaitTermination()
    return spark.read.parquet(target).groupBy("o_orderkey", "twice").agg(F.count(F.lit(1)).alias("n"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of six hours over a stream of two files in no order, closed by a watermark: as the table's are."""
    source, target, state = (_folder(spark, x) for x in ("in", "out", "state"))
    events = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    # the last event of all closes the windows before it; its own stays open
    end = events.agg((F.max("ts") + F.expr("interval 1000 days")).alias("ts")).select(F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), "ts", F.lit(-1).cast("long").alias("id"))
    for part in (events.where("id % 2 = 0"), events.where("id % 2 = 1"), end):
        part.repartition(1).write.mode("append").parquet(source)
    with ingest.rocks(spark):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest.windowed(stream, "ts", "6 hours", "900 days", "event_type", "value").writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as settings, a file for each nation, with comments, values that go on in the next line and a name that each gives again; read back."""
    at = _folder(spark, "settings")
    key, rest = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    broken = F.concat(F.lit("  c."), key, F.lit(": "), F.substring(rest, 1, 3), F.lit("\\\n"), F.expr("substring(c_mktsegment, 4)"))
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("# c."), key, F.lit(" = "), rest)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("c."), key, F.lit(" = "), rest)).otherwise(broken)
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat(line, F.lit("\nshared="), key).alias("value"))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(at)
    return code.settings(spark, at).select(F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).alias("nation"), "name", "value")


def template_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt templates in JSON files, one for each market segment with a text for each nation, filled for each customer."""
    at = _folder(spark, "templates")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"))
    text = F.concat(F.lit('Ask "'), "segment", F.lit('" {str1}\n\\ of '), "name", F.lit(": {str1}{str2}"))
    made = customers.select("segment", "name", text.alias("text")).distinct().groupBy("segment").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "text")))).alias("value"))
    made.repartition("segment").write.partitionBy("segment").text(at)
    found = code.template_texts(spark, at).select(F.url_decode(F.regexp_extract("file", "segment=([^/]*)", 1)).alias("segment"), "name", "template")
    return customers.join(small_side(staged(found, "found")), ["segment", "name"]).select("c_custkey", enrich.filled(F.col("template"), F.col("c_custkey").cast("string")).alias("prompt"))


#: A query in SQL alone: tries of new texts by LATERAL, edits of them, and names of the knowledge base by ending.
_SQL = """
SELECT v.l_orderkey, t.place, t.start, t.end, t.types, count(e.edit) AS n_new FROM sql_versions v, LATERAL loom_tries(v.after) t, LATERAL loom_edits(v.before, v.after) e
WHERE e.edit LIKE '+%' GROUP BY ALL
UNION ALL
SELECT s.s_suppkey, 0, length(loom_owner(n.name)), length(loom_simple_name(n.name)), loom_erased(n.name || '<' || s.s_suppkey || '>'), 0 FROM sql_suppliers s, LATERAL loom_ending((s.s_suppkey % 1000)::string) n
"""


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free SQL over registered functions."""
    _versions(spark, sf_dir).createOrReplaceTempView("sql_versions")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("sql_suppliers")
    _names(spark, sf_dir).createOrReplaceTempView("sql_names")
    registry.register(spark, "sql_names")
    return spark.sql(_SQL)


QUERIES = {f.__name__: f for f in (suffix_join, suffix_join_like, pattern_join, nesting_runs, json_arrays, stream_phases, stream_windows, repeated_ingest, settings_files, template_prompts, sql_functions)}

_N = "n AS (SELECT DISTINCT lower(p_type) || '.' || replace(p_name, ' ', '.') || '.' || p_partkey AS name FROM part)"
_S = f"{_N}, s AS (SELECT array_to_string(string_split(name, '.')[-2:], '.') AS suffix FROM n UNION SELECT (s_suppkey % 1000)::VARCHAR FROM supplier UNION SELECT upper(name) FROM n)"
ORACLES = {
    "sql_functions": f"""WITH {_N}, v AS (SELECT l_orderkey, count(*)::INT AS n, l_orderkey % 5 = 0 AS nested, l_orderkey % 3 = 0 AS old FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1),
e AS (SELECT *, CASE WHEN old THEN 0 ELSE 4 END + CASE WHEN nested THEN 3 ELSE 0 END AS n_new FROM v)
SELECT l_orderkey, 0 AS place, 2 AS start, n + 5 + CASE WHEN nested THEN 3 ELSE 0 END AS end, 'Ex' || l_orderkey % 4 AS types, n_new::BIGINT AS n_new FROM e WHERE n_new > 0
UNION ALL SELECT l_orderkey, 1, 3, n + 5, 'In', n_new FROM e WHERE nested
UNION ALL SELECT s_suppkey, 0, length(name) - length(string_split(name, '.')[-1]) - 1, length(string_split(name, '.')[-1]), name, 0 FROM supplier JOIN n ON ends_with(name, '.' || s_suppkey % 1000)""",
    "json_arrays": "SELECT source AS repo_id, 'p' || doc_id AS patch, md5('a } \"b{\" \\ [' || substring(text, 1, 300) || '\\') AS text, lang || ',}' AS types, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS label, 0 AS changed FROM documents",
    "stream_windows": "SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "settings_files": "SELECT c_nationkey::VARCHAR AS nation, 'c.' || c_custkey AS name, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_nationkey::VARCHAR, 'shared', max(c_custkey)::VARCHAR FROM customer GROUP BY c_nationkey",
    "template_prompts": "SELECT c_custkey, 'Ask \"' || c_mktsegment || '\" ' || c_custkey || chr(10) || '\\ of n' || c_nationkey || ': ' || c_custkey || '{str2}' AS prompt FROM customer",
    "repeated_ingest": "SELECT o_orderkey, o_custkey * 2 AS twice, 1 AS n FROM orders",
    "stream_phases": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, ts, event_type = 'view' AS v FROM events WHERE event_type IN ('view', 'click')),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS r, NULL::TIMESTAMP AS t, 0::BIGINT AS s, 0::BIGINT AS n FROM e UNION ALL SELECT w.user_id, e.r, CASE WHEN t IS NULL THEN CASE WHEN v THEN e.ts END WHEN v THEN t END, CASE WHEN t IS NOT NULL AND NOT v THEN s + (floor(epoch(e.ts)) - floor(epoch(t)))::BIGINT ELSE s END, CASE WHEN t IS NOT NULL AND NOT v THEN n + 1 ELSE n END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT user_id, max(n) AS n, max(s)::BIGINT AS total FROM w GROUP BY user_id HAVING max(n) > 0""",
    "suffix_join": f"WITH {_S} SELECT suffix, count(*) AS n, min(name) AS least FROM s JOIN n ON name = suffix OR ends_with(name, '.' || suffix) GROUP BY suffix",
    "suffix_join_like": f"WITH {_S} SELECT suffix, count(*) AS n, min(name) AS least FROM s JOIN n ON ends_with(lower(name), lower(suffix)) GROUP BY suffix",
    "pattern_join": f"WITH {_N}, p AS (SELECT '%' || left(c_mktsegment, 2) || '%.%' || c_custkey % 400 AS pattern FROM customer UNION SELECT '%.WIDGET._' || s_suppkey % 100 || '%' FROM supplier UNION SELECT '%\\_' || lower(n_name) || '%' FROM nation) SELECT pattern, count(*) AS n, min(name) AS least FROM p JOIN n ON name ILIKE pattern ESCAPE '\\' GROUP BY pattern",
    "nesting_runs": """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS start, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT AS stop FROM lineitem),
d AS (SELECT *, unnest(range(start, stop)) AS line FROM r), l AS (SELECT l_partkey, line, count(*) AS depth, max((start, l_orderkey, l_linenumber, l_suppkey, l_quantity)) AS top, arg_max(l_orderkey, (start, l_orderkey, l_linenumber, l_suppkey, l_quantity)) AS owner FROM d GROUP BY ALL),
c AS (SELECT *, CASE WHEN lag(line) OVER w = line - 1 AND lag(depth) OVER w = depth AND lag(top) OVER w = top THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY l_partkey ORDER BY line)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_partkey ORDER BY line) AS run FROM c)
SELECT l_partkey, min(line)::INT AS start, max(line)::INT + 1 AS end, any_value(depth)::BIGINT AS depth, any_value(owner) AS owner FROM g GROUP BY l_partkey, run""",
}
