"""Queries over line alignment, handlers, logs, stored records and streams, on texts and files made from the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import align, handlers, sequence
from codeloom.plans.facts import table
from codeloom.session import shared_dir, staged
from codeloom.sources import code
from codeloom.streaming import ingest


def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of different lines against themselves without some: of each new line the old one it matches.

    Lines with a place that leaves 0 by 3 are left out, those that leave 1 by 5 get other white space.
    """
    old = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("x"), F.md5(x))))
    kept = F.filter(F.transform(old, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] % 3 != 0)
    new = F.transform(kept, lambda s: F.when(s["i"] % 5 == 1, F.concat(F.lit("\t  "), s["x"], F.lit("  "))).otherwise(s["x"]))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(old, "\n").alias("old"), F.array_join(new, "\n").alias("new"), F.size(old).alias("n")).where("n > 1")
    return align.aligned(rows, "old", "new").select("doc_id", F.posexplode("matched").alias("new_line", "old_line"))


def line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old declaration against an assignment, a new try with resources, and other spacing: which of them match."""
    name, call = F.element_at(F.split("p_name", " "), 1), F.lower("p_type")
    new = F.when(F.col("p_size") % 4 == 0, F.concat(name, F.lit(" = "), call, F.lit("( );"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("\ttry ("), name, F.lit(" = "), call, F.lit("();) {"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("Type "), name, F.lit("  = "), call, F.lit("();"))).otherwise(F.concat(name, F.lit("="), call, F.lit("();")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Type "), name, F.lit(" = "), call, F.lit("();")).alias("old"), new.alias("new"))
    return align.aligned(rows, "old", "new").select("p_partkey", (F.get("matched", F.lit(0)) == 0).alias("same"))


def edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines of each order against five: one stays, one changes, one goes, two are new."""
    key = F.col("o_orderkey").cast("string")
    old = F.concat_ws("\n", F.lit("head"), F.concat(F.lit("a"), key), F.lit("same"), F.concat(F.lit("gone"), key))
    new = F.concat_ws("\n", F.lit("head"), F.concat(F.lit("b"), key), F.lit("  same"))
    more = F.concat_ws("\n", new, F.lit("tail"), F.lit("new"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", old.alias("old"), F.when(F.col("o_orderkey") % 2 == 0, new).otherwise(more).alias("new"))
    return align.edited(rows, "old", "new").select("o_orderkey", F.array_join("script", "|").alias("script"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order a method that calls its parts, and a version where those from the second call on stand in a try; every third
    has it in both, every fifth a nested one more.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ls"))
    called = F.transform("ls", lambda x, i: F.concat(F.lit("    m"), i.cast("string"), F.lit("(p"), x["l_partkey"].cast("string"), F.lit(");")))
    first, rest = F.slice(called, F.lit(1), F.lit(1)), F.slice(called, F.lit(2), F.greatest(F.size(called) - 1, F.lit(0)))
    catch = F.array(F.concat(F.lit("    } catch (Ex"), (F.col("l_orderkey") % 4).cast("string"), F.lit(" e) {")), F.lit("        log(e);"), F.lit("    }"))
    inner = F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.array(F.lit("    try {")), rest, F.array(F.lit("    } catch (final In e) {"), F.lit("    }")))).otherwise(rest)
    head, foot = F.array(F.lit("void run() {")), F.array(F.lit("}"))
    plain = F.concat(head, first, rest, foot)
    one = F.concat(head, first, F.array(F.lit("    try {")), rest, catch, foot)
    two = F.concat(head, first, F.array(F.lit("    try {")), inner, catch, foot)
    return lines.where("size(ls) > 1").select("l_orderkey", F.size("ls").alias("n"), F.array_join(F.when(F.col("l_orderkey") % 3 == 0, one).otherwise(plain), "\n").alias("before"), F.array_join(two, "\n").alias("after"))


def added_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tries that the new versions added, with their ranges, types and bodies."""
    found = handlers.method_diff(_versions(spark, sf_dir), "before", "after").select("l_orderkey", F.explode_outer("changes").alias("c")).where("c is not null")
    return found.select("l_orderkey", *(F.col(f"c.{side}Target{end}Line").alias(f"{side}_{end}".lower()) for side in ("before", "after") for end in ("Start", "End")), F.array_join(F.col("c.beforeTargetNoNestingLines").cast("array<string>"), ",").alias("own_before"), F.size("c.afterTargetNoNestingLines").alias("n_own_after"), F.array_join("c.exceptionTypes", "|").alias("types"), F.size("c.catchBlocks").alias("n_bodies"))


def changed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes each order's method has, the first one's start, what their JSON says, and which text is missing."""
    rows = _versions(spark, sf_dir).withColumn("before", F.when(F.col("l_orderkey") % 7 != 0, F.col("before"))).withColumn("after", F.when(F.col("l_orderkey") % 11 != 0, F.col("after")))
    found = handlers.first_change(handlers.method_diff(rows, "before", "after"))
    of = lambda path: F.coalesce(F.get_json_object("json", path), F.lit(""))
    found = found.withColumn("json", handlers.changes_json(F.col("changes"), F.concat(F.lit("run"), "l_orderkey"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))))
    return found.select("l_orderkey", "changed", F.coalesce("resultAfterTargetStartLine", F.lit(-1)).alias("start"), F.json_array_length("json").alias("n_json"), of("$[0].methodName").alias("json_name"), of("$[0].target.afterTargetStartLine").alias("json_start"), of("$[0].target.exceptionTypes[0]").alias("json_type"), F.md5(of("$[0].methodAfter")).alias("json_after"), F.coalesce("error", F.lit("")).alias("error"))


def file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as methods of files, paired by name: how many changes each pair with different text has."""
    rows = _versions(spark, sf_dir).select((F.col("l_orderkey") % 100).alias("file"), F.col("l_orderkey").alias("name"), "before", "after")
    found = handlers.file_diff(rows.select("file", "name", F.col("before").alias("text")), rows.select("file", "name", F.col("after").alias("text")), ["file"])
    return found.select("file", "name", F.size("changes").alias("n"))


def try_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line of a new version: how many tries cover it, the last of them, and whether the line is valid."""
    rows = handlers.with_tries(_versions(spark, sf_dir), "after", "tries").withColumn("ls", tx.lines(F.col("after")))
    per = rows.select("l_orderkey", F.posexplode(F.arrays_zip(handlers.nesting(F.col("tries"), F.size("ls")).alias("d"), handlers.owners(F.col("tries"), F.size("ls")).alias("o"))).alias("line", "x"), tx.valid_lines(F.col("ls")).alias("valid"))
    return per.groupBy("l_orderkey").agg(F.sum("x.d").alias("depths"), F.sum("x.o").alias("owners"), F.max(F.size("valid")).alias("valid"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' methods written as source files, a package for each tenth below a source root, read again: path, root, class name; one folder is left out."""
    at = _folder(spark, "tree")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey") % 10).alias("k"), "o_orderkey")
    # a file for each folder, whose last line tells its orders
    lines = staged(orders.groupBy("k").agg(F.concat(F.lit("package q."), F.first("k"), F.lit("; // "), F.count(F.lit(1)), F.lit(" "), F.sum("o_orderkey")).alias("value")), "packages")
    for k in range(10):
        folder = f"src/main/q/p{k}" if k < 8 else f"other/p{k}"
        lines.where(F.col("k") == f"p{k}").select("value").coalesce(1).write.option("compression", "none").text(f"{at}/{folder}")
    files = code.source_files(spark, at, ["src/main/q/p3"], suffix="txt")
    root = code.source_root(F.col("path"), F.col("content"))
    shown = files.select(F.regexp_extract("path", "(p[0-9])/", 1).alias("folder"), F.trim(F.regexp_replace("content", "\n", "")).alias("text"), root.alias("root"), code.class_name(F.col("path"), root).alias("class"))
    return shown.select("folder", "text", "root", F.regexp_extract("class", r"^(.*?)\.?part-", 1).alias("package")).where("text != ''")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples, written, replaced as a whole and read again; absent numbers are 0."""
    at = _folder(spark, "examples")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("p"), "doc_id").alias("patch"), F.array("lang").alias("exceptionTypes"), F.when(F.col("doc_id") % 2 == 0, 1).alias("label"))
    there = code.examples_or_none(spark, at).count()
    code.replace_json(rows.limit(1), at)
    code.replace_json(rows, at)
    back = spark.read.schema(code.EXAMPLE).json(at).fillna(0, ["label", "changed"])
    return back.select("repo_id", "patch", F.array_join("exceptionTypes", ",").alias("types"), "label", "changed", F.lit(there).alias("before"))


def log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines written as logs, one for each source, read again in order: how many lines, and where the first long one stands."""
    at = _folder(spark, "logs")
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id", "n").select("source", F.regexp_replace("line", "\r", "").alias("value")).write.partitionBy("source").text(at)
    back = code.log_lines(spark, at).select(F.regexp_extract("file", "source=([^/]*)", 1).alias("source"), "line_no", "line")
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), F.min(F.when(F.length("line") > 200, F.col("line_no"))).alias("long"))


def record_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers appended to a cache by mark, and found again by case; the folders of the cache as a listing."""
    at = _folder(spark, "cache")
    turns = table(spark, sf_dir, "conversations")
    code.append_records(turns.where("turn = 0").select(F.col("conv_id").alias("case_id"), F.lit("main").alias("mark"), F.md5("text").alias("value")), at)
    code.append_records(turns.where("turn = 1").select(F.col("conv_id").alias("case_id"), F.lit("api").alias("mark"), F.md5("text").alias("value")), at)
    cases = turns.select(F.col("conv_id").alias("case_id")).distinct()
    return code.record_of(cases, spark.read.parquet(at), "main").select("case_id", F.coalesce("value", F.lit("")).alias("value"))


def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of folders that pages' urls name, and how many pages lie under the roots of one host."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return code.folder_listing(paths).select("dir", F.array_join("subdirs", ",").alias("subdirs"))


def files_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below a folder of their host."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    roots = paths.select(F.concat(F.substring_index("path", "/", 1), F.lit("/en/")).alias("root")).distinct()
    return code.files_under(paths, roots).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken in as a stream, twice; what is there already is not taken again."""
    source, target, state = (_folder(spark, x) for x in ("in", "out", "state"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    double = lambda df: df.withColumn("twice", F.col("o_custkey") * 2)
    for part in (orders.where("o_orderstatus != 'P'"), orders):
        part.write.mode("append").parquet(source)
        query = ingest.resumable(spark, source, orders.schema, double, target, state, ["o_orderkey"])
        ingest.stop(query)
    return spark.read.parquet(target).select("o_orderkey", "twice")


def log_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases over three logs of events, by event number, in one table."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts"))
    logs = [sequence.phase_matches(events.where(F.col("event_id") % 3 == k), "user_id", [F.col("event_type") == x for x in ("view", "click")], ["ts", "event_id"]) for k in range(3)]
    found = sequence.durations(sequence.over_logs(logs), 2)
    return found.groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("phase_1"), F.col("l_extendedprice").cast("double").alias("phase_2"), (F.col("l_quantity") + F.col("l_linenumber")).cast("double").alias("total"))


def phase_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two phases trimmed by 2 % on each side, and of the totals by 3 %."""
    found = sequence.phase_statistics(_phases(spark, sf_dir), ["phase_1", "phase_2"], "total")
    return found.select("phase", "stat", F.round("original", 3).alias("original"), F.round("trimmed", 3).alias("trimmed"))


def duration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.duration_totals(_phases(spark, sf_dir), ["phase_1", "phase_2"])
    return found.select(*(F.round(c, 2).alias(c) for c in found.columns))


QUERIES = {
    f.__name__: f
    for f in (
        line_alignment, line_matches, edit_scripts, added_tries, changed_cases, file_diffs, try_lines, source_scan, json_round_trip, log_read, record_cache, folder_listing, files_under, stream_ingest,
        log_phases, phase_statistics, duration_totals,
    )
}

_V = "v AS (SELECT l_orderkey, count(*)::INT AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"
_STAT = "count(x)::DOUBLE AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, stddev_pop(x) / avg(x) AS cv"


ORACLES = {
    "line_alignment": "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS p FROM d), u AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM x GROUP BY doc_id, l) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS new_line, i::INT AS old_line FROM u WHERE n > 1 AND i % 3 <> 0",
    "line_matches": "SELECT p_partkey, p_size % 4 <> 3 AS same FROM part",
    "edit_scripts": "SELECT o_orderkey, ' head|~ a' || o_orderkey || ' -> b' || o_orderkey || '| same|' || CASE WHEN o_orderkey % 2 = 0 THEN '- gone' || o_orderkey ELSE '~ gone' || o_orderkey || ' -> tail|+ new' END AS script FROM orders",
    "added_tries": f"""WITH {_V}, k AS (SELECT *, l_orderkey % 5 = 0 AS nested, l_orderkey % 3 = 0 AS old FROM v),
outer_ AS (SELECT l_orderkey, 2 AS before_start, n + 1 AS before_end, 2 AS after_start, n + 6 + CASE WHEN nested THEN 3 ELSE 0 END AS after_end, '' AS x, 'Ex' || l_orderkey % 4 AS types, n, nested FROM k WHERE NOT old AND NOT nested),
inner_ AS (SELECT l_orderkey, n, old FROM k WHERE nested)
SELECT l_orderkey, before_start, before_end, after_start, after_end - 1 AS after_end, array_to_string(range(2, n + 1), ',') AS own_before, (n + 3)::INT AS n_own_after, types, 1 AS n_bodies FROM outer_
UNION ALL SELECT l_orderkey, 2, CASE WHEN old THEN n + 2 ELSE n + 1 END, 3, n + 5, array_to_string(range(2, CASE WHEN old THEN n + 2 ELSE n + 1 END), ','), (n + 2)::INT, 'In', 1 FROM inner_""",
    "changed_cases": f"""WITH {_V}, k AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 THEN 0 WHEN l_orderkey % 5 = 0 THEN 1 WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 END::INT AS changed FROM v),
c AS (SELECT l_orderkey, list(CASE WHEN r = 1 THEN '    m0(p' ELSE '    m' || r - 1 || '(p' END || l_partkey || ');' ORDER BY r) AS called FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) GROUP BY l_orderkey),
t AS (SELECT l_orderkey, array_to_string(['void run() {{', called[1], '    try {{'] || CASE WHEN l_orderkey % 5 = 0 THEN ['    try {{'] || called[2:] || ['    }} catch (final In e) {{', '    }}'] ELSE called[2:] END || ['    }} catch (Ex' || l_orderkey % 4 || ' e) {{', '        log(e);', '    }}', '}}'], chr(10)) AS after FROM c)
SELECT l_orderkey, changed, CASE WHEN changed = 0 THEN -1 WHEN l_orderkey % 5 = 0 THEN 3 ELSE 2 END::INT AS start, changed AS n_json, CASE WHEN changed = 1 THEN 'run' || l_orderkey ELSE '' END AS json_name, CASE WHEN changed = 0 THEN '' WHEN l_orderkey % 5 = 0 THEN '3' ELSE '2' END AS json_start, CASE WHEN changed = 0 THEN '' WHEN l_orderkey % 5 = 0 THEN 'In' ELSE 'Ex' || l_orderkey % 4 END AS json_type,
  md5(CASE WHEN changed = 1 THEN after ELSE '' END) AS json_after, CASE WHEN l_orderkey % 7 = 0 THEN 'no old text' WHEN l_orderkey % 11 = 0 THEN 'no new text' ELSE '' END AS error FROM k JOIN t USING (l_orderkey)""",
    "file_diffs": f"WITH {_V} SELECT l_orderkey % 100 AS file, l_orderkey AS name, 1 AS n FROM v WHERE l_orderkey % 5 = 0 OR l_orderkey % 3 <> 0",
    "try_lines": f"WITH {_V} SELECT l_orderkey, (n + 3 + CASE WHEN l_orderkey % 5 = 0 THEN 3 + n + 2 ELSE 0 END)::BIGINT AS depths, (CASE WHEN l_orderkey % 5 = 0 THEN n + 2 - (2 + 1) ELSE -3 END)::BIGINT AS owners, (n + 4 + CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 0 END)::INT AS valid FROM v",
    "source_scan": "SELECT 'p' || o_orderkey % 10 AS folder, 'package q.p' || o_orderkey % 10 || '; // ' || count(*) || ' ' || sum(o_orderkey) AS text, CASE WHEN o_orderkey % 10 < 8 THEN 'src/main' ELSE 'other/p' || o_orderkey % 10 END AS root, CASE WHEN o_orderkey % 10 < 8 THEN 'q.p' || o_orderkey % 10 ELSE '' END AS package FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY o_orderkey % 10",
    "json_round_trip": "SELECT source AS repo_id, 'p' || doc_id AS patch, lang AS types, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS label, 0 AS changed, 0 AS before FROM documents",
    "log_read": "WITH l AS (SELECT source, doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY doc_id, n) - 1 AS k FROM l) SELECT source, count(*) AS n, max(k) AS last, min(k) FILTER (length(line) > 200) AS long FROM r GROUP BY source",
    "record_cache": "SELECT c.conv_id AS case_id, coalesce(v, '') AS value FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, max(md5(text)) AS v FROM conversations WHERE turn = 0 GROUP BY conv_id) t ON t.conv_id = c.conv_id",
    "folder_listing": "WITH p AS (SELECT string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS p FROM pages) SELECT p[1] AS dir, string_agg(DISTINCT p[2], ',' ORDER BY p[2]) AS subdirs FROM p WHERE len(p) >= 3 GROUP BY 1",
    "files_under": "WITH p AS (SELECT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages) SELECT path, count(*) AS n FROM p WHERE regexp_matches(path, '^[^/]*/en/') GROUP BY path",
    "stream_ingest": "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders",
    "log_phases": "WITH RECURSIVE e AS (SELECT event_id % 3 AS log, user_id, row_number() OVER (PARTITION BY event_id % 3, user_id ORDER BY ts, event_id) AS r, ts, event_type = 'view' AS v FROM events WHERE event_type IN ('view', 'click')), w AS (SELECT DISTINCT log, user_id, 0::BIGINT AS r, NULL::TIMESTAMP AS t, 0::BIGINT AS s, 0::BIGINT AS n FROM e UNION ALL SELECT w.log, w.user_id, e.r, CASE WHEN t IS NULL THEN CASE WHEN v THEN e.ts END WHEN v THEN t END, CASE WHEN t IS NOT NULL AND NOT v THEN s + (floor(epoch(e.ts)) - floor(epoch(t)))::BIGINT ELSE s END, CASE WHEN t IS NOT NULL AND NOT v THEN n + 1 ELSE n END FROM w JOIN e ON e.log = w.log AND e.user_id = w.user_id AND e.r = w.r + 1), l AS (SELECT log, user_id, arg_max(s, r) AS s, arg_max(n, r) AS n FROM w GROUP BY log, user_id) SELECT log::INT AS log, sum(n)::BIGINT AS n, sum(s)::BIGINT AS total FROM l GROUP BY log",
    "phase_statistics": "WITH p AS (SELECT 'phase_1' AS phase, l_quantity::DOUBLE AS x, 0.02 AS s FROM lineitem UNION ALL SELECT 'phase_2', l_extendedprice::DOUBLE, 0.02 FROM lineitem UNION ALL SELECT 'total', l_quantity + l_linenumber, 0.03 FROM lineitem), b AS (SELECT phase, quantile_cont(x, 0.02) AS l2, quantile_cont(x, 0.98) AS h2, quantile_cont(x, 0.03) AS l3, quantile_cont(x, 0.97) AS h3 FROM p GROUP BY phase), " + f"a AS (SELECT phase, {_STAT} FROM p GROUP BY phase), t AS (SELECT phase, {_STAT} FROM p JOIN b USING (phase) WHERE x BETWEEN CASE WHEN phase = 'total' THEN l3 ELSE l2 END AND CASE WHEN phase = 'total' THEN h3 ELSE h2 END GROUP BY phase), u AS (UNPIVOT a ON n, mean, median, std, min, max, p25, p75, cv INTO NAME stat VALUE original), w AS (UNPIVOT t ON n, mean, median, std, min, max, p25, p75, cv INTO NAME stat VALUE trimmed) SELECT phase, stat, round(original, 3) AS original, round(trimmed, 3) AS trimmed FROM u JOIN w USING (phase, stat)",
    "duration_totals": "SELECT round(sum(l_quantity), 2)::DOUBLE AS phase_1_sum, round(sum(l_extendedprice), 2)::DOUBLE AS phase_2_sum, round(sum(l_quantity) + sum(l_extendedprice), 2)::DOUBLE AS all_sum FROM lineitem",
}
