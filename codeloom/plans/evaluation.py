"""Queries over metrics, sequences and statistics, on the star tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import cases, metrics, sequence
from codeloom.plans.facts import table
from codeloom.streaming import ingest


def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return found.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lineitem as a case: a true range, a predicted one, own lines with one doubled prediction, and a number of lines."""
    q, d = F.col("l_quantity").cast("int"), (F.col("l_discount") * 100).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice").alias("id"),
        F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + q % 9).alias("end"), d.alias("p_start"), (d + q % 7).alias("p_end"), (F.lit(30) + q).alias("n_lines"),
        F.array(F.col("l_linenumber"), F.col("l_linenumber") + q % 9).alias("own"), F.array(d, d, d + 1).alias("predicted"), F.col("l_returnflag"),
    )


_RANGES = "SELECT l_linenumber AS s, l_linenumber + q % 9 AS e, d AS ps, d + q % 7 AS pe, 30 + q AS n, [l_linenumber, l_linenumber + q % 9] AS own, [d, d, d + 1] AS pred, l_returnflag FROM (SELECT *, l_quantity::INT AS q, trunc(l_discount * 100)::INT AS d FROM lineitem)"
_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def line_metrics_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.line_totals(_ranges(spark, sf_dir), metrics.own_line_counts(F.col("own"), F.col("predicted"), F.col("n_lines"))))


def line_metrics_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.line_totals(_ranges(spark, sf_dir), metrics.range_counts(*map(F.col, ("start", "end", "p_start", "p_end", "n_lines")))))


def zone_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.zone_coverage(_ranges(spark, sf_dir))


def include_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranges(spark, sf_dir)
    return rows.agg(F.count_if(metrics.includes_lines(F.col("own"), F.col("p_start"), F.col("p_end"))).alias("line_included"), F.count_if(metrics.includes_type(F.array("l_returnflag"), F.array(F.lit("A|N"), F.lit("X")))).alias("type_included"))


def type_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders one of whose flags is among the types `A|R` of their status."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    predicted = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("A|R"))).otherwise(F.array(F.lit("N")))
    return per.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", metrics.includes_type(F.col("flags"), predicted).alias("hit"))


def type_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 unknown, 0 or 1 for one type; 2 for several with a runtime one, else -3. A type is runtime if its parts' least size is odd; those of SMALL size are unknown."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" | "), "p_type")).otherwise(F.col("p_type")).alias("types"))
    known = part.where("p_type != 'SMALL'").groupBy(F.col("p_type").alias("name")).agg((F.min("p_partkey") % 2).cast("int").alias("runtime"))
    return cases.type_class(names, "p_partkey", "types", known)


def distinct_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.distinct_words(table(spark, sf_dir, "documents"), F.split("text", " "), "word")


def trimmed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.compared_statistics(table(spark, sf_dir, "events"), "value", 0.02)
    return found.select("stat", *(F.round(c, 4).alias(c) for c in ("original", "trimmed", "pct_change")))


_STATS = "count(value)::DOUBLE AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, stddev_pop(value) / avg(value) AS cv"


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, click, error, purchase in this order, for each user, with the phases' seconds."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts"))
    found = sequence.durations(sequence.phase_matches(events, "user_id", [F.col("event_type") == x for x in ("view", "click", "error", "purchase")], ["ts", "event_id"]), 4)
    return found.select("user_id", F.col("match").cast("long").alias("match"), "phase_1", "phase_2", "phase_3", "total")


def marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by mark: three words, and a pattern at the line's start."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", sequence.markers(F.col("line"), ["token", "the", "und"], "^[A-Z][a-z]+ ").alias("mark")).where("mark is not null")


def localized_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    text = F.concat(F.month(ts).cast("string"), F.lit("月 "), F.date_format(ts, "dd, yyyy hh:mm:ss"), F.when(F.hour(ts) >= 12, " 下午").otherwise(" 上午"))
    parsed = table(spark, sf_dir, "events").select("event_id", tx.localized_time(text).alias("at"))
    return parsed.select("event_id", F.unix_timestamp("at").alias("epoch"))


def line_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 11).alias("end"))
    return sequence.nesting(rows, "l_orderkey").select("l_orderkey", "line", "depth", F.col("owner.l_partkey").alias("owner"))


def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sampled_negatives(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 2)


def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logits of each vector, softmax and the greater one."""
    vec = F.col("embedding")
    ones = F.transform(vec, lambda x, i: F.when(i % 2 == 0, 0.5).otherwise(-0.25))
    twos = F.transform(vec, lambda x, i: F.when(i % 3 == 0, 0.125).otherwise(0.0625))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(tx.dot(vec, ones), tx.dot(vec, twos)).alias("logits"))
    return rows.select("vec_id", F.round(tx.softmax(F.col("logits"))[0], 5).alias("p0"), tx.argmax(F.col("logits")).cast("long").alias("class"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of six hours (an extension)."""
    found = ingest.event_windows(table(spark, sf_dir, "events"), "ts", "6 hours", "event_type", "value")
    return found.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


def except_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


def intersect_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


def case_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of documents as cases: unknown label, few lines, a source called test-like (src1*), one type only; where none of a source is kept, all stay."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    types = F.when(F.col("toxic") == 1, F.array(F.lit("RuntimeException"))).otherwise(F.array("lang"))
    cohort = cases.cohort(F.col("quality"), F.size(F.split("text", "\n")), F.regexp_replace("source", "^src1", "Test"), types)
    tagged = rows.select("doc_id", "source", cohort.alias("cohort"))
    return cases.keep_or_all(tagged, "source", F.col("cohort") == "kept")


QUERIES = {
    f.__name__: f
    for f in (
        confusion_prf, line_metrics_own, line_metrics_range, zone_coverage, include_counts, type_overlap, type_class, distinct_exploded, trimmed_stats, event_sequence, marker_filter,
        localized_time, line_nesting, negative_sample, linear_head, windowed_events, union_results, except_set, intersect_set, case_filters,
    )
}

ORACLES = {
    "confusion_prf": f"WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels) SELECT tp, fp, fn, tn, {_PRF} FROM c",
    "line_metrics_own": f"WITH r AS ({_RANGES}), k AS (SELECT len(list_filter(own, lambda x: list_contains(pred, x))) AS tp, len(pred) AS np, len(own) AS nt, n FROM r), c AS (SELECT sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(nt - tp)::BIGINT AS fn, sum(n - tp - (np - tp) - (nt - tp))::BIGINT AS tn FROM k) SELECT tp, fp, fn, tn, {_PRF} FROM c",
    "line_metrics_range": f"WITH r AS ({_RANGES}), k AS (SELECT greatest(least(e, pe) - greatest(s, ps), 0) AS tp, greatest(pe - ps, 0) AS np, greatest(e - s, 0) AS nt, n FROM r), c AS (SELECT sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(nt - tp)::BIGINT AS fn, sum(n - np - nt + tp)::BIGINT AS tn FROM k) SELECT tp, fp, fn, tn, {_PRF} FROM c",
    "zone_coverage": f"""WITH r AS (SELECT *, row_number() OVER () AS id FROM ({_RANGES})), l AS (SELECT *, unnest(range(0, n)) AS line FROM r),
t AS (SELECT id, line >= ps AND line < pe AS hit, CASE WHEN list_contains(own, line) THEN 'own' WHEN line >= s AND line < e THEN 'nested' ELSE 'outside' END AS zone, line = own[1] AS first FROM l),
p AS (SELECT id, count(*) FILTER (zone = 'own' AND hit) AS oh, count(*) FILTER (zone = 'own' AND NOT hit) AS om, count(*) FILTER (zone = 'nested' AND hit) AS nh, count(*) FILTER (zone = 'nested' AND NOT hit) AS nm, count(*) FILTER (zone = 'outside' AND hit) AS uh, count(*) FILTER (zone = 'outside' AND NOT hit) AS um, bool_or(first AND hit) AS sh FROM t GROUP BY id)
SELECT sum(oh)::BIGINT AS own_hit, sum(om)::BIGINT AS own_miss, sum(nh)::BIGINT AS nested_hit, sum(nm)::BIGINT AS nested_miss, sum(uh)::BIGINT AS outside_hit, sum(um)::BIGINT AS outside_miss, count(*) FILTER (sh) AS start_hits, count(*) FILTER (oh + om > 0 AND 2 * oh >= oh + om) AS half_covered FROM p""",
    "include_counts": f"WITH r AS ({_RANGES}) SELECT count(*) FILTER (len(list_filter(own, lambda x: x < ps OR x >= pe)) = 0) AS line_included, count(*) FILTER (l_returnflag IN ('A', 'N', 'X')) AS type_included FROM r",
    "type_overlap": "SELECT o_orderkey, bool_or(CASE WHEN o_orderstatus = 'F' THEN l_returnflag IN ('A', 'R') ELSE l_returnflag = 'N' END) AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "type_class": "WITH k AS (SELECT p_type, (min(p_partkey) % 2)::INT AS r FROM part WHERE p_type <> 'SMALL' GROUP BY p_type) SELECT p_partkey, (CASE WHEN p_size % 2 = 1 THEN coalesce(r, -1) WHEN r = 1 THEN 2 ELSE -3 END)::INT AS class FROM part LEFT JOIN k USING (p_type)",
    "distinct_exploded": "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents",
    "trimmed_stats": f"WITH b AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events), a AS (SELECT {_STATS} FROM events), t AS (SELECT {_STATS} FROM events, b WHERE value BETWEEN lo AND hi), u AS (UNPIVOT a ON n, mean, median, std, min, max, p25, p75, cv INTO NAME stat VALUE original), v AS (UNPIVOT t ON n, mean, median, std, min, max, p25, p75, cv INTO NAME stat VALUE trimmed) SELECT stat, round(original, 4) AS original, round(trimmed, 4) AS trimmed, round(CASE WHEN original = 0 THEN 'infinity'::DOUBLE ELSE (trimmed - original) / original * 100 END, 4) AS pct_change FROM u JOIN v USING (stat)",
    "event_sequence": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, ts, list_position(['view', 'click', 'error', 'purchase'], event_type) AS p FROM events WHERE event_type IN ('view', 'click', 'error', 'purchase')),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS r, 0 AS n, 0::BIGINT AS m, []::TIMESTAMP[] AS t FROM e UNION ALL
SELECT w.user_id, e.r, CASE WHEN e.p = n + 1 THEN (n + 1) % 4 ELSE n END, CASE WHEN e.p = 4 AND n = 3 THEN m + 1 ELSE m END, CASE WHEN e.p = n + 1 THEN CASE WHEN n = 0 THEN [e.ts] ELSE list_append(t, e.ts) END ELSE t END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1),
d AS (SELECT user_id, m, n, t, lag(m) OVER (PARTITION BY user_id ORDER BY r) AS before FROM w)
SELECT user_id, m - 1 AS match, (floor(epoch(t[2])) - floor(epoch(t[1])))::BIGINT AS phase_1, (floor(epoch(t[3])) - floor(epoch(t[2])))::BIGINT AS phase_2, (floor(epoch(t[4])) - floor(epoch(t[3])))::BIGINT AS phase_3, (floor(epoch(t[4])) - floor(epoch(t[1])))::BIGINT AS total FROM d WHERE m > before""",
    "marker_filter": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(range(0, len(ls)))::INT AS n, unnest(ls) AS line FROM l) SELECT doc_id, n, mark FROM (SELECT doc_id, n, CASE WHEN contains(line, 'token') THEN 1 WHEN contains(line, 'the') THEN 2 WHEN contains(line, 'und') THEN 3 WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN 4 END AS mark FROM x) WHERE mark IS NOT NULL",
    "localized_time": "SELECT event_id, floor(epoch(ts))::BIGINT AS epoch FROM events",
    "line_nesting": "WITH r AS (SELECT *, unnest(range(l_linenumber, l_linenumber + l_quantity::INT % 11)) AS line FROM lineitem) SELECT l_orderkey, line::INT AS line, count(*) AS depth, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS owner FROM r GROUP BY ALL",
    "negative_sample": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 2",
    "linear_head": "WITH l AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * CASE WHEN i % 2 = 1 THEN 0.5::DOUBLE ELSE -0.25::DOUBLE END)) AS a, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * CASE WHEN i % 3 = 1 THEN 0.125::DOUBLE ELSE 0.0625::DOUBLE END)) AS b FROM embeddings) SELECT vec_id, round(1 / (1 + exp(b - a)), 5) AS p0, (CASE WHEN a >= b THEN 0 ELSE 1 END)::BIGINT AS class FROM l",
    "windowed_events": "SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "union_results": "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation",
    "except_set": "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
    "intersect_set": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier",
    "case_filters": "WITH t AS (SELECT d.doc_id, source, CASE WHEN quality IS NULL THEN 'unknown' WHEN len(string_split(text, chr(10))) < 3 THEN 'short' WHEN starts_with(source, 'src1') THEN 'test' WHEN toxic = 1 THEN 'runtime' ELSE 'kept' END AS cohort FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), a AS (SELECT *, bool_or(cohort = 'kept') OVER (PARTITION BY source) AS any_kept FROM t) SELECT doc_id, source, cohort FROM a WHERE cohort = 'kept' OR NOT any_kept",
}
