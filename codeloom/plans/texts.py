"""Queries over scalar text functions and alignment, on the star tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import enrich
from codeloom.plans.facts import table


def newline_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.newline_count(F.col("text")).alias("n"), F.size(tx.lines(F.col("text"))).cast("long").alias("n_lines"))


def signature_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: x["l_returnflag"])
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(types.alias("types"))
    return per.select("l_orderkey", tx.signature(F.concat(F.lit("order."), F.col("l_orderkey").cast("string")), F.col("types")).alias("name"))


def strip_generics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose type parameters nest as deep as a part is big."""
    deep = F.col("p_size") % 9
    name = F.concat("p_brand", F.repeat(F.lit("<A,List"), deep), F.when(deep > 0, F.lit("<? super T>")).otherwise(""), F.repeat(F.lit(">"), deep), F.lit("."), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_generics(name).alias("bare"), tx.after_last_dot(tx.strip_generics(name)).alias("last"))


def generic_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lower("p_type"), F.lit("("), F.array_join(F.slice(F.split(F.concat("p_name", F.lit(" x")), " "), F.lit(1), F.col("p_size") % 3 + 1), ","), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tx.generic_placements(name)).alias("name"))


def char_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.char_positions(F.col("p_name"), "e").cast("array<string>"), ",").alias("places"))


def doc_throws_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as `@throws` tags: the first word is the type, the rest the condition; the last line of a type counts."""
    tagged = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("@throws "), x)), "\n")
    tags = table(spark, sf_dir, "documents").select("doc_id", tx.throws_tags(tagged).alias("tags"))
    return tags.select("doc_id", F.explode("tags").alias("type", "condition")).select("doc_id", "type", F.md5("condition").alias("condition"))


def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.with_newline(tx.strip_fence(wrapped, "json"))).alias("body"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def record_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), tx.finding_hash(F.col("source"), F.array("lang", "source"), F.array(F.lit("b"), F.lit("a"))).alias("finding"))


def example_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.concat("url", F.lit("/commit/"), F.sha1("url"))
    return table(spark, sf_dir, "pages").select("page_id", tx.example_id(F.concat(F.lit("owner/repo"), F.col("page_id").cast("string")), tx.commit_hash(patch), F.lit("run")).alias("id"))


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    prompts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(enrich.prompt("Judge {str1} turns.", [F.count(F.lit(1)).cast("string")], turns).alias("prompt"))
    return prompts.select("conv_id", F.md5("prompt").alias("digest"), F.length("prompt").alias("n"))


def normal_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", F.md5(tx.normal_line(F.col("line"))).alias("digest"))


def encoder_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.encoder_input(F.col("text"))).alias("digest"))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(tx.marked_lines(F.col("text"), F.lit(1), F.lit(3)), "\n")).alias("digest"))


def class_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.class_type(F.col("p_size") % 5 == 0, F.col("p_size") * 64).alias("class_type"), tx.source_path(F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "."))).alias("path"))


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with a stored answer, and those that still need a call."""
    cache = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("case_id")).agg(F.min_by("text", F.struct("turn", "text")).alias("answer"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("case_id")).agg(F.count(F.lit(1)).alias("questions"))
    return enrich.with_cache(asked, cache, ["case_id"]).select("case_id", "questions", "needs_call", F.md5(F.coalesce("answer", F.lit(""))).alias("digest"))


def path_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an order's suppliers, by line number."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_suppkey"])
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tx.path_parts(path).alias("p"))
    return per.select("l_orderkey", F.coalesce("p.callee", F.lit(-1)).alias("callee"), F.coalesce("p.last_caller", F.lit(-1)).alias("last_caller"), F.col("p.depth").cast("long").alias("depth"))


def map_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions from a table, overlaid by those of comments."""
    base = F.create_map(F.lit("IO"), F.col("p_name"), F.lit("Error"), F.col("p_type"))
    over = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("IO"), F.col("p_brand"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tx.overlay(base, over)).alias("type", "condition"))


def locate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's last line first stands, and the range and order of the lines it shares with its first two."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("ls"))
    kept = tx.retained(F.col("ls"), F.slice("ls", F.lit(1), F.lit(2)))
    return rows.select("doc_id", tx.locate(F.col("ls"), F.slice("ls", F.lit(-1), F.lit(1))).cast("long").alias("place"), F.size(kept).cast("long").alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        newline_count, signature_build, strip_generics, generic_placements, char_positions, doc_throws_extract, fence_strip, json_fields, record_md5, example_id, prompt_assembly, normal_line, encoder_input, marked_lines,
        class_types, cached_answers, path_accessors, map_overlay, locate_lines,
    )
}

ORACLES = {
    "newline_count": "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n, len(string_split(regexp_replace(text, '\\n+$', ''), chr(10))) AS n_lines FROM documents",
    "signature_build": "SELECT l_orderkey, 'order.' || l_orderkey || '(' || string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) || ')' AS name FROM lineitem GROUP BY l_orderkey",
    "strip_generics": "WITH n AS (SELECT p_partkey, p_brand || repeat('<A,List', p_size % 9) || CASE WHEN p_size % 9 > 0 THEN '<? super T>' ELSE '' END || repeat('>', p_size % 9) || '.' || p_name AS n FROM part), b AS (SELECT p_partkey, " + "regexp_replace(" * 10 + "n" + ", '<[^<>]*>', '', 'g')" * 10 + " AS bare FROM n) SELECT p_partkey, bare, CASE WHEN contains(bare, '.') THEN string_split(bare, '.')[-1] ELSE '' END AS last FROM b",
    "generic_placements": """WITH n AS (SELECT p_partkey, lower(p_type) AS h, (string_split(p_name || ' x', ' '))[1:p_size % 3 + 1] AS p FROM part), m AS (SELECT *, unnest(range(1, (2 ** len(p))::BIGINT)) AS b FROM n)
SELECT p_partkey, h || '(' || array_to_string(list_transform(p, lambda x, i: CASE WHEN (b >> (i - 1)) & 1 = 1 THEN x || '<*>' ELSE x END), ',') || ')' AS name FROM m""",
    "char_positions": "SELECT p_partkey, array_to_string(list_filter(range(0, length(p_name)), lambda i: p_name[i + 1] = 'e'), ',') AS places FROM part",
    "doc_throws_extract": r"WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '@throws ' || x), chr(10)) AS t FROM documents), m AS (SELECT doc_id, regexp_extract_all(t, '@throws\s+(\S+)\s+([^\n]*)', 1) AS k, regexp_extract_all(t, '@throws\s+(\S+)\s+([^\n]*)', 2) AS v FROM l), x AS (SELECT doc_id, unnest(range(0, len(k))) AS i, unnest(k) AS type, unnest(v) AS c FROM m) SELECT doc_id, type, md5(arg_max(c, i)) AS condition FROM x GROUP BY doc_id, type",
    "fence_strip": "SELECT conv_id, turn, md5(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') || chr(10)) AS body FROM conversations",
    "json_fields": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
    "record_md5": "SELECT doc_id, md5(text) AS digest, md5(source || '|' || lang || '>' || source || '|a,b') AS finding FROM documents",
    "example_id": "SELECT page_id, 'owner_repo' || page_id || '+' || left(sha1(url), 7) || '+run' AS id FROM pages",
    "prompt_assembly": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations), p AS (SELECT conv_id, 'Judge ' || count(*) || ' turns.' || chr(10) || string_agg(k || '. ' || role || ': ' || text, chr(10) ORDER BY k) AS prompt FROM t GROUP BY conv_id) SELECT conv_id, md5(prompt) AS digest, length(prompt)::INT AS n FROM p",
    "normal_line": r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM l) SELECT doc_id, n::INT AS n, md5(regexp_replace(regexp_replace(regexp_replace(line, '([()\[\]{};])', ' \1 ', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[ \t\n\x0B\f\r]{2,}', ' ', 'g')) AS digest FROM x",
    "encoder_input": "SELECT doc_id, md5('[CLS]' || replace(text, chr(10), '[SEP]')) AS digest FROM documents",
    "marked_lines": "SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(text, '\\n+$', ''), chr(10)), lambda x, i: CASE WHEN i IN (2, 3) THEN 'O ' ELSE '  ' END || x), chr(10))) AS digest FROM documents",
    "class_types": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'interface' WHEN (p_size * 64) & 1024 <> 0 THEN 'abstract class' ELSE 'class' END AS class_type, lower(p_type) || '/' || replace(p_name, ' ', '/') || '.java' AS path FROM part",
    "cached_answers": "WITH c AS (SELECT conv_id, arg_min(text, (turn, text)) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT u.conv_id AS case_id, count(*) AS questions, any_value(answer) IS NULL AS needs_call, md5(coalesce(any_value(answer), '')) AS digest FROM conversations u LEFT JOIN c ON c.conv_id = u.conv_id WHERE role = 'user' GROUP BY u.conv_id",
    "path_accessors": "WITH p AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, coalesce(p[2], -1) AS callee, CASE WHEN len(p) > 1 THEN p[len(p) - 1] ELSE -1 END AS last_caller, len(p) - 1 AS depth FROM p",
    "map_overlay": "SELECT p_partkey, 'IO' AS type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS condition FROM part UNION ALL SELECT p_partkey, 'Error', p_type FROM part",
    "locate_lines": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, list_position(ls, ls[len(ls)])::BIGINT - 1 AS place, len(list_filter(ls, lambda x: list_contains(ls[1:2], x))) AS kept FROM l",
}
