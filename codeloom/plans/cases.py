"""Queries over cases, nodes, prompts and requests, on the star tables as stand-ins (see each query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import cases, closure, enrich, kb, metrics, nodes
from codeloom.plans.facts import part_parents, table

TEMPLATES = {"background": "B. ", "question": "Q? ", "input_format": "IN", "baseline_input_format": "BASE", "api_question": "What of {str1}? ", "api_format": "API", "throw_question": "Why `{str1}`? ", "throw_format": "T {str1}"}


def allowed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources that are not denied."""
    return cases.allowed(table(spark, sf_dir, "documents"), "source", ["src0", "src3"]).select("doc_id", "source")


def _typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the flags of their lines as exception types."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")))).alias("types"))


def runtime_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases one of whose types is runtime; those are the flags with 1 that occur on a line of more than 49 pieces."""
    runtime = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_linenumber % 3 = 1").select(F.concat("l_returnflag", F.lit("1")).alias("name")).distinct()
    return cases.any_of(_typed_orders(spark, sf_dir), "types", runtime).select("l_orderkey", F.array_join("types", ",").alias("types"))


def left_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether something is left: checked is null, empty or a list, by order status."""
    none = F.array().cast("array<string>")
    checked = F.when(F.col("o_orderstatus") == "O", none).when(F.col("o_orderstatus") == "F", F.array("o_orderpriority"))
    unchecked = F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderstatus")).otherwise(none)
    return table(spark, sf_dir, "orders").select("o_orderkey", cases.has_findings(checked, unchecked).alias("left"), tx.exception_list(checked, unchecked).alias("shown"))


def unchanged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose text did not change have changed 0 and empty results; a null result equals a null text."""
    q = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.nullif("l_returnflag", F.lit("R")).alias("methodBefore"), F.nullif("l_linestatus", F.lit("O")).alias("methodResult"),
        F.array("l_linenumber").alias("resultBeforeTargetNoNestingLines"), q.alias("resultBeforeTargetStartLine"),
    )
    out = cases.with_changed(rows, "methodBefore", "methodResult", F.col("l_linenumber") % 2)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "changed", F.size("resultBeforeTargetNoNestingLines").alias("n_lines"), F.col("resultBeforeTargetStartLine").alias("start"))


def made_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive copies and negative cases of documents as examples."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"), F.concat(F.lit("p"), "doc_id").alias("patch"), F.concat("lang", F.lit(".f()")).alias("methodName"), F.lit("f").alias("method_name"), F.concat("source", F.lit("/F.java")).alias("file_path"),
        F.col("lang").alias("methodBefore"), F.array("lang").alias("exceptionTypes"), F.col("n_chars").cast("int").alias("beforeTargetStartLine"), F.lit(1).alias("label"), F.lit(5).alias("changed"), F.array(F.lit(1)).alias("resultExceptionTypes"),
    )
    both = cases.add_results(cases.positive(rows), cases.negative(rows, F.concat("repo_id", F.lit(".g()")), F.lit("g")))
    return both.select("repo_id", "patch", "methodName", "method_name", "file_path", "methodBefore", F.size("exceptionTypes").alias("n_types"), "beforeTargetStartLine", "label", F.coalesce("changed", F.lit(-9)).alias("changed"), F.coalesce(F.size("resultExceptionTypes"), F.lit(-1)).alias("n_results"))


def case_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of a status and priority, or none."""
    return cases.lookup(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["o_orderkey"]).select("o_orderkey", "o_custkey")


def next_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document without a label."""
    return cases.next_undone(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], ["doc_id"]).select("doc_id", "source")


def clone_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as repositories, with the url that the index of suppliers' nations has."""
    index = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("full_name"), F.concat(F.lit("git://"), "s_name").alias("clone_url"))
    return cases.clone_urls(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("full_name")), index).select("c_custkey", F.coalesce("clone_url", F.lit("")).alias("clone_url"))


def flat_map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.flat_map_json(table(spark, sf_dir, "nation"), "n_name", "n_regionkey")


def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order, whether none or some of its lines came back."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_returnflag") == "R").alias("flags"))
    none, some = metrics.membership_counts(F.col("flags"))
    return per.select("l_orderkey", none.alias("none"), some.alias("some"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of classes of parts: `mod<size>/src/<type>/<Name>.java`."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("mod"), F.col("p_size") % 3, F.lit("/src/"), F.lower("p_type"), F.lit("/"), F.initcap(F.substring_index("p_name", " ", 1)), F.lit(".java")).alias("path")).distinct()


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of each class; nested ones climb to the outermost."""
    name = F.concat(F.lower("p_type"), F.lit("."), F.initcap(F.substring_index("p_name", " ", 1)))
    classes = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(name, F.lit(".Inner"))).otherwise(name).alias("class"))
    return nodes.class_file(classes, _files(spark, sf_dir))


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of a part's class, one for each part: file, name, seq."""
    first = F.initcap(F.substring_index("p_name", " ", 1))
    name = F.concat(F.lower("p_type"), F.lit("."), first, F.lit("."), F.element_at(F.split("p_name", " "), -1), F.lit("("), F.when(F.col("p_size") % 2 == 0, "int").otherwise(""), F.lit(")"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("mod"), F.col("p_size") % 3, F.lit("/src/"), F.lower("p_type"), F.lit("/"), first, F.lit(".java")).alias("file"), name.alias("name"), F.col("p_partkey").alias("seq"))


_METHODS_SQL = "m AS (SELECT 'mod' || p_size % 3 || '/src/' || lower(p_type) || '/' || upper(p_name[1]) || lower(string_split(p_name, ' ')[1][2:]) || '.java' AS file, lower(p_type) || '.' || upper(p_name[1]) || lower(string_split(p_name, ' ')[1][2:]) || '.' || string_split(p_name, ' ')[-1] || '(' || CASE WHEN p_size % 2 = 0 THEN 'int' ELSE '' END || ')' AS name, p_partkey AS seq FROM part)"


def signature_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each file, the last method that ends in a signature, and how many others are beside it."""
    methods = _methods(spark, sf_dir)
    targets = methods.select("file", F.substring_index("name", ".", -1).alias("target")).distinct()
    found, negatives = nodes.roots_by_file(targets, methods)
    return found.join(negatives.groupBy("file", "target").agg(F.countDistinct("negative").alias("n")), ["file", "target"], "left").select("file", "target", "name", F.coalesce("n", F.lit(0)).alias("negatives"))


def roots_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods found by their qualified name, through the file of their class."""
    methods = _methods(spark, sf_dir)
    return nodes.roots_by_name(methods.select(F.col("name").alias("query")).distinct(), methods, _files(spark, sf_dir))


def api_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parts as API methods throw: the brands of equal supplier lines, and `@throws` tags of a comment, which win; names become qualified by type."""
    part = table(spark, sf_dir, "part")
    comment = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Text.\n@throws "), F.substring_index("p_name", " ", 1), F.lit(" if "), "p_brand", F.lit("\n@throws Extra  always")))
    methods = part.select(F.col("p_partkey").alias("method"), comment.alias("comment"))
    throws = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("method"), F.concat(F.lit("f"), "l_returnflag").alias("exception")).unionByName(part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("method"), F.substring_index("p_name", " ", 1).alias("exception")))
    known = part.select(F.concat(F.lower("p_type"), F.lit("."), F.substring_index("p_name", " ", 1)).alias("qualified_name")).distinct()
    return nodes.api_exceptions(methods, throws, known).select("method", F.explode("exceptions").alias("exception", "condition"))


def api_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes are API methods, by name with or without type parameters."""
    name = F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "_"))
    part = table(spark, sf_dir, "part")
    known = part.where("p_size % 2 = 0").select(F.concat(name, F.lit("(List<"), F.translate("p_brand", "#", ""), F.lit(">)")).alias("name"))
    return nodes.api_nodes(part.select(F.concat(name, F.lit("(List)")).alias("node")), known)


def caught_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch clauses of two words of a part's name, the first qualified by type."""
    part = table(spark, sf_dir, "part")
    clauses = part.select(F.col("p_partkey").alias("clause"), F.concat(F.substring_index("p_name", " ", 1), F.lit(" | "), F.lit("Own")).alias("declared"))
    known = part.select(F.concat(F.lower("p_type"), F.lit("."), F.substring_index("p_name", " ", 1)).alias("qualified_name")).distinct()
    return nodes.caught_qualified(clauses, known).select("clause", F.array_join("types", ",").alias("types"))


def first_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first click inside each target user's events."""
    facts = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("owner"), F.col("event_id").alias("name"), F.struct("ts", "event_id").alias("seq"))
    return nodes.first_in_method(facts, F.col("owner") % 3 == 0, "click").select("owner", F.col("name").alias("event_id"))


def throw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throw facts of errors: their class, or NO_BINDING."""
    facts = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "throw").otherwise("call").alias("kind"), F.col("user_id").cast("string").alias("owner"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("E"), F.col("event_id") % 5)).otherwise("").alias("name"), F.when(F.col("event_id") % 3 == 0, "x > 0").otherwise("").alias("detail"), F.array("event_type").alias("catches"), "event_id")
    return nodes.throw_records(facts).groupBy("method", "declaring_class").agg(F.count(F.lit(1)).alias("n"), F.count("condition").alias("conditions"), F.max("innermost_catch").alias("caught"))


def declaration_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts below 2 are throwable, those below 5 runtime."""
    parents = part_parents(spark, sf_dir)
    return nodes.declaration_class(parents, closure.ancestors(parents), 2, 5)


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How suppliers read as nodes and their lines as call sites."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.array("l_returnflag", "l_linestatus"))).alias("sites"))
    rows = per.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("s_suppkey", nodes.node_text(F.concat(F.lit("a.b."), "s_name", F.lit("(int)")), F.array(F.lit("X"), F.col("s_nationkey").cast("string"))).alias("node"), F.md5(nodes.edge_text(F.col("sites"))).alias("edge"))


def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of orders as text: API ones with conditions, throws with statements."""
    route = F.array("o_orderstatus", F.col("o_custkey").cast("string"))
    api = tx.api_finding(F.col("o_orderpriority"), route, F.create_map(F.lit("IO"), F.col("o_orderstatus"), F.lit("E"), F.lit(None).cast("string")))
    thrown = tx.throw_finding(F.col("o_orderpriority"), route, F.array(F.struct(F.lit("IO").alias("exception"), F.concat(F.lit("throw\n"), "o_orderstatus").alias("statement"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.when(F.col("o_orderkey") % 2 == 0, api).otherwise(thrown)).alias("digest"), tx.description(F.nullif("o_orderstatus", F.lit("O"))).alias("said"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each kind of finding, of the main question and of the baseline."""
    kind = F.when(F.col("turn") % 2 == 0, "API").otherwise("THROW")
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), F.col("role").alias("method"), F.concat(F.lit("throw "), "role").alias("statement"), F.col("text").alias("code"), F.lit("doc").alias("doc"))
    one = F.array(F.struct("kind", F.col("method").alias("callee"), F.lit(2).alias("depth"), F.lit("m").alias("method"), F.lit("IO").alias("exceptions"), F.nullif("method", F.lit("user")).alias("description")))
    asked = enrich.dispatched(found, TEMPLATES)
    return asked.select("conv_id", "turn", F.md5("prompt").alias("own"), F.md5(enrich.main_prompt(TEMPLATES, F.col("code"), one)).alias("main"), F.md5(enrich.baseline_prompt(TEMPLATES, F.col("code"))).alias("base"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of conversation turns, with defaults, and their text form."""
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit("Be brief,").alias("content")), F.struct("role", F.col("text").alias("content")))
    rows = table(spark, sf_dir, "conversations").withColumn("r", enrich.request("small", messages, seed=7))
    return rows.select("conv_id", "turn", "r.model", "r.temperature", "r.max_tokens", "r.stream", "r.seed", F.md5(enrich.chat_text(F.col("r.messages"))).alias("digest"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service as JSON: the first choice's content and the tokens."""
    message = F.struct(F.struct("role", F.col("text").alias("content")).alias("message"), F.lit(0).alias("index"))
    body = F.to_json(F.struct(F.array(message).alias("choices"), F.struct(F.col("turn").cast("int").alias("total_tokens")).alias("usage")))
    rows = table(spark, sf_dir, "conversations").withColumn("a", enrich.response(F.when(F.col("role") == "user", F.lit("no json")).otherwise(body)))
    return rows.select("conv_id", "turn", F.md5(F.coalesce(enrich.first_content(F.col("a")), F.lit(""))).alias("digest"), F.coalesce("a.usage.total_tokens", F.lit(-1)).alias("tokens"))


def asked_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns asked of a stub that answers JSON, in a fence for even lengths, and no JSON for empty ones."""

    def stub(question: str) -> str:
        return f'```json\n{{"answer": "{len(question)}"}}\n```' if len(question) % 2 == 0 else f'{{"answer": "{len(question)}"}}'

    asked = enrich.ask(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt")), stub, delay=0.0)
    return asked.select("conv_id", "turn", F.get_json_object("answer", "$.answer").cast("long").alias("n"))


def _adviser(question: str) -> str:
    """A stand-in for a model: by the mark in the code it names one exception, says `no catch`, or does not answer in JSON."""
    if "mark0" in question:
        return '{"remark": "why", "result": ["Error"]}' if "API" in question else '{"remark": "", "result": "no catch"}'
    return '```json\n{"remark": "", "result": "stays"}\n```' if "mark1" in question else "no json"


def advised_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of conversation turns judged by a stand-in model: what stays of two candidates."""
    found = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, "API").otherwise("THROW").alias("kind"), F.col("role").alias("method"), F.lit("throw e").alias("statement"), F.concat(F.lit("mark"), F.col("conv_id") % 3).alias("code"), F.lit("").alias("doc"), F.array(F.lit("a.b.Error"), F.lit("a.IO")).alias("candidates"),
    )
    return enrich.advised(found, TEMPLATES, _adviser, delay=0.0).select("conv_id", "turn", F.array_join("checked", ",").alias("checked"), "description", F.col("error").isNotNull().alias("failed"))


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline question of each turn to a stand-in model that gives code back in a fence, or no JSON."""

    def client(question: str) -> str:
        return '{"analysis": "a", "answer": "yes", "remark": "", "result": "```java\\nint x;\\n```"}' if "mark0" in question else "[]"

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", enrich.baseline_prompt(TEMPLATES, F.concat(F.lit("mark"), F.col("turn") % 2)).alias("prompt"))
    return enrich.answered(rows, client, delay=0.0).select("conv_id", "turn", F.coalesce("judgement", F.lit("")).alias("judgement"), F.coalesce("code", F.lit("")).alias("code"), "status")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a model that each task loads once: here one that counts words."""

    def load():
        return lambda texts: (texts.str.count(" ") > 100).astype("int32")

    return enrich.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", load).select("doc_id", "class")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.progress(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def free_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free SQL over tables made known by name, with a parameter."""
    kb.views({"kb_calls": table(spark, sf_dir, "lineitem"), "kb_methods": table(spark, sf_dir, "part")})
    return kb.select_sql(spark, "SELECT p_type, count(*) AS n FROM kb_methods JOIN kb_calls ON l_partkey = p_partkey WHERE l_quantity > :least GROUP BY p_type", least=40)


def like_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.like(table(spark, sf_dir, "part"), "p_name", "%E_ %r%").select("p_partkey", "p_name")


def migrate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose part or supplier is not taken over, by their place in the old table."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).distinct()
    found = kb.failures(old, [("l_partkey", table(spark, sf_dir, "part").where("p_size <= 45"), "p_partkey"), ("l_suppkey", table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey")], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q"])
    return found.select("row_index", "column", "value")


def row_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array sets of each order's lines: types in both halves, range with own lines, first and last places of valid lines."""
    per = table(spark, sf_dir, "orders").select("o_orderkey", F.split("o_orderpriority", "").alias("a"), F.split("o_orderstatus", "").alias("b"), F.dayofmonth("o_orderdate").alias("d"))
    place = F.transform(F.array(F.lit(1), F.lit(3), F.lit(9)), lambda x: x + F.col("d"))
    return per.select("o_orderkey", F.array_join(F.array_sort(F.array_intersect("a", F.concat("b", F.array(F.lit("U"), F.lit("E"), F.lit("-"))))), "").alias("both"), F.array_join(tx.range_and_lines(F.col("d"), F.col("d") + 2, place).cast("array<string>"), ",").alias("lines"), tx.line_range(place)["start"].alias("first"), tx.line_range(place)["end"].alias("last"))


def object_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of two objects, taken apart."""
    text = F.concat(F.lit("["), "props", F.lit(', {"e": '), F.col("event_id").cast("string"), F.lit("}]"))
    return table(spark, sf_dir, "events").select("event_id", F.size(tx.object_strings(text)).alias("n"), F.get_json_object(F.get(tx.object_strings(text), F.lit(1)), "$.e").cast("long").alias("e"), tx.declared_type(F.concat("event_type", F.lit(" e"))).alias("type"))


QUERIES = {
    f.__name__: f
    for f in (
        allowed_repositories, runtime_cases, left_findings, unchanged_cases, made_cases, case_by_keys, next_undone, clone_urls, flat_map_json, membership_flags, class_files, signature_resolve, roots_by_name, api_exceptions, api_nodes, caught_qualified,
        first_facts, throw_records, declaration_kinds, display_texts, finding_texts, prompts, requests, responses, asked_model, advised_findings, answered_questions, classified, progress, free_sql, like_lookup, migrate_failures, row_sets, object_strings,
    )
}

_CODE = "'<代码片段>' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || '<end>' || chr(10) || chr(10)"

ORACLES = {
    "allowed_repositories": "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3')",
    "runtime_cases": "WITH r AS (SELECT DISTINCT l_returnflag || '1' AS name FROM lineitem WHERE l_quantity > 49 AND l_linenumber % 3 = 1), t AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linenumber % 3 AS t FROM lineitem) SELECT l_orderkey, string_agg(t, ',' ORDER BY t) AS types FROM t GROUP BY l_orderkey HAVING bool_or(t IN (SELECT name FROM r))",
    "left_findings": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN false WHEN 'F' THEN true ELSE o_custkey % 2 = 0 END AS left, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE '' END AS shown FROM orders",
    "unchanged_cases": "WITH c AS (SELECT *, CASE WHEN nullif(l_returnflag, 'R') IS NOT DISTINCT FROM nullif(l_linestatus, 'O') THEN 0 ELSE l_linenumber % 2 END::INT AS changed FROM lineitem) SELECT l_orderkey, l_partkey, l_linenumber, changed, CASE WHEN changed = 0 THEN 0 ELSE 1 END AS n_lines, CASE WHEN changed = 0 THEN 0 ELSE l_quantity::INT END AS start FROM c",
    "made_cases": "SELECT source AS repo_id, 'p' || doc_id AS patch, lang || '.f()' AS \"methodName\", 'f' AS method_name, source || '/F.java' AS file_path, lang AS \"methodBefore\", 1 AS n_types, n_chars::INT AS \"beforeTargetStartLine\", 1 AS label, -9 AS changed, -1 AS n_results FROM documents UNION ALL SELECT source, 'p' || doc_id, source || '.g()', 'g', source || '/F.java', '', 0, 0, 0, -9, -1 FROM documents",
    "case_by_keys": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 1",
    "next_undone": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 1",
    "clone_urls": "SELECT c_custkey, coalesce(u, '') AS clone_url FROM customer LEFT JOIN (SELECT s_nationkey, min('git://' || s_name) AS u FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY s_nationkey) ON s_nationkey = c_nationkey",
    "flat_map_json": "SELECT '{' || string_agg('\"' || n_name || '\":' || n_regionkey, ',' ORDER BY n_name) || '}' AS json FROM nation",
    "membership_flags": "SELECT l_orderkey, NOT bool_or(l_returnflag = 'R') AS none, bool_or(l_returnflag = 'R') AS some FROM lineitem GROUP BY l_orderkey",
    "class_files": f"WITH {_METHODS_SQL}, c AS (SELECT DISTINCT regexp_extract(name, '^([^.]*\\.[^.]*)', 1) || CASE WHEN ends_with(name, '(int)') THEN '.Inner' ELSE '' END AS class, file FROM m), f AS (SELECT DISTINCT file, regexp_replace(file, '^[^/]*/[^/]*/', '') AS tail FROM m) SELECT class, min(f.file) AS path FROM c JOIN f ON f.tail = replace(replace(class, '.Inner', ''), '.', '/') || '.java' GROUP BY class",
    "signature_resolve": f"WITH {_METHODS_SQL}, t AS (SELECT DISTINCT file, regexp_extract(name, '([^.]*)$', 1) AS target FROM m), x AS (SELECT t.file, target, name, seq, ends_with(name, target) AS hit FROM t JOIN m USING (file)) SELECT file, target, arg_max(name, seq) FILTER (hit) AS name, count(DISTINCT name) FILTER (NOT hit) AS negatives FROM x GROUP BY file, target",
    "roots_by_name": f"WITH {_METHODS_SQL}, f AS (SELECT regexp_replace(file, '^[^/]*/[^/]*/', '') AS tail, min(file) AS file FROM m GROUP BY 1) SELECT q.name AS query, arg_max(m.name, m.seq) AS name FROM (SELECT DISTINCT name FROM m) q JOIN f ON f.tail = replace(regexp_extract(q.name, '^([^.]*\\.[^.]*)', 1), '.', '/') || '.java' JOIN m ON m.file = f.file AND ends_with(m.name, q.name) GROUP BY q.name",
    "api_exceptions": """WITH p AS (SELECT *, string_split(p_name, ' ')[1] AS w FROM part),
t AS (SELECT DISTINCT l_partkey AS method, 'f' || l_returnflag AS e FROM lineitem WHERE l_quantity > 45 AND l_partkey IN (SELECT p_partkey FROM part) UNION SELECT p_partkey, w FROM p WHERE p_size % 2 = 0),
d AS (SELECT p_partkey AS method, w AS e, 'if ' || p_brand AS c FROM p WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'Extra', 'always' FROM p WHERE p_size % 3 = 0),
m AS (SELECT method, e, c FROM d UNION ALL SELECT method, e, '' FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.method = t.method AND d.e = t.e)),
k AS (SELECT w, min(lower(p_type) || '.' || w) AS q FROM p GROUP BY w)
SELECT method, coalesce(q, e) AS exception, max(c) AS condition FROM m LEFT JOIN k ON w = e GROUP BY ALL""",
    "api_nodes": "WITH n AS (SELECT lower(p_type) || '.' || replace(p_name, ' ', '_') AS b, p_size, replace(p_brand, '#', '') AS g FROM part) SELECT x.b || '(List)' AS node, min(k.b || '(List<' || k.g || '>)') AS true_name, count(k.b) > 0 AS is_api FROM (SELECT DISTINCT b FROM n) x LEFT JOIN n k ON k.b = x.b AND k.p_size % 2 = 0 GROUP BY x.b",
    "caught_qualified": "WITH p AS (SELECT *, string_split(p_name, ' ')[1] AS w FROM part), k AS (SELECT w, min(lower(p_type) || '.' || w) AS q FROM p GROUP BY w) SELECT p_partkey AS clause, q || ',Own' AS types FROM p JOIN k USING (w)",
    "first_facts": "SELECT user_id AS owner, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY user_id",
    "throw_records": "SELECT user_id::VARCHAR AS method, CASE WHEN event_id % 2 = 0 THEN 'E' || event_id % 5 ELSE 'NO_BINDING' END AS declaring_class, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS conditions, 'error' AS caught FROM events WHERE event_type = 'error' GROUP BY ALL",
    "declaration_kinds": "WITH RECURSIVE par AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part), clo AS (SELECT child, child AS ancestor FROM par UNION ALL SELECT clo.child, par.parent FROM clo JOIN par ON par.child = clo.ancestor WHERE par.child <> par.parent) SELECT child AS name, CASE WHEN bool_or(ancestor = 5) THEN 'runtime' WHEN bool_or(ancestor = 2) THEN 'checked' ELSE 'class' END AS kind FROM clo GROUP BY child",
    "display_texts": "SELECT s_suppkey, s_name || ' [X, ' || s_nationkey || ']' AS node, md5(string_agg('{' || l_returnflag || '|' || l_linestatus || '}', ' ' ORDER BY l_returnflag, l_linestatus)) AS edge FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name, s_nationkey",
    "finding_texts": "SELECT o_orderkey, md5('method: ' || o_orderpriority || chr(10) || 'route:' || chr(10) || '    [' || o_orderstatus || ', ' || o_custkey || ']' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'exceptions:' || chr(10) || '    E:  null' || chr(10) || '    IO:  ' || o_orderstatus || chr(10) ELSE 'throws:' || chr(10) || '    IO:throw' || chr(9) || o_orderstatus || chr(10) END) AS digest, coalesce(nullif(o_orderstatus, 'O'), '') AS said FROM orders",
    "prompts": f"""SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN 'What of ' || role || '? API' || chr(10) || {_CODE} || '<api方法文档>' || chr(10) || 'doc<end>' || chr(10) || chr(10) ELSE 'Why `throw ' || role || '`? T throw ' || role || chr(10) || {_CODE} END) AS own,
md5('B. Q? IN' || chr(10) || {_CODE} || '<函数调用 1>' || chr(10) || '代码片段中的函数：' || role || chr(10) || '在经过2重调用后，' || CASE WHEN turn % 2 = 0 THEN '最终在函数:m中' || chr(10) || '可能抛出运行时异常:IO' ELSE '使用throw语句`IO`抛出异常' END || chr(10) || CASE WHEN role = 'user' THEN '' ELSE '异常说明：' || role || chr(10) END || '<end 1>' || chr(10)) AS main,
md5('B. Q? BASE' || chr(10) || {_CODE}) AS base FROM conversations""",
    "requests": """SELECT conv_id, turn, 'small' AS model, 0.5::DOUBLE AS temperature, 8192 AS max_tokens, false AS stream, 7 AS seed, md5('[' || chr(10) || '    {"role": "system", "content": "Be brief,"},' || chr(10) || '    {"role": "' || role || '", "content": "' || text || '"}' || chr(10) || ']') AS digest FROM conversations""",
    "responses": "SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN '' ELSE text END) AS digest, CASE WHEN role = 'user' THEN -1 ELSE turn END::INT AS tokens FROM conversations",
    "asked_model": "SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations",
    "advised_findings": "SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 0 THEN 'a.b.Error,a.IO' WHEN turn % 2 = 0 THEN 'a.b.Error' ELSE '' END AS checked, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 'why' ELSE '' END AS description, conv_id % 3 = 2 AS failed FROM conversations",
    "answered_questions": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'yes' ELSE '' END AS judgement, CASE WHEN turn % 2 = 0 THEN 'int x;' || chr(10) ELSE chr(10) END AS code, CASE WHEN turn % 2 = 0 THEN 'answered' ELSE 'failed' END AS status FROM conversations",
    "classified": "SELECT doc_id, (length(text) - length(replace(text, ' ', '')) > 100)::INT AS class FROM documents",
    "progress": "SELECT d AS done, t AS total, round(100 * d / t, 2) AS percent FROM (SELECT (SELECT count(*) FROM labels) AS d, (SELECT count(*) FROM documents) AS t)",
    "free_sql": "SELECT p_type, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 40 GROUP BY p_type",
    "like_lookup": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%E_ %r%'",
    "migrate_failures": "WITH r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, q) - 1 AS row_index FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS q FROM lineitem)) SELECT row_index, 'l_partkey' AS column, l_partkey::VARCHAR AS value FROM r WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) UNION ALL SELECT row_index, 'l_suppkey', l_suppkey::VARCHAR FROM r WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "row_sets": "WITH o AS (SELECT o_orderkey, dayofmonth(o_orderdate)::INT AS d, list_sort(list_distinct(list_filter(string_split(o_orderpriority, ''), lambda x: list_contains(['U', 'E', '-', o_orderstatus], x)))) AS b FROM orders) SELECT o_orderkey, array_to_string(b, '') AS both, concat_ws(',', d, d + 1, d + 1, d + 3, d + 9) AS lines, d + 1 AS first, d + 10 AS last FROM o",
    "object_strings": "SELECT event_id, 2 AS n, event_id AS e, event_type AS type FROM events",
}
