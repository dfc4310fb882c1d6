"""Queries over knowledge-base operators, on the star tables as stand-ins (see each query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import cases, closure, enrich, graph, handlers, kb, nodes
from codeloom.session import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as part -> supplier of each lineitem; ids overlap, so walks go on."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"))


def _khop(hops: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        throws = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("exception"))
        return kb.khop_throws(calls(spark, sf_dir), hops, throws)

    return query


def _khop_sql(hops: int) -> str:
    steps = ["h1 AS (SELECT DISTINCT l_partkey AS root, l_suppkey AS target FROM lineitem)"]
    steps += [f"h{k} AS (SELECT DISTINCT h.root, e.target FROM h{k - 1} h JOIN h1 e ON e.root = h.target)" for k in range(2, hops + 1)]
    return f"WITH {', '.join(steps)} SELECT root, count(*) AS targets, count(DISTINCT s_nationkey) AS exceptions, min(target) AS least FROM h{hops} JOIN supplier ON s_suppkey = target GROUP BY root"


def part_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree: the parent of n is n div 2; 0 is its own parent."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))


def subtype_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.ancestors(part_parents(spark, sf_dir)).select("child", "ancestor", F.col("distance").cast("long").alias("distance"))


def is_runtime_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = closure.ancestors(part_parents(spark, sf_dir))
    names = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")).distinct()
    return closure.is_runtime(names, found, 5)


def local_chain_until_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("name"))
    return closure.chain_until(part_parents(spark, sf_dir), known).select("start", "node", F.col("distance").cast("long").alias("distance"))


_CLOSURE = "WITH RECURSIVE par AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part), clo AS (SELECT child, child AS ancestor, 0 AS distance FROM par UNION ALL SELECT clo.child, par.parent, distance + 1 FROM clo JOIN par ON par.child = clo.ancestor WHERE par.child <> par.parent)"


def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return kb.first_write(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "day", "l_quantity"])


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("comment"))
    updates = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("comment"), "ts", "event_id")
    return kb.last_write(customers, updates, "c_custkey", "comment", ["ts", "event_id"])


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return kb.insert_or_ignore(existing, rows, ["id"], ["name"])


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.violations(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


def migrate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls_ = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    good, bad = kb.migrate(calls_.distinct(), [("l_partkey", table(spark, sf_dir, "part").where("p_size <= 45"), "p_partkey"), ("l_suppkey", table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey")])
    return good.select("*", F.lit("copied").alias("state")).unionByName(bad.select("*", F.lit("missed").alias("state"))).groupBy("l_suppkey", "state").agg(F.count(F.lit(1)).alias("n"))


def cascade_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 100).alias("new"))
    one = lambda name, key, col: kb.rename(table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(col).alias("nation")), "nation", mapping).select(F.lit(name).alias("of"), "id", "nation")
    return one("customer", "c_custkey", "c_nationkey").unionByName(one("supplier", "s_suppkey", "s_nationkey"))


def skip_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.skip_done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


def semi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return kb.present(table(spark, sf_dir, "orders"), late, ["o_orderkey"]).select("o_orderkey", "o_custkey")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`type.name(Map<K,V>)`-like method names of parts; every odd size has type parameters."""
    base = F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "_"), F.lit("("))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(base, F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("List<"), F.translate("p_brand", "#", ""), F.lit(">)"))).otherwise("List)")).alias("name"))


_NAMES_SQL = "SELECT p_partkey, lower(p_type) || '.' || replace(p_name, ' ', '_') || '(' || CASE WHEN p_size % 2 = 1 THEN 'List<' || replace(p_brand, '#', '') || '>)' ELSE 'List)' END AS name FROM part"


def exact_then_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    asked = names.select(F.concat(F.substring_index("name", "(", 1), F.lit("(List<T>)")).alias("query")).unionByName(names.select(F.col("name").alias("query")))
    return kb.exact_then_erased(asked, names)


def simple_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "_")).alias("qualified_name"))
    asked = table(spark, sf_dir, "part").select(F.translate("p_name", " ", "_").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).distinct()
    return kb.resolve_simple(asked, known)


def suffix_lookup_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("."), "p_name").alias("name"))
    return kb.suffix_like(names, "name", "Widget", "like").select("p_partkey", "name")


def suffix_lookup_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("."))).alias("name"))
    return kb.suffix_like(names, "name", "widget").select("p_partkey", "name")


def answer_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (a part's brand and type, each before its name) that end in one of an answer's short names, which are parts of the name."""
    answer = F.split("p_name", " ")
    candidates = F.array(F.concat_ws(".", "p_brand", F.element_at(answer, -1)), F.concat_ws(".", "p_type", F.lower("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(enrich.matched_exceptions(answer, candidates), ",").alias("matched"))


def method_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal file and name, different text: lines of a part with one line number, returned (old) and not (new)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("name"), F.col("l_quantity").alias("text"), "l_returnflag")
    return handlers.paired(rows.where("l_returnflag = 'R'").drop("l_returnflag"), rows.where("l_returnflag != 'R'").drop("l_returnflag"), ["file"]).select("file", "name", "before", "after")


def edge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"), F.array("l_returnflag").alias("catch_types"))
    return graph.edges_from_sites(rows).select("caller", "callee", F.size("sites").cast("long").alias("n_sites"), F.array_join(F.array_sort(F.flatten("sites")), ",").alias("caught"))


#: A small exception hierarchy over nations: the parent of n is n div 2.
def _nation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.ancestors(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child"), F.expr("cast(n_nationkey div 2 as int)").alias("parent")))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: each lineitem, catching the type of its line number and type 3."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"), F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity").alias("site_id"), F.array(F.col("l_linenumber"), F.lit(3)).alias("catch_types"))


def edge_caught_all_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_catches(_sites(spark, sf_dir), _nation_closure(spark, sf_dir))


def _case_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases by brand: a root (-1 - brand number) that calls the brand's parts nobody else calls, and the calls below."""
    part = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("case_id"), "p_partkey")
    edges = calls(spark, sf_dir).distinct()
    entry = part.join(edges.select(F.col("callee").alias("p_partkey")).distinct(), "p_partkey", "left_anti").select((-1 - F.col("case_id")).alias("caller"), F.col("p_partkey").alias("callee"))
    roots = part.select("case_id", (-1 - F.col("case_id")).alias("root")).distinct()
    return roots, edges.unionByName(entry)


_API = "(SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0)"
_CASES_SQL = """RECURSIVE e0 AS (SELECT DISTINCT l_partkey AS caller, l_suppkey AS callee FROM lineitem),
p AS (SELECT regexp_extract(p_brand, '[0-9]+')::BIGINT AS case_id, p_partkey FROM part),
e AS (SELECT * FROM e0 UNION SELECT -1 - case_id, p_partkey FROM p WHERE p_partkey NOT IN (SELECT callee FROM e0)),
seen AS (SELECT DISTINCT case_id, -1 - case_id AS node, 0 AS level FROM p UNION SELECT case_id, callee, level + 1 FROM seen JOIN e ON caller = node WHERE level < 12),
lv AS (SELECT case_id, node, min(level) AS level FROM seen GROUP BY ALL),
tree AS (SELECT b.case_id, b.node, b.level, min(a.node) AS parent FROM lv b LEFT JOIN e ON e.callee = b.node LEFT JOIN lv a ON a.case_id = b.case_id AND a.node = e.caller AND a.level = b.level - 1 WHERE b.level = 0 OR a.node IS NOT NULL GROUP BY ALL)"""


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges = _case_graph(spark, sf_dir)
    return graph.spanning_trees(roots, edges).select("case_id", "node", F.coalesce("parent", "node").alias("parent"), F.col("level").cast("long").alias("level"))


def uncaught_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions (suppliers' nations) that no call site set on the path catches."""
    roots, edges = _case_graph(spark, sf_dir)
    throws = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("method"), F.col("s_nationkey").alias("exception"))
    found = graph.uncaught(graph.spanning_trees(roots, edges), edges, throws, _sites(spark, sf_dir), _nation_closure(spark, sf_dir))
    return found.select("case_id", "method", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "exception")


def api_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees and findings whose API leaves (suppliers that the knowledge base knows by name) are reached but not entered."""
    roots, edges = _case_graph(spark, sf_dir)
    known = table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("name"))
    every = edges.select(F.col("callee").cast("string").alias("node")).distinct()
    api = staged(nodes.api_nodes(every, known).where("is_api").select(F.col("node").cast("long").alias("name")), "api")
    throws = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("method"), F.col("s_nationkey").alias("exception"))
    trees = graph.spanning_trees(roots, edges, api)
    found = graph.uncaught(trees, edges, throws, _sites(spark, sf_dir), _nation_closure(spark, sf_dir), api)
    counts = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("method").alias("n_methods"))
    levels = trees.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("level").alias("levels"))
    return levels.join(counts, "case_id", "left").select("case_id", "n_nodes", "levels", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("n_methods", F.lit(0)).alias("n_methods"))


_CATCHES_SQL = """nc AS (SELECT n_nationkey AS child, n_nationkey AS ancestor FROM nation UNION ALL SELECT nc.child, nc.ancestor // 2 FROM nc WHERE nc.ancestor > 0),
site AS (SELECT DISTINCT l_partkey AS caller, l_suppkey AS callee, l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem),
ok AS (SELECT caller, callee, x.n_nationkey AS exception, bool_or(nc.ancestor IN (site.l_linenumber, 3)) AS hit, l_orderkey, l_linenumber, l_shipdate, l_quantity FROM site, nation x JOIN nc ON nc.child = x.n_nationkey GROUP BY ALL),
caught AS (SELECT caller, callee, exception FROM ok GROUP BY ALL HAVING bool_and(hit))"""


def adaptive_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as findings whose path length is the priority's digit and the day's last one."""
    length = (F.substring("o_orderpriority", 1, 1).cast("int") + F.dayofmonth("o_orderdate") % 9).alias("len")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("case_id"), F.col("o_orderkey").alias("id"), length).unionByName(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").alias("id"), length))
    return graph.pruned(found, "case_id", F.col("len"))


def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = cases.grouped(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), "n_regionkey", ["n_name"])
    return lists.select("n_regionkey", F.array_join(F.transform("rows", lambda r: r["n_name"]), ",").alias("nations"))


QUERIES = {f"khop_{k}": _khop(k) for k in (1, 2, 3, 4)} | {
    f.__name__: f
    for f in (
        subtype_closure, is_runtime_flag, local_chain_until_known, first_write_wins, last_write_wins, insert_or_ignore, fk_violations, migrate_table, cascade_rename, skip_done, semi_match,
        exact_then_fuzzy, simple_name_resolution, suffix_lookup_ilike, suffix_lookup_segment, answer_suffix_match, method_pairing, edge_sites, edge_caught_all_any, bfs_levels, uncaught_findings, api_traversal, adaptive_prune, group_collect,
    )
}

ORACLES = {f"khop_{k}": _khop_sql(k) for k in (1, 2, 3, 4)} | {
    "subtype_closure": f"{_CLOSURE} SELECT child, ancestor, distance::BIGINT AS distance FROM clo",
    "is_runtime_flag": f"{_CLOSURE} SELECT o_custkey AS name, coalesce(max((ancestor = 5)::INT), -1) AS runtime FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN clo ON child = o_custkey GROUP BY o_custkey",
    "local_chain_until_known": "WITH RECURSIVE par AS (SELECT p_partkey AS child, p_partkey // 2 AS parent, p_size > 40 AS known FROM part), c AS (SELECT child AS start, child AS node, 0 AS distance FROM par WHERE NOT known AND child <> parent UNION ALL SELECT start, parent, distance + 1 FROM c JOIN par ON child = node WHERE NOT known AND child <> parent) SELECT start, node, distance::BIGINT AS distance FROM c",
    "first_write_wins": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, day FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), l_quantity) AS k FROM lineitem) WHERE k = 1",
    "last_write_wins": "SELECT c_custkey, coalesce(e, c_mktsegment) AS comment FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY user_id) ON user_id = c_custkey",
    "insert_or_ignore": "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, min(c_name) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_custkey",
    "fk_violations": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "migrate_table": "WITH r AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), g AS (SELECT *, l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 45) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS ok FROM r) SELECT l_suppkey, CASE WHEN ok THEN 'copied' ELSE 'missed' END AS state, count(*) AS n FROM g GROUP BY ALL",
    "cascade_rename": "SELECT 'customer' AS of, c_custkey AS id, CASE WHEN n_regionkey = 1 THEN c_nationkey + 100 ELSE c_nationkey END AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN n_regionkey = 1 THEN s_nationkey + 100 ELSE s_nationkey END FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
    "skip_done": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "semi_match": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)",
    "exact_then_fuzzy": f"WITH n AS ({_NAMES_SQL}), q AS (SELECT string_split(name, '(')[1] || '(List<T>)' AS query FROM n UNION SELECT name FROM n), x AS (SELECT query, name, 0 AS r FROM q JOIN n ON name = query UNION ALL SELECT query, name, 1 FROM q JOIN n ON regexp_replace(name, '<[^<>]*>', '', 'g') = regexp_replace(query, '<[^<>]*>', '', 'g')) SELECT query, name, r = 0 AS is_exact FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r, name) AS k FROM x) WHERE k = 1",
    "simple_name_resolution": "WITH k AS (SELECT replace(p_name, ' ', '_') AS s, min(lower(p_type) || '.' || replace(p_name, ' ', '_')) AS q FROM part GROUP BY 1), a AS (SELECT replace(p_name, ' ', '_') AS name FROM part UNION SELECT r_name FROM region) SELECT name, coalesce(q, name) AS qualified FROM a LEFT JOIN k ON s = name",
    "suffix_lookup_ilike": "SELECT p_partkey, lower(p_type) || '.' || p_name AS name FROM part WHERE lower(p_type) || '.' || p_name ILIKE '%Widget'",
    "suffix_lookup_segment": "SELECT p_partkey, lower(p_type) || '.' || replace(p_name, ' ', '.') AS name FROM part WHERE ends_with(lower(p_type) || '.' || replace(p_name, ' ', '.'), '.widget')",
    "answer_suffix_match": "WITH a AS (SELECT *, string_split(p_name, ' ') AS w FROM part), c AS (SELECT p_partkey, w, [p_brand || '.' || w[-1], p_type || '.' || lower(p_brand)] AS c FROM a) SELECT p_partkey, array_to_string(list_filter(c, lambda q: len(list_filter(w, lambda x: ends_with(q, x))) > 0), ',') AS matched FROM c",
    "method_pairing": "SELECT a.l_partkey AS file, a.l_linenumber AS name, a.l_quantity AS before, b.l_quantity AS after FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity <> b.l_quantity WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R'",
    "edge_sites": "SELECT l_partkey AS caller, l_suppkey AS callee, count(*) AS n_sites, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS caught FROM lineitem GROUP BY ALL",
    "edge_caught_all_any": f"WITH RECURSIVE {_CATCHES_SQL} SELECT * FROM caught",
    "bfs_levels": f"WITH {_CASES_SQL} SELECT case_id, node, coalesce(parent, node) AS parent, level::BIGINT AS level FROM tree",
    "uncaught_findings": f"""WITH {_CASES_SQL}, {_CATCHES_SQL},
walk AS (SELECT case_id, node, [node] AS path FROM tree WHERE level = 0 UNION ALL SELECT t.case_id, t.node, list_append(path, t.node) FROM walk JOIN tree t ON t.case_id = walk.case_id AND t.parent = walk.node),
cand AS (SELECT case_id, callee AS method, list_append(path, callee) AS path FROM walk JOIN e ON caller = node WHERE NOT list_contains(path, callee) UNION ALL SELECT case_id, node, path FROM walk WHERE len(path) = 1),
th AS (SELECT case_id, method, path, s_nationkey AS exception FROM cand JOIN supplier ON s_suppkey = method),
st AS (SELECT case_id, path, exception, unnest(range(1, len(path))) AS i FROM th),
bad AS (SELECT DISTINCT case_id, path, st.exception FROM st JOIN caught c ON c.caller = path[i] AND c.callee = path[i + 1] AND c.exception = st.exception)
SELECT case_id, method, array_to_string(path, '>') AS path, exception FROM th WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.case_id = th.case_id AND bad.path = th.path AND bad.exception = th.exception)""",
    "api_traversal": f"""WITH {_CASES_SQL.replace('WHERE level < 12', 'WHERE level < 12 AND node NOT IN ' + _API).replace('LEFT JOIN lv a ON', 'LEFT JOIN lv a ON a.node NOT IN ' + _API + ' AND')}, {_CATCHES_SQL},
walk AS (SELECT case_id, node, [node] AS path FROM tree WHERE level = 0 UNION ALL SELECT t.case_id, t.node, list_append(path, t.node) FROM walk JOIN tree t ON t.case_id = walk.case_id AND t.parent = walk.node),
cand AS (SELECT case_id, callee AS method, list_append(path, callee) AS path FROM walk JOIN e ON caller = node WHERE node NOT IN {_API} AND NOT list_contains(path, callee) UNION ALL SELECT case_id, node, path FROM walk WHERE len(path) = 1),
th AS (SELECT case_id, method, path, s_nationkey AS exception FROM cand JOIN supplier ON s_suppkey = method),
st AS (SELECT case_id, path, exception, unnest(range(1, len(path))) AS i FROM th),
bad AS (SELECT DISTINCT case_id, path, st.exception FROM st JOIN caught c ON c.caller = path[i] AND c.callee = path[i + 1] AND c.exception = st.exception),
left_ AS (SELECT * FROM th WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.case_id = th.case_id AND bad.path = th.path AND bad.exception = th.exception))
SELECT t.case_id, n_nodes, levels, coalesce(n_findings, 0) AS n_findings, coalesce(n_methods, 0) AS n_methods FROM (SELECT case_id, count(*) AS n_nodes, sum(level)::BIGINT AS levels FROM tree GROUP BY case_id) t LEFT JOIN (SELECT case_id, count(*) AS n_findings, count(DISTINCT method) AS n_methods FROM left_ GROUP BY case_id) f ON f.case_id = t.case_id""",
    "adaptive_prune": """WITH f0 AS (SELECT *, left(o_orderpriority, 1)::INT + dayofmonth(o_orderdate) % 9 AS len FROM orders), f AS (SELECT o_orderstatus AS case_id, o_orderkey AS id, len::INT AS len FROM f0 UNION ALL SELECT o_custkey::VARCHAR, o_orderkey, len::INT FROM f0),
c AS (SELECT case_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER (len <= {n}) AS c{n}" for n in range(10, 3, -1)) + """ FROM f GROUP BY case_id),
l AS (SELECT case_id, CASE WHEN n <= 30 THEN 1000000 """ + " ".join(f"WHEN c{n} <= 30 THEN {n}" for n in range(10, 3, -1)) + """ ELSE 4 END AS lim FROM c)
SELECT case_id, id, len FROM f JOIN l USING (case_id) WHERE len <= lim""",
    "group_collect": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey",
}
