"""Operators on hand-made rows: order, nulls, ties and empty input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import align, cases, closure, enrich, graph, handlers, kb, metrics, nodes, sequence
from codeloom.session import staged
from codeloom.sources import code
from codeloom.streaming import ingest


def test_first_write_skips_nulls_and_keeps_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), ("b", 1, None)], "k string, seq int, v string")
    got = kb.insert_or_ignore(spark.createDataFrame([("c", 0, "old")], df.schema), df, ["k"], ["seq"])
    assert {tuple(r) for r in got.collect()} == {("c", 0, "old"), ("a", 1, "y"), ("b", 1, None)}
    assert kb.first_write(df.limit(0), ["k"], ["seq"]).count() == 0


def test_last_write_keeps_a_null_update(spark):
    table = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, comment string")
    updates = spark.createDataFrame([("a", "x", 1), ("a", None, 2)], "k string, comment string, seq int")
    assert {tuple(r) for r in kb.last_write(table, updates, "k", "comment", ["seq"]).collect()} == {("a", None), ("b", "2")}


def test_erased_names(spark):
    names = spark.createDataFrame([("a.f(Collector<? super T,A,R>)",), ("a.g(int)",)], "name string")
    asked = spark.createDataFrame([("a.f(Collector)",), ("a.g(int)",), ("a.h()",)], "query string")
    got = {r["query"]: (r["name"], r["is_exact"]) for r in kb.exact_then_erased(asked, names).collect()}
    assert got == {"a.f(Collector)": ("a.f(Collector<? super T,A,R>)", False), "a.g(int)": ("a.g(int)", True)}


def test_generic_placements(spark):
    df = spark.createDataFrame([("java.something.abc(p1,p2,p3)",), ("f()",), ("f(a)(b)",)], "n string")
    assert [len(r[0]) for r in df.select(tx.generic_placements(F.col("n"))).collect()] == [7, 0, 0]


def test_suffix_matches(spark):
    df = spark.createDataFrame([("java.io.IOException",), ("java.io.UncheckedIOException",)], "n string")
    assert kb.suffix_like(df, "n", "IOException").count() == 1
    assert kb.suffix_like(df, "n", "ioexception", "like").count() == 2


def test_closure_with_self_parent_and_cycle(spark):
    parents = spark.createDataFrame([("R", "E"), ("E", "T"), ("T", "T"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r["child"], r["ancestor"]) for r in closure.ancestors(parents).collect()}
    assert got == {("R", "R"), ("R", "E"), ("R", "T"), ("E", "E"), ("E", "T"), ("T", "T"), ("x", "x"), ("x", "y"), ("y", "y"), ("y", "x")}
    names = spark.createDataFrame([("R",), ("T",), ("?",)], "name string")
    assert {tuple(r) for r in closure.is_runtime(names, closure.ancestors(parents), "E").collect()} == {("R", 1), ("T", 0), ("?", -1)}


def test_uncaught_paths(spark):
    parents = closure.ancestors(spark.createDataFrame([("IO", "E"), ("E", "E")], "child string, parent string"))
    sites = spark.createDataFrame([("m", "a", 1, ["E"]), ("m", "b", 2, []), ("a", "x", 3, []), ("b", "x", 4, ["IO"]), ("b", "x", 5, []), ("x", "m", 6, [])], "caller string, callee string, site_id int, catch_types array<string>")
    catches = graph.edge_catches(sites, parents)
    assert {(r["caller"], r["callee"], r["exception"]) for r in catches.collect()} == {("m", "a", "E"), ("m", "a", "IO")}
    trees = graph.spanning_trees(spark.createDataFrame([(1, "m")], "case_id int, root string"), sites)
    throws = spark.createDataFrame([("x", "IO"), ("m", "E")], "method string, exception string")
    got = {(r["method"], tuple(r["path"]), r["exception"]) for r in graph.uncaught(trees, sites, throws, sites, parents).collect()}
    assert got == {("m", ("m",), "E"), ("x", ("m", "b", "x"), "IO")}
    walk = graph.depth_first(spark.createDataFrame([(1, "m")], "case_id int, root string"), sites.select(F.lit(1).alias("case_id"), "caller", "callee"))
    assert {r["node"]: r["path"] for r in walk.collect()} == {"m": ["m"], "a": ["m", "a"], "x": ["m", "a", "x"], "b": ["m", "b"]}


def test_prune_like_the_loop(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.randint(1, 14)) for c in range(12) for i in range(rng.choice([5, 31, 60, 90]))]
    got = {(r["case_id"], r["i"]) for r in graph.pruned(spark.createDataFrame(rows, "case_id int, i int, len int"), "case_id", F.col("len")).collect()}
    want = set()
    for c in range(12):
        kept, layer = [r for r in rows if r[0] == c], 10
        while len(kept) > 30 and layer > 3:
            kept, layer = [r for r in kept if r[2] <= layer], layer - 1
        want |= {(r[0], r[1]) for r in kept}
    assert got == want


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "t boolean, p boolean")
    assert tuple(metrics.confusion(empty, F.col("t"), F.col("p")).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_phases_restart(spark):
    rows = [("u", i, p) for i, p in enumerate("abacbcc")]
    df = spark.createDataFrame(rows, "u string, i int, p string").withColumn("at", F.timestamp_seconds("i"))
    got = sequence.phase_matches(df, "u", [F.col("p") == x for x in "abc"], ["i"]).select(F.unix_timestamp("t1"), F.unix_timestamp("t2"), F.unix_timestamp("t3"))
    assert [tuple(r) for r in got.collect()] == [(0, 1, 3)]


def test_localized_time(spark):
    df = spark.createDataFrame([("5月 07, 2025 12:54:13 下午",), ("11月 01, 2025 12:00:01 上午",), ("no",)], "t string")
    assert [str(r[0]) for r in df.select(tx.localized_time(F.col("t")).cast("string")).collect()] == ["2025-05-07 12:54:13", "2025-11-01 00:00:01", "None"]


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
@settings(max_examples=150, deadline=None)
def test_alignment_is_monotone_and_matches_equal_lines(old, new):
    match = align.align(old, new)
    taken = [(i, j) for j, i in enumerate(match) if i >= 0]
    assert taken == sorted(taken) and len({i for i, _ in taken}) == len(taken)
    assert all(old[i] == new[j] for i, j in taken)
    assert (old == new) <= (match == list(range(len(new))))
    script = align.edit_script(old, new)
    assert [x[1:] if x[0] == " " else x[2:].split(" -> ")[0] for x in script if x[0] != "+"] == old
    assert [x[1:] if x[0] == " " else x[2:].split(" -> ")[-1] for x in script if x[0] != "-"] == new


def test_alignment_forms():
    assert align.align(["int x = f();"], ["x = f();"]) == [0]
    assert align.align(["R r = open();"], ["try (r = open();) {"]) == [0]
    assert align.align(["R r = open();"], ["try (R r = open()) {"]) == [-1]
    assert align.align(["\tfoo( a );", "b"], ["foo(a);", " b\t"]) == [0, 1]
    assert align.align(["a = b"], ["a=b"]) == [-1]  # blanks count beside all but brackets and semicolons
    assert align.align(["int\tx = f();"], ["x = f();"]) == [-1]  # ends, though nothing can be taken off
    assert align.edit_script(["head", "a", "tail"], ["head", "b", "tail", "end"]) == [" head", "~ a -> b", " tail", "+ end"]


def test_ask_retries_and_parses(spark):
    def client(question):
        if "bad" in question:
            return "no json"
        if "down" in question:
            raise ConnectionError("down")
        return '```json\n{"answer": "yes"}\n```'

    df = spark.createDataFrame([("ok",), ("bad",), ("down",)], "prompt string")
    got = {r["prompt"]: (r["answer"], r["error"]) for r in enrich.ask(df, client, delay=0.0).collect()}
    assert got["ok"] == ('{"answer": "yes"}', None) and got["bad"] == (None, "no JSON object") and got["down"][1].startswith("ConnectionError")


def test_sources(spark, tmp_path):
    root = tmp_path / "src" / "main"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "b" / "C.java").write_text("package a.b;\nclass C {}\n")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "D.java").write_text("class D {}")
    files = code.source_files(spark, str(tmp_path), ["skip"])
    root_of = code.source_root(F.col("path"), F.col("content"))
    got = files.select("path", root_of.alias("root")).select("path", "root", code.class_name(F.col("path"), F.col("root")).alias("name")).collect()
    assert [tuple(r) for r in got] == [("src/main/a/b/C.java", "src/main", "a.b.C")]
    assert code.examples_or_none(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "x.json").write_text('[{"repo_id": "r", "label": 1, "other": 2}]')
    row = code.examples(spark, str(tmp_path / "x.json")).first()
    assert (row["repo_id"], row["label"], row["changed"]) == ("r", 1, 0)


def test_resumable_ingest_adds_nothing_twice(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(source)
    for more in (None, [(2, "b"), (3, "c")]):
        if more:
            spark.createDataFrame(more, rows.schema).write.mode("append").parquet(source)
        ingest.resumable(spark, source, rows.schema, lambda df: df.withColumn("w", F.upper("v")), target, mark, ["k"]).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [(1, "a", "A"), (2, "b", "B"), (3, "c", "C")]


def test_long_texts_are_aligned(spark):
    old = [f"line {k};" for k in range(6000)]
    new = [x for k, x in enumerate(old) if k % 10] + ["end;"]
    rows = spark.createDataFrame([(1, "\n".join(old), "\n".join(new)), (2, None, "x")], "id int, a string, b string")
    got = {r["id"]: r for r in align.aligned(rows, "a", "b").collect()}
    assert got[1]["matched"] == [k for k in range(6000) if k % 10] + [-1] and got[1]["status"] == "aligned"
    assert got[2]["matched"] is None and got[2]["status"] == "missing"


def test_chains_end_on_cycles_and_count_nodes_once(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y"), ("x", "z"), ("y", "K"), ("z", "K"), ("K", "top")], "child string, parent string")
    got = {tuple(r) for r in closure.chain_until(parents, spark.createDataFrame([("K",)], "name string")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1), ("x", "x", 0), ("x", "y", 1), ("x", "z", 1), ("x", "K", 2), ("y", "y", 0), ("y", "K", 1), ("z", "z", 0), ("z", "K", 1)}


def test_generics_of_any_depth_and_unbalanced(spark):
    names = ["A" + "<A" * 8 + ">" * 8, "Map<K,List<V>>.x", "a>b", "a<b", "a<b>c>d<e", "", None]

    def plain(text):
        if text is None:
            return None
        out, depth = "", 0
        for c in text:
            if c == "<":
                depth += 1
            elif c == ">":
                depth = max(depth - 1, 0)
            elif not depth:
                out += c
        return out

    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(tx.strip_generics(F.col("n"))).collect()] == [plain(n) for n in names]


def test_lookup_takes_the_tested_names(spark):
    known = ["build.tools.projectcreator.BuildConfig.init(Vector<String>,Vector<String>)", "java.util.stream.Stream.collect(Collector<? super T,A,R>)", "java.util.Collections.indexedBinarySearch(List<? extends Comparable<? super T>>,T)"]
    asked = {known[0]: known[0], "java.util.stream.Stream.collect(Collector)": known[1], "java.util.Collections.indexedBinarySearch(List,T)": known[2]}
    got = kb.exact_then_erased(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(n,) for n in known], "name string"))
    assert {r["query"]: r["name"] for r in got.collect()} == asked


@pytest.mark.parametrize("n", [0, 1, 2, 101])
def test_percentiles_and_row_numbers(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(50)) for _ in range(n)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)] + [(None, -1)], "v double, k int").repartition(5)
    got = sequence.percentiles(df, "v", [0.0, 0.02, 0.5, 0.75, 1.0])
    want = [float(np.percentile(values, p)) for p in (0, 2, 50, 75, 100)] if n else [None] * 5
    assert got == pytest.approx(want) if n else got == want
    numbered = kb.numbered(df.where("v is not null"), ["v", "k"]).collect()
    assert [(r["v"], r["k"]) for r in sorted(numbered, key=lambda r: r["row_index"])] == sorted((v, k) for k, v in enumerate(values)) and sorted(r["row_index"] for r in numbered) == list(range(n))


def test_zones_by_counting_lines(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(0, 12), rng.randrange(12), rng.randrange(12), [rng.randrange(14) for _ in range(rng.randrange(4))], rng.randrange(12), rng.randrange(14)) for _ in range(200)]
    got = metrics.zone_coverage(spark.createDataFrame(rows, "n_lines int, start int, end int, own array<int>, p_start int, p_end int")).first().asDict()
    want = dict.fromkeys(got, 0)
    for n, start, end, own, ps, pe in rows:
        hits = {"own": [0, 0], "nested": [0, 0], "outside": [0, 0]}
        for line in range(n):
            zone = "own" if line in own else "nested" if start <= line < end else "outside"
            hits[zone][ps <= line < pe] += 1
        for zone, (miss, hit) in hits.items():
            want[f"{zone}_miss"] += miss
            want[f"{zone}_hit"] += hit
        want["start_hits"] += bool(own) and own[0] < n and ps <= own[0] < pe
        miss, hit = hits["own"]
        want["half_covered"] += miss + hit > 0 and 2 * hit >= miss + hit
    assert got == want


def test_added_tries_know_their_accepted_ancestors(spark):
    before = "void f() {\n  a();\n  b();\n}"
    nested = "void f() {\n  try {\n    a();\n    try {\n      b();\n    } catch (final E1 e) {\n      x();\n    }\n  } catch (E2 e) {\n  }\n}"
    rows = [(1, before, nested), (2, nested, nested), (3, before, before), (4, None, nested), (5, before, 'void f() {\n  log("try { catch");\n}'), (6, "", "try catch"), (7, before, before.replace("a();", "try {\n;\n} finally {\n}\na(); // catch"))]
    out = {r["id"]: r for r in handlers.method_diff(spark.createDataFrame(rows, "id int, b string, a string"), "b", "a").collect()}
    assert [c["exceptionTypes"] for c in out[1]["changes"]] == [["E2"], ["E1"]]
    outer, inner = out[1]["changes"]
    assert (outer["beforeTargetStartLine"], outer["beforeTargetEndLine"], outer["afterTargetStartLine"], outer["afterTargetEndLine"]) == (1, 3, 1, 10)
    assert (inner["beforeTargetNoNestingLines"], inner["afterTargetNoNestingLines"]) == ([2], [3, 4, 5, 6, 7])
    assert all(not out[k]["changes"] for k in (2, 3, 4, 5, 6, 7)) and out[4]["error"] == "no old text"
    assert [t["types"] for t in handlers.try_statements("try (A a = b()) { } catch (X | Y e) { } finally { } try { unclosed")] == [["X"]]


def test_api_nodes_throw_what_table_and_document_say(spark):
    methods = spark.createDataFrame([("m", "Does.\n@throws IO when closed\n@throws IO if shut"), ("n", None), ("o", "none")], "method string, comment string")
    throws = spark.createDataFrame([("m", "IO"), ("m", "Arg"), ("n", "Arg"), ("n", "Arg")], "method string, exception string")
    known = spark.createDataFrame([("java.io.IO",), ("other.IO",)], "qualified_name string")
    got = {r["method"]: r["exceptions"] for r in nodes.api_exceptions(methods, throws, known).collect()}
    assert got == {"m": {"java.io.IO": "if shut", "Arg": ""}, "n": {"Arg": ""}, "o": {}}


def test_cases_take_odd_rows(spark):
    rows = spark.createDataFrame([("junit-team/junit5", ["IO"]), ("a/b", []), (None, None), ("a/b", ["RT", "IO"]), ("a/b", ["RT", "IO"])], "repo string, types array<string>")
    assert cases.allowed(rows, "repo").count() == 4
    assert cases.any_of(rows, "types", spark.createDataFrame([("RT",)], "name string")).count() == 2
    assert cases.lookup(rows, {"repo": "x"}, ["repo"]).count() == 0
    lists = spark.createDataFrame([(None, ["a"]), ([], ["a"]), (["b"], None), (None, None)], "c array<string>, u array<string>")
    assert [r[0] for r in lists.select(cases.has_findings(F.col("c"), F.col("u"))).collect()] == [True, False, True, False]
    assert kb.select_sql(spark, "SELECT nothing FROM nowhere") is None
    with pytest.raises(ValueError):
        kb.only_row(rows)
    with pytest.raises(Exception, match="no commit"):
        rows.select(tx.commit_hash(F.col("repo"), strict=True)).collect()


def test_requests_and_dispatch(spark):
    with pytest.raises(ValueError):
        enrich.request("m", F.array(), colour=1)
    templates = {"api_question": "{str1}{str1}", "api_format": "f", "throw_question": "$1 {str1}", "throw_format": "\\ {str1}"}
    rows = spark.createDataFrame([("API", "a$1", None, "c", None), ("THROW", None, "t\\x", "c", None)], "kind string, method string, statement string, code string, doc string")
    api, thrown = (r["prompt"] for r in enrich.dispatched(rows, templates).collect())
    assert api.startswith("a$1a$1f\n<代码片段>") and thrown.startswith("$1 t\\x\\ t\\x\n")
    with pytest.raises(Exception, match="unknown kind"):
        enrich.dispatched(rows.withColumn("kind", F.lit("?")), templates).collect()


def test_settings_and_templates_of_folders(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "t").mkdir()
    odd = ["# no\n! no\nroot = /a/b\nname: x=y\nlong = a\\\nb\n\n", "", "a = 1\r\na: 2\nalone\n  b  c d  \n#a=3", "k =\n"]
    for k, text in enumerate(odd):
        (tmp_path / "s" / f"{k}.properties").write_bytes(text.encode())
    got = {}
    for r in code.settings(spark, str(tmp_path / "s")).collect():
        got.setdefault(int(r["file"][-12]), {})[r["name"]] = r["value"]
    assert got == {0: {"root": "/a/b", "name": "x=y", "long": "ab"}, 2: {"a": "2", "b": "c d"}, 3: {"k": ""}}
    for k in (0, 2):
        assert got[k] == code.properties(str(tmp_path / "s" / f"{k}.properties"))
    for k, text in enumerate(['{"q": "a {str1}", "n": 5, "e": ""}', "[1]", "no", ""]):
        (tmp_path / "t" / f"{k}.json").write_text(text)
    assert {(r["name"], r["template"]) for r in code.template_texts(spark, str(tmp_path / "t")).collect()} == {("q", "a {str1}"), ("n", "5"), ("e", "")}


def test_settings_templates_and_whole_replacement(spark, tmp_path):
    (tmp_path / "c.properties").write_text("# no\n! no\nroot = /a/b\nname: x=y\nlong = a\\\nb\n\n")
    assert code.properties(str(tmp_path / "c.properties")) == {"root": "/a/b", "name": "x=y", "long": "ab"}
    (tmp_path / "t.json").write_text('{"q": "a {str1}"}')
    assert code.templates(str(tmp_path / "t.json")) == {"q": "a {str1}"}
    at = str(tmp_path / "out")
    code.replace_json(spark.createDataFrame([(1,), (2,)], "k int"), at)
    code.replace_json(spark.read.json(at).where("k = 2"), at)  # reads what it replaces
    assert [r["k"] for r in spark.read.json(at).collect()] == [2] and [p.name for p in tmp_path.iterdir() if ".new-" in p.name or ".old-" in p.name] == []


def test_log_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = code.log_lines(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["line_no"]: r["line"] for r in got} == {k: f"line {k}" for k in range(5000)}


def test_phases_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("u", i, p) for i, p in enumerate([1, 2, 1, 1, 3, 2, 3, 3])], "u string, i int, phase int").withColumn("at", F.timestamp_seconds("i"))
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows.write.parquet(source)
    found = ingest.phases_stream(spark.readStream.schema(rows.schema).parquet(source), "u", 3)
    query = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).trigger(availableNow=True).start()
    assert ingest.stop(query, 120)
    whole = sequence.phase_matches(rows, "u", [F.col("phase") == k for k in (1, 2, 3)], ["i"])
    pick = lambda df, a, b: sorted((r["u"], r["match"], r[a], r[b]) for r in df.collect())
    assert pick(spark.read.parquet(target), "first", "last") == pick(whole, "t1", "t3") and whole.count() == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from codeloom import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError):
        session.shared_dir(far)


def test_broadcast_sides_are_bounded_by_bytes(spark):
    from codeloom.session import small_side

    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert "BroadcastHashJoin" in spark.range(9).join(small_side(wide), "id")._jdf.queryExecution().toString()
    plan = spark.range(9).hint("merge").join(small_side(wide, size=10_000), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, k % 3) for k in range(0, 400, 7)] + [("b", 399, 1)], "kind string, s int, v int").withColumn("at", F.timestamp_seconds("s"))
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows.write.parquet(source)
    found = ingest.windowed(spark.readStream.schema(rows.schema).parquet(source), "at", "1 minute", "10 seconds", "kind", "v")
    query = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    assert ingest.stop(query, 120)
    closed = {(str(r["window"]["start"]), r["kind"], r["n"], r["total"]) for r in spark.read.parquet(target).collect()}
    every = {(str(r["window"]["start"]), r["kind"], r["n"], r["total"]) for r in ingest.event_windows(rows, "at", "1 minute", "kind", "v").collect()}
    assert closed <= every and len(closed) == 6  # the last minute is still open


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_reached_throws_equal_the_walk(spark, hops):
    rng = np.random.default_rng(hops)
    pairs = [(f"m{a}", f"m{b}") for a, b in rng.integers(0, 150, (400, 2))] + [(None, "m1"), ("m2", None), ("m3", "m3")]
    calls = spark.createDataFrame(pairs + pairs[:50], "caller string, callee string")
    thrown = [(f"m{a}", int(e) if e else None) for a, e in rng.integers(0, 130, (170, 2))] + [("m1", 5), ("m1", 5), (None, 4)]
    throws = spark.createDataFrame(thrown, "target string, exception int")
    want = kb.khop(calls, hops).join(throws, "target").groupBy("root").agg(F.count(F.lit(1)), F.countDistinct("exception"), F.min("target"))
    got = kb.khop_throws(calls, hops, throws)
    assert got.columns == ["root", "targets", "exceptions", "least"]
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in want.toDF(*got.columns).collect())


def test_edges_of_a_kind_catch_alike(spark):
    """Against plain sets; the plan has no row for each (site, exception), so an edge is met once by its kind."""
    rng = np.random.default_rng(5)
    above = {k: {k, k // 2, k // 4, k // 8, 0} for k in range(12)}
    parents = spark.createDataFrame([(k, a) for k, of in above.items() for a in of], "child int, ancestor int")
    rows = [(int(a), int(b), int(s), [int(t) for t in rng.integers(0, 12, n)]) for a, b, s, n in rng.integers([0, 0, 0, 0], [4, 4, 3, 4], (60, 4))] + [(None, 1, 0, [0]), (9, 9, 0, None), (9, 9, 1, [0]), (8, 8, 0, None), (8, 8, 0, [1])]
    sites: dict = {}
    for a, b, s, types in rows:
        sites.setdefault((a, b), {}).setdefault(s, set()).update(types or [])
    want = {(a, b, e) for (a, b), of in sites.items() for e in above if all(above[e] & types for types in of.values())}
    table = spark.createDataFrame(rows, "caller int, callee int, site_id int, catch_types array<int>")
    got = [tuple(r) for r in graph.edge_catches(table, parents).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    asked = spark.createDataFrame([(int(a), int(b), int(e)) for a, b, e in rng.integers(0, 12, (500, 3))], "caller int, callee int, exception int")
    assert {tuple(r) for r in graph.edge_catches(table, parents, asked).collect()} == want & {tuple(r) for r in asked.collect()}
    edges, caught = graph.edge_kinds(table, parents)
    assert edges.count() == len(sites) and caught.groupBy("kind", "exception").count().where("count > 1").isEmpty()


def test_uncaught_keeps_no_row_for_each_candidate_and_exception(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "staged", lambda df, label: kept.append(df.count()) or staged(df, label))
    edges = spark.createDataFrame([("r", f"m{k}") for k in range(10)] + [(f"m{k}", f"n{k}") for k in range(10)], "caller string, callee string")
    throws = spark.createDataFrame([(f"n{k}", e) for k in range(10) for e in range(12)], "method string, exception int")
    # m0 > n0 catches 0 to 5 by 5's children, r > m1 catches 7, and r > m2 has a site that catches nothing
    parents = spark.createDataFrame([(e, e) for e in range(12)] + [(e, 5) for e in range(5)], "child int, ancestor int")
    sites = spark.createDataFrame([("m0", "n0", 1, [5]), ("r", "m1", 2, [7]), ("r", "m2", 3, [8]), ("r", "m2", 4, [])], "caller string, callee string, site_id int, catch_types array<int>")
    trees = graph.spanning_trees(spark.createDataFrame([(1, "r")], "case_id int, root string"), edges)
    kept.clear()
    got = {(r["method"], ">".join(r["path"]), r["exception"]) for r in graph.uncaught(trees, edges, throws, sites, parents).collect()}
    want = {(f"n{k}", f"r>m{k}>n{k}", e) for k in range(10) for e in range(12)}
    assert got == want - {("n0", "r>m0>n0", e) for e in range(6)} - {("n1", "r>m1>n1", 7)}
    # the throws themselves are the largest table
    assert sorted(kept)[-1] == 120 and sorted(kept)[-2] < 60
