"""Joins by suffix and pattern, sweep lines, percentiles by group, doubling, arrays in splits and repeated ingest, against plain versions."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import registry
from codeloom.operators import align, cases, closure, lookup, sequence
from codeloom.sources import code
from codeloom.streaming import ingest


def words(rng, n):
    return ["".join(rng.choice("abAB.%_\\ü") for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def test_suffixes_equal_plain_endings(spark):
    rng = random.Random(1)
    names, suffixes = [*words(rng, 150), "a" * 70 + ".bb", None, ""], [*words(rng, 60), "", None, "b", "a" * 66 + ".bb"]
    n, s = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in suffixes], "suffix string")
    tests = {"end": lambda x, y: x.endswith(y), "segment": lambda x, y: x == y or x.endswith("." + y), "like": lambda x, y: x.lower().endswith(y.lower())}
    for match, fits in tests.items():
        got = sorted((r["suffix"], r["name"]) for r in lookup.suffix_join(n, s, match).collect())
        assert got == sorted({(y, x) for x in names for y in suffixes if x is not None and y is not None and fits(x, y)})
    with pytest.raises(ValueError, match="unknown match"):
        lookup.suffix_join(n, s, "other")
    assert lookup.suffix_join(n.limit(0), s).count() == lookup.suffix_join(n, s.limit(0)).count() == 0


def test_patterns_equal_ilike(spark):
    rng = random.Random(2)
    names = [*words(rng, 120), None, "50%_off"]
    patterns = ["".join(rng.choice(["a", "B", "ab", "%", "_", "\\%", "\\_", "\\\\", "."]) for _ in range(rng.randrange(0, 7))) for _ in range(80)] + ["%", "_", "", None, "50\\%\\_o%"]

    def plain(pattern):
        out = "".join(re.escape(x[1:]) if x[0] == "\\" else ".*" if x == "%" else "." if x == "_" else re.escape(x) for x in re.findall(r"\\.|.", pattern))
        return re.compile(out, re.S | re.I)

    n, p = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = sorted((r["pattern"], r["name"]) for r in lookup.pattern_join(n, p).collect())
    assert got == sorted({(y, x) for x in names for y in patterns if x is not None and y is not None and plain(y).fullmatch(x)})


def test_runs_equal_lines(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k, s := rng.randrange(30), s + rng.randrange(-1, 9)) for k in range(60)] + [("c", 1, 0, 10**6), ("c", 2, 10, 999_990)]
    df = spark.createDataFrame(rows, "g string, id int, start int, end int")
    runs = sequence.nesting_runs(df, "g").collect()
    assert sorted((r["start"], r["end"], r["depth"], r["owner"]) for r in runs if r["g"] == "c") == [(0, 10, 1, 1), (10, 999_990, 2, 2), (999_990, 10**6, 1, 1)]
    want = {}
    for g, k, s, e in rows[:60]:
        for line in range(s, e):
            want.setdefault((g, line), []).append((s, k))
    got = {(r["g"], r["line"]): (r["depth"], r["owner"]) for r in sequence.nesting(df.where("g is null or g != 'c'"), "g").collect()}
    assert got == {k: (len(v), max(v)[1]) for k, v in want.items()}
    ends = sorted((r["g"] or "", r["start"], r["end"], r["depth"], r["owner"]) for r in runs)
    assert all(not (a[0] == b[0] and a[2] == b[1] and a[3:] == b[3:]) for a, b in zip(ends, ends[1:], strict=False))
    assert sequence.nesting_runs(df.limit(0), "g").count() == 0


def test_statistics_by_group_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, rng.random(), rng.randrange(5)])) for g in ("x", "y", None) for _ in range(200)] + [("one", 3.0), ("none", None)]
    found = sequence.grouped_statistics(spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double"), ["g"], F.when(F.col("g") == "x", 0.1).otherwise(0.02)).collect()
    for g in ("x", "y", None, "one"):
        v = np.array([float(b) for a, b in rows if a == g and b is not None])
        share = 10 if g == "x" else 2
        low, high = np.percentile(v, [share, 100 - share])
        for side, w in (("original", v), ("trimmed", v[(v >= low) & (v <= high)])):
            row = next(r for r in found if r["g"] == g and r["side"] == side)
            want = [len(w), w.mean(), np.median(w), w.std(), w.min(), w.max(), *np.percentile(w, [25, 75])]
            assert np.allclose([row[c] for c in sequence.STATS[:8]], want)
    assert not [r for r in found if r["g"] == "none"]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    stages = []
    staged = closure.staged
    monkeypatch.setattr(closure, "staged", lambda df, label: (stages.append(label), staged(df, label))[1])
    n = 300
    got = closure.ancestors(spark.createDataFrame([(k, k + 1) for k in range(n)], "child int, parent int"))
    assert got.count() == (n + 1) * (n + 2) // 2 and got.where("child = 0").agg(F.max("distance")).first()[0] == n
    assert len(stages) <= 2 * 9 + 4


def test_closure_equals_breadth_first_search(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)] + [(None, 1), (2, None), (3, 3)]
    above = defaultdict(set)
    for c, p in pairs:
        if c is not None and p is not None and c != p:
            above[c].add(p)
    want = set()
    for start in {x for pair in pairs for x in pair if x is not None}:
        far, todo = {start: 0}, deque([start])
        while todo:
            at = todo.popleft()
            for p in above[at]:
                if p not in far:
                    far[p] = far[at] + 1
                    todo.append(p)
        want |= {(start, a, d) for a, d in far.items()}
    assert {tuple(r) for r in closure.ancestors(spark.createDataFrame(pairs, "child int, parent int")).collect()} == want


def test_rows_of_like_text_are_told_apart(spark):
    rows = spark.createDataFrame([(1, ["A, B"]), (1, ["A", "B"]), (1, ["A", "B"]), (2, None), (3, [])], "id int, names array<string>")
    got = cases.any_of(rows, "names", spark.createDataFrame([("B",), (None,)], "name string")).collect()
    assert [tuple(r) for r in got] == [(1, ["A", "B"])] * 2


@pytest.mark.parametrize("split", [1500, 1 << 20])
def test_arrays_in_splits_equal_the_whole(spark, tmp_path, split):
    rng = random.Random(8)
    texts = ['{"}', "}}}", "\\", '\\"', "a\nb", '"', "", "{{", "ü}\\\\", "],[", "\\}"]
    made = [{"repo_id": f"r{k}", "methodBefore": "".join(rng.choices(texts, k=rng.randrange(6))), "exceptionTypes": rng.choices(texts, k=2), "label": k, "x": {"y": {"z": rng.choice(texts)}}} for k in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(made[:40], indent=rng.choice([None, 2])))
    (tmp_path / "b.json").write_text(json.dumps(made[40:], ensure_ascii=False) + "\n")
    (tmp_path / "c.json").write_text("[]")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        found = code.array_records(spark, str(tmp_path)).collect()
        rows = code.examples_of_arrays(spark, str(tmp_path)).select("repo_id", "methodBefore", "label", "changed").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((json.loads(r["json"]) for r in found), key=lambda x: x["label"]) == made
    assert sorted(r["record_no"] for r in found if r["file"].endswith("a.json")) == list(range(40))
    assert sorted(tuple(r) for r in rows) == sorted((m["repo_id"], m["methodBefore"], m["label"], 0) for m in made)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "k int, v string")
    run = lambda at: ingest.ingest_once(spark, source, rows.schema, lambda df: df.withColumn("w", F.upper("v")), target, at, ["k"]).awaitTermination(120)
    rows.write.parquet(source)
    run(mark)
    spark.createDataFrame([(1, "b"), (2, "c")], rows.schema).write.mode("append").parquet(source)
    run(mark)
    want = [(1, "A"), (2, "C"), (None, "N")]
    read = lambda: sorted(((r["k"], r["w"]) for r in spark.read.parquet(target).collect()), key=str)
    assert read() == want
    run(mark)
    assert read() == want


def test_functions_in_sql(spark):
    spark.createDataFrame([("a.b.C",), ("x.C",), ("C",), ("a.BC",)], "name string").createOrReplaceTempView("known_names")
    assert "loom_ending" in registry.register(spark, "known_names")
    assert sorted(r[0] for r in spark.sql("SELECT name FROM loom_ending('C')").collect()) == ["C", "a.b.C", "x.C"]
    row = spark.sql("SELECT loom_simple_name('a.b.f'), loom_owner('a.b.f(x.Y)'), loom_erased('Map<K, List<V>>.Entry')").first()
    assert tuple(row) == ("f", "a.b", "Map.Entry")
    assert [tuple(r) for r in spark.sql("SELECT t.start, t.end, t.types FROM VALUES ('try {\n} catch (E e) {\n}'), (CAST(NULL AS STRING)) v(x), LATERAL loom_tries(v.x) t").collect()] == [(0, 3, "E")]


def test_endings_in_sql_are_met_by_equality(spark):
    spark.createDataFrame([("a.b.C",), ("x.C",), ("C",), ("a.BC",), ("y.",), ("",), (None,)], "name string").createOrReplaceTempView("ending_names")
    spark.createDataFrame([("C",), ("b.C",), ("",), ("BC",), (None,)], "suffix string").createOrReplaceTempView("ending_suffixes")
    registry.register(spark, "ending_names")
    met = spark.sql("SELECT s.suffix, n.name FROM ending_suffixes s, LATERAL loom_ending(s.suffix) n")
    assert sorted(map(tuple, met.collect())) == [("", ""), ("", "y."), ("BC", "a.BC"), ("C", "C"), ("C", "a.b.C"), ("C", "x.C"), ("b.C", "a.b.C")]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_small_tables_take_the_path_of_large_ones(monkeypatch):
    rng = np.random.default_rng(7)
    lines = ["a", "  a ", "T x = f();", "x = f();", "try (x = f()) {", "try (T x = f()) {", "}", "f ( a)", "f(a)"]
    pairs = [([lines[k] for k in rng.integers(0, 9, n)], [lines[k] for k in rng.integers(0, 9, m)]) for n, m in rng.integers(0, 9, (300, 2))]
    small = [align.steps(*p) for p in pairs]
    monkeypatch.setattr(align, "SMALL", -1)
    assert small == [align.steps(*p) for p in pairs]


@pytest.mark.parametrize("match", ["segment", "like"])
def test_suffixes_and_names_are_shuffled(spark, match):
    names = spark.range(100).selectExpr("concat('a.b', id) AS name")
    plan = lookup.suffix_join(names, names.selectExpr("name AS suffix"), match)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
