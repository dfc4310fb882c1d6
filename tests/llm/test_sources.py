"""Source mix and divergence audit against SQL, on odd rows, and against independent parts."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from codeloom.llm import curriculum, divergence, sql

#: Extra columns with the names that the operators use themselves.
EXTRA = ["size", "number", "at", "salt", "term", "n", "id", "p0"]


def made(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in EXTRA))


def by_sql(text, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    found = con.execute(text)
    return listed([c[0] for c in found.description], found.fetchall())


def listed(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


def rows_of(frame):
    return listed(frame.columns, frame.collect())


def corpus(seed, n):
    """A hot source, null and empty values, repeated rows, ties, one very long text, a lang of one document."""
    rng = random.Random(seed)
    words = ["Über", "straße", "naïve", "THE", "the", "of", "x9y", "日本", "a-b", "İx", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " \n", *[" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(12)]])
        rows.append((i, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "a", "B", "é", "zz", "日", None, "", "tiny"])))
    rows += [rows[5]] * 4 + [(None, "the of", "en", "hot")] * 3
    rows.append((n, " ".join(rng.choices(words, k=60_000)), "en", "a"))
    return [*rows, (n + 1, "alone here", "xx", "solo"), (n + 2, None, "yy", "none")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_sql(spark, seed):
    rows = corpus(seed, 160)
    assert rows_of(curriculum.mix(made(spark, rows))) == by_sql(sql.OP12, rows)


def test_mix_meets_its_targets_and_caps(spark):
    rows = corpus(7, 200)
    found = curriculum.mix(made(spark, rows)).toPandas()
    own = found.groupby("target").agg(taken=("taken", "sum"))
    assert all(t - 1 < x <= t for t, x in own["taken"].items()) or found["target"].duplicated().any()
    assert (found["taken"] <= 3 * found["size"]).all() and (found["target"] <= 3 * found["source_size"] + 1e-6).all()
    assert abs(found.drop_duplicates(["source_size", "target"])["target"].sum() - found["size"].sum()) < 1e-6 * found["size"].sum()
    reached = found["position"].dropna()
    assert reached.is_monotonic_increasing and 0 <= reached.min() and reached.max() <= 1


def test_levels_where_several_sources_stop(spark):
    of = spark.createDataFrame([(1, 5), (10, 2), (1000, 1), (0, 5), (3, 1)], "source_size bigint, weight bigint")
    assert [round(r["target"], 6) for r in curriculum.targets(of).collect()] == [3.0, 30.0, 972.0, 0.0, 9.0]


def test_demand_is_the_inverse_of_the_integral(spark):
    shares = spark.range(0, 100).select((F.col("id") / 100).alias("share"))
    for number, knots in enumerate(curriculum.SCHEDULES):
        whole = 0.0
        for share, t in shares.select("share", curriculum.demand_reaches(F.col("share"), F.lit(number)).alias("t")).collect():
            steps = 2000
            weight = lambda x: next(w + (w2 - w) * (x - a) / (b - a) for (a, w), (b, w2) in zip(knots, knots[1:], strict=False) if x <= b)  # noqa: E731, B023
            area = lambda end: sum(weight(end * (k + 0.5) / steps) for k in range(steps)) * end / steps  # noqa: E731, B023
            whole = whole or area(1.0)
            assert abs(area(t) / whole - share) < 1e-6


def test_visits_add_up(spark):
    mixed = curriculum.mix(made(spark, corpus(3, 80)))
    assert curriculum.visits(mixed).agg(F.sum("words")).first()[0] == mixed.agg(F.sum("taken")).first()[0]


@pytest.mark.parametrize(("seed", "pairs", "step"), [(1, 2_000_000, 4_000_000), (2, 5, 200)])
def test_audit_equals_sql(spark, monkeypatch, seed, pairs, step):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "STEP", step)
    rows = corpus(seed, 220)
    assert rows_of(divergence.audit(made(spark, rows))) == by_sql(sql.OP13, rows)


def test_vectors_are_those_of_a_count_vectorizer(spark):
    rows = [r for r in corpus(4, 150) if r[2] == "en"]
    docs = made(spark, rows).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = {r["term"]: {x["source"]: x["n"] for x in r["by_source"]} for r in divergence.vocabulary(divergence.group_sums(docs)).collect()}
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tokens = docs.select("source", F.expr(r"regexp_extract_all(translate(text, '%s', '%s'), '([^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+)', 1)" % (upper, lower)).alias("tokens"))
    model = CountVectorizer(inputCol="tokens", outputCol="v", minDF=divergence.MIN_DF, vocabSize=divergence.VOCAB_SIZE).fit(tokens)
    sums: dict = {t: {} for t in model.vocabulary}
    for r in model.transform(tokens).collect():
        for k, n in zip(r["v"].indices, r["v"].values, strict=True):
            own = sums[model.vocabulary[k]]
            own[r["source"]] = own.get(r["source"], 0) + int(n)
    assert kept == sums


def test_shares_are_exact(spark):
    cases = [(0, 1), (0, 7), (5, 6), (10**15, 3 * 10**15 + 1), (123_456_789_012, 9 * 10**15 - 1), (8 * 10**15, 9 * 10**15)]
    rows = spark.createDataFrame(cases, "c bigint, m bigint").select("c", "m", divergence.share(F.col("c"), F.col("m")).alias("p")).collect()
    assert all(p == 1 + 10**9 * (c + 1) // m for c, m, p in rows)


def test_too_many_terms_is_an_error(spark):
    docs = made(spark, corpus(4, 60)).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with pytest.raises(ValueError, match="more than 2 terms"):
        divergence.vocabulary(divergence.group_sums(docs), vocab_size=2)


def test_empty_tables(spark):
    assert curriculum.mix(made(spark, [])).count() == 0
    assert divergence.audit(made(spark, [])).count() == 0
    blank = [(1, None, None, None), (2, " ", None, "a")]
    assert [(r["taken"], r["target"], r["position"]) for r in curriculum.mix(made(spark, blank)).collect()] == [(0, 0.0, None)] * 2
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in divergence.audit(made(spark, blank)).collect()) == [("", "a", 0, 1), ("a", "", 0, 1)]
