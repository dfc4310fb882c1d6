"""Source divergence audit over exact sparse count vectors.

Count vectors are those of a CountVectorizer for each lang with min_df documents and the greatest
integer as its vocabulary size, so each term of enough documents is kept (`vocabulary`). The
vocabulary stays a table: it grows with the corpus, so it is neither gathered by the driver nor
broadcast. In a task each document becomes a sparse vector (term, count); vectors are summed
by (lang, source), element by element, in the task and then by Spark.

A group gives each kept term p = 1 + floor(10^9 * (count + 1) / (N + V)), V kept terms, N counts. The
divergence of a pair of groups is the sum of f = floor((p - q)^2 / q) over all V terms. Pairs are
evaluated sparsely: a term that neither group has adds the same f each time; what terms of
one group add to that depends on their count alone, so it is taken once for each different
count; and only terms that both groups have are evaluated for themselves, in blocks of bounded
size, whose sums by pair leave the task. All numbers are integers: quotients are made by
thousands, so they hold to 9 * 10^15 words.

Odd rows: null texts, langs and sources are empty ones; texts without terms count as documents
of their group; groups without terms take part in each pair; a lang without kept terms has value 0 in
its pairs; repeated rows count each; ties in value go by the item's UTF-8 bytes; long texts are read
whole; other columns are ignored, whatever their names; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.kb import numbered

from .common import small_side, staged

MIN_DF, VOCAB_SIZE = 3, 2**31 - 1
TOP = 200
#: What is no part of a term: ASCII but for letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Code points of text in a step of a task, and pairs of groups in one.
STEP, PAIRS = 4_000_000, 2_000_000


def _vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sparse count vectors of texts: row, code and count of each entry; the terms that codes stand for."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string())), BETWEEN)
    coded = split.flatten().dictionary_encode()
    terms = coded.dictionary
    sizes = np.diff(split.offsets.to_numpy())
    row = np.repeat(np.arange(len(texts)), sizes)
    code = coded.indices.to_numpy()
    blank = pc.index(terms, pa.scalar("", terms.type)).as_py() if len(terms) else -1
    if blank >= 0:
        row, code = row[code != blank], code[code != blank]
    entry, count = np.unique(row * max(len(terms), 1) + code, return_counts=True)
    return entry // max(len(terms), 1), entry % max(len(terms), 1), count, terms


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: sums of the vectors of each step's groups."""
    for batch in batches:
        langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
        held = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + STEP, "right")))
            pairs = list(zip(langs.slice(at, end - at).to_pylist(), sources.slice(at, end - at).to_pylist(), strict=True))
            known = {g: k for k, g in enumerate(dict.fromkeys(pairs))}
            group = np.array([known[g] for g in pairs])
            row, code, count, terms = _vectors(texts.slice(at, end - at))
            width = max(len(terms), 1)
            key, place = np.unique(group[row] * width + code, return_inverse=True)
            n, docs = np.zeros(len(key), np.int64), np.bincount(place, minlength=len(key))
            np.add.at(n, place, count)
            names = list(known)
            of = key // width
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.string()).take(pa.array(of)), pa.array([x[1] for x in names], pa.string()).take(pa.array(of)), terms.take(pa.array(key % width)).cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])
            at = end


def group_sums(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it): the sum of the count vectors of each group."""
    parts = docs.mapInArrow(_summed, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(sums: DataFrame, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """One row for each kept term: lang, term, lang_n, by_source (source, n). A lang of more than vocab_size terms is an error: none is dropped."""
    each = sums.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = staged(each.where(F.col("df") >= min_df).drop("df"), "vocabulary")
    if not kept.groupBy("lang").count().where(F.col("count") > vocab_size).isEmpty():
        raise ValueError(f"a lang has more than {vocab_size} terms")
    return kept


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / whole), by thousands."""
    whole = F.greatest(whole, F.lit(1).cast("long"))
    div = lambda a: F.call_function("div", a, whole)
    rest = count + 1
    out, rest = div(rest), rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + div(rest), rest % whole
    return out + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, value: what terms of both groups add beyond what they add alone. Rows are terms: lists of (id, p, p0)."""
    for batch in batches:
        lists = batch.column("groups")
        flat = lists.flatten()
        ids, p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "p", "p0"))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # a run: all partners of some of a term's groups, of PAIRS pairs at most unless one group has more
        runs = []
        for start, end in zip(bounds, bounds[1:], strict=False):
            step = max(1, PAIRS // max(end - start, 1))
            runs += [(a, min(a + step, end), start, end) for a in range(start, end, step)]
        table = np.array(runs, np.int64).reshape(-1, 4)
        sizes = (table[:, 1] - table[:, 0]) * (table[:, 3] - table[:, 2])
        total, at = np.cumsum(sizes), 0
        while at < len(table):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            part, n = table[at:stop], sizes[at:stop]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(part[:, 3] - part[:, 2], n)
            a, b = np.repeat(part[:, 0], n) + k // width, np.repeat(part[:, 2], n) + k % width
            a, b = a[a != b], b[a != b]
            value = _distance(p[a], p[b]) - _distance(p[a], p0[b]) - _distance(p0[a], p[b]) + _distance(p0[a], p0[b])
            known, local = np.unique(ids[np.concatenate([a, b])], return_inverse=True)
            key, place = np.unique(local[: len(a)] * max(len(known), 1) + local[len(a) :], return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, place, value)
            yield pa.RecordBatch.from_arrays([pa.array(known[key // max(len(known), 1)]), pa.array(known[key % max(len(known), 1)]), pa.array(sums)], ["a", "b", "value"])
            at = stop


def _groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each group that occurs: lang, source, id, n, lang_n, v (kept terms of the lang), p0 (p of a term it lacks)."""
    cells = terms.select("lang", F.explode("by_source").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    langs = staged(terms.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_n")), "langs")
    every = docs.select("lang", "source").distinct()
    met = every.join(cells, ["lang", "source"], "left").join(small_side(langs), F.col("lang") == F.col("_lang"), "left")
    known = met.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "lang_n", "v")))
    return numbered(known.withColumn("p0", share(F.lit(0).cast("long"), F.col("n") + F.col("v"))), ["lang", "source"], "id")


def divergences(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: each ordered pair of groups of a lang."""
    info = groups.select("lang", "source", "id", "n", "v", "p0")
    cells = terms.select("lang", "term", F.explode("by_source").alias("c")).select("lang", "term", "c.source", F.col("c.n").alias("k"))
    placed = staged(cells.join(small_side(info), ["lang", "source"]).select("lang", "term", "id", share(F.col("k"), F.col("n") + F.col("v")).alias("p"), "p0"), "placed")
    met = placed.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "p0")).alias("groups")).where(F.size("groups") > 1)
    both = met.select("groups").mapInArrow(_met, "a bigint, b bigint, value bigint").groupBy("a", "b").agg(F.sum("value").alias("value"))
    # the different counts of a group, against each other group of its lang
    counted = placed.groupBy("lang", "id", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    other = small_side(info.select("lang", F.col("id").alias("o"), F.col("p0").alias("o0")))
    p, p0, o0, times = (F.col(c) for c in ("p", "p0", "o0", "times"))
    sides = F.array(F.struct(F.col("id").alias("a"), F.col("o").alias("b"), (times * (distance(p, o0) - distance(p0, o0))).alias("value")), F.struct(F.col("o").alias("a"), F.col("id").alias("b"), (times * (distance(o0, p) - distance(o0, p0))).alias("value")))
    alone = counted.join(other, "lang").where("id != o").select(F.explode(sides).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.value").alias("value"))
    base = info.join(other, "lang").where("id != o").select(F.col("id").alias("a"), F.col("o").alias("b"), (F.col("v") * distance(p0, o0)).alias("value"))
    sums = base.unionByName(alone).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    names = lambda at, name: small_side(groups.select(F.col("id").alias(at), "lang", F.col("source").alias(name)))
    return sums.join(names("a", "source"), "a").join(names("b", "item").drop("lang"), "b").select("lang", "source", "item", "value")


def telling(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: terms that a group gives more than its lang does."""
    cells = terms.select("lang", F.col("term").alias("item"), "lang_n", F.explode("by_source").alias("c")).select("lang", "item", F.col("lang_n").alias("k_lang"), "c.source", F.col("c.n").alias("k"))
    met = cells.join(small_side(groups), ["lang", "source"])
    rated = met.select("lang", "source", "item", share(F.col("k"), F.col("n") + F.col("v")).alias("p"), share(F.col("k_lang"), F.col("lang_n") + F.col("v")).alias("q"))
    return rated.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank."""
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")))
    terms = vocabulary(group_sums(rows), min_df)
    groups = staged(_groups(rows, terms), "groups")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = divergences(terms, groups).withColumn("part", F.lit("pair")).withColumn("rank", ranked)
    told = telling(terms, groups).withColumn("part", F.lit("term")).withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.unionByName(told).select("lang", "source", "part", "item", "value", "rank")
