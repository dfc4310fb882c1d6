"""What the operators share: words, content keys, hashes of shingles, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import shared_dir, small_side, staged

__all__ = ["components", "doc_key", "shared_dir", "shingle_hashes", "small_side", "staged", "window_hashes", "word_hashes", "words"]

#: White space between words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
SPLIT = r"[ \t\n\x0B\f\r]+"

def words(text: Column) -> Column:
    """Words of a text, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def shingle_hashes(tokens: Column, k: int = 5) -> Column:
    """64-bit hashes of all windows of k words, in order (none for fewer than k words)."""
    ahead = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)])
    return F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(0), F.size(tokens) - k), ahead)).otherwise(F.array().cast("array<bigint>"))


def doc_key(doc_id: Column, text: Column) -> Column:
    """128 bits that identify a row by its content: rows of equal id and text share a key, all others differ."""
    known = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.when(text.isNull(), "-").otherwise("+"))
    return F.unhex(F.md5(F.concat_ws("\n", known, text)))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and the 64-bit hashes of all words of the texts, one after another."""
    split = pc.split_pattern_regex(texts.cast(pa.large_string()).fill_null(""), SPLIT)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    real = np.array([x != "" for x in coded.dictionary.to_pylist()], bool)
    index = coded.indices.to_numpy()
    keep = real[index] if len(index) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[bounds], known[index[keep]]


def window_hashes(offsets: np.ndarray, hashes: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of all windows of k words; a text of 1 to k-1 words has one window of all its words."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(offsets[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    end = np.repeat(offsets[1:], counts)
    out = np.zeros(bounds[-1], np.uint64)
    for j in range(k):
        at = start + j
        word = np.where(at < end, hashes[np.minimum(at, len(hashes) - 1)], 0) if len(hashes) else out
        out = (out * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) ^ (out >> np.uint64(29))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return bounds, out


#: Nodes with more than this share of all edges have theirs joined by broadcast: there are at most twice its inverse.
HUB = 1 / 1000


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """edges (src, dst) and the `low` of their src. Edges of hubs meet it by a broadcast of at most 2 / HUB rows, so
    no task reads all edges of one node; the others are dealt by src.
    """
    hubs = F.broadcast(least.where(F.col("degree") > max(HUB * n_edges, 100)).select("src", "low"))
    rest = edges.join(hubs.select("src"), "src", "left_anti").join(least.select("src", "low"), "src")
    return edges.join(hubs, "src").unionByName(rest)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) of an undirected graph (src, dst), by alternating large-star and small-star rounds.

    A component is named by its least node. Minima are grouped with map-side combine.
    """

    def round_(e: DataFrame, n: int) -> DataFrame:
        both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = staged(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"), F.count(F.lit(1)).alias("degree")), label)
        large = _with_least(both.where("dst > src"), least, n).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst").distinct()
        down = staged(large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), label)
        least = staged(down.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("degree")), label)
        small = _with_least(down, least, n).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        return small.unionByName(least.select("src", F.col("low").alias("dst"))).where("src != dst").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first())

    current = staged(edges.select("src", "dst").where("src != dst").distinct(), label)
    seen = state(current)
    while seen[0]:
        current = staged(round_(current, seen[0]), label)
        now = state(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(current.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
