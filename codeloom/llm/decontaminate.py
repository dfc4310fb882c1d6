"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Windows have the size of an item (in words) and begin wherever a five-word shingle that the
window shares with some item would put an item of that size; a window that shares no shingle
with any item has similarity 0 and needs no fingerprint. Shingles weigh as often as they
occur; those outside all items weigh nothing in a fingerprint. A window's SimHash is the sign
of the weighted sum of its shingles' bits. Fingerprints are cut into BLOCKS blocks, and each
item's block stands in the index with up to FLIPS of its bits turned: two fingerprints within
RADIUS = BLOCKS * (FLIPS + 1) - 1 of each other differ in FLIPS bits or fewer in one block, so
an equality join on (size, block, bits in it) returns all pairs within the radius. A block has
16 bits, of which an item holds 137 of 65,536 values, so few other items are met.

A window has two fingerprints, by its shingles' weights and by the shingles as such (one heavy
shingle may turn most bits of the first, many light ones those of the second); either may meet
the item's of its kind. The index alone finds candidates, so a similar pair both of whose prints differ
in more than RADIUS bits is missed; README has the measured recall. Each candidate is then verified exactly: sum of
lesser weights against sum of greater weights, over all shingles of both.

All of it is DataFrame functions. Items of fewer than five words have no shingle and match
nothing, nor do null or empty texts on either side; items with a null id are kept as such;
rows of one doc_id (or item_id) with different texts are told apart when they are judged, and
give one row of their (doc_id, item_id), the best window of any of them; repeated rows add
nothing; ties between windows go to the first; long texts are read whole; other columns are
ignored (contaminated) or kept (keep_clean); either table may be empty.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, shingle_hashes, small_side, staged, words

SHINGLE = 5
BITS, BLOCKS, FLIPS = 64, 4, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: The threshold as a fraction: shared weight * DENOMINATOR >= all weight * NUMERATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Words in a stretch of a document.
STRETCH = 64


def fingerprint(shingle: Column, weight: Column) -> Column:
    """Aggregate: SimHash of a group's weighted shingles, from one sum for each bit."""
    mixed = F.xxhash64(shingle, F.lit(7))
    signs = [F.sum(F.when(F.getbit(mixed, F.lit(k)) == 1, weight).otherwise(-weight)) for k in range(BITS)]
    print_ = F.lit(0).cast("long")
    for k, total in enumerate(signs):
        print_ = print_.bitwiseOR(F.when(total > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return print_


def _printed(weights: DataFrame, keys: list[str | Column], weight: str) -> DataFrame:
    """keys, kind and print: both fingerprints of each group of (shingle, weight)."""
    both = weights.groupBy(*keys).agg(fingerprint(F.col("shingle"), F.col(weight)).alias("_0"), fingerprint(F.col("shingle"), F.lit(1)).alias("_1"))
    rest = [c for c in both.columns if c not in ("_0", "_1")]
    return both.select(*rest, F.posexplode(F.array("_0", "_1")).alias("kind", "print"))


def _in_blocks(df: DataFrame, flips: int = 0) -> DataFrame:
    """A row for each block of `print` and each way to turn up to `flips` of its bits: block number and the bits."""
    size = BITS // BLOCKS
    turned = [sum(1 << k for k in chosen) for n in range(flips + 1) for chosen in combinations(range(size), n)]
    cut = [F.struct(F.lit(n).alias("block"), F.shiftrightunsigned(F.col("print"), n * size).bitwiseAND(F.lit((1 << size) - 1).cast("long")).alias("bits")) for n in range(BLOCKS)]
    rows = df.select("*", F.explode(F.array(*cut)).alias("at")).select(*df.columns, "at.block", "at.bits")
    return rows.withColumn("turn", F.explode(F.array(*(F.lit(t).cast("long") for t in turned)))).withColumn("bits", F.col("bits").bitwiseXOR(F.col("turn"))).drop("turn") if flips else rows


#: The shingles of all items are broadcast up to this many, of 8 bytes each; beyond it the join shuffles, and Spark splits frequent ones.
VOCABULARY_ROWS = 4_000_000


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each window that holds an item: doc_id, key (of the document's content), item, item_id, size, start, shared, similarity."""
    item_words = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE).distinct()
    item_words = item_words.select(doc_key(F.col("item_id"), F.array_join("w", " ")).alias("item"), "item_id", F.size("w").alias("size"), shingle_hashes(F.col("w"), SHINGLE).alias("h"))
    placed = staged(item_words.select("item", "item_id", "size", F.posexplode("h").alias("q", "shingle")), "items")
    weights = staged(placed.groupBy("item", "item_id", "size", "shingle").agg(F.count(F.lit(1)).alias("own_weight")), "weights")
    prints = _printed(weights, ["item", "item_id", "size"], "own_weight")
    item_blocks = staged(_in_blocks(prints, FLIPS).withColumnRenamed("print", "own"), "blocks")
    item_weights = weights.select("item", "shingle", "own_weight")

    # places in documents that hold a shingle of some item
    vocabulary = staged(placed.select("shingle").distinct(), "vocabulary")
    base = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    base = base.select("doc_id", "key", F.size("w").alias("n"), shingle_hashes(F.col("w"), SHINGLE).alias("h"))
    # outer: else Spark infers a filter that splits each text again for each word
    places = base.select("doc_id", "key", "n", F.posexplode_outer("h").alias("p", "shingle"))
    hits = staged(places.join(small_side(vocabulary, VOCABULARY_ROWS), "shingle", "left_semi").distinct(), "hits")

    # windows of an item's size that a shared shingle anchors, cut at the document's ends
    spots = staged(placed.select("shingle", "q", "size").distinct(), "spots")
    anchored = hits.join(small_side(spots), "shingle").select("doc_id", "key", "n", "size", (F.col("p") - F.col("q")).alias("start"))
    begin, end = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("size"), F.col("n"))
    windows = anchored.distinct().withColumns({"begin": begin, "last": end - SHINGLE}).where("last >= begin").drop("n")

    # what each window holds, as weighted shingles; windows and hits meet in stretches of a document
    stretches = F.explode(F.sequence(F.floor(F.col("begin") / STRETCH), F.floor(F.col("last") / STRETCH)))
    in_window = windows.withColumn("stretch", stretches).join(hits.select("key", "p", "shingle", F.floor(F.col("p") / STRETCH).alias("stretch")), ["key", "stretch"]).where("p between begin and last")
    held = in_window.groupBy("doc_id", "key", "size", "start", (F.col("last") - F.col("begin") + 1).alias("all"), "shingle").agg(F.count(F.lit(1)).alias("weight"))
    held = staged(held, "held")
    prints = _printed(held, ["key", "size", "start"], "weight")

    # all pairs within the radius
    near = _in_blocks(prints).join(small_side(item_blocks), ["size", "kind", "block", "bits"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("own"))) <= RADIUS).select("key", "size", "start", "item", "item_id").distinct()

    # exact weighted similarity
    shared = near.join(held, ["key", "size", "start"]).join(small_side(item_weights), ["item", "shingle"])
    total = shared.groupBy("doc_id", "key", "item", "item_id", "size", "start", "all").agg(F.sum(F.least("weight", "own_weight")).alias("shared"))
    every = F.col("all") + F.col("size") - SHINGLE + 1 - F.col("shared")
    return total.where(DENOMINATOR * F.col("shared") >= NUMERATOR * every).withColumn("similarity", F.round(F.col("shared") / every, 6))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that it contains, in the document's best window: doc_id, item_id, start_word, n_shared, similarity."""
    best = _found(docs, items).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "shared", "size")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).alias("start_word"), F.col("best.shared").alias("n_shared"), F.col("best.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item; each row is judged by its own content, whatever id it has."""
    dirty = small_side(staged(_found(docs, items).select("key").distinct(), "dirty"))
    return docs.join(dirty, doc_key(docs["doc_id"], docs["text"]) == dirty["key"], "left_anti")
