"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every document becomes its set of five-word shingles. Documents with equal sets form one
*copy group*, whose fingerprint stands for it from there on. Each of TREES trees labels a
fingerprint with DEEPEST hashes, the least ones of its shingles. The labels of a tree, sorted,
are its prefix trie: neighbours that agree in their first d hashes lie in one node of depth d.
One pass over the sorted labels walks the tries (`_walk`) and emits each pair of texts with
the longest prefix they share in some tree.

Pairs are verified from the longest prefixes to shorter ones. After each depth every text has
its own estimate of recall (`recall_at`): a partner of similarity s is met at depth d or below
with chance 1 - (1 - s^d)^TREES, so each partner found stands for the inverse of its chance, and
one more, unseen, is always assumed at the threshold. A text whose estimate reaches TARGET asks no
further; the others shorten their prefix by one hash. A pair is compared while one of the two still asks. At
`floor_depth` a text without any partner reaches the target, so no prefix gets shorter.

Nodes of more than NODE texts do not pair their members. All texts of such nodes are joined
exactly instead: a pair that reaches the threshold shares one of each text's rarest shingles
(prefix filter), so texts that share such shingles gather in clusters, which a passage that
many texts have in common does not join. A cluster is compared in blocks of texts, in numpy,
which emit the links' number for each text and a spanning forest, never the pairs. So recall
is 1 in crowded nodes and TARGET or more elsewhere.

Results for odd input: null, empty and blank texts have no shingles, link to nothing and are
their own class; texts of one to four words have one shingle, all their words; a repeated row
is a copy; null ids get a row too; long texts are read whole; extra columns are ignored,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, doc_key, staged, window_hashes, word_hashes

TREES = 24
DEEPEST = 6
TARGET = 0.99999
NODE = 40
#: Texts in a block of a cluster: of BLOCK up to BLOCKS blocks, then more, up to LARGE; and bytes of packed text.
BLOCK, BLOCKS, LARGE, BLOCK_BYTES = 256, 64, 1024, 2 << 20
SHINGLE = 5
#: The threshold as a fraction, so that ties are exact: |a and b| * DENOMINATOR >= |a or b| * NUMERATOR.
NUMERATOR, DENOMINATOR = 4, 5
SLICE = 400
#: Buckets of the table that orders shingles from rare to frequent.
BUCKETS = 1 << 20


def met(similarity: float, depth: int) -> float:
    """The chance that two texts of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def floor_depth() -> int:
    """The longest prefix at which a text without partners reaches the target."""
    for depth in range(DEEPEST, 0, -1):
        if met(NUMERATOR / DENOMINATOR, depth) >= TARGET:
            return depth
    raise ValueError("more trees are needed for this recall")


def recall_at(depth: int, found: Column, expected: Column) -> Column:
    """A text's recall at a depth. found: partners; expected: for how many of that depth they stand."""
    return (found + 1) / (expected + 1 / met(NUMERATOR / DENOMINATOR, depth))


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = TREES * DEEPEST
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    bounds, hashes = window_hashes(*word_hashes(texts), SHINGLE)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


#: Columns of a label: its prefixes from the floor to the deepest, each as one hash.
_PREFIXES = [f"prefix_{d}" for d in range(floor_depth(), DEEPEST + 1)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, print, labels: for each tree the prefixes of the text's label."""
    mult, add = _hash_family()
    for batch in (s for b in batches for s in _slices(b)):
        sets = shingle_sets(batch.column("text"))
        sizes = np.array([len(x) for x in sets])
        real = np.flatnonzero(sizes)
        prints = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
        labels: list = [None] * len(sets)
        if len(real):
            flat = np.concatenate([sets[i] for i in real])
            starts = np.concatenate([[0], np.cumsum(sizes[real])[:-1]])
            path = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(real), TREES))
            kept = []
            for level in range(DEEPEST):
                least = np.stack([np.minimum.reduceat(flat * m + a, starts) for m, a in zip(mult[level::DEEPEST], add[level::DEEPEST], strict=True)], 1)
                path = (path ^ least) * np.uint64(0x9E3779B97F4A7C15)
                path = path ^ (path >> np.uint64(31))
                kept.append(path)
            grid = np.stack(kept[-len(_PREFIXES) :], 2)
            for i, row in enumerate(real):
                labels[row] = grid[i].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints, pa.binary()), pa.array(labels, pa.binary())], ["doc_id", "key", "print", "labels"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print and the prefixes of its label, a row for each tree."""
    for batch in (s for b in batches for s in _slices(b)):
        grid = np.frombuffer(b"".join(batch.column("labels").to_pylist()), np.int64).reshape(-1, len(_PREFIXES))
        prints = batch.column("print").take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))
        yield pa.RecordBatch.from_arrays([prints, *(pa.array(np.ascontiguousarray(c)) for c in grid.T)], ["print", *_PREFIXES])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks sorted labels as tries: (src, dst, depth) of texts that share a prefix, of depth hashes; (print, null, null) of texts in a node of
    more than NODE at the floor, which give no pairs. At most NODE labels are held.
    """
    node: list[tuple[list, bytes]] = []  # labels and texts of the open node at the floor
    first, crowded = None, False
    src: list[bytes] = []
    dst: list[bytes | None] = []
    depths: list[int | None] = []

    def close() -> None:
        for n, (label, text) in enumerate(node):
            for other, partner in node[:n]:
                depth = floor_depth()
                for a, b in zip(label[1:], other[1:], strict=True):
                    if a != b:
                        break
                    depth += 1
                src.append(min(text, partner)), dst.append(max(text, partner)), depths.append(depth)
        node.clear()

    def full() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary()), pa.array(depths, pa.int32())], ["src", "dst", "depth"])
        src.clear(), dst.clear(), depths.clear()
        return out

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in _PREFIXES]
        prints = batch.column("print")
        # rows alone at the floor pair with nobody; only the others are walked
        same = np.flatnonzero(columns[0][1:] == columns[0][:-1])
        walked = np.union1d(np.union1d(same, same + 1), [0, batch.num_rows - 1][: batch.num_rows]).astype(int)
        for i in walked:
            label, text = [c[i] for c in columns], prints[i].as_py()
            if label[0] != first:
                close()
                first, crowded = label[0], False
            if not crowded and len(node) == NODE:
                crowded = True
                src.extend(member for _, member in node), dst.extend([None] * NODE), depths.extend([None] * NODE)
                node.clear()
            if crowded:
                src.append(text), dst.append(None), depths.append(None)
            else:
                node.append((label, text))
        yield full()
    close()
    yield full()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in (s for b in batches for s in _slices(b)):
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["key", "packed"])


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return shingle_sets(pa.array([unpack(x).decode() for x in blobs], pa.large_string()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in _slices(b)):
        left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
        known: dict[bytes, np.ndarray] = {}
        fresh = list(dict.fromkeys(left + right))
        known.update(zip(fresh, _unpacked(fresh), strict=True))
        both = np.array([len(known[a]) + len(known[b]) - len(np.union1d(known[a], known[b])) for a, b in zip(left, right, strict=True)], np.int64)
        either = np.array([len(known[a]) + len(known[b]) for a, b in zip(left, right, strict=True)], np.int64) - both
        rows = pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(both / np.maximum(either, 1))], ["src", "dst", "similarity"])
        yield rows.filter(pa.array(DENOMINATOR * both >= NUMERATOR * either))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, texts): in how many texts of a batch each bucket of shingles occurs."""
    for batch in (s for b in batches for s in _slices(b)):
        sets = _unpacked(batch.column("packed").to_pylist())
        buckets, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) % np.uint64(BUCKETS), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(counts.astype(np.int64))], ["bucket", "texts"])


def _prefixes(crowd: DataFrame) -> DataFrame:
    """(print, shingle): the rarest n - ceil(0.8 n) + 1 shingles of each text.

    Any order that is the same for all texts makes the filter exact. Rare ones go first by a
    table of fixed size, the texts that each of BUCKETS buckets of shingles occurs in.
    """
    counted = crowd.mapInArrow(_bucket_counts, "bucket int, texts bigint").groupBy("bucket").agg(F.sum("texts").alias("texts")).toPandas()  # BUCKETS rows at most
    table = np.zeros(BUCKETS, np.int64)
    table[counted["bucket"]] = counted["texts"]
    known = crowd.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = known.value
        for batch in (s for b in batches for s in _slices(b)):
            rows, shingles = [], [np.zeros(0, np.uint64)]
            for print_, x in zip(batch.column("print").to_pylist(), _unpacked(batch.column("packed").to_pylist()), strict=True):
                often = texts[x % np.uint64(BUCKETS)]
                first = np.lexsort((x, often))[: len(x) - math.ceil(len(x) * NUMERATOR / DENOMINATOR) + 1]
                first = first[often[first] > 1]  # one that is alone links nothing
                rows += [print_] * len(first)
                shingles.append(x[first])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(np.concatenate(shingles).view(np.int64))], ["print", "shingle"])

    return crowd.mapInArrow(run, "print binary, shingle bigint")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, one fewer than the texts of each component."""
    open_, edges = set(range(len(linked))), []
    while open_:
        stack = [open_.pop()]
        while stack:
            at = stack.pop()
            near = [int(x) for x in np.flatnonzero(linked[at]) if int(x) in open_]
            open_.difference_update(near)
            edges += [(at, x) for x in near]
            stack += near
    return edges


def _block_links(part: pd.DataFrame) -> pd.DataFrame:
    """Links between the texts of two blocks of a cluster (or within one): for each text how many
    documents it links to, and the edges of a spanning forest.
    """
    sets = _unpacked(part["packed"].tolist())
    sizes = np.array([len(x) for x in sets])
    shingles, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(shingles), -1)
    place[shared] = np.arange(len(shared))
    column = place[index]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), 4096):
        inside = (column >= at) & (column < at + 4096)
        grid = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        grid[row[inside], column[inside] - at] = 1
        both += grid @ grid.T
    both = np.rint(both).astype(np.int64)
    linked = DENOMINATOR * both >= NUMERATOR * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    edges = _forest(linked)
    if part["low"].iloc[0] != part["high"].iloc[0]:  # pairs within a block are counted where it meets itself
        block = part["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    prints = part["print"].to_numpy()
    counts = pd.DataFrame({"print": prints, "other": None, "links": linked @ part["copies"].to_numpy()})
    forest = pd.DataFrame({"print": [prints[a] for a, _ in edges], "other": [prints[b] for _, b in edges], "links": 0})
    return pd.concat([counts[counts["links"] > 0], forest], ignore_index=True) if edges else counts[counts["links"] > 0]


def _compared(crowd: DataFrame, weights: DataFrame) -> DataFrame:
    """All links among the texts of `crowd` (print, packed), exactly: rows (print, null, links) and forest edges (print, other, 0)."""
    prefix = staged(_prefixes(crowd), "prefix")
    least = prefix.groupBy("shingle").agg(F.min("print").alias("src"), F.max("print").alias("top")).where("src < top").drop("top")
    clusters = components(prefix.join(least, "shingle").select("src", F.col("print").alias("dst")), "clusters")

    members = staged(clusters.select(F.col("node").alias("print"), F.col("component").alias("cluster")).join(crowd.select("print", F.length("packed").alias("bytes")), "print"), "members")
    texts = F.count(F.lit(1))
    many = F.greatest(texts / LARGE, F.least(texts / BLOCK, F.lit(BLOCKS)), F.sum("bytes") / BLOCK_BYTES)
    blocks = members.groupBy("cluster").agg(F.ceil(many).cast("int").alias("blocks"))
    dealt = members.drop("bytes").join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")).join(weights, "print").join(crowd, "print")
    met_ = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return staged(met_.groupBy("cluster", "low", "high").applyInPandas(_block_links, "print binary, other binary, links bigint"), "compared")


def _finished(edges: DataFrame, depth: int) -> DataFrame:
    """(print): the texts whose recall has reached the target at this depth. edges: verified so far, with similarity."""
    ends = edges.select(F.col("src").alias("print"), "similarity").unionByName(edges.select(F.col("dst").alias("print"), "similarity"))
    chance = 1 - F.pow(1 - F.pow("similarity", F.lit(depth)), F.lit(TREES))
    own = ends.groupBy("print").agg(F.count(F.lit(1)).alias("found"), F.sum(1 / chance).alias("expected"))
    return own.where(recall_at(depth, F.col("found"), F.col("expected")) >= TARGET).select("print")


def _verified_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst, similarity) of the pairs that reach the threshold, from the longest shared prefixes to shorter ones."""
    left, right = (texts.select(F.col("print").alias(at), F.col("packed").alias(name)) for at, name in (("src", "left"), ("dst", "right")))
    edges = None
    for depth in range(DEEPEST, floor_depth() - 1, -1):
        todo = pairs.where(F.col("depth") == depth).select("src", "dst")
        if edges is not None:
            done = staged(_finished(edges, depth + 1), "done")
            closed = lambda at: done.select(F.col("print").alias(at), F.lit(True).alias(f"{at}_done"))  # noqa: E731,B023
            todo = todo.join(closed("src"), "src", "left").join(closed("dst"), "dst", "left").where("src_done is null or dst_done is null").select("src", "dst")
        found = staged(todo.join(left, "src").join(right, "dst").mapInArrow(_verified, "src binary, dst binary, similarity double"), "edges")
        edges = found if edges is None else edges.unionByName(found)
    return edges


def _classified(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (of its content), component (of its shingles; null without any), class_id, copy_id, n_links."""
    source = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    signed = staged(source.mapInArrow(_signatures, "doc_id bigint, key binary, print binary, labels binary"), "signed")
    groups = signed.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("copy_id"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"))
    groups = staged(groups, "groups")
    weights = groups.select("print", "copies")

    # the tries: labels dealt by their prefix at the floor and sorted
    labels = groups.select("print", "labels").mapInArrow(_labels, "print binary, " + ", ".join(f"{c} bigint" for c in _PREFIXES))
    walked = labels.repartition(_PREFIXES[0]).sortWithinPartitions(*_PREFIXES).mapInArrow(_walk, "src binary, dst binary, depth int")
    walked = staged(walked, "walked")
    crowded = walked.where("dst is null").select(F.col("src").alias("print")).distinct()
    paired = walked.where("dst is not null").groupBy("src", "dst").agg(F.max("depth").alias("depth"))
    ends = paired.select(F.col("src").alias("print")).unionByName(paired.select(F.col("dst").alias("print"))).distinct()
    standing = ends.select("print", F.lit(0).alias("c")).unionByName(crowded.select("print", F.lit(1).alias("c"))).groupBy("print").agg((F.max("c") == 1).alias("crowded"))
    standing = staged(standing, "standing")
    crowd = standing.where("crowded").select("print")
    both = lambda at: crowd.select(F.col("print").alias(at), F.lit(True).alias(f"{at}_in"))
    pairs = staged(paired.join(both("src"), "src", "left").join(both("dst"), "dst", "left").where("src_in is null or dst_in is null").select("src", "dst", "depth"), "pairs")

    # the texts of all who share a node, packed; every later step reads these
    wanted = groups.select("print", "key").join(standing, "print")
    texts = source.select("key", "text").mapInArrow(_packed, "key binary, packed binary").join(wanted.hint("merge"), "key").dropDuplicates(["print"])
    texts = staged(texts.select("print", "crowded", "packed"), "texts")

    edges = _verified_pairs(pairs, texts)
    compared = _compared(texts.where("crowded").select("print", "packed"), weights)
    every_edge = edges.select("src", "dst").unionByName(compared.where("other is not null").select(F.col("print").alias("src"), F.col("other").alias("dst")))
    members = components(every_edge, "classes").select(F.col("node").alias("print"), "component")

    both_ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = both_ways.join(weights.withColumnRenamed("print", "dst"), "dst").select(F.col("src").alias("print"), F.col("copies").alias("links"))
    links = found.unionByName(compared.where("other is null").select("print", "links")).groupBy("print").agg(F.sum("links").alias("links"))

    per_print = groups.drop("labels", "key").join(members, "print", "left").join(links, "print", "left").withColumn("component", F.coalesce("component", "print"))
    names = per_print.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    per_print = per_print.join(names, "component").select("print", "component", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = signed.select("doc_id", "key", "print").join(per_print, "print", "left")
    return joined.select("doc_id", "key", "component", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its connected class), copy_id (least
    doc_id with the same shingles), n_links (other documents of Jaccard similarity 0.8 or more).
    """
    return _classified(docs).select("doc_id", "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns: the one of least doc_id, null ids last. Documents without shingles
    are classes of their own; repeated rows count once.

    The texts move once: they meet the kept rows' keys and lose their repetitions in one partitioning.
    """
    rows = staged(_classified(docs).select("doc_id", "key", "component"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    heads = rows.where("component is not null").groupBy("component").agg(first).select(F.col("first.key").alias("key"))
    heads = heads.unionByName(rows.where("component is null").select("key")).distinct()
    keyed = docs.select(doc_key(F.col("doc_id"), F.col("text")).alias("key"), F.struct(*docs.columns).alias("doc"))
    return keyed.join(heads.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
