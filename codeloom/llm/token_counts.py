"""Token counts by a digest cache.

A text is normalised and digested with SHA-256. For a tokenizer that drops white space before
it splits (see `splits_at_blanks`) runs of space, tab, line feed and carriage return become
one space, with none at the ends, which never changes a count; for others the text stays as
it is. Digests are joined with the stored counts of the same tokenizer version (the digest of
its file); texts without a count are encoded once for each digest, and their counts are
appended to the cache. The documents, as digests only, are then joined with the cache.

The cache is a Parquet folder of (tokenizer, digest, n_tokens), append only: a run that is
repeated after a failure may store a digest twice, which reading removes.

Within a miss of such a tokenizer, tokens are counted by words: the words of a batch are made
distinct, those the task has not met are encoded, and the counts are summed by text. Each
task keeps the counts of WORDS words at most. Other tokenizers encode whole texts.

Null and empty texts have 0 bytes and 0 tokens; long texts are encoded whole; repeated rows
repeat; null ids pass through; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged

LIMIT = 2048
WORDS = 400_000
_CACHE = "tokenizer string, digest binary, n_tokens bigint"


def version(tokenizer_file: str) -> str:
    """Digest of a tokenizer's file."""
    with open(tokenizer_file, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer drops white space and no token or special string spans it, so that words can be counted alone."""

    def drops(pre: dict) -> bool:
        parts = pre.get("pretokenizers", [pre])
        return any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "[^\\s" in str(p.get("pattern", {}).get("Regex")) for p in parts[:1])

    def collapses(norm: dict) -> bool:
        return all(p.get("type") in ("NFC", "Lowercase") or (p.get("type") == "Replace" and p.get("pattern") == {"Regex": "\\s+"}) for p in norm.get("normalizers", [norm]))

    special = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    return special and drops(spec.get("pre_tokenizer") or {}) and collapses(spec.get("normalizer") or {})


class Counter:
    """Counts tokens as the tokenizers library gives them, without begin, end or added special tokens."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(tokenizer_file, encoding="utf-8") as f:
            self.by_word = splits_at_blanks(json.load(f))
        self.seen: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """texts: normalised, so the words of a tokenizer that drops white space stand between single spaces."""
        if not self.by_word:
            return np.array(self._whole(texts.to_pylist()), np.int64)
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, seen = coded.dictionary.to_pylist(), self.seen
        if len(seen) + len(words) > WORDS:
            seen.clear()
        fresh = [w for w in words if w not in seen]
        seen.update(zip(fresh, self._whole(fresh), strict=True))
        each = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        totals = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        return totals[bounds[1:] - bounds[0]] - totals[bounds[:-1] - bounds[0]]


@lru_cache(maxsize=2)
def counter(tokenizer_file: str) -> Counter:
    """One for each worker process."""
    return Counter(tokenizer_file)


def normalised(text: Column, blanks: bool) -> Column:
    """The text as it is digested. blanks: whether its white space may be normalised."""
    whole = F.coalesce(text, F.lit(""))
    return F.btrim(F.regexp_replace(whole, r"[ \t\n\r]+", " ")) if blanks else whole


def stored(spark, cache_dir: str) -> DataFrame:
    """The cache's rows; none where the folder does not exist yet."""
    try:
        return spark.read.schema(_CACHE).parquet(cache_dir).dropDuplicates(["tokenizer", "digest"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)


def count_tokens(docs: DataFrame, tokenizer_file: str, cache_dir: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. cache_dir: a folder all machines
    share, which later calls with the same one use again; without one the cache starts empty.
    """
    spark = docs.sparkSession
    cache_dir = cache_dir or f"{shared_dir(spark)}/codeloom/token-counts-{uuid.uuid4().hex}"
    name = version(tokenizer_file)
    keyed = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), normalised(F.col("text"), counter(tokenizer_file).by_word).alias("content"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("content", 256)))

    own = F.col("tokenizer") == name
    # distinct first: copies of one text combine before the shuffle, however many there are
    misses = keyed.select("digest", "content").dropDuplicates(["digest"]).join(stored(spark, cache_dir).where(own).select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = known.count(part.column("content"))
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), part.column("digest"), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    misses.mapInArrow(run, _CACHE).write.mode("append").parquet(cache_dir)
    counts = stored(spark, cache_dir).where(own).select("digest", "n_tokens")
    narrow = staged(keyed.select("doc_id", "n_bytes", "digest"), "digests")
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
