"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once. At each position its output links name every piece that ends
there; each tries to relax that position from the one where the piece begins.

In a unigram file a piece relaxes a position by its score; of equal paths the one with the
longer last piece wins. A merge (BPE) file holds ranks of merges, which are no path scores:
there a piece relaxes a position if merges would leave it behind the best last piece of the
position where it begins, that is, if the text of these two pieces is merged into just the
two (`Codec.follows`). Of the pieces that end at a position exactly one is such, and the path
through them is the segmentation that merges give, so ids equal the library's.

A character that no piece covers becomes its UTF-8 bytes, as `<0x..>` pieces; in a unigram
file it costs the least score of all less PENALTY. White space becomes U+2581 and one is put
in front, as the model's specification says; U+2581 in a text is white space too, as in the
library, and decodes to a space. No piece has U+2581 behind another character, so a path is
made of the paths of the chunks that begin at U+2581; each task keeps the chunks it has seen,
CHUNKS at most.

Null and empty texts have no pieces and decode to the empty text; any text decodes to itself
but for U+2581; long texts are encoded whole; repeated rows, null ids and other columns pass
through (a column `ids` gives way to the new one in `encode`, `text` in `decode`); no rows
give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
PENALTY = 10.0
CHUNKS = 300_000
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, BYTE = 1, 2, 6


class Codec:
    """Encodes and decodes with the pieces (text, score, kind), whose places are their ids. merges: scores are ranks of merges."""

    def __init__(self, pieces: list[tuple[str, float, int]], merges: bool = False):
        self.pieces, self.merges = pieces, merges
        self.bytes_ = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        usable = [(text, i, score) for i, (text, score, kind) in enumerate(pieces) if kind == NORMAL]
        self.worst = min((s for _, _, s in usable), default=0.0) - PENALTY
        self.ids = {text: i for text, i, _ in usable}
        self.score = {text: s for text, _, s in usable}
        self.singles = {text for text, _, _ in usable if len(text) == 1}
        self.automaton = ahocorasick.Automaton()
        for text, i, score in usable:
            self.automaton.add_word(text, (len(text), i, score))
        if usable:
            self.automaton.make_automaton()
        #: Whether chunks that begin at SPACE can be segmented alone, and parts between characters that are no pieces.
        self.apart = not any(SPACE in text.lstrip(SPACE) for text, _, _ in usable)
        self.whole = all(self.singles.issuperset(text) for text, _, _ in usable)
        self.sizes = [len(text) for text, _, _ in pieces]
        self.raw = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE, " ").encode() for text, _, kind in pieces]
        self.seen: dict[str, tuple[int, ...]] = {}
        #: Whether a piece may follow another, by place of that * pieces + place of this.
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merges make of a short text: always the pair of best score, of equal ones the first."""
        parts, score = list(text), self.score
        pairs = [score.get(a + b, -math.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == -math.inf:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score.get(parts[at - 1] + parts[at], -math.inf)
            if at < len(pairs):
                pairs[at] = score.get(parts[at] + parts[at + 1], -math.inf)
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """Whether merges leave `piece` behind `before` (-1: the start)."""
        pair = [self.pieces[i][0] for i in (before, piece) if i >= 0]
        return self.merged("".join(pair)) == pair

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of the best path through a text whose white space is escaped already."""
        last = self._last_merged(text) if self.merges else self._last_scored(text)
        if -1 in last[1:]:  # a character that no piece covers
            return self._segment_with_unknown(text)
        out, n, sizes = [], len(text), self.sizes
        while n:
            i = last[n]
            out.append(i)
            n -= sizes[i]
        out.reverse()
        return tuple(out)

    def _last_merged(self, text: str) -> list[int]:
        """Of each position the piece that merges leave before it; -1 at the start."""
        last, pairs, n = [-1] * (len(text) + 1), self.pairs, len(self.pieces)
        for end, (length, i, _) in self.automaton.iter(text):
            end += 1
            # several pieces end here, the longest first; the first that may follow is the only one
            if last[end] < 0:
                pair = last[end - length] * n + i
                if pair not in pairs:
                    pairs[pair] = self.follows(last[end - length], i)
                if pairs[pair]:
                    last[end] = i
        return last

    def _last_scored(self, text: str) -> list[int]:
        best, last = [0.0] + [-math.inf] * len(text), [-1] * (len(text) + 1)
        for end, (length, i, score) in self.automaton.iter(text):
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], last[end + 1] = total, i
        return last

    def _unknown(self, char: str) -> list[int]:
        return [self.bytes_.get(b, self.unknown) for b in char.encode()]

    def _segment_with_unknown(self, text: str) -> tuple[int, ...]:
        if not self.whole or self.singles.issuperset(text):
            return self._around_unknown(text)
        # no piece holds a character that is none itself, so the parts between such characters are apart
        out: list[int] = []
        start = 0
        for k, char in enumerate(text):
            if char not in self.singles:
                out += [*self.segment(text[start:k]), *self._unknown(char)]
                start = k + 1
        return (*out, *self.segment(text[start:]))

    def _around_unknown(self, text: str) -> tuple[int, ...]:
        """As segment, where pieces hold characters that are no pieces themselves."""
        if self.merges:
            return tuple(i for part in self.merged(text) for i in ([self.ids[part]] if part in self.ids else self._unknown(part)))
        n, at = len(text), 0
        best, back = [0.0] + [-math.inf] * n, [(1, -1)] * (n + 1)

        def unknown_to(end: int) -> int:
            for k in range(at, end):
                if text[k] not in self.singles and best[k] + self.worst > best[k + 1]:
                    best[k + 1], back[k + 1] = best[k] + self.worst, (1, -1)
            return end

        for end, (length, i, score) in self.automaton.iter(text) if len(self.automaton) else ():
            at = unknown_to(end)
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (length, i)
        unknown_to(n)
        out: list[int] = []
        while n:
            length, i = back[n]
            out += [i] if i >= 0 else reversed(self._unknown(text[n - 1]))
            n -= length
        return tuple(reversed(out))

    def forget(self) -> None:
        self.seen.clear()
        if len(self.pairs) > 10 * CHUNKS:
            self.pairs.clear()

    def encode(self, text: str) -> list[int]:
        return self._chunks(SPACE + text.replace(" ", SPACE)) if text else []

    def _chunks(self, escaped: str) -> list[int]:
        if not self.apart:
            return list(self.segment(escaped))
        out: list[int] = []
        seen = self.seen
        first, *parts = escaped.split(SPACE)
        out += self.segment(first)
        run = ""
        for part in parts:
            run += SPACE
            if part:
                ids = seen.get(run + part)
                if ids is None:
                    if len(seen) >= CHUNKS:
                        self.forget()
                    ids = seen[run + part] = self.segment(run + part)
                out += ids
                run = ""
        return out + list(self.segment(run)) if run else out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of all texts, one after another.

        Texts of words between single spaces, which are most, are split at once; each
        different word of the batch is looked up or segmented once.
        """
        full = texts.cast(pa.large_string()).fill_null("")
        plain = pc.invert(pc.match_substring_regex(full, f"^ |  | $|^$|{SPACE}")).to_numpy(zero_copy_only=False) if self.apart else np.zeros(len(full), bool)
        split = pc.split_pattern(full.filter(pa.array(plain)), " ")
        bounds = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
        coded = split.flatten().dictionary_encode()
        words, seen = coded.dictionary.to_pylist(), self.seen
        if len(seen) + len(words) > CHUNKS:
            self.forget()
        known = []
        for word in words:
            chunk = SPACE + word
            ids = seen.get(chunk)
            if ids is None:
                ids = seen[chunk] = self.segment(chunk)
            known.append(ids)
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        pool = np.fromiter((i for ids in known for i in ids), np.int32, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        index = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        at = np.repeat(starts[index] - ends[:-1], sizes[index]) + np.arange(ends[-1])
        flat, cuts = pool[at], ends[bounds] if len(bounds) else np.zeros(1, np.int64)
        if plain.all():
            return cuts, flat
        parts, nth = [], 0
        for k, easy in enumerate(plain):
            if easy:
                parts.append(flat[cuts[nth] : cuts[nth + 1]])
                nth += 1
            else:
                parts.append(np.array(self.encode(full[k].as_py()), np.int32))
        return np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), np.concatenate(parts).astype(np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of these ids: bytes are joined, SPACE becomes a space, the one in front goes."""
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")[1:]


def read_model(model_file: str) -> tuple[list[tuple[str, float, int]], bool]:
    """The pieces of a SentencePiece model file, and whether their scores are ranks of merges."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == model.trainer_spec.BPE


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec for each worker process and model file. Tokenizer files are part of the installed environment of each executor."""
    return Codec(*read_model(model_file))


_DIGEST = "doc_id bigint, n_pieces bigint, n_bytes_pieces bigint, ids_hash string, round_trip boolean"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """docs with the column ids array<int> in place of text."""
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(model_file)
        for batch in _slices(batches):
            offsets, flat = known.encode_all(batch.column("text"))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], [*kept, "ids"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """docs with the column text in place of ids."""
    kept = [c for c in encoded.columns if c not in ("text", "ids")]
    schema = encoded.select(*kept).schema.add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(model_file)
        for batch in _slices(batches):
            texts = pa.array([known.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], [*kept, "text"])

    return encoded.select(*kept, "ids").mapInArrow(run, schema)


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_pieces, n_bytes_pieces (of them single bytes), ids_hash (XXH3 of the ids as
    little-endian 32-bit numbers) and whether the ids decode to the text
    (U+2581 to a space).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(model_file)
        is_byte = np.zeros(len(known.pieces), bool)
        is_byte[list(known.bytes_.values())] = True
        for batch in _slices(batches):
            texts = [(t or "").replace(SPACE, " ") for t in batch.column("text").to_pylist()]
            offsets, flat = known.encode_all(batch.column("text"))
            bytes_before = np.concatenate([[0], np.cumsum(is_byte[flat])])
            ids = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(np.diff(bytes_before[offsets]), pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(x.astype("<i4").tobytes()) for x in ids]),
                    pa.array([known.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ],
                [c.split()[0] for c in _DIGEST.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _DIGEST)
