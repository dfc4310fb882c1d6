"""Toxicity by a weighted finite-state pattern grammar.

Tokens are read into symbols: insult (of three levels), threat, target, negation, report,
quotation mark, sentence end, line end, other. Three transducers over these symbols are data
(states and weighted arcs, `Transducer`) and are composed into one (`compose`), which reads a
text once:

- `reported_speech` marks insults and threats behind a verb of saying in the same sentence,
  or between quotation marks of the same line;
- `negation` marks those up to three words behind a negation;
- `aim` writes the weights: of an insult or threat by its level and marks, more if a target
  stands up to four words before it, and a share of it again at a target up to three behind.

The sums of weights by sentence are the clauses' scores. The insult lexicon has seeds and
what is learned: word beginnings (STEMS letters) and words that are used REASON times as
often, or more, in toxic training texts as in others. The documents' sums, densities and
greatest clause are calibrated by a logistic regression. Both are fitted on at most SAMPLE
labelled documents, taken in the order of a hash of their ids; labels, languages and sources
are no inputs of a score.

Null, empty and blank texts match nothing and get the score of such texts; long texts are
scored whole; repeated rows repeat; null ids pass through and never train; of several texts of
one id the least trains; several labels of a document count as their greatest; without labels the
given weights stay; extra columns are ignored, whatever their names; no rows give none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SAMPLE = 20_000
STEMS = (4, 5, 6, 7)
#: What a learned term needs: toxic documents, and their share beyond the others', and how much more often toxic texts use it.
LEAST_DOCS, LEAST_SHARE, REASON = 5, 0.01, 8.0
THRESHOLD = 0.7

#: Seeds. Weights are in the scale of log-odds.
INSULTS = dict.fromkeys("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown vermin imbecile fool dumb filth coward".split(), 2.0)
THREATS = dict.fromkeys("kill hurt destroy beat punch stab shoot crush murder burn".split(), 1.5)
TARGETS = set("you your yours u they them he she his her him these those all tu vous toi du dich dir ihr euch ustedes te vos".split())
NEGATIONS = set("not no never nobody neither nor without isn aren wasn don doesn didn hardly ne pas jamais nicht kein keine nie nunca sin ni".split())
REPORTS = set("said says say wrote writes quoted claimed called reported alleged according dit selon sagte laut dijo".split())

#: Symbols of a grammar's tokens that a task keeps.
KNOWN = 500_000

_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]|[.!?\n]")
_WORD = re.compile(r"[^\W\d_]+")

INSULT, THREAT = ("insult1", "insult2", "insult3"), "threat"
#: Input symbols, by number.
SYMBOLS = ("other", "target", "negation", "report", "quote", "sentence", "line", *INSULT, THREAT)
_VALUE = {"insult1": 1.0, "insult2": 2.0, "insult3": 3.0, THREAT: 1.5}
#: Factors of the weights, and how many words negations and targets reach.
UNAIMED_THREAT, AIMED, NEGATED, REPORTED, BEHIND = 0.3, 1.5, 0.3, 0.5, 0.5
NEGATION_REACH, TARGET_BEFORE, TARGET_BEHIND = 3, 4, 3


@dataclass(frozen=True)
class Transducer:
    """Letter to letter, deterministic: arcs[state, symbol] is (next state, output symbol, weight). State 0 is the start."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def run(self, symbols: list[str]) -> tuple[list[str], list[float]]:
        """What it writes, and the weights of the arcs taken."""
        state, out, weights = 0, [], []
        for symbol in symbols:
            state, written, weight = self.arcs[state, symbol]
            out.append(written)
            weights.append(weight)
        return out, weights


def transducer(start: Hashable, alphabet: Iterable[str], step: Callable[[Any, str], tuple[Hashable, str, float]]) -> Transducer:
    """The arcs of all states that can be reached from `start`, numbered in the order they are met."""
    numbers, arcs, alphabet = {start: 0}, {}, list(alphabet)
    queue = [start]
    for state in queue:
        for symbol in alphabet:
            to, written, weight = step(state, symbol)
            if to not in numbers:
                numbers[to] = len(numbers)
                queue.append(to)
            arcs[numbers[state], symbol] = (numbers[to], written, weight)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what `first` reads and writes what `second` writes on the output of `first`; weights add up."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, float]:
        a, middle, weight = first.arcs[state[0], symbol]
        b, written, more = second.arcs[state[1], middle]
        return (a, b), written, weight + more

    return transducer((0, 0), dict.fromkeys(symbol for _, symbol in first.arcs), step)


def _scored(symbol: str) -> bool:
    return symbol.startswith(("insult", THREAT))


def reported_speech() -> Transducer:
    """State: whether speech is reported, whether it is quoted."""

    def step(state: tuple[bool, bool], symbol: str) -> tuple[tuple[bool, bool], str, float]:
        said, quoted = state
        if _scored(symbol):
            return state, symbol + "+reported" * (said or quoted), 0.0
        after = {"report": (True, quoted), "quote": (said, not quoted), "sentence": (False, quoted), "line": (False, False)}
        return after.get(symbol, state), symbol, 0.0

    return transducer((False, False), SYMBOLS, step)


def _marked() -> list[str]:
    return [*SYMBOLS, *(s + "+reported" for s in SYMBOLS if _scored(s))]


def negation() -> Transducer:
    """State: how many words a negation still reaches."""

    def step(left: int, symbol: str) -> tuple[int, str, float]:
        if symbol in ("sentence", "line"):
            return 0, symbol, 0.0
        if symbol == "negation":
            return NEGATION_REACH, symbol, 0.0
        written = symbol + "+negated" * (left > 0 and _scored(symbol))
        return (left if symbol == "quote" else max(left - 1, 0)), written, 0.0

    return transducer(0, _marked(), step)


def aim() -> Transducer:
    """State: how many words a target still reaches, what was written last, and how many words it still waits for a target."""

    def step(state: tuple[int, float, int], symbol: str) -> tuple[tuple[int, float, int], str, float]:
        before, value, waits = state
        if symbol in ("sentence", "line"):
            return (0, 0.0, 0), symbol, 0.0
        if symbol == "quote":
            return state, symbol, 0.0
        if symbol == "target":
            return (TARGET_BEFORE, 0.0, 0), symbol, BEHIND * value
        after = max(before - 1, 0)
        if not _scored(symbol):
            waits = max(waits - 1, 0)
            return (after, value if waits else 0.0, waits), symbol, 0.0
        kind, *marks = symbol.split("+")
        weight = _VALUE[kind] * (AIMED if before else UNAIMED_THREAT if kind == THREAT else 1.0)
        weight *= (NEGATED if "negated" in marks else 1.0) * (REPORTED if "reported" in marks else 1.0)
        return (after, round(weight, 6), TARGET_BEHIND), symbol, round(weight, 6)

    return transducer((0, 0.0, 0), [*_marked(), *(s + "+negated" for s in _marked() if _scored(s))], step)


_FIXED = {token: SYMBOLS.index(symbol) for symbol, tokens in {"target": TARGETS, "negation": NEGATIONS, "report": REPORTS, "quote": '"“”«»„', "sentence": ".!?", "line": "\n"}.items() for token in tokens}
_ENDS = {SYMBOLS.index("sentence"), SYMBOLS.index("line")}


@lru_cache(maxsize=1)
def patterns() -> tuple[list[list[int]], list[list[float]]]:
    """The composed grammar as tables: next state and weight, by state and number of the symbol."""
    whole = compose(compose(reported_speech(), negation()), aim())
    states = 1 + max(state for state, _ in whole.arcs)
    arcs = [[whole.arcs[state, symbol] for symbol in SYMBOLS] for state in range(states)]
    return [[to for to, _, _ in row] for row in arcs], [[weight for *_, weight in row] for row in arcs]


@dataclass
class Grammar:
    """Lexicon (words and word beginnings) and calibration of the scores."""

    words: dict[str, float] = field(default_factory=lambda: dict(INSULTS))
    stems: dict[str, float] = field(default_factory=dict)
    intercept: float = -3.0
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    #: Symbols of the tokens that a task has met, KNOWN at most.
    seen: dict[str, int] = field(default_factory=dict)

    def pattern(self) -> str:
        """Finds the texts that any term can match (RE2)."""
        every = sorted({*self.words, *self.stems, *THREATS})
        return r"(?i)(?:^|[^\pL])(?:" + "|".join(map(re.escape, every)) + ")"

    def weight(self, token: str) -> float:
        """Of an insult; 0 for other words. The longest known beginning counts."""
        if (w := self.words.get(token)) is not None:
            return w
        for n in range(min(max(STEMS), len(token)), min(STEMS) - 1, -1):
            if (w := self.stems.get(token[:n])) is not None:
                return w
        return 0.0

    def symbol(self, token: str) -> int:
        """The number of a token's symbol."""
        if token in _FIXED:
            return _FIXED[token]
        weight = self.weight(token)
        if weight:
            return SYMBOLS.index(INSULT[min(max(round(weight), 1), 3) - 1])
        return SYMBOLS.index(THREAT) if token in THREATS else 0

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the clauses of a text, and the number of its words."""
        follow, weigh = patterns()
        known, state, n, scores, total = self.seen, 0, 0, [], 0.0
        for token in _TOKEN.findall(text.lower()):
            number = known.get(token)
            if number is None:
                if len(known) > KNOWN:
                    known.clear()
                number = known[token] = self.symbol(token)
            total += weigh[state][number]
            state = follow[state][number]
            if number in _ENDS:
                scores.append(total)
                total = 0.0
            else:
                n += 1
        return [*scores, total], n

    def features(self, text: str) -> tuple[float, float, float]:
        """Of a text that may match: log of its sum, density for a hundred words, greatest clause."""
        scores, n = self.clauses(text)
        total = sum(scores)
        return math.log1p(total), min(100 * total / n, 20.0) if n else 0.0, min(max(scores), 10.0)

    def score(self, features: tuple[float, float, float]) -> float:
        z = self.intercept + sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def all_features(grammar: Grammar, texts: pa.Array) -> list[tuple[float, float, float]]:
    full = texts.cast(pa.large_string()).fill_null("")
    possible = pc.match_substring_regex(full, grammar.pattern()).to_pylist()
    return [grammar.features(full[i].as_py()) if can else (0.0, 0.0, 0.0) for i, can in enumerate(possible)]


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels must not be learned from (not for null ids)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most SAMPLE labelled documents outside the held-out ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    held = docs.select("doc_id", "text").where(F.trim("text") != "").join(F.broadcast(known), "doc_id")  # SAMPLE ids at most
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: each word and word beginning, how often and in how many texts, by label."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = Counter(t for t in _WORD.findall(text.lower()) if len(t) > 2)
            terms: Counter = Counter()
            for word, n in found.items():
                terms["=" + word] += n
                for k in STEMS:
                    if len(word) >= k:
                        terms[word[:k]] += n
            terms["*"] = sum(found.values())
            for term, n in terms.items():
                entry = counts.setdefault(term, [0, 0, 0, 0])
                entry[0 if toxic else 1] += n
                entry[2 if toxic else 3] += 1
        columns = list(zip(*counts.values(), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["term", "pos", "neg", "pos_docs", "neg_docs"])


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar whose insults and calibration are fitted on the training sample."""
    sample = staged(training_sample(docs, labels), "sample")
    counts = sample.mapInArrow(_term_counts, "term string, pos bigint, neg bigint, pos_docs bigint, neg_docs bigint").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "pos_docs", "neg_docs")))
    counts = staged(counts, "terms")
    grammar = Grammar()
    every = counts.where("term = '*'").first()
    if every is None or not every["pos"] or not every["neg"]:
        return grammar
    rate = ((F.col("pos") + 0.5) / every["pos"]) / ((F.col("neg") + 0.5) / every["neg"])
    share = F.col("pos_docs") / every["pos_docs"] - F.col("neg_docs") / every["neg_docs"]
    terms = counts.where((F.col("term") != "*") & (F.col("pos_docs") >= LEAST_DOCS)).withColumns({"rate": rate, "share": share})
    best = terms.where((F.col("rate") >= REASON) & (F.col("share") > LEAST_SHARE)).orderBy("term").collect()  # each fills a share of the sample's documents, so their number is bounded
    for row in best:
        weight = min(3.0, math.log(row["rate"]))
        if row["term"][0] == "=":
            grammar.words[row["term"][1:]] = weight
        else:
            grammar.stems[row["term"]] = weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*all_features(grammar, batch.column("text")), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c, pa.float64()) for c in columns)], ["toxic", "a", "b", "c"])

    fitted = sample.withColumn("toxic", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, a double, b double, c double").toPandas()  # SAMPLE rows at most
    calibrate(grammar, fitted[["a", "b", "c"]].to_numpy(), fitted["toxic"].to_numpy(float))
    return grammar


def calibrate(grammar: Grammar, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
    """Logistic regression by Newton's method, with a ridge on the weights."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    grammar.intercept, grammar.weights = float(w[0]), tuple(map(float, w[1:]))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [grammar.score(f) for f in all_features(grammar, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns on the documents outside the held-out ones and scores all."""
    return score(docs, learn(docs, labels))
