"""PII: base patterns, and information-theoretic sanitisation of the texts that hold their matches.

Base spans come from four patterns (email, ip, card, phone). Their values are the protected
entities. From the corpus, where equal texts count once, p(c) is the share of texts that
mention entity c, p(t) the share that hold term t anywhere, and p(c, t) the share that do both.
The disclosure of c by t is PMI(c; t) / IC(c) = log(p(c, t) / (p(c) p(t))) / -log p(c), which
is 1 where t never occurs without c. A term is a span wherever it stands in a text that
mentions an entity it discloses beyond GENERALISE, if the mentions in these texts stand in
SUPPORT different surroundings or more (REACH words before and behind) and share no more than
VERSIONS of their terms (so versions of one text, however many, prove nothing): kind `general` up to REMOVE, `remove` beyond it. `sanitise` puts the
entity's kind in place of base spans, `[TERM]` in place of general ones and nothing in place
of removed ones.

Entities of fewer than SUPPORT surroundings cannot disclose anything by this rule, so they
are dropped before any term is counted; the others' texts are read a second time.

Offsets are code points, ends exclusive. Null and empty texts have no spans; long texts are
scanned whole; repeated rows repeat and change nothing else; null ids pass through; other
columns are ignored (scan) or kept (sanitise); no rows give none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "general", "remove")

REACH, SUPPORT = 4, 3
GENERALISE, REMOVE = 0.8, 0.95
#: Terms in a batch that a task passes on.
TERMS = 1 << 16
#: Texts that share more than this part of their terms, two by two on average, are versions of one text.
VERSIONS = 0.9
#: Terms are counted in one of so many texts first, then in more, then in all.
PARTS = (64, 8, 1)
#: Bytes of texts that a task looks at together while it counts; a longer text is looked at alone.
TOGETHER = 2 << 20
#: Wanted terms of so many characters in all are first sought as one pattern, which most texts do not match.
SOUGHT = 1 << 12

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A word without what is neither letter nor number at its ends; in time linear in the word.
_CORE = regex.compile(r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", regex.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds, from the @ signs: the pattern alone would try each start of a long run."""
    done, at = 0, text.find("@")
    while at >= 0:
        local, domain = _LOCAL.match(text[done:at][::-1]), _DOMAIN.match(text, at + 1)
        if local and domain:
            yield at - local.end(), domain.end()
            done = domain.end()
        else:
            done = at + 1  # no name reaches over an @
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base spans, by kind and start."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-18:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _before(text: str, a: int) -> list[re.Match[str]]:
    """The last REACH words before a place, whole however long they are."""
    width = 60 * REACH
    while True:
        low = max(0, a - width)
        found = list(_WORD.finditer(text, low, a))
        # the first of them may be cut, so one more is wanted
        if low == 0 or len(found) > REACH:
            return found[-REACH:]
        width *= 2


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """(entity, hash of the words around it) of each span."""
    out = []
    for kind, a, b in spans:
        entity = KINDS[kind] + ":" + (re.sub(r"\D", "", text[a:b]) if kind > 1 else text[a:b].lower())
        after = []
        for m in _WORD.finditer(text, b):
            after.append(m)
            if len(after) == REACH:
                break
        around = "\0".join(m[0] for m in _before(text, a) + after)
        out.append((entity, int.from_bytes(hashlib.blake2b(around.encode(), digest_size=8).digest(), "big", signed=True)))
    return out


def terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside the spans, in lower case, without what is neither letter nor number at their ends."""
    ordered, at, reached = sorted((a, b) for _, a, b in spans), 0, 0
    for m in _WORD.finditer(text):
        core = _CORE.search(m[0])
        if not core:
            continue
        start, end = m.start() + core.start(), m.start() + core.end()
        while at < len(ordered) and ordered[at][0] < end:
            reached = max(reached, ordered[at][1])
            at += 1
        if reached <= start:
            yield core[0].lower(), start, end


def _term(word: str) -> str:
    """The term that a word is, empty if none."""
    if word.isalnum():  # most words: nothing to strip
        return word.lower()
    core = _CORE.search(word)
    return core[0].lower() if core else ""


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_SPANS = "array<struct<kind:int,start:int,stop:int>>"


def _key(text: Column) -> Column:
    """Identifies a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    mention = pa.struct([("entity", pa.string()), ("place", pa.int64())])
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).fill_null("")
        possible = pc.match_substring_regex(texts, r"[0-9][ .0-9-]{6}|@[A-Za-z0-9-]+\.|\+[0-9]").to_pylist()
        spans = [base_spans(texts[i].as_py()) if can else [] for i, can in enumerate(possible)]
        found = [mentions(texts[i].as_py(), x) if x else [] for i, x in enumerate(spans)]
        columns = [pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in x] for x in spans], pa.list_(span)), pa.array([[dict(zip(("entity", "place"), s, strict=True)) for s in x] for x in found], pa.list_(mention))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", "base", "mentions"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[bytes, str, int, int]] = []

    def full() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["key", "term", "start", "stop"])

    for batch in batches:
        for row in range(batch.num_rows):
            key, text, spans = (batch.column(c)[row].as_py() for c in ("key", "text", "base"))
            for term in terms(text, [(s["kind"], s["start"], s["stop"]) for s in spans]):
                rows.append((key, *term))
                if len(rows) == TERMS:
                    yield full()
    yield full()


def _sought(terms: list[str]) -> str:
    """A pattern that matches every text that holds one of the terms in any case (and some that do not: beyond ASCII it only tells that there is a character)."""

    def one(c: str) -> str:
        if not c.isascii():
            return r"[^\x00-\x7F]" + ("?" if c == "\u0307" else "")  # U+0130 is i and U+0307 in lower case
        more = {"i": "\u0130", "k": "\u212a"}.get(c, "")
        return f"[{c}{c.upper()}{more}]" if c.isalpha() else f"\\x{ord(c):02x}"

    return "|".join("".join(map(one, t)) for t in terms)


def _holding(wanted: list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over (key, text): (key, term) of the different terms of each text, base spans included; of the wanted ones alone if they are given."""
    kept = None if wanted is None else frozenset(wanted)
    pattern = _sought(wanted) if wanted and sum(map(len, wanted)) <= SOUGHT else None

    def held(texts: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, str]]:
        # bytes split at space and U+0009 to U+000D, as _WORD does
        split = [text.split() for _, text in texts]
        known = {}
        for word in set().union(*split):
            term = _term(word.decode())
            if term and (kept is None or term in kept):
                known[word] = term
        hits = frozenset(known)
        for (key, _), words in zip(texts, split, strict=True):
            for term in {known[word] for word in hits.intersection(words)}:
                yield key, term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[bytes, bytes]] = []
        size = 0

        def full() -> pa.RecordBatch:
            keys, found = list(zip(*held(texts), strict=True)) or ((), ())
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "term"])

        for batch in batches:
            if pattern:
                batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text").cast(pa.large_string()), pattern), False))
            for key, text in zip(batch.column("key"), batch.column("text").cast(pa.large_binary()), strict=True):
                texts.append((key.as_py(), text.as_py() or b""))
                size += len(texts[-1][1])
                if size >= TOGETHER:
                    yield full()
                    size = 0
        yield full()

    return run


def _with_term(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, with_term): how many different texts hold each wanted term, those that no text holds left out.

    texts: (key, text); wanted: distinct (term), staged. Wanted terms that may be broadcast go to the tasks, which pass on
    nothing else; more of them meet all terms of the texts by a shuffle.
    """
    near = small_side(wanted)
    listed = None if near is wanted else [r["term"] for r in wanted.collect()]
    held = texts.mapInArrow(_holding(listed), "key binary, term string")
    met = held if listed is not None else held.join(wanted, "term")
    return met.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))


def _alikeness(said: DataFrame, met: DataFrame, at: DataFrame) -> DataFrame:
    """(entity, texts, alike): how many texts with terms mention an entity, and which part of their terms they share, two by two on average (null for one text).

    met: (entity, term, both), how many of the entity's texts hold a term; at: (key, term, start, stop).
    """
    sizes = at.select("key", "term").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    texts = said.select("key", "entity").distinct().join(sizes, "key").groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.avg("n").alias("n"))
    shared = met.groupBy("entity").agg(F.sum(F.col("both") * (F.col("both") - 1)).alias("shared"))
    pairs = F.col("n") * F.col("texts") * (F.col("texts") - 1)
    return texts.join(shared, "entity", "left").select("entity", "texts", F.when(pairs > 0, F.coalesce("shared", F.lit(0)) / pairs).alias("alike"))


def _disclosing(said: DataFrame, at: DataFrame, source: DataFrame, scanned: DataFrame, support: int, versions: float) -> DataFrame:
    """(entity, term, disclosure) of the terms that disclose an entity beyond GENERALISE.

    said: distinct (key, entity, place) of the entities that have `support` places or more; at: (key, term, start, stop) of their texts;
    source, scanned: all texts, and their keys as staged.
    Every count is grouped with map-side combine, so an entity that a third of all texts mention is no hot key.
    """
    held = at.select("key", "term").distinct()
    met = said.select("key", "entity").distinct().join(held, "key").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    places = said.join(held, "key").select("entity", "term", "place").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") >= support)
    met = staged(met, "met")
    # an entity whose texts share nearly all of their terms, two by two on average, is in versions of one text
    apart = _alikeness(said, met, at).where(F.coalesce(F.col("alike") <= versions, F.lit(True))).select("entity")
    pairs = staged(met.join(places, ["entity", "term"]).join(apart, "entity", "left_semi"), "pairs")
    with_entity = said.select("key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"))
    total = scanned.select("key").distinct().count()
    counted = pairs.join(with_entity, "entity").where(F.col("with_entity") < total)
    share = lambda c: F.col(c) / F.lit(total)
    pmi = F.log(share("both") / (share("with_entity") * F.greatest(share("with_term"), share("both"))))
    disclosure = pmi / -F.log(share("with_entity"))
    # how many texts hold a term: counted in a part of the texts first, which is never more than in all of them, so a pair
    # below the threshold there is below it for good; frequent words go before they are counted everywhere
    for part in PARTS if not pairs.isEmpty() else ():
        wanted = staged(counted.select("term").distinct(), "wanted")
        some = (source if part == 1 else source.where(F.pmod(F.xxhash64("key"), F.lit(part)) == 0)).select("key", "text")
        known = counted.join(_with_term(some, wanted), "term", "left").withColumn("with_term", F.coalesce("with_term", F.lit(0)))
        known = known.withColumn("disclosure", disclosure).where(F.col("disclosure") > GENERALISE)
        counted = staged(known.select("entity", "term", "both", "with_entity", "disclosure"), "counted").drop(*(["disclosure"] if part > 1 else []))
    return counted.select("entity", "term", "disclosure") if "disclosure" in counted.columns else counted.select("entity", "term", F.lit(0.0).alias("disclosure"))


def _scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts by key, each document's base spans and mentions, and the distinct (key, entity, place)."""
    source = docs.select("doc_id", _key(F.col("text")).alias("key"), "text")
    scanned = staged(source.mapInArrow(_scan, f"doc_id bigint, key binary, base {_SPANS}, mentions array<struct<entity:string,place:bigint>>"), "scanned")
    return source, scanned, staged(scanned.select("key", F.explode("mentions").alias("x")).select("key", "x.*").distinct(), "mentions")


def _supported(mentioned: DataFrame, support: int) -> DataFrame:
    """The mentions of entities in `support` surroundings or more."""
    known = mentioned.select("entity", "place").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("entity")
    return staged(mentioned.join(small_side(staged(known, "entities")), "entity", "left_semi"), "said")


def _terms_of(source: DataFrame, scanned: DataFrame, said: DataFrame) -> DataFrame:
    """(key, term, start, stop) of the texts that mention the entities of `said`."""
    wanted = staged(said.select("key").distinct().join(scanned.select("key", "base").dropDuplicates(["key"]), "key"), "carriers")
    texts = source.select("key", "text").join(small_side(wanted), "key").dropDuplicates(["key"])
    return staged(texts.mapInArrow(_terms, "key binary, term string, start int, stop int"), "terms")


def entities(docs: DataFrame, support: int = SUPPORT, versions: float = VERSIONS) -> DataFrame:
    """One row per protected entity, and why its terms are not sought: entity, texts, surroundings, alike (see VERSIONS; null
    where no terms were counted, or for one text), status (`few surroundings`, `versions of one text` or `sought`).
    """
    source, scanned, mentioned = _scanned(docs)
    seen = mentioned.groupBy("entity").agg(F.countDistinct("key").alias("texts"), F.countDistinct("place").alias("surroundings"))
    said = _supported(mentioned, support)
    at = _terms_of(source, scanned, said)
    met = said.select("key", "entity").distinct().join(at.select("key", "term").distinct(), "key").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    status = F.when(F.col("surroundings") < support, "few surroundings").when(F.col("alike") > versions, "versions of one text").otherwise("sought")
    return seen.join(_alikeness(said, met, at).drop("texts"), "entity", "left").withColumn("status", status)


def find(docs: DataFrame, support: int = SUPPORT, versions: float = VERSIONS) -> DataFrame:
    """One row per document: doc_id, key (of its text) and spans, array of (kind number, start, stop)."""
    source, scanned, mentioned = _scanned(docs)
    said = _supported(mentioned, support)
    if said.isEmpty():
        return scanned.select("doc_id", "key", F.col("base").alias("spans"))

    at = _terms_of(source, scanned, said)
    disclosing = staged(_disclosing(said, at, source, scanned, support, versions), "disclosing")
    kind = F.when(F.col("disclosure") > REMOVE, 5).otherwise(4)
    worst = said.select("key", "entity").distinct().join(small_side(disclosing), "entity").groupBy("key", "term").agg(F.max(kind).alias("kind"))
    added = at.join(worst, ["key", "term"]).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))  # as long as the text has words
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    return scanned.join(small_side(staged(added, "added")), "key", "left").select("doc_id", "key", spans.alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans (`kind:start:end`, by kind and start), n_general, n_remove."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda x: x["kind"] < 4)
    return find(docs).select("doc_id", *counts[:4], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), *counts[4:])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with their spans in `text` replaced: base ones by `[EMAIL]`, `[IP]`, `[CARD]` or `[PHONE]`, general terms by `[TERM]`, the rest by nothing."""
    spans = find(docs).select("key", "spans").dropDuplicates(["key"])
    held = docs.select(F.struct(*docs.columns).alias("doc"), "text", _key(F.col("text")).alias("key")).join(spans, "key", "left")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind"))))
    mark = F.array(*map(F.lit, ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, x):
        fresh = x["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, x["start"] - state["at"]), F.get(mark, x["kind"]))
        return F.struct(F.when(fresh, more).otherwise(state["out"]).alias("out"), F.when(fresh, -x["back"]).otherwise(state["at"]).alias("at"))

    done = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    clean = F.when(F.col("text").isNull(), F.col("text")).otherwise(done)
    return held.select(F.col("doc").withField("text", clean).alias("doc")).select("doc.*")
