"""Secret scans by assignment-aware lexing.

Base spans come from three patterns (assign, access, hex). Then each text that holds a
sensitive word with an assignment's sign anywhere behind it is lexed as source or configuration: quoted strings, names, numbers and operators
give (name, literal) pairs for `name = "literal"`, `name: literal`, `name => literal`,
`NAME=literal` and dictionary entries; strings may be single, triple or back-quoted, and values the lines of
a YAML block. Constants propagate: a name assigned another name, or a concatenation of names, strings
and calls, takes their literals (but for a call's arguments that read like names of settings). Each literal is scored by the
words of its target's name (a sensitive word, less an innocent one) and by its own form
(length, mixed classes, entropy, less for blanks); literals of REACH or more are spans of kind `literal`.

Offsets are code points, ends exclusive. Null and empty texts have no spans; long texts are
scanned whole; repeated rows give repeated results; null ids pass through; other columns are
ignored (scan) or kept (redact); no rows give none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and least lengths.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "literal")

#: Words of names that make a literal a secret, with their weights, and words that excuse it.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "signature": 1.0, "salt": 1.5, "cert": 1.0}
EXCUSES = {"public": -2.5, "example": -2.0, "test": -1.0, "sample": -2.0, "placeholder": -3.0, "name": -1.0, "path": -2.0, "file": -1.5, "url": -1.0, "count": -2.0, "length": -2.0, "limit": -2.0}
REACH = 4.0

_LEX = re.compile(r"""(?P<string>\"{3}(?:[^"\\]++|\\[\s\S]|\"(?!\"\"))*+\"{3}|\'{3}(?:[^'\\]++|\\[\s\S]|\'(?!\'\'))*+\'{3}|`[^`\n]*+`|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)|(?P<op>=>|:=|==|!=|<=|>=|[=:+,;{}()\[\]])|(?P<line>\n)|(?P<bare>[^\s"'`=:+,;{}()\[\]]+)""")
#: The lines of a YAML block: all that are indented, behind the sign of the block.
_BLOCK = re.compile(r"[|>][-+]?[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\Z))+)")
#: How deep in a call's arguments literals are looked for; what a literal with blanks loses.
DEEP, BLANK = 3, 1.5
#: Arguments of this form are names of settings, not secrets.
_SETTING = re.compile(r"[A-Z][A-Z0-9_]*|[a-z][a-z0-9_.-]*")
# Literal spans need a target that holds a sensitive word, with an operator behind it: a text without these has none.
_LIKELY = f"(?is)(?:{'|'.join(SENSITIVE)}).*[=:]"
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base spans."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def entropy(value: str) -> float:
    """Bits for each character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def name_score(name: str) -> float:
    """How far the words of a name speak for a secret."""
    parts = [p.lower() for p in _PARTS.findall(name.replace("-", "_"))]
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0) + 0.5 * (sum(p in SENSITIVE for p in parts) > 1) + sum(EXCUSES.get(p, 0.0) for p in parts)


def literal_score(value: str) -> float:
    """How far the form of a literal speaks for a secret: 0 for words and short strings, up to 3."""
    if len(value) < LEAST_VALUE or "${" in value or "{{" in value:
        return -3.0
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return 0.5 * (classes - 1) + 0.5 * (len(value) >= 12) + (entropy(value) >= 3.0) - BLANK * bool(re.search(r"\s", value))


class _Value:
    """What a name was given: literals of its own (start, end, whether a call's argument), the values of the names in it, and how sensitive the names it reaches are."""

    __slots__ = ("literals", "score", "sources")

    def __init__(self, score: float):
        self.literals: list[tuple[int, int, bool]] = []
        self.sources: list[_Value] = []
        self.score = score


def assigned(text: str) -> list[_Value]:
    """The values of all assignments in the order of the text, each with the score of the most sensitive name it reaches.

    A literal reaches a name directly, by way of other names (`b = a`), or as a part of a
    concatenation (`c = a + "x"`). A name stands for what it was assigned last before its use,
    so values form a graph without cycles; it is walked once, backwards, however often names
    repeat in it.
    """
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEX.finditer(text)]
    pair, stack = {}, []
    for at, token in enumerate(tokens):
        if token[1] in ("(", "["):
            stack.append(at)
        elif token[1] in (")", "]") and stack:
            pair[stack.pop()] = at
    held: dict[str, _Value] = {}
    out: list[_Value] = []

    def inside(value: str, a: int, b: int, argument: bool) -> tuple[int, int, bool]:
        """A string's place without its quotes."""
        width = 3 if len(value) >= 6 and value[:3] in ('"' * 3, "'" * 3) else 1
        return a + width, b - width, argument

    def arguments(given: _Value, first: int, last: int, deep: int) -> None:
        """Literals and names between two brackets."""
        at = first + 1
        while at < last:
            k, value, a, b = tokens[at]
            if k == "string":
                given.literals.append(inside(value, a, b, True))
            elif k == "name" and value in held:
                given.sources.append(held[value])
            elif at in pair:
                if deep > 1:
                    arguments(given, at, pair[at], deep - 1)
                at = pair[at]
            at += 1

    for at in range(len(tokens) - 2):
        kind, word, *_ = tokens[at]
        if tokens[at + 1][1] not in ("=", ":=", ":", "=>") or kind not in ("name", "string"):
            continue
        target = word.strip("\"'") if kind == "string" else word
        given = _Value(name_score(target))
        place, wants = at + 2, True
        while place < len(tokens):
            k, value, a, b = tokens[place]
            called = place + 1 if k == "name" and place + 1 in pair else place
            if wants and called in pair:
                arguments(given, called, pair[called], DEEP)
                place = pair[called]
            elif wants and k == "string":
                given.literals.append(inside(value, a, b, False))
            elif wants and k == "name" and value in held:
                given.sources.append(held[value])
            elif wants and k == "bare" and (block := _BLOCK.match(text, a)):
                given.literals += [(block.start(1) + m.start(), block.start(1) + m.end(), False) for m in re.finditer(r"[^\s](?:[^\n]*[^\s])?", block[1])]
                break
            elif wants and k in ("name", "bare"):
                # an unquoted value runs on to the next white space or separator
                end = place
                while end + 1 < len(tokens) and tokens[end + 1][2] == tokens[end][3] and tokens[end + 1][0] in ("name", "bare"):
                    end += 1
                given.literals.append((a, tokens[end][3], False))
                place = end
            elif not (not wants and value == "+"):
                break
            wants = not wants
            place += 1
        held[target] = given
        out.append(given)
    for given in reversed(out):
        for source in given.sources:
            source.score = max(source.score, given.score)
    return out


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name and look like secrets."""
    return sorted({(3, a, b) for given in assigned(text) if given.score > 0 for a, b, argument in given.literals if given.score + literal_score(text[a:b]) >= REACH and not (argument and _SETTING.fullmatch(text[a:b]))})


def spans_of(text: str, likely: bool = True) -> list[tuple[int, int, int]]:
    """All spans, in the order of kinds. likely: whether to lex (a text without a sensitive word before an operator has no literal spans)."""
    return base_spans(text) + (literal_spans(text) if likely else [])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def _all_spans(texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """Spans of each text. Texts that no pattern can match are told in one vectorised pass."""
    full = texts.cast(pa.large_string()).fill_null("")
    possible = pc.match_substring_regex(full, r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}").to_pylist()
    likely = pc.match_substring_regex(full, _LIKELY).to_pylist()
    for i, (can, lex) in enumerate(zip(possible, likely, strict=True)):
        yield spans_of(full[i].as_py(), lex) if can or lex else []


_EMPTY = hashlib.sha256(b"").hexdigest()
_REPORT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_literal bigint"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans in _all_spans(batch.column("text")):
            n = Counter(k for k, _, _ in spans)
            base = hashlib.sha256(_joined([s for s in spans if s[0] < 3]).encode()).hexdigest() if spans else _EMPTY
            rows.append((n[0], n[1], n[2], base, _joined(spans), n[3]))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [c.split()[0] for c in _REPORT.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256 and spans (`kind:start:end`, by start)."""
    return docs.select("doc_id", "text").mapInArrow(_report, _REPORT)


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], "[SECRET]"] if not (out and a == at and out[-1] == "[SECRET]") else []
        at = b
    return "".join(out) + text[at:]


def _redact(texts: pd.Series) -> pd.Series:
    array = pa.array(texts, pa.large_string())
    return pd.Series([t if t is None or not s else _redacted(t, s) for t, s in zip(array.to_pylist(), _all_spans(array), strict=True)], dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in `text` replaced by `[SECRET]` (overlapping ones by a single one); n_chars follows where there is such a column."""
    out = docs.withColumn("text", F.pandas_udf(_redact, T.StringType())("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
