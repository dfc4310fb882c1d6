"""Java source as tokens: levels of brackets, statements, and the statements around each place.

A file becomes tokens by one pattern that takes every character. Brackets are matched by running
sums: a token's level is the number of brackets around it. Within a level what stands in deeper
brackets is left out, so a statement reads flat, as `if ( ) throw new X ( ) ;`, and its
boundaries are the semicolons, closing braces and enclosing brackets of that level. The
statements around a place are, of each level down to its own, the last that starts before it,
if that has not ended.

Texts that end inside a bracket, a comment or a string are read as far as they go; null and empty
texts have no tokens; a file is one row of the input and is read by itself, in one task.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cache

# Words of the language that are no names.
KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while".split())
#: White space as Java's patterns have it.
SPACE = r" \t\n\x0B\f\r"


@cache
def name_pattern() -> str:
    """A name: letters, digits, `_` and `$`, and no number of any script first."""
    numbers = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
    return rf"(?:(?![{numbers}])[^\W\d]|\$)[\w$]*"


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Of tokens (text blocks, strings, characters, comments, words, numbers, arrows, white space, all else), and of words."""
    name, any_ = name_pattern(), r"[^\n\r\u0085\u2028\u2029]"
    token = rf'"""[\s\S]*?"""|"[^"\\\n]*+(?:\\{any_}[^"\\\n]*+)*+"|' + rf"'[^'\\\n]*+(?:\\{any_}[^'\\\n]*+)*+'" + rf"|/\*[\s\S]*?\*/|//[^\n]*|{name}|[0-9][A-Za-z0-9_.]*|->|::|\.\.\.|[{SPACE}]+|[\s\S]"
    return re.compile(token), re.compile(name)


@dataclass(slots=True)
class Token:
    """A code token at a level. chain: the last token before it that is neither name nor dot; next: the token after it; around: the bracket its level lies in."""

    i: int
    text: str
    line: int
    doc: str | None
    around: int
    chain: str | None = None
    next: str | None = None


@dataclass(slots=True)
class Statement:
    """start, end, body: places of its first and last token and of its brace (None without); head: its tokens down to the brace, with blanks between.

    run: the number of the chain that `else`, `catch` and `finally` continue. The rest is what extract.py finds out.
    """

    level: int
    around: int
    start: int
    end: int
    body: int | None
    line: int
    doc: str | None
    items: list[Token]
    head: str
    run: int = 0
    kind: str = "other"
    name: str | None = None
    typed: bool = False
    inside: str | None = None
    condition: str | None = None
    types: list[str] | None = None
    variable: str | None = None
    handlers: list[str] = field(default_factory=list)


class Source:
    """A file's raw tokens, the tokens of each level, and its statements by level and start."""

    def __init__(self, text: str) -> None:
        token, word = _patterns()
        self.raw = token.findall(text)
        self.levels: dict[int, list[Token]] = {}
        self.statements: dict[int, list[Statement]] = {}
        code, line, doc, low, total = [], 0, None, 0, 0
        for i, t in enumerate(self.raw):
            first = t[0]
            if first in " \t\n\x0b\f\r":
                line += t.count("\n")
                continue
            if first == "/" and t[1:2] in ("*", "/") and len(t) > 1:
                doc = t
                line += t.count("\n")
                continue
            step = 1 if t in "({[" else -1 if t in ")}]" else 0
            total += step
            low = min(low, total)
            # a closing bracket that nothing opened starts anew at level 0
            code.append((i, t, line, doc, total - low - (step > 0), step > 0))
            line += t.count("\n")
            doc = None
        self._place(code, word)
        runs: dict[int, int] = {}
        for s in sorted((s for of in self.statements.values() for s in of), key=lambda s: s.start):
            runs[s.around] = runs.get(s.around, 0) + (not s.head.startswith(("else ", "catch ", "finally ")))
            s.run = runs[s.around]
        self._starts = {level: [s.start for s in of] for level, of in self.statements.items()}

    def _place(self, code: list[tuple], word: re.Pattern) -> None:
        around: dict[int, int] = {}
        chain: dict[int, str | None] = {}
        last: dict[int, Token | None] = {}
        open_: dict[int, list[Token]] = {}
        for i, t, line, doc, level, opens in code:
            shown = '""' if t[0] in "\"'" else t
            one = Token(i, shown, line, doc, around.get(level, -1), chain.get(level))
            if (before := last.get(level)) is not None:
                before.next = t
            last[level] = one
            self.levels.setdefault(level, []).append(one)
            open_.setdefault(level, []).append(one)
            if t != "." and (t in KEYWORDS or not (t.isascii() and t.isidentifier() or word.fullmatch(t))):
                chain[level] = t
            if t in (";", "}"):
                self._end(level, open_.pop(level))
            if opens:
                inside = level + 1
                if inside in open_:
                    self._end(inside, open_.pop(inside))
                around[inside], chain[inside], last[inside] = i, t, None
        for level, items in open_.items():
            self._end(level, items)

    def _end(self, level: int, items: list[Token]) -> None:
        words = [x.text for x in items]
        brace = words.index("{") if "{" in words else None
        body = None if brace is None else items[brace].i
        # a brace that nothing closes holds the rest of the file
        end = 1 << 30 if items[-1].i == body else items[-1].i
        head = " ".join(words if brace is None else words[: brace + 1])
        self.statements.setdefault(level, []).append(Statement(level, items[0].around, items[0].i, end, body, items[0].line, items[0].doc, items, head))

    def between(self, start: int, end: int) -> str:
        """What stands between two tokens, as it is written."""
        return "".join(self.raw[start + 1 : end])

    def around(self, i: int, level: int) -> list[Statement]:
        """The statements around a place, outermost first."""
        out = []
        for k in range(level + 1):
            at = bisect_right(self._starts.get(k, ()), i) - 1
            if at >= 0 and (s := self.statements[k][at]).end >= i:
                out.append(s)
        return out
