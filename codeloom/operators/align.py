"""Line alignment and edit scripts of two versions of a text."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACED, _ENDS, _RUNS = [(c, f" {c} ") for c in "()[]{};"], " \t\n\r\f\v", re.compile(r"\s{2,}", re.ASCII)
_DECLARED = re.compile(r"\s*(\w+)\s+(\w+)\s*=\s*.*;\s*", re.ASCII)
_RESOURCE = re.compile(r"\s*try\s*\((.*)\)\s*\{\s*", re.ASCII)
#: Lines of at most so many characters are kept with what they equal, and tables of at most so many cells with their path.
SHORT, SMALL = 200, 2_500


def normal(line: str) -> str:
    """As functions.text.normal_line, for lines inside a task."""
    for sign, spaced in _SPACED:
        line = line.replace(sign, spaced)
    return _RUNS.sub(" ", line.strip(_ENDS))


def forms(line: str, old: bool) -> frozenset[tuple[str, str]]:
    """What a line equals. An old declaration equals its assignment without the type, too; a new try with resources
    equals what an old line without types says, if these are its resources.
    """
    return (_kept_forms if len(line) <= SHORT else _forms)(line, old)


def _forms(line: str, old: bool) -> frozenset[tuple[str, str]]:
    whole = normal(line)
    out = {("line", whole)}
    if old:
        while "=" in line and (m := _DECLARED.fullmatch(line)):
            bare = line.replace(m[1] + " ", "")
            if bare == line:  # the type is not followed by a blank: nothing more to take off
                break
            line = bare
            whole = normal(line)
            out.add(("line", whole))
        out.add(("resource", whole))
    elif "try" in line and (m := _RESOURCE.fullmatch(line)):
        out.add(("resource", normal(m[1])))
    return frozenset(out)


_kept_forms = functools.lru_cache(1 << 14)(_forms)


def split_lines(text: str) -> list[str]:
    """Lines, without empty ones at the end."""
    return text.rstrip("\n").split("\n")


def align(old: list[str], new: list[str]) -> list[int]:
    """For each new line the old line it matches, or -1, on a path of least edits (insert, delete, substitute)."""
    out = [-1] * len(new)
    for kind, i, j in steps(old, new):
        if kind == " ":
            out[j] = i
    return out


def steps(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """(kind, old line, new line) of a path of least edits, in order: ` ` match, `-` delete, `+` insert, `~` substitute.

    Lines that match are always taken together; going back, a match is preferred to a
    deletion, that to an insertion, and that to a substitution. Costs are found row by row;
    of the table, every so many-th row is kept, and the rows between two of these are found
    again on the way back, so memory grows as the power 1.5 of the lines.
    """
    a, b = [forms(x, True) for x in old], [forms(x, False) for x in new]
    out: list[tuple[str, int, int]] = []
    i, j = len(a), len(b)
    while i and j and not a[i - 1].isdisjoint(b[j - 1]):
        i, j = i - 1, j - 1
        out.append((" ", i, j))
    width = j
    where: dict[tuple[str, str], list[int]] = {}
    for k, fs in enumerate(b[:width]):
        for f in fs:
            where.setdefault(f, []).append(k)
    if i * width <= SMALL:
        return _small_path(tuple(tuple(sorted({k for f in fs for k in where.get(f, ())})) for fs in a[:i]), width) + out[::-1]
    stairs = np.arange(width + 1, dtype=np.int32)

    def matches(row: int) -> np.ndarray:
        found = np.zeros(width, bool)
        for f in a[row - 1]:
            found[where.get(f, [])] = True
        return found

    def below(last: np.ndarray, row: int) -> np.ndarray:
        """The costs of a row, from those of the row above it."""
        same = matches(row)
        costs = np.empty(width + 1, np.int32)
        costs[0] = row
        costs[1:] = np.where(same, last[:-1], np.minimum(last[1:], last[:-1]) + 1)
        # insertions: the least of all starts to the left, except into matched places
        run = np.minimum.accumulate(costs - stairs) + stairs
        costs[1:] = np.where(same, costs[1:], np.minimum(costs, run)[1:])
        return costs

    apart = math.isqrt(i) + 1
    kept, last = {0: stairs}, stairs
    for row in range(1, i + 1):
        last = below(last, row)
        if row % apart == 0:
            kept[row] = last
    first, block = i + 1, [last]
    while i and j:
        if i - 1 < first:
            # the rows from the last kept one above up to this one
            first = (i - 1) // apart * apart
            block = [kept[first]]
            for row in range(first + 1, i + 1):
                block.append(below(block[-1], row))
        above, here = block[i - 1 - first], block[i - first]
        if not a[i - 1].isdisjoint(b[j - 1]):
            i, j = i - 1, j - 1
            out.append((" ", i, j))
        elif here[j] == above[j] + 1:
            i -= 1
            out.append(("-", i, j))
        elif here[j] == here[j - 1] + 1:
            j -= 1
            out.append(("+", i, j))
        else:
            i, j = i - 1, j - 1
            out.append(("~", i, j))
    out += [("-", k, 0) for k in range(i - 1, -1, -1)] + [("+", 0, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


@functools.lru_cache(1 << 14)
def _small_path(met: tuple[tuple[int, ...], ...], width: int) -> list[tuple[str, int, int]]:
    """steps() of a small table, told by the new lines that each old one matches: many texts have one such pattern. Its list must not be changed."""
    table = [list(range(width + 1))]
    for row, same in enumerate(met, 1):
        last, costs = table[-1], [row]
        for k in range(1, width + 1):
            costs.append(last[k - 1] if k - 1 in same else min(last[k], last[k - 1], costs[k - 1]) + 1)
        table.append(costs)
    i, j, out = len(met), width, []
    while i and j:
        if j - 1 in met[i - 1]:
            i, j = i - 1, j - 1
            out.append((" ", i, j))
        elif table[i][j] == table[i - 1][j] + 1:
            i -= 1
            out.append(("-", i, j))
        elif table[i][j] == table[i][j - 1] + 1:
            j -= 1
            out.append(("+", i, j))
        else:
            i, j = i - 1, j - 1
            out.append(("~", i, j))
    out += [("-", k, 0) for k in range(i - 1, -1, -1)] + [("+", 0, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def aligned(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows with matched array<int>: for each line of `new` the line of `old`, or -1; null if a text is null, which `status` says.

    Time is quadratic in one pair's lines, memory is not.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                lines = None if x is None or y is None else (split_lines(x), split_lines(y))
                out.append(None if lines is None else align(*lines))
            yield pd.Series(out, dtype=object)

    udf = F.pandas_udf(_typed(run), T.ArrayType(T.IntegerType()))
    whole = rows.withColumn("matched", udf(old, new))
    status = F.when(F.col(old).isNull() | F.col(new).isNull(), "missing").otherwise("aligned")
    return whole.withColumn("status", status)


def _typed(run):
    """pandas_udf reads the annotations, which must be objects."""
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return run


def edit_script(old: list[str], new: list[str]) -> list[str]:
    """The edits as text: ` line`, `- line`, `+ line` or `~ old -> new`."""
    return [f" {old[i]}" if kind == " " else f"- {old[i]}" if kind == "-" else f"+ {new[j]}" if kind == "+" else f"~ {old[i]} -> {new[j]}" for kind, i, j in steps(old, new)]


def edited(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows with script array<string>, the edits from one text to the other; null if a text is null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else edit_script(split_lines(x), split_lines(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return rows.withColumn("script", F.pandas_udf(_typed(run), T.ArrayType(T.StringType()))(old, new))
