"""Handlers of a method: its try statements, their nesting, and those that a new version added."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import lines, may_have_handlers, valid_lines
from codeloom.operators.align import aligned
from codeloom.session import staged

#: A try statement, with its lines in the method as a half-open range, in the order of the text.
TRY = "array<struct<place:int,start:int,end:int,types:array<string>,bodies:array<string>>>"
_TOKEN = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|([A-Za-z_$][\w$]*|[(){}])', re.S)


def try_statements(text: str) -> list[dict]:
    """The try statements of a method's text, by tokens and braces; one that does not close is left out."""
    if "try" not in text:
        return []
    found = [m for m in _TOKEN.finditer(text) if m[1]]
    words, pair, stack = [m[1] for m in found], {}, []
    for k, w in enumerate(words):
        if w in "({":
            stack.append(k)
        elif w in ")}" and stack:
            pair[stack.pop()] = k
    line = lambda k: text.count("\n", 0, found[k].start())
    out = []
    for k, w in enumerate(words):
        if w != "try":
            continue
        body = pair.get(k + 1, k) + 1 if words[k + 1 : k + 2] == ["("] else k + 1
        if words[body : body + 1] != ["{"] or body not in pair:
            continue
        last, types, bodies = pair[body], [], []
        while words[last + 1 : last + 3] == ["catch", "("] and pair.get(last + 2, -1) + 1 in pair:
            inside = found[last + 2].end(), found[pair[last + 2]].start()
            block = pair[last + 2] + 1
            declared = text[slice(*inside)].split()
            types.append(next((x for x in declared if x != "final"), ""))
            bodies.append(text[found[block].start() : found[pair[block]].end()])
            last = pair[block]
        if words[last + 1 : last + 3] == ["finally", "{"] and last + 2 in pair:
            last = pair[last + 2]
        out.append({"place": len(out), "start": line(k), "end": line(last) + 1, "types": types, "bodies": bodies})
    return out


def with_tries(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the try statements of a text (none for null)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([try_statements(t or "") for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(name, F.pandas_udf(run, T._parse_datatype_string(TRY))(column))


def nesting(tries: Column, n_lines: Column) -> Column:
    """Of each line how many tries cover it."""
    return F.transform(_places(n_lines), lambda i: F.size(F.filter(tries, lambda t: (t["start"] <= i) & (i < t["end"]))))


def owners(tries: Column, n_lines: Column) -> Column:
    """Of each line the place of the last try that covers it; -1 for none."""
    return F.transform(_places(n_lines), lambda i: F.coalesce(F.array_max(F.transform(F.filter(tries, lambda t: (t["start"] <= i) & (i < t["end"])), lambda t: t["place"])), F.lit(-1)))


def ancestors_of(tries: Column, one: Column) -> Column:
    """Places of the tries around one: those that begin before it, or with it and before it in the text, and end with it or later."""
    around = lambda t: (t["place"] < one["place"]) & (t["start"] <= one["start"]) & (t["end"] >= one["end"])
    return F.transform(F.filter(tries, around), lambda t: t["place"])


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def added(match: Column, tries: Column, depth_before: Column, depth_after: Column, owner: Column, text: Column) -> Column:
    """The tries of a new version that were added, in order.

    match: old line of each new one, or -1; text: the new lines. A try was added if a valid line
    of it matches an old line whose nesting is less than its own by more than the tries around it
    that were added already, and such a line is its own.
    """

    def gained(t: Column, line: Column, accepted: Column) -> Column:
        old = F.get(match, line)
        around = F.size(F.array_intersect(ancestors_of(tries, t), F.transform(accepted, lambda x: x["place"])))
        return (old >= 0) & (F.get(owner, line) == t["place"]) & (F.get(depth_after, line) > F.get(depth_before, old) + around)

    def step(accepted: Column, t: Column) -> Column:
        return F.when(F.exists(valid_lines(text, t["start"], t["end"]), lambda line: gained(t, line, accepted)), F.array_append(accepted, t)).otherwise(accepted)

    return F.aggregate(tries, F.array().cast(TRY), step)


def described(t: Column, match: Column, owner: Column, text: Column) -> Column:
    """What is recorded of an added try: its ranges and own lines in both versions, types and catch bodies."""
    at = lambda places: F.filter(F.transform(places, lambda i: F.get(match, i)), lambda x: x >= 0)
    own = F.filter(_places(F.size(text)), lambda i: F.get(owner, i) == t["place"])
    before = at(valid_lines(text, t["start"], t["end"]))
    # The names of the fields.
    return F.struct(
        F.array_min(before).alias("beforeTargetStartLine"), (F.array_max(before) + 1).alias("beforeTargetEndLine"), at(own).alias("beforeTargetNoNestingLines"),
        t["start"].alias("afterTargetStartLine"), t["end"].alias("afterTargetEndLine"), own.alias("afterTargetNoNestingLines"), t["types"].alias("exceptionTypes"), t["bodies"].alias("catchBlocks"),
    )


def method_diff(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows with changes (the added tries, described; none for pairs that cannot have any) and error (which text is missing).

    The cheap test comes first: only pairs whose new text has the words of a handler are aligned.
    """
    possible = F.coalesce(may_have_handlers(F.col(after)), F.lit(False))
    kept = rows.withColumns({"_before": F.when(possible, F.col(before)), "_after": F.when(possible, F.col(after))})
    kept = with_tries(with_tries(aligned(kept, "_before", "_after").drop("status"), "_before", "_tries1"), "_after", "_tries2")
    kept = kept.withColumns({"_lines1": lines(F.col("_before")), "_lines2": lines(F.col("_after"))})
    kept = kept.withColumns({"_depth1": nesting(F.col("_tries1"), F.size("_lines1")), "_depth2": nesting(F.col("_tries2"), F.size("_lines2")), "_owner": owners(F.col("_tries2"), F.size("_lines2"))})
    # written once: else the arrays would be worked out again for each line that looks into them
    kept = staged(kept, "lines")
    kept = kept.withColumn("_added", added(F.col("matched"), F.col("_tries2"), F.col("_depth1"), F.col("_depth2"), F.col("_owner"), F.col("_lines2")))
    one = F.transform("_added", lambda t: described(t, F.col("matched"), F.col("_owner"), F.col("_lines2")))
    none = F.array().cast(kept.select(one.alias("x")).schema["x"].dataType)
    error = F.when(F.col(before).isNull(), "no old text").when(F.col(after).isNull(), "no new text")
    return kept.withColumns({"changes": F.coalesce(one, none), "error": error}).select(*rows.columns, "changes", "error")


def paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, before, after) of what both versions have by name, with different text. old, new: keys, name, text."""
    return old.select(*keys, "name", F.col("text").alias("before")).join(new.select(*keys, "name", F.col("text").alias("after")), [*keys, "name"]).where("before != after")


def file_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of the methods that both versions of a file have by name, with different text."""
    return method_diff(paired(old, new, keys), "before", "after")


def first_change(rows: DataFrame) -> DataFrame:
    """rows with `changed`, how many changes there are, and the first one's fields as result columns."""
    first = F.get("changes", F.lit(0))
    fields = [f.name for f in rows.schema["changes"].dataType.elementType.fields]
    return rows.select("*", F.size("changes").alias("changed"), *(first[f].alias("result" + f[0].upper() + f[1:]) for f in fields))


def changes_json(changes: Column, name: Column, before: Column, after: Column) -> Column:
    """The changes as a JSON array of objects, each with the method's name and texts."""
    return F.to_json(F.transform(changes, lambda c: F.struct(name.alias("methodName"), before.alias("methodBefore"), after.alias("methodAfter"), c.alias("target"))))
