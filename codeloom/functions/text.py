"""Scalar functions over names, source text and records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit of an abstract class in a modifier mask (java.lang.reflect.Modifier).
ABSTRACT = 0x0400


def signature(name: Column, types: Column) -> Column:
    """`name(T1,T2)`."""
    return F.concat(name, F.lit("("), F.array_join(types, ","), F.lit(")"))


def after_last_dot(name: Column) -> Column:
    """The part behind the last dot; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")


def strip_generics(name: Column) -> Column:
    """A name without its type parameters, nested to any depth: what stands outside `<` and `>`; a `>` that closes nothing goes too."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("open"))

    def step(state: Column, c: Column) -> Column:
        depth = F.when(c == "<", state["open"] + 1).when(c == ">", F.greatest(state["open"] - 1, F.lit(0))).otherwise(state["open"])
        kept = (state["open"] == 0) & ~c.isin("<", ">")
        return F.struct(F.when(kept, F.concat(state["out"], c)).otherwise(state["out"]).alias("out"), depth.alias("open"))

    plain = ~name.contains("<") & ~name.contains(">")
    return F.when(plain, name).otherwise(F.aggregate(F.split(name, ""), start, step, lambda s: s["out"]))


def generic_placements(name: Column) -> Column:
    """All ways to put `<*>` behind some of the parameters of `f(p1,...,pn)`, but none and all of none: 2^n - 1 names.

    Empty unless there is exactly one pair of parentheses with parameters in it.
    """
    inside = F.regexp_extract(name, r"^[^()]*\(([^()]+)\)[^()]*$", 1)
    head, tail = F.substring_index(name, "(", 1), F.substring_index(name, ")", -1)
    parts = F.split(inside, ",")
    last = (F.pow(F.lit(2), F.size(parts)) - 1).cast("int")

    def placed(bits: Column) -> Column:
        marked = F.transform(parts, lambda p, i: F.when(F.floor(bits / F.pow(F.lit(2), i)) % 2 == 1, F.concat(p, F.lit("<*>"))).otherwise(p))
        return F.concat(head, F.lit("("), F.array_join(marked, ","), F.lit(")"), tail)

    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), placed))


def char_positions(text: Column, char: str) -> Column:
    """0-based places of a character."""
    places = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)))
    return F.filter(places, lambda i: F.substring(text, i + 1, F.lit(1)) == char)


def throws_tags(comment: Column) -> Column:
    """Map of exception to condition of the `@throws` tags of a comment; the last tag of a type counts."""
    pattern = F.lit(r"@throws\s+(\S+)\s+(.*)")
    pairs = F.arrays_zip(F.regexp_extract_all(comment, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(comment, pattern, F.lit(2)).alias("v"))
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )


def caught_types(declared: Column) -> Column:
    """The types of a multi-catch `A | B`."""
    return F.filter(F.transform(F.split(declared, r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def strip_fence(text: Column, language: str) -> Column:
    """Text without a Markdown code fence around it; both ends are needed. Null becomes empty."""
    blanks = F.lit(" \t\n\r")
    t = F.btrim(F.coalesce(text, F.lit("")), blanks)
    for opening in (f"```{language}", "```"):
        n = len(opening)
        t = F.when(t.startswith(opening) & t.endswith("```") & (F.length(t) >= n + 3), F.btrim(F.substring(t, F.lit(n + 1), F.length(t) - n - 3), blanks)).otherwise(t)
    return t


def with_newline(text: Column) -> Column:
    """Text that ends with a line feed."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def finding_hash(node: Column, path: Column, exceptions: Column) -> Column:
    """MD5 of a finding; the exceptions are sorted, as a set has no order."""
    return F.md5(F.concat_ws("|", node, F.array_join(path, ">"), F.array_join(F.array_sort(exceptions), ",")))


def commit_hash(patch: Column, strict: bool = False) -> Column:
    """The 40 characters behind `/commit/`; null where there are none, or an error if strict."""
    found = F.nullif(F.regexp_extract(patch, "/commit/(.{40})", 1), F.lit(""))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no commit in "), F.coalesce(patch, F.lit("null"))))) if strict else found


def example_id(repo: Column, commit: Column, name: Column) -> Column:
    """`repo_with_underscores+1234567+name`."""
    return F.concat_ws("+", F.translate(repo, "/", "_"), F.left(commit, F.lit(7)), name)


def exception_list(checked: Column, unchecked: Column) -> Column:
    """The checked list if there is one, else the unchecked one, comma-joined."""
    return F.array_join(F.when(F.size(checked) > 0, checked).otherwise(F.coalesce(unchecked, F.array().cast("array<string>"))), ", ")


def newline_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def lines(text: Column) -> Column:
    """Lines, without empty ones at the end."""
    return F.split(F.regexp_replace(text, "\n+$", ""), "\n")


_BLANK = "[ \\t\\n\\x0B\\f\\r]"


def normal_line(line: Column) -> Column:
    """A line as the aligner compares it: brackets and semicolons stand alone, ends are trimmed, runs of white space are one space."""
    spaced = F.regexp_replace(line, r"([()\[\]{};])", " $1 ")
    return F.regexp_replace(F.regexp_replace(spaced, f"^{_BLANK}+|{_BLANK}+$", ""), _BLANK + "{2,}", " ")


def trimmed(text: Column, right_only: bool = False) -> Column:
    """Text without white space at its ends, or at its right end."""
    return F.regexp_replace(text, f"{_BLANK}+$" if right_only else f"^{_BLANK}+|{_BLANK}+$", "")


def valid_lines(rows: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """0-based places, in [start, end), of lines with more than one character between white space."""
    start, end = F.lit(0) if start is None else start, F.size(rows) if end is None else end
    places = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.length(trimmed(F.get(rows, i))) > 1)


def may_have_handlers(text: Column) -> Column:
    """Cheap test before a diff: the words `try` and `catch`."""
    return text.contains("try") & text.contains("catch")


def declared_type(parameter: Column) -> Column:
    """The type in a catch clause's parameter: its first word."""
    return F.split(parameter, " ")[0]


def object_strings(text: Column) -> Column:
    """The objects of a JSON array, each as JSON text; null if it is no array."""
    return F.transform(F.from_json(text, "array<variant>"), lambda x: F.to_json(x))


def description(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def api_finding(method: Column, route: Column, exceptions: Column) -> Column:
    """Text of a finding at an API method. exceptions: map of name to condition."""
    shown = F.transform(F.array_sort(F.map_entries(exceptions)), lambda e: F.concat(F.lit("    "), e["key"], F.lit(":  "), F.coalesce(e["value"], F.lit("null")), F.lit("\n")))
    return F.concat(_finding_head(method, route), F.lit("exceptions:\n"), F.array_join(shown, ""))


def throw_finding(method: Column, route: Column, throws: Column) -> Column:
    """Text of a finding at throw statements. throws: array of (exception, statement)."""
    shown = F.transform(throws, lambda t: F.concat(F.lit("    "), t["exception"], F.lit(":"), F.replace(t["statement"], F.lit("\n"), F.lit("\t")), F.lit("\n")))
    return F.concat(_finding_head(method, route), F.lit("throws:\n"), F.array_join(shown, ""))


# The texts of findings.
def _finding_head(method: Column, route: Column) -> Column:
    return F.concat(F.lit("method: "), method, F.lit("\nroute:\n    ["), F.array_join(route, ", "), F.lit("]\n"))


def range_and_lines(start: Column, end: Column, more: Column) -> Column:
    """The lines of a half-open range, and more behind them."""
    return F.concat(F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>")), more)


def class_type(is_interface: Column, modifier: Column) -> Column:
    return F.when(is_interface, "interface").when(modifier.bitwiseAND(ABSTRACT) != 0, "abstract class").otherwise("class")


def marked_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines with `O ` before those in [start, end)."""
    return F.transform(lines(text), lambda x, i: F.when((i >= start) & (i < end), F.concat(F.lit("O "), x)).otherwise(F.concat(F.lit("  "), x)))


def source_path(class_name: Column) -> Column:
    """`a.b.C` as `a/b/C.java`."""
    return F.concat(F.replace(class_name, F.lit("."), F.lit("/")), F.lit(".java"))


def encoder_input(text: Column) -> Column:
    """`[CLS]` before the text and `[SEP]` for line feeds."""
    return F.concat(F.lit("[CLS]"), F.replace(text, F.lit("\n"), F.lit("[SEP]")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """Place of the first greatest value."""
    return F.array_position(values, F.array_max(values)) - 1


def localized_time(text: Column) -> Column:
    """Timestamp of `5月 07, 2025 12:54:13 下午`: month number, day, year, 12-hour clock, morning or afternoon."""
    month, day, year, hour, minute, second, half = (F.regexp_extract(text, r"(\d+)月 (\d+), (\d+) (\d+):(\d+):(\d+) (上午|下午)", k) for k in range(1, 8))
    hour24 = hour.cast("int") % 12 + F.when(half == "下午", 12).otherwise(0)
    return F.when(month != "", F.make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), hour24, minute.cast("int"), second.cast("decimal(8,6)")))


def overlay(base: Column, over: Column) -> Column:
    """Map of both, where `over` wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def retained(first: Column, second: Column) -> Column:
    """Elements of `first` that `second` has, in order and as often as they stand there."""
    return F.filter(first, lambda x: F.array_contains(second, x))


def locate(whole: Column, part: Column) -> Column:
    """0-based place where the lines of `part` first stand together in `whole`; null where they do not."""
    starts = F.sequence(F.lit(0), F.size(whole) - F.size(part))
    hits = F.filter(starts, lambda i: F.slice(whole, i + 1, F.size(part)) == part)
    return F.when((F.size(part) > 0) & (F.size(whole) >= F.size(part)), F.get(hits, F.lit(0)))


def line_range(own: Column) -> Column:
    """Half-open range that a list of lines spans; null for none."""
    return F.when(F.size(own) > 0, F.struct(F.array_min(own).alias("start"), (F.array_max(own) + 1).alias("end")))


def path_parts(path: Column) -> Column:
    """Of a call path: the direct callee, the last caller and the depth; null where it is too short."""
    return F.struct(F.get(path, F.lit(1)).alias("callee"), F.try_element_at(path, F.lit(-2)).alias("last_caller"), (F.size(path) - 1).alias("depth"))
