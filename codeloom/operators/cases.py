"""Experiment cases: cohort filters, lookups, construction, results copied back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import staged

# Repositories that cannot be analysed.
DENIED = ["junit-team/junit5", "OpenLiberty/open-liberty", "opensourceBIM/BIMserver", "openjdk/jdk"]
KEYS = ["repo_id", "patch", "methodName"]
#: Fields that a case without change has empty.
RESULT_LISTS = ["resultAfterTargetNoNestingLines", "resultBeforeTargetNoNestingLines", "resultCatchBlocks", "resultExceptionTypes"]
RESULT_LINES = ["resultAfterTargetEndLine", "resultAfterTargetStartLine", "resultBeforeTargetEndLine", "resultBeforeTargetStartLine"]
#: Fields that a positive case keeps; the others are not copied.
COPIED = ["afterTargetStartLine", "beforeTargetEndLine", "afterTargetEndLine", "beforeTargetStartLine", "label", "methodBefore", "methodName", "methodAfter", "repo_id", "patch", "file_path", "method_name", "methodResult", "afterTargetNoNestingLines", "exceptionTypes", "beforeTargetNoNestingLines", "catchBlocks"]


def allowed(rows: DataFrame, column: str, denied: list[str] = DENIED) -> DataFrame:
    """Rows of no denied repository (a null one is kept)."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(denied))


def any_of(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows one of whose names in an array is in names (column name). A row is known by its number, so rows of like texts are told apart."""
    placed = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    hit = placed.select("_row", F.explode(column).alias("name")).join(names.select("name"), "name", "left_semi").select("_row").distinct()
    return placed.join(hit, "_row", "left_semi").drop("_row")


def has_findings(checked: Column, unchecked: Column) -> Column:
    """Whether something is left: of the checked list if there is one, even an empty one, else of the unchecked list."""
    return F.size(F.coalesce(checked, unchecked, F.array().cast("array<string>"))) > 0


def cohort(label: Column, n_lines: Column, path: Column, types: Column, least_lines: int = 3) -> Column:
    """Why a case may be left out: `unknown` label, `short` method, `test` file, only `RuntimeException`; else `kept`."""
    only = (F.size(types) > 0) & F.forall(types, lambda t: t.isin("RuntimeException", "java.lang.RuntimeException"))
    return F.when(F.coalesce(label, F.lit(-1)) == -1, "unknown").when(n_lines < least_lines, "short").when(F.lower(path).contains("test"), "test").when(F.coalesce(only, F.lit(False)), "runtime").otherwise("kept")


def keep_or_all(rows: DataFrame, case: str, keep: Column) -> DataFrame:
    """Rows that a filter keeps; of a case of which it keeps none, all rows."""
    tagged = rows.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    some = tagged.groupBy(F.col(case).alias("_case")).agg(F.max("_keep").alias("_some"))
    return tagged.join(some, F.col(case).eqNullSafe(F.col("_case"))).where("_keep or not _some").select(*rows.columns)


def lookup(rows: DataFrame, keys: dict[str, object], order: list[str]) -> DataFrame:
    """The first row with these values, or none."""
    for column, value in keys.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*order).limit(1)


def next_undone(todo: DataFrame, done: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The next row that is not done, or none; a null key never counts as done."""
    return todo.join(done.select(*keys), keys, "left_anti").orderBy(*order).limit(1)


def with_changed(rows: DataFrame, before: str, result: str, changed: Column) -> DataFrame:
    """rows with changed: 0 where the texts are equal (two nulls are), else what is given; without change the result fields are empty."""
    out = rows.withColumn("changed", F.when(F.col(before).eqNullSafe(F.col(result)), 0).otherwise(F.coalesce(changed, F.lit(0))))
    return reset_unchanged(out)


def reset_unchanged(rows: DataFrame) -> DataFrame:
    """rows whose result fields are empty or 0 where changed is 0."""
    there = set(rows.columns)
    empty = {c: F.when(F.col("changed") == 0, F.array().cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in RESULT_LISTS if c in there}
    zero = {c: F.when(F.col("changed") == 0, F.lit(0)).otherwise(F.col(c)) for c in RESULT_LINES if c in there}
    return rows.withColumns(empty | zero) if empty or zero else rows


def positive(rows: DataFrame) -> DataFrame:
    """Copies of cases: the fields of COPIED, the others null."""
    return rows.select(*(F.col(c) if c in COPIED else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))


def negative(rows: DataFrame, name: Column, simple: Column) -> DataFrame:
    """Negative cases of the same file: label 0, another method's name, all else empty but repository, patch and file."""

    def field(c: str) -> Column:
        kind = rows.schema[c].dataType
        given = {"methodName": name, "method_name": simple, "repo_id": F.col("repo_id"), "patch": F.col("patch"), "file_path": F.col("file_path"), "label": F.lit(0)}
        if c in given:
            return given[c].cast(kind).alias(c)
        if c not in COPIED:
            return F.lit(None).cast(kind).alias(c)
        return (F.array() if kind.typeName() == "array" else F.lit(0) if kind.typeName() == "integer" else F.lit("")).cast(kind).alias(c)

    return rows.select(*map(field, rows.columns))


def add_results(done: DataFrame, results: DataFrame) -> DataFrame:
    """Results behind those there are; columns that one side lacks are null."""
    return done.unionByName(results, allowMissingColumns=True)


def clone_urls(repositories: DataFrame, index: DataFrame) -> DataFrame:
    """repositories (full_name) with the clone_url of the index, null where it has none; of several the least."""
    known = index.groupBy("full_name").agg(F.min("clone_url").alias("clone_url"))
    return repositories.join(known, "full_name", "left")


def grouped(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key with its rows as a list, in order. A list is one row: for keys whose rows fit a task."""
    rest = [c for c in rows.columns if c != key]
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("_row"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x["_row"]).alias("rows"))


def type_class(rows: DataFrame, key: str, column: str, known: DataFrame) -> DataFrame:
    """(key, class) of type lists `A | B`: of one type -1 unknown, 0 or 1; of several 2 with a runtime one, else -3. known: name, runtime."""
    from codeloom.functions.text import caught_types

    parts = rows.select(key, F.size(caught_types(F.col(column))).alias("n"), F.explode(caught_types(F.col(column))).alias("name"))
    flags = parts.join(known.select("name", "runtime"), "name", "left").groupBy(key).agg(F.first("n").alias("n"), F.max("runtime").alias("r"))
    return flags.select(key, F.when(F.col("n") == 1, F.coalesce("r", F.lit(-1))).when(F.col("r") == 1, 2).otherwise(-3).alias("class"))


def distinct_words(rows: DataFrame, words: Column, name: str) -> DataFrame:
    """The distinct elements of an array column."""
    return rows.select(F.explode(words).alias(name)).distinct()


def flat_map_json(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row: a JSON object of all (key, value), keys in order. As wide as the keys: for name tables."""
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value)))))).alias("json"))
