"""Functions by name, so that free SQL can call what the library has: names, lookups, tries and edit scripts, with LATERAL too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.operators import align, handlers

#: Scalar and table functions in SQL itself, which the optimizer sees through. kb_names is a view of known names (column name).
SQL_FUNCTIONS = {
    "loom_simple_name": "(name STRING) RETURNS STRING RETURN CASE WHEN instr(name, '.') > 0 THEN substring_index(name, '.', -1) ELSE name END",
    "loom_owner": "(name STRING) RETURNS STRING RETURN regexp_extract(substring_index(name, '(', 1), '^(.*)\\\\.[^.]*$', 1)",
    "loom_erased": "(name STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(regexp_replace(name, '<[^<>]*>', ''), '<[^<>]*>', ''), '<[^<>]*>', '')",
}
# A name is met by equality with its endings at dots, itself among them, so no suffix is tested against all names.
TABLE_FUNCTIONS = {
    "loom_ending": "(suffix STRING) RETURNS TABLE (name STRING) RETURN SELECT k.name FROM (SELECT n.name, explode(transform(sequence(1, size(split(n.name, '[.]'))), i -> array_join(slice(split(n.name, '[.]'), i, size(split(n.name, '[.]'))), '.'))) AS ending FROM kb_names n) k WHERE k.ending = suffix",
}
#: Table functions over lists that tasks make in batches.
LIST_FUNCTIONS = {
    "loom_tries": "(text STRING) RETURNS TABLE (place INT, start INT, end INT, types STRING) RETURN SELECT t.place, t.start, t.end, t.types FROM inline(loom_try_list(text)) t",
    "loom_edits": "(old STRING, new STRING) RETURNS TABLE (place INT, edit STRING) RETURN SELECT e.pos, e.col FROM posexplode(loom_edit_list(old, new)) e",
}


def try_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The try statements of methods' texts: place, start, end (half-open lines), types."""
    for texts in batches:
        yield pd.Series([[(t["place"], t["start"], t["end"], "|".join(t["types"])) for t in handlers.try_statements(x or "")] for x in texts], dtype=object)


def edit_list(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The edit scripts of two texts, line by line."""
    for old, new in batches:
        yield pd.Series([None if a is None or b is None else align.edit_script(a.split("\n"), b.split("\n")) for a, b in zip(old, new, strict=True)], dtype=object)


try_list.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
edit_list.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}


def register(spark: SparkSession, names: str | None = None) -> list[str]:
    """Make the functions known to the session's SQL, and list them. names: the view that loom_ending looks names up in (column name)."""
    done = list(SQL_FUNCTIONS)
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    if names:
        for name, body in TABLE_FUNCTIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body.replace('kb_names', names)}")
            done.append(name)
    spark.udf.register("loom_try_list", F.pandas_udf(try_list, "array<struct<place:int,start:int,end:int,types:string>>"))
    spark.udf.register("loom_edit_list", F.pandas_udf(edit_list, "array<string>"))
    for name, body in LIST_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return [*done, *LIST_FUNCTIONS]
