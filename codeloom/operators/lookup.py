"""Names against tables of suffixes and of patterns: equality joins on blocks and grams, exact tests behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import staged

#: Lengths of the blocks that suffixes are found by, longest first.
BLOCKS = (64, 32, 16, 8, 4, 2, 1)
#: Lengths of grams, longest first.
GRAMS = (3, 2, 1)


def suffix_join(names: DataFrame, suffixes: DataFrame, match: str = "segment") -> DataFrame:
    """(suffix, name): the different names that end in each suffix; at a dot or as a whole (`segment`), anywhere (`end`), or anywhere without case (`like`).

    A suffix is a prefix of the name read backwards. Each stands under its longest block, a prefix of a
    power of two; names stand under their blocks of the lengths that suffixes have. So a suffix meets the names
    that share its block, all suffixes in one shuffle. The empty suffix fits every name. Nulls fit nothing.
    Both sides are shuffled: Spark would take the names, as long as their files are small, for a side to broadcast,
    but a name stands under several blocks, and in memory is many times its place in a compressed file.
    """
    if match not in ("segment", "end", "like"):
        raise ValueError(f"unknown match {match}")
    form = (lambda c: F.lower(c)) if match == "like" else (lambda c: c)
    asked = suffixes.select("suffix").where("suffix is not null").distinct().withColumn("_s", F.reverse(form(F.col("suffix"))))
    block = F.coalesce(*(F.when(F.length("_s") >= n, n) for n in BLOCKS), F.lit(0))
    asked = staged(asked.withColumn("_n", block).withColumn("_b", F.substring(F.col("_s"), F.lit(1), F.col("_n"))), "suffixes")
    lengths = sorted(r["_n"] for r in asked.select("_n").distinct().collect())  # eight at most
    known = names.select("name").where("name is not null").distinct().withColumn("_r", F.reverse(form(F.col("name"))))
    keys = F.filter(F.array(*map(F.lit, lengths or [0])), lambda n: n <= F.length("_r"))
    known = known.withColumn("_n", F.explode(keys)).withColumn("_b", F.substring(F.col("_r"), F.lit(1), F.col("_n")))
    met = known.join(asked.hint("merge"), ["_n", "_b"]).where(F.col("_r").startswith(F.col("_s")))
    if match == "segment":
        met = met.where((F.length("_r") == F.length("_s")) | (F.substring(F.col("_r"), F.length("_s") + 1, F.lit(1)) == "."))
    return met.select("suffix", "name")


def pattern_join(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, name): the different names that each `LIKE` pattern (`%`, `_`, escaped by `\\`) fits, without case.

    Names are indexed by their grams of three characters. A pattern is looked up by its rarest gram, and `ilike` decides.
    One without three literal characters in a row goes by two or one; one without any meets all names, as it must.
    """
    asked = staged(patterns.select("pattern").where("pattern is not null").distinct(), "patterns")
    low = F.lower("pattern")
    # escaped signs stand for themselves
    for sign, mark in (("\\\\", "\x03"), ("\\%", "\x01"), ("\\_", "\x02")):
        low = F.replace(low, F.lit(sign), F.lit(mark))
    plain = F.transform(F.split(low, "[%_]"), lambda x: F.translate(x, "\x03\x01\x02", "\\%_"))

    def grams(texts, n: int):
        return F.flatten(F.transform(texts, lambda t: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))

    size = F.array_max(F.transform(plain, lambda t: F.length(t)))
    own = F.coalesce(*(F.when(size >= n, grams(plain, n)) for n in GRAMS), F.array(F.lit("")))
    wanted = staged(asked.select("pattern", F.explode(F.array_distinct(own)).alias("gram")), "grams")
    lengths = sorted(r["n"] for r in wanted.select(F.length("gram").alias("n")).distinct().collect())  # four at most
    known = staged(names.select("name").where("name is not null").distinct(), "names")
    lists = [F.array(F.lit("")) if n == 0 else grams(F.array(F.lower("name")), n) for n in lengths]
    index = known.select("name", F.explode(F.array_distinct(F.concat(*lists) if lists else F.array(F.lit("")))).alias("gram"))
    index = staged(index.join(wanted.select("gram").distinct(), "gram", "left_semi"), "index")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no name has is the rarest: the pattern then fits none
    rarest = wanted.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).select("pattern", F.col("x.gram").alias("gram"))
    return rarest.join(index, "gram").where(F.expr("name ilike pattern")).select("pattern", "name")
