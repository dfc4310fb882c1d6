"""Quality rules: rule failures by host, shrunk rates, host verdicts back on documents.

A document's own rules come first (`document_rules`): the base rule rejects it at once, the
soft rules only accuse it. Failures of any rule are then counted by host (column `source`),
and each host's failure rate is shrunk towards all hosts' by a beta prior whose two
parameters are fitted to the hosts' rates by moments. A host whose shrunk rate, less Z
posterior standard deviations, is above LIMIT is condemned: of its documents only those that
fail no rule stay. So one bad document does not condemn a small host, and a clean document
of a bad host is kept.

All of it is DataFrame functions. Words are runs of characters other than U+0020 and U+0009
to U+000D. Null and blank texts have no words, so they fail the base rule; a null host is a
host of its own; repeated rows count each time; other columns are ignored; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, small_side, staged, words

#: The base rule.
LEAST_WORDS, MOST_REPEAT_PERCENT = 10, 20
#: Soft rules: symbols per word, code points per word, repeated lines, each as a percentage.
MOST_SYMBOL_PERCENT, LEAST_WORD_CHARS, MOST_WORD_CHARS = 25, 2, 20
#: A host is condemned if its shrunk failure rate is above LIMIT by Z deviations.
LIMIT, Z = 0.6, 2.0
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _repeated_starts(ordered: Column) -> Column:
    """Where the windows begin that have an equal neighbour. ordered: (hash, place) of all windows, sorted."""

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get(ordered, k - 1)["h"] == x["h"], F.get(ordered, k + 1)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["i"]))


def document_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and soft_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    step = docs.withColumns({"loom_words": words(F.col("text")), "loom_lines": lines})
    step = step.withColumns(
        {
            "n_words": F.size("loom_words").cast("long"),
            "word_chars": F.length(F.array_join("loom_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("loom_lines") - F.size(F.array_distinct("loom_lines"))).cast("long"),
            "loom_windows": shingle_hashes(F.col("loom_words"), WINDOW),
        }
    ).drop("loom_words", "loom_lines")
    repeated = F.size(F.array_distinct("loom_windows")) < F.size("loom_windows")
    ordered = F.sort_array(F.transform("loom_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("loom_sorted", F.when(repeated, ordered).otherwise(none)).drop("loom_windows")
    step = step.withColumn("loom_starts", _repeated_starts(F.col("loom_sorted"))).drop("loom_sorted")
    # a repeated window covers WINDOW words, or fewer where the next one begins inside it
    covered = F.aggregate(
        F.transform(F.col("loom_starts"), lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("loom_starts", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    step = step.withColumn("n_repeat_words", covered.cast("long")).drop("loom_starts")
    n = F.col("n_words")
    return step.withColumns(
        {
            "base_failed": (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * n),
            "soft_failed": (100 * F.col("n_symbols") > MOST_SYMBOL_PERCENT * n) | (F.col("word_chars") < LEAST_WORD_CHARS * n) | (F.col("word_chars") > MOST_WORD_CHARS * n) | (F.col("n_dup_lines") > n / 10),
        }
    )


def host_verdicts(ruled: DataFrame) -> DataFrame:
    """One row per host: host, n_docs, n_failed, rate (shrunk), condemned.

    The beta prior has the mean and, by moments, the variance of the hosts' rates; hosts
    that do not differ beyond chance give a prior as strong as the mean host.
    """
    hosts = ruled.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    rates = hosts.agg(F.avg(raw).alias("mean"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("spread"), F.avg("n_docs").alias("size")).first()  # one row
    mean = max(min(rates["mean"] or 0.0, 0.999), 0.001)
    size = rates["size"] or 1.0
    strength = min(max(mean * (1 - mean) / rates["spread"] - 1, 1.0), size) if rates["spread"] else size
    a, b = mean * strength + F.col("n_failed"), (1 - mean) * strength + F.col("n_docs") - F.col("n_failed")
    rate = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate - Z * deviation > LIMIT).alias("condemned"))


def with_verdicts(ruled: DataFrame) -> DataFrame:
    """ruled (staged: it is read twice) with kept: the base rule's verdict, then the host's."""
    bad = staged(host_verdicts(ruled).where("condemned").select(F.col("host").alias("loom_host"), F.lit(True).alias("loom_bad")), "hosts")
    joined = ruled.join(small_side(bad), F.col("source").eqNullSafe(F.col("loom_host")), "left")
    kept = ~F.col("base_failed") & ~(F.coalesce("loom_bad", F.lit(False)) & F.col("soft_failed"))
    return joined.withColumn("kept", kept).drop("loom_host", "loom_bad")


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and COLUMNS."""
    ruled = staged(document_rules(docs.select("doc_id", "text", "source")).drop("text"), "ruled")
    return with_verdicts(ruled).select("doc_id", *COLUMNS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns. The rules run once over the texts."""
    ruled = document_rules(docs.select(F.struct(*docs.columns).alias("loom_doc"), F.col("text"), F.col("source")))
    ruled = staged(ruled.drop("text"), "ruled")
    return with_verdicts(ruled).where("kept").select("loom_doc.*")
