"""Sources and sinks: source trees, jars, examples, logs, caches."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import small_side, staged

_INTS, _STRINGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())

#: An experiment example as its JSON files hold it.
EXAMPLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repo_id", "patch", "methodName", "file_path", "method_name", "methodBefore", "methodAfter", "methodResult")]
    + [T.StructField(n, _STRINGS) for n in ("exceptionTypes", "catchBlocks", "resultExceptionTypes", "resultCatchBlocks")]
    + [T.StructField(f"{side}Target{end}Line", T.IntegerType()) for side in ("before", "after", "resultBefore", "resultAfter") for end in ("Start", "End")]
    + [T.StructField(f"{side}TargetNoNestingLines", _INTS) for side in ("before", "after", "resultBefore", "resultAfter")]
    + [T.StructField("label", T.IntegerType()), T.StructField("changed", T.IntegerType())]
)
INDEX = T.StructType([T.StructField("full_name", T.StringType()), T.StructField("clone_url", T.StringType())])


def source_files(spark: SparkSession, root: str, ignored: list[str] = (), suffix: str = "java") -> DataFrame:
    """(path, content) of all files of a suffix below root, without ignored subtrees (paths relative to root)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").text(root, wholetext=True)
    relative = F.regexp_replace(F.input_file_name(), f"^.*?{_escaped(root)}/?", "")
    files = files.select(relative.alias("path"), F.col("value").alias("content"))
    for part in ignored:
        files = files.where(~(F.col("path").startswith(part.rstrip("/") + "/") | (F.col("path") == part)))
    return files


def jar_paths(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jar").load(root).select("path")


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text.rstrip("/"))


def source_root(path: Column, content: Column) -> Column:
    """A file's path without its package and name."""
    package = F.regexp_extract(content, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    tail = F.concat(F.lit("/"), F.replace(package, F.lit("."), F.lit("/")), F.lit("/"))
    folder = F.regexp_replace(F.concat(F.lit("/"), path), "[^/]*$", "")
    return F.when((package != "") & folder.endswith(tail), F.substring(folder, F.lit(2), F.greatest(F.length(folder) - F.length(tail) - 1, F.lit(0)))).otherwise(F.substring(folder, F.lit(2), F.length(folder) - 2))


def class_name(path: Column, root: Column) -> Column:
    """`a/b/C.java` below a source root as `a.b.C`."""
    inner = F.when(root == "", path).otherwise(F.substring(path, F.length(root) + 2, F.length(path)))
    return F.replace(F.regexp_replace(inner, r"\.java$", ""), F.lit("/"), F.lit("."))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a JSON array file; absent numbers are 0, as the writers leave them out."""
    rows = spark.read.schema(EXAMPLE).option("multiLine", "true").json(path)
    return rows.fillna(0, [f.name for f in EXAMPLE if f.dataType == T.IntegerType()])


def examples_or_none(spark: SparkSession, path: str) -> DataFrame:
    """examples, or no rows where nothing is written yet."""
    from pyspark.errors import AnalysisException

    try:
        return examples(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EXAMPLE)


def _summed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (file, block, at) with the sum of a value over the earlier rows of the file: within splits, and of the splits before by one row each."""
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(F.col("file").alias("_f"), F.col("block").alias("_b")).agg(F.sum(value).alias("_n"))
    starts = staged(splits.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    inside = rows.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    met = inside.join(small_side(starts), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return staged(met.withColumn(name, F.col(name) + F.col("_start")).drop("_f", "_b", "_start"), name)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_no, json): the objects of JSON array files, as text. A file is read in splits, however large its array is.

    Files are cut at closing braces. Whether such a place lies in a string is the parity of the quotes before it, how
    deep it lies the sum of braces outside strings, and which record it belongs to the number of records that ended before:
    three running sums, each within splits and over the splits' totals. An object is then put together from its pieces.
    Empty arrays and files have no records; values of an array that are no objects are skipped.
    """
    read = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = staged(read.withColumn("at", F.monotonically_increasing_id()), "pieces")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    opened = lambda odd: F.aggregate(F.transform(parts, lambda x, k: F.when(k % 2 == odd, F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))).otherwise(0)), F.lit(0), lambda a, b: a + b)
    light = staged(pieces.select("file", "block", "at", (F.size(parts) - 1).alias("quotes"), opened(0).alias("outside"), opened(1).alias("inside")), "marks")
    light = _summed(light, F.col("quotes"), "quoted")
    in_string = F.col("quoted") % 2 == 1
    closes = (F.col("quoted") + F.col("quotes")) % 2 == 0
    light = light.select("file", "block", "at", F.when(in_string, F.col("inside")).otherwise(F.col("outside")).alias("opens"), closes.cast("int").alias("closes"))
    light = _summed(light, F.col("opens") - F.col("closes"), "depth")
    ends = (F.col("closes") == 1) & (F.col("depth") + F.col("opens") == 1)
    light = _summed(light.select("file", "block", "at", ends.cast("int").alias("ends")), F.col("ends"), "record_no")
    numbers = light.select("at", "record_no", F.col("ends").alias("_ends"))
    joined = pieces.join(numbers, "at").groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"), F.max("_ends").alias("_ended"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    return joined.where("_ended = 1").select("file", "record_no", F.regexp_extract(text, r"(?s)(\{.*)", 1).alias("json"))


def examples_of_arrays(spark: SparkSession, path: str) -> DataFrame:
    """examples() of array files of any size, each read in several tasks."""
    rows = array_records(spark, path).select(F.from_json("json", EXAMPLE).alias("e")).select("e.*")
    return rows.fillna(0, [f.name for f in EXAMPLE if f.dataType == T.IntegerType()])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines in order. Long logs are read in splits: lines are counted by split, and the counts before it are added."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    placed = staged(read.withColumn("at", F.monotonically_increasing_id()), "log")
    splits = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    return placed.join(small_side(starts), ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first")).alias("line_no"), F.col("value").alias("line"))  # one row for each split


def records(spark: SparkSession, root: str) -> DataFrame:
    """Answer records (case_id, mark, suffix, value) of `<repo>/<case>/<mark>+<suffix>.json` files."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    parts = F.split(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "/")
    name = F.element_at(parts, -1)
    return files.select(F.element_at(parts, -3).alias("repo"), F.element_at(parts, -2).alias("case_id"), F.substring_index(name, "+", 1).alias("mark"), F.regexp_extract(name, r"^[^+]*\+(.*)\.json$", 1).alias("suffix"), "value")


def append_records(answers: DataFrame, path: str) -> None:
    """Add answers to a cache, by mark."""
    answers.write.mode("append").partitionBy("mark").parquet(path)


def replace_json(rows: DataFrame, path: str) -> None:
    """Replace a JSON folder as a whole; rows may read from it. What is new is written beside it, the old one is kept until that stands in its place."""
    spark = rows.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.json(fresh)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(at(path))
    if there:
        fs.rename(at(path), at(old))
    if not fs.rename(at(fresh), at(path)):
        if there:
            fs.rename(at(old), at(path))
        raise OSError(f"{path} could not be replaced")
    if there:
        fs.delete(at(old), True)


def json_array(rows: DataFrame, key: str, path: str) -> None:
    """Write rows as JSON lines, a folder for each value of a key."""
    rows.write.mode("append").partitionBy(key).json(path)


def templates(path: str) -> dict[str, str]:
    """Prompt templates of a JSON object file, by name."""
    with open(path, encoding="utf-8") as f:
        return {str(k): str(v) for k, v in json.load(f).items()}


def properties(path: str) -> dict[str, str]:
    """`name = value` or `name: value` lines of a settings file; `#` and `!` begin comments, a backslash at the end goes on."""
    with open(path, encoding="utf-8") as f:
        text = f.read().replace("\\\n", "")
    found = (re.match(r"\s*([^#!\s][^=:\s]*)\s*[=:\s]\s*(.*)", line) for line in text.splitlines())
    return {m[1]: m[2].strip() for m in found if m}


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of all settings files below a folder, in the form that properties() reads; of a name given twice the last counts."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\\\r?\n", ""), r"\r?\n")).alias("at", "line"))
    part = lambda k: F.regexp_extract("line", r"(?s)^\s*([^#!\s][^=:\s]*)\s*[=:\s]\s*(.*)$", k)
    named = lines.select("file", "at", part(1).alias("name"), F.trim(part(2)).alias("value")).where("name != ''")
    return named.groupBy("file", "name").agg(F.max_by("value", "at").alias("value"))


def template_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, template) of all JSON object files below a folder; a file that is no object has none."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json("value", "map<string,string>")).alias("name", "template"))


def record_of(cases: DataFrame, cache: DataFrame, mark: str) -> DataFrame:
    """cases (case_id) with the cached record of a mark, or null."""
    known = cache.where(F.col("mark") == mark).groupBy("case_id").agg(F.max("value").alias("value"))
    return cases.join(known, "case_id", "left")


def files_under(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files below one of the roots. Both meet on the folders above a file, so no file is tested against all roots."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("root"))
    return files.join(above.join(roots.select(F.regexp_replace("root", "/$", "").alias("root")).distinct(), "root", "left_semi").select("path").distinct(), "path", "left_semi")


def folder_listing(files: DataFrame, column: str = "path") -> DataFrame:
    """(dir, subdirs): the second level below each folder."""
    parts = F.split(column, "/")
    return files.where(F.size(parts) >= 3).select(F.get(parts, F.lit(0)).alias("dir"), F.get(parts, F.lit(1)).alias("sub")).groupBy("dir").agg(F.array_sort(F.collect_set("sub")).alias("subdirs"))
