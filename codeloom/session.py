"""Sessions and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a broadcast side may have at most; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_OWN: dict[str, str] = {}


def session(app: str = "codeloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster master, memory and folders come from spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset, and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="codeloom-")
        path = _OWN[app]
    return path.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, so a lost executor costs no more than a step."""
    path = f"{shared_dir(df.sparkSession)}/codeloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value holds."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16), lambda s, x: s + _held(kind.elementType, x))
    return F.lit(8)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows of `size` bytes in all, else unchanged (the join then shuffles).

    df should be staged: at most rows + 1 of its rows are counted and measured.
    """
    row = reduce(lambda a, b: a + b, [_held(f.dataType, F.col(f"`{f.name}`")) for f in df.schema])
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df
