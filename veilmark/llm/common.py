"""What the corpus operators share: table access, the shared work folder, and cut lineage."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from veilmark.functions.ranges import above, bounds

#: Rows in a range of a global order, about.
RANGE = 100_000
_local: str | None = None
_open = threading.local()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only, so that any store Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workdir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where it names none, a folder of this
    machine will do if driver and executors are one process, as in tests, and is an error else."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="veilmark-")
    return _local


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and losing
    executors later costs nothing that came before. Shuffle files of the write go when it ends,
    so that consecutive steps do not add up on disk."""
    spark = df.sparkSession
    path = f"{workdir(spark)}/veilmark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._veilmark_path = path
    if stack := _open.__dict__.get("stack"):
        stack[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside goes when the block ends, but for what the given function was called with: that goes with
    the block around it, or stays."""
    stack = _open.__dict__.setdefault("stack", [])
    mine: list[DataFrame] = []
    kept: set[str] = set()
    stack.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._veilmark_path)
        return df

    try:
        yield keep
    finally:
        stack.pop()
        for df in mine:
            if df._veilmark_path not in kept:
                discard(df)
            elif stack:
                stack[-1].append(df)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` stored, once nothing reads it any more."""
    spark, path = df.sparkSession, df._veilmark_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, size: int | None, each: int) -> int:
    """So many partitions that each gets ``each`` units of ``size``, and the session's number at least."""
    return max(shuffle_parts(spark), math.ceil((size or 0) / each))


def lower_ascii(c: Column | str) -> Column:
    """A-Z only: other letters are left alone, unlike ``lower``."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_ranges(df: DataFrame, key: Column, n: int) -> tuple[Column, int]:
    """The number of the range that a row's key falls in, 0 and up, and how many ranges there are.

    n ranges of about as many rows each; the driver gets one number for each. Equal keys share a range."""
    cuts = bounds(df, key, n)
    return above(key, cuts).cast("int"), len(cuts) + 1


def in_ranges(df: DataFrame, order: list[Column], name: str, **sums: Column) -> tuple[DataFrame, DataFrame, WindowSpec]:
    """``df`` sorted into ranges and written with the number of each row's range (_range); for each range the
    sums over all ranges before it; and the window of the rows before a row within its range."""
    n = parts_for(df.sparkSession, df.count(), RANGE)
    own = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order), name)
    ahead = own.groupBy("_range").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ahead = ahead.select("_range", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums))
    return own, ahead, Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, order: list[Column], name: str, **sums: Column) -> DataFrame:
    """``df`` with sums over all rows that come before each in this order. Ranges are of ``RANGE`` rows about, and no
    task gets more than a range, or a row for each range."""
    own, ahead, within = in_ranges(df, order, name, **sums)
    inner = own.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{k}") for k, v in sums.items()))
    out = inner.join(F.broadcast(ahead), "_range")  # a row for each range of RANGE rows
    return out.select(*df.columns, *((F.col(k) + F.col(f"_in_{k}")).alias(k) for k in sums))


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that bear a name an operator uses itself renamed, and how to name them back."""
    new = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in own}
    return docs.withColumnsRenamed(new), {v: k for k, v in new.items()}
