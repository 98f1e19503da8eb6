"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; where that is unset, in a new temporary folder if all runs on this machine,
    else an error. It is deleted as the application's JVM ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _DIRS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="findgrid-")
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/findgrid-{sc.applicationId}-{uuid.uuid4().hex[:8]}")
        store = path.getFileSystem(sc._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _DIRS[sc.applicationId] = path.toString()
    return _DIRS[sc.applicationId]


def save_table(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: the lineage is cut, lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where windows, sorts and groups keep whole rows.
TASK_ROWS = 200_000


def tasks_for(spark: SparkSession, rows: int, most: int = TASK_ROWS) -> int:
    """Number of partitions of at most about `most` rows, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def dealt(df: DataFrame, *by: Column | str, rows: int | None = None, most: int = TASK_ROWS) -> DataFrame:
    """df dealt out by `by` into partitions of about `most` rows: what a task holds does not grow with the input, whatever the
    number of shuffle partitions is. rows: their number, if known; else df, which should be a stored table, is counted."""
    return df.repartition(tasks_for(df.sparkSession, df.count() if rows is None else rows, most), *by)


def in_order(df: DataFrame, *by: Column | str, number: str = "_no") -> DataFrame:
    """df with the number (from 1) of each row in the order of `by`: ranges are sorted by many tasks, and offsets come from a
    count of each range, so no task sees all rows. Rows that are equal in `by` get any order."""
    df = save_table(df, "unordered")  # ranges are found by a pass of their own, which must not repeat what is behind df
    n = tasks_for(df.sparkSession, df.count())
    ranges = save_table(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row for each range
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranges.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(number, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def before_it(df: DataFrame, value: Column, name: str, number: str = "_no") -> DataFrame:
    """df of in_order() with the value of the row before, null for the first."""
    return df.join(df.select((F.col(number) + 1).alias(number), value.alias(name)), number, "left")
