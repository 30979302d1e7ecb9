"""Written intermediate tables: lineage is cut in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.config import SETTINGS


def folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a scratch folder only on a local master that names none."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="daygrid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several branches read, and read it back.

    Parquet rather than an RDD checkpoint, so each branch still prunes columns
    and pushes filters, and a lost executor never recomputes the lineage.
    """
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, small: DataFrame) -> DataFrame:
    """Every row with every row of a table whose size is fixed by configuration (folds, weights).

    The small table travels as one array value and is exploded in place, so
    there is no product of two tables in the plan.
    """
    rows = small.agg(F.collect_list(F.struct(*small.columns))).scalar()
    return df.withColumn("_beside", F.explode(rows)).select(*df.columns, "_beside.*")


def by_names(df: DataFrame, names: int | None, keys: list[str]) -> DataFrame:
    """Rows of a wide panel dealt by `keys` to as many tasks as its entities fill, so a task's sort doesn't grow with them.

    Where that is no more than the cores, the exchange of the window that follows is left to adaptive execution.
    """
    n = -(-(names or 0) // SETTINGS.names_per_task)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan alone would use fewer, for CPU-heavy text work.

    A scan that already has as many partitions as cores is left alone: no
    large text table is ever shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
