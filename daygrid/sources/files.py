"""Readers and writers of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with a declared schema; unparsable cells become null."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", dateFormat="yyyy-MM-dd")


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables are small; the parts stay as many as Spark writes."""
    df.write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Panel as parquet partitioned by month, so date filters prune folders.

    Ranges of date and entity, rather than months, are dealt to tasks: a month may fill several.
    """
    keys = [c for c in ("date", "entity") if c in df.columns]
    df.withColumn("month", F.date_format("date", "yyyy-MM")).repartitionByRange(*keys).write.mode("overwrite").partitionBy("month").parquet(path)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Read-merge-write without touching what is being read: each write is a new version folder."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest version; the filter prunes the older folders."""
    table = spark.read.parquet(path)
    return table.where(F.col("version") == table.agg(F.max("version")).scalar()).drop("version")


def write_texts(df: DataFrame, path: str, key: str, text: str, folders: int = 256) -> None:
    """One text file per key: the key on the first line, its text below (texts of a repeated key end up in one file).

    Files share a fixed number of folders and each folder has one writer, so neither the folders to list nor the
    renames of the commit grow with the files.
    """
    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(folders)).alias("folder"), key, text).repartition("folder")
    page = F.array_join(F.collect_list(F.coalesce(text, F.lit(""))), "\x00")
    whole = dealt.groupBy("folder", key).agg(page.alias("_page")).select("folder", F.concat_ws("\n", F.coalesce(F.col(key).cast("string"), F.lit("")), "_page").alias("value"))
    whole.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).partitionBy("folder").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one whole file per row, without the separator the writer ends them with."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\x00$", "").alias("text"), F.col("_metadata.file_path").alias("path"))
