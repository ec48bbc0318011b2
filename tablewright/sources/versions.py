"""Versions of a dataset, their lineage and the log of cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHANGES = ["filled", "removed", "rows_removed", "cells_replaced", "scaled"]  # fixed values: counts that mean a change

HISTORY = (
    "base string, version int, stage string, method string, columns array<string>, rows_affected bigint, details string"
)


def base_key(name: Column) -> Column:
    """File name without extension, version and the marks of cleaned or featurized copies."""
    out = F.regexp_replace(name, r"\.\w+$", "")
    out = F.regexp_replace(out, r"_v\d+$", "")
    out = F.regexp_replace(out, r"^(?i)(cleaned_|featurized_)", "")
    return F.regexp_replace(out, r"(?i)_(cleaned|featurized)$", "")


def version_number(name: Column) -> Column:
    text = F.regexp_extract(name, r"_v(\d+)(\.\w+)?$", 1)
    return F.when(text == "", 1).otherwise(text.try_cast("int"))


def lineage(files: DataFrame, name: str = "name") -> DataFrame:
    """Per base key: number of versions, the newest version and the file that holds it."""
    named = files.select(F.col(name).alias("name"), base_key(F.col(name)).alias("base"), version_number(F.col(name)).alias("version"))
    return named.groupBy("base").agg(
        F.count("*").alias("versions"),
        F.max("version").alias("active_version"),
        F.max(F.struct("version", "name"))["name"].alias("active"),
    )


def changed(stats: Mapping, before: DataFrame, after: DataFrame) -> bool:
    return any((stats.get(k) or 0) > 0 for k in CHANGES) or before.columns != after.columns


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def versions(spark: SparkSession, folder: str, base: str) -> list[int]:
    """Version numbers written so far."""
    root = f"{folder}/{base}"
    if not _exists(spark, root):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def write_version(before: DataFrame, after: DataFrame, stats: Mapping, folder: str, base: str) -> int | None:
    """Write ``after`` as the next version below ``folder/base`` if the step changed anything; the old ones stay."""
    if not changed(stats, before, after):
        return None
    spark = after.sparkSession
    n = max(versions(spark, folder, base), default=1) + 1
    after.write.mode("errorifexists").parquet(f"{folder}/{base}/version={n}")
    return n


def read_version(spark: SparkSession, folder: str, base: str, version: int | None = None) -> DataFrame:
    n = max(versions(spark, folder, base)) if version is None else version
    return spark.read.parquet(f"{folder}/{base}/version={n}")


def log_step(
    spark: SparkSession, folder: str, base: str, version: int, stage: str, method: str, columns: Sequence[str], stats: Mapping
) -> None:
    """Append one cleaning step to the history table."""
    rows = next((int(stats[k]) for k in CHANGES if stats.get(k)), 0)
    row = (base, version, stage, method, list(columns), rows, str({k: stats[k] for k in CHANGES if k in stats}))
    spark.createDataFrame([row], HISTORY).write.mode("append").parquet(f"{folder}/history")


def history(spark: SparkSession, folder: str, base: str | None = None) -> DataFrame:
    steps = spark.read.schema(HISTORY).parquet(f"{folder}/history")
    return steps if base is None else steps.where(F.col("base") == base)
