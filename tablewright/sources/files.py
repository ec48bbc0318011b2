"""Datasets as files: formats by extension, previews, exports."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.scalar import nested_to_json
from tablewright.plans.selection import first_rows_bound
from tablewright.plans.types import known, quoted


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", skip_malformed: bool = False) -> DataFrame:
    """Header CSV with blanks after separators dropped; types are inferred unless a schema is given.

    ``skip_malformed`` drops the rows that do not fit the schema.
    """
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("sep", sep)
    if skip_malformed:
        if schema is None:
            raise ValueError("skipping malformed rows needs a schema")
        # rows are judged on all columns, so the reader may not prune any
        reader = reader.option("mode", "DROPMALFORMED").option("columnPruning", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return trim_names(reader.csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, or files that each hold one JSON array."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    reader = spark.read.option("multiLine", bool(first) and first[0]["value"].lstrip().startswith("["))
    reader = reader.schema(schema) if schema is not None else reader
    return trim_names(reader.json(path))


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by extension: .tsv/.tab, .json/.jsonl, .parquet, anything else as CSV."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".tsv", ".tab"):
        return read_csv(spark, path, schema, sep="\t")
    if kind in (".json", ".jsonl", ".ndjson"):
        return read_json(spark, path, schema)
    if kind == ".parquet":
        return trim_names(spark.read.parquet(path))
    return read_csv(spark, path, schema)


def view_name(file_name: str) -> str:
    """SQL name of a dataset file."""
    stem = re.sub(r"[^A-Za-z0-9_]", "_", file_name.rsplit(".", 1)[0])
    return stem if re.match(r"[A-Za-z]", stem) else f"t_{stem}"


def register_views(frames: Mapping[str, DataFrame], selected: str | None = None) -> dict[str, str]:
    """One temporary view per dataset file; ``data`` for the selected one.  Returns file -> view."""
    names = {}
    for file_name, df in frames.items():
        names[file_name] = view_name(file_name)
        df.createOrReplaceTempView(names[file_name])
    if selected is not None:
        frames[selected].createOrReplaceTempView("data")
    return names


def describe(df: DataFrame) -> DataFrame:
    """Column name, type and nullability."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string, nullable boolean")


def catalog(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and types per dataset (row counts of parquet come from the footers)."""
    out = None
    for name, df in frames.items():
        kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
        row = df.agg(
            F.lit(name).alias("dataset"),
            F.count("*").alias("rows"),
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            F.lit(kinds).alias("dtypes"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def preview(df: DataFrame, order_by: Sequence[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of rows as text, nulls as empty text."""
    page = df.orderBy(*order_by).offset(offset).limit(limit)
    return page.select(*[F.coalesce(known(df, c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def export(df: DataFrame, path: str, kind: str = "csv") -> str:
    """Write a whole dataset as CSV or parquet; an empty one is refused."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"cannot export as {kind!r}")
    if df.isEmpty():
        raise ValueError("the dataset is empty")
    if kind == "csv":
        nested_to_json(df).write.option("header", True).csv(path)
    else:
        df.write.parquet(path)
    return path


def export_result(
    df: DataFrame, path: str, kind: str = "csv", limit: int | None = None, order_by: Sequence[str] = ()
) -> dict[str, object]:
    """Write a query result as CSV or JSON lines, nested values as JSON text; says its rows and whether it was cut.

    Everything is written unless a ``limit`` is given, which needs a total order and keeps the first rows of it.
    """
    total = df.count()
    if limit is not None and total > limit:
        if not order_by:
            raise ValueError("a limit needs order_by")
        df = df.where(first_rows_bound(df, [quoted(c) for c in order_by], limit, total))
    out = nested_to_json(df)
    if kind == "csv":
        out.write.option("header", True).csv(path)
    elif kind == "json":
        out.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"cannot export as {kind!r}")
    return {"path": path, "rows": total, "truncated": limit is not None and total > limit}


def result_to_dataset(df: DataFrame, path: str) -> DataFrame:
    """Save a query result as a new dataset and return it; an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, source: str, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options: str
) -> DataFrame:
    """A table or query of another database, read in parallel ranges of ``partition_column``."""
    return spark.read.format("jdbc").options(**jdbc_options(url, source, partition_column, bounds, partitions), **options).load()


def jdbc_options(url: str, source: str, partition_column: str | None, bounds: tuple | None, partitions: int) -> dict[str, str]:
    is_query = bool(re.match(r"\s*select\b", source, re.IGNORECASE))
    out = {"url": url, "dbtable": f"({source}) q" if is_query else source}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its bounds")
        out |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return out


def columns_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c).cast("string").alias(c) for c in df.columns])
