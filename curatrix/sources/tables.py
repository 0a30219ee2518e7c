"""Tables of manifests, splits, annotations, tasks and histories. Keys are read as text, never inferred."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import require, with_split
from ..schemas import ANNOTATION, REQUIRED_METADATA, strings


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; known integer columns are integers and all others text."""
    read = lambda: spark.read.option("header", True).option("escape", '"')
    return read().option("multiLine", True).schema(strings(read().csv(path).columns)).csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    if "relative_path" not in df.columns and "image_path" in df.columns:
        df = df.withColumnRenamed("image_path", "relative_path")
    require(df, REQUIRED_METADATA, "metadata")
    return df


def read_split(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    require(df, ["split"], "split")
    return with_split(df)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation sheet whose header is its second row, with short column names and row numbers: CSV, or a workbook where openpyxl is installed."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        sheet = pd.read_excel(path, header=1, dtype=str)
        sheet = spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None), strings(sheet.columns))
        return sheet.withColumnsRenamed(ANNOTATION).withColumn("row", F.monotonically_increasing_id())
    lines = [r.value for r in spark.read.text(path).limit(2).collect()]
    names = next(csv.reader([lines[1]]))
    names = [n or f"Unnamed: {i}" for i, n in enumerate(names)]
    # fields may have line ends, and such a file is read in one piece, so rows are numbered as they stand in it
    raw = spark.read.option("multiLine", True).option("escape", '"').schema(strings(f"c{i}" for i in range(len(names)))).csv(path).withColumn("row", F.monotonically_increasing_id())
    rows = raw.where(F.col("row") > 1).toDF(*names, "row")
    return rows.withColumnsRenamed(ANNOTATION)


def focus_tasks(rows: DataFrame, path: str = "path") -> DataFrame:
    """(image_id, path) of rows; a row without an id is named by its path."""
    return rows.select(F.coalesce(F.nullif("image_id", F.lit("")), F.col(path)).alias("image_id"), F.col(path).alias("path"))


def resolve_paths(df: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """df with source_path: the first of root/relative_path and raw_path that is among the files (path); null if neither is."""
    there = files.select("path").distinct()
    first = df.withColumn("_a", F.concat(F.lit(root.rstrip("/") + "/"), F.col("relative_path")))
    out = first.join(there.withColumn("_1", F.lit(True)).withColumnRenamed("path", "_a"), "_a", "left")
    if "raw_path" not in df.columns:
        return out.withColumn("source_path", F.when(F.col("_1"), F.col("_a"))).drop("_a", "_1")
    out = out.join(there.withColumn("_2", F.lit(True)).withColumnRenamed("path", "raw_path"), "raw_path", "left")
    return out.withColumn("source_path", F.coalesce(F.when(F.col("_1"), F.col("_a")), F.when(F.col("_2"), F.col("raw_path")))).drop("_a", "_1", "_2")


def missing_files(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    return df.join(files.select(F.col("path").alias(column)), column, "left_anti")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(c).cast("int" if c == "epoch" else "double").alias(c) for c in df.columns])
