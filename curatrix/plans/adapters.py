"""Manifests over the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sign_hash

LANGS = ("de", "en", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(n: str):
    r = F.col(n) % 20
    return F.when(r < 14, "train").when(r < 17, "val").otherwise("test")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as images: a class is a language, a group a source."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.format_string("DOC_%06d", "doc_id").alias("image_id"),
        path.alias("relative_path"),
        F.col("lang").alias("class_name"),
        (F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")) - 1).cast("int").alias("class_index"),
        F.concat_ws("::", "lang", "source").alias("group_id"),
        F.sha2("text", 256).alias("sha256"),
        F.floor(F.col("n_chars") / 100).cast("int").alias("width"),
        (F.col("n_chars") % 100).cast("int").alias("height"),
        F.element_at(F.array(*map(F.lit, ("natural", "indoor", "outdoor"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("light_condition"),
        F.element_at(F.array(*map(F.lit, (".jpg", ".png", ".tif", ".bmp"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("file_extension"),
        "doc_id",
        "n_chars",
        split_of("doc_id").alias("split"),
    )


MANIFEST = """m AS (
  SELECT printf('DOC_%06d', doc_id) AS image_id, lang || '/' || source || '/' || doc_id || '.txt' AS relative_path, lang AS class_name,
    CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS class_index, lang || '::' || source AS group_id, sha256(text) AS sha256,
    CAST(n_chars // 100 AS INTEGER) AS width, CAST(n_chars % 100 AS INTEGER) AS height, (['natural', 'indoor', 'outdoor'])[doc_id % 3 + 1] AS light_condition,
    (['.jpg', '.png', '.tif', '.bmp'])[doc_id % 4 + 1] AS file_extension, doc_id, n_chars,
    CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split
  FROM documents)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as images: a class is a label, the hash has a bit for each component above the median."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("image_id"),
        F.col("label").cast("string").alias("class_name"),
        F.col("label").alias("class_index"),
        F.concat_ws("/", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("relative_path"),
        F.concat_ws("::", F.col("label").cast("string"), (F.col("vec_id") % 17).cast("string")).alias("group_id"),
        sign_hash(F.col("embedding")).alias("phash"),
        split_of("vec_id").alias("split"),
    )


IMAGES = """v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings
), w AS (
  SELECT vec_id, label, list_transform(e, lambda x: x > (s[32] + s[33]) / 2) AS b FROM v
), h AS (
  SELECT vec_id, label, CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN b[i] THEN CAST(1 AS BIGINT) << (32 - i) ELSE 0 END)) AS BIGINT) AS hi,
    CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN b[32 + i] THEN CAST(1 AS BIGINT) << (32 - i) ELSE 0 END)) AS BIGINT) AS lo FROM w
), i AS (
  SELECT vec_id AS image_id, CAST(label AS VARCHAR) AS class_name, label AS class_index, label || '/' || vec_id AS relative_path, label || '::' || vec_id % 17 AS group_id, hi, lo,
    format('{:08x}{:08x}', hi, lo) AS phash, CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM h)"""
