"""Trees of image files as a manifest."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import images, keys
from ..operators import profile
from ..schemas import CLASS_NOTES, METADATA_COLUMNS, SKIPPED, UNREADABLE, WALK_EXTENSIONS, strings

BACKEND = "curatrix"


@dataclass(frozen=True)
class Manifest:
    metadata: DataFrame
    skipped: DataFrame
    unreadable: DataFrame
    class_notes: DataFrame
    phash_backend: str | None


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, raw_path) of all files below a folder of the driver's file system, in order. Spark's own listing would leave out names that begin with "_" or "."."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no folder {root}")
    found = sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)
    return spark.createDataFrame([(p, os.path.join(root, p)) for p in found], "relative_path string, raw_path string")


def walk_tasks(spark: SparkSession, root: str) -> DataFrame:
    """(image_id, path) of image files below a folder; hidden ones and all but a few formats stay out by extension only."""
    files = list_tree(spark, root).where(keys.extension(F.col("relative_path")).isin(*WALK_EXTENSIONS))
    return files.select(F.col("relative_path").alias("image_id"), F.col("raw_path").alias("path"))


def contents(spark: SparkSession, files: DataFrame, root: str, format: str = "binaryFile") -> DataFrame:
    """(raw_path and the format's columns) of the files below a root. Files with a part that begins with "_" are left out by Spark's listing; they are
    read by links to them in the shared folder."""
    reader = spark.read.format(format).option("recursiveFileLookup", True).option("ignoreCorruptFiles", format == "image")  # a file that can't be decoded has no pixels
    name = F.col("image.origin" if format == "image" else "path")
    out = reader.load(root).withColumn("raw_path", _local(name))
    hidden = [r.raw_path for r in files.where(F.exists(keys.parts(F.col("relative_path")), lambda x: x.startswith("_"))).select("raw_path").collect()]
    if hidden:
        links = shared_folder(spark)
        os.makedirs(links)
        rows = []
        for n, path in enumerate(hidden):
            os.symlink(path, link := f"{links}/{n:09d}{os.path.splitext(path)[1]}")
            rows.append((link, path))
        there = spark.createDataFrame(rows, "link string, raw_path string")
        out = out.unionByName(reader.load(links).withColumn("link", _local(name)).join(there, "link").drop("link"))
    return out


def shared_folder(spark: SparkSession) -> str:
    base = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()).removeprefix("file:")
    if ":" in base:
        raise ValueError(f"names that begin with an underscore need a shared folder that is a file system's, not {base}")
    return f"{'/' + base.strip('/')}/links-{uuid.uuid4().hex}"


@F.pandas_udf(BooleanType())
def exists_udf(path: pd.Series) -> pd.Series:
    """Whether a file is there, for the executors, which see the same file system as the driver."""
    return path.map(lambda p: p is not None and os.path.exists(p)).astype(bool)


def _local(path) -> F.Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def scan(spark: SparkSession, root: str, sha256: bool = True, phash: bool = False) -> Manifest:
    """A manifest of root/class/...: a row for each image that can be read, and tables of what was left out and why.

    Folders at the top are classes by name; hidden ones are ignored, others without a class are noted as skipped. One pass over the contents
    gives sizes and digests, and finds files that are cut off: they are unreadable. Perceptual hashes come from decoded pixels, turned as the
    file's orientation says; formats that can't be decoded here have an empty one."""
    root = os.path.abspath(root)
    files = list_tree(spark, root).withColumn("top", F.element_at(keys.parts(F.col("relative_path")), 1))
    files = files.where(~F.col("top").startswith(".") & (F.size(keys.parts(F.col("relative_path"))) > 1))
    named = profile.with_class(files, "top")
    tops = sorted(n for n in os.listdir(root) if not n.startswith(".") and os.path.isdir(os.path.join(root, n)))
    if not tops:
        raise FileNotFoundError(f"no class folders in {root}")
    folders = profile.with_class(spark.createDataFrame([(t,) for t in tops], "top string"), "top")
    nameless = folders.where("class_name is null").select(F.concat(F.lit(root + "/"), "top").alias("path"), F.lit("no class has this name").alias("reason"), F.lit("top_level_folder").alias("kind"))
    notes = folders.where("class_name is not null and class_note <> ''").select(F.col("top").alias("top_level_folder"), "class_name", F.col("class_note").alias("note"))
    named = named.where("class_name is not null").withColumn("reason", keys.skip_reason(F.col("relative_path")))
    skipped = named.where("reason is not null").select(F.col("raw_path").alias("path"), "reason", F.lit("file").alias("kind"))
    wanted = named.where("reason is null")
    size = images.size_udf("content")
    read = contents(spark, files, root).withColumn("size", size)
    read = read.select("raw_path", F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.col("size.turn").alias("turn"), F.col("size.error").alias("error"), (F.sha2("content", 256) if sha256 else F.lit("")).alias("sha256"))
    told = wanted.join(read.dropDuplicates(["raw_path"]), "raw_path", "left").persist()
    unreadable = told.where("error is not null or width is null").select(F.col("raw_path").alias("path"), "relative_path", "class_name", F.coalesce("error", F.lit("not found")).alias("error"))
    good = told.where("error is null and width is not null")
    if good.isEmpty():
        raise ValueError(f"no readable image in {root}")
    if phash:
        pixels = contents(spark, files, root, "image").select("raw_path", images.phashes_udf("image").alias("phashes"))  # orientations are known on the other side; only hashes are moved
        good = good.join(pixels.dropDuplicates(["raw_path"]), "raw_path", "left").withColumn("phash", F.coalesce(F.try_element_at("phashes", "turn"), F.lit("")))
    else:
        good = good.withColumn("phash", F.lit(""))
    p = F.col("relative_path")
    rows = good.select(
        p, "raw_path", keys.basename(p).alias("original_filename"), F.col("top").alias("top_level_folder"), "class_name", "class_index", "width", "height", keys.extension(p).alias("file_extension"), "sha256", "phash",
        keys.group_id(p).alias("group_id"), keys.specimen_key(keys.group_id(p)).alias("specimen_key"), keys.light(p).alias("light_condition"),
        keys.parsed_group(p, F.col("class_name")).alias("parsed_group_id"), keys.parsed_group(p, F.col("class_name")).alias("legacy_parsed_group_id"), F.col("class_note").alias("notes"),
    )
    numbered = profile.numbered(rows, ["class_index", "relative_path"], "IMG_").select(*METADATA_COLUMNS)
    typed = lambda df, schema: df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return Manifest(typed(numbered, strings(METADATA_COLUMNS)), typed(skipped.unionByName(nameless), SKIPPED), typed(unreadable, UNREADABLE), typed(notes, CLASS_NOTES), BACKEND if phash else None)


def focus(spark: SparkSession, tasks: DataFrame, root: str, longer: int = 0) -> DataFrame:
    """(image_id, path, width, height, laplacian_var, error) of each task; sizes are those before shrinking."""
    pixels = spark.read.format("image").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    made = pixels.select(_local(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), images.focus_udf(longer)("image").alias("laplacian_var"))
    return tasks.join(made, "path", "left").select("image_id", "path", "width", "height", "laplacian_var", F.when(F.col("laplacian_var").isNull(), "unreadable").alias("error"))
