"""Checks of manifests and splits, and matching of a given split to a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import basename, normalise_class, normalise_split, parts, path_key
from ..schemas import PATH_KEYS, SPLITS
from .splits import split_layout


class InvalidSplit(ValueError):
    pass


def require(df: DataFrame, columns, what: str) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} lacks columns: {missing}")


def has_value(df: DataFrame, column: str) -> bool:
    """Whether a column is there and has any value but null and the empty text."""
    return column in df.columns and not df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").isEmpty()


def prefer(df: DataFrame, columns) -> DataFrame:
    """df with the given columns first, those that it has, and the others after them."""
    first = [c for c in dict.fromkeys(columns) if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def with_split(df: DataFrame, column: str = "split") -> DataFrame:
    """df with its split values normalised; unknown values are an error that lists them."""
    unknown = df.where(normalise_split(F.col(column)).isNull()).select(F.col(column).cast("string").alias("s")).distinct().orderBy("s").limit(20)
    if found := [r.s for r in unknown.collect()]:
        raise InvalidSplit(f"unknown split values: {found}")
    return df.withColumn(column, normalise_split(F.col(column)))


def split_class(df: DataFrame, path: str | None) -> Column:
    """The class of a split's row: of its class_name, or of the path's part after a split's name, or of its parent folder."""
    if "class_name" in df.columns:
        return normalise_class(F.col("class_name"))["name"]
    if path is None:
        raise InvalidSplit("a split without class_name needs a path")
    p = parts(F.col(path))
    where = F.array_position(F.transform(p, lambda x: F.lower(x).isin(*SPLITS)), True)
    after = F.when((where > 0) & (where < F.size(p)), F.get(p, where.cast("int"))).when(F.size(p) >= 2, F.get(p, F.size(p) - 2))
    return normalise_class(after)["name"]


def duplicates(df: DataFrame, keys: list[str], keep_first: str | None = None) -> DataFrame:
    """Rows whose keys come more than once: all of them, or all but the first in the order of a column."""
    w = Window.partitionBy(*keys)
    if keep_first:
        return df.withColumn("_n", F.row_number().over(w.orderBy(keep_first))).where("_n > 1").drop("_n")
    return df.withColumn("_n", F.count("*").over(w)).where("_n > 1").drop("_n")


def excluded(metadata: DataFrame, split: DataFrame, key: str = "image_id") -> DataFrame:
    """Manifest rows that a split doesn't have."""
    return metadata.join(split.select(key).distinct(), key, "left_anti")


def unknown_images(split: DataFrame, metadata: DataFrame, key: str = "image_id") -> DataFrame:
    """Split rows that a manifest doesn't have."""
    return split.join(metadata.select(key).distinct(), key, "left_anti")


def class_mismatch(merged: DataFrame, given: str = "class_name_split", right: str = "class_name") -> DataFrame:
    return merged.where(~normalise_class(F.col(given))["name"].eqNullSafe(F.col(right)))


def completeness(split: DataFrame) -> DataFrame:
    """One row: splits that are missing, images that come again, rows without a split."""
    w = Window.partitionBy("image_id").orderBy("image_id")
    numbered = split.withColumn("_n", F.row_number().over(w))
    return numbered.agg(
        F.array_sort(F.array_except(F.array(*map(F.lit, SPLITS)), F.collect_set("split"))).alias("missing_splits"),
        F.count_if(F.col("_n") > 1).alias("duplicate_images"),
        F.count_if(F.col("split").isNull()).alias("rows_without_split"),
    )


def check_completeness(split: DataFrame) -> None:
    r = completeness(split).first()
    if r.missing_splits or r.duplicate_images or r.rows_without_split:
        raise InvalidSplit(f"missing splits {r.missing_splits}, {r.duplicate_images} repeated images, {r.rows_without_split} rows without a split")


def filename_match(metadata: DataFrame, split: DataFrame, path: str) -> DataFrame:
    """Full join by class and file name; in_metadata and in_split say which side a row has."""
    left = metadata.withColumn("filename_key", F.col("original_filename") if "original_filename" in metadata.columns else basename(F.col("relative_path")))
    left = left.withColumn("class_key", F.col("class_name")).withColumn("in_metadata", F.lit(True))
    right = split.select(basename(F.col(path)).alias("filename_key"), split_class(split, path).alias("class_key"), "split", *[F.col(c).alias(f"{c}_split") for c in ("class_name", "class_index") if c in split.columns], F.lit(True).alias("in_split"))
    both = left.join(right, ["class_key", "filename_key"], "full")
    return both.withColumn("in_metadata", F.coalesce("in_metadata", F.lit(False))).withColumn("in_split", F.coalesce("in_split", F.lit(False)))


@dataclass(frozen=True)
class Validated:
    split: DataFrame
    excluded: DataFrame
    diagnostics: dict


def validate_split(metadata: DataFrame, split: DataFrame, allow_subset: bool = False, files: DataFrame | None = None) -> Validated:
    """Matches a given split to a manifest: by image_id, relative path, or the first other path that it has; if a path leaves rows unmatched, by class and
    file name. files: existing paths, against which raw_path is then checked.

    Errors: unknown split values, repeated keys, rows that no key matches (unless allow_subset), classes that differ, missing files.
    Split rows that the manifest lacks are counted in the diagnostics."""
    require(split, ["split"], "split")
    split = with_split(split)
    carried = [c for c in ("class_name", "class_index") if c in split.columns]
    path = None
    if "image_id" in split.columns:
        key, left, right = "image_id", split, metadata
    else:
        path = "relative_path" if "relative_path" in split.columns else next((c for c in PATH_KEYS if c in split.columns), None)
        if path is None:
            raise InvalidSplit(f"a split needs image_id, relative_path or one of {PATH_KEYS}")
        key = "relative_key" if path == "relative_path" else "raw_key"
        left = split.withColumn(key, path_key(F.col(path)))
        source = "relative_path" if path == "relative_path" else "raw_path"
        right = metadata.withColumn(key, path_key(F.col(source)) if source in metadata.columns else F.lit(""))
    told = {"match_key": path or key, "allow_subset": allow_subset, "metadata_rows": metadata.count(), "split_rows": split.count()}
    if repeated := left.groupBy(key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).first().n:
        raise InvalidSplit(f"{repeated} repeated split keys")
    slim = left.select(key, "split", *[F.col(c).alias(f"{c}_split") for c in carried])
    merged = slim.join(right, key, "right")
    told["extra_split_rows"] = left.join(right.select(key), key, "left_anti").count()
    lost = merged.where("split is null")
    if path and not lost.isEmpty():
        again = {f"{side}_duplicate_keys": n for side, n in _filename_duplicates(metadata, split, path).items()}
        told |= {"fallback_key": f"class_name+filename from {path}"} | again
        if any(again.values()):
            raise InvalidSplit(f"rows unmatched by {path}, and file names repeat: {told}")
        matched = filename_match(metadata, split, path)
        if n := matched.where("not in_metadata").count():
            raise InvalidSplit(f"{n} split rows match no file name: {told}")
        merged = matched.drop("in_metadata", "in_split")
        told["match_key"] = told["fallback_key"]
        lost = merged.where("split is null")
    if not lost.isEmpty() and not allow_subset:
        raise InvalidSplit(f"no split for {[r[0] for r in lost.select('relative_path').orderBy('relative_path').limit(20).collect()]}")
    kept = merged.where("split is not null")
    if "class_name" in carried and (rows := class_mismatch(kept).select("relative_path", "class_name_split", "class_name").limit(20).collect()):
        raise InvalidSplit(f"classes differ: {[tuple(r) for r in rows]}")
    if files is not None and "raw_path" in kept.columns:
        if n := kept.join(files.select(F.col("path").alias("raw_path")), "raw_path", "left_anti").count():
            raise FileNotFoundError(f"{n} image paths are missing")
    told |= {"matched_rows": kept.count(), "excluded_metadata_rows": lost.count()}
    return Validated(split_layout(kept).orderBy("split", "class_index", "relative_path"), lost, told)


def _filename_duplicates(metadata: DataFrame, split: DataFrame, path: str) -> dict[str, int]:
    name = F.col("original_filename") if "original_filename" in metadata.columns else basename(F.col("relative_path"))
    sides = {"metadata": metadata.select(F.col("class_name").alias("c"), name.alias("f")), "split": split.select(split_class(split, path).alias("c"), basename(F.col(path)).alias("f"))}
    return {k: duplicates(v, ["c", "f"]).count() for k, v in sides.items()}
