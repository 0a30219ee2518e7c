"""Leakage audits of a split: values, hashes and near-duplicate images that more than one split has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import distance, with_halves
from ..functions.keys import basename, filename_key
from ..schemas import SPLITS
from .components import bands, blocks_for
from .splits import split_order
from .validate import has_value

THRESHOLDS = (5, 10)
OPTIONAL = ("original_filename", "group_id", "parsed_group_id", "specimen_key", "sha256", "phash", "light_condition")


def merge_metadata(metadata: DataFrame, split: DataFrame, on: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A split's rows with what the manifest adds to them by the key columns: of rows with the same key, the least."""
    added = [c for c in OPTIONAL if c in metadata.columns and c not in split.columns]
    if not added:
        return split
    rows = metadata.groupBy(*on).agg(F.min(F.struct(*added)).alias("_added")).select(*on, *[F.col(f"_added.{c}").alias(c) for c in added])
    return split.join(rows, list(on), "left")


def class_distribution(frame: DataFrame) -> DataFrame:
    return frame.groupBy("split", "class_name").agg(F.count("*").alias("n_images"))


def distribution_pivot(frame: DataFrame) -> DataFrame:
    """Classes by split, 0 where there is none."""
    return frame.groupBy("class_name").pivot("split", list(SPLITS)).count().na.fill(0, list(SPLITS))


def overlap(frame: DataFrame, column: str, label: str = "value") -> DataFrame:
    """A row for each value and pair of splits that both have it, with how many rows of the whole frame do.

    One aggregation by value; pairs come from its set of splits (three at most), not from a join."""
    value = F.col(column).cast("string")
    by = frame.where(F.coalesce(value, F.lit("")) != "").groupBy(value.alias(label)).agg(F.collect_set("split").alias("s"), F.count("*").alias("n_rows"))
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    listed = F.array_compact(F.array(*[F.when(F.array_contains("s", a) & F.array_contains("s", b), F.struct(F.lit(a).alias("l"), F.lit(b).alias("r"))) for a, b in pairs]))
    out = by.where(F.size("s") > 1).withColumn("p", F.explode(listed))
    return out.select(F.lit(column).alias("audit"), F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split"), label, "n_rows")


def filename_overlap(frame: DataFrame) -> DataFrame:
    name = F.col("original_filename") if "original_filename" in frame.columns else basename(F.col("relative_path"))
    return overlap(frame.withColumn("normalized_filename", filename_key(name)), "normalized_filename", "filename")


def group_overlap(frame: DataFrame) -> DataFrame:
    column = "group_id" if "parsed_group_id" not in frame.columns or has_value(frame, "group_id") else "parsed_group_id"
    return overlap(frame, column, "group_id")


def group_overlap_examples(frame: DataFrame, column: str = "group_id", examples: int = 10) -> DataFrame:
    """How many values each pair of splits shares, and the first of them."""
    by = overlap(frame, column).groupBy("left_split", "right_split")
    return by.agg(F.count("*").alias("n_groups"), F.slice(F.array_sort(F.collect_set("value")), 1, examples).alias("examples"))


def hash_overlap(frame: DataFrame, column: str = "sha256") -> DataFrame:
    """All rows of hashes that more than one split has."""
    group = F.col("group_id" if "group_id" in frame.columns else "parsed_group_id") if {"group_id", "parsed_group_id"} & set(frame.columns) else F.lit("")
    rows = frame.where(F.coalesce(F.col(column), F.lit("")) != "")
    leaking = rows.groupBy(column).agg((F.count_distinct("split") > 1).alias("leaks")).where("leaks").select(column)
    return rows.join(leaking, column).select(column, "image_id", "split", "class_name", group.alias("group_id"), "relative_path")


def phash_overlap(frame: DataFrame, thresholds=THRESHOLDS, method: str = "auto", blocks: int | None = None) -> DataFrame:
    """Pairs of images of different splits, of any classes, whose hashes differ in as many bits as the largest threshold at most.

    threshold: the smallest that holds. method and blocks: as for hash_pairs."""
    most = max(thresholds)
    rows = with_halves(frame).withColumn("o", split_order())
    rows = rows.where("o > 0").select("image_id", "split", "class_name", "relative_path", "hi", "lo", "o")
    near = distance("l", "r") <= most
    if method == "bands" or method == "auto" and most <= 11:
        left, right = bands(rows, most, False, "image_id", None), bands(rows, most, True, "image_id", None)
        found = left.withColumnRenamed("id", "x").join(right.withColumnRenamed("id", "y"), ["band", "value"]).where("x <> y").select("x", "y").distinct()
        l, r = rows.select(F.struct(*rows.columns).alias("l")), rows.select(F.struct(*rows.columns).alias("r"))
        pairs = found.join(l, F.col("x") == F.col("l.image_id")).join(r, F.col("y") == F.col("r.image_id")).where((F.col("l.o") < F.col("r.o")) & near)
    else:
        blocks = blocks or blocks_for(rows)
        grid = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        part = F.pmod(F.xxhash64("image_id"), F.lit(blocks)).cast("int")
        l, r = rows.withColumn("i", part).withColumn("j", grid).alias("l"), rows.withColumn("j", part).withColumn("i", grid).alias("r")
        pairs = l.join(r, (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j")) & (F.col("l.o") < F.col("r.o")) & near)
    d = distance("l", "r").cast("int")
    smallest = F.array_min(F.filter(F.array(*[F.lit(int(t)) for t in thresholds]), lambda t: d <= t))
    side = lambda s, name: [F.col(f"{s}.{c}").alias(f"{name}_{n}") for c, n in (("image_id", "image_id"), ("split", "split"), ("class_name", "class"), ("relative_path", "relative_path"))]
    return pairs.select(smallest.alias("threshold"), *side("l", "query"), *side("r", "neighbor"), d.alias("phash_distance"))


def threshold_counts(report: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Pairs within each threshold: a row a threshold, 0 if there is none."""
    counts = report.agg(*[F.count_if(F.col("phash_distance") <= t).alias(str(t)) for t in thresholds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(int(t)).alias("threshold"), F.col(f"`{t}`").alias("n_pairs")) for t in thresholds])).alias("x")).select("x.*")


@dataclass(frozen=True)
class Audit:
    distribution: DataFrame
    groups: DataFrame
    hashes: DataFrame
    filenames: DataFrame
    phashes: DataFrame
    summary: DataFrame
    warnings: list[str]


def summarise(distribution: DataFrame, groups: DataFrame, hashes: DataFrame, filenames: DataFrame, phashes: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row: images by split, findings of each audit, and whether they passed."""
    images = distribution.groupBy("split").agg(F.sum("n_images").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("n_images_by_split"))
    near = phashes.agg(F.map_from_arrays(F.array(*[F.lit(str(t)) for t in thresholds]), F.array(*[F.count_if(F.col("phash_distance") <= t) for t in thresholds])).alias("phash_candidate_pairs_by_threshold"), F.count_if(F.col("phash_distance") <= max(thresholds)).alias("near"))
    out = images.crossJoin(groups.agg(F.count("*").alias("group_overlap_rows")))  # one row each
    out = out.crossJoin(hashes.agg(F.count_distinct("sha256").alias("sha256_overlap_hashes"), F.count("*").alias("sha256_overlap_rows")))
    out = out.crossJoin(filenames.agg(F.count("*").alias("filename_overlap_rows"))).crossJoin(near)
    clean = (F.col("group_overlap_rows") == 0) & (F.col("sha256_overlap_rows") == 0) & (F.col("filename_overlap_rows") == 0)
    return out.withColumn("passed_basic_audits", clean).withColumn("passed_phash_audit", F.col("near") == 0).drop("near")


def audit(frame: DataFrame, thresholds=THRESHOLDS, method: str = "auto") -> Audit:
    """All audits over one cached frame. Columns without any value give empty reports and a warning."""
    frame = frame.persist()
    warnings = [f"{c} has no values: its audit is skipped" for c in ("sha256", "phash") if not has_value(frame, c)]
    for c in ("sha256", "phash", "group_id"):
        if c not in frame.columns:
            frame = frame.withColumn(c, F.lit(None).cast("string"))
    reports = (class_distribution(frame), group_overlap(frame), hash_overlap(frame), filename_overlap(frame), phash_overlap(frame, thresholds, method))
    return Audit(*reports, summarise(*reports, thresholds), warnings)


def mark_duplicates(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.withColumn("n_same", F.count("*").over(Window.partitionBy(*keys)))
