"""Profile tables of a manifest, distributions of a measure, and annotation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import class_index, normalise_class, sample_id

QUANTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def counts(df: DataFrame, *keys: str, name: str = "n_images") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def specimen_counts(df: DataFrame, *keys: str, group: str = "group_id") -> DataFrame:
    """Groups and images by the keys."""
    return df.groupBy(*keys).agg(F.count_distinct(group).alias("n_specimens"), F.count("*").alias("n_images"))


def size_summary(df: DataFrame) -> DataFrame:
    """One row: images, classes, and the least, greatest and mean width and height."""
    sides = [f(c).alias(f"{c}_{n}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.agg(F.count("*").alias("n_images"), F.count_distinct("class_name").alias("n_classes"), *sides)


def resolutions(df: DataFrame, *keys: str) -> DataFrame:
    """Images by size, most frequent first, ties by width and height."""
    return counts(df, *keys, "width", "height").orderBy(*keys, F.desc("n_images"), "width", "height")


def manifest_summary(df: DataFrame) -> DataFrame:
    """One row with nested counts, fit for a JSON document."""
    pairs = lambda d, *cols: d.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    by_class = df.groupBy("class_name").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("g"))
    maps = by_class.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "n")))).alias("images_by_class"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "g")))).alias("groups_by_class"),
    )
    light = pairs(counts(df, "class_name", "light_condition"), "class_name", "light_condition", "n_images").withColumnRenamed("x", "light_by_class")
    kinds = pairs(counts(df, "class_name", "file_extension"), "class_name", "file_extension", "n_images").withColumnRenamed("x", "extensions_by_class")
    return size_summary(df).crossJoin(maps).crossJoin(kinds).crossJoin(light)  # one row each


def component_sizes(df: DataFrame, component: str, class_col: str = "class_name") -> DataFrame:
    return df.groupBy(class_col, component).agg(F.count("*").alias("size"))


def component_summary(df: DataFrame, component: str, class_col: str = "class_name") -> DataFrame:
    """Of each class: components, rows, and the distribution of component sizes."""
    return component_sizes(df, component, class_col).groupBy(class_col).agg(
        F.count_distinct(component).alias("n_components"),
        F.sum("size").alias("n_images"),
        F.min("size").alias("min_size"),
        F.percentile("size", 0.5).alias("median_size"),
        F.avg("size").alias("mean_size"),
        F.max("size").alias("max_size"),
        F.count_if(F.col("size") > 1).alias("n_multi"),
        F.sum(F.col("size") - 1).alias("n_excess"),
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).alias("n_grouped"),
    )


# ---------------------------------------------------------------- annotations


def forward_fill(df: DataFrame, column: str, order: str, *keys: str) -> DataFrame:
    """Nulls of a column take the last value before them in the order, within the keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, True).over(w))


def joined_unique(column: str | Column) -> Column:
    """An aggregate: the distinct values without blanks at their ends, sorted, joined by "; "; empty if there is none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(c.cast("string")), F.lit("")))), "; ")


def annotations(sheet: DataFrame, order: str) -> DataFrame:
    """An annotation sheet by class and specimen: class names filled downwards and normalised, rows without a sample dropped, texts joined."""
    rows = forward_fill(sheet, "class_name_raw", order).where("sample_id is not null")
    rows = rows.withColumn("class_name", normalise_class(F.col("class_name_raw"))["name"]).withColumn("specimen_key", sample_id(F.col("sample_id")))
    texts = [c for c in ("source_institution", "humidity_state", "collectors", "captured_place", "annotation_light_condition", "image_refs", "qc_notes") if c in rows.columns]
    return rows.groupBy("class_name", "specimen_key").agg(*[joined_unique(c).alias(c) for c in texts], F.count("*").alias("annotation_rows"))


def annotate(df: DataFrame, notes: DataFrame, keys: list[str], flag: str = "annotated") -> DataFrame:
    """df with its annotations, and whether it has any: a blank annotation is not a missing one."""
    return df.join(notes.withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unannotated(df: DataFrame, notes: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Distinct keys (or columns that include them) without an annotation."""
    return df.select(*(columns or keys)).distinct().join(notes, keys, "left_anti")


def source_breakdown(annotated: DataFrame, column: str, *keys: str) -> DataFrame:
    """Images by the keys and an annotation; images without one are "unmatched"."""
    return counts(annotated, *keys, column).withColumn(column, F.coalesce(column, F.lit("unmatched")))


# ---------------------------------------------------------------- measures


def distribution(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """n, mean, sample deviation, exact quantiles (linear), least and greatest of a measure."""
    qs = F.percentile(column, F.array(*map(F.lit, QUANTILES.values())))
    out = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), qs.alias("_q"), F.max(column).alias("max")
    )
    return out.select(*keys, "n", "mean", "std", "min", *[F.col("_q")[i].alias(q) for i, q in enumerate(QUANTILES)], "max")


def below(df: DataFrame, column: str, thresholds) -> DataFrame:
    """Rows strictly below each threshold, and their share in percent."""
    one = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), *[F.count_if(F.col(column) < t).alias(f"b{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"b{i}").alias("n_below")) for i, t in enumerate(thresholds)]))
    return one.select("n", rows.alias("r")).select("r.threshold", "r.n_below", F.try_divide(100.0 * F.col("r.n_below"), F.col("n")).alias("percent"))


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal bins between the least and greatest value; the last is closed. Empty bins have no row."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def lowest(df: DataFrame, column: str, id: str, k: int = 25) -> DataFrame:
    """The k lowest values, ties by id."""
    return df.where(F.col(column).isNotNull()).orderBy(column, id).limit(k)


# ---------------------------------------------------------------- plans for files


def numbered(df: DataFrame, order: list[str], prefix: str, out: str = "image_id") -> DataFrame:
    """df with ids of a prefix and six digits, counted in an order: a range sort, and a count of each partition, no single task."""
    schema = df.schema
    sorted_ = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from .components import cut

    placed = cut(sorted_)
    sizes = {r._p: r.n for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, base = 0, {}
    for p in sorted(sizes):
        base[p] = before
        before += sizes[p]
    offset = F.lit(0).cast("long") if not base else F.element_at(F.create_map(*[F.lit(x) for p, b in base.items() for x in (p, b)]), F.col("_p")).cast("long")
    n = offset + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return placed.select(F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0")).alias(out), *[f.name for f in schema if f.name != out])


def destinations(df: DataFrame, folder: Column, name: Column, order: str, id: str = "image_id") -> DataFrame:
    """df with output_path: folder/name, and stem__id.ext for all but the first row (in the order) of a path."""
    d = df.withColumn("_d", F.concat_ws("/", folder, name)).withColumn("_n", F.row_number().over(Window.partitionBy("_d").orderBy(order)))
    again = F.regexp_replace("_d", r"((?:^|/)[^/]+?)(\.[^./]+)?$", F.concat(F.lit("$1__"), F.col(id), F.lit("$2")))
    return d.withColumn("output_path", F.when(F.col("_n") == 1, F.col("_d")).otherwise(again)).drop("_d", "_n")


def with_class(df: DataFrame, folder: str) -> DataFrame:
    told = normalise_class(F.col(folder))
    return df.withColumn("class_name", told["name"]).withColumn("class_index", class_index(told["name"])).withColumn("class_note", told["note"])
