"""Command lines: python -m curatrix.cli COMMAND --help. Tables are CSV folders of Spark, documents JSON files."""

from __future__ import annotations

import argparse
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .operators import audit, components, metrics, profile, splits, validate
from .schemas import CLASSES, METADATA_COLUMNS, SPLITS
from .sources import images, sinks, tables


def build_manifest(spark: SparkSession, a) -> None:
    m = images.scan(spark, a.raw_root, not a.no_sha256, a.compute_phash)
    for name, df in (("metadata", m.metadata), ("skipped_files", m.skipped), ("unreadable_images", m.unreadable)):
        sinks.write_csv(df, f"{a.output_dir}/{name}.csv")
    if notes := [r.asDict() for r in m.class_notes.collect()]:  # a row for each folder at the top
        sinks.write_json(notes, f"{a.output_dir}/class_normalization_notes.json")
    sinks.write_json(sinks.label_map(), f"{a.output_dir}/label_map.json")
    told = profile.manifest_summary(m.metadata).first().asDict(True)
    told |= {"raw_root": os.path.abspath(a.raw_root), "skipped_files": m.skipped.count(), "unreadable_images": m.unreadable.count(), "phash_backend": m.phash_backend, "expected_classes": list(CLASSES)}
    sinks.write_json(told | sinks.provenance(), f"{a.output_dir}/manifest_summary.json")


def split_mode(a) -> str:
    if a.use_phash_components:
        return "phash" if a.no_group_aware else "phash+group"
    return "stratified" if a.no_group_aware else "group"


def prepare_splits(spark: SparkSession, a) -> None:
    metadata = tables.read_metadata(spark, a.metadata_csv)
    told: dict = {}
    if a.existing_split_csv:
        v = validate.validate_split(metadata, tables.read_split(spark, a.existing_split_csv), a.allow_subset)
        made, told = v.split, v.diagnostics
        sinks.write_csv(v.excluded, f"{a.output_dir}/{a.split_name}_excluded_metadata_images.csv")
    else:
        made = splits.generate(metadata, split_mode(a), a.seed, (a.train_ratio, a.val_ratio, a.test_ratio), a.phash_threshold)
        told = {"mode": split_mode(a)}
    made = splits.split_layout(made).persist()
    validate.check_completeness(made)
    sinks.write_csv(made.orderBy("split", "class_index", "relative_path"), f"{a.output_dir}/{a.split_name}.csv")
    distribution = audit.class_distribution(made)
    sinks.write_csv(distribution, f"{a.output_dir}/{a.split_name}_distribution.csv")
    sizes = {r.split: r.n_images for r in profile.counts(made, "split").collect()}
    sinks.write_json(told | {"n_images_by_split": sizes} | sinks.provenance(a.seed), f"{a.output_dir}/{a.split_name}_summary.json")


def audit_splits(spark: SparkSession, a) -> None:
    split = tables.read_split(spark, a.split_csv)
    validate.check_completeness(split)
    metadata = tables.read_metadata(spark, a.metadata_csv)
    if n := validate.unknown_images(split, metadata).count():
        raise ValueError(f"{n} split rows are not in the manifest")
    report = audit.audit(audit.merge_metadata(metadata, split), tuple(a.phash_thresholds))
    names = {"split_distribution": report.distribution, "group_overlap_report": report.groups, "hash_overlap_report": report.hashes, "filename_overlap_report": report.filenames, "phash_overlap_report": report.phashes}
    for name, df in names.items():
        sinks.write_csv(df, f"{a.output_dir}/{name}.csv")
    told = report.summary.persist()
    sinks.write_json(told.first().asDict(True) | {"warnings": report.warnings}, f"{a.output_dir}/audit_summary.json")
    Path(a.output_dir, "audit_summary_latex_table.tex").write_text(sinks.latex_audit(told))
    sinks.split_chart(report.distribution, f"{a.output_dir}/split_distribution.png")
    told.unpersist()


def create_split_a(spark: SparkSession, a) -> None:
    made = splits.group_split(tables.read_metadata(spark, a.metadata_csv), seed=a.seed)
    sinks.write_csv(validate.prefer(made, ["image_id", "relative_path", "class_name", "class_index", "split", *METADATA_COLUMNS]), a.output_csv)


def _sources(spark: SparkSession, a, root: str) -> DataFrame:
    split = tables.read_split(spark, a.split_csv)
    metadata = tables.read_metadata(spark, a.metadata_csv)
    lost = validate.unknown_images(split, metadata)
    if not lost.isEmpty():
        raise ValueError(f"images without metadata: {[r.image_id for r in lost.limit(10).collect()]}")
    added = [c for c in ("raw_path", "original_filename") if c in metadata.columns and c not in split.columns]
    rows = split.join(metadata.select("image_id", *added), "image_id", "left")
    files = images.list_tree(spark, os.path.abspath(root)).select(F.col("raw_path").alias("path"))
    if "raw_path" in rows.columns:  # candidates outside the root
        others = rows.select(F.col("raw_path").alias("path")).where("path is not null").distinct()
        files = files.unionByName(others.where(images.exists_udf("path")))
    return tables.resolve_paths(rows, files, os.path.abspath(root))


def materialize_split(spark: SparkSession, a) -> None:
    rows = _sources(spark, a, a.raw_root)
    named = rows.where("source_path is not null").withColumn("class_folder", keys.class_folder(F.col("class_name"), a.folder_name_style))
    plan = profile.destinations(named, F.concat_ws("/", "split", "class_folder"), keys.basename(F.col("source_path")), "image_id").persist()
    sinks.copy_files(plan, a.output_root, a.copy_mode, a.overwrite)
    if n := rows.where("source_path is null").count():
        raise FileNotFoundError(f"{n} source images are missing; all others were copied")
    at = F.concat(F.lit(a.output_root.rstrip("/") + "/"), "output_path").alias("output_path")
    sinks.write_csv(plan.select("image_id", "split", "class_name", "class_folder", "source_path", at), f"{a.output_root}/materialized_manifest.csv")
    sinks.write_csv(profile.counts(plan, "split", "class_folder").orderBy("split", "class_folder"), f"{a.output_root}/materialized_counts.csv")
    plan.unpersist()


def create_release(spark: SparkSession, a) -> None:
    rows = _sources(spark, a, a.source_raw_root)
    if n := rows.where("source_path is null").count():
        raise FileNotFoundError(f"{n} source images are missing")
    inside = keys.below_class(F.col("relative_path"))
    plan = profile.destinations(rows, keys.class_folder(F.col("class_name"), a.folder_name_style), inside, "image_id").persist()
    sinks.copy_files(plan.withColumn("output_path", F.concat(F.lit("raw/"), "output_path")), a.output_root, a.copy_mode, a.overwrite)
    at = plan.select("image_id", F.col("output_path").alias("_new"))
    new = [F.concat(F.lit("raw/"), "output_path").alias("release_relative_path"), F.col("output_path").alias("release_raw_relative_path")]
    name = F.col("original_filename") if "original_filename" in plan.columns else keys.basename(F.col("relative_path")).alias("original_filename")
    sinks.write_csv(plan.select("image_id", "split", "class_name", "class_index", F.col("relative_path").alias("source_relative_path"), *new, name), f"{a.output_root}/metadata/release_manifest.csv")
    moved = lambda df: df.join(at, "image_id").withColumn("relative_path", F.col("_new")).drop("_new")
    sinks.write_csv(moved(tables.read_metadata(spark, a.metadata_csv)).withColumn("raw_path", F.concat(F.lit("raw/"), "relative_path")), f"{a.output_root}/metadata/metadata.csv")
    sinks.write_csv(moved(tables.read_split(spark, a.split_csv)), f"{a.output_root}/splits/{a.split_name}.csv")
    sinks.write_json(sinks.label_map(), f"{a.output_root}/metadata/label_map.json")
    counts = profile.counts(plan, "split", "class_name").persist()  # splits times classes
    sinks.write_csv(counts.orderBy("split", "class_name"), f"{a.output_root}/metadata/release_counts.csv")
    total = lambda column: {r[0]: r.n for r in counts.groupBy(column).agg(F.sum("n_images").alias("n")).orderBy(column).collect()}
    by_split = total("split")
    told = {"source_raw_root": os.path.abspath(a.source_raw_root), "output_root": a.output_root, "n_images": sum(by_split.values()), "split_counts": {s: by_split.get(s, 0) for s in SPLITS}, "class_counts": total("class_name")}
    told |= {"folder_name_style": a.folder_name_style, "copy_mode": a.copy_mode}
    parts = {"raw": "raw", "metadata_csv": "metadata/metadata.csv", "split_csv": f"splits/{a.split_name}.csv", "release_manifest": "metadata/release_manifest.csv", "counts": "metadata/release_counts.csv"}
    sinks.write_json(told | {"release_files": {k: f"{a.output_root}/{v}" for k, v in parts.items()}} | sinks.provenance(), f"{a.output_root}/dataset_release_summary.json")
    counts.unpersist()
    plan.unpersist()


def revision_tables(spark: SparkSession, a) -> None:
    metadata = tables.read_metadata(spark, a.metadata_csv)
    validate.require(metadata, ["group_id"], "metadata")
    metadata = metadata.withColumn("specimen_key", keys.specimen_key(F.col("group_id"))).persist()
    specimens = lambda *by: metadata.groupBy(*by).agg(F.count_distinct("group_id").alias("specimens"), F.count("image_id").alias("images")).orderBy(*by)
    made = {
        "per_class_specimen_image_counts": specimens("class_name"),
        "resolution_distribution": profile.resolutions(metadata),
        "resolution_distribution_by_class": profile.resolutions(metadata, "class_name"),
        "file_extension_by_class": profile.counts(metadata, "class_name", "file_extension").orderBy("class_name", "file_extension"),
        "light_condition_by_class": specimens("class_name", "light_condition"),
        "exclusion_log_template": sinks.exclusion_template(spark),
    }
    captions = {"per_class_specimen_image_counts": ("Per-class specimen and image counts.", "tab:per_class_specimen_counts")}
    if validate.has_value(metadata, "phash"):
        near = components.phash_components(metadata, a.phash_threshold)
        made["phash_component_sizes"] = profile.component_sizes(near, "phash_component").withColumnRenamed("size", "component_size")
        names = {"n_components": "phash_components", "n_images": "images", "min_size": "min_component_size", "median_size": "median_component_size", "mean_size": "mean_component_size", "max_size": "max_component_size"}
        made["per_class_phash_component_summary"] = profile.component_summary(near, "phash_component").withColumnsRenamed(names).orderBy("class_name")
    else:
        made["per_class_phash_component_summary"] = spark.createDataFrame([("metadata has no phash values: build the manifest with --compute-phash",)], "warning string")
    if a.annotation:
        notes = profile.annotations(tables.read_annotations(spark, a.annotation), "row")
        on = ["class_name", "specimen_key"]
        joined = profile.annotate(metadata, notes, on).withColumn("source_institution", F.coalesce("source_institution", F.lit("unmatched")))
        made["annotation_specimen_metadata"] = notes.orderBy(*on)
        made["metadata_without_annotation_match"] = profile.unannotated(metadata, notes, on, ["group_id", *on]).orderBy(*on)
        by = ["class_name", "source_institution"]
        made["source_institution_breakdown"] = joined.groupBy(*by).agg(F.count_distinct("group_id").alias("specimens"), F.count("image_id").alias("images")).orderBy(*by)
        captions["source_institution_breakdown"] = ("Per-class source-institution breakdown.", "tab:source_institution_breakdown")
    for name, df in made.items():
        sinks.write_csv(df, f"{a.output_dir}/{name}.csv")
    for name, (caption, label) in captions.items():
        Path(a.output_dir, f"{name}.tex").write_text(sinks.latex_table(made[name], caption, label))
    total = metadata.agg(F.count("*").alias("n_images"), F.count_distinct("class_name").alias("n_classes"), F.count_distinct("group_id").alias("n_specimens")).first().asDict()
    told = {"metadata_csv": a.metadata_csv, "annotation": a.annotation, **total, "outputs": sinks.list_outputs(a.output_dir)}
    sinks.write_json(told | sinks.provenance(), f"{a.output_dir}/revision_tables_summary.json")
    metadata.unpersist()


def focus(spark: SparkSession, a) -> None:
    root = os.path.abspath(a.images_root)
    if a.no_metadata or not a.metadata:
        tasks = images.walk_tasks(spark, root).withColumn("class_name", F.lit("")).withColumn("split", F.lit(""))
    else:
        rows = tables.read_csv(spark, a.metadata)
        more = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in ("class_name", "split")]
        at = F.when(F.col(a.path_column).startswith("/"), F.col(a.path_column)).otherwise(F.concat(F.lit(root + "/"), F.col(a.path_column)))
        tasks = rows.select(F.coalesce(F.nullif("image_id", F.lit("")), F.col(a.path_column)).alias("image_id"), at.alias("path"), *more)
    told = images.focus(spark, tasks, root, a.resize_longer).join(tasks.drop("path"), "image_id").persist()
    good, bad = told.where("error is null"), told.where("error is not null")
    sinks.write_csv(good.orderBy("laplacian_var", "image_id"), f"{a.out_dir}/focus.csv")
    parts = (profile.distribution(good, "laplacian_var"), profile.distribution(good, "laplacian_var", "class_name"), profile.below(good, "laplacian_var", a.thresholds))
    lowest = profile.lowest(good.select("image_id", "laplacian_var"), "laplacian_var", "image_id", a.lowest)
    Path(a.out_dir, "summary.txt").write_text(sinks.focus_report(*parts, lowest, bad.select("image_id", "error")))
    sinks.lines_chart(profile.histogram(good, "laplacian_var"), "bin", ["n"], f"{a.out_dir}/histogram.png")


def evaluate(spark: SparkSession, a) -> None:
    p = spark.read.option("header", True).csv(a.predictions_csv)
    p = p.select(F.col("true_index").cast("int").alias("true_index"), F.col("pred_index").cast("int").alias("pred_index"))
    labels = spark.createDataFrame([(i,) for i in range(len(CLASSES))], "label int")
    by = metrics.per_class(p, labels)
    summary, matrix = metrics.summary(by), metrics.confusion(p, labels)
    sinks.write_csv(by, f"{a.output_dir}/per_class.csv")
    sinks.write_csv(matrix, f"{a.output_dir}/confusion.csv")
    sinks.write_json(summary, f"{a.output_dir}/metrics.json")
    Path(a.output_dir, "metrics.tex").write_text(sinks.latex_metrics(summary, a.name))
    sinks.heat_map(matrix, f"{a.output_dir}/confusion.png")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="curatrix")
    sub = p.add_subparsers(required=True)

    def command(f, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(f.__name__.replace("_", "-"))
        c.set_defaults(run=f)
        for x in paths:
            c.add_argument(f"--{x}", required=True)
        return c

    c = command(build_manifest, "raw-root", "output-dir")
    c.add_argument("--no-sha256", action="store_true")
    c.add_argument("--compute-phash", action="store_true")
    c = command(prepare_splits, "metadata-csv", "output-dir")
    c.add_argument("--existing-split-csv")
    c.add_argument("--split-name", default="split_B_strict")
    c.add_argument("--seed", type=int, default=42)
    for name, r in zip(("train", "val", "test"), splits.RATIOS):
        c.add_argument(f"--{name}-ratio", type=float, default=r)
    c.add_argument("--use-phash-components", action="store_true")
    c.add_argument("--phash-threshold", type=int, default=10)
    c.add_argument("--no-group-aware", action="store_true")
    c.add_argument("--allow-subset", action="store_true")
    c = command(audit_splits, "metadata-csv", "split-csv", "output-dir")
    c.add_argument("--phash-thresholds", type=int, nargs="+", default=list(audit.THRESHOLDS))
    c = command(create_split_a, "metadata-csv", "output-csv")
    c.add_argument("--seed", type=int, default=42)
    c = command(materialize_split, "metadata-csv", "split-csv", "raw-root", "output-root")
    c.add_argument("--folder-name-style", choices=["legacy", "underscore", "canonical"], default="legacy")
    c.add_argument("--copy-mode", choices=["copy", "symlink"], default="copy")
    c.add_argument("--overwrite", action="store_true")
    c = command(create_release, "metadata-csv", "split-csv", "source-raw-root", "output-root")
    c.add_argument("--folder-name-style", choices=["underscore", "canonical"], default="underscore")
    c.add_argument("--copy-mode", choices=["copy", "symlink"], default="copy")
    c.add_argument("--split-name", default="split_B_strict")
    c.add_argument("--overwrite", action="store_true")
    c = command(revision_tables, "metadata-csv", "output-dir")
    c.add_argument("--annotation")
    c.add_argument("--phash-threshold", type=int, default=10)
    c = command(focus, "images-root", "out-dir")
    c.add_argument("--metadata")
    c.add_argument("--no-metadata", action="store_true")
    c.add_argument("--path-column", default="relative_path")
    c.add_argument("--thresholds", type=float, nargs="+", default=[50, 100, 150, 200, 300])
    c.add_argument("--resize-longer", type=int, default=0)
    c.add_argument("--lowest", type=int, default=25)
    c = command(evaluate, "predictions-csv", "output-dir")
    c.add_argument("--name", default="model")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("curatrix").getOrCreate(), a)


if __name__ == "__main__":
    main()
