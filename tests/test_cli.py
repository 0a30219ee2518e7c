"""The command lines from end to end, over a small tree of pictures."""

import json

import numpy as np
import pytest

from curatrix import cli

from .test_operators import png


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(0)
    for k, c in enumerate(("Eucalyptus grandis", "E. saligna")):
        for g in range(5):
            px = rng.integers(0, 256, (16, 20, 3), dtype=np.uint8)
            for i in range(2):
                png(root / f"raw/{c}/33{g}{k}. X.{g}/img {i}.png", px if i else np.roll(px, 1, 0))
    cli.main(["build-manifest", "--raw-root", str(root / "raw"), "--output-dir", str(root / "m"), "--compute-phash"])
    cli.main(["prepare-splits", "--metadata-csv", str(root / "m/metadata.csv"), "--output-dir", str(root / "s"), "--use-phash-components"])
    return root


def test_manifest_and_split(spark, tree):
    s = json.loads((tree / "m/manifest_summary.json").read_text())
    assert s["skipped_files"] == s["unreadable_images"] == 0 and s["phash_backend"] and len(s["expected_classes"]) == 8
    assert json.loads((tree / "m/class_normalization_notes.json").read_text()) == [{"top_level_folder": "E. saligna", "class_name": "Eucalyptus saligna", "note": "normalized from folder 'E. saligna'"}]
    assert (tree / "m/skipped_files.csv").exists() and (tree / "m/unreadable_images.csv").exists()
    assert s["n_images"] == 20 and s["images_by_class"] == {"Eucalyptus grandis": 10, "Eucalyptus saligna": 10}
    split = spark.read.option("header", True).csv(str(tree / "s/split_B_strict.csv"))
    assert split.count() == 20 and "constraint_component" in split.columns
    assert set(json.loads((tree / "s/split_B_strict_summary.json").read_text())["n_images_by_split"]) == {"train", "val", "test"}


def test_audit(tree):
    cli.main(["audit-splits", "--metadata-csv", str(tree / "m/metadata.csv"), "--split-csv", str(tree / "s/split_B_strict.csv"), "--output-dir", str(tree / "a")])
    s = json.loads((tree / "a/audit_summary.json").read_text())
    assert s["group_overlap_rows"] == 0 and s["sha256_overlap_rows"] == 0 and s["warnings"] == []
    tex = (tree / "a/audit_summary_latex_table.tex").read_text().splitlines()
    assert tex[0] == r"\begin{table}[t]" and tex[4:9] == [r"\begin{tabular}{lc}", r"\toprule", r"Audit & Findings \\", r"\midrule", r"Group overlap & 0 \\"]
    assert [x.split(")")[0] for x in tex if x.startswith("pHash")] == [f"pHash candidates (d <= {t}" for t in sorted(map(int, s["phash_candidate_pairs_by_threshold"]))]
    for name in ("split_distribution", "group_overlap_report", "hash_overlap_report", "filename_overlap_report", "phash_overlap_report"):
        assert (tree / f"a/{name}.csv").exists()


def test_existing_and_split_a(spark, tree):
    cli.main(["prepare-splits", "--metadata-csv", str(tree / "m/metadata.csv"), "--existing-split-csv", str(tree / "s/split_B_strict.csv"), "--output-dir", str(tree / "e")])
    assert json.loads((tree / "e/split_B_strict_summary.json").read_text())["matched_rows"] == 20
    cli.main(["create-split-a", "--metadata-csv", str(tree / "m/metadata.csv"), "--output-csv", str(tree / "split_a.csv")])
    assert spark.read.option("header", True).csv(str(tree / "split_a.csv")).columns[:5] == ["image_id", "relative_path", "class_name", "class_index", "split"]


def test_copies(spark, tree):
    read = lambda path: spark.read.option("header", True).csv(str(tree / path))
    both = ["--metadata-csv", str(tree / "m/metadata.csv"), "--split-csv", str(tree / "s/split_B_strict.csv")]
    cli.main(["materialize-split", *both, "--raw-root", str(tree / "raw"), "--output-root", str(tree / "out")])
    found = [p for p in (tree / "out").rglob("*.png")]
    assert len(found) == 20 and {p.relative_to(tree / "out").parts[0] for p in found} == {"train", "val", "test"}
    counts = read("out/materialized_counts.csv")
    assert counts.columns == ["split", "class_folder", "n_images"] and sum(int(r.n_images) for r in counts.collect()) == 20
    assert read("out/materialized_manifest.csv").columns == ["image_id", "split", "class_name", "class_folder", "source_path", "output_path"]
    cli.main(["create-release", *both, "--source-raw-root", str(tree / "raw"), "--output-root", str(tree / "rel")])
    assert len([p for p in (tree / "rel/raw/Eucalyptus_saligna").rglob("*.png")]) == 10
    told = json.loads((tree / "rel/dataset_release_summary.json").read_text())
    assert told["n_images"] == 20 and told["class_counts"] == {"Eucalyptus grandis": 10, "Eucalyptus saligna": 10} and list(told["split_counts"]) == ["train", "val", "test"]
    assert sum(int(r.n_images) for r in read("rel/metadata/release_counts.csv").collect()) == 20
    assert read("rel/metadata/release_manifest.csv").columns[-3:] == ["release_relative_path", "release_raw_relative_path", "original_filename"]


def test_tables_focus_metrics(spark, tree):
    (tree / "notes.csv").write_text("title,,\nScience name,Sample ID,Originin\nE. grandis,3300. X.0,Here\n")
    cli.main(["revision-tables", "--metadata-csv", str(tree / "m/metadata.csv"), "--annotation", str(tree / "notes.csv"), "--output-dir", str(tree / "t")])
    read = lambda path: spark.read.option("header", True).csv(str(tree / path))
    assert read("t/metadata_without_annotation_match.csv").count() == 9
    assert [tuple(r) for r in read("t/per_class_specimen_image_counts.csv").collect()] == [("Eucalyptus grandis", "5", "10"), ("Eucalyptus saligna", "5", "10")]
    assert {(r.class_name, r.source_institution, r.images) for r in read("t/source_institution_breakdown.csv").collect()} == {("Eucalyptus grandis", "Here", "2"), ("Eucalyptus grandis", "unmatched", "8"), ("Eucalyptus saligna", "unmatched", "10")}
    assert read("t/exclusion_log_template.csv").columns == ["change_id", "class_name", "specimen_or_folder", "n_images", "action", "reason"]
    assert read("t/per_class_phash_component_summary.csv").columns[1:3] == ["phash_components", "images"]
    bare = read("m/metadata.csv").drop("phash")
    bare.coalesce(1).write.option("header", True).csv(str(tree / "bare.csv"))
    cli.main(["revision-tables", "--metadata-csv", str(tree / "bare.csv"), "--output-dir", str(tree / "u")])  # neither hashes nor annotations
    assert read("u/per_class_phash_component_summary.csv").columns == ["warning"] and not (tree / "u/annotation_specimen_metadata.csv").exists()
    assert json.loads((tree / "u/revision_tables_summary.json").read_text())["n_images"] == 20
    cli.main(["focus", "--images-root", str(tree / "raw"), "--metadata", str(tree / "m/metadata.csv"), "--out-dir", str(tree / "f")])
    assert "20 measured" in (tree / "f/summary.txt").read_text() and spark.read.option("header", True).csv(str(tree / "f/focus.csv")).count() == 20
    (tree / "p.csv").write_text("path,true_index,pred_index\na,0,0\nb,1,0\n")
    cli.main(["evaluate", "--predictions-csv", str(tree / "p.csv"), "--output-dir", str(tree / "p")])
    assert json.loads((tree / "p/metrics.json").read_text())["accuracy"] == 0.5
