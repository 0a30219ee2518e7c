"""Operators against brute force and on edge cases."""

import collections
import itertools
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curatrix.functions import images as kernels
from curatrix.operators import audit, components, metrics, profile, splits, validate
from curatrix.sources import images as trees
from curatrix.sources import sinks, tables


def components_of(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_connected(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 70))] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    found = {r.id: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert found == components_of(real, {x for e in real for x in e})


def hashes(spark, n=60, seed=1):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)]
    rows = []
    for i in range(n):
        h = rng.choice(base)
        for _ in range(rng.randrange(9)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, rng.choice("ab"), f"{h:016x}", f"g{rng.randrange(12)}"))
    rows += [(n, "a", "", "g0"), (n + 1, "a", None, "g1"), (n + 2, "b", "1g", "g2"), (n + 3, "a", rows[0][2].upper(), "gx")]
    return rows, spark.createDataFrame(rows, "image_id long, class_name string, phash string, group_id string")


@pytest.mark.parametrize("method, blocks", [("bands", 1), ("blocks", 1), ("blocks", 3)])
@pytest.mark.parametrize("threshold", [0, 5, 10])
def test_hash_pairs(spark, method, blocks, threshold):
    rows, df = hashes(spark)
    good = [r for r in rows if r[2] and r[2] != "1g"]
    want = {(a[0], b[0], (int(a[2], 16) ^ int(b[2], 16)).bit_count()) for a, b in itertools.combinations(good, 2) if a[1] == b[1]}
    want = {x for x in want if x[2] <= threshold}
    got = [tuple(r)[1:] for r in components.hash_pairs(df, threshold, method=method, blocks=blocks).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("blocks, at_once", [(1, 1 << 18), (3, 50)])
def test_bands_stay_inside_tasks(spark, monkeypatch, blocks, at_once):
    """A wide neighbourhood (697 values a band at 15 bits) is looked up, so no join or broadcast holds it; copies and text ids give each pair once."""
    monkeypatch.setattr(components, "PAIRS_AT_ONCE", at_once)
    rows, df = hashes(spark)
    df = df.select(F.format_string("i%03d", "image_id").alias("image_id"), "class_name", "phash")
    good = [(f"i{r[0]:03d}", int(r[2], 16)) for r in rows if r[2] and r[2] != "1g"]
    want = [(a[0], b[0], d) for a, b in itertools.combinations(good, 2) if (d := (a[1] ^ b[1]).bit_count()) <= 15]
    found = components.hash_pairs(df, 15, block=None, method="bands", blocks=blocks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(plan) < 20_000
    assert sorted((r.a, r.b, r.distance) for r in found.collect()) == sorted(want)


def test_components_are_numbered_by_first_row(spark):
    rows, df = hashes(spark)
    made = components.constraint_components(components.phash_components(df, 10))
    got = {r.image_id: (r.phash_component, r.constraint_component) for r in made.collect()}
    assert len(got) == len(rows)
    for c in "ab":
        own = [r for r in rows if r[1] == c]
        near = [(a[0], b[0]) for a, b in itertools.combinations(own, 2) if a[2] and b[2] and "g" not in a[2] + b[2] and (int(a[2], 16) ^ int(b[2], 16)).bit_count() <= 10]
        one = components_of(near, [r[0] for r in own])
        two = components_of([*near, *((a[0], b[0]) for a, b in itertools.combinations(own, 2) if a[3] == b[3])], [r[0] for r in own])
        for roots, k, name in ((one, 0, "phash"), (two, 1, "constraint")):
            order = {root: i + 1 for i, root in enumerate(dict.fromkeys(roots[r[0]] for r in own))}
            assert {i: f"{c}::{name}_{order[roots[i]]:04d}" for i in roots} == {i: got[i][k] for i in roots}


def greedy(sizes, ratios=(0.7, 0.15, 0.15)):
    total, have, out = sum(n for _, n in sizes), [0, 0, 0], {}
    for i, (k, n) in enumerate(sizes):
        to = i if i < 3 else max(range(3), key=lambda s: (total * ratios[s] - have[s], -s))
        out[k] = ("train", "val", "test")[to]
        have[to] += n
    return out


def test_component_split(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(i, c, f"{c}{int(rng.expovariate(0.2)) % 25}") for c in "xy" for i in range(200)]
    df = spark.createDataFrame(rows, "image_id long, class_name string, k string")
    got = {(r.class_name, r.k): r.split for r in splits.component_split(df, "k").select("class_name", "k", "split").distinct().collect()}
    for c in "xy":
        sizes = {}
        for _, _, k in (r for r in rows if r[1] == c):
            sizes[k] = sizes.get(k, 0) + 1
        order = sorted(sizes.items(), key=lambda x: (-x[1], hashlib.sha256(f"42|{x[0]}".encode()).hexdigest()))
        assert greedy(order) == {k: s for (q, k), s in got.items() if q == c}
    shuffled = random.Random(42)
    same = {(r.class_name, r.k): r.split for r in splits.component_split(df, "k", parity_rng=True).select("class_name", "k", "split").distinct().collect()}
    for c in "xy":
        ids = sorted({r[2] for r in rows if r[1] == c})
        shuffled.shuffle(ids)
        order = sorted(((k, sum(r[1] == c and r[2] == k for r in rows)) for k in ids), key=lambda x: -x[1])
        assert greedy(order) == {k: s for (q, k), s in same.items() if q == c}


def test_component_split_errors(spark):
    df = spark.createDataFrame([(1, "a", "p"), (2, "a", "q")], "image_id long, class_name string, k string")
    with pytest.raises(ValueError, match="fewer than three"):
        splits.component_split(df, "k")
    with pytest.raises(ValueError, match="rows without"):
        splits.component_split(df.withColumn("k", F.lit(None).cast("string")), "k")
    with pytest.raises(ValueError, match="add up"):
        splits.component_split(df, "k", ratios=(0.5, 0.1, 0.1))


@pytest.mark.parametrize("mode", ["phash+group", "phash", "group", "group_shuffle", "stratified"])
def test_generators_are_disjoint(spark, mode):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], f"{rng.getrandbits(64):016x}", f"{'ab'[i % 2]}{rng.randrange(20)}") for i in range(200)]
    df = spark.createDataFrame(rows, "image_id long, class_name string, phash string, group_id string")
    made = splits.generate(df, mode)
    assert made.count() == 200 and {r.split for r in made.collect()} == {"train", "val", "test"}
    if mode in ("phash+group", "group", "group_shuffle"):
        assert audit.group_overlap(made).isEmpty()


META = [("1", "c/a.png", "Eucalyptus grandis", 4), ("2", "c/b.png", "Eucalyptus grandis", 4), ("3", "d/a.png", "Eucalyptus saligna", 6)]


def meta(spark):
    return spark.createDataFrame(META, "image_id string, relative_path string, class_name string, class_index int")


def test_validate_by_id(spark):
    given = spark.createDataFrame([("1", "training"), ("2", "val"), ("3", "test"), ("9", "test")], "image_id string, split string")
    v = validate.validate_split(meta(spark), given)
    assert [(r.image_id, r.split) for r in v.split.collect()] == [("3", "test"), ("1", "train"), ("2", "val")]
    assert v.diagnostics["extra_split_rows"] == 1
    with pytest.raises(validate.InvalidSplit, match="no split"):
        validate.validate_split(meta(spark), given.where("image_id <> '2'"))
    assert [r.image_id for r in validate.validate_split(meta(spark), given.where("image_id <> '2'"), True).excluded.collect()] == ["2"]
    with pytest.raises(validate.InvalidSplit, match="repeated"):
        validate.validate_split(meta(spark), given.union(given))
    with pytest.raises(validate.InvalidSplit, match="unknown"):
        validate.validate_split(meta(spark), given.withColumn("split", F.lit("dev")))


def test_validate_by_file_name(spark):
    rows = [("x/train/Eucalyptus grandis/a.png", "train"), ("x/val/Eucalyptus_grandis/b.png", "val"), ("x/test/E. saligna/a.png", "test")]
    given = spark.createDataFrame(rows, "path string, split string")
    v = validate.validate_split(meta(spark), given)
    assert v.diagnostics["match_key"] == "class_name+filename from path" and v.split.count() == 3
    with pytest.raises(validate.InvalidSplit, match="file names repeat"):
        validate.validate_split(meta(spark), given.union(spark.createDataFrame([("y/train/Eucalyptus grandis/a.png", "train")], given.schema)))


def test_validate_class(spark):
    given = spark.createDataFrame([("1", "train", "Eucalyptus saligna"), ("2", "val", "E. grandis"), ("3", "test", "E saligna")], "image_id string, split string, class_name string")
    with pytest.raises(validate.InvalidSplit, match="classes differ"):
        validate.validate_split(meta(spark), given)


def test_audit_of_empty_columns(spark):
    frame = spark.createDataFrame([("1", "train", "c", "p"), ("2", "test", "c", "q")], "image_id string, split string, class_name string, relative_path string")
    a = audit.audit(frame)
    assert len(a.warnings) == 2 and a.hashes.isEmpty() and a.phashes.columns[0] == "threshold"
    s = a.summary.first()
    assert s.passed_basic_audits and s.passed_phash_audit and s.phash_candidate_pairs_by_threshold == {"5": 0, "10": 0}


@pytest.mark.parametrize("method, blocks", [("bands", 1), ("blocks", 2)])
def test_phash_overlap(spark, method, blocks):
    rows, df = hashes(spark)
    df = df.withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("image_id") % 3 + 1).cast("int"))).withColumn("relative_path", F.col("image_id").cast("string"))
    good = [r for r in rows if r[2] and r[2] != "1g"]
    want = set()
    for a, b in itertools.permutations(good, 2):
        d = (int(a[2], 16) ^ int(b[2], 16)).bit_count()
        if a[0] % 3 < b[0] % 3 and d <= 10:
            want.add((5 if d <= 5 else 10, a[0], b[0], d))
    got = audit.phash_overlap(df, (5, 10), method, blocks).select("threshold", "query_image_id", "neighbor_image_id", "phash_distance").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_metrics(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "true_index int, pred_index int")
    labels = spark.createDataFrame([(i,) for i in range(4)], "label int")
    by = {r.label: r for r in metrics.per_class(p, labels).collect()}
    assert (by[1].precision, by[1].recall, by[3].f1, by[3].support) == (pytest.approx(1 / 3), 1.0, 0.0, 0)
    s = metrics.summary(metrics.per_class(p, labels)).first()
    assert s.accuracy == 0.5 and s.macro_f1 == pytest.approx((2 / 3 + 0.5) / 4)
    h = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, None)], "epoch int, val_macro_f1 double")
    assert metrics.best_epoch(h).first().epoch == 2


def test_distribution_of_few(spark):
    one = profile.distribution(spark.createDataFrame([(2.0,)], "x double"), "x").first()
    assert (one.n, one["std"], one["median"]) == (1, None, 2.0)
    none = profile.distribution(spark.createDataFrame([], "x double"), "x").first()
    assert none.n == 0 and none["p5"] is None
    h = profile.histogram(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 5).collect()
    assert [(r.bin, r.n) for r in h] == [(0, 2)]
    b = profile.below(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "x", [2.0]).first()
    assert (b.n_below, b.percent) == (1, 50.0)


def test_annotations(spark):
    rows = [(0, "E. grandis", "3358, 1", "A "), (1, None, "3358.1", "B"), (2, None, None, "C"), (3, "E. saligna", "7", " ")]
    sheet = spark.createDataFrame(rows, "row long, class_name_raw string, sample_id string, source_institution string")
    got = {(r.class_name, r.specimen_key): r.source_institution for r in profile.annotations(sheet, "row").collect()}
    assert got == {("Eucalyptus grandis", "3358.1"): "A; B", ("Eucalyptus saligna", "7"): ""}


def test_destinations(spark):
    df = spark.createDataFrame([("i1", 1), ("i2", 2)], "image_id string, o int")
    got = [r.output_path for r in profile.destinations(df, F.lit("train/c"), F.lit("a.b.png"), "o").orderBy("o").collect()]
    assert got == ["train/c/a.b.png", "train/c/a.b__i2.png"]


# ---------------------------------------------------------------- images


def png(path, px):
    h, w = px.shape[:2]
    raw = b"".join(b"\0" + px[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan(spark, tmp_path):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (12, 9, 3), dtype=np.uint8)
    root = tmp_path / "raw"
    for name in ("E. grandis/3358. X.1/a.png", "E. grandis/3358. X.1/_b.PNG", "Eucalyptus saligna/indoor (2).png"):
        png(root / name, px)
    (root / "E. grandis/.hidden.png").write_bytes(b"x")
    (root / "E. grandis/notes.txt").write_text("x")
    (root / "E. grandis/broken.png").write_bytes(b"no image")
    (root / ".git").mkdir()
    (root / ".git/x.png").write_bytes(b"x")
    png(root / "Unknown wood/c.png", px)
    m = trees.scan(spark, str(root), phash=True)
    rows = {r.relative_path: r for r in m.metadata.collect()}
    assert set(rows) == {"E. grandis/3358. X.1/a.png", "E. grandis/3358. X.1/_b.PNG", "Eucalyptus saligna/indoor (2).png"}
    a = rows["E. grandis/3358. X.1/a.png"]
    assert (a.width, a.height, a.class_name, a.class_index, a.group_id, a.specimen_key, a.image_id) == (9, 12, "Eucalyptus grandis", 4, "3358. X.1", "3358.1", "IMG_000002")
    assert rows["Eucalyptus saligna/indoor (2).png"].light_condition == "indoor" and rows["Eucalyptus saligna/indoor (2).png"].group_id == "indoor"
    grey = kernels.gray(px[:, :, ::-1].tobytes(), 12, 9, 3)
    assert a.phash == kernels.perceptual_hash(grey) and len(a.phash) == 16
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in m.skipped.collect()) == [(".hidden.png", "hidden/system"), ("Unknown wood", "no class has this name"), ("notes.txt", "unsupported extension")]
    assert [r.relative_path for r in m.unreadable.collect()] == ["E. grandis/broken.png"]
    assert [r.top_level_folder for r in m.class_notes.collect()] == ["E. grandis"]
    f = trees.focus(spark, trees.walk_tasks(spark, str(root)).select("image_id", "path"), str(root / "Eucalyptus saligna")).where("image_id like 'Euc%'").first()
    assert f.laplacian_var == pytest.approx(kernels.focus(grey))


def test_focus_kernel():
    px = np.zeros((3, 3), np.uint8)
    px[1, 1] = 1
    # edges are mirrored without repeating them: a neighbour of the centre sees it twice on one side
    lap = np.array([[0, 2, 0], [2, -4, 2], [0, 2, 0]])
    assert kernels.focus(px) == pytest.approx(lap.var())
    assert kernels.focus(np.full((40, 20), 7, np.uint8), 10) == 0


def test_dct_is_orthonormal():
    m = kernels.dct_matrix(32)
    assert np.allclose(m @ m.T, np.eye(32))


def test_jpeg_orientation():
    exif = b"Exif\0\0" + b"MM\0*\0\0\0\x08" + struct.pack(">HHHIHH", 1, 0x112, 3, 1, 6, 0) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + b"\0" * 12
    assert kernels.image_size(jpeg) == (30, 40)
    for bad in (b"", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n" + b"\0" * 20):
        with pytest.raises((ValueError, struct.error)):
            kernels.image_size(bad)


def test_hashes_by_orientation():
    px = np.random.default_rng(3).integers(0, 256, (50, 70), dtype=np.uint8)
    # what a viewer does for the orientations 1 to 8
    shown = (px, np.fliplr(px), np.rot90(px, 2), np.flipud(px), px.T, np.rot90(px, -1), np.rot90(px, 2).T, np.rot90(px))
    made = kernels.perceptual_hashes(px)
    assert made == [kernels.perceptual_hash(x) for x in shown] and len(set(made)) == 8


def java_picture(spark, kind, px):
    """A picture that Java's encoder writes."""
    jvm = spark.sparkContext._jvm
    img = jvm.java.awt.image.BufferedImage(px.shape[1], px.shape[0], 1)
    for y, row in enumerate(px.tolist()):
        for x, (r, g, b) in enumerate(row):
            img.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(img, kind, out)
    return bytes(out.toByteArray())


def test_scan_turned_and_cut_off(spark, tmp_path):
    y, x = np.mgrid[0:40, 0:56]
    px = np.stack([(3 * x + y) % 256, (x * y // 4) % 256, (5 * y) % 256], 2).astype(np.uint8)
    folder = tmp_path / "E. grandis"
    folder.mkdir()
    jpeg = java_picture(spark, "jpg", px)
    exif = b"Exif\0\0" + b"MM\0*\0\0\0\x08" + struct.pack(">HHHIHH", 1, 0x112, 3, 1, 6, 0) + b"\0\0\0\0\0\0"
    (folder / "plain.jpg").write_bytes(jpeg)
    (folder / "turned.jpg").write_bytes(jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + jpeg[2:])
    kinds = {k: java_picture(spark, k, px) for k in ("png", "bmp", "tif")}
    for k, data in (kinds | {"jpg": jpeg}).items():
        (folder / f"whole.{k}").write_bytes(data)
        (folder / f"cut.{k}").write_bytes(data[: len(data) * 2 // 3])
    m = trees.scan(spark, str(tmp_path), phash=True)
    rows = {r.original_filename: r for r in m.metadata.collect()}
    assert sorted(rows) == ["plain.jpg", "turned.jpg", *sorted(f"whole.{k}" for k in ("bmp", "jpg", "png", "tif"))]
    assert (rows["plain.jpg"].width, rows["plain.jpg"].height, rows["turned.jpg"].width, rows["turned.jpg"].height) == (56, 40, 40, 56)
    pixels = spark.read.format("image").load(str(folder / "plain.jpg")).first().image
    grey = kernels.gray(bytes(pixels.data), 40, 56, 3)
    assert rows["plain.jpg"].phash == kernels.perceptual_hash(grey)
    assert rows["turned.jpg"].phash == kernels.perceptual_hash(np.rot90(grey, -1)) != rows["plain.jpg"].phash
    assert rows["whole.png"].phash == rows["whole.bmp"].phash == rows["whole.tif"].phash == kernels.perceptual_hash(kernels.gray(px[:, :, ::-1].tobytes(), 40, 56, 3))
    assert sorted(r.relative_path for r in m.unreadable.collect()) == [f"E. grandis/cut.{k}" for k in ("bmp", "jpg", "png", "tif")]


def test_components_need_hashes(spark):
    df = spark.createDataFrame([("a", "c", None), ("b", "c", "")], "image_id string, class_name string, phash string")
    with pytest.raises(ValueError):
        components.phash_components(df)
    with pytest.raises(ValueError):
        components.phash_components(df.drop("phash"))


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_id,image_path,class_name,class_index,specimen_key\n1,c/a.png,Eucalyptus grandis,4,3358.10\n")
    m = tables.read_metadata(spark, str(tmp_path / "m.csv"))
    assert m.first().specimen_key == "3358.10" and m.first().class_index == 4
    (tmp_path / "s.csv").write_text("image_id,split\n1,Training\n")
    assert tables.read_split(spark, str(tmp_path / "s.csv")).first().split == "train"
    (tmp_path / "a.csv").write_text("title,,\nScience name,Sample ID,Originin\nE. grandis,3358.1,X\n,3358.2,Y\n")
    a = profile.annotations(tables.read_annotations(spark, str(tmp_path / "a.csv")), "row")
    assert sorted(r.specimen_key for r in a.collect()) == ["3358.1", "3358.2"]
    (tmp_path / "lines.csv").write_text('title,,\nScience name,Sample ID,Originin\nE. grandis,3358.1,"X\nY"\n,3358.2,Z\n')
    sheet = {r.sample_id: (r.source_institution, r.row) for r in tables.read_annotations(spark, str(tmp_path / "lines.csv")).collect()}
    assert sheet["3358.1"][0] == "X\nY" and sheet["3358.1"][1] < sheet["3358.2"][1]
    twice = spark.createDataFrame([("1", "b"), ("1", "a")], "image_id string, sha256 string")
    assert [tuple(r) for r in audit.merge_metadata(twice, spark.createDataFrame([("1", "train"), ("2", "val")], "image_id string, split string")).orderBy("image_id").collect()] == [("1", "train", "a"), ("2", "val", None)]
    assert r"a\_b" in sinks.latex_table(spark.createDataFrame([("a_b",)], "x_y string"), "c", "l")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.png").write_bytes(b"1")
    plan = spark.createDataFrame([(str(tmp_path / "src/a.png"), "train/c/a.png"), (None, "x")], "source_path string, output_path string")
    for mode in ("copy", "symlink"):
        sinks.copy_files(plan, str(tmp_path / mode), mode)
        assert (tmp_path / mode / "train/c/a.png").read_bytes() == b"1"
    h = spark.createDataFrame([(1, 0.5)], "epoch int, val_macro_f1 double")
    sinks.append_history(h, str(tmp_path / "h"))
    sinks.append_history(h, str(tmp_path / "h"))
    assert tables.read_history(spark, str(tmp_path / "h")).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_fold_of_sizes_equals_greedy(seed):
    """For every component, by its place among equal sizes, also with few sizes and many components."""
    rng = random.Random(seed)
    for _ in range(60):
        sizes = sorted((rng.choice((1, 1, 2, 3, 7, 20, 100)) if seed % 2 else rng.randrange(1, 12) for _ in range(rng.randrange(3, 120))), reverse=True)
        want = greedy(list(enumerate(sizes)))
        counts = collections.Counter(sizes)
        folded = splits.fold_sizes(pd.DataFrame([("c", n, m) for n, m in counts.items()], columns=["c", "n", "m"]), splits.RATIOS)
        got, at = {}, 0
        for r in folded.itertuples():
            for j in range(counts[r.n]):
                t = j - r.skip
                s = r.first + j if t < 0 else r.one if t < r.a else (r.two, r.one)[(t - r.a) % 2] if t < r.a + r.b else (r.three, r.x, r.y)[(t - r.a - r.b) % 3]
                got[at] = ("train", "val", "test")[s]
                at += 1
        assert got == want


def test_a_large_class_is_no_array(spark):
    df = spark.range(100_000).select(F.col("id").alias("image_id"), F.lit("a").alias("class_name"), F.concat(F.lit("k"), (F.col("id") - F.when(F.col("id") < 300, F.col("id") % 3).otherwise(0)).cast("string")).alias("k"))
    made = splits.component_split(df, "k")
    assert {r.split: r["count"] for r in made.groupBy("split").count().collect()} == {"train": 70_000, "val": 15_000, "test": 15_000}
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [5, 1000])
def test_connected_over_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(components, "EDGES_A_TASK", most)
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("z", f"y{i}") for i in range(12)]
    found = {r.id: r.root for r in components.connected(spark.createDataFrame(edges, "a string, b string").repartition(4)).collect()}
    assert found == {f"n{i:02d}": "n00" for i in range(31)} | {f"y{i}": "y0" for i in range(12)} | {"z": "y0"}
