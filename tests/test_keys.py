"""Column functions on literal edge cases."""

import pytest
from pyspark.sql import functions as F

from curatrix.functions import keys
from curatrix.functions.hashing import distance, is_hash, sign_hash, with_halves


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ascii_key(spark):
    assert run(spark, keys.ascii_key, ["12. Été & co", "ﬁ①", "  3358_A-b ", "", None]) == ["ete and co", "fi1", "a b", "", None]


@pytest.mark.parametrize(
    "folder, name, noted",
    [
        ("Eucalyptus_camaldulensis", "Eucalyptus camaldulensis", False),
        ("E. camaldulensis", "Eucalyptus camaldulensis", True),
        ("3358. Eucalyptus camandulensis", "Eucalyptus camaldulensis", True),
        ("S. hemisphericum", "Syzygium hemisphericum", True),
        ("Syzygium chanlos", "Syzygium hemisphericum", True),
        ("wood of grandis", "Eucalyptus grandis", True),
        ("Syzygium grandis", None, None),
        ("hemisphericum leaf", "Syzygium hemisphericum", True),
        ("unknown", None, None),
        ("", None, None),
    ],
)
def test_class(spark, folder, name, noted):
    told = run(spark, keys.normalise_class, [folder])[0]
    assert told.name == name
    assert (told.note if noted is None else bool(told.note)) == noted


def test_class_aliases_keep_their_index(spark):
    assert run(spark, lambda v: keys.class_index(v), ["Eucalyptus camaldulensis", "Syzygium hemisphericum", "x"]) == [0, 7, None]


def test_paths(spark):
    assert run(spark, keys.path_key, ["../.a/b", "./x//y/", "a/./b", "/abs/p"]) == ["a/b", "x/y", "a/b", "abs/p"]
    assert run(spark, keys.basename, ["a/b.PNG", "a/"]) == ["b.PNG", "a"]
    assert run(spark, keys.extension, ["a/b.PNG", ".x", "a.", "n", "a.tar.gz"]) == [".png", "", "", "", ".gz"]
    assert run(spark, keys.stem, ["a/b.c.PNG", ".x", "n"]) == ["b.c", ".x", "n"]
    assert run(spark, keys.below_class, ["c/g/x.png", "x.png"]) == ["g/x.png", "x.png"]
    assert run(spark, keys.is_image, ["c/x.PNG", "c/.x.png", "c/_x.png", ".git/x.png", "c/Thumbs.db", "c/x.webp", "c/x.gif"]) == [True, False, True, False, False, True, False]


def test_groups(spark):
    assert run(spark, keys.group_stem, ["A  b. (12)", "x...", "(3)", "a(1)b"]) == ["A b", "x", "(3)", "a(1)b"]
    assert run(spark, keys.specimen_key, ["3358. X.1", "3358. X.10", "3284. X.011", "none", "1234"]) == ["3358.1", "3358.10", "3284.11", "none", "1234"]
    assert run(spark, keys.group_id, ["c/g/x.png", "c/x (2).png"]) == ["g", "x"]
    assert run(spark, lambda p: keys.parsed_group(p, F.lit("C")), ["c/g/h/x.png", "c/x (2).png"]) == ["C::g/h", "C::x"]
    assert run(spark, keys.light, ["c/Indoor_outdoor/x", "c/OUTDOOR.png", "c/x"]) == ["indoor", "outdoor", "natural"]
    assert run(spark, keys.sample_id, [" 3358,x 7 "]) == ["3358.7"]


def test_split_values(spark):
    assert run(spark, keys.normalise_split, ["train", "Training", " valid ", "VALIDATION", "testing", "dev", None]) == ["train", "train", "val", "val", "test", None, None]


def test_folders(spark):
    one = lambda style: run(spark, lambda v: keys.class_folder(v, style), ["Eucalyptus deglupta"])[0]
    assert (one("canonical"), one("underscore"), one("legacy")) == ("Eucalyptus deglupta", "Eucalyptus_deglupta", "Eucalyptus_daglupta")
    with pytest.raises(ValueError):
        keys.class_folder(F.lit("x"), "other")


def test_hashes(spark):
    assert run(spark, is_hash, ["f" * 16, "0", "", None, "zz", "F0", "1" * 17, "0x1"]) == [True, True, False, False, False, True, False, False]
    df = with_halves(spark.createDataFrame([("a", "f" * 16), ("b", "0"), ("c", "1g")], "id string, phash string"))
    r = df.alias("l").join(df.alias("r"), F.col("l.id") < F.col("r.id")).select(distance("l", "r").alias("d")).collect()
    assert [x.d for x in r] == [64]


def test_sign_hash(spark):
    df = spark.createDataFrame([([float(i) for i in range(64)],), ([1.0],)], "v array<double>")
    assert [r.h for r in df.select(sign_hash(F.col("v")).alias("h")).collect()] == ["00000000ffffffff", None]
