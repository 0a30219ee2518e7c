"""Every query with SQL gives what DuckDB gives over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from curatrix.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(found, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    assert rows(df.select(*columns).collect(), columns, columns) == rows(told.fetchall(), columns, names)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_generated_split_of_few_components(spark, tmp_path):
    """Classes of one and two components are split as in the SQL, not refused."""
    import numpy as np

    rng = np.random.default_rng(4)
    base, vectors = rng.normal(size=(2, 64)), []
    for i in range(60):
        label, kind = i % 3, int(i // 3 % 17 < 6)  # label 1 has two kinds of vectors, each a group of its own
        v = (base[0], base[kind], rng.normal(size=64))[label]
        vectors.append((51 * i + (kind if label == 1 else i), v.tolist(), label))
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLES["generated_split"]).fetchall()
    got = catalogue.QUERIES["generated_split"](spark, str(tmp_path)).collect()
    assert sorted((r.image_id, r.class_name, r.split) for r in got) == sorted(want) and len(want) == 60
    assert {r.split for r in got if r.class_name == "0"} == {"train"}
    assert {r.split for r in got if r.class_name == "1"} == {"train", "val"}
