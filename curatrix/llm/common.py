"""Plumbing that the operators share: scratch tables in the shared folder and shipping of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


#: Rows of an Arrow batch: texts can be long, and a batch is held in memory several times.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the Python workers of a cluster, and keeps this session's Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if _local(spark) or app in _shipped or not ROOT.is_dir():
        return
    target = Path(tempfile.mkdtemp()) / "curatrix.zip"  # Spark hands it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "curatrix").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not _local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="curatrix-")
        shared_dir.own = path
        path = f"file://{path}"
    return path.rstrip("/")


class Scratch:
    """Tables of one job in the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if df is not None and (path := getattr(df, "_scratch_path", None)):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
