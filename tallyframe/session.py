"""What a session needs: this package on its executors, and tables between steps in the folder that all share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows go to Python workers in batches of at most so many bytes, so that long texts don't add up in memory.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds the batches of the session."""
    if int(re.sub(r"\D", "", spark.conf.get(_BATCH))) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="spark-")) / "tallyframe_pkg.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine that names none (tests) gets a new one."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one operator, in the shared folder. A table is dropped once its successors are
    written, so disk holds what is still read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, step: str) -> DataFrame:
        """Writes df as the table of a step and reads it again; the step's table before it is dropped after that."""
        path, old = new_path(self.spark, f"{self.name}-{step}"), self.paths.get(step)
        df.write.parquet(path)
        self.paths[step] = path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: str) -> None:
        for step in steps:
            if step in self.paths:
                self._delete(self.paths.pop(step))

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
