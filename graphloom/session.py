"""Sessions, the folder that driver and executors share, and getting the library to the executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Bytes of the batches that go to Python workers and come back: by rows alone 10,000 long texts would be one.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxBytesPerOutputBatch": "2m"}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that functions of it can run there, and bound Arrow batches by bytes."""
    context = spark.sparkContext
    for key, most in BATCH_BYTES.items():
        spark.conf.set(key, most)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"graphloom/{p.relative_to(root)}")
        context.addPyFile(str(at))
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage and go away together.

    Used as a context manager by operators that finish their large steps before they return: what is
    left for the caller is kept by ``keep`` (a reliable ``checkpoint``, small), the rest is deleted.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def keep(self, df: DataFrame) -> DataFrame:
        """A result that outlives the scratch tables and goes when nobody refers to it."""
        if self.spark.sparkContext.getCheckpointDir() is None:
            self.spark.sparkContext.setCheckpointDir(shared_dir(self.spark))
        return df.checkpoint()

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished steps now rather than at its next collection."""
    gc.collect()
    spark._jvm.System.gc()
