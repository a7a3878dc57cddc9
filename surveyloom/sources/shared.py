"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's path under spark.checkpoint.dir, which all machines see.

    Without that setting only a local session may go on, in a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="surveyloom-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def put_text(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a small file through Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once to a folder of its own in the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_surveyloom_package", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="surveyloom-")) / "surveyloom-survey.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(name))
    sc._surveyloom_package = True
