"""Sessions: the package reaches the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "kairosift.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("kairosift", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it; its own where none is named and there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = own.get() if own.isDefined() else None
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read back: computed once, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
