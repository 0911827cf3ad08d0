"""What a session needs before its Python workers can run this package."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Workers that share this folder find the package as the driver does.  Where they don't, submit it with the job
    (--py-files)."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([*known, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, that driver and executors share.  A local session without one gets its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp()
