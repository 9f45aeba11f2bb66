"""Python workers find the library where the driver has it; frames are cut off their lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Puts the library's folder on the path of workers that start from now on; a cluster without it there needs it as a package or py-file."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def cut(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there; only a local session that sets none, as in tests, gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith(("local[", "local,")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint(eager=True)
