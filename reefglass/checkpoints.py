"""Cutting lineage through the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; a cluster is refused, as its executors share no such folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="reefglass-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


__all__ = ["cut", "ensure_checkpoint_dir"]
