"""Cutting lineage through the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only local sessions get their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="mediaops-checkpoint-")
    sc.setCheckpointDir(folder)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Later steps never recompute it, executors may be lost, and every consumer sees the very
    same rows even when ``df`` contains a sampled range partitioning.  A table rather than
    ``checkpoint()``: that keeps the partitioning of the plan it cuts, and in a loop of joins
    these descriptions double with every round until planning takes longer than the work.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
