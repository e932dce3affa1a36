"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, local mode takes a temporary one and a cluster,
    whose executors could not read what others write there, is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hearthline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared checkpoint folder, with no lineage before it.

    Spark removes these files when their DataFrame is collected if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
