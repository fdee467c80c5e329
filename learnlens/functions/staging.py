"""Intermediate results that several later steps read, written once to shared storage.

A written result cuts the lineage: a lost executor costs a re-read, not a recomputation of everything before. The files are Spark
checkpoints: they go when the result is no longer in use and `spark.cleaner.referenceTracking.cleanCheckpoints` is on. The shuffle files
behind it are of no use any more and go at once, and not when the driver next happens to collect its garbage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; on one machine, where none is named, one below the warehouse."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named and not is_one_machine(spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def is_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def stage(df: DataFrame) -> DataFrame:
    """Write `df` and return a DataFrame that reads it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, None)
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        # a query of its own takes the setting, so that `df` itself keeps the files of other uses
        return df.select("*").checkpoint()
    finally:
        if before is None:
            conf.unset(CLEAN_SHUFFLES)
        else:
            conf.set(CLEAN_SHUFFLES, before)
