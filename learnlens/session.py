"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Broadcasts stay Spark's own decision, made on measured sizes. Skewed joins are split at run time, also where the
# next step then needs a shuffle that it could otherwise save.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Only a new session can take these. Checkpoint files of results that are no longer in use are deleted.
STATIC_SETTINGS = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that was made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app_name: str = "learnlens", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
