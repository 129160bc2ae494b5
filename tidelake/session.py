"""Sessions with the settings that the engine's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on, then what speed does. Everything may be overridden by the caller.
SEMANTICS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.runSQLOnFiles": "false", "spark.sql.sources.partitionColumnTypeInference.enabled": "false"}
SPEED = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.aggregatePushdown": "true"}


def session(name: str = "tidelake", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session: on the cluster that spark-submit names, or on `master`."""
    builder = SparkSession.builder.appName(name).config(map=SEMANTICS | SPEED | {"spark.ui.showConsoleProgress": "false"} | conf)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", conf.get("spark.driver.memory", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
