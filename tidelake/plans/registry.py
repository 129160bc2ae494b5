"""Registered queries: a name, a Spark form and, where SQL can express it, the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query in Spark's SQL over the tables that it names; oracle: the same in the oracle's dialect, if it differs."""
    import re

    used = [t for t in TABLES if re.search(rf"\b{t}\b", spark_sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = oracle or spark_sql


def query(oracle: str | None = None):
    """Registers a function (load, spark) -> DataFrame under its name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: load(spark, sf_dir, name), spark)

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register
