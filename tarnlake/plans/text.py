"""Items whose query is SQL text: the Spark text, and the oracle's where it differs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.session import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_text(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query function of SQL text; the tables it names become views of the data directory."""
    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark, d, *named)
        return spark.sql(text)

    return run


def same(text: str) -> tuple:
    return run_text(text), text


def pair(spark_text: str, duck_text: str) -> tuple:
    return run_text(spark_text), duck_text
