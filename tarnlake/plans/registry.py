"""All registered queries of the library, with their oracle SQL.

A query module has ITEMS: name -> (function of (spark, sf_dir), oracle SQL or None).
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "custom", "statistics", "functions", "functions_more", "sources", "catalog", "suites")


def items() -> dict:
    out: dict = {}
    for m in MODULES:
        found = importlib.import_module(f"tarnlake.plans.{m}").ITEMS
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict:
    return {k: v[0] for k, v in items().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in items().items() if v[1]}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["tpch_q06"](spark, sf_dir)
