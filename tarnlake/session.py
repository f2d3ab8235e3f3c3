"""Session settings and table loading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine's results rely on; anything about size is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tarnlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_workers(spark)
    return spark


def ensure_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (on a cluster ship it with --py-files too)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, held)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; a file or a folder of Parquet files."""
    ensure_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables, for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a session in one process (local master, as in tests) gets a temporary folder of its own; a
    cluster has none that all its machines see, so there it is an error.
    """
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a slash at its end; see scratch_path."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            d = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            d = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
            spark.sparkContext.setCheckpointDir(d)
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
    return d.rstrip("/")
