"""Session helpers shared by tests, the bench and scripts."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None, name: str = "folioweave", **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster use your own session instead."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        os.environ["PYTHONPATH"] = root + (os.pathsep + path if path else "")
    builder = (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
