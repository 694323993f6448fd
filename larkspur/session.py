"""A Spark session with the settings that this library's semantics rest on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "larkspur", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive execution with skew joins, Arrow for Python; on a cluster the deployment's own settings hold.

    ``partitions`` sets spark.sql.shuffle.partitions; with adaptive execution a generous number is
    coalesced by size.
    """
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if partitions:
        build = build.config("spark.sql.shuffle.partitions", str(partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return build.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, as spark.checkpoint.dir names it; on one machine a temporary folder will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found}/{name}-{uuid.uuid4().hex}"
