"""SparkSession factory with the settings the engine is tested under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "loomline", master: str | None = None, **conf: str) -> SparkSession:
    """Local session for tests and benches; on a cluster pass your own session instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": master or f"local[{cpus}]",
        "spark.app.name": app,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    return SparkSession.builder.config(map=settings).getOrCreate()
