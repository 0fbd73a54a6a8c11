"""Session factory with the settings every plan in this package assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "isolens", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC, ANSI session.  Without a master, one that is set in the environment is used."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    if master and master.startswith("local"):
        settings.setdefault("spark.sql.shuffle.partitions", "8")
        settings.setdefault("spark.driver.memory", os.environ.get("ISOLENS_DRIVER_MEMORY", "8g"))
        settings.setdefault("spark.ui.showConsoleProgress", "false")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
