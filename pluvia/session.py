"""Session factory: UTC, adaptive execution, one place for the defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pluvia", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings that the operators expect; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
