"""The Spark session of the command-line tool; as a library, every function takes the caller's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """The running session, or a new one with the settings that the operators assume: UTC, ANSI and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()
