"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "fathomline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()
