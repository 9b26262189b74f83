"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corpuscope", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and bounded Arrow batches; settings override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    }
    return builder.config(map=own | settings).getOrCreate()
