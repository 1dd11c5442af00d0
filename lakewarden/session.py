"""Session defaults shared by the command line, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the expression semantics rely on. ANSI mode is off because contract casts and rule
#: expressions turn bad values into NULL instead of failing the job.
SEMANTICS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "lakewarden", master: str | None = None, **settings: str) -> SparkSession:
    """Create (or fetch) a session with adaptive execution and the engine's semantic settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **SEMANTICS,
        **settings,
    }
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
