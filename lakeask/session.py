"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; `extra` overrides them (dots written as two underscores)."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in extra.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def dialect_session(spark: SparkSession) -> SparkSession:
    """A child session for candidate SQL, with the caller's settings but quoted identifiers and casts that give null instead of an
    error; views and functions of the caller are not in it."""
    child = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and child.conf.isModifiable(name):
            child.conf.set(name, value)
    child.conf.set("spark.sql.ansi.enabled", "false")
    child.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "false")
    return child
