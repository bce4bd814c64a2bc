"""Every registered query of the library, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import ink, oracle, oracle_ink, oracle_readings, oracle_scans, oracle_texts, readings, scans, texts
from .plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.proportional_report(spark, sf_dir)


def queries() -> dict:
    return {**plans.queries(), **texts.queries(), **readings.queries(), **ink.queries(), **scans.queries()}


def oracle_sql() -> dict[str, str]:
    return {**oracle.oracle_sql(), **oracle_texts.oracle_sql(), **oracle_readings.oracle_sql(), **oracle_ink.oracle_sql(), **oracle_scans.oracle_sql()}
