"""All queries of the library by name, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import profile, reference, sites


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**reference.QUERIES, **profile.QUERIES, **sites.QUERIES}


def oracles() -> dict[str, str]:
    return {**reference.ORACLES, **profile.ORACLES, **sites.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring content themes of every site."""
    return reference.content_themes(spark, sf_dir)
