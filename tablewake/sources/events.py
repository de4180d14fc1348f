"""Audit-trail scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import INVENTORY


def scan_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Events with the declared columns; name and time filters on it reach the files.

    Date folders below ``path`` become partition columns and prune as usual.
    """
    return spark.read.schema(INVENTORY["events"]).format(fmt).load(path)
