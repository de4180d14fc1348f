from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

EDGE = "job_id string, database_name string, table_name string, direction string, is_dynamic boolean, evidence string"
JOIN = """job_id string, left_database string, left_table string, left_column string,
    right_database string, right_table string, right_column string, evidence string"""
JOB = "id string, type string, name string, runtime string"
TABLE = "database_name string, name string, storage_descriptor string, partition_keys string"
FOCUS = "database_name string, table_name string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablewake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Make:
    """Tiny catalog tables from tuples."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def frame(self, rows, ddl: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), ddl)

    def edges(self, *rows) -> DataFrame:
        """(job, direction, database, table)"""
        return self.frame([(j, d, t, way, False, f"{way} {t}") for j, way, d, t in rows], EDGE)

    def joins(self, *rows) -> DataFrame:
        """(job, left database, left table, left column, right database, right table, right column)"""
        return self.frame([(*r, f"{r[2]} = {r[5]}") for r in rows], JOIN)

    def jobs(self, *rows) -> DataFrame:
        """(id, type, name)"""
        return self.frame([(*r, None) for r in rows], JOB)

    def tables(self, *rows) -> DataFrame:
        """(database, name) or (database, name, descriptor, partition keys)"""
        return self.frame([(*r, None, None)[:4] for r in rows], TABLE)

    def foci(self, *rows) -> DataFrame:
        return self.frame(rows, FOCUS)


@pytest.fixture(scope="session")
def make(spark) -> Make:
    return Make(spark)


@pytest.fixture(scope="session")
def rows():
    def collect(df: DataFrame, *columns: str) -> list[tuple]:
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
