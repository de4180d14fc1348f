"""Display keys, labels and identity rules for tables and jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colour ramp has six steps, numbered from one.
ACCENT_STEPS = 6


def known_database(database: Column) -> Column:
    """An empty database name means the database is unknown."""
    return F.nullif(database, F.lit(""))


def table_key(database: Column, table: Column) -> Column:
    """``database.table``, or the bare table when the database is unknown."""
    return F.concat_ws(".", known_database(database), table)


def same_database(left: Column, right: Column) -> Column:
    """Databases are compatible when equal or when either is unknown.

    Only ever used as the residual of an equi join on the table name, so Spark
    hashes on the name and this runs as a filter inside the join.
    """
    return left.isNull() | right.isNull() | (left == right)


def job_label(job_type: Column, name: Column, job_id: Column) -> Column:
    """``type: name``; the id when the job has no catalog row."""
    return F.coalesce(F.concat(job_type, F.lit(": "), name), job_id)


def job_id(job_type: Column, name: Column) -> Column:
    """Id that stays the same over rebuilds because it is made from the natural key."""
    return F.sha2(F.concat_ws("\u0000", job_type, name), 256)


def accent(name: Column) -> Column:
    return (F.crc32(name.cast("binary")) % ACCENT_STEPS + 1).cast("int")


def s3_bucket(uri: Column) -> Column:
    """Bucket of an ``s3://bucket/key`` uri, null when the uri has no bucket or no key."""
    return F.nullif(F.regexp_extract(uri, r"(?s)^s3://([^/]+)/(.+)$", 1), F.lit(""))


def s3_key(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"(?s)^s3://([^/]+)/(.+)$", 2), F.lit(""))
