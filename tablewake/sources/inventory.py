"""Landed inventory: scans, and the mapping of job records to catalog jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import packed, text_field
from ..functions.names import job_id
from ..schemas import INVENTORY, JOB_ATTRIBUTES, JSON_COLUMNS

# Names inside a job's command and argument documents.
SCRIPT_LOCATION = "ScriptLocation"
PYTHON_VERSION = "PythonVersion"
EXTRA_FILES = "--extra-py-files"

def scan(spark: SparkSession, landing: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """One inventory table, ``<landing>/<kind>``, with its declared columns only."""
    return spark.read.schema(INVENTORY[kind]).format(fmt).load(f"{landing}/{kind}")


def scan_inventory(spark: SparkSession, landing: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    kinds = ("databases", "tables", "glue_jobs", "lambda_functions")
    return {kind: scan(spark, landing, kind, fmt) for kind in kinds}


def _column(df: DataFrame, name: str) -> Column:
    """A column of the record, or null when the landed file does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def glue_runtime() -> Column:
    return text_field(F.col("command"), PYTHON_VERSION)


def function_runtime() -> Column:
    return F.col("runtime")


# A mapping per job type: its runtime expression and its modification column. New job types
# are added by registering an entry here and a list of attribute columns.
JobMapping = tuple[Callable[[], Column], str]
JOB_MAPPINGS: dict[str, JobMapping] = {
    "glue": (glue_runtime, "last_modified_on"),
    "lambda": (function_runtime, "last_modified"),
}


def job_rows(records: DataFrame, job_type: str) -> DataFrame:
    """Catalog job rows of one record type."""
    runtime, modified = JOB_MAPPINGS[job_type]
    attributes = JOB_ATTRIBUTES[job_type]
    present = [c for c in attributes if c in records.columns]
    full = records.select(
        "*", *[F.lit(None).cast("string").alias(c) for c in attributes if c not in present]
    )
    kind = F.lit(job_type)
    return full.select(
        job_id(kind, F.col("name")).alias("id"), kind.alias("type"), "name",
        _column(records, "description").alias("description"), _column(records, "role").alias("role"),
        runtime().alias("runtime"), F.col(modified).alias("last_modified"),
        packed(attributes, JSON_COLUMNS).alias("attributes"),
    )


def normalized_jobs(glue_jobs: DataFrame, lambda_functions: DataFrame) -> DataFrame:
    return job_rows(glue_jobs, "glue").unionByName(job_rows(lambda_functions, "lambda"))


#: White space of any kind at the ends of a text.
OUTER_SPACE = r"^[\p{Z}\x09-\x0D\x1C-\x1F\x{85}]+|[\p{Z}\x09-\x0D\x1C-\x1F\x{85}]+$"


def script_uris(glue_jobs: DataFrame) -> DataFrame:
    """(name, position, uri): the script, then the extra files; blanks are dropped."""
    extras = F.split(F.coalesce(text_field(F.col("default_arguments"), EXTRA_FILES), F.lit("")), ",")
    uris = F.concat(F.array(text_field(F.col("command"), SCRIPT_LOCATION)), extras)
    cleaned = F.filter(F.transform(uris, lambda u: F.regexp_replace(u, OUTER_SPACE, "")), lambda u: F.coalesce(u != "", F.lit(False)))
    return glue_jobs.select("name", F.posexplode(cleaned).alias("position", "uri"))


def job_artifacts(glue_jobs: DataFrame, lambda_functions: DataFrame) -> DataFrame:
    """(job_id, reference, position): distinct uris of a job at their first position, or its arn."""
    scripts = script_uris(glue_jobs).groupBy("name", "uri").agg(F.min("position").alias("position"))
    rows = scripts.select(
        job_id(F.lit("glue"), F.col("name")).alias("job_id"), F.col("uri").alias("reference"), "position"
    )
    functions = lambda_functions.where("arn <> ''").select(
        job_id(F.lit("lambda"), F.col("name")).alias("job_id"), F.col("arn").alias("reference"),
        F.lit(0).alias("position"),
    )
    return rows.unionByName(functions)
