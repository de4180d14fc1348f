"""Rebuilding the catalog: inventory to snapshot, and extraction of changed jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import DEFAULT_IGNORED_JOBS, is_ignored_job
from ..operators import extraction as ex
from ..sources import inventory, snapshot
from ..sources.scratch import cut

# An edge source takes (stale jobs, pages of their prompts) and returns (job_id, name, extraction, valid), for a job any number of them.
EdgeSource = Callable[[DataFrame, DataFrame], DataFrame]


def by_extractor(extractor: ex.Extractor, partitions: int | None = None) -> EdgeSource:
    """An extractor of a prompt's pages, called in tasks, with one retry for invalid output."""

    def run(jobs: DataFrame, prompts: DataFrame) -> DataFrame:
        first = cut(ex.extract(prompts, extractor, partitions))
        second = cut(ex.extract(ex.retry_prompts(prompts, first), extractor, partitions))
        return first.where("valid").unionByName(second)

    return run


def by_fixture(fixtures: DataFrame | Callable[[DataFrame], DataFrame]) -> EdgeSource:
    """Canned extractions (name, extraction), or a function that gives those of jobs of given names (name).

    A job without one counts as invalid output, so it is rejected. Only the fixtures of the jobs asked for are kept, written
    once, since they are looked at for what is there and for what is missing.
    """

    def run(jobs: DataFrame, prompts: DataFrame) -> DataFrame:
        asked = cut(jobs.select(F.col("id"), "name"))
        names = asked.select("name").distinct()
        found = fixtures(names) if callable(fixtures) else fixtures
        own = cut(found.select("name", "extraction").join(names, "name", "left_semi"))
        return ex.fixture_extractions(asked, own).drop("reason")

    return run


def sync_edges(
    jobs: DataFrame,
    files: DataFrame,
    old: dict[str, DataFrame],
    edge_source: EdgeSource,
    model: str,
    prompt_version: str,
    ignored: str | None = DEFAULT_IGNORED_JOBS,
) -> dict[str, DataFrame]:
    """Extract the jobs whose sources changed and merge their edges into the old ones.

    ``old`` has job_extractions, job_table_edges and table_join_edges under current job ids.
    The outputs of a job are merged first, so it has one stored extraction. Returns those three, plus ``extracted`` (job_id of every re-extracted job) and
    ``rejected`` (jobs whose output stayed invalid; they keep their earlier rows).
    Ignored jobs and jobs without sources keep their earlier rows too.
    """
    eligible = jobs.where(~is_ignored_job(F.col("name"), ignored))
    keys = ex.cache_key(
        files.join(eligible.select(F.col("id").alias("job_id")), "job_id", "left_semi"),
        prompt_version, model,
    )
    stale = cut(ex.stale_jobs(keys, old["job_extractions"]))
    stale_ids = stale.select(F.col("job_id").alias("id"))
    stale_rows = eligible.join(stale_ids, "id", "left_semi")
    stale_files = files.join(stale.select("job_id"), "job_id", "left_semi")
    output = cut(ex.one_per_job(edge_source(stale_rows, ex.render_prompt(stale_rows, stale_files))))
    rejected = output.where("NOT valid").select("job_id")
    accepted = output.where("valid").select("job_id", "extraction")
    done = stale.join(accepted.select("job_id"), "job_id", "left_semi")

    edges = ex.table_edges(accepted)
    joins = ex.anchored(edges, ex.join_edges(accepted))
    stored = accepted.join(done, "job_id").select(
        "job_id", "cache_key", F.lit(model).alias("model"),
        F.lit(prompt_version).alias("prompt_version"), "extraction",
        F.current_timestamp().alias("extracted_at"),
    )
    return {
        "job_extractions": snapshot.upsert_by_job(old["job_extractions"], stored, done),
        "job_table_edges": snapshot.upsert_by_job(old["job_table_edges"], edges, done),
        "table_join_edges": snapshot.upsert_by_job(old["table_join_edges"], joins, done),
        "extracted": done.select("job_id"),
        "rejected": rejected,
    }


def rebuilt_tables(
    raw: dict[str, DataFrame],
    files: DataFrame,
    old: dict[str, DataFrame],
    edge_source: EdgeSource,
    model: str,
    prompt_version: str,
    ignored: str | None = DEFAULT_IGNORED_JOBS,
) -> dict[str, DataFrame]:
    """All seven catalog tables from a fresh inventory, plus ``extracted`` and ``rejected``.

    Earlier edges and extractions move to the new job ids; those of vanished jobs drop out.
    """
    jobs = inventory.normalized_jobs(raw["glue_jobs"], raw["lambda_functions"])
    carried = {
        name: ex.rehomed(old[name], old["jobs"], jobs)
        for name in ("job_extractions", "job_table_edges", "table_join_edges")
    }
    key = F.concat_ws("\u0000", "database_name", "name")
    return {
        "databases": raw["databases"].select(F.sha2("name", 256).alias("id"), "*"),
        "tables": raw["tables"].select(F.sha2(key, 256).alias("id"), "*"),
        "jobs": jobs,
        "job_artifacts": inventory.job_artifacts(raw["glue_jobs"], raw["lambda_functions"]).select(
            "job_id", "reference"
        ),
        **sync_edges(jobs, files, carried, edge_source, model, prompt_version, ignored),
    }


CATALOG_TABLES = (
    "databases", "tables", "jobs", "job_artifacts", "job_extractions", "job_table_edges",
    "table_join_edges",
)


def rebuild(
    spark: SparkSession,
    root: str,
    raw: dict[str, DataFrame],
    files: DataFrame,
    edge_source: EdgeSource,
    model: str,
    prompt_version: str,
    ignored: str | None = DEFAULT_IGNORED_JOBS,
) -> DataFrame:
    """Rebuild the snapshot under ``root``; returns the ids of the re-extracted jobs."""
    old = snapshot.read_snapshot(spark, root)
    tables = rebuilt_tables(raw, files, old, edge_source, model, prompt_version, ignored)
    extracted = cut(tables["extracted"])
    snapshot.write_snapshot(spark, root, {name: tables[name] for name in CATALOG_TABLES})
    return extracted

