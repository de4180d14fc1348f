"""What depends on a table: the downstream walk over read and write edges.

Tables match on (database, name); an unknown (null) database matches any database of that
name. That match is not transitive, so it can never be a grouping key: every match here is
an equi join on the name with the database rule as a residual.

Order inside one hop: when a hop reaches both ``(null, t)`` and some ``(x, t)``, the
concrete key is placed and the null key is dropped. A key that matches anything placed by an
earlier hop is dropped as well.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Levels, cut, cut_clustered, cut_counted
from .masks import by_focus, number_foci
from .spread import ROWS_PER_SALT, hot_keys, matched, salted


#: Edges from which on their sides are stored clustered; below, a level is joined by broadcasting whichever side is small.
CLUSTERED_EDGES = 5_000_000


@dataclass(frozen=True)
class EdgeSides:
    """Distinct read and write edges, salted where a join key is hot."""

    reads: DataFrame
    writes: DataFrame
    hot_tables: DataFrame | None
    hot_jobs: DataFrame | None
    n_edges: int = 0


@dataclass(frozen=True)
class Walk:
    """Result of a walk: numbered foci and the tables placed at each hop (0 = the focus)."""

    foci: DataFrame
    placed: DataFrame
    sides: EdgeSides


def edge_sides(edges: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> EdgeSides:
    """Write the two edge sets once, so that every hop scans only what it joins."""
    distinct, n_edges = cut_counted(
        edges.where("direction IN ('read', 'write')")
        .select("job_id", "database_name", "table_name", "direction")
        .distinct(),
        partition_by="direction",
    )
    reads = distinct.where("direction = 'read'").drop("direction")
    writes = distinct.where("direction = 'write'").drop("direction")
    table_rows, job_rows = _largest_groups(reads, writes)
    reads, hot_tables = _salt_side(reads, "table_name", "job_id", rows_per_salt, table_rows)
    writes, hot_jobs = _salt_side(writes, "job_id", "table_name", rows_per_salt, job_rows)
    return EdgeSides(reads, writes, hot_tables, hot_jobs, n_edges)


def _largest_groups(reads: DataFrame, writes: DataFrame) -> tuple[int, int]:
    """Rows of the hottest join key on each side; decides whether salts are needed at all."""
    sizes = reads.groupBy("table_name").count().selectExpr("count AS reads", "0 AS writes").unionByName(
        writes.groupBy("job_id").count().selectExpr("0 AS reads", "count AS writes")
    )
    row = sizes.selectExpr("max(reads)", "max(writes)").first()
    return row[0] or 0, row[1] or 0


def _salt_side(
    side: DataFrame, key: str, by: str, rows_per_salt: int, largest: int
) -> tuple[DataFrame, DataFrame | None]:
    if largest <= rows_per_salt:
        return side, None
    hot = cut(hot_keys(side, key, rows_per_salt))
    return cut(salted(side, key, hot, [by])), hot


def clustered(sides: EdgeSides) -> EdgeSides:
    """The same sides stored so that a hop shuffles its level and the jobs it reaches but no edges."""
    by_table = ["table_name", *["salt"] * (sides.hot_tables is not None)]
    by_job = ["job_id", *["salt"] * (sides.hot_jobs is not None)]
    return replace(sides, reads=cut_clustered(sides.reads, by_table), writes=cut_clustered(sides.writes, by_job))


def _on_hot_key(
    light: DataFrame, key: str, hot: DataFrame | None
) -> tuple[DataFrame, list[str]]:
    if hot is None:
        return light, [key]
    return matched(light, key, hot), [key, "salt"]


def readers(placed: DataFrame, sides: EdgeSides) -> DataFrame:
    """Jobs reading any of the placed tables: (block, job_id, hop, mask), hop as placed."""
    return _reading(placed, sides).groupBy("block", "job_id", "hop").agg(F.expr("bit_or(mask) AS mask"))


def _reading(placed: DataFrame, sides: EdgeSides) -> DataFrame:
    """The placed tables, a row for each read edge that can mean them."""
    light, keys = _on_hot_key(placed, "table_name", sides.hot_tables)
    reads = sides.reads.withColumnRenamed("database_name", "read_database")
    return light.join(reads, keys).where(
        "database_name IS NULL OR read_database IS NULL OR database_name = read_database"
    )


def _written(jobs: DataFrame, sides: EdgeSides) -> DataFrame:
    """Tables written by the jobs, one row per write edge: (block, database_name, table_name, mask)."""
    light, keys = _on_hot_key(jobs, "job_id", sides.hot_jobs)
    return light.join(sides.writes, keys)


def _not_placed(candidates: DataFrame, placed: DataFrame) -> DataFrame:
    """Candidates minus everything that already matches a placed table, per focus bit.

    Masks are merged per table key first and per table name second, both with partial sums
    before the shuffle, so a name that exists in very many databases stays cheap.
    """
    both = placed.selectExpr(
        "block", "database_name", "table_name", "mask AS old", "0L AS new"
    ).unionByName(
        candidates.selectExpr("block", "database_name", "table_name", "0L AS old", "mask AS new")
    )
    keys = both.groupBy("block", "database_name", "table_name").agg(
        F.expr("bit_or(old) AS old"), F.expr("bit_or(new) AS new")
    )
    names = keys.groupBy("block", "table_name").agg(
        F.expr("bit_or(old) AS old_any"),
        F.expr("bit_or(if(database_name IS NULL, old, 0L)) AS old_unknown"),
        F.expr("bit_or(if(database_name IS NULL, 0L, new & ~old)) AS new_known"),
    )
    return (
        keys.where("new != 0")
        .join(names, ["block", "table_name"])
        .selectExpr(
            "block",
            "database_name",
            "table_name",
            "new & ~if(database_name IS NULL, old_any | new_known, old | old_unknown) AS mask",
        )
        .where("mask != 0")
    )


LEVEL = "block bigint, database_name string, table_name string, mask bigint"


def walk(
    edges: DataFrame | EdgeSides, foci: DataFrame, max_hops: int | None = None, clustered_edges: int = CLUSTERED_EDGES
) -> Walk:
    """Place every table downstream of the foci, with the hop at which it is reached.

    One written table per hop and one stop test, the row count seen by that write.
    Jobs reached again in a later hop are not tracked: all they write is placed already, so
    they add nothing; :func:`job_visits` derives each job's first hop afterwards.
    """
    sides = edges if isinstance(edges, EdgeSides) else edge_sides(edges)
    if sides.n_edges >= clustered_edges:
        sides = clustered(sides)
    numbered = number_foci(foci)
    levels = Levels(numbered.sparkSession, LEVEL)
    size = levels.add(numbered.select("block", "database_name", "table_name", "mask"), 0)
    hop = 0
    while size and (max_hops is None or hop < max_hops):
        jobs = readers(levels.read(hop), sides).drop("hop")
        found = _not_placed(_written(jobs, sides), levels.read())
        hop += 1
        size = levels.add(found, hop)
    return Walk(numbered, levels.read(), sides)


def job_visits(result: Walk) -> DataFrame:
    """First visit of each job: (block, job_id, hop, mask).

    A job's hop is one more than that of the first placed table it reads. The window holds
    at most one row per hop for a (block, job).
    """
    return (
        readers(result.placed, result.sides)
        .selectExpr(
            "block",
            "job_id",
            "hop + 1 AS hop",
            """mask & ~coalesce(bit_or(mask) OVER (PARTITION BY block, job_id ORDER BY hop
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS mask""",
        )
        .where("mask != 0")
    )


def job_masks(result: Walk, referring: DataFrame) -> DataFrame:
    """One row per job of a block: (block, job_id, direct, reached, referring).

    ``direct`` has the foci that the job reads, ``reached`` these and those it is reached from in a later hop, ``referring``
    the masks of the given (block, job_id, mask) rows. Where the hop itself is not asked for, this is less than :func:`job_visits`.
    """
    hits = _reading(result.placed, result.sides).selectExpr(
        "block", "job_id", "if(hop = 0, mask, 0L) AS direct", "mask AS reached", "0L AS referring"
    )
    refs = referring.selectExpr("block", "job_id", "0L AS direct", "0L AS reached", "mask AS referring")
    return hits.unionByName(refs).groupBy("block", "job_id").agg(
        *[F.bit_or(c).alias(c) for c in ("direct", "reached", "referring")]
    )


def placed_tables(result: Walk) -> DataFrame:
    """(focus, hop, database_name, table_name) of every table the walk reached."""
    return by_focus(result.placed.where("hop > 0"))


def visited_jobs(result: Walk) -> DataFrame:
    """(focus, hop, job_id) of every job the walk reached."""
    return by_focus(job_visits(result))
