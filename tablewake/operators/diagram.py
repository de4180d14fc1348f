"""Join diagrams and lineage diagrams, for any number of focus tables at once.

Diagrams match tables by name only, unlike the dependents walk.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import table_key
from ..sources.scratch import Levels, cut, cut_clustered, cut_counted
from .catalog import join_edges_of_tables, partition_columns
from .closure import CLUSTERED_EDGES, EdgeSides, edge_sides
from .dependents import with_label
from .masks import WIDTH, bits, by_focus, named_foci, number_foci
from .spread import ITEMS_PER_PART, ROWS_PER_SALT, hot_keys, listed_text, matched, salted

# Bounds of the walk in each direction.
MIN_DEPTH, MAX_DEPTH, DEFAULT_DEPTH = 1, 4, 2

LEVEL = "block bigint, table_name string, mask bigint"


class Dag:
    """A lineage diagram: placed tables by layer and the jobs walked through.

    ``placed`` has (block, table_name, layer, mask); layer 0 is the focus, positive layers
    lie downstream and negative ones upstream. ``jobs`` has (block, job_id, mask).
    """

    def __init__(self, foci: DataFrame, placed: DataFrame, jobs: DataFrame, sides: EdgeSides, clustered: bool = False) -> None:
        self.foci = foci
        self.clustered = clustered
        self.placed = placed
        self.jobs = jobs
        self.sides = sides
        self._touched: DataFrame | None = None

    @property
    def touched(self) -> DataFrame:
        """Edges of the walked jobs on placed tables: (block, job_id, table_name, direction, database_name, mask). Written once."""
        if self._touched is None:
            columns = ["job_id", "table_name", "database_name"]
            reads = self.sides.reads.select(*columns, F.lit("read").alias("direction"))
            writes = self.sides.writes.select(*columns, F.lit("write").alias("direction"))
            on_jobs = self.jobs.join(reads.unionByName(writes), "job_id")
            placed = self.placed.groupBy("block", "table_name").agg(F.expr("bit_or(mask) AS placed"))
            rows = (
                on_jobs.join(placed, ["block", "table_name"])
                .selectExpr("block", "job_id", "table_name", "direction", "database_name", "mask & placed AS mask")
                .where("mask != 0")
            )
            # By table, as they come from the join and as databases and keys are joined to them.
            self._touched = cut_clustered(rows, ["block", "table_name"]) if self.clustered else cut(rows)
        return self._touched


class Sides:
    """Edges by table name only, each direction written once for a walk from its tables and once for one from its jobs.

    A key that is hot in one of the four is salted there. Large sides are stored clustered by the column that the walk comes
    from, so that a hop shuffles its level and the jobs it reaches but no edges.
    """

    def __init__(self, sides: EdgeSides, clustered: bool, rows_per_salt: int) -> None:
        self.clustered = clustered
        self.rows_per_salt = rows_per_salt
        # Clustered ones are made distinct where they are clustered; until then equal names only count as more rows.
        names = {way: rows.select("job_id", "table_name") for way, rows in (("read", sides.reads), ("write", sides.writes))}
        self.names = names if clustered else {way: cut(rows.distinct()) for way, rows in names.items()}
        counts = [
            rows.groupBy(F.col(key).alias("key")).count().select(F.lit(f"{way} {key}").alias("side"), "count")
            for way, rows in self.names.items()
            for key in ("job_id", "table_name")
        ]
        most = reduce(DataFrame.unionByName, counts).groupBy("side").agg(F.max("count").alias("most"))
        self.hot = {r.side for r in most.where(F.col("most") > rows_per_salt).collect()}
        self.known: dict[str, tuple[DataFrame, DataFrame | None]] = {}

    def joined(self, light: DataFrame, way: str, key: str) -> DataFrame:
        """The light rows joined to one direction on ``key``."""
        name = f"{way} {key}"
        if name not in self.known:
            rows, hot = self.names[way], None
            if name in self.hot:
                hot = cut(hot_keys(rows, key, self.rows_per_salt))
                rows = salted(rows, key, hot, ["job_id", "table_name"])
                rows = rows if self.clustered else cut(rows)
            if self.clustered:
                keys = [key, *["salt"] * (hot is not None)]
                n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                rows = cut_clustered(rows.repartition(n, *keys).distinct(), keys)
            self.known[name] = rows, hot
        rows, hot = self.known[name]
        return light.join(rows, key) if hot is None else matched(light, key, hot).join(rows, [key, "salt"])


def _minus(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Clear the bits of ``rows`` that ``seen`` has; rows left without bits are dropped."""
    old = seen.groupBy(*keys).agg(F.expr("bit_or(mask) AS seen"))
    return (
        rows.join(old, keys, "left")
        .selectExpr(*keys, "mask & ~coalesce(seen, 0L) AS mask")
        .where("mask != 0")
    )


def lineage_dag(
    edges: DataFrame | EdgeSides, foci: DataFrame, depth: int = DEFAULT_DEPTH,
    clustered_edges: int = CLUSTERED_EDGES, rows_per_salt: int = ROWS_PER_SALT,
) -> Dag:
    """Walk down, then up, up to ``depth`` jobs each way (clamped to 1..4).

    Jobs and tables of the down walk are not available to the up walk.
    """
    depth = max(MIN_DEPTH, min(depth, MAX_DEPTH))
    sides = edges if isinstance(edges, EdgeSides) else edge_sides(edges)
    names = Sides(sides, sides.n_edges >= clustered_edges, rows_per_salt)
    numbered = number_foci(foci)
    levels = Levels(numbered.sparkSession, LEVEL)
    levels.add(numbered.select("block", "table_name", "mask"), 0)
    merged = F.expr("bit_or(mask) AS mask")

    def touching(level: DataFrame, way: str) -> DataFrame:
        return names.joined(level.drop("hop"), way, "table_name").groupBy("block", "job_id").agg(merged)

    def walk(inbound: str, outbound: str, blocked_jobs: DataFrame | None, sign: int) -> DataFrame:
        reached = [0]
        for hop in range(1, depth + 1):
            jobs = touching(levels.read(reached[-1]), inbound)
            if blocked_jobs is not None:
                jobs = _minus(jobs, blocked_jobs, ["block", "job_id"])
            out = names.joined(jobs, outbound, "job_id").groupBy("block", "table_name").agg(merged)
            reached.append(sign * hop)
            if levels.add(_minus(out, levels.read(), ["block", "table_name"]), sign * hop) == 0:
                break
        return touching(levels.read(*reached[:-1]), inbound)

    down_jobs = cut(walk("read", "write", None, 1))
    up_jobs = _minus(walk("write", "read", down_jobs, -1), down_jobs, ["block", "job_id"])
    placed = levels.read().withColumnRenamed("hop", "layer")
    return Dag(numbered, placed, cut(down_jobs.unionByName(up_jobs)), sides, names.clustered)


def dag_tables(dag: Dag) -> DataFrame:
    """(focus_database, focus_table, layer, table_name)."""
    return named_foci(by_focus(dag.placed.select("block", "table_name", "layer", "mask")), dag.foci)


def database_masks(dag: Dag, tables: DataFrame) -> DataFrame:
    """(block, table_name, layer, database_name, mask): the focus's own database, else from edges, else from the catalog.

    Where edges or the catalog name several databases, the smallest one is taken. A focus's bit is in one row of each table.
    """
    by_table = ["block", "table_name"]
    on_edges = dag.touched.where("database_name <> ''").groupBy(*by_table, "database_name").agg(F.expr("bit_or(mask) AS mask"))
    # A focus's bit stays with the first row of the table that has it; what neither foci nor edges name is the catalog's.
    named = (
        dag.foci.selectExpr(*by_table, "0 AS turn", "if(table_name IS NULL, NULL, database_name) AS database_name", "mask")
        .unionByName(on_edges.selectExpr(*by_table, "1 AS turn", "database_name", "mask"))
        .unionByName(dag.placed.selectExpr(*by_table, "2 AS turn", "CAST(NULL AS STRING) AS database_name", "mask"))
    )
    first = named.selectExpr(
        *by_table, "turn", "database_name",
        """mask & ~coalesce(bit_or(mask) OVER (PARTITION BY block, table_name ORDER BY turn, database_name
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS mask""",
    ).where("mask != 0")
    from_catalog = tables.groupBy(F.col("name").alias("table_name")).agg(
        F.min("database_name").alias("catalog_database")
    )
    known = first.join(from_catalog, "table_name", "left").selectExpr(
        "block AS its_block", "table_name AS its_table", "if(turn = 2, catalog_database, database_name) AS database_name",
        "mask AS its_mask",
    )
    at = F.expr("block = its_block AND table_name <=> its_table")
    return (
        dag.placed.select(*by_table, "layer", "mask").join(known, at)
        .selectExpr(*by_table, "layer", "database_name", "mask & its_mask AS mask")
        .where("mask != 0")
    )


def diagram_databases(dag: Dag, tables: DataFrame) -> DataFrame:
    """(focus, table_name, layer, database_name), see :func:`database_masks`."""
    return by_focus(database_masks(dag, tables))


# Reads of one job that one task pairs with the job's writes.
READS_PER_SALT = 1_000


def _paired(source: DataFrame, target: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Reads joined to writes of the same job; jobs with very many reads are spread by salt.

    The number of pairs grows faster than the rows that go in, so a job is spread long
    before its rows alone would make a partition large.
    """
    spread = salted(source, "job_id", hot, ["source"])
    pairs = spread.join(matched(target, "job_id", hot), [*keys, "salt"]).drop("salt")
    return pairs.where("source <> target")


def job_flows(edges: DataFrame, reads_per_salt: int = READS_PER_SALT) -> DataFrame:
    """(job_id, source, target) for every table a job reads and every other table it writes.

    This product is the result itself; both sides are distinct before they meet.
    """
    pairs = edges.select("job_id", "table_name", "direction").distinct()
    source = pairs.where("direction = 'read'").selectExpr("job_id", "table_name AS source")
    target = pairs.where("direction = 'write'").selectExpr("job_id", "table_name AS target")
    return _paired(source, target, ["job_id"], hot_keys(source, "job_id", reads_per_salt))


def dag_arrow_jobs(dag: Dag, jobs: DataFrame, tables: DataFrame, reads_per_salt: int = READS_PER_SALT) -> DataFrame:
    """(block, source_key, target_key, label, mask): arrows between placed tables, by job label.

    Keys and labels are joined to the ends before they are paired, so pairs move once, to their arrow.
    """
    keys = database_masks(dag, tables).select(
        "block", "table_name", table_key(F.col("database_name"), F.col("table_name")).alias("key"), F.col("mask").alias("key_mask")
    )
    merged = dag.touched.groupBy("block", "job_id", "table_name", "direction").agg(
        F.expr("bit_or(mask) AS mask")
    )
    ends = merged.join(keys, ["block", "table_name"]).withColumn("mask", F.expr("mask & key_mask")).where("mask != 0")
    source = ends.where("direction = 'read'").selectExpr(
        "block", "job_id", "table_name AS source", "key AS source_key", "mask AS source_mask"
    )
    target = ends.where("direction = 'write'").selectExpr(
        "block", "job_id", "table_name AS target", "key AS target_key", "mask AS target_mask"
    )
    target = with_label(target, jobs)
    # Counted on the edges, so a job has at least as many salts as its reads need; mostly there are no such jobs.
    hot, n_hot = cut_counted(hot_keys(dag.touched.where("direction = 'read'"), "job_id", reads_per_salt))
    at = ["block", "job_id"]
    pairs = _paired(source, target, at, hot) if n_hot else source.join(target, at).where("source <> target")
    arrows = pairs.selectExpr("block", "source_key", "target_key", "label", "source_mask & target_mask AS mask").where("mask != 0")
    n = int(arrows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = arrows.repartition(n, *ARROW)
    merged = spread.groupBy(*ARROW, "label").agg(F.expr("bit_or(mask) AS mask"))
    return cut_clustered(merged, ARROW) if dag.clustered else cut(merged)


ARROW = ["block", "source_key", "target_key"]


def dag_arrows(dag: Dag, jobs: DataFrame, tables: DataFrame, page: int = ITEMS_PER_PART) -> DataFrame:
    """(focus_database, focus_table, source_key, target_key, part, jobs).

    A block's arrow that has no more labels than a page has none that needs pages; its lists are made where its labels lie.
    """
    arrows = dag_arrow_jobs(dag, jobs, tables)
    longest = arrows.groupBy(*ARROW).count().agg(F.max("count")).first()[0] or 0
    if longest > page:
        lists = listed_text(by_focus(arrows), ["focus", "source_key", "target_key"], "label", "jobs", page=page)
    else:
        by_arrow = bits(arrows).groupBy(*ARROW, "bit").agg(F.array_sort(F.collect_list("label")).alias("labels"))
        lists = by_arrow.select(
            (F.col("block") * WIDTH + F.col("bit")).alias("focus"), "source_key", "target_key", F.lit(0).alias("part"),
            F.array_join("labels", ", ").alias("jobs"),
        )
    return named_foci(lists, dag.foci)


@dataclass(frozen=True)
class FocusEdges:
    """Join edges of each focus, written once for all parts of a diagram: (focus_database, focus_table, edge columns)."""

    edges: DataFrame


def focus_edges(foci: DataFrame, join_edges: DataFrame | FocusEdges) -> FocusEdges:
    if isinstance(join_edges, FocusEdges):
        return join_edges
    focus = foci.selectExpr("database_name AS focus_database", "table_name AS focus_name").distinct()
    own = focus.join(join_edges_of_tables(join_edges, foci), F.expr("focus_name = focus_table"))
    return FocusEdges(cut(own.drop("focus_name")))


def _edge_ends(focus_edges: DataFrame) -> DataFrame:
    """Both ends of each edge: (focus_database, focus_table, table_name, database_name, column_name)."""
    return focus_edges.selectExpr(
        "focus_database", "focus_table",
        """inline(array(
             named_struct('table_name', left_table, 'database_name', left_database, 'column_name', left_column),
             named_struct('table_name', right_table, 'database_name', right_database, 'column_name', right_column)))""",
    )


def erd_databases(foci: DataFrame, join_edges: DataFrame | FocusEdges, tables: DataFrame) -> DataFrame:
    """(focus_database, focus_table, table_name, database_name, catalog_database) of diagram tables."""
    ends = _edge_ends(focus_edges(foci, join_edges).edges).groupBy(
        "focus_database", "focus_table", "table_name"
    ).agg(F.expr("min(nullif(database_name, '')) AS edge_database"))
    own = foci.selectExpr(
        "database_name AS focus_database", "table_name AS focus_table", "table_name",
        "CAST(NULL AS STRING) AS edge_database",
    )
    everything = ends.where("table_name <> focus_table").unionByName(own.distinct())
    from_catalog = tables.groupBy(F.col("name").alias("table_name")).agg(
        F.min("database_name").alias("catalog_database")
    )
    return everything.join(from_catalog, "table_name", "left").selectExpr(
        "focus_database", "focus_table", "table_name",
        """if(table_name = focus_table, focus_database,
              coalesce(edge_database, catalog_database)) AS database_name""",
        "if(table_name = focus_table, focus_database, catalog_database) AS catalog_database",
    )


def erd_rows(foci: DataFrame, join_edges: DataFrame | FocusEdges, tables: DataFrame) -> DataFrame:
    """Column rows of the join diagram's cards: partition keys first, then join columns.

    (focus_database, focus_table, table_name, is_partition, position, column_name). Partition
    keys are in declared position; join columns are in name order and have position null.
    """
    own = focus_edges(foci, join_edges)
    cards = cut(erd_databases(foci, own, tables))
    keys = partition_columns(tables).selectExpr(
        "database_name AS key_database", "table_name AS key_table", "position", "column_name"
    )
    partitions = cards.join(
        keys, F.expr("table_name = key_table AND catalog_database = key_database")
    ).select(
        "focus_database", "focus_table", "table_name", F.lit(True).alias("is_partition"),
        "position", "column_name",
    )
    columns = _edge_ends(own.edges).select(
        "focus_database", "focus_table", "table_name", "column_name"
    ).distinct()
    taken = partitions.selectExpr(
        "focus_database AS d", "focus_table AS f", "table_name AS t", "column_name AS c"
    )
    joined = columns.join(
        taken,
        F.expr("focus_table = f AND table_name = t AND column_name = c AND focus_database <=> d"),
        "left_anti",
    ).selectExpr(
        "focus_database", "focus_table", "table_name", "false AS is_partition",
        "CAST(NULL AS INT) AS position", "column_name",
    )
    return partitions.unionByName(joined)


def erd_join_columns(foci: DataFrame, join_edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Join columns per card, minus partition keys, as sorted text."""
    rows = erd_rows(foci, join_edges, tables).where("NOT is_partition")
    return listed_text(rows, ["focus_database", "focus_table", "table_name"], "column_name", "columns")


def erd_arrows(
    foci: DataFrame, join_edges: DataFrame | FocusEdges, jobs: DataFrame, tables: DataFrame
) -> DataFrame:
    """Arrows between columns: (focus_database, focus_table, left_key, left_column, right_key, right_column, part, jobs)."""
    own = focus_edges(foci, join_edges)
    keys = erd_databases(foci, own, tables).select(
        "focus_database", "focus_table", "table_name",
        table_key(F.col("database_name"), F.col("table_name")).alias("key"),
    )
    edges = with_label(own.edges, jobs)
    for side in ("left", "right"):
        renamed = keys.selectExpr(
            "focus_database AS d", "focus_table AS f", "table_name AS t", f"key AS {side}_key"
        )
        edges = edges.join(
            renamed, F.expr(f"focus_table = f AND {side}_table = t AND focus_database <=> d")
        ).drop("d", "f", "t")
    return listed_text(
        edges,
        ["focus_database", "focus_table", "left_key", "left_column", "right_key", "right_column"],
        "label", "jobs",
    )
