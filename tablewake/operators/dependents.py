"""Dependents of tables, for any number of focus tables at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import job_label, known_database, same_database, table_key
from ..sources.scratch import cut, cut_counted
from .closure import Walk, job_masks, job_visits, readers, walk
from .masks import count_bits, named
from .spread import ROWS_PER_SALT, hot_keys, matched, salted


def clean_foci(foci: DataFrame) -> DataFrame:
    """Distinct (database_name, table_name); an empty database means unknown."""
    return foci.select(
        known_database(F.col("database_name")).alias("database_name"), "table_name"
    ).distinct()


def matching_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose (database_name, table_name) can name the same table."""
    other = right.select(
        F.col("database_name").alias("right_database"), F.col("table_name").alias("right_table")
    )
    return (
        left.withColumnRenamed("database_name", "left_database")
        .withColumnRenamed("table_name", "left_table")
        .join(other, F.col("left_table") == F.col("right_table"))
        .where(same_database(F.col("left_database"), F.col("right_database")))
    )


def with_label(df: DataFrame, jobs: DataFrame, job_column: str = "job_id") -> DataFrame:
    """Attach ``label``, falling back to the id for jobs without a catalog row."""
    known = jobs.select(
        F.col("id").alias("known_id"), F.col("type").alias("known_type"),
        F.col("name").alias("known_name"),
    )
    label = job_label(F.col("known_type"), F.col("known_name"), F.col(job_column))
    return df.join(known, F.col(job_column) == F.col("known_id"), "left").select(
        *df.columns, label.alias("label")
    )


def single_databases(tables: DataFrame) -> DataFrame:
    """Table names that the catalog knows in exactly one database: (known_table, known_db)."""
    no_database = F.max(F.col("database_name").isNull().cast("int"))
    return (
        tables.groupBy(F.col("name").alias("known_table"))
        .agg(
            F.count_distinct("database_name").alias("n"),
            no_database.alias("n_unknown"),
            F.min("database_name").alias("known_database"),
        )
        .where("n + n_unknown = 1")
        .select("known_table", "known_database")
    )


def backfilled(df: DataFrame, tables: DataFrame, focus_table: str = "focus_table") -> DataFrame:
    """Fill a null ``database_name`` from the catalog when only one database has the name.

    The focus's own name is left alone.
    """
    return filled(with_known(df, tables), focus_table)


def with_known(df: DataFrame, tables: DataFrame) -> DataFrame:
    """Add ``known_database``: the only database in which the catalog has the name."""
    known = single_databases(tables)
    joined = df.join(known, F.col("table_name") == F.col("known_table"), "left")
    return joined.select(*df.columns, "known_database")


def filled(df: DataFrame, focus_table: str = "focus_table") -> DataFrame:
    """Fill a null ``database_name`` with ``known_database``, but for the focus's own name."""
    usable = F.col("database_name").isNull() & (F.col("table_name") != F.col(focus_table))
    database = F.coalesce("database_name", F.when(usable, F.col("known_database")))
    rest = [c for c in df.columns if c not in ("database_name", "known_database")]
    return df.select(*rest, database.alias("database_name"))


def edge_ends(join_edges: DataFrame) -> DataFrame:
    """Both ends of each join edge, a row each: ``table_name`` and ``end_database``, the rest of the edge, and the other end."""
    end = """named_struct('table_name', {a}_table, 'end_database', {a}_database, 'other_database', {b}_database,
                          'other_table', {b}_table)"""
    return join_edges.selectExpr(
        "job_id", "evidence", f"inline(array({end.format(a='left', b='right')}, {end.format(a='right', b='left')}))"
    )


def focus_ends(
    join_edges: DataFrame, foci: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> tuple[DataFrame, DataFrame | None]:
    """Ends of join edges that bear the name of a focus, written once, and the names that hold very many of them."""
    names = foci.select("table_name").distinct()
    ends, n = cut_counted(edge_ends(join_edges).join(names, "table_name", "left_semi"))
    return ends, cut(hot_keys(ends, "table_name", rows_per_salt)) if n > rows_per_salt else None


def matched_ends(ends: DataFrame, hot: DataFrame | None, targets: DataFrame) -> DataFrame:
    """Ends of join edges with the foci they touch on exactly one side, a row for each pair.

    ``targets`` are (focus_database, table_name) and any further columns; the pairs have these and those of the ends. An edge
    whose two sides both match the focus is a self join and is left out. Hot names are spread by salts.
    """
    keys = ["table_name"]
    if hot is not None:
        ends, targets = salted(ends, "table_name", hot, ["job_id", "evidence"]), matched(targets, "table_name", hot)
        keys = ["table_name", "salt"]
    here = same_database(F.col("end_database"), F.col("focus_database"))
    there = (F.col("other_table") == F.col("table_name")) & same_database(F.col("other_database"), F.col("focus_database"))
    return ends.join(targets, keys).where(here & ~there)


def join_refs(join_edges: DataFrame, foci: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Join edges that touch a focus on exactly one side, with the other side as partner.

    A self join is left out, so the two ends of an edge never give it twice. The edges are read once; only ends of focus names
    are kept.
    """
    targets = clean_foci(foci).select(F.col("database_name").alias("focus_database"), "table_name")
    return matched_ends(*focus_ends(join_edges, targets, rows_per_salt), targets).select(
        "focus_database", F.col("table_name").alias("focus_table"), "job_id",
        F.col("other_database").alias("database_name"), F.col("other_table").alias("table_name"), "evidence",
    )


def direct_readers(edges: DataFrame, foci: DataFrame) -> DataFrame:
    """Distinct (focus_database, focus_table, job_id) of jobs reading a focus."""
    reads = edges.where(F.col("direction") == "read").select(
        "job_id", "database_name", "table_name"
    )
    pairs = matching_tables(clean_foci(foci), reads.distinct().drop("job_id").distinct())
    keys = pairs.select(
        "left_database", "left_table", F.col("right_database").alias("database_name")
    ).distinct()
    hits = keys.join(
        reads,
        (keys["left_table"] == reads["table_name"])
        & keys["database_name"].eqNullSafe(reads["database_name"]),
    )
    return hits.select(
        F.col("left_database").alias("focus_database"),
        F.col("left_table").alias("focus_table"),
        "job_id",
    ).distinct()


def with_dependents_flag(
    foci: DataFrame, edges: DataFrame, join_edges: DataFrame
) -> DataFrame:
    """``foci`` (database_name, table_name) with ``has_dependents``.

    A table has dependents when some job reads it or some join names it; the closure is not
    needed. Only distinct table keys are compared, never one row per reading job.
    """
    keys = clean_foci(foci)
    read_keys = (
        edges.where(F.col("direction") == "read").select("database_name", "table_name").distinct()
    )
    read = matching_tables(keys, read_keys).select(
        F.col("left_database").alias("hit_database"), F.col("left_table").alias("hit_table")
    )
    sides = join_edges.select(
        "left_database", "left_table", "right_database", "right_table"
    ).distinct()
    joined = join_refs(
        sides.withColumn("job_id", F.lit("")).withColumn("evidence", F.lit("")), keys
    ).select(
        F.col("focus_database").alias("hit_database"), F.col("focus_table").alias("hit_table")
    )
    hits = read.unionByName(joined).distinct().withColumn("hit", F.lit(True))
    return keys.join(
        hits,
        (keys["table_name"] == hits["hit_table"])
        & keys["database_name"].eqNullSafe(hits["hit_database"]),
        "left",
    ).select("database_name", "table_name", F.col("hit").isNotNull().alias("has_dependents"))


def delete_verdicts(foci: DataFrame, edges: DataFrame, join_edges: DataFrame) -> DataFrame:
    """Whether each table is safe to delete."""
    return with_dependents_flag(foci, edges, join_edges).withColumn("safe", ~F.col("has_dependents"))


def dependents(edges: DataFrame, foci: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Closure as rows (focus_database, focus_table, kind, hop, database_name, node).

    ``kind`` is 'job' or 'table'; ``node`` is the job id or the table name.
    """
    return closure_rows(walk(edges, foci, max_hops))


def closure_rows(result: Walk) -> DataFrame:
    tables = result.placed.where("hop > 0").select(
        "block", "mask", F.lit("table").alias("kind"), "hop", "database_name",
        F.col("table_name").alias("node"),
    )
    jobs = job_visits(result).select(
        "block", "mask", F.lit("job").alias("kind"), "hop",
        F.lit(None).cast("string").alias("database_name"), F.col("job_id").alias("node"),
    )
    return named(tables.unionByName(jobs), result.foci)


def lineage_layers(result: Walk, tables: DataFrame) -> DataFrame:
    """Tables written at each hop as (focus, layer, raw key, display key) rows.

    Inside a layer the order is that of the raw key: ``sort_database`` (unknown first), then
    ``table_name``. One row per table keeps layers of any size distributed.
    """
    placed = result.placed.where("hop > 0").withColumn("sort_database", F.coalesce("database_name", F.lit("")))
    shown = filled(named(with_known(placed, tables), result.foci))
    return shown.select(
        "focus_database", "focus_table", F.col("hop").alias("layer"), "sort_database",
        "table_name", table_key(F.col("database_name"), F.col("table_name")).alias("table_key"),
    )


def blast_radius(result: Walk, join_edges: DataFrame) -> DataFrame:
    """Per focus: distinct jobs broken (reading, transitive or joining) and tables orphaned.

    Counted on the bit masks, so the (focus, node) pairs never exist as rows.
    """
    tables = count_bits(result.placed.where("hop > 0"), "tables_orphaned")
    refs = join_refs(join_edges, result.foci)
    foci = result.foci
    bits = foci.selectExpr("block", "mask", "database_name AS bit_database", "table_name AS bit_table")
    joining = refs.join(
        bits, F.expr("focus_table = bit_table AND focus_database <=> bit_database")
    ).select("block", "job_id", "mask")
    # Which hop a job is reached in doesn't matter here.
    visits = readers(result.placed.withColumn("hop", F.lit(0)), result.sides).select("block", "job_id", "mask")
    merged = visits.unionByName(joining).groupBy("block", "job_id").agg(
        F.bit_or("mask").alias("mask")
    )
    jobs = count_bits(merged, "jobs_broken")
    zero = F.lit(0).cast("bigint")
    return (
        foci.join(jobs, "focus", "left")
        .join(tables, "focus", "left")
        .select(
            F.col("database_name").alias("focus_database"),
            F.col("table_name").alias("focus_table"),
            F.coalesce("jobs_broken", zero).alias("jobs_broken"),
            F.coalesce("tables_orphaned", zero).alias("tables_orphaned"),
        )
    )


def in_catalog(foci: DataFrame, tables: DataFrame) -> DataFrame:
    """Whether each focus is a table of the catalog; an unknown database never is."""
    keys = clean_foci(foci)
    known = tables.select(
        F.col("database_name").alias("known_database"), F.col("name").alias("known_table"),
        F.lit(True).alias("known"),
    ).distinct()
    return keys.join(
        known,
        (keys["database_name"] == known["known_database"])
        & (keys["table_name"] == known["known_table"]),
        "left",
    ).select("database_name", "table_name", F.col("known").isNotNull().alias("in_catalog"))


# The sections of a dependents report, in their order.
SECTIONS = (
    "direct_jobs",
    "direct_tables",
    "join_refs",
    "transitive_jobs",
    "transitive_tables",
)


@dataclass(frozen=True)
class Entries:
    """What the dependents reports of many foci are made of, before there is a row per focus of a job or table.

    ``placed`` (block, mask, hop, database_name, table_name, known_database) is by mask; ``refs`` has a row for each focus and
    join edge. ``more`` columns of the foci are in ``refs`` too.
    """

    walk: Walk
    foci: DataFrame
    placed: DataFrame
    refs: DataFrame
    jobs: DataFrame
    more: tuple[str, ...] = ()


def report_entries(
    result: Walk, join_edges: DataFrame, jobs: DataFrame, tables: DataFrame, foci: DataFrame | None = None
) -> Entries:
    """Labels and databases are joined to the masks and to the ends of join edges, not to the rows per focus.

    ``foci`` are those of the walk with any further columns.
    """
    foci = result.foci if foci is None else foci
    more = tuple(c for c in foci.columns if c not in result.foci.columns)
    placed = with_known(result.placed.where("hop > 0"), tables)
    targets = foci.withColumnRenamed("database_name", "focus_database")
    ends, hot = focus_ends(join_edges, foci)
    labelled = with_label(ends, jobs).withColumnsRenamed({"table_name": "end_table", "other_table": "table_name"})
    partners = with_known(labelled, tables).withColumnsRenamed({"table_name": "other_table", "end_table": "table_name"})
    refs = filled(
        matched_ends(partners, hot, targets).selectExpr(
            "focus", "block", "mask", "focus_database", "table_name AS focus_table", *more, "job_id", "label",
            "other_database AS database_name", "other_table AS table_name", "evidence", "known_database",
        )
    )
    return Entries(result, foci, placed, refs, jobs, more)


def report_items(
    result: Walk, join_edges: DataFrame, jobs: DataFrame, tables: DataFrame
) -> DataFrame:
    """All entries of the dependents reports, one row each, for every focus; see :func:`entry_items`."""
    return entry_items(report_entries(result, join_edges, jobs, tables))


def entry_items(entries: Entries) -> DataFrame:
    """All entries of the dependents reports, one row each, for every focus.

    (focus_database, focus_table, section, hop, job_id, label, database_name, table_name,
    evidence). Within a section, jobs are in order of their label and tables in order of
    (database or '', name).
    """
    none = F.lit(None).cast("string")
    direct = F.col("hop") == 1
    visits = named(with_label(job_visits(entries.walk), entries.jobs), entries.foci).select(
        "focus_database", "focus_table",
        F.when(direct, "direct_jobs").otherwise("transitive_jobs").alias("section"),
        "hop", "job_id", "label", none.alias("database_name"), none.alias("table_name"),
        none.alias("evidence"),
    )
    written = filled(named(entries.placed, entries.foci)).select(
        "focus_database", "focus_table",
        F.when(direct, "direct_tables").otherwise("transitive_tables").alias("section"),
        "hop", none.alias("job_id"), none.alias("label"), "database_name", "table_name",
        none.alias("evidence"),
    )
    refs = entries.refs.select(
        "focus_database", "focus_table", F.lit("join_refs").alias("section"),
        F.lit(1).alias("hop"), "job_id", "label", "database_name", "table_name", "evidence",
    )
    return visits.unionByName(written).unionByName(refs)


def report_jobs(entries: Entries) -> DataFrame:
    """:func:`job_masks` of the reports with ``times``, the rows that the catalog has for a job (1 for none)."""
    masks = job_masks(entries.walk, entries.refs.select("block", "job_id", "mask"))
    again, n = cut_counted(
        entries.jobs.groupBy(F.col("id").alias("again_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND again_id IS NOT NULL")
    )
    if n == 0:
        return masks.withColumn("times", F.lit(1).cast("bigint"))
    return masks.join(again, F.col("job_id") == F.col("again_id"), "left").select(
        *masks.columns, F.coalesce("n", F.lit(1)).cast("bigint").alias("times")
    )


def report_summary(entries: Entries, masks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per focus, with its number: catalog flag, entries per section, verdict counts.

    Jobs and tables are counted on the bit masks, so the (focus, node) pairs never exist as rows. ``masks`` are those
    of :func:`report_jobs`.
    """
    foci = entries.foci
    named_jobs = masks.where("job_id IS NOT NULL").withColumn("broken", F.expr("reached | referring"))
    later = masks.withColumn("later", F.expr("reached & ~direct"))
    parts = [
        count_bits(masks.where("direct != 0"), "n_direct_jobs", "direct", "times"),
        count_bits(later.where("later != 0"), "n_transitive_jobs", "later", "times"),
        count_bits(entries.placed.where("hop = 1"), "n_direct_tables"),
        count_bits(entries.placed.where("hop > 1"), "n_transitive_tables"),
        count_bits(named_jobs, "jobs_broken", "broken"),
        entries.refs.groupBy("focus").agg(F.count(F.lit(1)).alias("n_join_refs")),
    ]
    known = in_catalog(foci, tables).selectExpr("database_name AS known_database", "table_name AS known_table", "in_catalog")
    joined = foci.join(known, F.expr("table_name = known_table AND database_name <=> known_database")).select(
        "focus", "database_name", "table_name", "in_catalog"
    )
    for part in parts:
        joined = joined.join(part, "focus", "left")
    zero = F.lit(0).cast("bigint")
    n = {s: F.coalesce(F.col(f"n_{s}"), zero) for s in SECTIONS}
    return joined.select(
        "focus",
        F.col("database_name").alias("focus_database"),
        F.col("table_name").alias("focus_table"),
        "in_catalog",
        ((n["direct_jobs"] + n["join_refs"]) > 0).alias("has_dependents"),
        *[n[s].alias(f"n_{s}") for s in SECTIONS],
        F.coalesce("jobs_broken", zero).alias("jobs_broken"),
        (n["direct_tables"] + n["transitive_tables"]).alias("tables_orphaned"),
    )


def reference_lines(entries: Entries) -> DataFrame:
    """Distinct texts of the join references of each focus: (focus, focus_database, focus_table, more columns, partner)."""
    focus = table_key(F.col("focus_database"), F.col("focus_table"))
    key = table_key(F.col("database_name"), F.col("table_name"))
    partner = F.concat("label", F.lit(" joins "), focus, F.lit(" <-> "), key)
    return entries.refs.select("focus", "focus_database", "focus_table", *entries.more, partner.alias("partner")).distinct()


def direct_labels(entries: Entries, masks: DataFrame) -> DataFrame:
    """(block, mask, job_id, label) of the jobs that read a focus, from :func:`report_jobs`."""
    return with_label(masks.where("direct != 0").selectExpr("block", "direct AS mask", "job_id"), entries.jobs)


def report_lines(entries: Entries, summary: DataFrame, labels: DataFrame, references: DataFrame) -> DataFrame:
    """Report text as rows, ordered by (section, rank_a, rank_b) within a focus.

    (focus_database, focus_table, more columns of the foci, section, rank_a, rank_b, line). The text of one report is
    its lines in that order; writing many reports is a distributed sort, and a report of any
    length never has to fit into one row. ``labels`` are those of :func:`direct_labels`, ``references``
    those of :func:`reference_lines`.
    """
    focus = table_key(F.col("focus_database"), F.col("focus_table"))
    empty = F.lit("")

    def lines(df: DataFrame, section, line, rank_a=empty, rank_b=empty) -> DataFrame:
        return df.select(
            "focus_database", "focus_table", *entries.more, section.alias("section"),
            rank_a.alias("rank_a"), rank_b.alias("rank_b"), line.alias("line"),
        )

    key = table_key(F.col("database_name"), F.col("table_name"))
    visits = named(labels, entries.foci, *entries.more)
    placed = filled(named(entries.placed, entries.foci, *entries.more))
    n_refs = references.groupBy("focus").agg(F.count(F.lit(1)).alias("n_lines"))
    if entries.more:
        summary = summary.join(entries.foci.select("focus", *entries.more), "focus")

    def text(template: str, *counts: str) -> Column:
        return F.format_string(template, *[focus if c == "focus" else F.col(c) for c in counts])

    # One row per focus, its lines as a list.
    risky, transitive = F.col("has_dependents"), F.col("n_transitive_tables") + F.col("n_transitive_jobs") > 0
    heads = [
        (~risky, 0, F.concat(focus, F.lit(" has no dependents"))),
        (risky, 0, F.concat(focus, F.lit(" has dependents:"))),
        (risky, 1, empty),
        (risky & (F.col("n_direct_jobs") > 0), 2, text("  jobs reading %s (%d):", "focus", "n_direct_jobs")),
        (risky & (F.col("n_direct_tables") > 0), 4, text("  tables written by those jobs (%d):", "n_direct_tables")),
        (F.col("n_lines").isNotNull(), 6, text("  join references (%d):", "n_lines")),
        (
            risky & transitive, 8,
            text("  transitive blast radius: %d more table(s), %d more job(s)", "n_transitive_tables", "n_transitive_jobs"),
        ),
        (risky, 10, empty),
        (
            risky, 11,
            text("NOT SAFE: deleting %s breaks %d job(s) and orphans %d table(s)", "focus", "jobs_broken", "tables_orphaned"),
        ),
    ]
    entry = [F.when(told, F.struct(F.lit(section).alias("section"), line.alias("line"))) for told, section, line in heads]
    headed = summary.join(n_refs, "focus", "left").withColumn("head", F.explode(F.array(*entry))).where("head IS NOT NULL")
    return (
        lines(headed, F.col("head.section"), F.col("head.line"))
        .unionByName(lines(visits, F.lit(3), F.concat(F.lit("    - "), "label"), F.col("label"), F.col("job_id")))
        .unionByName(
            lines(
                placed, F.when(F.col("hop") == 1, 5).otherwise(9), F.concat(F.lit("    - "), key),
                F.coalesce("database_name", empty), F.col("table_name"),
            )
        )
        .unionByName(lines(references, F.lit(7), F.concat(F.lit("    - "), "partner"), F.col("partner")))
    )
