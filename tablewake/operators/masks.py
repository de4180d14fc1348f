"""Many walks at once: foci as bits.

Walking the graph from one focus at a time repeats the same joins, and walking from all of
them with one row per (focus, node) repeats the same rows. Here the foci are numbered and
packed 64 to a block; a node carries one BIGINT per block whose bit *i* says "reached from
the block's i-th focus". Merging paths is ``bit_or``, removing what was seen is ``& ~``, and
both stay inside Spark's hash aggregation. (Multi-source breadth-first search, Then et al.,
VLDB 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import known_database
from ..sources.scratch import cut

WIDTH = 64


def number_foci(foci: DataFrame) -> DataFrame:
    """Distinct foci as (focus, block, mask, database_name, table_name).

    The ids come from sorted range partitions, so no single task numbers them; a partition's
    ids start at a multiple of 2**33 and blocks never straddle partitions. The table is
    written out because a recomputed partition might number its rows differently.
    """
    keys = foci.select(
        known_database(F.col("database_name")).alias("database_name"), "table_name"
    ).distinct()
    ordered = keys.repartitionByRange("table_name", "database_name").sortWithinPartitions(
        "table_name", "database_name"
    )
    numbered = ordered.withColumn("focus", F.monotonically_increasing_id())
    return cut(
        numbered.selectExpr(
            "focus",
            f"focus DIV {WIDTH} AS block",
            f"shiftleft(1L, CAST(focus % {WIDTH} AS INT)) AS mask",
            "database_name",
            "table_name",
        )
    )


def bits(df: DataFrame) -> DataFrame:
    """One row per set bit of ``mask``, with ``bit``: a generator and a filter in generated code, no function per bit."""
    return df.selectExpr(f"explode(sequence(0, {WIDTH - 1})) AS bit", "*").where("getbit(mask, bit) = 1")


def by_focus(df: DataFrame) -> DataFrame:
    """One row per set bit: ``block`` and ``mask`` become ``focus``."""
    rest = [c for c in df.columns if c not in ("block", "mask")]
    exploded = bits(df)
    return exploded.selectExpr(f"block * {WIDTH} + bit AS focus", *rest)


def named(df: DataFrame, foci: DataFrame, *more: str) -> DataFrame:
    """One row per set bit: ``block`` and ``mask`` become (focus_database, focus_table) and ``more`` columns of the foci.

    The names of a block travel as one list, so the join moves a row per mask and not one per bit. A focus that ``foci`` has
    several rows for gives a row for each.
    """
    entry = F.struct(
        (F.col("focus") % WIDTH).cast("int").alias("bit"), F.col("database_name").alias("focus_database"),
        F.col("table_name").alias("focus_table"), *more,
    )
    names = foci.groupBy("block").agg(F.collect_list(entry).alias("named_foci"))
    rest = [c for c in df.columns if c not in ("block", "mask")]
    chosen = df.join(names, "block").selectExpr("explode(named_foci) AS named_focus", "mask", *rest)
    fields = [f"named_focus.{c}" for c in ("focus_database", "focus_table", *more)]
    return chosen.where("getbit(mask, named_focus.bit) = 1").select(*fields, *rest)


def count_bits(df: DataFrame, name: str, mask: str = "mask", times: str = "1L") -> DataFrame:
    """Rows per focus, as (focus, name), without producing a row per focus and node; a row counts ``times``.

    Half as many sums per block as bits, for bits 0 to 31 in the lower and 32 to 63 in the upper half of a number; both stay below
    2**31. Partial sums are taken before the shuffle.
    """
    half = WIDTH // 2
    ones = 1 + (1 << half)
    sums = ", ".join(f"sum((shiftrightunsigned({mask}, {i}) & {ones}L) * {times})" for i in range(half))
    per_block = df.groupBy("block").agg(F.expr(f"array({sums}) AS sums"))
    counts = f"concat(transform(sums, s -> s & {(1 << half) - 1}L), transform(sums, s -> shiftrightunsigned(s, {half})))"
    exploded = per_block.selectExpr("block", f"posexplode({counts}) AS (bit, {name})")
    return exploded.selectExpr(f"block * {WIDTH} + bit AS focus", name)


def named_foci(df: DataFrame, foci: DataFrame) -> DataFrame:
    """Replace the focus number by (focus_database, focus_table)."""
    names = foci.select(
        F.col("focus").alias("number"),
        F.col("database_name").alias("focus_database"),
        F.col("table_name").alias("focus_table"),
    )
    rest = [c for c in df.columns if c != "focus"]
    return df.join(names, df["focus"] == names["number"]).select(
        "focus_database", "focus_table", *rest
    )
