"""Keeping hot keys out of single tasks.

One table name, job or focus may hold a third of all rows. Two tools deal with that:

* :func:`salted` / :func:`matched` give the rows of a hot join key several salts and repeat
  the other side once per salt, for hot keys only. The result of the join is unchanged.
* :func:`listed` builds ordered lists in pages of bounded length: page 0 holds a group's first
  items, page 1 the next ones, and so on. No task ever holds a whole unbounded group, no
  value is lost, and the pages of a group follow each other in the order of its items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, cut_counted

ROWS_PER_SALT = 2_000_000
ITEMS_PER_PART = 10_000


def hot_keys(df: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows and the number of salts each needs.

    Counted with map-side partial sums. At most ``rows / rows_per_salt`` keys qualify.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / rows_per_salt).cast("int")
    return counts.where(F.col("n") > rows_per_salt).select(key, salts.alias("n_salts"))


def salted(df: DataFrame, key: str, hot: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``salt`` to the heavy side: a hash of ``by`` for hot keys, zero for the others."""
    salt = F.when(F.col("n_salts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*by), F.col("n_salts"))
    )
    joined = df.join(hot, key, "left")
    return joined.withColumn("salt", salt.cast("int")).drop("n_salts")


def matched(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat the light side once per salt of its key."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col("n_salts"), F.lit(1)) - 1)
    joined = df.join(hot, key, "left")
    return joined.withColumn("salt", F.explode(salts)).drop("n_salts")


def _same(keys: Sequence[str], prefix: str) -> str:
    return " AND ".join(f"{k} <=> {prefix}{k}" for k in keys)


def _paged(rows: DataFrame, keys: Sequence[str], page: int) -> DataFrame:
    """Add ``part``, the item's rank in its group div ``page``, without a task for a whole group.

    Rows are range-partitioned by key and item and numbered within each range; a group's counts
    per range, a row for each range it reaches into, give the start of the next range.
    """
    ranges = cut(rows.repartitionByRange(*keys, "item").withColumn("range_no", F.spark_partition_id()))
    counts = ranges.groupBy(*keys, "range_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"start_{k}") for k in keys], F.col("range_no").alias("start_no"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    inside = Window.partitionBy(*keys, "range_no").orderBy("item")
    numbered = ranges.withColumn("nth", F.row_number().over(inside) - 1)
    placed = numbered.join(starts, F.expr(f"range_no = start_no AND {_same(keys, 'start_')}"))
    return placed.select(*keys, "item", F.expr(f"CAST((start + nth) DIV {page} AS INT) AS part"))


def listed(df: DataFrame, keys: Sequence[str], item: str, *, page: int = ITEMS_PER_PART) -> DataFrame:
    """Sorted lists of ``item`` per key, as rows (keys, part, items) of at most ``page`` items each.

    Items may be structs; they sort field by field. Only groups of more than one page are numbered.
    """
    rows = cut(df.select(*keys, F.col(item).alias("item")))
    large, n_large = cut_counted(
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > page)
        .select(*[F.col(k).alias(f"large_{k}") for k in keys])
    )
    if n_large == 0:
        return rows.groupBy(*keys).agg(F.expr("array_sort(collect_list(item)) AS items")).select(*keys, F.lit(0).alias("part"), "items")
    is_large = F.expr(_same(keys, "large_"))
    single = rows.join(large, is_large, "left_anti").withColumn("part", F.lit(0))
    paged = _paged(rows.join(large, is_large, "left_semi"), keys, page)
    return single.unionByName(paged).groupBy(*keys, "part").agg(F.expr("array_sort(collect_list(item)) AS items"))


def listed_text(
    df: DataFrame, keys: Sequence[str], item: str, name: str, separator: str = ", ", page: int = ITEMS_PER_PART
) -> DataFrame:
    """Distinct items of each key, sorted and joined to text, as rows (keys, part, name)."""
    lists = listed(df.select(*keys, item).distinct(), keys, item, page=page)
    return lists.select(*keys, "part", F.array_join("items", separator).alias(name))
