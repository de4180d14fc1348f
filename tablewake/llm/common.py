"""Helpers shared by the operators: words, ordered positions, worker caches."""

from __future__ import annotations

import sys
import types

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tablewake.sources.scratch import cut

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, so that equal texts are worked on once."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def positions(df: DataFrame, *order: Column, sums: dict[str, str] | None = None) -> DataFrame:
    """``position`` (from 0) of each row in a total order, and sums over the rows before it.

    ``sums`` maps new columns to summed ones. Rows are range-partitioned and written; each range
    is numbered by itself, and only the ranges' totals (a row for each range) meet in one task.
    """
    ranges = cut(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    inside = Window.partitionBy("range_no").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums or {}
    rows = ranges.withColumn("position", F.row_number().over(inside) - 1)
    for name, of in sums.items():
        rows = rows.withColumn(name, F.coalesce(F.sum(of).over(before), F.lit(0)))
    counts = ranges.groupBy("range_no").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(of).alias(f"all_{name}") for name, of in sums.items())
    )
    starts = counts.select(
        "range_no",
        F.coalesce(F.sum("n").over(totals), F.lit(0)).alias("n_before"),
        *(F.coalesce(F.sum(f"all_{name}").over(totals), F.lit(0)).alias(f"at_{name}") for name in sums),
    )
    rows = rows.join(starts, "range_no").withColumn("position", F.col("position") + F.col("n_before"))
    for name in sums:
        rows = rows.withColumn(name, F.col(name) + F.col(f"at_{name}"))
    return rows.drop("range_no", "n_before", *(f"at_{name}" for name in sums))


def with_columns(df: DataFrame, **added: str) -> StructType:
    """The schema of ``df`` with columns added, given by name and type."""
    return StructType([*df.schema.fields, *(StructField(n, DataType.fromDDL(t)) for n, t in added.items())])


#: White space on both sides of a blank: there a cut would part a run of white space.
_PARTED = regex.compile(r"\s (?=\s)|  ")
_BLANK = regex.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut at single blanks, which are left out.

    The tokenizers' pattern separates before each of them, and what it finds in a chunk (with its blank before it)
    does not depend on what stands around, so chunks can be encoded by themselves.
    """
    return _BLANK.split(text) if _PARTED.search(text) else text.split(" ")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as its Python worker, whatever tasks it runs."""
    holder = sys.modules.setdefault("tablewake_worker_caches", types.ModuleType("tablewake_worker_caches"))
    return vars(holder).setdefault(name, {})


class Kept:
    """What a worker has worked out by string: at least the last ``size / 2`` that were put in or asked for, at most ``size``."""

    def __init__(self, size: int) -> None:
        self.half = size // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None and (value := self.old.pop(key, None)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[key] = value
