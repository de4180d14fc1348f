"""Cutting lineage with tables in the shared checkpoint folder.

An iterative walk must not drag the plan of every earlier round behind it, and its state
must survive the loss of an executor. Each round is therefore written as a Parquet table
under ``spark.checkpoint.dir`` and read back: fault tolerant, columnar, and with true sizes
for the next round's join decisions. Without that setting the tables go below
``spark.sql.warehouse.dir``, which a cluster shares as well; the rule is the same for every
master. :func:`clear` removes what a session has written once its results have been used.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
FALLBACK = "spark.sql.warehouse.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder in the shared storage."""
    shared = spark.conf.get(SETTING, None) or spark.conf.get(FALLBACK)
    return f"{shared.rstrip('/')}/tablewake-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{scratch_root(spark)}/{kind}-{uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Remove the table that a DataFrame of :func:`cut` reads, once all that is made from it has been written."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.split("/tablewake-")[-1] != folder and root.rsplit("/", 1)[-1] in folder:
            remove(spark, folder)


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables of this session. DataFrames that read them end with it."""
    for table in spark.catalog.listTables():
        if table.name.startswith("clustered_") and not table.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    remove(spark, scratch_root(spark))


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Materialise a DataFrame as a shared table and return a scan of it."""
    return cut_counted(df, partition_by)[0]


def cut_counted(df: DataFrame, partition_by: str | None = None) -> tuple[DataFrame, int]:
    """Like :func:`cut`, with the row count taken while writing rather than by another job."""
    path = new_path(df.sparkSession, "table")
    size = write_counted(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path), size


def cut_clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Like :func:`cut`, clustered: joins on ``keys`` read the table as it lies and shuffle only their other side.

    There are as many buckets as shuffle partitions. The table is known to the session by a name of its own; its files lie in
    the shared folder like those of any other table and go with them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _clustered(df.repartition(n, *keys).sortWithinPartitions(*keys), keys, n)


def cut_grouped(df: DataFrame, key: str) -> DataFrame:
    """Like :func:`cut_clustered`, for the result of ``groupBy(key)``: its rows lie by the key already and move no further."""
    return _clustered(df, [key], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _clustered(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    spark = rows.sparkSession
    path = new_path(spark, "clustered")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with without_leftovers(spark):
        rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files behind; else they stay until the driver collects its garbage.

    Nothing reads them again: later steps read the table that was written.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def write_counted(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    seen = Observation()
    with without_leftovers(df.sparkSession):
        df.observe(seen, F.expr("count(1) AS n")).write.parquet(path, partitionBy=partition_by)
    return seen.get["n"]


class Levels:
    """The rounds of a walk as one table, partitioned by ``hop``.

    Round *n* is the folder ``hop=n``. Reading all rounds is one scan whatever their number,
    and the plan of each round has the same shape, so its generated code is reused.
    """

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark = spark
        self.schema = f"{schema}, hop int"
        self.root = new_path(spark, "levels")
        self.hops: list[int] = []

    def add(self, df: DataFrame, hop: int) -> int:
        """Write one round and return its number of rows."""
        self.hops.append(hop)
        return write_counted(df, f"{self.root}/hop={hop}")

    def read(self, *hops: int) -> DataFrame:
        """The given rounds, or all of them."""
        paths = [f"{self.root}/hop={h}" for h in (hops or self.hops)]
        reader = self.spark.read.schema(self.schema).option("basePath", self.root)
        return reader.parquet(*paths)
