"""WARC archives in which equal payloads are stored once.

Headers (without payloads) are grouped by payload digest; the smallest page_id of a digest keeps its
payload as a response, the others become revisit records that refer to it. Payloads below
``SMALLEST`` bytes are always responses. Records are written by Spark's own text writer, with the
record separator of the format as line separator, so writing is committed by task, on any storage, and
each part file is a gzipped WARC file. Files hold ``RECORDS`` records of at most ``LARGE`` bytes, or a
single larger one, which bounds the memory of reading: it parses records by their stated lengths.

Nulls: a null html is an empty payload; a page without page_id is always a response and nobody's
original; a null url has an empty target. Line breaks in a url are percent-encoded. Rows with the
original's own page_id and payload are responses as well. An empty table gives archives without
records. Extra columns are not read.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm.common import table
from tablewake.sources.scratch import cut, new_path

SMALLEST = 100
LARGE = 1 << 16
RECORDS = 256
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def resolve(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """(digest, original): for each payload of at least ``smallest`` bytes the page that keeps it, if others repeat it."""
    heads = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"))
    heads = heads.where((F.col("n") >= smallest) & F.col("page_id").isNotNull())
    groups = heads.groupBy("digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last"))
    return groups.where("last > original").select("digest", "original")


def _head(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """(record, n): the text of a WARC record for each page (page_id, url, html), without its end, and its payload's bytes."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    originals = cut(resolve(pages, smallest))
    rows = pages.withColumn("its_digest", F.sha2("payload", 256))
    rows = rows.join(originals, F.col("its_digest") == F.col("digest"), "left")
    n = F.octet_length("payload")
    revisit = F.coalesce(F.col("page_id") > F.col("original"), F.lit(False))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    empty = F.lit("")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _head("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _head("WARC-Record-ID", _urn(F.col("page_id"))),
        _head("WARC-Date", F.lit(DATE)),
        _head("WARC-Target-URI", url),
        _head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("its_digest"))),
        _head("X-Payload-Length", n.cast("string")),
        F.when(
            revisit,
            F.concat(
                _head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                _head("WARC-Refers-To", _urn(F.col("original"))),
            ),
        ).otherwise(empty),
        _head("Content-Type", F.lit("text/html; charset=utf-8")),
        _head("Content-Length", F.when(revisit, F.lit("0")).otherwise(n.cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, empty).otherwise(F.col("payload")),
    )
    return rows.select(record.alias("record"), F.when(revisit, 0).otherwise(n).alias("n"))


def write_archives(pages: DataFrame, path: str, smallest: int = SMALLEST) -> None:
    """Write ``<path>/small`` and ``<path>/large``: gzipped WARC files."""
    rows = records(pages, smallest)
    for kind, part, most in (("small", F.col("n") <= LARGE, RECORDS), ("large", F.col("n") > LARGE, 1)):
        writer = rows.where(part).select("record").write.option("lineSep", END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", most).text(f"{path}/{kind}")


def parse(raw: bytes):
    """Headers and payload of each record of a WARC file."""
    at = 0
    while at < len(raw):
        body = raw.index(b"\r\n\r\n", at) + 4
        lines = raw[at:body].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record without its version line")
        heads = dict(line.split(": ", 1) for line in lines[1:] if line)
        at = body + int(heads["Content-Length"])
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record without its end")
        yield heads, raw[body:at]
        at += 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record; ``payload`` is null for revisits, or for all without ``payloads``."""

    def run(batches):
        page = lambda urn: None if urn in (None, "<urn:page:none>") else int(urn[10:-1])
        for batch in batches:
            for content in batch.column(0):
                out = []
                for heads, payload in parse(gzip.decompress(content.as_py())):
                    kind = heads["WARC-Type"]
                    out.append(
                        (
                            page(heads["WARC-Record-ID"]),
                            heads["WARC-Target-URI"],
                            int(heads["X-Payload-Length"]),
                            heads["WARC-Payload-Digest"].removeprefix("sha256:"),
                            kind,
                            page(heads.get("WARC-Refers-To")),
                            payload if payloads and kind == "response" else None,
                        )
                    )
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    schema = pa.schema(list(zip([c.split()[0] for c in SCHEMA.split(", ")], types, strict=True)))
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True)
    return reader.load(path).select("content").mapInArrow(run, SCHEMA)


def restore(archive: DataFrame) -> DataFrame:
    """All records with their payloads: revisits get that of the response they refer to."""
    originals = archive.where("record_type = 'response'").select(F.col("page_id").alias("original"), F.col("payload_digest").alias("its_digest"), F.col("payload").alias("its_payload"))
    originals = originals.dropDuplicates(["original", "its_digest"])
    same = (F.col("refers_to") == F.col("original")) & (F.col("payload_digest") == F.col("its_digest"))
    rows = archive.join(originals, same, "left")
    payload = F.when(F.col("record_type") == "revisit", F.col("its_payload")).otherwise(F.col("payload"))
    return rows.withColumn("payload", payload).drop("original", "its_digest", "its_payload")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = read_archives(spark, path, payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
WITH heads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
originals AS (SELECT digest, min(page_id) AS original FROM heads WHERE n >= {SMALLEST} GROUP BY digest)
SELECT page_id, n AS payload_bytes, h.digest AS payload_digest,
  CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > original THEN original END AS refers_to
FROM heads h LEFT JOIN originals o ON h.digest = o.digest AND h.n >= {SMALLEST}
"""
