"""Line dedup against a sharded minimal perfect hash.

The key of a line is the line without white space (ASCII) at its ends, in lower case (A-Z). Keys of at
least ``LEAST_CHARS`` code points that at least ``LEAST_DOCS`` documents hold lose all their lines but those of
the largest doc_id that holds them.

Each document gives a 128-bit hash for each different key. Counting by hash (with partial counts before the
shuffle) leaves the frequent ones with their number of documents and largest doc_id. They fall into shards by
hash; a shard's index is built in one task: hashes are dealt into small buckets, and each bucket,
largest first, gets the first displacement that puts its hashes into free slots of an array of exactly as many
slots as hashes. The index is three flat arrays: displacements, 64-bit fingerprints, largest doc_ids,
and one of counts. The documents' hashes go to the shards and look themselves up in the arrays, so no line is
joined to another. As every document that has a frequent line asks for it, a shard is asked unevenly:
shards with many questions get copies, and questions are dealt to the copies by document. What comes back to a
document are the hashes of its keys that go.

Nulls: a null text is one empty line. A null doc_id counts as one document, smaller than all others. Rows with
one doc_id count as one document, and each is judged by its lines and doc_id. An empty table gives no rows.
Extra columns are kept by :func:`drop_lines` and not read by the query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm.common import table, with_columns
from tablewake.sources.scratch import cut, cut_counted

LEAST_CHARS = 20
LEAST_DOCS = 3
ASKED = 1 << 12  # questions that a shard, or a copy of one, gets, about
BUCKET = 4  # keys a bucket has, about
BLANKS = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None) -> list[bytes | None]:
    """For each line its key's hash; None for a key that is too short."""
    out = []
    for line in (text or "").encode("utf-8", "replace").lower().split(b"\n"):
        key = line.strip(BLANKS)
        long = len(key) >= LEAST_CHARS and (key.isascii() or len(key.decode("utf-8")) >= LEAST_CHARS)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, f): the two halves of each different key's hash in each row."""

    def run(batches):
        for batch in batches:
            found = [{k for k in keys_of(t.as_py()) if k} for t in batch.column(1)]
            halves = np.frombuffer(b"".join([k for keys in found for k in keys]), "<i8").reshape(-1, 2)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "h", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, h long, f long")


def mixed(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Well-spread 64 bits of each hash under a salt."""
    with np.errstate(over="ignore"):
        x = h ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(salt, np.uint64) + np.uint64(1)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def slot_of(h: np.ndarray, f: np.ndarray, salt: np.ndarray | int, n: int) -> np.ndarray:
    """One of n slots for each hash (h, f) under a salt."""
    return (mixed(h ^ mixed(f, salt), salt) % np.uint64(max(n, 1))).astype(np.int64)


def build(h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each hash) for different hashes; slots are 0 to n - 1, each once."""
    n = len(h)
    shifts = np.zeros(max(1, -(-n // BUCKET)), np.uint32)
    bucket = slot_of(h, f, 0, len(shifts))
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(shifts))
    begins = np.cumsum(sizes) - sizes
    free, slots = np.ones(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        members = order[begins[b] : begins[b] + sizes[b]]
        if not len(members):
            break
        tried = 1
        while True:  # try a run of displacements at once
            salts = np.arange(tried, tried + 64, dtype=np.uint64)[:, None]
            spots = slot_of(h[members][None, :], f[members][None, :], salts, n)
            good = free[spots].all(axis=1)
            ranked = np.sort(spots, axis=1)
            good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.flatnonzero(good)[0])
                shifts[b], slots[members] = tried + k, spots[k]
                free[spots[k]] = False
                break
            tried += 64
    return shifts, slots


def find(h: np.ndarray, f: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """The slot that each hash has if it is in the index."""
    return slot_of(h, f, shifts[slot_of(h, f, 0, len(shifts))].astype(np.uint64), n)


INDEX = "shard long, shifts binary, fingerprints binary, doc_counts binary, last_docs binary"


def index(frequent: DataFrame, n_shards: int) -> DataFrame:
    """A row of flat arrays for each shard of (h, f, n_docs, last_doc)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, f = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "f"))
        shifts, slots = build(h, f)
        arrays = []
        for column, kind in (("f", np.int64), ("n_docs", np.uint32), ("last_doc", np.int64)):
            array = np.zeros(len(h), kind)
            array[slots] = group[column].to_numpy()
            arrays.append(array.tobytes())
        return pd.DataFrame([[group["shard"].iloc[0], shifts.tobytes(), *arrays]], columns=[c.split()[0] for c in INDEX.split(", ")])

    return frequent.withColumn("shard", F.pmod("h", F.lit(n_shards))).groupBy("shard").applyInPandas(run, INDEX)


def lost_keys(lines: DataFrame, n_lines: int) -> DataFrame:
    """(doc_id, h, f) of the keys whose lines a document loses, from (doc_id, h, f)."""
    each = lines.groupBy("h", "f", "doc_id").agg(F.lit(1).alias("one"))
    frequent = each.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    frequent = cut(frequent.where(F.col("n_docs") >= LEAST_DOCS).withColumn("n_docs", F.least("n_docs", F.lit(2**32 - 1))))
    n_shards = max(1, -(-n_lines // ASKED))
    shards = cut(index(frequent, n_shards))
    asked = lines.withColumn("shard", F.pmod("h", F.lit(n_shards)))
    copies = cut(asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / ASKED).alias("copies")))
    named = copies.withColumnRenamed("shard", "its_shard")
    asked = asked.join(named, F.col("shard") == F.col("its_shard"))
    asked = asked.select("shard", F.pmod(F.xxhash64("doc_id"), "copies").alias("copy"), "doc_id", "h", "f")
    shards = shards.join(named, F.col("shard") == F.col("its_shard"))
    shards = shards.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("its_shard", "copies")

    def probe(questions: pa.Table, index: pa.Table) -> pa.Table:
        questions = questions.select(["doc_id", "h", "f"])
        if not index.num_rows:
            return questions.slice(0, 0)
        array = lambda name, kind: np.frombuffer(index.column(name)[0].as_py(), kind)
        prints, last = array("fingerprints", np.int64), array("last_docs", np.int64)
        h, f = (questions.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
        slots = find(h, f, array("shifts", np.uint32), len(prints))
        known = (prints[slots].view(np.uint64) == f) & (array("doc_counts", np.uint32)[slots] >= LEAST_DOCS)
        ids = questions.column("doc_id")
        known &= ids.is_null().to_numpy() | (ids.fill_null(-(1 << 63)).to_numpy() < last[slots])
        return questions.filter(pa.array(known))

    grouped = asked.groupBy("shard", "copy").cogroup(shards.groupBy("shard", "copy"))
    return grouped.applyInArrow(probe, "doc_id long, h long, f long")


def drop_lines(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``docs`` (doc_id long, text and any others) without the lines that go, and with ``n_lines`` (before) and ``n_dropped``.

    With ``digest`` only doc_id, n_lines, n_dropped and kept_sha256 are returned.
    """
    import hashlib

    lines, n_lines = cut_counted(line_hashes(docs))
    lost = lost_keys(lines, n_lines).withColumn("key", F.struct("h", "f")).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    lost = cut(lost.select(F.col("doc_id").alias("__lost_id"), F.col("keys.h").alias("__lost_h"), F.col("keys.f").alias("__lost_f")))
    added = {"n_lines": "bigint", "n_dropped": "bigint"}
    rows = docs.select(F.col("doc_id").cast("long"), "text") if digest else docs.drop(*added)
    kept = rows.columns
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__lost_id")), "left").select(*kept, "__lost_h", "__lost_f")
    at = kept.index("text")

    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped, hs, fs = [], [], [], batch.column(len(kept)), batch.column(len(kept) + 1)
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                parts = (text or "").split("\n")
                n_lines.append(len(parts))
                if hs[i].is_valid:
                    pairs = np.stack([hs[i].values.to_numpy(), fs[i].values.to_numpy()], axis=1).astype("<i8")
                    gone = {row.tobytes() for row in pairs}
                    stay = [p for p, k in zip(parts, keys_of(text), strict=True) if k not in gone]
                    text = "\n".join(stay)
                    parts = stay
                n_dropped.append(n_lines[-1] - len(parts))
                texts.append(text)
            if digest:
                sums = [hashlib.sha256((t or "").encode("utf-8", "replace")).hexdigest() for t in texts]
                columns = [batch.column(0), pa.array(n_lines), pa.array(n_dropped), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *added, "kept_sha256"])
            else:
                columns = list(batch.columns[: len(kept)])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], [*kept, *added])

    if digest:
        return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return rows.mapInArrow(run, with_columns(docs.drop(*added), **added))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents"), digest=True)


OP10_SQL = rf"""
WITH parted AS (SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, row_no, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM parted),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= {LEAST_DOCS}),
judged AS (
  SELECT k.*, f.key IS NOT NULL AND (doc_id IS NULL OR doc_id < last_doc) AS goes
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT row_no, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '') AS kept
  FROM judged GROUP BY row_no)
"""
