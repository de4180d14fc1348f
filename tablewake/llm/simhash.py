"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A text is lower-cased (A-Z), cut into words and word shingles (repeats count; a text of fewer words
is one shingle; one without words has fingerprint zero). A bit of the fingerprint is 1 if it is set
in over half of the shingles' hashes. Two fingerprints link if they differ in at most two bits.

Links are searched among distinct fingerprints. Cut into four blocks of 16 bits, two fingerprints
that differ in two bits agree in at least two blocks, so each is listed under its six pairs of
blocks and met there. A list longer than ``LIST`` is not compared as a whole: its fingerprints are
listed again under 56 of their 64 bits (16 blocks of 4, without each pair of blocks: 120 keys),
where a list cannot hold more than 256 different ones; a pair that differs in two bits agrees there
too, so no link is lost. Within a list all pairs are verified by their distance, and only a
spanning set of links leaves it.

Nulls: a null text has no words; a null doc_id is never the smallest, and a component of null ids
only has a null id. Repeated rows give a row each. An empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm.common import table
from tablewake.llm.components import components
from tablewake.sources.scratch import cut

SHINGLE = 3
SEED = 42
BITS = 2
LIST = 256
CHUNK = 1 << 16  # shingles counted at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    words = raw.split()  # bytes: exactly the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    begins, ends = begins[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    ones = np.zeros(64, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(begins[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        hashes = np.fromiter((hash64(line[a:b], SEED) for a, b in spans), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            signed = np.array(fps, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def links_of(fps: list[int]) -> list[tuple[int, int]]:
    """For each fingerprint of a list but the smallest of its component in it: a link to that one."""
    fps = sorted(fps)
    if len(fps) == 2:
        a, b = fps
        return [(b, a)] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= BITS else []
    x = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= BITS
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            return [(fps[i], fps[k]) for i, k in enumerate(label.tolist()) if k != i]
        label = least


def _lists(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(kind, key, fp): each fingerprint under its bits in each mask."""
    keys = [F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("at")).select("fp", "at.kind", "at.key")


def _masks(width: int, left_out: int) -> list[int]:
    """Masks of all bits but ``left_out`` blocks of ``width`` bits, as signed numbers."""
    block = (1 << width) - 1
    full = (1 << 64) - 1
    out = []
    for picked in combinations(range(64 // width), left_out):
        mask = full
        for k in picked:
            mask &= ~(block << (k * width))
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _met(lists: DataFrame) -> DataFrame:
    """Links (a, b) found in lists of bounded length."""

    def run(batches):
        for batch in batches:
            found = [link for fps in batch.column(0).to_pylist() for link in links_of(fps)]
            a, b = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    lists = lists.groupBy("kind", "key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return lists.select("fps").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, longest: int = LIST) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (fp)."""
    coarse = cut(_lists(fps, _masks(16, 2)))
    counts = cut(coarse.groupBy("kind", "key").count().where("count > 1"))
    short = coarse.join(counts.where(F.col("count") <= longest), ["kind", "key"], "left_semi")
    long = coarse.join(counts.where(F.col("count") > longest), ["kind", "key"], "left_semi").select("fp").distinct()
    return _met(short).union(_met(_lists(long, _masks(4, 2))))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text)."""
    prints = cut(fingerprints(docs, shingle))
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp")))
    placed = firsts.join(roots, firsts.fp == roots.node, "left")
    placed = cut(placed.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    names = cut(placed.join(ids, "root").select("fp", "component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(names, "fp").select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows whose doc_id is the smallest of its component; rows without a doc_id stay."""
    groups = cut(near_duplicates(docs, shingle).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(groups, docs["doc_id"] == groups["doc_id"], "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
