"""Removal of repeated byte strings, by a collection's suffix order built column by column.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere in the collection goes. The full
construction over whole texts takes as many rounds, each rewriting a file of the collection's size, as the longest
text has bytes. Here it runs over short strings of equal place instead, so that rounds are few and shards bounded:

1. Winnowing: of the ``GRAM``-byte grams inside each string of ``LENGTH`` bytes, the one of least hash (the
   leftmost of equals) is its anchor. Equal strings have equal anchors at equal places.
2. Only anchors whose gram occurs in two places matter. An anchor's context is all that strings with this anchor can
   cover. A context that occurs twice is repeated as a whole: no more work.
3. The different contexts of a gram are dealt to shards. A shard is a table with a row for each context, aligned at
   the anchor, read column by column from the right: each round puts one symbol before every row's suffix, which
   turns the order of the suffixes by a stable sort of that column (the Burrows-Wheeler step) and updates the common
   prefixes of neighbours. A string is repeated if its suffix shares ``LENGTH`` bytes with a neighbour's.
4. A gram with more than ``SHARD`` contexts does not fit a task. Its strings are counted by 128-bit hashes
   instead, with partial counts.

Each step's table is written to the shared folder, and removed once the tables made from it are. Texts are named by 96 bits of hashes. Rows with equal texts are one text that
occurs in several places: all of it goes if it has ``LENGTH`` bytes.

Nulls: a null text is empty, doc_id is only carried. Repeated rows give a row each. Texts below ``LENGTH`` bytes
lose nothing. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm.common import table, text_of
from tablewake.sources.scratch import cut, cut_counted, discard

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM  # the most bytes of a string before its anchor
SHARD = 2048  # contexts of one gram, and about those of a shard
BLOCK = 8  # neighbouring strings counted together
PART = 1 << 18  # windows of a text looked at together
SEEDS = (101, 202)


def named(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("u"), F.hash(text, F.lit(7)).alias("u2")]


class Rolling:
    """Hashes of all substrings of a byte string from sums over its prefixes."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(0, 1 << 60)) * 8 + 5  # odd, so that it can be undone
        self.undo = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            powers = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, np.uint64(b), np.uint64))))
            self.up, self.down = powers(self.base), powers(self.undo)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self.grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[begin]) * self.down[begin]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD1342543DE82EF95)
        return x ^ (x >> np.uint64(32))


def least_of_each(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(raw: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(places of the anchors, hashes of their contexts with their grams') in a text of at least LENGTH bytes."""
    found = []
    for begin in range(0, len(raw) - LENGTH + 1, PART):
        part = raw[begin : begin + PART + LENGTH - 1]
        sums = rolling.sums(part)
        at = np.arange(len(part) - GRAM + 1)
        keys = rolling.of(sums, at, at + GRAM) >> np.uint64(20) << np.uint64(20) | at.astype(np.uint64)
        least = least_of_each(keys, SPAN + 1)
        own = least[np.concatenate(([True], least[1:] != least[:-1]))]
        found.append((own & np.uint64((1 << 20) - 1)).astype(np.int64) + begin)
    return np.unique(np.concatenate(found))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(gram, context, u, u2, place) of all anchors of ``docs`` (u, u2, text)."""

    def run(batches):
        rolling = Rolling(SEEDS[0])
        for batch in batches:
            out, counts = [], []
            for text in batch.column(2):
                raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                if len(raw) < LENGTH:
                    counts.append(0)
                    continue
                places = anchors(raw, rolling)
                sums = rolling.sums(raw)
                lo, hi = np.maximum(places - SPAN, 0), np.minimum(places + LENGTH, len(raw))
                cut_off = ((places - lo) * (LENGTH + 1) + hi - places).astype(np.uint64)
                context = rolling.of(sums, lo, hi) ^ (cut_off * np.uint64(0x9E3779B97F4A7C15))
                out.append((rolling.of(sums, places, places + GRAM), context, places))
                counts.append(len(places))
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            parts = [np.concatenate([np.zeros(0, t), *(o[i] for o in out)]) for i, t in enumerate((np.uint64, np.uint64, np.int64))]
            columns = [parts[0].view(np.int64), parts[1].view(np.int64), batch.column(0).take(of), batch.column(1).take(of), parts[2].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["gram", "context", "u", "u2", "place"])

    return docs.select("u", "u2", "text").mapInArrow(run, "gram long, context long, u long, u2 int, place int")


def repeated_starts(rows: np.ndarray, length: int, starts: int) -> np.ndarray:
    """For each row of symbols (0: no symbol) and each of its first ``starts`` columns: do ``length`` symbols from
    there also stand at the same columns of another row?
    """
    n, columns = rows.shape
    out = np.zeros((n, starts), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.int32)  # common[i]: of the suffixes at i - 1 and i
    for column in range(columns - 1, -1, -1):
        symbols = rows[order, column]
        turn = np.argsort(symbols, kind="stable")
        ordered = symbols[turn]
        same = np.flatnonzero((ordered[1:] == ordered[:-1]) & (ordered[1:] > 0))
        fresh = np.zeros(n + 1, np.int32)
        if len(same):
            ends = np.stack([turn[same] + 1, turn[same + 1] + 1], axis=1).ravel()
            fresh[same + 1] = np.minimum.reduceat(common, ends)[::2] + 1
        order, common = order[turn], fresh
        if column < starts:
            out[order, column] = np.maximum(common[:-1], common[1:]) >= length
    return out


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]


def _discard(*tables: DataFrame) -> None:
    """Remove tables whose successors are written, so that the disk holds a few steps and not all of them."""
    for written in tables:
        discard(written)


RUNS = "u long, u2 int, begin int, end int"


def _strings(docs: DataFrame, wanted: DataFrame, used: list[DataFrame]) -> DataFrame:
    """``wanted`` (u, u2, gram, context, place, alone) with ``bytes``, the context from the text and ``before``, its bytes before the anchor.

    Tables that the result reads are added to ``used``, here and below.
    """
    firsts = docs.groupBy("u", "u2").agg(F.min("row_key").alias("row_key"))
    lists = wanted.groupBy("u", "u2").agg(F.collect_set(F.struct("gram", "context", "place", "alone")).alias("list"))
    lists = cut(lists.join(firsts, ["u", "u2"]))
    used.append(lists)
    rows = docs.select("u", "u2", "row_key", "text").join(lists, ["u", "u2", "row_key"])
    one = rows.select("u", "u2", F.encode("text", "utf-8").alias("raw"), F.explode("list").alias("x")).select("u", "u2", "raw", "x.*")
    before = F.least(F.col("place"), F.lit(SPAN))
    taken = F.substring("raw", F.col("place") - before + 1, before + LENGTH)
    return one.select("gram", "context", "u", "u2", "place", "alone", before.alias("before"), taken.alias("bytes"))


def _in_shards(strings: DataFrame) -> DataFrame:
    """Removed runs of the strings that occur once as a whole, shard by shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["gram", "context"]).reset_index(drop=True)
        rows = np.zeros((len(group), SPAN + LENGTH), np.uint16)
        for i, (raw, before) in enumerate(zip(group["bytes"], group["before"], strict=True)):
            rows[i, SPAN - before : SPAN - before + len(raw)] = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
        flags = repeated_starts(rows, LENGTH, SPAN + 1)
        out = []
        for i in np.flatnonzero(group["alone"].to_numpy() & flags.any(axis=1)).tolist():
            u, u2, place = group.at[i, "u"], group.at[i, "u2"], group.at[i, "place"]
            out += [(u, u2, place - SPAN + a, place - SPAN + b + LENGTH) for a, b in runs_of(flags[i])]
        return pd.DataFrame(out, columns=["u", "u2", "begin", "end"]).astype({"u": "int64", "u2": "int32", "begin": "int32", "end": "int32"})

    return strings.groupBy("shard").applyInPandas(run, RUNS)


def _by_hash(strings: DataFrame, used: list[DataFrame]) -> DataFrame:
    """The same for grams with many contexts: strings are counted by their hashes.

    Strings that start side by side are first counted together, as blocks: a block that occurs twice is repeated as
    a whole. Single strings are counted for the blocks that occur once, and for one of each of the others.
    """

    def windows(batches):
        hashes = [Rolling(s) for s in SEEDS]
        own = Rolling(SEEDS[0])
        for batch in batches:
            u, u2, place, before, alone, raws = (batch.column(i).to_pylist() for i in range(6))
            out = []
            for i in range(len(raws)):
                raw = np.frombuffer(raws[i], np.uint8)
                at = np.arange(len(raw) - LENGTH + 1)
                if not len(at):
                    continue
                grams = np.arange(len(raw) - GRAM + 1)
                keys = own.of(own.sums(raw), grams, grams + GRAM) >> np.uint64(20) << np.uint64(20) | grams.astype(np.uint64)
                anchor = least_of_each(keys, SPAN + 1) & np.uint64((1 << 20) - 1)
                at = at[anchor == before[i]]  # strings that have this anchor
                sums = [h.sums(raw) for h in hashes]
                a, b = (h.of(x, at, at + LENGTH).view(np.int64).tolist() for h, x in zip(hashes, sums, strict=True))
                # Blocks end at fixed distances from the anchor, so equal ones are cut alike.
                block = (before[i] - at) // BLOCK
                for k in np.unique(block).tolist():
                    own_at = np.flatnonzero(block == k)
                    lo, hi = own_at[0], own_at[-1] + 1
                    ends = at[lo : lo + 1], at[hi - 1 : hi] + LENGTH
                    ua, ub = (int(h.of(x, *ends).view(np.int64)[0]) for h, x in zip(hashes, sums, strict=True))
                    start = place[i] - before[i] + int(at[lo])
                    out.append((ua, ub ^ int(hi - lo), u[i], u2[i], start, alone[i], a[lo:hi], b[lo:hi]))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["ua", "ub", "u", "u2", "start", "alone", "a", "b"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    rows = strings.select("u", "u2", "place", "before", "alone", "bytes")
    rows = cut(rows.mapInArrow(windows, "ua long, ub long, u long, u2 int, start int, alone boolean, a array<long>, b array<long>"))
    where = F.struct("u", "u2", "start")
    blocks = rows.groupBy("ua", "ub").agg(F.min(F.struct("u", "u2", "start", "alone", "a", "b")).alias("x"), F.max(where).alias("y"))
    once = (F.col("x.u") == F.col("y.u")) & (F.col("x.u2") == F.col("y.u2")) & (F.col("x.start") == F.col("y.start"))
    blocks = cut(blocks.select("ua", "ub", once.alias("once"), "x.*"))
    repeated = cut(blocks.where("NOT once").select("ua", "ub"))
    whole = rows.where("alone").join(repeated, ["ua", "ub"], "left_semi")
    whole = whole.select("u", "u2", F.col("start").alias("begin"), (F.col("start") + F.size("a") - 1 + LENGTH).alias("end"))
    single = blocks.select("u", "u2", "start", (F.col("alone") & F.col("once")).alias("open"), F.posexplode(F.arrays_zip("a", "b")).alias("k", "h"))
    single = cut(single.select("h.a", "h.b", "u", "u2", (F.col("start") + F.col("k")).alias("start"), "open"))
    twice = single.groupBy("a", "b").agg(F.min(where).alias("x"), F.max(where).alias("y")).where("x <> y").select("a", "b")
    twice = cut(twice)
    used += [rows, repeated, single, twice]
    _discard(blocks)
    hit = single.where("open").join(twice, ["a", "b"], "left_semi")
    return whole.union(hit.select("u", "u2", F.col("start").alias("begin"), (F.col("start") + LENGTH).alias("end")))


def repeated_runs(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(u, u2, begin, end): runs of bytes that are covered by repeated strings, from ``docs`` (row_key, u, u2, text)."""
    anchored = cut(anchor_rows(docs))
    often = cut(anchored.groupBy("gram").count().where("count > 1").select("gram"))
    rows = cut(anchored.join(often, "gram", "left_semi"))
    _discard(anchored, often)
    where = F.struct("u", "u2", "place")
    contexts = rows.groupBy("gram", "context").agg(F.min(where).alias("x"), F.max(where).alias("y"))
    contexts = cut(contexts.select("gram", "context", "x", (F.col("x") == F.col("y")).alias("alone")))
    # Contexts that occur twice are repeated from end to end; the ends of a text are clipped below.
    whole = rows.join(contexts.where("NOT alone").select("gram", "context"), ["gram", "context"], "left_semi")
    whole = cut(whole.select("u", "u2", F.greatest(F.col("place") - SPAN, F.lit(0)).alias("begin"), (F.col("place") + LENGTH).alias("end")))
    _discard(rows)
    # The others are compared where their gram has another context.
    grams = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("any_alone"))
    grams = cut(grams.where("n > 1 AND any_alone").select("gram", "n"))
    wanted, n_strings = cut_counted(contexts.join(grams, "gram").select("x.*", "gram", "context", "alone"))
    _discard(contexts)
    n_shards = max(1, -(-n_strings // shard))
    used: list[DataFrame] = []
    strings = cut(_strings(docs, wanted, used).withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(n_shards))))
    _discard(wanted, *used)
    many = grams.where(F.col("n") > shard).select("gram")
    few = strings.join(many, "gram", "left_anti")
    used = [whole, grams, strings]
    found = cut(whole.union(_in_shards(few)).union(_by_hash(strings.join(many, "gram", "left_semi"), used)).distinct())
    _discard(*used)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", text_of().alias("text")).select("doc_id", *named(F.col("text")), "text")
    keyed = texts.select(F.xxhash64("doc_id").alias("row_key"), "u", "u2", "text")
    found = repeated_runs(keyed)
    runs = found.groupBy("u", "u2").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    copies = texts.groupBy("u", "u2").count().where("count > 1").select("u", "u2", F.lit(True).alias("copied"))
    known = cut(runs.join(copies, ["u", "u2"], "full"))
    _discard(found)
    known = known.select("u", "u2", F.coalesce("copied", F.lit(False)).alias("copied"), F.col("runs.begin").alias("begins"), F.col("runs.end").alias("ends"))
    rows = texts.join(known, ["u", "u2"], "left").select("doc_id", "text", "copied", "begins", "ends")

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, copied, begins, ends in zip(*batch.columns[1:], strict=True):
                raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                cover = np.zeros(len(raw) + 1, np.int64)
                if copied.as_py() and len(raw) >= LENGTH:
                    cover[0] = 1
                elif begins.is_valid:
                    edges = [np.minimum(x.values.to_numpy(), len(raw)) for x in (begins, ends)]
                    good = edges[1] - edges[0] >= LENGTH
                    np.add.at(cover, edges[0][good], 1)
                    np.add.at(cover, edges[1][good], -1)
                gone = np.cumsum(cover)[:-1] > 0
                n_bytes.append(len(raw))
                n_removed.append(int(gone.sum()))
                n_spans.append(len(runs_of(gone)))
                kept.append(raw[~gone].tobytes())
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
