"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least ``max(MIN_LENGTH, 3 q)`` words long, that no neighbouring
word extends. They are found in three steps, all linear in the text but for a logarithm:

* Periods below ``SMALL`` are read off directly: stretches in which words q apart are equal. These highly periodic regions
  are also what the synchronising sets leave out.
* At each scale t = 4, 8, 16, ... a position i is picked if the least hash among the t-word blocks that begin at i .. i + t,
  without those of a period up to t / 3, is that of the first or the last of them. Whether i is picked depends on its 2 t
  words only, so equal contexts are picked alike; and every run with a period p of 2 t <= p < 4 t has a picked position
  among its first p. That one and the one p later have equal contexts: all pairs of equal contexts at such distances are
  proposed. Equal contexts of picked positions are never closer than about t / 3, so a position is in few pairs.
* A proposed pair is extended to both sides on the words themselves. Stretches shorter than three periods go, as do those
  that have been found with a smaller period.

Block hashes are made by doubling, so a scale costs one pass and only the present scale's arrays are held: the memory is
some 100 bytes a word of the longest text. Each text is worked on by itself in an Arrow batch; there is no shuffle.

Nulls: a null text has no words, no runs and an empty collapsed text. A null doc_id is kept; its text is never rewritten
(:func:`planted`). Repeated rows give a row each, ties between runs go to the smaller start, then the smaller period, an
empty table gives no rows, and columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablewake.llm.common import table

MIN_LENGTH = 24
TIMES = 3  # periods in a run at least; the scales rest on it
SMALL = 8  # periods below are read off directly
BLOCK = 64  # words compared at first when a pair is extended
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

Run = tuple[int, int, int]  # first word, word after the last, period


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of blocks of twice the width."""
    return mixed(mixed(ids[:-width] + np.uint64(0x9E3779B97F4A7C15)) + ids[width:])


def stretches(words: np.ndarray, period: int, least: int) -> list[Run]:
    """Maximal stretches of at least ``least`` words in which words ``period`` apart are equal."""
    same = words[:-period] == words[period:]
    if np.count_nonzero(same) < least - period:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
    begins, ends = edges[::2], edges[1::2] + period
    long = ends - begins >= least
    return [(int(b), int(e), period) for b, e in zip(begins[long], ends[long], strict=True)]


def picked(ids: np.ndarray, width: int, periodic: list[Run]) -> np.ndarray:
    """The synchronising set of a scale: positions, from the hashes of blocks of ``width`` words (a power of two)."""
    ids = ids.copy()
    for begin, end, period in periodic:
        if period <= width // 3 and end - begin >= width:
            ids[begin : end - width + 1] = NONE
    least, held = ids, 1
    while held < width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    n = len(ids) - width
    least = np.minimum(least[:n], ids[width:])
    return np.flatnonzero(((least == ids[:n]) | (least == ids[width:])) & (least != NONE))


def proposals(at: np.ndarray, contexts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(distance, position) of pairs of picked positions with equal contexts, 2 to 4 widths apart."""
    order = np.lexsort((at, contexts))
    at, contexts = at[order], contexts[order]
    found = []
    for step in range(1, len(at)):
        apart = at[step:] - at[:-step]
        near = (contexts[step:] == contexts[:-step]) & (apart < 4 * width)
        if not near.any():
            break
        near &= apart >= 2 * width
        found += zip(apart[near].tolist(), at[:-step][near].tolist(), strict=True)
    return sorted(found)


def matching(x: np.ndarray, y: np.ndarray) -> int:
    """The length of the longest common prefix."""
    n, at, size = min(len(x), len(y)), 0, BLOCK
    while at < n:
        end = min(n, at + size)
        other = x[at:end] != y[at:end]
        if other.any():
            return at + int(other.argmax())
        at, size = end, 2 * size
    return n


def periodic_runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> list[Run]:
    """All runs of a sequence of numbered words, by start and period."""
    n = len(words)
    runs: dict[tuple[int, int], int] = {}
    periodic: list[Run] = []
    for period in range(1, min(SMALL, n // TIMES + 1)):
        regions = stretches(words, period, TIMES * period)
        periodic += regions
        for begin, end, _ in regions:
            if end - begin >= max(min_length, TIMES * period):
                runs.setdefault((begin, end), period)
    ids, width = mixed(words.astype(np.uint64)), 1
    while 2 * width * TIMES <= n:
        context = doubled(ids, width)
        if 2 * width >= SMALL:
            at = picked(ids, width, periodic)
            apart = covered = 0
            for distance, i in proposals(at, context[at], width):
                if distance == apart and i + distance < covered:
                    continue
                begin = i - matching(words[:i][::-1], words[: i + distance][::-1])
                end = i + distance + matching(words[i:], words[i + distance :])
                apart, covered = distance, end
                if end - begin >= max(min_length, TIMES * distance) and (begin, end) not in runs:
                    runs[begin, end] = distance
                    periodic.append((begin, end, distance))
        ids, width = context, 2 * width
    return sorted(((begin, end, period) for (begin, end), period in runs.items()), key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the query's contract gives every tenth document."""
    if doc_id is None or not words:
        return words
    rest, tenth = zlib.crc32(str(doc_id).encode()), 0
    rest, tenth = divmod(rest, 10)
    if tenth:
        return words
    start = rest % len(words)
    period = 1 + (len(words) - start) // (3 + rest % 8)
    return words[:start] + [words[start + i % period] for i in range(len(words) - start)]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The text without what each run repeats after its first period."""
    keep = np.ones(len(words), bool)
    for begin, end, period in runs:
        keep[begin + period : end] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()])


COLUMNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"


def find_runs(docs: DataFrame, plant: bool = False, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, runs, collapsed) for each row: its runs by start and period, and the words that stay, joined by a blank."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            found, texts = [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: the six ASCII spaces
                if plant:
                    words = planted(words, doc_id.as_py())
                runs = periodic_runs(numbered(words), min_length)
                found.append([{"start": b, "length": e - b, "period": p} for b, e, p in runs])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, run_type), pa.array(texts, pa.binary())], names)

    names = ["doc_id", "runs", "collapsed"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def digests(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The digest columns of the query, made from the rows of :func:`find_runs`."""

    def run(batches):
        for batch in batches:
            rows = []
            for runs, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                best = max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                rows.append(
                    {
                        "n_runs": len(runs),
                        **(best or dict.fromkeys(("start", "length", "period"))),
                        "exponent_milli": best and 1000 * best["length"] // best["period"],
                        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
                        "collapsed_sha256": hashlib.sha256(text.as_py()).hexdigest(),
                    }
                )
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *kinds])

    kinds = dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), pa.int64())
    kinds |= dict.fromkeys(("runs_sha256", "collapsed_sha256"), pa.string())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{n} {'bigint' if k == pa.int64() else 'string'}" for n, k in kinds.items())])
    return find_runs(docs, plant).mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), plant=True)
