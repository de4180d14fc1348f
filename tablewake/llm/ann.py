"""Approximate nearest neighbours by shifted Hilbert curves.

Equal vectors are one class, which keeps the smallest of its ids. For each of ``CURVES`` curves the unit vectors
are projected to ``DIMS`` random directions, shifted, cut into cells and keyed by the cells' place on a Hilbert
curve. Spark range-partitions all keys and numbers them, so that each class has a position on each curve.
A curve's positions are cut into runs of ``RUN``; a run also gets the ``REACH`` positions on either side. In a run
each query meets the classes within its reach, by cosine; the best of all curves are merged, scored
in double precision on the original vectors, and expanded to the ids of their classes. Small tables are searched
completely, as the reach covers them. Rows of one cell are ordered by a curve through the cell's own content, and rows of
one such cell by another (``LEVELS``), so a dense group is spread out as well; what is equal then is ordered by a hash
that differs from curve to curve. A window keeps all ties at its last place for the exact scores. After each ``CURVES`` curves the recall is measured against all vectors on up to
``SAMPLE`` queries; while it is below ``RECALL``, as many further curves are added, whatever the table's size.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Only
vectors of equal length meet. Rows that repeat an id and a vector count once; of several vectors
under one id each is a row of its own (a query's own id is never its neighbour). An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewake.llm.common import positions, table
from tablewake.sources.scratch import cut

NEAREST = 5
QUERY_EVERY = 50
CURVES = 24
DIMS = 7
CELL_BITS = 8
LEVELS = 3  # curves within cells; beyond 24 bits cosines in double precision do not differ
TIE = 1e-12
RUN = 4096
REACH = 1024
SEED = 23
SAMPLE = 256  # queries whose recall is measured
RECALL = 0.93  # on the sample, which leaves room for its error above 0.9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (integers below 2**bits) on a Hilbert curve, as a non-negative number.

    Works from the highest bit down: the bits of a level pick an orthant in Gray-code order, and the cells are
    reflected or swapped into that orthant's own orientation for the levels below.
    """
    x = cells.T.astype(np.uint64).copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = (one << np.uint64(level)) - one
        for d in range(dims):
            set_here = (x[d] >> np.uint64(level)) & one == one
            swap = np.where(set_here, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_here, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one == one, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curves: int, dims: int, bits: int, seed: int, start: int = 0) -> np.ndarray:
    """The keys of vectors (rows) on each curve (columns) at each level (last axis), from curve ``start`` on."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros((len(unit), curves, LEVELS), np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, start + c, vectors.shape[1]])
        axes = np.linalg.qr(rng.standard_normal((vectors.shape[1], min(dims, vectors.shape[1]))))[0]
        # A component of a random unit vector has a deviation of 1 / sqrt(length); four of them fill the cells.
        spread = 4 / np.sqrt(vectors.shape[1])
        shift = rng.uniform(0, 0.5, axes.shape[1])
        place = (unit @ axes / spread + 1) / 2 * 0.66 + shift * 0.66
        for level in range(LEVELS):
            cells = np.clip(place * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            out[:, c, level] = hilbert(cells, bits)
            place = place * (1 << bits) - cells
    return out


def unsigned_zero(vectors: DataFrame) -> Column:
    """The vectors, floats as they are and other numbers as doubles, with 0.0 for -0.0."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    return F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))


def classes(vectors: DataFrame, ids: int) -> DataFrame:
    """(class_id, length, vector, ids): different usable vectors with the smallest ``ids`` ids that have them."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), unsigned_zero(vectors).alias("vector"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.forall("vector", number) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("a", F.xxhash64("vector")).withColumn("b", F.xxhash64(F.lit(1), "vector"))
    # Partial limits keep a frequent vector from sending more than a few rows from each task.
    order = Window.partitionBy("a", "b").orderBy("id")
    firsts = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= ids)
    merged = firsts.groupBy("a", "b").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("id")).alias("ids"))
    return merged.select(F.struct("a", "b").alias("class_id"), F.size("vector").alias("length"), "vector", "ids")


def _placed(known: DataFrame, curves: int, dims: int, bits: int, seed: int, start: int) -> DataFrame:
    """(length, curve, keys, turn, class_id) of every class on every curve; ``turn`` orders equal keys."""

    def run(frames):
        for frame in frames:
            for length, group in frame.groupby("length"):
                keys = curve_keys(np.stack(group["vector"].to_numpy()).astype(np.float64), curves, dims, bits, seed, start)
                yield pd.DataFrame(
                    {
                        "length": np.int32(length),
                        "curve": np.tile(np.arange(start, start + curves, dtype=np.int32), len(group)),
                        **{f"key{i}": keys[:, :, i].ravel() for i in range(LEVELS)},
                        "a": np.repeat(group["a"].to_numpy(), curves),
                        "b": np.repeat(group["b"].to_numpy(), curves),
                    }
                )

    rows = known.select("length", "vector", "class_id.a", "class_id.b")
    keys = "".join(f"key{i} long, " for i in range(LEVELS))
    return rows.mapInPandas(run, f"length int, curve int, {keys}a long, b long").withColumn("turn", F.xxhash64("curve", "a", "b"))


def _met(
    known: DataFrame, asked: DataFrame, nearest: int, curves: int, dims: int, bits: int, run_length: int, reach: int, seed: int, start: int
) -> DataFrame:
    """(a, b, na, nb, score): the nearest classes that each asking class meets on ``curves`` curves from ``start`` on."""
    line = positions(cut(_placed(known, curves, dims, bits, seed, start)), *map(F.col, ("length", "curve", *(f"key{i}" for i in range(LEVELS)), "turn", "a", "b")))
    line = cut(line.select("length", "curve", "a", "b", "position"))
    # Positions run over all curves; a run holds places of one curve only where it matters: windows check the curve.
    lane = line.join(asked.withColumn("asks", F.lit(True)), ["a", "b"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    run = F.call_function("div", F.col("position"), F.lit(run_length))
    inside = F.col("position") % run_length
    runs = F.array_compact(
        F.array(
            run, F.when((inside < reach) & (run > 0), run - 1), F.when(inside >= run_length - reach, run + 1)
        )
    )
    lane = lane.withColumn("home", run).withColumn("run_no", F.explode(runs))
    lane = lane.join(known.select("class_id.a", "class_id.b", "vector"), ["a", "b"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position", kind="stable").reset_index(drop=True)
        found = []
        place, lane_of = group["position"].to_numpy(), (group["length"].to_numpy(np.int64) << 32) + group["curve"].to_numpy()
        a, b = group["a"].to_numpy(), group["b"].to_numpy()
        for one in np.unique(lane_of):
            rows = np.flatnonzero(lane_of == one)
            matrix = np.stack(group["vector"].to_numpy()[rows]).astype(np.float64)
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            home = (group["home"].to_numpy() == group["run_no"].to_numpy())[rows]
            for q in np.flatnonzero(group["asks"].to_numpy()[rows] & home):
                lo, hi = np.searchsorted(place[rows], [place[rows][q] - reach, place[rows][q] + reach + 1])
                scores = matrix[lo:hi] @ matrix[q]
                scores[q - lo] = -np.inf
                last = np.partition(scores, -nearest)[-nearest] if len(scores) > nearest else -np.inf
                best = np.flatnonzero((scores >= last - TIE) & np.isfinite(scores)) + lo
                found += [(a[rows[q]], b[rows[q]], a[rows[k]], b[rows[k]], scores[k - lo]) for k in best]
        ids = dict.fromkeys(["a", "b", "na", "nb"], "int64")
        return pd.DataFrame(found, columns=[*ids, "score"]).astype({**ids, "score": "float64"})

    pairs = lane.groupBy("run_no").applyInPandas(search, "a long, b long, na long, nb long, score double")
    return pairs.groupBy("a", "b", "na", "nb").agg(F.max("score").alias("score"))


def _best_scores(known: DataFrame, sample: DataFrame, nearest: int) -> dict:
    """The scores, best first, of the classes nearest to each class of a sample (bounded), by comparison with all."""
    asking = known.join(sample, [known["class_id.a"] == sample["a"], known["class_id.b"] == sample["b"]], "left_semi")
    asking = asking.select("length", "class_id.a", "class_id.b", "vector").toPandas()
    by_length = {}
    for length, group in asking.groupby("length"):
        q = np.stack(group["vector"].to_numpy()).astype(np.float64)
        by_length[length] = (group["a"].to_numpy(), group["b"].to_numpy(), q / np.linalg.norm(q, axis=1, keepdims=True))

    def compare(frames):
        for frame in frames:
            for length, group in frame.groupby("length"):
                if length not in by_length:
                    continue
                a, b, q = by_length[length]
                v = np.stack(group["vector"].to_numpy()).astype(np.float64)
                scores = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                scores[(a[:, None] == group["a"].to_numpy()) & (b[:, None] == group["b"].to_numpy())] = -np.inf
                best = -np.sort(-scores, axis=1)[:, :nearest]
                n = best.shape[1]
                out = pd.DataFrame({"a": np.repeat(a, n), "b": np.repeat(b, n), "score": best.ravel()})
                yield out[np.isfinite(out["score"])]

    rows = known.select("length", "class_id.a", "class_id.b", "vector").mapInPandas(compare, "a long, b long, score double")
    return _top(rows, nearest)


def _top(rows: DataFrame, nearest: int) -> dict:
    """The best scores of each class (a, b) of a bounded table."""
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score")))
    out: dict = {}
    for r in rows.select("a", "b", "score", place.alias("place")).where(F.col("place") <= nearest).orderBy("place").collect():
        out.setdefault((r.a, r.b), []).append(r.score)
    return out


def _recall(pairs: DataFrame, sample: DataFrame, best: dict, nearest: int) -> float:
    """The part of the best scores of a sample that ``pairs`` reach."""
    found = _top(pairs.join(sample, ["a", "b"], "left_semi"), nearest)
    hits = sum(score >= scores[-1] - 1e-9 for key, scores in best.items() for score in found.get(key, []))
    return hits / max(1, sum(map(len, best.values())))


def neighbours(
    vectors: DataFrame, every: int = QUERY_EVERY, nearest: int = NEAREST, curves: int = CURVES, dims: int = DIMS,
    bits: int = CELL_BITS, run_length: int = RUN, reach: int = REACH, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found for each id that ``every`` divides, from (vec_id, embedding)."""
    known = cut(classes(vectors, nearest + 1))
    asking = vectors.select(F.col("vec_id").cast("long").alias("query_id"), unsigned_zero(vectors).alias("v"))
    asking = asking.where(F.col("query_id") % every == 0)
    asking = asking.select("query_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")).distinct()
    asked = cut(asking.select("a", "b").distinct())
    sample = cut(asked.orderBy(F.xxhash64("a"), "a", "b").limit(SAMPLE))
    best_scores = _best_scores(known, sample, nearest)
    pairs, start = None, 0
    while pairs is None or _recall(pairs, sample, best_scores, nearest) < (RECALL if best_scores else 0):
        more = _met(known, asked, nearest, curves, dims, bits, run_length, reach, seed, start)
        pairs = cut(more if pairs is None else pairs.union(more).groupBy("a", "b", "na", "nb").agg(F.max("score").alias("score")))
        start += curves
    pairs = pairs.drop("score")
    # A class is its own neighbour when it has several ids.
    pairs = cut(pairs.union(asked.select("a", "b", F.col("a").alias("na"), F.col("b").alias("nb"))))
    one = known.select("class_id.a", "class_id.b", F.col("vector").alias("q"))
    other = known.select(F.col("class_id.a").alias("na"), F.col("class_id.b").alias("nb"), F.col("vector").alias("v"), "ids")
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    dot = lambda x, y: total(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")))
    scored = pairs.join(one, ["a", "b"]).join(other, ["na", "nb"])
    cosine = dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))
    scored = scored.select("a", "b", cosine.alias("score"), F.explode("ids").alias("vec_id"))
    # The best of a class of queries, one more than asked for, as a query drops its own id.
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= nearest + 1)
    answers = asking.join(cut(scored.select("a", "b", "score", "vec_id")), ["a", "b"]).where("query_id <> vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
