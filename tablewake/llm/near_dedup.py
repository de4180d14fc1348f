"""Near-duplicate texts of the pipeline: five-word shingles, Jaccard similarity of at least 0.8, exact.

A text is lower-cased (A-Z), cut into words and the set of its word shingles (a text of fewer words is one shingle;
texts without words are equal). Two texts link if their sets' Jaccard similarity is at least ``SIMILAR``. Candidates are
verified on whole sets, whatever finds them.

The first candidates come by SimHash: texts whose fingerprints over these shingles are equal or differ in at most two bits,
met in blocks of bits as in ``simhash``. That finds most lightly edited copies, and their components are known from then on.
Fingerprints cannot find the others: sets at 0.8 differ in some ten of 64 bits, and more by chance. These are searched by
prefix filter, which loses no link: put in one order for all texts, two such sets meet in the first ``n - ceil(0.8 n) + 1`` of
their n shingles. The order has shingles that a sample finds frequent last. Each text is listed under its prefix; texts of one
list are candidates unless their component, their sizes or the places of the shingle rule that out.

First each list's texts are compared with the list's first. Then, in lists that still hold several components, the
pairs across components are, so a group of near copies costs about as many pairs as it has texts. A list where these are
many (a passage that the sample missed) forms none: its texts are listed again, first in an order by a sample of them alone,
then, where lists stay long, in the order of exact counts among them, by which what a text has for itself comes first and
leaves little room in its prefix for what many share.

Of a component the row of the smallest doc_id stays (one without only if no other is there; then the smaller key of the
text); of equal rows one stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewake.llm import simhash
from tablewake.llm.common import text_key, text_of
from tablewake.llm.components import components
from tablewake.sources.scratch import cut, cut_counted, cut_grouped, discard

SHINGLE = 5
SEED = 42
SIMILAR = (4, 5)  # numerator, denominator
SAMPLE = 2_000  # texts, about, whose shingles are counted for the order at least: a share of them picked by hash
SHARE = 8  # one text in so many at least is counted: of a fixed number of texts, lists would grow with the table unnoticed
MOST_BUCKETS = 1 << 16  # of a signature
FULL = 65_535  # a bucket's count that says nothing
FREQUENT = 1_000_000  # shingles put last, at most; the choice changes the cost and not the links
MOST_PAIRS = 32  # pairs a text of a list that are formed at once; beyond, its texts are listed again in an exact order


def shingle_set(text: str | None) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII spaces
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1)) if words else np.zeros(1, np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else [len(line)]
    hash64 = xxhash.xxh64_intdigest
    hashes = (hash64(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), list(ends), strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, n).view(np.int64))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(x) + len(y) - both)


def prefix_length(n: int) -> int:
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def _mapped(rows: DataFrame, made: Callable, schema: str) -> DataFrame:
    """Rows that ``made`` gives, as lists of columns' arrays, for each (node, text)."""

    def run(batches):
        for batch in batches:
            parts = [made(node.as_py(), text.as_py()) for node, text in zip(*batch.columns, strict=True)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select("node", "text").mapInArrow(run, schema)


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and their counts in a sample of the texts: a table of bounded size."""
    part = min(SHARE, max(1, -(-texts.count() // SAMPLE)))
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(part)) == 0)

    def run(batches):
        for batch in batches:
            own = [shingle_set(t.as_py()) for t in batch.column(0)]
            h, n = np.unique(np.concatenate(own), return_counts=True)  # merged before the shuffle
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])

    counts = cut(sample.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("count")).where("count > 2"))
    least, room = 3, FREQUENT
    for count, n in sorted(map(tuple, counts.groupBy("count").count().collect()), reverse=True):
        room -= n
        if room < 0:
            least = count + 1
            break
    top = counts.where(F.col("count") >= least).toPandas().sort_values("h")
    discard(counts)
    return top["h"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, node, n, place): the shingles of each text's prefix, with the size of its set and their places in it."""
    known = texts.sparkSession.sparkContext.broadcast(_frequent(texts))

    def made(node, text):
        hashes, counts = known.value
        own = shingle_set(text)
        weight = np.zeros(len(own), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            weight = np.where(hashes[at] == own, counts[at], 0)
        n = prefix_length(len(own))
        first = own[np.lexsort((own, weight))[:n]]
        return first, np.full(n, node, np.int64), np.full(n, len(own), np.int32), np.arange(n, dtype=np.int32)

    return _mapped(texts, made, "key long, node long, n int, place int")


def _possible(x: str, y: str) -> Column:
    """Whether sizes, and the places of a shared shingle if it is the first, allow the similarity."""
    up, down = SIMILAR
    nx, ny = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    sizes = F.least(nx, ny) * down >= F.greatest(nx, ny) * up
    shared = F.least(nx - F.col(f"{x}.place"), ny - F.col(f"{y}.place"))
    return sizes & (shared * (up + down) >= (nx + ny) * up)


def signature(own: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of a number of buckets that grows with the set (some four a bucket)."""
    n = 64
    while n < MOST_BUCKETS and 4 * n < len(own):
        n *= 2
    return np.minimum(np.bincount(own & (n - 1), minlength=n), FULL).astype(np.uint16).tobytes()


def may_be_similar(x: bytes, y: bytes) -> bool:
    """Whether two signatures allow the similarity: sets share at most the smaller count of each bucket."""
    a, b = (np.frombuffer(s, np.uint16).astype(np.int64) for s in (x, y))
    if (a == FULL).any() or (b == FULL).any():
        return True
    n = min(len(a), len(b))
    most = np.minimum(a.reshape(-1, n).sum(axis=0), b.reshape(-1, n).sum(axis=0)).sum()
    return bool(most * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (a.sum() + b.sum()))


def _filtered(pairs: DataFrame, texts: DataFrame, made: Callable, good: Callable) -> DataFrame:
    """The pairs (a, b) for which ``good`` holds on what ``made`` gives for both texts' sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = texts.join(nodes, "node", "left_semi")
    each = cut(_mapped(wanted, lambda i, t: ([i], np.array([made(shingle_set(t))], object)), "node long, own binary"))
    rows = pairs.join(each.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    rows = rows.join(each.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")

    def run(batches):
        for batch in batches:
            both = zip(*(c.to_pylist() for c in batch.select(["x", "y"]).columns), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([good(*p) for p in both], pa.bool_()))

    found = cut(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    discard(each)
    return found


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that have the similarity. Most of the others go by signatures, a sixteenth of the sets in size."""
    possible = _filtered(pairs, texts, signature, may_be_similar)
    return _filtered(possible, texts, np.ndarray.tobytes, lambda x, y: similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)))


def ranked(texts: DataFrame) -> DataFrame:
    """Like ``prefixes``, in the order of how many of these texts hold a shingle; those held once are placed and left out."""

    def made(node, text):
        own = shingle_set(text)
        return own, np.full(len(own), node, np.int64), np.full(len(own), len(own), np.int32)

    each = cut(_mapped(texts, made, "key long, node long, n int"))
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    last_first = Window.partitionBy("node").orderBy(F.desc("held"), F.desc("key"))
    rows = each.join(held, "key").withColumn("place", F.col("n") - F.row_number().over(last_first))
    up, down = SIMILAR
    whole = F.col("n").cast("long")
    length = whole - F.ceil(whole * up / down) + 1
    found = cut(rows.where(F.col("place") < length).select("key", "node", "n", "place"))
    discard(each)
    return found


def _mixed(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of lists that hold several components, with the ``root`` of each and the pairs ``across`` them in its list."""
    placed = listed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = cut(placed.select("key", "node", "n", "place", "root"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("size"))
    lists = sizes.groupBy("key").agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("size")).alias("inside"))
    lists = lists.select("key", "all", ((F.col("all") * F.col("all") - F.col("inside")) / 2).alias("across")).where("across > 0")
    found = cut(placed.join(lists, "key"))
    discard(placed)
    return found


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in one list that may be similar."""
    pairs = rows.alias("x").join(rows.alias("y"), F.col("x.key") == F.col("y.key"))
    pairs = pairs.where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y"))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _by_fingerprints(texts: DataFrame) -> DataFrame:
    """Candidates (a, b) whose fingerprints are equal, or linked by blocks of bits: of equal ones each text with the first."""
    prints = cut(simhash.fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), SHINGLE).withColumnRenamed("doc_id", "node"))
    firsts = cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    equal = prints.join(firsts, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    first = lambda end: firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first"))
    near = simhash.links(firsts.select("fp")).join(first("a"), "a").join(first("b"), "b").select("a_first", "b_first")
    found = cut(equal.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    discard(prints)
    return found


def _shared(listed: DataFrame) -> DataFrame:
    """Rows of lists that hold several texts, with the list's ``first``.

    Rows are moved once, to their lists; nearly all lists have one text and go where they are counted.
    """
    own = Window.partitionBy("key")
    rows = listed.withColumns({"held": F.count(F.lit(1)).over(own), "first": F.min(F.struct("node", "n", "place")).over(own)})
    return cut(rows.where("held > 1").drop("held"))


def _with_firsts(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's first and another of its texts that may be similar and are not in one component."""
    rest = shared.alias("x").where(F.col("node") != F.col("first.node")).where(_possible("x", "first"))
    pairs = rest.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        placed = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(placed, end, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def links(texts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Links (a, b) that span the components of different texts (node, text)."""
    found = _verified(_by_fingerprints(texts), texts)
    roots = components(found)
    rest, tried, across = texts, [], []
    few = F.col("across") <= F.col("all") * most
    for _ in range(2):
        shared = _shared(prefixes(rest))
        tried.append(cut(_with_firsts(shared, roots)))
        found = found.union(_verified(tried[-1], texts))
        roots = components(found)
        left = _mixed(shared.select("key", "node", "n", "place"), roots)
        discard(shared)
        across.append(_across(left.where(few)))
        # Two texts that meet only in lists of many pairs are both in such a list, and meet again in their texts' own order.
        again, n = cut_counted(left.where(~few).select("node").distinct())
        if not n:
            break
        rest = cut(texts.join(again, "node", "left_semi"))
    else:
        across.append(_across(_mixed(ranked(rest), roots)))
    pairs = reduce(DataFrame.union, across).distinct()
    pairs = cut(pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"))
    return found.union(_verified(pairs, texts))


def _node(key: Column, salt: int) -> Column:
    """The number of a text, from its key: the same whenever a task is run again."""
    return F.xxhash64(F.lit(salt), key) if salt else key["a"]


def distinct_texts(docs: DataFrame, node: Callable = _node) -> DataFrame:
    """(node, who, text) for each text, clustered by node, so that texts move here only; ``who`` is its first row.

    Where two texts have one number, all are numbered anew.
    """
    keyed = docs.select("doc_id", text_of().alias("text"))
    keyed = keyed.select(F.isnull("doc_id").alias("unnamed"), "doc_id", text_key(F.col("text")).alias("key"), "text")
    who = F.min(F.struct("unnamed", "doc_id", "key")).alias("who")
    for salt in count():
        numbered = keyed.withColumn("node", node(F.col("key"), salt)).groupBy("node")
        one = (F.min("key") == F.max("key")).alias("one")
        texts = cut_grouped(numbered.agg(who, F.first("text").alias("text"), one), "node")
        if texts.where("NOT one").isEmpty():
            return texts.drop("one")
        discard(texts)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates."""
    texts = distinct_texts(docs)
    roots = components(links(texts))
    placed = texts.select("node", "who").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("who").alias("who"))
    named = lambda row: F.coalesce(row.cast("string"), F.lit("")).alias("row_id")
    key = lambda of: (of["a"].alias("row_a"), of["b"].alias("row_b"))
    stay = cut(placed.select(F.col("who.unnamed").alias("row_unnamed"), named(F.col("who.doc_id")), *key(F.col("who.key"))))
    discard(texts)
    # The documents' columns travel in one struct, so none of their names can clash with these.
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.isnull("doc_id").alias("row_unnamed"), named(F.col("doc_id")), *key(text_key(text_of()))
    )
    # Equal rows have equal keys; the others are alone with theirs. Keys have no nulls, so rows move once for both steps.
    same = ["row_unnamed", "row_id", "row_a", "row_b"]
    return rows.join(stay, same, "left_semi").dropDuplicates(same).select("row.*")
