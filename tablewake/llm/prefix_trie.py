"""The trie of conversations that share their first turns, by composable fingerprints.

A conversation's *rebuilt* turns are the first h turns of its base conversation and its own turns after its first h. Nobody
writes the rebuilt texts. A turn is the map v -> b v + x modulo a prime, x being a hash of its role and text; a sequence
of turns is the product of its maps, again such a map (H, B), and its fingerprint is H. For a base's head G of g turns and a
conversation's own products (H_k, B_k) after k turns, the product of the head and of own turns h .. k is

    H_k + (G - H_h) B_k / b^h,

so three numbers of different conversations give the fingerprint of each prefix of a rebuilt one. Two primes' worth of
fingerprint (61 bits each) name a prefix group. Each prefix row holds, besides, the key of its last turn and its parent's
fingerprint, and groups are checked through them: equal keys must belong to equal stored turns (role and text are compared
themselves), and within a group all last turns and all parents must be the same. By induction on the depth each group is then one
sequence. Otherwise everything is made again with other bases.

No group is held by a task: products run over range partitions of (conversation, turn), and the products of a
conversation's part in each range (a row for each range it reaches into) carry over; so one conversation may have any
number of turns. Sums over a subtree need no walk over the levels either: each node lays its share upon its smallest member's
row of that depth, sums run up each conversation's rows over range partitions, and a node adds up its members' rows.
The list of members that end at a node is hashed in order from pages of joined ids made in range partitions.

Rows without a conv_id belong to no conversation and are left out; a null role or text is empty; a null turn comes first; equal
turn numbers are ordered by their keys; equal rows are turns of their own. A conversation whose rebuilt sequence is
empty is a member of the root. An empty table has no nodes. Other columns are not read. Long texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewake.llm.common import WORD, table
from tablewake.sources.scratch import cut

PRIME = (1 << 61) - 1
HEADS = 4  # heads have 0 to HEADS - 1 turns
FAMILY = 20  # conversations that share a base
PAGE = 1 << 16  # bytes of joined ids in a page
BASES = ((0x1B873593CC9E2D51, 0x0C6EF372FE94F82B), (0x14A1B2C3D4E5F607, 0x1F83D9ABFB41BD6B), (0x05BE0CD19137E217, 0x1A54FF53A5F1D36F))


class Collision(Exception):
    """Different sequences have one fingerprint."""


def _times(a: Column, b: Column) -> Column:
    """The product of two numbers below the prime, modulo it."""
    wide = lambda c: c.cast("decimal(19,0)")
    return ((wide(a) * wide(b)) % F.lit(PRIME).cast("decimal(19,0)")).cast("bigint")


def _plus(*terms: Column) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = (total + term) % F.lit(PRIME)  # two numbers below 2^61
    return total


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, words, role, text) of each turn; (a, b) is the key of its role and text."""
    texts = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", F.length("text"), "role").alias("b")]
    return texts.select("conv_id", "turn", *key, F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"), "role", "text")


def check_keys(turns: DataFrame) -> None:
    """Equal keys must be those of equal turns."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)]
    other = turns.groupBy("a", "b").agg(*ends).where("min_role <> max_role OR min_text <> max_text")
    if not other.isEmpty():
        raise Collision("two stored turns have one key")


def own_products(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """Turns with ``place`` (from 0) and the products before them: h1, m1, h2, m2. Written in ranges."""

    def run(batches):
        conv, place, h1, m1, h2, m2 = None, 0, 0, 1, 0, 1
        b1, b2 = bases
        for batch in batches:
            out = []
            ids, a, b = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for c, x, y in zip(ids, a, b, strict=True):
                if c != conv:
                    conv, place, h1, m1, h2, m2 = c, 0, 0, 1, 0, 1
                out.append((place, h1, m1, h2, m2))
                h1, m1 = (h1 * b1 + x) % PRIME, m1 * b1 % PRIME
                h2, m2 = (h2 * b2 + y) % PRIME, m2 * b2 % PRIME
                place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in out], pa.int64()) for i in range(5))], names)

    names = ["conv_id", "a", "b", "words", "range_no", "place", "h1", "m1", "h2", "m2"]
    # Nulls sort first, so a null turn comes first.
    rows = turns.select("conv_id", "turn", "a", "b", "words").repartitionByRange("conv_id", "turn", "a", "b")
    rows = rows.withColumn("range_no", F.spark_partition_id()).sortWithinPartitions("conv_id", "turn", "a", "b")
    local = cut(rows.select("conv_id", "a", "b", "words", "range_no").mapInArrow(run, ", ".join(f"{n} {'int' if n == 'range_no' else 'bigint'}" for n in names)))

    # A conversation that reaches over several ranges: the product of all its earlier parts goes before.
    last = F.max(F.struct("place", "h1", "m1", "h2", "m2", "a", "b")).alias("last")
    parts = local.groupBy("conv_id", "range_no").agg(last, F.count(F.lit(1)).alias("n"))
    several = local.groupBy("conv_id").agg(F.min("range_no").alias("lo"), F.max("range_no").alias("hi")).where("lo <> hi").select("conv_id")
    parts = parts.join(several, "conv_id", "left_semi").select(
        "conv_id", "range_no", "n",
        *(_plus(_times(F.col(f"last.h{i}"), F.lit(bases[i - 1])), F.pmod(F.col(f"last.{x}"), F.lit(PRIME))).alias(f"p{i}") for i, x in ((1, "a"), (2, "b"))),
        *(_times(F.col(f"last.m{i}"), F.lit(bases[i - 1])).alias(f"q{i}") for i in (1, 2)),
    )
    carried = _carried(parts)
    joined = local.join(carried, ["conv_id", "range_no"], "left")
    part = lambda name, none: F.coalesce(name, F.lit(none))
    products = [
        c
        for i in (1, 2)
        for c in (
            _plus(_times(part(f"c{i}", 0), F.col(f"m{i}")), F.col(f"h{i}")).alias(f"h{i}"),
            _times(part(f"d{i}", 1), F.col(f"m{i}")).alias(f"m{i}"),
        )
    ]
    keys = [F.pmod(k, F.lit(PRIME)).alias(f"x{i}") for i, k in ((1, "a"), (2, "b"))]
    return joined.select("conv_id", "a", "b", "words", *keys, (F.col("place") + part("before", 0)).alias("place"), *products)


def _carried(parts: DataFrame) -> DataFrame:
    """For each part of a conversation, the product of the parts in the ranges before it: at most a row for each range."""

    def run(batches):
        conv, before, one, two = None, 0, (0, 1), (0, 1)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, before, one, two = row["conv_id"], 0, (0, 1), (0, 1)
                out.append((conv, row["range_no"], before, *one, *two))
                before += row["n"]
                one = ((one[0] * row["q1"] + row["p1"]) % PRIME, one[1] * row["q1"] % PRIME)
                two = ((two[0] * row["q2"] + row["p2"]) % PRIME, two[1] * row["q2"] % PRIME)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(7)], names)

    names = ["conv_id", "range_no", "before", "c1", "d1", "c2", "d2"]
    kinds = [pa.int32() if n == "range_no" else pa.int64() for n in names]
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "range_no")
    return rows.mapInArrow(run, ", ".join(f"{n} {'int' if n == 'range_no' else 'bigint'}" for n in names))


def prefix_rows(products: DataFrame, bases: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, n_turns) of all, and (conv_id, depth, f1, f2, up1, up2, a, b, words), a row for each turn."""
    heads = cut(products.where(F.col("place") < HEADS))
    convs = products.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", head_length(F.col("conv_id")))
    convs = cut(convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY))
    bound = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    after = [_plus(_times(F.col(f"h{i}"), F.lit(bases[i - 1])), F.col(f"x{i}")).alias(f"f{i}") for i in (1, 2)]
    ended = heads.select("conv_id", (F.col("place") + 1).alias("upto"), *after)

    # What a conversation takes over (g turns, product g1, g2) and what it drops of its own (o1, o2).
    info = convs.join(bound, "base", "left").withColumn("g", F.least("h", F.coalesce("n_base", F.lit(0))))
    of_base = ended.select(F.col("conv_id").alias("base"), F.col("upto").alias("g"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    of_own = ended.select("conv_id", F.col("upto").alias("h"), F.col("f1").alias("o1"), F.col("f2").alias("o2"))
    info = info.join(of_base, ["base", "g"], "left").join(of_own, ["conv_id", "h"], "left")
    info = cut(info.select("conv_id", "base", "n", "h", "g", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("g1", "g2", "o1", "o2"))))
    sizes = info.select("conv_id", (F.col("g") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n_turns"))

    head_rows = info.where("g > 0").select("conv_id", "base", "g").join(heads.withColumnRenamed("conv_id", "base"), "base").where("place < g")
    head_rows = head_rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), *after, F.col("h1").alias("up1"), F.col("h2").alias("up2"), "a", "b", "words"
    )
    own = products.join(info.select("conv_id", "h", "g", "g1", "g2", "o1", "o2"), "conv_id").where("place >= h")
    inverse = [[pow(b, -k, PRIME) for k in range(HEADS)] for b in bases]
    ups = []
    for i in (1, 2):
        moved = F.element_at(F.array(*map(F.lit, inverse[i - 1])), (F.col("h") + 1).cast("int"))
        change = F.pmod(F.col(f"g{i}") - F.col(f"o{i}"), F.lit(PRIME))
        ups.append(_plus(F.col(f"h{i}"), _times(change, _times(F.col(f"m{i}"), moved))).alias(f"up{i}"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("g") + 1).alias("depth"), *ups, "x1", "x2", "a", "b", "words")
    own = own.select(
        "conv_id", "depth", *(_plus(_times(F.col(f"up{i}"), F.lit(bases[i - 1])), F.col(f"x{i}")).alias(f"f{i}") for i in (1, 2)),
        "up1", "up2", "a", "b", "words",
    )
    return sizes, cut(head_rows.unionByName(own))


def _nodes(prefixes: DataFrame) -> DataFrame:
    """One row for each node below the root, after the check that each group is one sequence."""
    same = [f(c).alias(f"{f.__name__}_{c}") for c in ("up1", "up2", "a", "b") for f in (F.min, F.max)]
    groups = prefixes.groupBy("depth", "f1", "f2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *same
    )
    groups = cut(groups)
    if not groups.where(" OR ".join(f"min_{c} <> max_{c}" for c in ("up1", "up2", "a", "b"))).isEmpty():
        raise Collision("two sequences have one fingerprint")
    return groups.select("depth", "f1", "f2", F.col("min_up1").alias("up1"), F.col("min_up2").alias("up2"), "conv_id", "n_convs", "words")


def _subtree_sums(prefixes: DataFrame, shares: DataFrame) -> DataFrame:
    """(depth, f1, f2, n_leaves, saved_tokens): shares (conv_id, depth, leaf, saved) summed over each node's subtree."""
    none = [F.lit(0).cast("bigint").alias(c) for c in ("leaf", "saved")]
    rows = prefixes.select("conv_id", "depth", "f1", "f2", *none, F.lit(1).alias("late"))
    given = shares.select("conv_id", "depth", *(F.lit(None).cast("bigint").alias(c) for c in ("f1", "f2")), "leaf", "saved", F.lit(0).alias("late"))
    order = ["conv_id", F.desc("depth"), "late"]
    ranges = rows.unionByName(given).repartitionByRange(*order).withColumn("range_no", F.spark_partition_id())
    ranges = cut(ranges)
    inside = Window.partitionBy("conv_id", "range_no").orderBy(F.desc("depth"), "late").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.select("conv_id", "range_no", "depth", "f1", "f2", "late", *(F.sum(c).over(inside).alias(c) for c in ("leaf", "saved")))
    parts = ranges.groupBy("conv_id", "range_no").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    several = ranges.groupBy("conv_id").agg(F.min("range_no").alias("lo"), F.max("range_no").alias("hi")).where("lo <> hi").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = parts.join(several, "conv_id", "left_semi").select("conv_id", "range_no", *(F.sum(c).over(before).alias(f"{c}_before") for c in ("leaf", "saved")))
    sums = sums.where("late = 1").join(carried, ["conv_id", "range_no"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce(f"{c}_before", F.lit(0)))
    return sums.groupBy("depth", "f1", "f2").agg(total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"))


def joined_ids(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(*keys, ends_sha256): SHA-256 of each group's numbers, ascending and joined by commas.

    Ranges make pages of joined numbers; of a group with several pages one task reads just these, in order.
    """
    k = len(keys)

    def pages(batches) -> Iterator[pa.RecordBatch]:
        group, held, size, page = None, [], 0, 0
        out: list[tuple] = []

        def close() -> None:
            if held:
                out.append((*group, number, page, ",".join(held).encode()))

        number = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *own, value, number in zip(*columns, strict=True):
                if own != group or size > PAGE:
                    close()
                    page = page + 1 if own == group else 0
                    group, held, size = own, [], 0
                held.append(str(value))
                size += len(held[-1]) + 1
            yield as_batch(out)
            out.clear()
        close()
        if out:
            yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * k, pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], page_names)

    def hashes(batches) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = row[:k]
                if own != group:
                    if group is not None:
                        out.append((*group, state.hexdigest()))
                    group, state = own, hashlib.sha256(row[-1])
                else:
                    state.update(b"," + row[-1])
            yield digests(out)
            out.clear()
        if group is not None:
            yield digests([(*group, state.hexdigest())])

    def digests(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array([r[i] for r in out], pa.int64()) for i in range(k)), pa.array([r[k] for r in out], pa.string())], [*keys, "ends_sha256"]
        )

    page_names = [*keys, "range_no", "page", "ids"]
    sorted_rows = rows.select(*keys, item).repartitionByRange(*keys, item).withColumn("range_no", F.spark_partition_id())
    sorted_rows = sorted_rows.sortWithinPartitions(*keys, item)
    made = cut(sorted_rows.mapInArrow(pages, ", ".join(f"{n} bigint" for n in keys) + ", range_no int, page bigint, ids binary"))
    several = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages > 1").drop("n_pages")
    several = cut(several)
    one = made.join(several, keys, "left_anti").select(*keys, F.sha2("ids", 256).alias("ends_sha256"))
    more = made.join(several, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "range_no", "page")
    more = more.select(*keys, "ids").mapInArrow(hashes, ", ".join(f"{n} bigint" for n in keys) + ", ends_sha256 string")
    return one.unionByName(more)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored_turns(conversations)
    check_keys(turns)
    for bases in BASES:
        sizes, prefixes = prefix_rows(cut(own_products(turns, bases)), bases)
        try:
            nodes = _nodes(prefixes)
        except Collision:
            continue
        return _described(cut(sizes), prefixes, cut(nodes))
    raise Collision(f"{len(BASES)} pairs of bases")


def _described(sizes: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "conv_id", "n_convs", zero.alias("words"))
    known = cut(nodes.select("depth", "f1", "f2", "conv_id", "n_convs", "words").unionByName(root))
    ups = nodes.select((F.col("depth") - 1).alias("depth"), F.col("up1").alias("f1"), F.col("up2").alias("f2"))
    children = ups.groupBy("depth", "f1", "f2").agg(F.count(F.lit(1)).alias("n_children"))
    known = cut(known.join(children, ["depth", "f1", "f2"], "left").withColumn("n_children", F.coalesce("n_children", zero)))

    all_rows = prefixes.select("conv_id", "depth", "f1", "f2").unionByName(sizes.select("conv_id", *(zero.alias(c) for c in ("depth", "f1", "f2"))))
    leaf = (F.col("n_children") == 0).cast("bigint").alias("leaf")
    shares = known.select("conv_id", "depth", leaf, ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = _subtree_sums(all_rows, shares)

    last = prefixes.join(sizes.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"], "left_semi").select("conv_id", "depth", "f1", "f2")
    last = last.unionByName(sizes.where("n_turns = 0").select("conv_id", *(zero.alias(c) for c in ("depth", "f1", "f2"))))
    ends = joined_ids(last, ["depth", "f1", "f2"], "conv_id")

    # The only parent of nodes of depth 1 is the root: one row, so its children need no join that meets in one task.
    first = sizes.agg(F.min("conv_id")).first()[0]
    above = known.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("up1"), F.col("f2").alias("up2"), F.col("conv_id").alias("parent"))
    deep = nodes.where("depth > 1").join(above, ["depth", "up1", "up2"]).select("depth", "f1", "f2", "parent")
    named = nodes.where("depth = 1").select("depth", "f1", "f2", F.lit(first).cast("bigint").alias("parent")).unionByName(deep)
    key = ["depth", "f1", "f2"]
    rows = known.join(named, key, "left").join(sums, key, "left").join(ends, key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 of the id's decimal digits, bit by bit, since the engine has no such function.
OP13_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 0 AS bits, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, s, CASE WHEN bits = 8 THEN i + 1 ELSE i END, CASE WHEN bits = 8 THEN 0 ELSE bits + 1 END,
    CASE WHEN bits = 0 THEN (CASE WHEN xor(c, ascii(s[i + 1])) % 2 = 1 THEN xor(xor(c, ascii(s[i + 1])) // 2, 3988292384) ELSE xor(c, ascii(s[i + 1])) // 2 END)
         WHEN bits < 8 THEN (CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ELSE c END
  FROM crc WHERE i < length(s)
),
heads AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM crc WHERE i = length(s)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
keyed AS (SELECT conv_id, place, sha256(sha256(role) || sha256(text)) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns),
rebuilt AS (
  SELECT d.conv_id, 0 AS own, t.place, t.k, t.words FROM heads d JOIN keyed t ON t.conv_id = d.base AND t.place < d.h
  UNION ALL
  SELECT d.conv_id, 1, t.place, t.k, t.words FROM heads d JOIN keyed t ON t.conv_id = d.conv_id AND t.place >= d.h
),
placed AS (SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
    count(*) OVER (PARTITION BY conv_id) AS n FROM placed
),
members AS (
  SELECT conv_id, depth, path, path[1 : (depth - 1) * 64] AS up, words, depth = n AS ends FROM prefixes
  UNION ALL
  SELECT i.conv_id, 0, '', NULL, 0, p.conv_id IS NULL FROM ids i LEFT JOIN (SELECT DISTINCT conv_id FROM placed) p USING (conv_id)
),
nodes AS (
  SELECT depth, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY depth, path
),
children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
shares AS (
  SELECT n.conv_id, n.depth, (n.n_convs - 1) * n.words AS saved, CAST(c.path IS NULL AS INT) AS leaf
  FROM nodes n LEFT JOIN children c ON c.path = n.path
),
ups AS (
  SELECT m.depth, m.path, coalesce(sum(s.saved), 0) AS saved_tokens, coalesce(sum(s.leaf), 0) AS n_leaves
  FROM members m JOIN shares s ON s.conv_id = m.conv_id AND s.depth >= m.depth GROUP BY m.depth, m.path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  CAST(coalesce(u.n_leaves, 0) AS BIGINT) AS n_leaves, CAST(coalesce(u.saved_tokens, 0) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.up
LEFT JOIN children c ON c.path = n.path LEFT JOIN ups u ON u.depth = n.depth AND u.path = n.path
"""
