"""Mixing sources to target weights by the method of Sainte-Lague.

Each source has a target in words: a share of the whole by weight, held at a multiple of the
source's size, the excess going to the others by weight (water filling, in whole numbers). A
source's documents fall into shards of bounded size; each shard lays its documents out in a seeded
order and cuts the line of words into equal blocks. A shard's claim is its part of the target,
counted in blocks, and the blocks go to the highest quotients claim / (2k - 1): all quotients of
at least 1/2 win, which is the apportionment of as many blocks as win in all, and gives every shard
a whole number of blocks within half a block of its claim. The quota is taken in full passes
over the shard and then a run of blocks, around the end, from a seeded start; as the order is
seeded too, that run is a random part of the shard.

Nulls: a null text has size 0; a null source is a source of its own, after all others; a null
doc_id sorts first. Repeated rows are documents of their own, and equal ones are interchangeable.
Sources of size 0 have target 0. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewake.llm.common import SPACE, WORD, positions, table
from tablewake.sources.scratch import cut

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all sizes, as a fraction
CAP = 2  # times a source's size
BLOCK_WORDS = 16
DOCS_PER_SHARD = 2048
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(*parts: Column | str) -> Column:
    """60 bits of an MD5 over the parts as text."""
    texts = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size); weights repeat in order of source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = positions(per_source, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "n_docs", weight.cast("long").alias("weight"), F.col("position").alias("rank"))
    # Ordered by size over weight, those at their cap come first.
    unit = lcm(*weights)
    ratio = (F.col("source_size") * (F.lit(unit) / F.col("weight")).cast("long")).alias("ratio")
    line = cut(
        positions(
            ranked.select("*", ratio), F.col("ratio"), F.col("rank"), sums={"size_before": "source_size", "weight_before": "weight"}
        )
    )
    total = line.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    all_words, all_weights = total[0], total[1]
    up, down = share
    wide = lambda c: c.cast("decimal(19,0)")
    capped = wide(F.col("source_size") * down * cap) * wide(all_weights - F.col("weight_before")) <= wide(
        F.col("weight")
    ) * wide(F.lit(up * all_words) - F.col("size_before") * down * cap)
    line = line.withColumn("capped", capped)
    held = line.where("capped").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, free = up * all_words - down * cap * held[0], down * (all_weights - held[1])
    level = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(free or 1))
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(level)
    return cut(line.select("source", "source_size", "n_docs", target.alias("target")))


def mix(
    docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, block_words=BLOCK_WORDS, docs_per_shard=DOCS_PER_SHARD, seed=SEED
) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Columns: doc_id, source, text_hash, size, source_size, target, taken, shard, n_blocks, quota; ``passes``:
    how often the whole text is taken; ``ranges``: runs of its words (from, to) that are taken once more.
    """
    size = n_words(F.col("text")).alias("size")
    sizes = cut(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size))
    per_source = targets(sizes, weights, share, cap).withColumnRenamed("source", "its_source")
    rows = sizes.join(per_source, F.col("source").eqNullSafe(F.col("its_source")))
    shards = F.ceil(F.col("n_docs") / docs_per_shard)
    rows = rows.select(
        *sizes.columns,
        "source_size",
        "target",
        (hashed(str(seed), F.col("doc_id")) % shards).alias("shard"),
        hashed(str(seed), "order", F.col("doc_id")).alias("turn"),
    )
    shard = Window.partitionBy("source", "shard")
    turn = shard.orderBy("turn", F.col("doc_id").asc_nulls_first(), "size", "text_hash")
    rows = rows.select(
        "*",
        F.sum("size").over(shard).alias("words"),
        F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"),
    )
    words = F.col("words")
    blocks = F.when(words > 0, F.greatest(F.lit(1), F.floor(words / block_words + 0.5))).otherwise(0).cast("long")
    rows = rows.withColumn("n_blocks", blocks)
    quota = F.when(words > 0, F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)).otherwise(0)
    rows = rows.withColumn("quota", quota.cast("long"))
    n, some = F.col("n_blocks"), F.greatest(F.col("n_blocks"), F.lit(1))
    extra = F.col("quota") % some
    first = hashed(str(seed), "start", F.col("source"), F.col("shard")) % some
    word_at = lambda block: F.call_function("div", block * words, some)
    rows = rows.select(
        "*",
        F.call_function("div", F.col("quota"), some).alias("passes"),
        word_at(first).alias("from_1"),
        word_at(F.least(first + extra, n)).alias("to_1"),
        word_at(F.greatest(first + extra - n, F.lit(0))).alias("to_2"),
    )
    end = F.col("begin") + F.col("size")
    clip = lambda lo, hi: F.struct(
        (F.greatest(lo, F.col("begin")) - F.col("begin")).alias("from"), (F.least(hi, end) - F.col("begin")).alias("to")
    )
    both = F.array(clip(F.lit(0), F.col("to_2")), clip(F.col("from_1"), F.col("to_1")))
    rows = rows.withColumn("ranges", F.filter(both, lambda r: r["from"] < r["to"]))
    more = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])
    return rows.withColumn("taken", F.col("passes") * F.col("size") + more).drop(
        "turn", "words", "begin", "from_1", "to_1", "to_2"
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each text as often as it is taken whole, and each run of its words as a text.

    Columns are those of ``docs``; ``n_chars``, if there is one, follows the text. White space inside a run
    stays as it is in the text. Documents of which nothing is taken are left out; so are those without words.
    """
    number = Window.partitionBy("doc_id", "source", "text_hash").orderBy("doc_id")
    plan = mix(docs, **options).where("taken > 0").withColumn("copy_no", F.row_number().over(number))
    plan = plan.select(
        *(F.col(c).alias(f"its_{c}") for c in ("doc_id", "source", "text_hash", "copy_no")), "passes", "ranges"
    )
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("copy_no", F.row_number().over(number))
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in ("doc_id", "source", "text_hash", "copy_no")]
    rows = rows.join(plan, same[0] & same[1] & same[2] & same[3])
    text = F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(rf"{WORD}{SPACE}*"), F.lit(0))
    runs = F.transform("ranges", lambda r: F.array_join(F.slice(words, r["from"] + 1, r["to"] - r["from"]), ""))
    whole = F.when(F.col("passes") > 0, F.array_repeat(text, F.col("passes").cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("row", F.explode(F.concat(whole, runs)).alias("taken_text"))
    row = F.col("row").withField("text", F.col("taken_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("taken_text").cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sizes GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM per_source),
weighted AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
line AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0) AS s_before, coalesce(sum(w) OVER before, 0) AS w_before,
    sum(source_size) OVER () AS s_all, sum(w) OVER () AS w_all
  FROM weighted
  WINDOW before AS (ORDER BY source_size * (10 // w), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (
  SELECT *, 4 * source_size * (w_all - w_before) <= w * (3 * s_all - 4 * s_before) AS capped FROM line),
level AS (
  SELECT max(3 * s_all) - 4 * coalesce(sum(source_size) FILTER (capped), 0) AS rest,
    2 * (max(w_all) - coalesce(sum(w) FILTER (capped), 0)) AS free FROM held),
targets AS (
  SELECT source, source_size, n_docs,
    CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE w::DOUBLE * rest::DOUBLE / free::DOUBLE END AS target
  FROM held, level),
placed AS (
  SELECT s.*, source_size, target,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT
      % ceil(n_docs / {DOCS_PER_SHARD}.0)::BIGINT AS shard,
    ('0x' || substr(md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS turn
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY turn, doc_id NULLS FIRST, size, h
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
  FROM placed),
blocks AS (
  SELECT *, CASE WHEN words > 0 THEN greatest(1, floor(words / {BLOCK_WORDS}.0 + 0.5))::BIGINT ELSE 0 END AS n FROM laid),
quotas AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target * n / source_size + 0.5)::BIGINT ELSE 0 END AS quota,
    greatest(n, 1) AS m,
    ('0x' || substr(md5('{SEED}|start|' || coalesce(source, 'null') || '|' || shard), 1, 15))::BIGINT % greatest(n, 1) AS start
  FROM blocks),
runs AS (
  SELECT *, start * words // m AS a, least(start + quota % m, n) * words // m AS b,
    greatest(start + quota % m - n, 0) * words // m AS c FROM quotas)
SELECT doc_id, size, source_size, target,
  (quota // m * size + greatest(0, least(b, lo + size) - greatest(a, lo)) + greatest(0, least(c, lo + size) - lo))::BIGINT
    AS taken
FROM runs
"""
