"""The corpus pipeline: quality rules, line dedup, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages documents are
written as Parquet and read again. All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm import bpe, line_dedup, mixing, near_dedup, quality
from tablewake.llm.common import table, text_of
from tablewake.sources.scratch import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    A null or empty text has no words and goes; repeated rows have one fate; an empty table stays empty.
    """
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that frequent keys lose.

    A null text becomes empty, one line; repeated rows, ties and long texts are as in ``line_dedup``. All rows and columns stay,
    whatever their names; an empty table stays empty.
    """
    carried = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("document"))
    rows = line_dedup.drop_lines(carried)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(changed.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    SimHash fingerprints over these shingles make the first candidates. They can't find all pairs of that similarity, so the rest is
    searched by prefixes of the texts' shingle sets; both are verified on the sets (``near_dedup``, which says what becomes of nulls,
    ties and repeated rows).
    """
    return near_dedup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole texts as often as they are taken, and the runs of words that are taken besides.

    A null source is a source of its own, the last; texts without words are never taken; repeated rows are separate documents; an
    empty table stays empty. Other columns, whatever their names, stay.
    """
    return mixing.apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens and whether decoding gives the text back.

    A null text becomes empty, without tokens. Columns of the documents with these three names are replaced; all others, and all
    rows, repeated ones included, stay; texts of any length are encoded whole; an empty table stays empty.
    """
    path = public_tokenizers.path(bpe.VOCABULARY)
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    carried = docs.select(text_of().alias("text"), F.struct(*(c for c in kept if c != "text")).alias("document"))
    rows = bpe.encode(carried, path, decoded=True)
    same = (F.col("decoded") == F.encode("text", "utf-8")).alias("round_trip")
    own = [F.col("text") if c == "text" else F.col("document").getField(c).alias(c) for c in kept]
    return rows.select(*own, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Shingle sets and tokens have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
