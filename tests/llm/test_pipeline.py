"""The stages of the pipeline on a small table: each does its work on what the one before kept."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tablewake.llm import mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(9)
    prose = lambda n: " ".join(random.choice(["the", "of", "and", "to", "house", "tree", "river"]) + random.choice(["", "s", f"x{random.randint(0, 999)}"]) for _ in range(n))
    shared = "A line of at least twenty letters that many share."
    texts = [f"{prose(60)}\n{shared}\n{prose(40)}" for _ in range(24)]
    texts += [texts[3], texts[3], "too short", "Q#$% " * 100, None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_in_order(spark, folder):
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mix", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, folder))
        after[name] = docs
        assert docs.columns[:5] == columns and (docs.columns == columns or name == "byte_bpe")
    ids = {name: sorted(r.doc_id for r in d.select("doc_id").collect()) for name, d in after.items()}
    assert ids["quality_rules"] == list(range(26))
    assert ids["line_dedup"] == list(range(26))
    holders = after["line_dedup"].where(F.contains("text", F.lit("twenty letters"))).collect()
    assert [r.doc_id for r in holders] == [25]
    # 24 equals 3; 25 kept the line that both lost and is still close to them or not, as its fingerprint says.
    assert set(range(24)) <= set(ids["simhash_near_dedup"]) and 24 not in ids["simhash_near_dedup"]
    mixed = mixing.mix(after["simhash_near_dedup"]).agg(F.sum("taken")).first()[0]
    assert after["source_mix"].agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == mixed
    assert after["byte_bpe"].where("NOT round_trip OR n_tokens < 1").count() == 0
    assert pipeline.run(spark, folder).count() == after["byte_bpe"].count()


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, folder))
        assert docs.count() == 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, its_id long, row_key string, n_lines long, n_dropped long, n_tokens long, token_ids string, decoded string, round_trip string, document string, row string, a long, id string"


def test_columns_of_any_name_pass_through_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [f.name for f in spark.createDataFrame([], CLASHING).schema.fields[5:]]
    values = [F.concat(F.lit(f"{name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(name) for name in extra]
    wide = docs.select("*", *values)
    for name, stage in pipeline.STAGES:
        before, wide = wide.columns, pipeline.cut(stage(spark, wide, folder))
        if name == "byte_bpe":
            assert sorted(wide.columns) == sorted(before)
            assert wide.where("NOT round_trip OR n_tokens <> size(token_ids)").count() == 0
            extra = [c for c in extra if c not in ("n_tokens", "token_ids", "round_trip")]
        else:
            assert wide.columns == before
        wrong = " OR ".join(f"{c} <> concat('{c} ', doc_id)" for c in extra)
        assert wide.count() > 0 and wide.where(wrong).count() == 0, name
