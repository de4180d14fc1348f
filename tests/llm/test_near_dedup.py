"""The pipeline's near-duplicate stage against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np

import corpus_pipeline as pipeline
from tablewake.llm import near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_force(rows):
    """Indexes of the rows of smallest doc_id of each component."""
    sets = [plain_set(r[1]) for r in rows]
    linked = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)]
    root, before = list(range(len(rows))), None
    while root != before:
        before = list(root)
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return root


def edited(words, n):
    words = list(words)
    for at in random.sample(range(len(words)), n):
        words[at] = f"edit{random.randint(0, 10**6)}"
    return words


def stage(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], DOCS).repartition(3)
    return sorted(((r.doc_id, r.text) for r in pipeline.simhash_near_dedup(spark, docs, "").collect()), key=repr)


def test_edited_copies_equal_brute_force(spark):
    random.seed(3)
    word = lambda: f"w{random.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(12):
        base = [word() for _ in range(random.choice([8, 40, 150, 300]))] + passage * (i % 3 == 0)
        texts += [base] + [edited(base, n) for n in range(1, 1 + len(base) // 20)]
    chain = [word() for _ in range(200)]
    for _ in range(8):  # each is similar to the one before, the ends are not
        texts.append(chain)
        chain = edited(chain, 4)
    texts = [" ".join(t) for t in texts] + ["", " \n", "One two", "one  TWO", "one two three"]
    random.shuffle(texts)
    rows = list(enumerate(texts))
    root = brute_force(rows)
    want = sorted(((i, texts[i]) for i in range(len(texts)) if root[i] == i), key=repr)
    got = stage(spark, rows)
    assert got == want
    assert 5 < len(got) < len(texts) - 20
    assert stage(spark, []) == []


def test_prefix_is_long_enough():
    for n in range(1, 200):
        # A set of n shares at least ceil(0.8 n) with a similar one.
        assert n - near_dedup.prefix_length(n) + 1 == -(-8 * n // 10)


def test_rows_are_dropped_one_by_one(spark):
    random.seed(4)
    one, other = (" ".join(f"w{random.randint(0, 3000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, one), (7, one.upper()), (7, other), (None, one), (None, "a lone text"), (None, "a lone text"), (9, "z"), (9, "z")]
    assert stage(spark, rows) == sorted([(1, one), (7, other), (None, "a lone text"), (9, "z")], key=repr)


def test_signatures_never_rule_out_similar_sets():
    rng = np.random.default_rng(6)
    for n in (1, 5, 60, 700, 9000):
        for share in (0.0, 0.05, 0.15, 0.3, 0.9):
            x = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
            y = np.unique(np.concatenate([x[rng.random(len(x)) >= share], rng.integers(-(1 << 62), 1 << 62, int(n * share / 2))]))
            if len(y) and near_dedup.similar(x, y):
                assert near_dedup.may_be_similar(near_dedup.signature(x), near_dedup.signature(y))
    far = [near_dedup.signature(np.unique(rng.integers(-(1 << 62), 1 << 62, 800))) for _ in range(40)]
    assert not any(near_dedup.may_be_similar(a, b) for a, b in zip(far[:-1], far[1:]))


def test_a_passage_that_the_sample_missed_forms_few_pairs(spark, monkeypatch):
    random.seed(8)
    word = lambda: f"w{random.randint(0, 10**6)}"
    passage = [word() for _ in range(20)]
    base = [[word() for _ in range(60)] for _ in range(200)]
    texts = [t + passage for t in base] + [edited(t, 1) + passage for t in base[:30]] + [passage, passage[:-1]]
    texts = [" ".join(t) for t in texts]
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(near_dedup, "_frequent", lambda texts: (none, none))
    formed, across = [], near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda rows: formed.append(across(rows).count()) or across(rows))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    root = brute_force([(i, t) for i, t in enumerate(texts)])
    want = {(i, r) for i, r in enumerate(root) if i != r}
    assert len(want) >= 30
    got = near_dedup.components(near_dedup.links(rows)).collect()
    assert {(r.node, r.root) for r in got} == want
    assert sum(formed) < 10 * len(texts)  # all pairs of the list are 26,796


def test_ranked_prefixes_hold_what_similar_sets_share(spark):
    random.seed(9)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(50)]
    texts = [" ".join(t) for t in ([base] + [edited(base, 1) for _ in range(12)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    keys = {}
    for r in near_dedup.ranked(rows).collect():
        assert 0 <= r.place < near_dedup.prefix_length(r.n)
        keys.setdefault(r.node, set()).add(r.key)
    sets = [near_dedup.shingle_set(t) for t in texts]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if near_dedup.similar(x, y):
                assert keys[i] & keys[j]


def test_fingerprints_make_candidates(spark, monkeypatch):
    random.seed(10)
    texts = []
    for _ in range(20):
        base = [f"w{random.randint(0, 10**6)}" for _ in range(600)]
        texts += [" ".join(base), " ".join(edited(base, 1)), " ".join(base + ["end"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    monkeypatch.setattr(near_dedup, "prefixes", lambda texts: spark.createDataFrame([], "key long, node long, n int, place int"))
    prints = [near_dedup.simhash.fingerprint(t, near_dedup.SHINGLE) for t in texts]
    close = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert len(close) >= 20
    roots = {r.node: r.root for r in near_dedup.components(near_dedup.links(rows)).collect()}
    assert all(roots.get(i, i) == roots.get(j, j) for i, j in close)


def test_the_sample_grows_with_the_table(spark, monkeypatch):
    random.seed(11)
    word = lambda: f"w{random.randint(0, 10**6)}"
    passage = [word() for _ in range(8)]
    texts = [" ".join([word() for _ in range(6)] + passage * (i % 20 == 0)) for i in range(1_600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    monkeypatch.setattr(near_dedup, "SAMPLE", 4)
    hashes, counts = near_dedup._frequent(rows)  # 4 texts would hold the passage, of 80 texts, three times only by chance
    assert set(near_dedup.shingle_set(" ".join(passage)).tolist()) <= set(hashes.tolist())
    monkeypatch.setattr(near_dedup, "FREQUENT", 3)
    assert len(near_dedup._frequent(rows)[0]) <= 3


def moves(df, column):
    """How often rows with the column are dealt out anew in the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return len(re.findall(rf"\) Exchange\nInput \[\d+\]: \[[^\]]*\b{column}#", plan))


def test_whole_texts_move_once_and_whole_rows_once(spark, monkeypatch):
    random.seed(12)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(60)]
    rows = [(i, " ".join(edited(base, i % 3))) for i in range(8)] + [(None, "x"), (None, "x"), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], DOCS)
    seen, mapped = [], near_dedup._mapped
    monkeypatch.setattr(near_dedup, "_mapped", lambda rows, *a: seen.append(moves(rows, "text")) or mapped(rows, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dedup.keep_one(docs)
        assert seen and not any(seen)
        assert moves(kept, "row") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_one_number_are_numbered_anew(spark):
    docs = spark.createDataFrame([(i, f"text {i % 5}", "en", "s", 6) for i in range(10)], DOCS)
    texts = near_dedup.distinct_texts(docs, lambda key, salt: near_dedup._node(key, salt) * int(salt > 0))
    got = texts.collect()
    assert sorted((r.who.doc_id, r.text) for r in got) == [(i, f"text {i}") for i in range(5)]
    assert len({r.node for r in got}) == 5
