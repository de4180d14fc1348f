"""The network's gradient, its states, what it learns, and the rows it gives."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tablewake.llm import langid

DOCS = "doc_id long, text string, lang string, source string, lang_pred string, score string, lang_spans string, held_out string, key string"


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    w = langid.new_weights(3, 5, 1, np.float64)
    segments, mask, labels = rng.integers(0, 256, (7, 4)), np.ones((7, 4)), np.array([0, 1, 2, 1])
    mask[4:, 1] = 0
    _, g = langid.gradients(w, segments, mask, labels)
    for name, x in w.items():
        for _ in range(8):
            at = tuple(int(rng.integers(s)) for s in x.shape)
            at = (*at[:2], int(segments[2, 3]), at[3]) if name == "E" else at
            old, losses = x[at], []
            for change in (1e-6, -1e-6):
                x[at] = old + change
                losses.append(langid.gradients(w, segments, mask, labels)[0])
            x[at] = old
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(g[name][at], abs=1e-7)


def plain_probabilities(w, raw):
    """Position by position, a segment at a time."""
    soft = lambda x: x / (1 + np.abs(x))
    out = []
    for at in range(0, len(raw), langid.SEGMENT):
        part, states = raw[at : at + langid.SEGMENT], []
        for d in (0, 1):
            h, own = np.zeros(w["U"].shape[-1]), []
            for b in part if d == 0 else part[::-1]:
                z, r = (0.5 + 0.5 * soft(w["E"][d, k, b] + h @ w["U"][d, k]) for k in (0, 1))
                n = soft(w["E"][d, 2, b] + r * (h @ w["U"][d, 2]))
                h = n + z * (h - n)
                own.append(h)
            states.append(own if d == 0 else own[::-1])
        for a, b in zip(*states, strict=True):
            e = np.exp(a @ w["V"][0] + b @ w["V"][1] + w["c"])
            out.append(e / e.sum())
    return np.array(out)


def test_every_byte_is_read(spark):
    model = langid.Model(["de", "en", "fr"], langid.new_weights(3, 8, 5))
    texts = ["a", "Wörter " * 100, "x" * 64, "é" * 33, "word " * 40_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    for row in langid.predict(docs, model, spans=True).collect():
        raw = texts[row.doc_id].encode()
        if len(raw) < 5000:
            p = plain_probabilities(model.weights, raw)
            assert row.score == pytest.approx(p.mean(axis=0).max(), rel=1e-4)
            assert row.lang_pred == model.languages[p.mean(axis=0).argmax()]
            labels = np.repeat([model.languages.index(s.lang) for s in row.lang_spans], [s.end - s.begin for s in row.lang_spans])
            assert (labels == p.argmax(axis=1)).mean() > 0.99
        assert row.lang_spans[0].begin == 0 and row.lang_spans[-1].end == len(raw)
        assert all(a.end == b.begin and a.lang != b.lang for a, b in zip(row.lang_spans, row.lang_spans[1:]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = {"de": ["der", "und", "schön", "nicht", "ich", "straße"], "en": ["the", "and", "of", "with", "this", "though"], "fr": ["le", "être", "une", "où", "qui", "très"]}
    extra = ("s", "l", "x", "y", "h", "k")
    out = []
    for i in range(300):
        lang = ("de", "en", "fr")[i % 3]
        out.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 60))), lang if i % 7 else None, *extra))
    out += [(900, None, "de", *extra), (901, "", "en", *extra), (902, "12 34 !?", "fr", *extra), (None, "the and of with this", "en", *extra), out[5], out[5]]
    return out


def test_held_out_accuracy_and_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    out = langid.predict(docs.withColumn("left_out", langid.remainder() == 2), model)
    assert sorted(out.columns) == sorted([*docs.columns, "left_out"])
    got = out.collect()
    assert len(got) == len(rows)
    truth = {i: ("de", "en", "fr")[i % 3] for i in range(300)}
    held = [r for r in got if r.left_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"]
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    other = docs.withColumn("lang", langid.F.when(langid.remainder() == 2, "zz").otherwise(langid.F.col("lang")))
    first, second = langid.fit(docs, steps=3), langid.fit(other, steps=3)
    assert first.languages == second.languages
    assert all((first.weights[k] == second.weights[k]).all() for k in first.weights)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOCS)
    model = langid.fit(empty)
    assert langid.predict(empty, model).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict(one, model).collect()] == [("und", 0.0)]
