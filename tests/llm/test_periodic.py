"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewake.llm import periodic

DOCS = "doc_id long, text string, runs string, collapsed string, period long, n_runs string"


def plain_runs(words, least=24):
    seen, out = set(), []
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            begin = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - begin >= max(least, 3 * p) and (begin, i + p) not in seen:
                seen.add((begin, i + p))
                out.append((begin, i + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng):
    letters, out = rng.choice([1, 2, 3, 50]), []
    for _ in range(rng.randint(1, 5)):
        base = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([5, 20, 80])))]
        x, y = [0], [0, 1]
        for _ in range(rng.randint(3, 9)):
            x, y = y, y + x
        out += rng.choice([base, (base * rng.randint(2, 8))[: rng.randint(1, 300)], (y * rng.randint(1, 4))[: rng.randint(1, 300)]])
    return (out[:60] * 4 if rng.random() < 0.3 else out)[:500]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 30))
def test_all_runs_of_structured_sequences(seed):
    words = sequence(random.Random(seed))
    assert periodic.periodic_runs(np.array(words)) == plain_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_all_runs_of_two_words(words):
    assert periodic.periodic_runs(np.array(words, np.int64)) == plain_runs(words)


def test_picked_positions_depend_on_their_context_only():
    rng = np.random.default_rng(2)
    part = rng.integers(0, 4, 200)
    words = np.concatenate([part, rng.integers(0, 4, 31), part])
    ids = periodic.mixed(words.astype(np.uint64))
    for width in (1, 2, 4):
        ids = periodic.doubled(ids, width)
    at = periodic.picked(ids, 8, [])
    inner = lambda start: {i - start for i in at if start <= i <= start + len(part) - 16}
    assert inner(0) == inner(231) and inner(0)


def test_digests_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "die", "é", "漢", "x1", "und"]
    texts = [None, "", " \n\t", "one", "x " * 24, "x " * 23, "long " * 40_000]
    texts += [" ".join(vocabulary[w % 7] for w in sequence(rng)) for _ in range(60)]
    rows = [(i, t, "r", "c", 1, "n") for i, t in enumerate(texts)] + [(9, texts[9], "r", "c", 1, "n")] * 2 + [(None, "y " * 30, "r", "c", 1, "n")]
    got = periodic.digests(spark.createDataFrame(rows, DOCS).repartition(3), plant=True)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = [(0, n, 1)] if len(set(words)) == 1 and n >= 24 else plain_runs(words) if n < 5000 else []
        best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
        dropped = {i for b, e, p in runs for i in range(b + p, e)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{b},{e - b},{p}\n" for b, e, p in runs)
        four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert periodic.digests(spark.createDataFrame([], DOCS)).count() == 0
