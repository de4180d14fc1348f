"""The trie of rebuilt conversations against one made of tuples."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tablewake.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, place long, n string, h long, base long"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        turns.sort(key=lambda t: t[:2])
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = own.get(conv - int(math.fmod(conv, 20)), [])
        path = tuple(t[2:] for t in base[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    children = Counter(path[:-1] for path in members if path)
    saved, leaves = Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * len(WORD.findall(path[-1][1])) if path else 0
            leaves[path[:d]] += not children[path]
    return sorted(
        (
            (
                min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path],
                hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
            )
            for path, convs in members.items()
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for conv in [*range(140), -7, -20]:
        if conv == 20:
            continue
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            number = None if not turn and rng.random() < 0.2 else turn
            out.append((conv, number, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello there", "", None, "a b c"])))
    out += [(c, t, "user", f"x{t % 2}") for c, n in ((200, 120), (201, 110)) for t in range(n)]
    out += [(1000 + i, 0, "user", "same words") for i in range(800)]
    out += [(3000, 5, "user", "equal"), (3000, 5, "user", "equal"), (None, 0, "a", "b"), (3001, 0, "user", "long " * 30_000)]
    rng.shuffle(out)
    return out


def bag(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "n", 3, 4) for r in rows], TURNS).repartition(5)


def test_equal_to_brute_force_and_sql(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PAGE", 100)  # ends of one node come in many pages
    want = plain_trie(rows)
    assert bag(prefix_trie.trie(frame(spark, rows))) == want
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, db.sql(prefix_trie.OP13_SQL).select(*COLUMNS).fetchall()), key=repr) == want


def test_a_conversation_over_many_ranges(spark):
    rows = [(c, t, "user", f"w{t % 5}") for c in (1, 2) for t in range(400)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert bag(prefix_trie.trie(frame(spark, rows))) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_collisions_are_found(spark, rows, monkeypatch):
    few = [r for r in rows if r[0] is not None and r[0] < 60]
    # With base 1 a fingerprint is a sum: sequences of the same turns in another order collide, and the next bases are taken.
    monkeypatch.setattr(prefix_trie, "BASES", ((1, 1), prefix_trie.BASES[0]))
    few += [(c, t, "user", x) for c, texts in ((2000, "abcd"), (2020, "bacd"), (2040, "cdab")) for t, x in enumerate(texts * 2)]
    assert bag(prefix_trie.trie(frame(spark, few))) == plain_trie(few)
    monkeypatch.setattr(prefix_trie, "BASES", ((1, 1),))
    with pytest.raises(prefix_trie.Collision):
        prefix_trie.trie(frame(spark, few))


def test_no_conversations(spark):
    assert prefix_trie.trie(frame(spark, [])).count() == 0
    assert bag(prefix_trie.trie(frame(spark, [(1, 0, "user", "x")]))) == plain_trie([(1, 0, "user", "x")])
