"""The walk against brute force on random graphs, and its independence of partitioning."""

from __future__ import annotations

import random

import pytest

from tablewake.operators.closure import edge_sides, readers, walk
from tablewake.operators.dependents import closure_rows


def same(a, b):
    return a[1] == b[1] and (a[0] is None or b[0] is None or a[0] == b[0])


def brute_force(edges, focus):
    """Rows (kind, hop, database, node) of one focus, straight from the definition."""
    reads = {(j, (d, t)) for j, way, d, t in edges if way == "read"}
    writes = {(j, (d, t)) for j, way, d, t in edges if way == "write"}
    placed, seen, frontier, hop, out = {focus}, set(), {focus}, 0, set()
    while frontier:
        hop += 1
        jobs = {j for j, key in reads if any(same(key, f) for f in frontier)} - seen
        if not jobs:
            break
        seen |= jobs
        out |= {("job", hop, None, j) for j in jobs}
        new = {k for j, k in writes if j in jobs and not any(same(k, p) for p in placed)}
        known = {t for d, t in new if d is not None}
        new = {k for k in new if k[0] is not None or k[1] not in known}
        out |= {("table", hop, *k) for k in new}
        placed |= new
        frontier = new
    return out


def random_edges(seed, n_jobs=25, n_tables=15, per_job=3):
    rng = random.Random(seed)
    databases = [None, "a", "b"]
    return [
        (f"j{j}", rng.choice(["read", "write"]), rng.choice(databases), f"t{rng.randrange(n_tables)}")
        for j in range(n_jobs) for _ in range(rng.randint(1, per_job))
    ]


def check(make, edges, foci, rows_per_salt=2_000_000):
    result = walk(edge_sides(make.edges(*edges), rows_per_salt), make.foci(*foci))
    got = {tuple(r) for r in closure_rows(result).collect()}
    want = {
        (d, t, kind, hop, db, node)
        for d, t in foci for kind, hop, db, node in brute_force(edges, (d, t))
    }
    # Column order of closure_rows: focus, kind, hop, database, node.
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(make, seed):
    edges = random_edges(seed)
    foci = [(d, f"t{i}") for i in range(15) for d in (None, "a", "b")]
    check(make, edges, foci)


def test_more_foci_than_one_block(make):
    edges = random_edges(7, n_jobs=40, n_tables=60)
    foci = [(d, f"t{i}") for i in range(60) for d in (None, "a", "b")]
    check(make, edges, foci)


def test_hot_keys_are_salted_without_changing_the_result(make):
    """Every job reads one table and one job writes many: both join keys are hot."""
    edges = [(f"j{i}", "read", None if i % 3 == 0 else "a", "hub") for i in range(30)]
    edges += [("j0", "write", "a", f"t{i}") for i in range(30)] + random_edges(3)
    foci = [("a", "hub"), ("b", "hub"), (None, "hub"), ("a", "t3")]
    check(make, edges, foci, rows_per_salt=4)


def test_partitioning_does_not_matter(spark, make):
    edges = random_edges(11)
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        result = walk(make.edges(*edges).repartition(3), make.foci(("a", "t1"), (None, "t2")))
        results.append({tuple(r) for r in closure_rows(result).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_order_and_repetition_do_not_matter(make):
    edges = random_edges(5)
    foci = make.foci(("a", "t1"))
    one = {tuple(r) for r in closure_rows(walk(make.edges(*edges), foci)).collect()}
    two = {tuple(r) for r in closure_rows(walk(make.edges(*(edges[::-1] + edges)), foci)).collect()}
    assert one == two


def test_max_hops(make):
    edges = [("j1", "read", "a", "t0"), ("j1", "write", "a", "t1"), ("j2", "read", "a", "t1"), ("j2", "write", "a", "t2")]
    result = walk(make.edges(*edges), make.foci(("a", "t0")), max_hops=1)
    assert {r.table_name for r in result.placed.where("hop > 0").collect()} == {"t1"}


@pytest.mark.parametrize("rows_per_salt", [4, 2_000_000])
def test_large_sides_are_clustered_and_hops_shuffle_no_edges(spark, make, rows_per_salt):
    edges = [(f"j{i}", "read", "a", "hub") for i in range(30)] + random_edges(3)
    foci = [("a", "hub"), (None, "t3")]
    result = walk(edge_sides(make.edges(*edges), rows_per_salt), make.foci(*foci), clustered_edges=0)
    want = {(d, t, kind, hop, db, node) for d, t in foci for kind, hop, db, node in brute_force(edges, (d, t))}
    assert {tuple(r) for r in closure_rows(result).collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = readers(result.placed, result.sides)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    edge_side = plan[plan.index("clustered_") - 600 : plan.index("clustered_")]
    assert "Exchange" not in edge_side
