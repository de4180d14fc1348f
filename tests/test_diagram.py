"""Join diagrams and lineage diagrams."""

from __future__ import annotations

from tablewake.operators import diagram

DS = '[{"Name":"ds","Type":"string"}]'


def test_join_diagram_rows_and_arrows(make, rows):
    foci = make.foci(("sales", "orders"))
    joins = make.joins(
        ("j1", "sales", "orders", "customer_id", None, "customers", "id"),
        ("j2", "sales", "orders", "customer_id", "crm", "customers", "id"),
        ("j1", "sales", "orders", "ds", None, "unknown", "day"),
        ("j1", "sales", "orders", "id", "sales", "orders", "parent_id"),
        ("j1", "x", "other", "a", "x", "another", "b"),
    )
    jobs = make.jobs(("j1", "glue", "one"), ("j2", "lambda", "two"))
    tables = make.tables(("sales", "orders", None, DS), ("crm", "customers"))
    assert rows(diagram.erd_rows(foci, joins, tables), "table_name", "is_partition", "column_name") == sorted(
        [
            ("orders", True, "ds"), ("orders", False, "customer_id"), ("orders", False, "id"),
            ("orders", False, "parent_id"), ("customers", False, "id"), ("unknown", False, "day"),
        ],
        key=repr,
    )
    arrows = diagram.erd_arrows(foci, joins, jobs, tables)
    assert rows(arrows, "left_key", "left_column", "right_key", "right_column", "jobs") == [
        ("sales.orders", "customer_id", "crm.customers", "id", "glue: one, lambda: two"),
        ("sales.orders", "ds", "unknown", "day", "glue: one"),
        ("sales.orders", "id", "sales.orders", "parent_id", "glue: one"),
    ]
    assert rows(diagram.erd_join_columns(foci, joins, tables), "table_name", "columns") == [
        ("customers", "id"), ("orders", "customer_id, id, parent_id"), ("unknown", "day"),
    ]


def test_join_diagram_of_a_lone_table(make, rows):
    foci, tables = make.foci(("sales", "orders")), make.tables(("sales", "orders", None, DS))
    assert rows(diagram.erd_rows(foci, make.joins(), tables), "table_name", "column_name") == [("orders", "ds")]
    assert diagram.erd_arrows(foci, make.joins(), make.jobs(), tables).count() == 0


CHAIN = [
    ("up2", "read", "a", "t0"), ("up2", "write", "a", "t1"),
    ("up1", "read", "a", "t1"), ("up1", "write", "a", "focus"),
    ("dn1", "read", "zzz", "focus"), ("dn1", "write", "a", "t3"),
    ("dn2", "read", "a", "t3"), ("dn2", "write", None, "t4"),
    ("dn3", "read", "a", "t4"), ("dn3", "write", "a", "t5"),
]


def layers(make, edges, depth=2, focus=("a", "focus")):
    dag = diagram.lineage_dag(make.edges(*edges), make.foci(focus), depth)
    return dag, {(r.layer, r.table_name) for r in diagram.dag_tables(dag).collect()}


def test_lineage_layers_and_depth(make):
    _, two = layers(make, CHAIN)
    assert two == {(-2, "t0"), (-1, "t1"), (0, "focus"), (1, "t3"), (2, "t4")}
    _, one = layers(make, CHAIN, depth=0)
    assert one == {(-1, "t1"), (0, "focus"), (1, "t3")}
    _, deep = layers(make, CHAIN, depth=9)
    assert (3, "t5") in deep


def test_lineage_arrows_and_databases(make, rows):
    dag, _ = layers(make, CHAIN)
    edges = make.edges(*CHAIN)
    tables = make.tables(("cat", "t4"), ("a", "focus"))
    arrows = diagram.dag_arrows(dag, make.jobs(("dn1", "glue", "down")), tables)
    assert rows(arrows, "source_key", "target_key", "jobs") == [
        ("a.focus", "a.t3", "glue: down"), ("a.t0", "a.t1", "up2"), ("a.t1", "a.focus", "up1"),
        ("a.t3", "cat.t4", "dn2"),
    ]


def test_down_walk_claims_shared_jobs_and_tables(make):
    """A job that reads and writes the focus belongs to the down walk only."""
    edges = [
        ("j1", "read", "a", "focus"), ("j1", "write", "a", "focus"), ("j1", "read", "a", "side"),
        ("j2", "read", "a", "out"), ("j2", "write", "a", "focus"), ("j1", "write", "a", "out"),
    ]
    _, found = layers(make, edges)
    assert found == {(0, "focus"), (1, "out")}


def test_lone_focus(make):
    _, found = layers(make, [("j", "read", "a", "x")])
    assert found == {(0, "focus")}


def test_job_flows(make, rows):
    edges = make.edges(
        ("j", "read", "a", "x"), ("j", "read", "b", "x"), ("j", "write", "a", "x"), ("j", "write", "a", "y")
    )
    assert rows(diagram.job_flows(edges)) == [("j", "x", "y")]


def test_job_flows_of_a_hot_job(make, rows):
    edges = [("hot", "read", "a", f"r{i}") for i in range(20)] + [("hot", "write", "a", f"w{i}") for i in range(3)]
    edges += [("cold", "read", "a", "r1"), ("cold", "write", "a", "w1")]
    flows = diagram.job_flows(make.edges(*edges), reads_per_salt=4)
    want = [("hot", f"r{i}", f"w{k}") for i in range(20) for k in range(3)] + [("cold", "r1", "w1")]
    assert rows(flows, "job_id", "source", "target") == sorted(want)


def test_clustered_and_salted_sides_give_the_same_diagram(spark, make, rows):
    edges = make.edges(
        *[(f"r{i}", "read", "d", "hub") for i in range(30)], *[(f"r{i}", "write", "d", f"t{i % 4}") for i in range(30)],
        *[("w", "write", "d", f"u{i}") for i in range(20)], ("w", "read", None, "t1"), ("up", "write", "d", "hub"), ("up", "read", "d", "raw"),
    )
    foci = make.foci(("d", "hub"), ("d", "t1"))
    plain = rows(diagram.dag_tables(diagram.lineage_dag(edges, foci)))
    dag = diagram.lineage_dag(edges, foci, clustered_edges=0, rows_per_salt=5)
    assert rows(diagram.dag_tables(dag)) == plain and len(plain) > 25
    tables, jobs = make.tables(("d", "hub")), make.jobs(("w", "glue", "wide"))
    assert rows(diagram.dag_arrows(dag, jobs, tables)) == rows(diagram.dag_arrows(diagram.lineage_dag(edges, foci), jobs, tables))


def test_a_hop_does_not_shuffle_clustered_edges(spark, make):
    edges = make.edges(("j", "read", "d", "a"), ("j", "write", "d", "b"))
    sides = diagram.Sides(diagram.edge_sides(edges), True, 10)
    level = spark.createDataFrame([(0, "a", 1)], "block long, table_name string, mask long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = sides.joined(level, "read", "table_name")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text


def test_arrows_of_many_foci_are_one_row_until_they_are_listed(make, rows):
    """Foci of one block that share an arrow share its row; keys differ by focus only where the focus is an end."""
    several = [f"a{i:02}" for i in range(20)]
    edges = make.edges(
        *(("j1", "read", "d", t) for t in several), ("j1", "write", "d", "m"), ("j2", "read", "d", "m"), ("j2", "write", "e", "z"),
        ("j2", "write", "c", "z"),
    )
    jobs, tables = make.jobs(("j2", "glue", "two")), make.tables(("d", "m"))
    foci = make.foci(*(("own", t) for t in several))
    dag = diagram.lineage_dag(edges, foci)
    arrows = diagram.dag_arrow_jobs(dag, jobs, tables)
    # 20 arrows of j1 from each table in its own database and as seen by the others, and the shared arrow of j2
    assert len(rows(arrows.where("label = 'glue: two'"))) == 1
    wanted = sorted(("own", t, "d.m", "c.z", 0, "glue: two") for t in several)
    found = diagram.dag_arrows(dag, jobs, tables)
    assert rows(found.where("jobs = 'glue: two'")) == wanted
    assert rows(found.where("source_key LIKE 'own%'")) == sorted(("own", t, f"own.{t}", "d.m", 0, "j1") for t in several)
    assert rows(diagram.dag_arrows(dag, jobs, tables, page=1)) == rows(found)


def test_clustered_diagrams_are_the_same(make, rows):
    edges = make.edges(
        ("j1", "read", "d", "a"), ("j1", "read", None, "a"), ("j1", "write", "d", "b"), ("j1", "write", "e", "b"), ("j2", "read", "d", "b"),
        ("j2", "write", None, "c"), ("j3", "read", "d", "x"), ("j3", "write", "d", "a"),
    )
    jobs, tables = make.jobs(("j1", "glue", "one")), make.tables(("f", "c"), ("g", "c"))
    foci = make.foci(("q", "a"), (None, "b"), ("d", None))
    plain, stored = (diagram.lineage_dag(edges, foci, clustered_edges=n) for n in (10**9, 0))
    assert rows(diagram.dag_arrows(plain, jobs, tables)) == rows(diagram.dag_arrows(stored, jobs, tables))
    both = [rows(diagram.diagram_databases(dag, tables).drop("focus")) for dag in (plain, stored)]
    assert both[0] == both[1]
    assert (None, 0, None) in both[0] and ("c", 2, "f") in both[0] and ("a", 0, "q") in both[0]
