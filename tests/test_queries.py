"""Every registered query against its SQL in another engine, on the smallest tables; and small fixtures by hand."""

from __future__ import annotations

import math
import os

import pytest

from lodestone import plans, projections, registry
from lodestone.operators import graph, journal, risk

plans.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in projections.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return repr(round(float(x), 6))
    return str(x).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(projections.expand(registry.ORACLES[name]))
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("at_once", [0, 1000])
def test_coreness_of_a_path(spark, at_once):
    rows = [(f"n{i:04d}", f"n{i + 1:04d}", "textual", False) for i in range(1000 if at_once else 25)]
    got = graph.coreness(spark.createDataFrame(rows, "src string, dst string, confidence string, ruled_out boolean"), at_once=at_once).collect()
    assert len(got) == len(rows) + 1 and {r["coreness"] for r in got} == {1}


@pytest.mark.parametrize("at_once,n", [(0, 4), (1000, 70)])
def test_chain_of_cycles(spark, at_once, n):
    rows = [e for i in range(n) for e in ((f"a{i}", f"b{i}"), (f"b{i}", f"a{i}"), (f"b{i}", f"x{i}"), (f"x{i}", f"a{i + 1}"))]
    edges = spark.createDataFrame([(a, b, "formal", False) for a, b in rows], "src string, dst string, confidence string, ruled_out boolean")
    assert {r[0] for r in graph.cycles(edges, at_once=at_once).collect()} == {f"{x}{i}" for x in "ab" for i in range(n)}


def test_coreness_by_peeling(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (3, 5), (6, 6), (5, 2), (1, 7)]
    edges = spark.createDataFrame([(str(a), str(b), "textual", False) for a, b in pairs] + [("8", "9", "ambiguous", False)], "src string, dst string, confidence string, ruled_out boolean")
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        want[str(v)] = k
        for u in near.pop(v):
            near[u].discard(v)
    assert {r["node"]: r["coreness"] for r in graph.coreness(edges).collect()} == want
    assert {r["node"]: r["coreness"] for r in graph.coreness(edges, at_once=0).collect()} == want


def test_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("g", "h"), ("h", "g"), ("d", "g")]
    edges = spark.createDataFrame([(a, b, "formal", False) for a, b in pairs], "src string, dst string, confidence string, ruled_out boolean")
    for at_once in (0, 1000):
        assert sorted(r[0] for r in graph.cycles(edges, at_once=at_once).collect()) == ["a", "b", "c", "f", "g", "h"]


def test_ambiguous_edges_are_listed_but_not_followed(spark):
    edges = spark.createDataFrame([("a", "b", "ambiguous", False), ("b", "c", "formal", False), ("a", "d", "formal", False), ("d", "b", "formal", False)], "src string, dst string, confidence string, ruled_out boolean")
    got = {r["node"]: (r["depth"], r["sure"]) for r in graph.transitive(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"b": (1, True), "d": (1, True), "c": (3, True)}


def test_path_of_two_steps(spark):
    edges = spark.createDataFrame([("A", "B", "textual", False), ("B", "C", "textual", False)], "src string, dst string, confidence string, ruled_out boolean")
    got = {r["node"]: r["hops"] for r in graph.shortest_path_lengths(edges, spark.createDataFrame([("A",)], "node string")).collect()}
    assert got == {"A": 0, "B": 1, "C": 2}
    assert {r["coreness"] for r in graph.coreness(edges).collect()} == {1}


def test_touching_and_nested_symbols(spark):
    rows = [("p", "a", 1, 3), ("p", "b", 3, 5), ("q", "c", 1, 9), ("q", "d", 3, 5), ("r", "e", 2, 4), ("r", "f", 2, 3)]
    s = spark.createDataFrame(rows, "path string, qn string, line_start int, line_end int")
    assert sorted(r[0] for r in graph.boundary_ambiguous(s).collect()) == ["a", "b", "e", "f"]


def test_chain_breaks(spark):
    events = spark.createDataFrame([("x", i, f"p{i}") for i in range(5)], "chain string, seq long, payload string")
    ledger = journal.append_chain(events)
    assert journal.verify_chain(ledger).first()["first_break"] is None
    assert journal.verify_chain(ledger.where("seq != 2")).first()["first_break"] == 3
    bad = ledger.selectExpr("chain", "seq", "if(seq = 0, 'other', prev_hash) as prev_hash", "event_hash", "payload")
    assert tuple(journal.verify_chain(bad).first())[1:] == (0, "link")


def test_overlap_across_buckets(spark):
    h = spark.createDataFrame([("p", 60, 200)], "path string, new_start int, new_end int")
    s = spark.createDataFrame([("p", "a", 1, 60), ("p", "b", 1, 59), ("p", "c", 100, 300), ("p", "d", 201, 202)], "path string, qn string, line_start int, line_end int")
    assert sorted(r["qn"] for r in risk.overlaps(h, s).collect()) == ["a", "c"]
