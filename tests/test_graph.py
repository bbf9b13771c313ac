import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import graph as G
from graphloom.operators import links as L
from graphloom.operators import resolve as R


def reach(edges, a):
    seen, stack = set(), [a]
    while stack:
        x = stack.pop()
        for s, t in edges:
            if s == x and t not in seen:
                seen.add(t)
                stack.append(t)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_closure(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(20)}
    df = spark.createDataFrame(list(edges), "src_id int, dst_id int")
    far = {a: reach(edges, a) for a in range(14)}
    groups = {a: {b for b in range(14) if b in far[a] and a in far[b]} | {a} for a in range(14)}
    want = {a: min(g) for a, g in groups.items() if len(g) > 1}
    assert {x.id: x.component for x in G.strong_components(df).collect()} == want
    assert {(x.src_id, x.dst_id) for x in G.closure(df).collect()} == {(a, b) for a in far for b in far[a]}


def test_far_nodes_and_long_cycles_are_not_lost(spark, monkeypatch):
    monkeypatch.setattr(G.levels, "__defaults__", (False, 3))
    chain = [(i, i + 1) for i in range(7)]
    far = G.levels(spark.createDataFrame(chain, "src_id int, dst_id int"), spark.createDataFrame([(0,)], "id int"))
    assert {r.id: r.level for r in far.collect()} == {i: i for i in range(8)}
    ring = G.strong_components(spark.createDataFrame([*chain, (7, 0)], "src_id int, dst_id int"))
    assert {r.id: r.component for r in ring.collect()} == dict.fromkeys(range(8), 0)


def test_longest_levels_that_run_out_of_rounds_raise(spark):
    one = spark.createDataFrame([(0,)], "id int")
    chain = spark.createDataFrame([(i, i + 1) for i in range(3)], "src_id int, dst_id int")
    assert {r.id: r.level for r in G.levels(chain, one, longest=True, most=3).collect()} == {i: i for i in range(4)}
    with pytest.raises(ValueError, match="more than 3 steps"):
        G.levels(spark.createDataFrame([(0, 1), (1, 0)], "src_id int, dst_id int"), one, longest=True, most=3)


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src_id int, dst_id int")
    assert G.strong_components(none).count() == G.closure(none).count() == 0
    assert G.levels(none, spark.createDataFrame([(1,)], "id int")).collect() == [(1, 0)]


def test_inverse_and_degrees(spark):
    links = L.edges(spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "s string, t string"), "imports", "s", "t", F.lit(0))
    back = L.with_inverse(links).where("link_type = 'importedBy'")
    assert sorted((r.src_id, r.dst_id) for r in back.collect()) == [("b", "a"), ("b", "a"), ("c", "a")]
    assert {r.id: (r.n_out, r.n_in) for r in L.degrees(links).collect()} == {"a": (2, 0), "b": (0, 1), "c": (0, 1)}


def test_route_patterns(spark):
    calls = spark.createDataFrame([("/a/1/",), ("/a/1?x=/b",), ("/f/x/y/z",), ("/f",), ("/",), ("/a/1/2",)], "path string")
    routes = spark.createDataFrame([(0, "/a/:id"), (1, "/:x/:y"), (2, "/f/*rest"), (3, "/")], "ord int, pattern string")
    got = {r.path: r.pattern for r in R.match_routes(calls, routes).collect()}
    assert got == {"/a/1/": "/a/:id", "/a/1?x=/b": "/a/:id", "/f/x/y/z": "/f/*rest", "/f": None, "/": "/", "/a/1/2": None}


def test_globs():
    import re

    assert re.search(R.glob_regex("src/**/*.ts"), "src/a/b/c.ts") and re.search(R.glob_regex("src/**/*.ts"), "src/c.ts")
    assert not re.search(R.glob_regex("src/*.ts"), "src/a/c.ts") and not re.search(R.glob_regex("*.ts"), "axts")


def test_round_robin_and_dominant(spark):
    rows = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 10), ("y", 11)], "g string, n int")
    got = [(r.place, r.g, r.n) for r in A.round_robin(rows, "g", [F.col("n")], 4).orderBy("place").collect()]
    assert got == [(1, "x", 0), (2, "y", 10), (3, "x", 1), (4, "y", 11)]
    kinds = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "b"), ("k", "c"), ("z", "a"), ("z", "b")], "m string, v string")
    assert {r.m: r.dominant for r in A.dominant(kinds, "m", "v").collect()} == {"m": "a", "k": "c", "z": "mixed"}
