"""Depth-first orders and workflows against plain searches."""

from __future__ import annotations

import random

import pytest

from tessella.operators import orders, workflows


def plain_search(nodes: dict[int, int | None], edges: list[tuple[int, int]]) -> tuple[list[int], dict[int, int]]:
    """Nodes in the order of a depth-first search, and the start from which each was reached."""
    below = {v: sorted({b for a, b in edges if a == v and b in nodes}) for v in nodes}
    order, root = [], {}

    def visit(v: int, start: int) -> None:
        if v not in root:
            root[v] = start
            order.append(v)
            for b in below[v]:
                visit(b, start)

    for v in sorted(nodes, key=lambda v: (nodes[v] is None, nodes[v] or 0, v)):
        visit(v, v)
    return order, root


def test_levels_and_walks_give_the_same_places(spark, monkeypatch):
    rng = random.Random(6)
    parent = {k: rng.choice([None, *range(k)]) for k in range(300)}
    depth = {}
    for k, p in parent.items():
        depth[k] = 0 if p is None else depth[p] + 1
    trees = spark.createDataFrame([(k, p, rng.choice([1, 2, orders.LAST]), k, depth[k]) for k, p in parent.items()], "node long, parent long, root_place long, root long, depth int")
    want = sorted(map(tuple, orders.preorder(trees.drop("depth"), 16).collect()))
    assert [p for _, p in sorted(want, key=lambda x: x[1])] == list(range(1, 301))
    tables = []
    monkeypatch.setattr(orders, "written", lambda df, name, write=orders.written: tables.append(name) or write(df, name))
    assert sorted(map(tuple, orders.preorder(trees, 16).collect())) == want and "arcs" not in tables
    monkeypatch.setattr(orders, "LEVELS", 0)
    assert sorted(map(tuple, orders.preorder(trees, 16).collect())) == want and "arcs" in tables
    assert orders.preorder(trees.limit(0), 16).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_forests_is_the_searchs_own(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(1000), 60)
    edges = [(rng.choice(names[max(0, k - 8) : k]), names[k]) for k in range(1, 60) if rng.random() < 0.85]
    nodes = {v: rng.choice([None, None, None, 1, 2]) for v in names}
    rows = spark.createDataFrame([*nodes.items(), *list(nodes.items())[:5], (None, 1)], "node long, place int")
    links = spark.createDataFrame([*edges, edges[0], (names[0], names[0]), (names[3], -1), (None, names[2])], "src long, dst long")
    got = [r.node for r in orders.clustered(rows, links, 4).orderBy("place").collect()]
    assert got == plain_search(nodes, edges)[0]


@pytest.mark.parametrize("seed", [3, 4])
def test_trees_of_graphs_with_cycles(spark, seed):
    rng = random.Random(seed)
    nodes = {v: rng.choice([None, None, None, None, 1]) for v in range(40)}
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    rows, links = spark.createDataFrame(list(nodes.items()), "node long, place int"), spark.createDataFrame(edges, "src long, dst long")
    trees = {r.node: r for r in orders.forest(rows, links).collect()}
    _, root = plain_search(nodes, edges)
    assert {v: r.root for v, r in trees.items()} == root
    assert all(r.parent is None or ((r.parent, v) in edges and trees[r.parent].depth == r.depth - 1) for v, r in trees.items())
    order = [r.node for r in orders.preorder(orders.forest(rows, links)).orderBy("place").collect()]
    assert sorted(order) == sorted(nodes)
    starts = [v for v in order if trees[v].parent is None]
    assert starts == sorted(starts, key=lambda v: (nodes[v] is None, nodes[v] or 0, v))


def test_deep_and_wide_trees(spark):
    """A node with 5,000 children, and a chain of 2,000 parent pointers: 14 rounds, not 2,000."""
    wide = spark.range(1, 5001).selectExpr("id AS node", "0L AS parent", "0L AS root_place", "0L AS root")
    chain = spark.range(6001, 8000).selectExpr("id AS node", "id - 1 AS parent", "0L AS root_place", "6000L AS root")
    roots = spark.createDataFrame([(0, None, 0, 0), (6000, None, 0, 6000)], "node long, parent long, root_place long, root long")
    got = [r.node for r in orders.preorder(wide.union(chain).union(roots), 512).orderBy("place").collect()]
    assert got == [*range(5001), *range(6000, 8000)]
    empty = spark.createDataFrame([], "node string, place int")
    assert orders.clustered(empty, spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0


def test_workflows_of_a_small_shop(spark):
    """A page's button calls a client function, which calls a route; its handler's calls are read back in order."""
    edges = [("click", "save", 1, "VERIFIED"), ("save", "post", 2, "VERIFIED"), ("other", "post", 1, "VERIFIED"), ("create", "check", 5, "VERIFIED"), ("create", "store", 3, "VERIFIED"),
        ("store", "insert", 1, "VERIFIED"), ("insert", "create", 1, "VERIFIED"), ("list", "guess", 1, "INFERRED"), ("list", "find", 2, "VERIFIED"), ("guess", "find", 1, "VERIFIED"), (None, "x", 1, "VERIFIED")]
    routes = [("POST /orders", "create"), ("POST /orders", "create"), ("GET /orders", "list"), ("GET /lost", None), (None, "create")]
    links = [("app:9", "save", "POST /orders"), ("app:9", "save", "POST /orders"), ("bare:1", None, "POST /orders"), ("app:7", "save", "GET /nowhere"), (None, "save", "GET /lost")]
    got = workflows.assemble(
        spark.createDataFrame(routes, "route string, entry string"), spark.createDataFrame(links, "call string, caller string, route string"),
        spark.createDataFrame(edges, "src string, dst string, ord long, status string"), spark.createDataFrame([("click",)], "node string"), 8, 8,
    )
    flows = {}
    for r in got.orderBy("place").collect():
        flows.setdefault((r.call, r.route, r.status), []).append((r.place, r.kind, r.node, r.step_status))
    sure = "VERIFIED"
    create = [("handler", "create"), ("step", "store"), ("step", "insert"), ("step", "check")]
    assert flows == {
        ("app:9", "POST /orders", sure): [(k + 1, *x, sure) for k, x in enumerate([("caller", "click"), ("caller", "save"), ("call", None), ("route", None), *create])],
        ("bare:1", "POST /orders", sure): [(k + 1, *x, sure) for k, x in enumerate([("call", None), ("route", None), *create])],
        (None, "GET /orders", "PARTIAL"): [(1, "route", None, sure), (2, "handler", "list", sure), (3, "step", "guess", "INFERRED"), (4, "step", "find", sure)],
        (None, "GET /lost", "PARTIAL"): [(1, "route", None, sure), (2, "handler", None, "UNKNOWN")],
    }


def test_workflows_of_empty_tables(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    got = workflows.assemble(empty("route long, entry long"), empty("call long, caller long, route long"), empty("src long, dst long, ord long, status string"), empty("node long"), 3, 3)
    assert got.count() == 0


def test_steps_of_random_calls(spark):
    """Steps by the fewest calls and the least way, against all ways written out."""
    rng = random.Random(9)
    edges = [(rng.randrange(15), rng.randrange(15), rng.randrange(4), rng.choice(["VERIFIED", "INFERRED"])) for _ in range(40)]
    rows = spark.createDataFrame(edges, "src long, dst long, ord long, status string")
    got = {}
    for r in workflows.walks(rows, spark.createDataFrame([(0,), (3,), (3,), (None,)], "entry long"), 4, 4).orderBy("step").collect():
        got.setdefault(r.entry, []).append((r.node, r.depth, r.open))
    for entry in (0, 3):
        best = {entry: (0, [(0, entry)], False)}
        front = {entry: [(0, entry)]}
        for k in range(1, 5):
            new = {}
            for v, way in front.items():
                for b in {b for a, b, _, _ in edges if a == v and a != b}:
                    here = [(o, s) for x, y, o, s in edges if (x, y) == (v, b)]
                    to = (way + [(min(o for o, _ in here), b)], all(s != "VERIFIED" for _, s in here))
                    if b not in best:
                        new[b] = min(new.get(b, to), to)
            best |= {b: (k, way, open_) for b, (way, open_) in new.items()}
            front = {b: way for b, (way, _) in new.items()}
        want = sorted(((way, v, k, open_) for v, (k, way, open_) in best.items()))
        assert got[entry] == [(v, k, open_) for _, v, k, open_ in want]
