"""Orders of dependencies, lists cut to fit, versions and reconciled knowledge, against plain forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import compare, graph, packing, reconcile, versions

CELLS = "kind string, id string, part string, item string, value string, status string"
STORE = CELLS + ", origin string, stale boolean, run string, version long"


def plain_layers(edges: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """node -> (component, layer), by reachability and longest paths."""
    nodes = {v for e in edges for v in e}
    after = {v: {b for a, b in edges if a == v and b != v} for v in nodes}
    reach = {}
    for v in nodes:
        seen, todo = set(), [v]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        reach[v] = seen
    part = {v: min({v} | {b for b in reach[v] if v in reach[b]}) for v in nodes}
    below = {c: {part[b] for v in nodes if part[v] == c for b in after[v]} - {c} for c in set(part.values())}
    layer: dict[int, int] = {}

    def at(c: int) -> int:
        if c not in layer:
            layer[c] = 1 + max((at(b) for b in below[c]), default=-1)
        return layer[c]

    return {v: (part[v], at(part[v])) for v in nodes}


@pytest.mark.parametrize("seed,n,m", [(1, 12, 14), (2, 30, 36), (3, 8, 30)])
def test_topological_order_of_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    got = {r.node: (r.component, r.layer) for r in graph.topological(spark.createDataFrame(edges + edges[:3], "src long, dst long")).collect()}
    assert got == plain_layers(edges)


def test_topological_order_of_odd_graphs(spark):
    chains = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (None, 7), (7, None)]
    got = {r.node: (r.component, r.layer) for r in graph.topological(spark.createDataFrame(chains, "src long, dst long")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 5: (4, 0), 6: (6, 0)}
    assert graph.topological(spark.createDataFrame([], "src string, dst string")).count() == 0
    names = graph.topological(spark.createDataFrame([("app", "lib"), ("lib", "base"), ("tool", "base")], "src string, dst string"))
    assert [r.node for r in names.orderBy("layer", "component").collect()] == ["base", "lib", "tool", "app"]


def test_the_longest_list_is_cut_first(spark):
    rng = random.Random(6)
    for budget in (0, 50, 400, 10_000):
        lists = {(g, p): [rng.choice([None, 1, 5, 9]) for _ in range(rng.choice([1, 7, 7, 40]))] for g in ("x", "y", None) for p in "abcd"}
        want = {}
        for g in ("x", "y", None):
            now = {p: list(v) for (h, p), v in lists.items() if h == g}
            cost = lambda: sum(c or 0 for v in now.values() for c in v)  # noqa: B023, E731
            while cost() > budget and any(now.values()):
                p = max(sorted(now), key=lambda k: len(now[k]))  # noqa: B023
                now[p] = now[p][: int(len(now[p]) * 0.7)]
            want |= {(g, p): len(v) for p, v in now.items()}
        rows = [(g, p, k + 1, c, "clash") for (g, p), v in lists.items() for k, c in enumerate(v)]
        got = packing.shrink(spark.createDataFrame(rows, "g string, p string, place int, cost long, n string"), "g", "p", "place", "cost", budget)
        assert {(r.g, r.p): r.kept for r in got.collect()} == want


def test_versions_follow_loads(spark):
    day = lambda k: F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp")
    load = lambda rows: spark.createDataFrame(rows, "k string, body string")
    store = versions.first_versions(load([("a", "Generated: 1\nx"), ("b", "one"), ("c", None), ("d", "stays")]), "k", "body", day(1))
    store = versions.next_versions(store, load([("a", "Generated: 2\nx"), ("b", "two"), ("c", None), ("e", "new"), ("e", "newer")]), "k", "body", day(2), close_missing=True)
    store = versions.next_versions(store, load([("a", "Generated: 2\nx\nGenerated: 3"), ("b", "one"), ("c", ""), ("d", "stays"), ("e", "new")]), "k", "body", day(3))
    got = sorted((r.k, r.version, r.body or "", r.valid_from.day, r.valid_to and r.valid_to.day) for r in store.collect())
    assert got == [
        ("a", 1, "Generated: 1\nx", 1, 3), ("a", 2, "Generated: 2\nx\nGenerated: 3", 3, None), ("b", 1, "one", 1, 2), ("b", 2, "two", 2, 3), ("b", 3, "one", 3, None),
        ("c", 1, "", 1, 3), ("c", 2, "", 3, None), ("d", 1, "stays", 1, 2), ("d", 2, "stays", 3, None), ("e", 1, "new", 2, None),
    ]


def test_reconciled_cells(spark):
    old = [
        ("file", "a", "purpose", None, "loads", "INFERRED", "AI", False, "r0", 3), ("file", "a", "claim", "c1", "x", "INFERRED", "AI", False, "r0", 3), ("file", "b", "purpose", None, "old", "VERIFIED", "AI", True, "r0", 1),
        ("entity", "T", "field", "id", "int", "VERIFIED", "SOURCE", False, "r0", 1), ("relationship", "Order>Item", "type", None, "has", "VERIFIED", "AI", False, "r0", 1), ("module", "m", "purpose", None, None, "INFERRED", "AI", False, "r0", 1),
    ]
    new = [
        ("file", "a", "purpose", None, "stores", "INFERRED"), ("file", "a", "claim", "c1", "y", "INFERRED"), ("file", "a", "claim", "c1", "z", "UNKNOWN"), ("file", "b", "purpose", None, "new", "INFERRED"),
        ("entity", "T", "field", "id", "text", "VERIFIED"), ("entity", "U", "field", "id", "int", "UNKNOWN"), ("entity", "V", "field", "id", "int", "VERIFIED"), ("relationship", "Item>Order", "type", None, "of", "VERIFIED"),
        ("module", "m", "purpose", None, "sells", "INFERRED"), ("file", "d", "purpose", None, None, "INFERRED"), ("file", "e", "purpose", None, "once", "VERIFIED"), ("file", "e", "purpose", None, "once", "VERIFIED"),
    ]
    cells = reconcile.reconcile(spark.createDataFrame(old, STORE), spark.createDataFrame(new, CELLS), "r1")
    got = {(r.kind, r.id, r.item): (r.value, r.status, r.origin, r.run, r.version, r.alternative, r.outcome) for r in cells.collect()}
    assert got == {
        ("file", "a", None): ("loads", "INFERRED", "AI", "r0", 4, "stores", "kept"), ("file", "a", "c1"): ("y", "INFERRED", "AI", "r1", 4, "x", "changed"), ("file", "b", None): ("new", "INFERRED", "AI", "r1", 2, "old", "changed"),
        ("entity", "T", "id"): ("int", "VERIFIED", "SOURCE", "r0", 1, "text", "conflict"), ("entity", "U", "id"): ("int", "UNKNOWN", "AI", "r1", None, None, "unverified"), ("entity", "V", "id"): ("int", "VERIFIED", "AI", "r1", 1, None, "added"),
        ("relationship", "Item>Order", None): ("has", "VERIFIED", "AI", "r0", 1, "of", "kept"), ("module", "m", None): ("sells", "INFERRED", "AI", "r1", 2, None, "changed"), ("file", "d", None): (None, "INFERRED", "AI", "r1", None, None, "unverified"),
        ("file", "e", None): ("once", "VERIFIED", "AI", "r1", 1, None, "added"),
    }
    assert {tuple(r) for r in reconcile.conflicts(cells).collect()} == {("entity", "T", "field", "id", "int", "text", "source wins")}
    again = reconcile.reconcile(reconcile.stored(cells), spark.createDataFrame(new, CELLS), "r2")
    assert {r.outcome for r in again.collect()} == {"kept", "conflict", "unverified"} and max(r.version or 0 for r in again.collect()) == 4
    assert reconcile.reconcile(spark.createDataFrame([], STORE), spark.createDataFrame([], CELLS), "r1").count() == 0


def test_claims_of_fields_relations_and_features(spark):
    known = spark.createDataFrame([("Order", "total_price", "decimal(9,2)"), ("Order", "note", None)], "entity string, field string, type string")
    claims = [("order", "totalPrice", "decimal"), ("Order", "total_price", "text"), ("Order", "note", "x"), ("Order", "ghost", "int"), ("Order", "seen_field", "int"), (None, None, None)]
    evidence = spark.createDataFrame([("Order", "seen_field", "class has SeenField: int"), ("Order", "ghost", "nothing"), ("Order", None, "x")], "entity string, field string, text string")
    got = {(r.entity, r.claimed_type, r.field): (r.type, r.status, r.basis, r.conflict) for r in reconcile.check_fields(spark.createDataFrame(claims, "entity string, field string, type string"), known, evidence).collect()}
    assert got == {
        ("order", "decimal", "total_price"): ("decimal(9,2)", "VERIFIED", "static analysis", False), ("Order", "text", "total_price"): ("decimal(9,2)", "VERIFIED", "static analysis", True),
        ("Order", "x", "note"): (None, "VERIFIED", "static analysis", False), ("Order", None, "ghost"): ("int", "UNKNOWN", None, False), ("Order", None, "seen_field"): ("int", "VERIFIED", "source text", False),
        (None, None, None): (None, "UNKNOWN", None, False),
    }
    links = spark.createDataFrame([("Order", "Item", "one-to-many")], "src string, dst string, type string")
    said = spark.createDataFrame([("item", "order", "many-to-one"), ("Order", "Item", "one-to-one"), ("Order", "User", "x"), ("Order", "Bin", "y")], "src string, dst string, type string")
    shown = spark.createDataFrame([("Order", "User", "the user of an order"), ("Order", "Bin", "order")], "src string, dst string, text string")
    got = {(r.dst, r.claimed_type): (r.src, r.type, r.status, r.conflict) for r in reconcile.check_relations(said, links, shown).collect()}
    assert got == {("Item", "many-to-one"): ("Order", "one-to-many", "VERIFIED", False), ("Item", "one-to-one"): ("Order", "one-to-many", "VERIFIED", True), ("User", None): ("Order", "x", "INFERRED", False), ("Bin", None): ("Order", "y", "UNKNOWN", False)}
    names = spark.createDataFrame([("shop", "sale.order"), ("shop", "id")], "module string, name string")
    rows = [("shop", "sales", "VERIFIED", ["the Sale_Order model"]), ("shop", "ids", "VERIFIED", ["id"]), ("shop", "free", None, None), ("none", "x", "VERIFIED", ["sale.order"]), ("shop", "whole", "VERIFIED", ["sale.order", "y"])]
    got = {r.feature: (r.status, r.matched) for r in reconcile.check_features(spark.createDataFrame(rows, "module string, feature string, status string, based_on array<string>"), names).collect()}
    assert got == {"sales": ("VERIFIED", ["the Sale_Order model"]), "ids": ("INFERRED", []), "free": ("INFERRED", []), "x": ("UNKNOWN", []), "whole": ("VERIFIED", ["sale.order"])}


def test_overlaps_of_sets(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xyz"), rng.choice(["k", "l"]), f"i{rng.randrange(40)}") for _ in range(150)] + [("w", "k", "i1"), (None, "k", "i1"), ("x", None, "i1"), ("x", "k", None)]
    got = {(r.category, r.a, r.b): (r.common, r.only_a, r.only_b) for r in compare.set_overlaps(spark.createDataFrame(rows, "o string, c string, i string"), "o", "c", "i").collect()}
    sets = {}
    for o, c, i in rows:
        if None not in (o, c, i):
            sets.setdefault((o, c), set()).add(i)
    want = {(c, a, b): (len(x & y), len(x - y), len(y - x)) for (a, c), x in sets.items() for (b, d), y in sets.items() if c == d and a < b}
    assert got == want
