"""Batches and selections in blocks against plain loops over each group."""

from __future__ import annotations

import random

import pytest

from tessella.operators import packing

GROUPS = ("a", "b", None)


def sizes(rng: random.Random, n: int) -> list[int | None]:
    return [rng.choice([None, 0, 1, 3, 7, 20, 60]) for _ in range(n)]


def plain_batches(items: list, most_size: int, most_items: int) -> list[int]:
    out, batch, total, n = [], 1, 0, 0
    for x in items:
        x = x or 0
        if n and (total + x > most_size or n >= most_items):
            batch, total, n = batch + 1, 0, 0
        total, n = total + x, n + 1
        out.append(batch)
    return out


def plain_budget(items: list, most_size: int, most_items: int, most_one: int, most_lines: int) -> list[str | None]:
    out, n, size, lines = [], 0, 0, 0
    for x, y in items:
        x, y = x or 0, y or 0
        why = "too_large" if x > most_one else "no_count" if n >= most_items else "no_size" if size + x > most_size else "no_lines" if lines + y > most_lines else None
        if not why:
            n, size, lines = n + 1, size + x, lines + y
        out.append(why)
    return out


@pytest.mark.parametrize("most_size,most_items,block", [(50, 5, 8), (15, 3, 4), (100_000, 7, 16), (0, 1, 1), (40, 9, 8192)])
def test_batches_in_blocks(spark, most_size, most_items, block):
    rng = random.Random(most_size)
    groups = {g: sizes(rng, n) for g, n in zip(GROUPS, (131, 1, 64), strict=True)}
    rows = [(g, k, x, "clash") for g, v in groups.items() for k, x in enumerate(v)]
    rng.shuffle(rows)
    got = packing.batches(spark.createDataFrame(rows, "g string, id long, size long, batch string"), ["g"], ["id"], "id", "size", most_size, most_items, block)
    assert got.columns == ["g", "id", "size", "batch"]
    want = {(g, k): (x, b) for g, v in groups.items() for k, (x, b) in enumerate(zip(v, plain_batches(v, most_size, most_items), strict=True))}
    assert {(r.g, r.id): (r["size"], r.batch) for r in got.collect()} == want


@pytest.mark.parametrize("most_size,most_items,block", [(50, 5, 8), (200, 40, 4), (60, 9, 1), (40, 9, 8192)])
def test_budgets_in_blocks(spark, most_size, most_items, block):
    rng = random.Random(most_size)
    groups = {g: [(x, rng.choice([None, 0, 1, 5])) for x in sizes(rng, n)] for g, n in zip(GROUPS, (90, 1, 37), strict=True)}
    rows = [(g, k, x, y, "clash") for g, v in groups.items() for k, (x, y) in enumerate(v)]
    rng.shuffle(rows)
    got = packing.budgeted(spark.createDataFrame(rows, "g string, id long, size long, lines long, reason string"), ["g"], ["id"], "id", "size", most_size, most_items, 20, "lines", 12, block)
    want = {(g, k): w for g, v in groups.items() for k, w in enumerate(plain_budget(v, most_size, most_items, 20, 12))}
    assert {(r.g, r.id): r.reason for r in got.collect()} == want


def test_budget_goes_on_far_behind(spark):
    """What fits lies many blocks apart, with blocks between that hold a small size and few lines, but not in one item."""
    rows = [(k, 9, 0) if k % 2 else (k, 1, 9) for k in range(200)] + [(300, 2, 2), (301, 3, 1)]
    got = packing.budgeted(spark.createDataFrame(rows, "id long, size long, lines long"), [], ["id"], "id", "size", 6, 5, 20, "lines", 5, 4)
    assert sorted(r.id for r in got.filter("reason IS NULL").collect()) == [300, 301]
    assert packing.batches(spark.createDataFrame([], "g string, id long, size long"), ["g"], ["id"], "id", "size", 5, 5).count() == 0
    assert packing.budgeted(spark.createDataFrame([], "g string, id long, size long"), ["g"], ["id"], "id", "size", 5, 5, 5).count() == 0


def test_one_group_is_many_tasks(spark):
    """A group of 300,000 items: equal to the loop, and no block holds more than its items."""
    rows = spark.range(300_000).selectExpr("id", "pmod(hash(id), 97) AS size")
    got = {r.id: r.batch for r in packing.batches(rows, [], ["id"], "id", "size", 400, 10).collect()}
    given = sorted((r.id, r["size"]) for r in rows.collect())
    assert [got[k] for k, _ in given] == plain_batches([x for _, x in given], 400, 10)
    placed = packing.numbered(rows, [], ["id"], 8192)
    assert placed.filter("_place <> id").count() == 0 and placed.groupBy("_block").count().agg({"count": "max"}).first()[0] == 8192
