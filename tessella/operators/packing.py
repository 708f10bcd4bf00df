"""Batches by budget, and selections that skip what does not fit: sequences over ordered items, dealt in blocks.

When a batch ends depends on where it began, so a window cannot say it. The items of a group are numbered and dealt in blocks of
``BLOCK`` consecutive ones, and a task takes a block, never a group. What a block does is a function of the state in which
it is entered: batches know it by the place in the block where the first of them begins (fewer than the items of a
batch), so every block's function is a short table, tables of neighbours are composed by doubling, and each block is then
done by itself. A selection changes its state only by what it keeps, which is few; rounds look for the next block with an item that
still fits.

Defined results for odd input: a null or negative size counts as 0, sizes are whole; ties in the order go by item, then by
size; a null group is a group; repeated rows are items of their own; no items give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessella.functions.text import token_estimate
from tessella.sources.scratch import written

#: Items of a block.
BLOCK = 8192
#: A size that no item has.
ENDLESS = 1 << 62


def numbered(rows: DataFrame, group: list[str], order: list[str], block: int) -> DataFrame:
    """The rows, written down, with ``_key`` (the group), ``_place`` from 0 in its order and ``_block``.

    Rows are dealt by ranges of (group, order) and counted a range, so that the numbers of a large group come from many tasks.
    """
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("_"))
    dealt = rows.withColumn("_key", key)
    dealt = written(dealt.repartitionByRange("_key", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_key", "_range").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_key", "_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_key", "_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_within", within).join(first, ["_key", "_range"]).withColumn("_place", (F.col("_within") + F.col("_first")).cast("long"))
    return written(placed.withColumn("_block", F.floor(F.col("_place") / block).cast("long")).drop("_range", "_within", "_first"), "numbered")


def whole(size: str | None) -> Column:
    return F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0)) if size else F.lit(0).cast("long")


def _values(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _ends(x: np.ndarray, most_size: int, most_items: int) -> np.ndarray:
    """Where the batch that begins at each item ends: behind the last item that fits, at least one."""
    sums = np.concatenate(([0], np.cumsum(x)))
    at = np.arange(len(x))
    return np.maximum(at + 1, np.minimum(at + most_items, np.searchsorted(sums, sums[:-1] + most_size, "right") - 1))


def _by_block(rows: DataFrame, fields: list[StructField], run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``run`` on each block's rows in order."""

    def sort(table: pa.Table) -> pa.Table:
        return run(table.sort_by("_place"))

    return rows.groupBy("_key", "_block").applyInArrow(sort, StructType(fields))


def batches(rows: DataFrame, group: list[str], order: list[str], item: str, size: str, most_size: int, most_items: int, block: int = BLOCK) -> DataFrame:
    """Greedy batches in order: a new one starts when the next item would pass a limit; an oversize item is alone."""
    block = max(block, most_items)
    needed = list(dict.fromkeys([*group, *order, item, size]))
    items = numbered(rows.select(*needed, whole(size).alias("_x")), group, list(dict.fromkeys([*order, item, size])), block)
    kinds = {f.name: f for f in items.schema.fields}
    last = items.agg(F.max("_block")).first()[0] or 0
    entered = items.filter("_place = 0").select("_key", "_block", F.lit(0).cast("long").alias("_entry"), F.lit(0).cast("long").alias("_before"))

    def through(table: pa.Table) -> pa.Table:
        """For each place at which the block may be entered: the place in the next block at which it is left, and batches begun."""
        own = _values(table, "_place") < (table.column("_home")[0].as_py() + 1) * block
        n, x = int(own.sum()), _values(table, "_x")
        to = np.arange(n + most_items)
        to[:n] = _ends(x, most_size, most_items)[:n]
        begun = (np.arange(len(to)) < n).astype(np.int64)
        while (to[:n] < n).any():
            begun, to = begun + begun[to], to[to]
        entries = min(most_items, n)
        return pa.table({
            "_key": table.column("_key").slice(0, 1).take(pa.array([0] * entries)), "_from": pa.array([table.column("_home")[0].as_py()] * entries, pa.int64()),
            "_at": pa.array(np.arange(entries)), "_to": pa.array([table.column("_home")[0].as_py() + 1] * entries, pa.int64()), "_exit": pa.array(to[:entries] - n), "_begun": pa.array(begun[:entries]),
        })

    if last:
        # Items that the last batches of a block may reach into go to the block before as well.
        homes = F.when((F.col("_block") > 0) & (F.col("_place") % block < most_items), F.array(F.col("_block"), F.col("_block") - 1)).otherwise(F.array("_block"))
        lent = items.select("_key", "_x", "_place", F.explode(homes).alias("_home")).withColumn("_block", F.col("_home"))
        names = ("_from", "_at", "_to", "_exit", "_begun")
        jump = written(_by_block(lent, [kinds["_key"], *[StructField(c, LongType()) for c in names]], through), "jumps")
        reach = 1
        while reach <= last:  # blocks below ``reach`` are known, and ``jump`` goes as far
            ahead = entered.join(jump, (entered["_key"] == jump["_key"]) & (F.col("_block") == F.col("_from")) & (F.col("_entry") == F.col("_at")))
            ahead = ahead.select(entered["_key"], F.col("_to").alias("_block"), F.col("_exit").alias("_entry"), (F.col("_before") + F.col("_begun")).alias("_before"))
            entered = written(entered.unionByName(ahead), "entered")
            then = jump.select(F.col("_key").alias("_k"), F.col("_from").alias("_f"), F.col("_at").alias("_a"), F.col("_to").alias("_to2"), F.col("_exit").alias("_exit2"), F.col("_begun").alias("_more"))
            twice = jump.join(then, (F.col("_key") == F.col("_k")) & (F.col("_to") == F.col("_f")) & (F.col("_exit") == F.col("_a")))
            jump = written(twice.select("_key", "_from", "_at", F.col("_to2").alias("_to"), F.col("_exit2").alias("_exit"), (F.col("_begun") + F.col("_more")).alias("_begun")), "jumps")
            reach *= 2

    said = list(dict.fromkeys([*group, item, size]))

    def number(table: pa.Table) -> pa.Table:
        ends, begins, at = _ends(_values(table, "_x"), most_size, most_items), np.zeros(len(table), dtype=np.int64), table.column("_entry")[0].as_py()
        while at < len(table):
            begins[at], at = 1, int(ends[at])
        return table.select(said).append_column("batch", pa.array(table.column("_before")[0].as_py() + np.cumsum(begins)))

    return _by_block(items.join(entered, ["_key", "_block"]), [*[kinds[c] for c in said], StructField("batch", LongType())], number)


def selected(items: DataFrame, most_size: int, most_items: int, most_one: int, most_lines: int, names: tuple[str, str, str, str]) -> DataFrame:
    """The numbered items with ``reason``: null of those kept, else one of ``names`` (too large, no count, no size, no lines left).

    ``items``: as ``numbered`` leaves them, with _x and _y, their sizes and lines.
    """

    def choose(table: pa.Table) -> tuple[np.ndarray, list[int]]:
        x, y = _values(table, "_x"), _values(table, "_y")
        n, size, lines = (table.column(c)[0].as_py() for c in ("_n", "_size", "_lines"))
        why, at = np.full(len(x), None, dtype=object), 0
        while at < len(x):
            a, b = x[at:], y[at:]
            ruled = [a > most_one, np.full(len(a), n >= most_items), size + a > most_size, lines + b > most_lines]
            out = np.logical_or.reduce(ruled)
            k = len(out) if out.all() else int(out.argmin())
            why[at : at + k] = np.select([r[:k] for r in ruled], names, "")
            if k < len(out):
                n, size, lines = n + 1, size + int(a[k]), lines + int(b[k])
            at += k + 1
        return why, [n, size, lines]

    kinds = {f.name: f for f in items.schema.fields}
    states = ["_n", "_size", "_lines"]
    none = [F.lit(0).cast("long").alias(c) for c in states]
    state_fields = [kinds["_key"], kinds["_block"], *[StructField(c, LongType()) for c in states]]

    def after(table: pa.Table) -> pa.Table:
        out = table.select(["_key", "_block"]).slice(0, 1)
        for c, v in zip(states, choose(table)[1], strict=True):
            out = out.append_column(c, pa.array([v], pa.int64()))
        return out

    def reasons(table: pa.Table) -> pa.Table:
        return table.select(said).append_column("reason", pa.array(choose(table)[0], pa.string()))

    blocks = written(items.groupBy("_key", "_block").agg(F.min("_x").alias("_least"), F.min("_y").alias("_fewest")), "blocks")
    more = not blocks.filter("_block > 0").isEmpty()
    known = latest = written(_by_block(items.filter("_block = 0").select("*", *none), state_fields, after), "states") if more else None
    while more:
        open_ = latest.filter(F.col("_n") < most_items).withColumnRenamed("_block", "_last")
        may = blocks.join(open_, "_key").filter((F.col("_block") > F.col("_last")) & (F.col("_least") <= most_one) & (F.col("_least") + F.col("_size") <= most_size) & (F.col("_fewest") + F.col("_lines") <= most_lines))
        fit = items.join(may.drop("_least", "_fewest", "_last"), ["_key", "_block"]).filter((F.col("_x") <= most_one) & (F.col("_x") + F.col("_size") <= most_size) & (F.col("_y") + F.col("_lines") <= most_lines))
        found = written(fit.groupBy("_key", *states).agg(F.min("_block").alias("_block")), "next")
        if found.isEmpty():
            break
        latest = written(_by_block(items.join(found, ["_key", "_block"]), state_fields, after), "states")
        known = known.unionByName(latest)
    said = [c for c in items.columns if c not in ("_key", "_x", "_y", "_place", "_block")]
    if known is None:
        entered = items.select("*", *none)
    else:
        above = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        state = F.last(F.when(F.col("_n").isNotNull(), F.struct(*states)), ignorenulls=True).over(above)
        per_block = blocks.select("_key", "_block").join(known, ["_key", "_block"], "left").withColumn("_state", state)
        entered = items.join(per_block.select("_key", "_block", *[F.coalesce(F.col(f"_state.{c}"), F.lit(0)).alias(c) for c in states]), ["_key", "_block"])
    return _by_block(entered, [*[kinds[c] for c in said], StructField("reason", StringType())], reasons)


def budgeted(
    rows: DataFrame, group: list[str], order: list[str], item: str, size: str, most_size: int, most_items: int, most_one: int, lines: str | None = None, most_lines: int = 0, block: int = BLOCK
) -> DataFrame:
    """Each item with ``reason``: kept (null), too_large, no_count, no_size or no_lines; what does not fit is skipped, the next is tried."""
    needed = list(dict.fromkeys([*group, *order, item]))
    sized = rows.select(*needed, whole(size).alias("_x"), whole(lines).alias("_y"))
    items = numbered(sized, group, [*list(dict.fromkeys([*order, item])), "_x", "_y"], block)
    items = items.drop(*[c for c in order if c not in (*group, item)])
    return selected(items, most_size, most_items, most_one, most_lines if lines else ENDLESS, ("too_large", "no_count", "no_size", "no_lines"))


#: What stands at the end of a text that was cut.
CUT = "\n[cut]"


def shrunk_lines(text: Column, most_lines: int, most_tokens: int) -> Column:
    """Lines that stay of a text: at most so many, then four fifths again and again while they pass the tokens and over ten are left."""
    steps = F.sequence(F.lit(1), F.lit(60))  # enough for any number of lines that an int holds

    def shrink(k: Column, _: Column) -> Column:
        kept = F.call_function("substring_index", text, F.lit("\n"), k)
        return F.when((k > 10) & (token_estimate(kept) > most_tokens), F.floor(k * 0.8).cast("int")).otherwise(k)

    return F.aggregate(steps, F.least(F.size(F.split(text, "\n", -1)), F.lit(most_lines)), shrink)


def reduced(
    rows: DataFrame, group: list[str], order: list[str], item: str, text: str, most_items: int, most_lines_one: int, most_tokens_one: int, most_tokens: int, most_lines: int, block: int = BLOCK
) -> DataFrame:
    """The group, the item, its lines and tokens after the cut, whether it was cut, and ``reason`` if it does not fit with those kept before it."""
    n = shrunk_lines(F.col(text), most_lines_one, most_tokens_one)
    kept = rows.withColumn("lines", n).withColumn("cut", F.col("lines") < F.size(F.split(text, "\n", -1)))
    body = F.concat(F.call_function("substring_index", F.col(text), F.lit("\n"), F.col("lines")), F.when(F.col("cut"), F.lit(CUT)).otherwise(F.lit("")))
    sized = kept.withColumn("tokens", token_estimate(body))
    needed = list(dict.fromkeys([*group, *order, item, "lines", "tokens", "cut"]))
    items = numbered(sized.select(*needed, whole("tokens").alias("_x"), whole("lines").alias("_y")), group, [*list(dict.fromkeys([*order, item])), "_x", "_y"], block)
    items = items.drop(*[c for c in order if c not in (*group, item)])
    return selected(items, most_tokens, most_items, ENDLESS, most_lines, ("", "maxFiles", "maxTotalTokens", "maxTotalLines"))


#: What is left of a list that is cut (fixed value), and more steps than any list has.
KEPT, STEPS = 0.7, 96


def shrink(items: DataFrame, group: str, part: str, place: str, cost: str, budget: float) -> DataFrame:
    """group, part, n and ``kept``: items of each list that stay when the longest list is cut again and again until the group fits.

    ``items``: a row an item with its place in its list, from 1 and gapless. Of lists as long the least part is cut first, to ``KEPT`` of its
    length, rounded down; cutting ends when the costs fit or nothing is left. A list's lengths are a falling ladder, so the loop's
    cuts are all ladders' steps in the order of their lengths, and those done are the ones before which the running sum
    of what is saved does not suffice: a window over the steps (some tens a list), none over items. Null costs are 0.
    """
    ladder = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array(F.col("n").cast("long")), lambda a, _: F.when(F.element_at(a, -1) > 0, F.concat(a, F.array(F.floor(F.element_at(a, -1) * F.lit(KEPT)).cast("long")))).otherwise(a))
    lists = items.groupBy(group, part).agg(F.count("*").alias("n"), F.sum(F.coalesce(cost, F.lit(0))).alias("_all")).withColumn("_ladder", ladder)
    steps = lists.select(group, part, F.posexplode("_ladder").alias("_k", "_size")).filter("_size > 0").withColumn("_k", F.col("_k") + 1)
    owner = lists.select(F.col(group).alias("_g"), F.col(part).alias("_p"), "_ladder")
    met = items.join(owner, F.col(group).eqNullSafe(F.col("_g")) & F.col(part).eqNullSafe(F.col("_p")))
    saved = met.groupBy("_g", "_p", F.size(F.filter("_ladder", lambda x: x >= F.col(place))).alias("_at")).agg(F.sum(F.coalesce(cost, F.lit(0))).alias("_saved"))
    total = lists.groupBy(F.col(group).alias("_tg")).agg(F.sum("_all").alias("_total"))
    same = steps[group].eqNullSafe(saved["_g"]) & steps[part].eqNullSafe(saved["_p"]) & (steps["_k"] == saved["_at"])
    cuts = steps.join(saved, same, "left").select(group, part, "_k", "_size", F.coalesce("_saved", F.lit(0)).alias("_saved")).join(total, F.col(group).eqNullSafe(F.col("_tg")))
    before = Window.partitionBy(group).orderBy(F.desc("_size"), part).rowsBetween(Window.unboundedPreceding, -1)
    done = cuts.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_saved").over(before), F.lit(0))).filter(F.col("_left") > budget)
    taken = done.groupBy(F.col(group).alias("_g"), F.col(part).alias("_p")).agg(F.count("*").alias("_cuts"))
    found = lists.join(taken, F.col(group).eqNullSafe(F.col("_g")) & F.col(part).eqNullSafe(F.col("_p")), "left")
    return found.select(group, part, "n", F.get("_ladder", F.coalesce("_cuts", F.lit(0)).cast("int")).alias("kept"))
