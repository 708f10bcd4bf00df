"""Orders in which related nodes stand together: depth first from given starts, without walking the graph node by node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.packing import BLOCK, numbered
from tessella.sources.scratch import written

#: Place of a node that is no start.
LAST = 1 << 62
#: Depth of trees up to which they are placed level by level.
LEVELS = 24


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root_place, root, depth, parent): the tree that each node belongs to, and what it hangs from.

    Starts come first by ``place``, then all others by node; a search from one after the other takes what none before it reached. So a
    node's root is the least start that reaches it, which is what each round hands on along edges, with the number of steps and the
    least node of that number to come from. Rounds follow the longest way, their tables are written down.

    ``nodes``: node, place (null: no start). ``edges``: src, dst; ends that are no nodes are passed over.
    """
    ranked = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("place").alias("place"))
    ranked = written(ranked.select("node", F.struct(F.coalesce("place", F.lit(LAST)).cast("long").alias("place"), F.col("node").alias("root")).alias("_root")), "forest-nodes")
    known = ranked.select("node")
    e = edges.filter("src <> dst").select("src", "dst").distinct().join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    e = written(e, "forest-edges")
    none = F.lit(None).cast(dict(nodes.dtypes)["node"])
    state = ranked.select("node", F.struct(F.col("_root").alias("root"), F.lit(0).alias("depth"), none.alias("parent")).alias("_at"), F.lit(True).alias("_new"))
    while True:
        come = state.filter("_new").join(e, F.col("node") == F.col("src"))
        best = come.groupBy(F.col("dst").alias("_to")).agg(F.min(F.struct(F.col("_at.root").alias("root"), (F.col("_at.depth") + 1).alias("depth"), F.col("src").alias("parent"))).alias("_best"))
        better = F.col("_best").isNotNull() & (F.col("_best") < F.col("_at"))
        state = written(state.join(best, F.col("node") == F.col("_to"), "left").select("node", F.when(better, F.col("_best")).otherwise(F.col("_at")).alias("_at"), better.alias("_new")), "forest")
        if state.filter("_new").isEmpty():
            return state.select("node", F.col("_at.root.place").alias("root_place"), F.col("_at.root.root").alias("root"), F.col("_at.depth").alias("depth"), F.col("_at.parent").alias("parent"))


def preorder(trees: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, place): nodes before their children, children by node, trees by (root_place, root); places from 1.

    Trees with a ``depth`` (0 of a root) of at most ``LEVELS`` are placed level by level: a node is behind its parent, its earlier siblings
    and all below these. Sizes go up the levels and places down them, so a node is sent a few times in all.

    In deeper trees, or without a depth, a walk round all trees passes down to a node once and up from it once. Every such arc knows the next one from first children and
    next siblings alone, and how many nodes are yet to come is summed by doubling: as many rounds as the binary digits of the
    number of arcs, whatever the depth of a tree or the number of a node's children.

    ``trees``: node, parent (null of a root), root_place, root and perhaps depth.
    """
    inner = F.col("parent").isNotNull()
    order = F.when(inner, F.lit(0)).otherwise(F.col("root_place")).cast("long").alias("_order")
    deepest = trees.agg(F.max("depth")).first()[0] if "depth" in trees.columns else None
    if deepest is not None and deepest <= LEVELS:
        return _by_levels(numbered(trees.select("node", "parent", "depth", order), ["parent"], ["_order", "node"], block), deepest)
    children = trees.select("node", "parent", order)
    placed = numbered(children, ["parent"], ["_order", "node"], block).select("node", "parent", "_key", "_place")
    first = placed.filter("_place = 0 AND parent IS NOT NULL").select(F.col("parent").alias("_of"), F.col("node").alias("_first"))
    after = placed.select(F.col("_key").alias("_key2"), (F.col("_place") - 1).alias("_place2"), F.col("node").alias("_after"))
    near = placed.join(first, F.col("node") == F.col("_of"), "left").join(after, (F.col("_key") == F.col("_key2")) & (F.col("_place") == F.col("_place2")), "left")
    down = F.struct(F.lit(False).alias("up"), F.coalesce("_first", "node").alias("to"), F.col("_first").isNull().alias("to_up"))
    up = F.struct(F.lit(True).alias("up"), F.coalesce("_after", "parent").alias("to"), F.col("_after").isNull().alias("to_up"))
    arcs = near.select("node", F.explode(F.array(down, up)).alias("_arc")).select("node", "_arc.up", "_arc.to", "_arc.to_up")
    arcs = written(arcs.withColumn("ahead", F.when(F.col("to").isNotNull() & ~F.col("to_up"), 1).otherwise(0).cast("long")), "arcs")
    total = placed.count()
    while not arcs.filter("to IS NOT NULL").isEmpty():
        then = arcs.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("to").alias("_to"), F.col("to_up").alias("_to_up"), F.col("ahead").alias("_ahead"))
        met = arcs.join(then, (F.col("to") == F.col("_node")) & (F.col("to_up") == F.col("_up")), "left")
        arcs = written(met.select("node", "up", F.col("_to").alias("to"), F.col("_to_up").alias("to_up"), (F.col("ahead") + F.coalesce("_ahead", F.lit(0))).alias("ahead")), "arcs")
    return arcs.filter("NOT up").select("node", (F.lit(total) - F.col("ahead")).cast("long").alias("place"))


def _by_levels(placed: DataFrame, deepest: int) -> DataFrame:
    """(node, place) of nodes numbered among their siblings."""
    none = F.lit(0).cast("long")
    levels: list[DataFrame] = []
    for k in range(deepest, -1, -1):
        level = placed.filter(F.col("depth") == k).select("node", "parent", "_key", "_block", "_place")
        size = F.lit(1).cast("long")
        if levels:
            level = level.join(levels[-1].groupBy(F.col("parent").alias("_of")).agg(F.sum("_size").alias("_below")), F.col("node") == F.col("_of"), "left")
            size = size + F.coalesce("_below", none)
        levels.append(written(level.select("node", "parent", "_key", "_block", "_place", size.alias("_size")), "level"))
    earlier = Window.partitionBy("_key", "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    found, upper = None, None
    for level in reversed(levels):
        blocks = level.groupBy("_key", "_block").agg(F.sum("_size").alias("_n"))
        first = blocks.select("_key", "_block", F.coalesce(F.sum("_n").over(above), none).alias("_first"))
        place = F.col("_first") + F.coalesce(F.col("_earlier"), none) + 1
        met = level.withColumn("_earlier", F.sum("_size").over(earlier)).join(first, ["_key", "_block"])
        if upper is not None:
            met = met.join(upper.select(F.col("node").alias("_of"), F.col("place").alias("_up")), F.col("parent") == F.col("_of"))
            place = place + F.col("_up")
        upper = written(met.select("node", place.alias("place")), "places")
        found = upper if found is None else found.unionByName(upper)
    return found


def clustered(nodes: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, place): the order in which a depth-first search from the starts, then from the rest, meets the nodes' trees.

    Every node stands in the tree of the start from which such a search would reach it. Within a tree a node hangs from the
    nearest one that leads to it (the least of those), so that where every node has one way in, the order is that search's
    own; where several lead to it, the tree is the same and its inner order may differ.

    Null nodes and edges with a null end are passed over, a repeated node counts once with its least place, cycles do no harm, and no nodes give no rows.
    """
    return preorder(forest(nodes, edges), block)
