"""Graphs as edge tables: reachability by frontiers, prefixes through mounts, impact and risk.

A frontier holds each node once, so a search costs an edge a step whatever the number of paths; the steps are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import dealt, written


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Distinct src and dst. Edges are dealt before they are made distinct, so no task holds more of them as the input grows."""
    return dealt(edges.select("src", "dst"), "src", "dst").distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int, include_start: bool = False) -> DataFrame:
    """(start, node, depth) of all nodes within ``depth`` steps, with the least number of steps; cycles do no harm.

    ``edges``: src, dst. ``starts``: start. Every frontier is written down, so a step joins stored tables and the plan of
    the result is a scan a step. The search ends early when a frontier is empty.
    """
    e = written(distinct_edges(edges).select(F.col("src").alias("_src"), F.col("dst").alias("_dst")), "edges")
    front = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "front")
    seen = front
    for k in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("_src")).select("start", F.col("_dst").alias("node"), F.lit(k).alias("depth")).distinct()
        front = written(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if include_start else seen.filter("depth > 0")


def trace(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """As ``reach``, with ``status``: the best over all shortest paths, INFERRED if an edge on the path is.

    ``edges``: src, dst, status.
    """
    sure = F.when(F.col("status") == "VERIFIED", 1).otherwise(0)
    e = dealt(edges.select("src", "dst", sure.alias("_one")), "src", "dst").groupBy("src", "dst").agg(F.max("_one").alias("_sure"))
    e = written(e.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "_sure"), "edges")
    front = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("sure")).distinct(), "front")
    seen = front
    for k in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("_src")).groupBy("start", F.col("_dst").alias("node")).agg(F.max(F.least("sure", "_sure")).alias("sure"))
        new = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = written(new.select("start", "node", F.lit(k).alias("depth"), "sure"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0").select("start", "node", "depth", F.when(F.col("sure") == 1, "VERIFIED").otherwise("INFERRED").alias("status"))


def trace_up(edges: DataFrame, starts: DataFrame, bound: DataFrame, depth: int) -> DataFrame:
    """(start, step, node) of the chain from each start up through the first caller, until a bound node or none is left.

    ``edges``: src, dst and ord, the order in which a node's callers count. ``bound``: node. A node already on the chain
    is passed over, so cycles end.
    """
    up = written(edges.select(F.col("dst").alias("_node"), F.col("src").alias("_from"), "ord").filter("_node <> _from"), "callers")
    ends = written(bound.select(F.col("node").alias("_bound")).distinct(), "bound")
    front = written(starts.select("start", F.lit(0).alias("step"), F.col("start").alias("node")).distinct(), "chain")
    seen = front
    for k in range(1, depth + 1):
        open_ends = front.join(ends, F.col("node") == F.col("_bound"), "left_anti")
        step = open_ends.join(up, F.col("node") == F.col("_node")).select("start", F.col("_from").alias("node"), "ord")
        new = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = written(new.groupBy("start").agg(F.min_by("node", F.struct("ord", "node")).alias("node")).select("start", F.lit(k).alias("step"), "node"), "chain")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def call_edges(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, line, status) of calls that resolve, by the first rule that holds.

    A symbol of the same file, then the symbol of an imported file under the imported name (both VERIFIED), then a name
    that one symbol of the whole project has (INFERRED). A name that is imported but found nowhere resolves to nothing.

    ``calls``: file, symbol, name, line. ``symbols``: file, name. ``imports``: file, local, target (null: not of the project), imported.
    """
    node = F.concat_ws("#", "file", "name")
    known = symbols.select("file", "name", node.alias("id")).distinct()
    one = known.groupBy("name").agg(F.min("id").alias("only_id"), F.count("*").alias("n")).filter("n = 1").select("name", "only_id")
    first = imports.groupBy("file", F.col("local").alias("name")).agg(F.min(F.struct("target", "imported")).alias("i"))
    there = known.select(F.col("file").alias("_target"), F.col("name").alias("_imported"), F.col("id").alias("far_id"))
    met = (
        calls.join(known.select("file", "name", F.col("id").alias("near_id")), ["file", "name"], "left")
        .join(first, ["file", "name"], "left")
        .join(there, (F.col("i.target") == F.col("_target")) & (F.col("i.imported") == F.col("_imported")), "left")
        .join(one, "name", "left")
    )
    dst = F.when(F.col("near_id").isNotNull(), F.col("near_id")).when(F.col("i").isNotNull(), F.col("far_id")).otherwise(F.col("only_id"))
    status = F.when(F.col("near_id").isNotNull() | F.col("i").isNotNull(), "VERIFIED").otherwise("INFERRED")
    out = met.select(F.concat_ws("#", "file", "symbol").alias("src"), dst.alias("dst"), "line", status.alias("status"))
    return out.filter("dst IS NOT NULL AND src <> dst")


def mount_prefixes(mounts: DataFrame, depth: int = 6) -> DataFrame:
    """(file, prefix), one row for each way a file is mounted. ``mounts``: parent (null for a root), file, prefix."""
    level = mounts.filter("parent IS NULL").select("file", "prefix")
    out = level
    inner = mounts.filter("parent IS NOT NULL").select("parent", F.col("file").alias("_file"), F.col("prefix").alias("_prefix"))
    for _ in range(depth):
        level = level.join(inner, F.col("file") == F.col("parent")).select(F.col("_file").alias("file"), F.concat("prefix", "_prefix").alias("prefix")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) over distinct edges."""
    e = distinct_edges(edges)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("end"))
    return ends.select("end.*").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def risk(impact: DataFrame) -> DataFrame:
    """Risk and its reasons, in rule order. ``impact``: dependents, in_workflow, is_route, is_schema."""
    rules = (
        (F.col("dependents") >= 5, "MEDIUM", "five or more dependents"),
        (F.col("in_workflow"), "MEDIUM", "part of a workflow"),
        (F.col("is_route"), "MEDIUM", "defines routes"),
        (F.col("is_schema"), "HIGH", "defines the schema"),
        (F.col("dependents") >= 15, "HIGH", "fifteen or more dependents"),
    )
    high = F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c, level, _ in rules if level == "HIGH"]), lambda x: x)
    some = F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c, _, _ in rules]), lambda x: x)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(why)) for c, _, why in rules])), "; ")
    return impact.withColumn("risk", F.when(high, "HIGH").when(some, "MEDIUM").otherwise("LOW")).withColumn("reasons", reasons)


def _spread(labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) where each label has gone along all edges as far as it is the greatest."""
    while True:
        near = labels.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("_to")).agg(F.max("label").alias("_near"))
        step = labels.join(near, F.col("node") == F.col("_to"), "left").select("node", F.greatest("label", F.coalesce("_near", "label")).alias("label"), (F.col("_near") > F.col("label")).alias("rose"))
        step = written(step, name)
        labels = step.select("node", "label")
        if step.filter("rose").isEmpty():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other have one component, named by its least node.

    ``edges``: src, dst. Nodes without an edge in or out are components of their own and go first, again and again. Among the
    rest the greatest node that reaches a node colours it; what reaches the colour's own node backwards within the colour
    is one component, and edges between colours are none of any. Every round takes out the component of each colour. All
    tables are written down, so a plan is one round long; rounds follow the longest path, not the number of nodes.
    A node with an edge to itself alone is a component of its own.
    """
    ends = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    e = written(distinct_edges(ends.filter("src <> dst")), "cycle-edges")
    nodes = written(ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "cycle-nodes")
    found = None
    while not nodes.isEmpty():
        inner = written(e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node"))), "cycle-inner")
        single = written(nodes.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")), "cycle-single")
        if not single.isEmpty():
            done, nodes = single, inner
        else:
            labels = _spread(nodes.select("node", F.col("node").alias("label")), e, "cycle-colours")
            a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("_a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_b"))
            e = written(e.join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst"), "cycle-within")
            front = written(labels.filter("node = label"), "cycle-front")
            done = front
            while not front.isEmpty():
                step = front.join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "label").distinct()
                front = written(step.join(done.select("node"), "node", "left_anti"), "cycle-front")
                done = done.unionByName(front)
            done = written(done.select("node", F.col("label").alias("component")), "cycle-done")
            nodes = written(nodes.join(done, "node", "left_anti"), "cycle-nodes")
        gone = done.select("node")
        e = written(e.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"), "cycle-edges")
        found = done if found is None else found.unionByName(done)
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = found.groupBy("component").agg(F.min("node").alias("_least"))
    return written(found.join(least, "component").select("node", F.col("_least").alias("component")), "cycle-components")


def topological(edges: DataFrame) -> DataFrame:
    """(node, component, layer): what a node depends on (src on dst) is in its component or in a lower layer.

    A cycle is cut by taking its nodes as one component; ``layer`` is the length of the longest chain of components below.
    Sorting by layer, component and node is an order in which everything comes after what it depends on, the same whatever the
    order of the rows. Layers are peeled off from below, each by one anti-join over stored tables.
    """
    parts = cycles(edges)
    a, b = parts.select(F.col("node").alias("src"), F.col("component").alias("_a")), parts.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    e = written(edges.select("src", "dst").join(a, "src").join(b, "dst").filter("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct(), "layer-edges")
    left = written(parts.select("component").distinct(), "layer-open")
    layers, k = None, 0
    while not left.isEmpty():
        waits = e.select(F.col("src").alias("component")).distinct()
        ready = written(left.join(waits, "component", "left_anti").select("component", F.lit(k).alias("layer")), "layer")
        left = written(left.join(waits, "component", "left_semi"), "layer-open")
        e = written(e.join(ready.select(F.col("component").alias("dst")), "dst", "left_anti").select("src", "dst"), "layer-edges")
        layers, k = ready if layers is None else layers.unionByName(ready), k + 1
    if layers is None:
        return parts.withColumn("layer", F.lit(0))
    return parts.join(layers, "component").select("node", "component", "layer")
