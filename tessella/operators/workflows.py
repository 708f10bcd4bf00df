"""Workflows put together from calls of a client, the routes that they meet and what the routes' handlers call in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import trace_up
from tessella.operators.packing import BLOCK, numbered
from tessella.sources.scratch import written


def walks(edges: DataFrame, entries: DataFrame, depth: int, block: int = BLOCK) -> DataFrame:
    """(entry, step, node, depth, open): what each entry calls within ``depth`` steps, in the order of the calls, itself first.

    A node is reached once, by the fewest steps; its way there (the edges' ``ord`` and nodes, at most ``depth`` of them) goes
    with the frontier, the least way is kept, and sorting by it reads a tree of calls back from the top. ``open`` says that the last edge of
    the way is not VERIFIED. A frontier is a stored table, so the plan is linear in the depth.

    ``edges``: src, dst, ord, status. ``entries``: entry.
    """
    sure = F.max((F.col("status") == "VERIFIED").cast("int")).alias("_sure")
    e = written(edges.filter("src <> dst").groupBy(F.col("src").alias("_src"), F.col("dst").alias("_dst")).agg(F.min("ord").alias("_ord"), sure), "calls")
    hop = lambda ord_, node: F.struct(ord_.cast("long").alias("ord"), node.alias("node"))
    start = entries.filter("entry IS NOT NULL").select("entry", F.col("entry").alias("node")).distinct()
    front = written(start.select("entry", "node", F.lit(0).alias("depth"), F.array(hop(F.lit(0), F.col("node"))).alias("way"), F.lit(False).alias("open")), "walk")
    seen = front
    for k in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("_src")).select("entry", F.col("_dst").alias("node"), F.concat("way", F.array(hop(F.col("_ord"), F.col("_dst")))).alias("way"), "_sure")
        best = step.groupBy("entry", "node").agg(F.min(F.struct("way", "_sure")).alias("_b")).join(seen.select("entry", "node"), ["entry", "node"], "left_anti")
        front = written(best.select("entry", "node", F.lit(k).alias("depth"), F.col("_b.way").alias("way"), (F.coalesce(F.col("_b._sure"), F.lit(0)) == 0).alias("open")), "walk")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    placed = numbered(seen, ["entry"], ["way"], block)
    return placed.select("entry", (F.col("_place") + 1).alias("step"), "node", "depth", "open")


def assemble(routes: DataFrame, links: DataFrame, edges: DataFrame, bound: DataFrame, depth: int, depth_up: int, block: int = BLOCK) -> DataFrame:
    """(call, route, place, kind, node, step_status, status): the steps of each workflow, numbered from 1.

    One workflow for each call of a client that meets a route: the callers from the outermost (a bound one, if there is one) to the
    one that calls, the call, the route, and the handler with what it calls. Then one for each route that no call meets, from the
    route on, with a null ``call``. A handler that is not known is an UNKNOWN step; a step reached by a call that is not
    resolved for certain is INFERRED, and a workflow with such a step is PARTIAL, else VERIFIED. What an entry or a caller leads to is
    traced once, however many workflows share it.

    ``routes``: route, entry (null: handler not found). ``links``: call, caller (null: none), route. ``edges``: src, dst, ord, status.
    ``bound``: node. Links to no known route, and null calls or routes, give no workflow; repeated rows count once, and of a
    route's entries the least counts.
    """
    known = routes.filter("route IS NOT NULL").groupBy("route").agg(F.min("entry").alias("entry"))
    met = links.filter("call IS NOT NULL").groupBy("call", "route").agg(F.min("caller").alias("caller")).join(known, "route")
    alone = known.join(links.filter("call IS NOT NULL").select("route"), "route", "left_anti")
    none = F.lit(None)
    flows = met.select("call", "route", "entry", "caller").unionByName(alone.select(none.cast(dict(met.dtypes)["call"]).alias("call"), "route", "entry", none.cast(dict(met.dtypes)["caller"]).alias("caller")))
    flows = written(flows, "flows")
    down = written(walks(edges, flows.select("entry").distinct(), depth, block), "down")
    up = written(trace_up(edges, flows.filter("caller IS NOT NULL").select(F.col("caller").alias("start")).distinct(), bound, depth_up), "up")
    height = up.groupBy(F.col("start").alias("_start")).agg(F.max("step").alias("_top"))
    partial = down.groupBy(F.col("entry").alias("_entry")).agg(F.max("open").alias("_open"))
    status = F.when(F.col("entry").isNull() | F.coalesce("_open", F.lit(False)), "PARTIAL").otherwise("VERIFIED")
    above = F.when(F.col("call").isNull(), 0).otherwise(F.coalesce(F.col("_top") + 1, F.lit(0)) + 1)  # callers and the call
    flows = flows.join(height, F.col("caller") == F.col("_start"), "left").join(partial, F.col("entry") == F.col("_entry"), "left")
    flows = written(flows.select("call", "route", "entry", "caller", "_top", above.cast("long").alias("_above"), status.alias("status")), "flows")

    node_kind = dict(edges.dtypes)["src"]

    def rows(df: DataFrame, place, kind, node, step_status) -> DataFrame:
        return df.select("call", "route", place.cast("long").alias("place"), kind.alias("kind"), node.cast(node_kind).alias("node"), step_status.alias("step_status"), "status")

    sure = F.lit("VERIFIED")
    callers = flows.join(up.select("start", "step", "node"), F.col("caller") == F.col("start"))
    handlers = flows.join(down.withColumnRenamed("entry", "_entry"), F.col("entry") == F.col("_entry"))
    parts = (
        rows(callers, F.col("_top") - F.col("step") + 1, F.lit("caller"), F.col("node"), sure),
        rows(flows.filter("call IS NOT NULL"), F.col("_above"), F.lit("call"), none, sure),
        rows(flows, F.col("_above") + 1, F.lit("route"), none, sure),
        rows(flows.filter("entry IS NULL"), F.col("_above") + 2, F.lit("handler"), none, F.lit("UNKNOWN")),
        rows(handlers, F.col("_above") + 1 + F.col("step"), F.when(F.col("step") == 1, "handler").otherwise("step"), F.col("node"), F.when(F.col("open"), "INFERRED").otherwise(sure)),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
