"""Joins that resolve names, places and paths. Every one is an equi join with a residual, so none pairs everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Projects that are compared pair by pair.
MOST_PROJECTS = 1000


def wildcard_join(calls: DataFrame, routes: DataFrame, key: str, method: str, wildcards: tuple[str, ...] = ("ANY", "ALL")) -> DataFrame:
    """Equal ``key`` and compatible ``method``: equal, or a wildcard on either side. Routes' columns get ``route_``."""
    r = routes.select([F.col(c).alias(f"route_{c}") for c in routes.columns])
    a, b = F.col(method), F.col(f"route_{method}")
    return calls.join(r, (F.col(key) == F.col(f"route_{key}")) & ((a == b) | a.isin(*wildcards) | b.isin(*wildcards)))


def first_existing(wanted: DataFrame, candidates: str, known: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Of an array of candidates per row the first that is in ``known``; null when none is."""
    tried = wanted.select(*keys, F.posexplode_outer(candidates).alias("_pos", name))
    hit = tried.join(known.select(name).distinct(), name).groupBy(*keys).agg(F.min_by(name, "_pos").alias("found"))
    return wanted.select(*keys).distinct().join(hit, keys, "left")


def within_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points inside closed intervals of the same key. Both sides carry the bucket of ``width`` that they touch, so a
    long history of one key is dealt over many tasks."""
    buckets = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    spread = intervals.withColumn("_bucket", buckets)
    placed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return placed.join(spread, [key, "_bucket"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


def innermost(matches: DataFrame, point: list[str], low: str, high: str, order: str, keep: str) -> DataFrame:
    """Of the intervals that hold a point the shortest; of equal ones the one with the largest ``order``."""
    return matches.groupBy(*point).agg(F.min_by(keep, F.struct(F.col(high) - F.col(low), -F.col(order))).alias(keep))


def longest_prefix(paths: DataFrame, path: str, owners: DataFrame, root: str, key: str) -> DataFrame:
    """The longest ``root`` that is the path or a folder above it: an equi join on every prefix, not a scan of owners."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hit = paths.select(key, F.explode(prefixes).alias(root)).join(owners.select(root).distinct(), root)
    best = hit.groupBy(key).agg(F.max_by(root, F.length(root)).alias("owner"))
    return paths.select(key, path).join(best, key, "left")


def unique_match(left: DataFrame, right: DataFrame, name: str, target: str) -> DataFrame:
    """Rows of ``left`` whose name has exactly one ``target`` on the right."""
    one = right.groupBy(name).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).filter("_n = 1").drop("_n")
    return left.join(one, name)


def fallback_lookup(left: DataFrame, names: list[Column], known: DataFrame, key: str, value: str, ids: list[str]) -> DataFrame:
    """The value of the first of several names that is known; of one name's values the first by order."""
    tried = left.select(*ids, F.posexplode(F.array(*names)).alias("_pos", key))
    dedup = known.groupBy(key).agg(F.min(value).alias(value))
    hit = tried.join(dedup, key).groupBy(*ids).agg(F.min_by(value, "_pos").alias(value))
    return left.select(*ids).join(hit, ids, "left")


def split_known(edges: DataFrame, src: str, dst: str, known: DataFrame, path: str) -> DataFrame:
    """Edges with ``kind`` internal or external by whether the target is known; edges to oneself go, equal ones merge."""
    k = known.select(F.col(path).alias(dst)).distinct().withColumn("_in", F.lit(True))
    flagged = edges.filter(F.col(src) != F.col(dst)).join(k, dst, "left")
    return flagged.groupBy(src, dst).agg(F.count("*").alias("n"), F.when(F.max("_in"), "internal").otherwise("external").alias("kind"))


def both_ends_known(edges: DataFrame, src: str, dst: str, known: DataFrame, name: str) -> DataFrame:
    """Edges with status VERIFIED if both ends are known, in any case of letters, else INFERRED."""
    k = known.select(F.lower(name).alias("_k")).distinct()
    a, b = k.withColumnRenamed("_k", "_a"), k.withColumnRenamed("_k", "_b")
    met = edges.join(a, F.lower(src) == F.col("_a"), "left").join(b, F.lower(dst) == F.col("_b"), "left")
    return met.withColumn("status", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "VERIFIED").otherwise("INFERRED")).drop("_a", "_b")


def transitions(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """NEW, SAME, CHANGED or REMOVED for every key of two snapshots."""
    b = before.select(F.col(key).alias("_key"), F.col(digest).alias("_digest"))
    met = now.select(key, digest).join(b, F.col(key) == F.col("_key"), "full")
    status = F.when(F.col("_key").isNull(), "NEW").when(F.col(key).isNull(), "REMOVED").when(F.col(digest) == F.col("_digest"), "SAME").otherwise("CHANGED")
    return met.select(F.coalesce(key, "_key").alias(key), status.alias("transition"))


def compare(a: DataFrame, b: DataFrame, key: list[str], detail: str) -> DataFrame:
    """Side by side by key: common, different (details unlike), only_a or only_b."""
    x = a.select(*key, F.col(detail).alias("a_detail"), F.lit(1).alias("_a"))
    y = b.select(*key, F.col(detail).alias("b_detail"), F.lit(1).alias("_b"))
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("a_detail").eqNullSafe(F.col("b_detail")), "common").otherwise("different")
    return x.join(y, key, "full").select(*key, "a_detail", "b_detail", side.alias("side"))


def pairwise_sets(sets: DataFrame, key: str, items: str) -> DataFrame:
    """For every two of a few projects: how many items are common and how many only one has. ``sets``: a row an item.

    Items meet by an equi join, so only what is common is paired; the projects themselves are ``MOST_PROJECTS`` at most.
    """
    rows = sets.select(F.col(key).alias("a"), F.col(items).alias("_x")).distinct()
    sizes = rows.groupBy("a").agg(F.count("*").alias("_n"))
    keys = [r["a"] for r in sizes.select("a").limit(MOST_PROJECTS + 1).collect()]
    if len(keys) > MOST_PROJECTS:
        raise ValueError(f"over {MOST_PROJECTS} projects: choose which to compare")
    later = F.filter(F.array(*map(F.lit, keys)).cast(f"array<{dict(rows.dtypes)['a']}>"), lambda k: k > F.col("a"))
    pairs = sizes.select("a", F.col("_n").alias("_na"), F.explode(later).alias("b")).join(sizes.toDF("b", "_nb"), "b")
    met = rows.join(rows.toDF("b", "_x"), "_x").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    common = F.coalesce("common", F.lit(0))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", common.alias("common"), (F.col("_na") - common).alias("only_a"), (F.col("_nb") - common).alias("only_b"))


def either_direction(left: DataFrame, right: DataFrame, src: str, dst: str) -> DataFrame:
    """Rows of ``left`` whose ends are linked on the right in one direction or the other: one equi join with both turns, not an OR."""
    r = right.select(src, dst)
    turned = r.select(F.col(dst).alias(src), F.col(src).alias(dst))
    return left.join(r.union(turned), [src, dst], "left_semi")


def first_definer(extensions: DataFrame, definitions: DataFrame, name: str, owner: str, order: str) -> DataFrame:
    """The first owner that defines what another owner extends."""
    first = definitions.groupBy(name).agg(F.min_by(owner, order).alias("definer"))
    return extensions.join(first, name).filter(F.col(owner) != F.col("definer"))


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ranked(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows with ``rank``, their number within the keys by ``order``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


#: Fixed value: what describes a sub-project, read before its other files.
MANIFEST = r"(^|/)(__manifest__\.py|__openerp__\.py|package\.json|go\.mod|Cargo\.toml|pyproject\.toml|setup\.py|composer\.json|pom\.xml|build\.gradle(\.kts)?|[^/]+\.csproj|Gemfile|mix\.exs|pubspec\.yaml)$"
#: Order of the states of files in a broad run.
STATE_RANK = {"NOT_ANALYZED": 0, "OUTDATED": 1, "PARTIAL": 2}


def reading_order(files: DataFrame, first: list[str], last: list[str]) -> DataFrame:
    """path and place (from 1): files under ``first`` entries, then the rest, then those under ``last`` entries.

    The longest entry above a file decides, one of ``first`` on a tie. Within a group: the state, then the path, a manifest
    before all else in its folder. ``files``: path, status.
    """
    path = F.col("path")

    def best(entries: list[str]) -> Column:
        hits = [F.when((path == e) | F.startswith(path, F.lit(e + "/")), F.struct(F.lit(len(e)).alias("n"), F.lit(-k).alias("k"))) for k, e in enumerate(entries)]
        none = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("k"))
        return F.array_max(F.array(none, *[F.coalesce(h, none) for h in hits]))

    a, b = best([e.strip("/") for e in first]), best([e.strip("/") for e in last])
    group = F.when((a["n"] < 0) & (b["n"] < 0), len(first)).when(a["n"] >= b["n"], -a["k"]).otherwise(len(first) + 1 - b["k"])
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv]), F.col("status")), F.lit(len(STATE_RANK)))
    key = F.when(path.rlike(MANIFEST), F.concat(F.regexp_extract(path, "^(.*/)?", 0), F.lit("\x00"), path)).otherwise(path)
    keyed = files.withColumn("_order", F.struct(group.alias("g"), rank.alias("r"), key.alias("k")))
    return keyed.select("path", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_order")).cast("long").alias("place"))
