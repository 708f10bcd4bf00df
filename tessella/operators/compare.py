"""Two projects as items by category, side by side: what both have, what one has, and what differs by four rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import joins as J
from tessella.sources.scratch import written

#: Items that a suggestion names.
SHOWN = 12


def _key(name: Column) -> Column:
    return T.singular(T.name_key(name))


def items(columns: DataFrame, routes: DataFrame, packages: DataFrame, languages: DataFrame) -> DataFrame:
    """category, key, label and detail, the first of each key.

    ``columns``: entity, field, type, required. ``routes``: method, endpoint, protected. ``packages``: name, version.
    ``languages``: language, files.
    """
    tables = columns.groupBy("entity").agg(F.count("*").alias("n"))
    need = F.when(F.col("required"), ", required").otherwise("")
    parts = (
        tables.select(F.lit("tables").alias("category"), _key(F.col("entity")).alias("key"), F.col("entity").alias("label"), F.concat(F.col("n"), F.lit(" fields")).alias("detail")),
        columns.select(F.lit("fields"), F.concat(_key(F.col("entity")), F.lit("."), T.name_key(F.col("field"))), F.concat("entity", F.lit("."), "field"), F.concat("type", need)),
        routes.select(
            F.lit("apis"), F.concat(F.upper("method"), F.lit(" "), T.comparison_path(F.col("endpoint"))), F.concat(F.upper("method"), F.lit(" "), "endpoint"),
            F.when(F.col("protected"), "protected").otherwise(""),
        ),
        packages.select(F.lit("modules"), T.name_key(F.col("name")), F.col("name"), F.coalesce("version", F.lit(""))),
        languages.select(F.lit("stack"), F.concat(F.lit("lang:"), "language"), F.col("language"), F.concat(F.col("files").cast("string"), F.lit(" files"))),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return J.latest_per_key(out.filter("key <> ''"), ["category", "key"], F.col("label"), F.col("detail"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """category, key, label, a and b (details), side (common, only_a, only_b) and why they differ (an array, empty if they do not)."""
    x = a.select("category", "key", F.col("label").alias("_la"), F.col("detail").alias("a"), F.lit(True).alias("_a"))
    y = b.select("category", "key", F.col("label").alias("_lb"), F.col("detail").alias("b"), F.lit(True).alias("_b"))
    met = x.join(y, ["category", "key"], "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    kind = lambda c: T.type_family(F.substring_index(c, ",", 1))
    need = lambda c: F.contains(F.col(c), F.lit("required"))
    major = lambda c: F.coalesce(T.major_version(F.col(c)).cast("string"), F.col(c))
    rules = (
        ((F.col("category") == "fields") & (kind("a") != kind("b")), "field type differs"), ((F.col("category") == "fields") & (need("a") != need("b")), "required differs"),
        ((F.col("category") == "modules") & (major("a") != major("b")), "major version differs"), ((F.col("category") == "apis") & (F.col("a") != F.col("b")), "protection differs"),
    )
    why = F.array_compact(F.array(*[F.when(both & test, F.lit(text)) for test, text in rules]))
    side = F.when(both, "common").when(F.col("_a").isNotNull(), "only_a").otherwise("only_b")
    return met.select("category", "key", F.coalesce("_la", "_lb").alias("label"), "a", "b", side.alias("side"), why.alias("why"))


def totals(met: DataFrame) -> DataFrame:
    """category (null: all), common, only_a, only_b and different."""
    counts = [F.count_if(F.col("side") == s).alias(s) for s in ("common", "only_a", "only_b")]
    return met.rollup("category").agg(*counts, F.coalesce(F.sum(F.size("why")), F.lit(0)).alias("different"))


def suggestions(met: DataFrame) -> DataFrame:
    """category, direction (adopt what only b has, keep what only a has, review what differs), its first items and how many more there are."""
    direction = F.when(F.col("side") == "only_b", "adopt").when(F.col("side") == "only_a", "keep").when(F.size("why") > 0, "review")
    named = met.withColumn("direction", direction).filter("direction IS NOT NULL")
    text = F.when(F.col("direction") == "review", F.concat("label", F.lit(" ("), F.array_join("why", ", "), F.lit(")"))).otherwise(F.col("label"))
    ranked = J.ranked(named.withColumn("text", text), ["category", "direction"], F.col("label"))
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= SHOWN, F.struct("rank", "text"))))
    return ranked.groupBy("category", "direction").agg(
        F.array_join(F.transform(F.array_compact(shown), lambda s: s["text"]), "; ").alias("items"), F.greatest(F.count("*") - SHOWN, F.lit(0)).alias("more")
    )


def set_overlaps(items: DataFrame, owner: str, category: str, item: str) -> DataFrame:
    """category, a, b, common, only_a, only_b for each two owners (a < b) with items of a category: their sets as bitmaps.

    Items are numbered once, in a written table, and an owner's set is one bitmap for each 32,768 numbers, so a pair costs a
    union of bitmaps and not a row an item. Repeated items count once; nulls in any column take no part.
    """
    known = items.filter(F.col(owner).isNotNull() & F.col(category).isNotNull() & F.col(item).isNotNull()).select(F.col(owner).alias("owner"), F.col(category).alias("category"), F.col(item).alias("item"))
    numbers = written(known.select("category", "item").distinct().withColumn("no", F.monotonically_increasing_id()), "set-items")
    bits = known.join(numbers, ["category", "item"]).groupBy("owner", "category", F.bitmap_bucket_number("no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits"))
    bits = written(bits, "set-bits")
    sizes = bits.groupBy("owner", "category").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    a, b = sizes.select("category", F.col("owner").alias("a"), F.col("n").alias("n_a")), sizes.select("category", F.col("owner").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "category").filter("a < b")
    met = pairs.withColumn("owner", F.explode(F.array("a", "b"))).join(bits, ["owner", "category"])
    union = met.groupBy("category", "a", "b", "n_a", "n_b", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy("category", "a", "b", "n_a", "n_b").agg(F.sum("n").alias("n"))
    common = F.col("n_a") + F.col("n_b") - F.col("n")
    return union.select("category", "a", "b", common.alias("common"), (F.col("n_a") - common).alias("only_a"), (F.col("n_b") - common).alias("only_b"))


def overlap_matrix(overlaps: DataFrame, categories: list[str]) -> DataFrame:
    """a, b, the common items of each category as a column, and ``line``: what is common and what is not, in words."""
    wide = overlaps.groupBy("a", "b").pivot("category", categories).agg(F.first("common").alias("common"), F.first("only_a").alias("a"), F.first("only_b").alias("b"))
    count = lambda c, what: F.coalesce(F.col(f"{c}_{what}"), F.lit(0)).cast("string")
    said = [F.concat(F.lit(f"{c}: common "), count(c, "common"), F.lit(", only A "), count(c, "a"), F.lit(", only B "), count(c, "b")) for c in categories]
    return wide.select("a", "b", *[F.coalesce(F.col(f"{c}_common"), F.lit(0)).alias(c) for c in categories], F.concat_ws("; ", *said).alias("line"))


def hunks(diffs: DataFrame, key: str, diff: str = "diff", context: int = 3) -> DataFrame:
    """The hunks of line diffs (arrays of marked lines): the key, hunk (from 1), old_start, old_lines, new_start, new_lines,
    n_lines, body and head.

    Changes with at most ``context`` kept lines between them are one hunk, which has up to as many kept lines on either side;
    a kept line can end one hunk and begin the next. A diff without changes, an empty or a null one has no hunks. ``key`` names
    a diff: rows that share it are numbered on as one, so give each its own.

    Hunks are cut within a row by array functions; only they are exchanged, with counts of the lines before them (and the
    body where it is asked for), never all lines of a diff.
    """
    rows = diffs.select(F.col(key), F.col(diff).alias("_diff"))
    changed = F.transform("_diff", lambda x, k: F.when(~F.startswith(x, F.lit(" ")), k))
    rows = rows.withColumn("_at", F.array_compact(changed))
    begins = F.filter("_at", lambda p, k: (k == 0) | (p - F.get("_at", k - 1) > context + 1))
    ends = F.filter("_at", lambda p, k: (k == F.size("_at") - 1) | (F.get("_at", k + 1) - p > context + 1))
    rows = rows.withColumn("_first", begins).withColumn("_last", ends).withColumn("_spans", F.arrays_zip("_first", "_last"))

    def part(x: Column) -> Column:
        low = F.greatest(F.lit(0), x["_first"] - context)
        return F.struct(low.alias("low"), F.slice("_diff", low + 1, x["_last"] + context + 1 - low).alias("lines"))

    parts = rows.select(key, F.posexplode(F.transform("_spans", part)).alias("_k", "_part")).select(key, "_k", "_part.*")
    number = lambda mark: F.size(F.filter("lines", lambda x: F.startswith(x, F.lit(mark)))).cast("long")
    parts = parts.select(key, "_k", "low", F.size("lines").cast("long").alias("n_lines"), number("-").alias("_gone"), number("+").alias("_come"), F.array_join("lines", "\n").alias("body"))
    before = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda other: F.col("low") + 1 - F.coalesce(F.sum(other).over(before), F.lit(0).cast("long"))
    found = parts.select(
        key, (F.col("_k") + 1).cast("long").alias("hunk"), start("_come").alias("old_start"), (F.col("n_lines") - F.col("_come")).alias("old_lines"),
        start("_gone").alias("new_start"), (F.col("n_lines") - F.col("_gone")).alias("new_lines"), "n_lines", "body",
    )
    head = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_lines", "new_start", "new_lines")
    return found.withColumn("head", head)
