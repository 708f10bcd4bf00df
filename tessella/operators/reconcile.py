"""Checked claims merged into a store of knowledge: versions, conflicts, and what could not be confirmed.

Subjects of all kinds (file, feature, workflow, entity, relationship, architecture, module) are rows of one table of
cells: kind, id, part, item, value, status. A part is a single value (purpose, overview: no item) or a list of items
(fields, steps, claims). One full join by cell merges them; what is known from the source itself never gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import name_key, status_rank

CELL = ["kind", "id", "part", "item"]
#: The type that a relationship has when it is read from its other end (fixed values).
INVERSE = {"one-to-many": "many-to-one", "many-to-one": "one-to-many"}


def contains_name(text: Column, name: Column) -> Column:
    """Whether a name stands in a text, apart from case and from what is no letter or digit in the name; an empty one does not."""
    return (name_key(name) != "") & F.contains(name_key(text), name_key(name))


def same_type(claimed: Column, known: Column) -> Column:
    """A claimed type agrees with a known one if it is the same name or a part of it; an unknown one agrees with all."""
    return F.coalesce((name_key(claimed) == name_key(known)) | F.contains(F.lower(known), F.lower(claimed)), F.lit(True))


def check_fields(claims: DataFrame, known: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claimed fields of entities: entity, field, type, status, basis, known_type, conflict.

    ``claims``: entity, field, type; ``known``: entity, field, type, from the source; ``evidence``: entity, field, text, a
    row for each valid piece. Names meet by ``name_key``. A field known from the source is VERIFIED with the source's
    name and type; ``conflict`` says that the claim had another type. Otherwise a piece of evidence that names the field
    makes it VERIFIED, and without one it is UNKNOWN. Of known fields with one key the least name counts; repeated claims
    give a row each; a null name meets nothing.
    """
    k = known.groupBy(name_key(F.col("entity")).alias("_e"), name_key(F.col("field")).alias("_f")).agg(F.min(F.struct("field", "type")).alias("_known"))
    shown = evidence.filter(contains_name(F.col("text"), F.col("field"))).select(F.col("entity").alias("_ev"), F.col("field").alias("_fv")).distinct()
    c = claims.select("entity", "field", "type", name_key(F.col("entity")).alias("_e"), name_key(F.col("field")).alias("_f"))
    met = c.join(k, ["_e", "_f"], "left").join(shown, (F.col("entity") == F.col("_ev")) & (F.col("field") == F.col("_fv")), "left")
    static, seen = F.col("_known").isNotNull(), F.col("_ev").isNotNull()
    return met.select(
        "entity", F.when(static, F.col("_known.field")).otherwise(F.col("field")).alias("field"), F.when(static, F.col("_known.type")).otherwise(F.col("type")).alias("type"),
        F.when(static | seen, "VERIFIED").otherwise("UNKNOWN").alias("status"), F.when(static, "static analysis").when(seen, "source text").alias("basis"),
        F.when(static, F.col("type")).alias("claimed_type"), F.when(static, ~same_type(F.col("type"), F.col("_known.type"))).otherwise(False).alias("conflict"),
    )


def check_relations(claims: DataFrame, known: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claimed relationships: src, dst, type, status, basis, claimed_type, conflict.

    ``claims`` and ``known``: src, dst, type; ``evidence``: src, dst, text. One known in either direction is VERIFIED as it
    is known; a claimed type that is neither the known one nor its inverse is a conflict. Otherwise a piece of evidence that
    names both ends makes it INFERRED, and without one it is UNKNOWN. Of several known ones between two ends the least counts.
    """
    ends = lambda a, b: F.array_sort(F.array(name_key(F.col(a)), name_key(F.col(b))))
    k = known.groupBy(ends("src", "dst").alias("_ends")).agg(F.min(F.struct("src", "dst", "type")).alias("_known"))
    shown = evidence.filter(contains_name(F.col("text"), F.col("src")) & contains_name(F.col("text"), F.col("dst"))).select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    c = claims.select("src", "dst", "type", ends("src", "dst").alias("_ends"))
    met = c.join(k, "_ends", "left").join(shown, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
    static, seen, known_type = F.col("_known").isNotNull(), F.col("_s").isNotNull(), F.col("_known.type")
    inverse = known_type
    for a, b in INVERSE.items():
        inverse = F.when(known_type == a, b).otherwise(inverse)
    agrees = (name_key(F.col("type")) == name_key(known_type)) | (name_key(F.col("type")) == name_key(inverse))
    as_known = lambda c: F.when(static, F.col(f"_known.{c}")).otherwise(F.col(c)).alias(c)
    return met.select(
        as_known("src"), as_known("dst"), as_known("type"), F.when(static, "VERIFIED").when(seen, "INFERRED").otherwise("UNKNOWN").alias("status"),
        F.when(static, "static analysis").when(seen, "both entities appear in cited source").alias("basis"),
        F.when(static, F.col("type")).alias("claimed_type"), F.when(static, F.coalesce(~agrees, F.lit(False))).otherwise(False).alias("conflict"),
    )


def check_features(claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Claimed features of modules with ``status`` and ``matched``, the names they are based on that the module has.

    ``claims``: module, feature, status, based_on (array); ``vocabulary``: module, name. A name matches by its key, whole
    or by one of its parts of over two letters; keys of two letters or fewer match nothing. VERIFIED needs a match and
    becomes INFERRED without one; no status is INFERRED. Claims on a module without any name are UNKNOWN.
    """
    v = vocabulary.select(F.col("module").alias("_m"), name_key(F.col("name")).alias("_key")).filter(F.length("_key") > 2).distinct()
    modules = vocabulary.select("module").distinct().withColumn("_is", F.lit(True))
    numbered = claims.select("module", "feature", "status", F.coalesce("based_on", F.array().cast("array<string>")).alias("based_on"))
    parts = lambda b: F.array_union(F.array(name_key(b)), F.transform(F.filter(F.split(b, r"[\s,()]+"), lambda x: F.length(x) > 2), name_key))
    names = numbered.select("module", "feature", F.explode(F.array_distinct("based_on")).alias("_b")).distinct().select("module", "feature", "_b", F.explode(parts(F.col("_b"))).alias("_key"))
    hits = names.join(v, (F.col("module") == F.col("_m")) & (names["_key"] == v["_key"])).groupBy("module", "feature").agg(F.collect_set("_b").alias("_hits"))
    met = numbered.join(modules, "module", "left").join(hits, ["module", "feature"], "left")
    matched = F.array_sort(F.array_intersect("based_on", F.coalesce("_hits", F.array().cast("array<string>"))))
    status = F.when(F.col("_is").isNull(), "UNKNOWN").when((F.col("status") == "VERIFIED") & (F.size(matched) == 0), "INFERRED").otherwise(F.coalesce("status", F.lit("INFERRED")))
    return met.select("module", "feature", status.alias("status"), matched.alias("matched"))


def _id() -> Column:
    """A relationship is the same from either end."""
    turned = F.array_join(F.array_sort(F.split("id", ">")), ">")
    return F.when(F.col("kind") == "relationship", turned).otherwise(F.col("id"))


def reconcile(store: DataFrame, found: DataFrame, run: str) -> DataFrame:
    """Every cell after a run: kind, id, part, item, value, status, origin, run, version, alternative, outcome.

    ``store``: the cells with origin (SOURCE or AI), stale (their source changed), run and version of the subject.
    ``found``: the checked cells of the run, one row a cell (of repeated ones the best status counts, then the least value).

    * A cell of the source stays; an unlike found value is its ``alternative``, outcome ``conflict``.
    * A single value (no item): equal values take the better status; a stale one gives way; a higher rank wins; of equal
      ranks the old stays. An item of a list gives way to one of at least its rank. The loser is ``alternative``.
    * A known relationship stays as it is, from whichever end it is found.
    * A subject that only claims speak of and no one confirmed (UNKNOWN) is reported, outcome ``unverified``, not stored.

    Other outcomes: ``kept``, ``changed``, ``added``. ``run`` is that which set the value. The version of a subject rises by one
    in a run that changed or added a cell; a new subject has version 1.
    """
    s = store.withColumn("id", _id()).select(*CELL, *[F.col(c).alias(f"_{c}") for c in ("value", "status", "origin", "stale", "run", "version")], F.lit(True).alias("_old"))
    rank = status_rank(F.col("status"))
    n = found.withColumn("id", _id()).groupBy(*CELL).agg(F.min(F.struct((-rank).alias("r"), F.col("value").alias("v"), F.col("status").alias("s"))).alias("_new"))
    same_cell = [s[c].eqNullSafe(n[c]) for c in CELL]
    on = same_cell[0]
    for c in same_cell[1:]:
        on = on & c
    old, new, new_status = F.coalesce("_old", F.lit(False)), F.col("_new.v"), F.col("_new.s")
    met = s.join(n, on, "full").select(*[F.coalesce(s[c], n[c]).alias(c) for c in CELL], "_value", "_status", "_origin", "_stale", "_run", "_version", "_old", "_new")
    gain, same = status_rank(new_status) - status_rank(F.col("_status")), F.col("_value").eqNullSafe(new)
    single = F.when(same, gain > 0).when(F.coalesce("_stale", F.lit(False)), True).otherwise(gain > 0)
    take = (
        F.when(F.col("_new").isNull() | new.isNull(), False).when(~old, True).when((F.col("_origin") == "SOURCE") | (F.col("kind") == "relationship"), False)
        .when(F.col("_value").isNull(), True).when(F.col("item").isNull(), single).otherwise((gain >= 0) & ~(same & (gain == 0)))
    )
    unlike = old & F.col("_new").isNotNull() & new.isNotNull() & F.col("_value").isNotNull() & ~same
    outcome = (
        F.when(~old & (new_status == "UNKNOWN"), "unverified").when(~old & new.isNull(), "unverified").when(~old, "added").when(F.col("_take"), "changed")
        .when((F.col("_origin") == "SOURCE") & unlike, "conflict").otherwise("kept")
    )
    cells = met.withColumn("_take", take)
    pick = lambda a, b: F.when(F.col("_take") | ~old, a).otherwise(b)
    cells = cells.select(
        *CELL, pick(new, F.col("_value")).alias("value"), pick(new_status, F.col("_status")).alias("status"), F.coalesce("_origin", F.lit("AI")).alias("origin"),
        pick(F.lit(run), F.col("_run")).alias("run"), F.col("_version"), F.when(unlike, F.when(F.col("_take"), F.col("_value")).otherwise(new)).alias("alternative"), outcome.alias("outcome"),
    )
    changed = F.bool_or(F.col("outcome").isin("added", "changed")).cast("long")
    subjects = cells.filter("outcome <> 'unverified'").groupBy("kind", F.col("id").alias("_id")).agg((F.coalesce(F.max("_version"), F.lit(0)) + changed).alias("version"))
    subjects = subjects.withColumnRenamed("kind", "_kind")
    versioned = cells.join(subjects, (F.col("kind") == F.col("_kind")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("outcome") != "unverified"), "left")
    return versioned.select(*CELL, "value", "status", "origin", "run", "version", "alternative", "outcome")


def stored(cells: DataFrame) -> DataFrame:
    """The store after ``reconcile``, as the next run takes it."""
    return cells.filter("outcome <> 'unverified'").select(*CELL, "value", "status", "origin", F.lit(False).alias("stale"), "run", "version")


def conflicts(cells: DataFrame) -> DataFrame:
    """What claims said against the source; the source's value holds."""
    return cells.filter("outcome = 'conflict'").select(*CELL, F.col("value").alias("source_value"), F.col("alternative").alias("claimed"), F.lit("source wins").alias("resolution"))


def changes(cells: DataFrame) -> DataFrame:
    """Cells by kind and outcome."""
    return cells.groupBy("kind", "outcome").agg(F.count("*").alias("cells"), F.countDistinct("id").alias("subjects"))
