"""Checking what is claimed about a project against its files: references, then verdicts.

A reference is held against files and symbols by equi joins; the first test that fails is its reason. A claim's
references are gathered again, a few each, and one chain of conditions gives the verdict.

Defined results for odd input: a claim without references has none; a null line range means the whole file; an unknown
status is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as T

REFERENCES = "array<struct<file: string, symbol: string, first: int, last: int, hash: string>>"


def check_references(claims: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """claim, n (the reference's number), reason (null: it holds), stale, known (its symbol is one) and the text it cites.

    ``claims``: claim, evidence. ``files``: path, text, hash. ``symbols``: file, name.
    """
    refs = claims.select("claim", F.posexplode("evidence").alias("n", "r")).select("claim", "n", "r.*")
    name = F.element_at(F.split("symbol", "[.#]"), -1)
    refs = refs.withColumn("name", F.when(F.coalesce("symbol", F.lit("")) != "", name))
    there = files.select(F.col("path").alias("file"), "text", F.col("hash").alias("now"), F.lit(True).alias("_there"))
    met = refs.join(there, "file", "left").join(symbols.select("file", "name", F.lit(True).alias("_known")).distinct(), ["file", "name"], "left")
    lines = F.size(F.split("text", "\n", -1))
    last = F.coalesce("last", "first")
    known = F.coalesce("_known", F.lit(False))
    reason = (
        F.when(~P.is_safe(F.col("file")), "unsafe_path")
        .when(F.col("_there").isNull(), "unknown_file")
        .when((F.coalesce("hash", F.lit("")) != "") & (F.col("hash") != F.col("now")), "stale_hash")
        .when(F.col("first").isNotNull() & ~((F.col("first") >= 1) & (last >= F.col("first")) & (last <= lines)), "bad_lines")
        .when(F.col("name").isNotNull() & ~known & ~T.contains_word(F.col("text"), F.col("name")), "unknown_symbol")
    )
    cited = F.when(F.col("first").isNull(), F.col("text")).otherwise(F.array_join(F.slice(F.split("text", "\n", -1), F.greatest(F.col("first"), F.lit(1)), F.greatest(last - F.col("first") + 1, F.lit(0))), "\n"))
    return met.select("claim", "n", reason.alias("reason")  , (reason == "stale_hash").alias("stale"), (known & reason.isNull()).alias("known"), F.when(reason.isNull(), cited).alias("cited"))


def claim_verdicts(claims: DataFrame, references: DataFrame) -> DataFrame:
    """claim, verdict and why, by nine cases. ``claims``: claim, status, subject, body; ``references``: of ``check_references``."""
    by = references.groupBy("claim").agg(
        F.count("*").alias("refs"), F.count_if(F.col("reason").isNull()).alias("good"), F.count_if("stale").alias("stale"), F.bool_or("known").alias("known"),
        F.array_compact(F.collect_list("cited")).alias("texts"),
    )
    tokens = F.when(F.coalesce("subject", F.lit("")) != "", F.array("subject")).otherwise(T.identifiers(F.coalesce("body", F.lit(""))))
    met = claims.select("claim", "status", tokens.alias("tokens")).join(by, "claim", "left")
    found = F.exists("tokens", lambda w: F.exists("texts", lambda x: T.contains_word(x, w)))
    good, refs, stale = (F.coalesce(c, F.lit(0)) > 0 for c in ("good", "refs", "stale"))
    asked, named = F.size("tokens") > 0, F.coalesce(F.col("known"), F.lit(False))
    claimed = F.col("status") == "VERIFIED"
    cases: tuple[tuple[Column, str, str], ...] = (
        (claimed & ~good & stale, "UNKNOWN", "stale evidence"), (claimed & ~good & refs, "UNKNOWN", "evidence does not hold"), (claimed & ~good, "INFERRED", "no evidence"),
        (claimed & asked & found, "VERIFIED", "found in source"), (claimed & asked, "UNKNOWN", "subject not in evidence"),
        (claimed & named, "VERIFIED", "symbol exists"), (claimed, "INFERRED", "not checkable"),
        ((F.col("status") == "INFERRED") & good, "INFERRED", "kept with evidence"), (F.col("status") == "INFERRED", "INFERRED", "kept without evidence"),
    )
    verdict, why = F, F
    for test, v, w in cases:
        verdict, why = verdict.when(test, v), why.when(test, w)
    return met.select("claim", verdict.otherwise(F.col("status")).alias("verdict"), why.otherwise("as given").alias("why"))


def sanitised(claims: DataFrame, batch: DataFrame) -> DataFrame:
    """Claims of a model's answer held to the files it was given: references to others go, hashes are the files' own, VERIFIED without references is INFERRED.

    ``claims``: claim, status, evidence. ``batch``: path, hash.
    """
    refs = claims.select("claim", F.posexplode_outer("evidence").alias("n", "r"))
    own = refs.join(batch.select(F.col("path").alias("_path"), F.col("hash").alias("_hash")), F.col("r.file") == F.col("_path"), "left")
    fixed = F.when(F.col("_path").isNotNull(), F.struct("n", F.col("r").withField("hash", F.col("_hash")).alias("r")))
    kept = own.groupBy("claim").agg(F.transform(F.array_sort(F.array_compact(F.collect_list(fixed))), lambda x: x["r"]).alias("evidence"))
    met = claims.drop("evidence").join(kept, "claim")
    return met.withColumn("status", F.when((F.col("status") == "VERIFIED") & (F.size("evidence") == 0), "INFERRED").otherwise(F.col("status")))


def places_exist(places: DataFrame, files: DataFrame) -> DataFrame:
    """place and whether it is a file, a folder or the end of a file's path. ``places``: place; ``files``: path."""
    parts = F.split("path", "/")
    n = F.size(parts)
    tails = files.select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "/"))).alias("place"))
    heads = files.select(F.explode(P.ancestors(F.col("path"))).alias("place"))
    known = tails.union(heads).distinct().withColumn("_known", F.lit(True))
    bare = F.regexp_replace("place", "^/+|/+$", "")
    return places.withColumn("_place", bare).join(known.withColumnRenamed("place", "_place"), "_place", "left").select("place", F.coalesce("_known", F.lit(False)).alias("exists"))
