"""Documents kept by version: what is written anew, what is archived, what stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The line that says when a document was made (fixed value); two bodies that differ there only are the same.
STAMP = r"Generated: [^\n]*"


def body_hash(body: Column) -> Column:
    """The hash of a body apart from its first time stamp; null for none."""
    at = F.regexp_instr(body, F.lit(STAMP))
    size = F.length(F.regexp_substr(body, F.lit(STAMP)))
    bare = F.when(at > 0, F.concat(F.substring(body, F.lit(1), at - 1), F.lit("Generated: {{GENERATED}}"), F.substring(body, at + size, F.length(body)))).otherwise(body)
    return F.sha2(bare, 256)


def first_versions(load: DataFrame, key: str, body: str, at: Column) -> DataFrame:
    """A store that holds each document of a load as its first version."""
    return load.select(key, body, body_hash(F.col(body)).alias("hash"), F.lit(1).cast("long").alias("version"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))


def next_versions(store: DataFrame, load: DataFrame, key: str, body: str, at: Column, close_missing: bool = False) -> DataFrame:
    """The store after a load at the time ``at``: key, body, hash, version, valid_from, valid_to (null: current).

    A document whose hash is the current version's is not written; another one ends that version and begins the next. One
    that the load lacks stays current, or ends with ``close_missing``; if it comes back it is a new version. A load has one row a
    key (of several the least body counts), keys are not null. One shuffle by key joins the current versions; archived ones
    are passed on as they are.
    """
    new = load.groupBy(key).agg(F.min(body).alias("_body")).withColumn("_hash", body_hash(F.col("_body"))).withColumnRenamed(key, "_key")
    last = store.groupBy(key).agg(F.max_by(F.struct("hash", "valid_to", "version"), "version").alias("_last"))
    met = last.join(new, F.col(key) == F.col("_key"), "full").withColumn("_is", F.coalesce(key, "_key"))
    lives = F.col("_last").isNotNull() & F.col("_last.valid_to").isNull()
    same = lives & F.col("_last.hash").eqNullSafe(F.col("_hash"))
    comes = F.col("_key").isNotNull() & ~same
    ends = lives & (comes | (F.col("_key").isNull() & F.lit(close_missing)))
    decided = met.select("_is", "_body", "_hash", F.coalesce("_last.version", F.lit(0)).alias("_version"), comes.alias("_comes"), ends.alias("_ends"))
    ended = decided.filter("_ends").select(F.col("_is").alias("_k"), F.col("_version").alias("_v"))
    kept = store.join(ended, (F.col(key) == F.col("_k")) & (F.col("version") == F.col("_v")), "left")
    kept = kept.withColumn("valid_to", F.when(F.col("_k").isNotNull(), at).otherwise(F.col("valid_to"))).select(*store.columns)
    begun = decided.filter("_comes").select(F.col("_is").alias(key), F.col("_body").alias(body), F.col("_hash").alias("hash"), (F.col("_version") + 1).alias("version"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return kept.unionByName(begun)
