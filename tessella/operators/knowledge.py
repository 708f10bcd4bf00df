"""Merging and checking of claims: values with ranks, evidence against sources, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import status_rank


def merge_values(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One value a key from stored and new cells (value, status, stale). In order: no new value keeps the old; no old
    value takes the new; equal values take the better status; a stale old value gives way; a higher rank wins; of equal
    ranks the old stays. A value that gives way or is refused while unlike is kept as ``alternative``."""
    o = old.select(*key, F.col("value").alias("ov"), F.col("status").alias("os"), F.col("stale").alias("ost"))
    n = new.select(*key, F.col("value").alias("nv"), F.col("status").alias("ns"))
    same = F.col("ov") == F.col("nv")
    better = status_rank(F.col("ns")) > status_rank(F.col("os"))
    take = F.when(F.col("nv").isNull(), False).when(F.col("ov").isNull(), True).when(same, better).when(F.col("ost"), True).otherwise(better)
    met = o.join(n, key, "full").withColumn("take", F.coalesce(take, F.lit(True)))
    lost = F.when(F.col("ov").isNotNull() & F.col("nv").isNotNull() & ~same, F.when(F.col("take"), F.col("ov")).otherwise(F.col("nv")))
    return met.select(
        *key, F.when(F.col("take"), F.col("nv")).otherwise(F.col("ov")).alias("value"), F.when(F.col("take"), F.col("ns")).otherwise(F.col("os")).alias("status"),
        lost.alias("alternative"),
    )


def merge_batches(rows: DataFrame, key: list[str], text: str, attribute: str, items: str, order: str) -> DataFrame:
    """Of several packages: the first text that is not empty, the last attribute, the union of lists."""
    filled = F.col(text).isNotNull() & (F.col(text) != "")
    return rows.groupBy(*key).agg(
        F.min_by(text, F.when(filled, F.col(order))).alias(text),
        F.max_by(attribute, F.when(F.col(attribute).isNotNull(), F.col(order))).alias(attribute),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
    )


def check_evidence(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Each piece of evidence with ``reason``: null when valid, else the first of unsafe_path, unknown_file, stale_hash,
    bad_lines, not_found. ``evidence``: path, hash, first, last, quote; ``files``: path, text, hash, lines."""
    f = files.select("path", F.col("text").alias("_text"), F.col("hash").alias("_hash"), F.col("lines").alias("_lines"))
    met = evidence.join(f, "path", "left")
    reason = (
        F.when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), "unsafe_path")
        .when(F.col("_hash").isNull(), "unknown_file")
        .when(F.col("hash") != F.col("_hash"), "stale_hash")
        .when((F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > F.col("_lines")), "bad_lines")
        .when(~F.contains(F.col("_text"), F.col("quote")), "not_found")
    )
    return met.withColumn("reason", reason).drop("_text", "_hash", "_lines")


def verdicts(checked: DataFrame, claim: list[str]) -> DataFrame:
    """VERIFIED if a piece of evidence is valid, OUTDATED if one was before its file changed, else REJECTED."""
    return checked.groupBy(*claim).agg(
        F.when(F.count_if(F.col("reason").isNull()) > 0, "VERIFIED").when(F.count_if(F.col("reason") == "stale_hash") > 0, "OUTDATED").otherwise("REJECTED").alias("verdict"),
        F.count_if(F.col("reason").isNull()).alias("valid"), F.count("*").alias("pieces"),
    )


def file_status(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """NOT_ANALYZED, ANALYZED, PARTIAL or OUTDATED. ``files``: path, hash; ``analyses``: path, hash, complete (the last one)."""
    a = analyses.select("path", F.col("hash").alias("_hash"), "complete")
    status = F.when(F.col("_hash").isNull(), "NOT_ANALYZED").when(F.col("_hash") != F.col("hash"), "OUTDATED").when(F.col("complete"), "ANALYZED").otherwise("PARTIAL")
    return files.join(a, "path", "left").select("path", status.alias("status"))


def stale_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """doc, stale: whether a source of a document has another hash or is gone. ``documents``: a row of doc, path and hash for each source."""
    s = documents.select("doc", "path", F.col("hash").alias("_was"))
    met = s.join(files.select("path", "hash"), "path", "left")
    gone = F.col("path").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_was"))
    return met.groupBy("doc").agg(F.bool_or(gone).alias("stale"))


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that have no cached facts for their hash and the analyzer's revision."""
    return files.join(cache.select("path", "hash", "revision"), ["path", "hash", "revision"], "left_anti")
