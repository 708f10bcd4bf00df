"""Queries over a corpus of texts: sizes, lines, token estimates and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, code points, lines and estimated tokens by language and source, with every subtotal."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    sized = d.select(
        "lang",
        "source",
        F.length("text").cast("long").alias("chars"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("lines"),
        F.ceil(F.length("text") / F.lit(3.6).cast("double")).cast("long").alias("tokens"),
    )
    return sized.cube("lang", "source").agg(
        F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens")
    )


QUERIES = {"corpus_rollup": corpus_rollup}
ORACLES = {
    "corpus_rollup": """
select lang, source, count(*) as docs, sum(length(text))::bigint as chars,
       sum(len(string_split(text, chr(10))))::bigint as lines, sum(ceil(length(text) / 3.6::double))::bigint as tokens
from documents group by cube (lang, source)""",
}
