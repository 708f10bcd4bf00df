"""What a task holds does not grow with the input: rows are dealt by how many they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella import queries as core
from tessella.operators import graph
from tessella.sources import scratch
from tests.compare import SF_DIR


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 50).alias("src"), F.when(F.col("id") % 9 > 0, F.col("id") % 1000).alias("dst"))
    edges = graph.distinct_edges(rows)
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 200 and edges.count() == rows.distinct().count()
    assert graph.distinct_edges(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["g01_r03_degrees", "g10_g11_impact", "j20_either_direction"])
def test_queries_deal_before_they_hold_distinct_rows(spark, monkeypatch, capsys, name):
    monkeypatch.setattr(scratch, "ROWS", 100)
    n = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    core.queries()[name](spark, SF_DIR).explain()
    assert f", {-(-n // 100)}), REPARTITION_BY_NUM" in capsys.readouterr().out


def test_a_task_is_dealt_half_a_million_rows(spark):
    rows = spark.range(8_000_000).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst"))
    sizes = [r["count"] for r in scratch.dealt(rows, "dst").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 510_000
