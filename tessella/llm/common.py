"""What the operators of this subpackage share: words, scratch tables and guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: A table is broadcast only when it was materialized and holds at most this many rows.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """Bind an expression once inside another: a one-element transform, so a lambda does not evaluate it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, local mode takes a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessella.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.scratch.dir", root)
    return root.rstrip("/")


#: Rows of one file of a small table (ids, scores, labels).
FILE_ROWS = 1_000_000


def _gathered(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.repartition(rows // FILE_ROWS + 4)


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and sizes are known.

    A lost executor then costs a read of files that every other one can also read. With an upper bound for its ``rows``, a
    table of narrow rows is gathered into few files, since each costs the store some calls whatever its size.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessella/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _gathered(df, rows).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator writes and reads again, dropped with their files when the ``with`` block ends."""

    DATABASE = "tessella_scratch"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: list[str] = []

    def __enter__(self) -> Scratch:
        where = f"{scratch_root(self.spark)}/tessella/{self.spark.sparkContext.applicationId}/tables"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.DATABASE} LOCATION '{where}'")
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def keep(self, df: DataFrame, tag: str, rows: int | None = None, **options: str) -> DataFrame:
        """Like ``materialize``; ``options`` are the writer's."""
        name = f"{self.DATABASE}.{tag}_{uuid.uuid4().hex}"
        _gathered(df, rows).write.format("parquet").options(**options).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self, df_tag: str) -> None:
        """Drop the tables of one tag before the block ends."""
        for name in [n for n in self.names if n.startswith(f"{self.DATABASE}.{df_tag}_")]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.names.remove(name)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within the limit, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= limit else df
