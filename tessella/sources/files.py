"""Source trees as tables, and versioned tables as sinks.

A tree is read by Spark's own ``binaryFile`` source, so it is split over executors and can lie in any store. Everything
after that is built-in expressions over (path, length, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as T

#: How code names environment variables; the first group is the name.
ENVIRONMENT = (
    r"process\.env\.([A-Z_][A-Z0-9_]*)",
    r"process\.env\[['\"]([A-Z_][A-Z0-9_]*)['\"]\]",
    r"import\.meta\.env\.([A-Z_][A-Z0-9_]*)",
    r"os\.environ(?:\.get)?\(?\[?['\"]([A-Z_][A-Z0-9_]*)['\"]",
    r"os\.getenv\(['\"]([A-Z_][A-Z0-9_]*)['\"]",
    r"getenv\(['\"]([A-Z_][A-Z0-9_]*)['\"]\)",
    r"env\(['\"]([A-Z_][A-Z0-9_]*)['\"]",
    r"os\.(?:Getenv|LookupEnv)\(\s*[\"']([A-Za-z_][A-Za-z0-9_]*)[\"']",
    r"Environment\.GetEnvironmentVariable\([\"']([A-Za-z_][A-Za-z0-9_]*)[\"']",
)


def relative(path: Column, root: str) -> Column:
    """The path below ``root``, without a scheme."""
    plain = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    return F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path, bytes, modified, language, is_binary, hash, lines, tokens and text of each file under ``root``.

    Hash, lines and tokens of binary files are null; so is their text. Spark lists no hidden and no empty files; files such
    as ``.env`` can be read by naming them as ``root``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = raw.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    if exclude:
        files = files.filter(~P.excluded(F.col("path"), exclude))
    binary = P.is_binary(F.col("path"), F.col("bytes"), F.col("content"))
    texts = files.withColumn("is_binary", binary).withColumn("text", F.when(~F.col("is_binary"), F.col("content").cast("string")))
    return texts.select(
        "path", "bytes", "modified", P.language(F.col("path")).alias("language"), "is_binary", F.when(~F.col("is_binary"), T.content_hash(F.col("text"))).alias("hash"),
        T.lines_scan(F.col("text")).alias("lines"), T.token_estimate(F.col("text")).alias("tokens"), "text",
    )


def config_files(files: DataFrame) -> DataFrame:
    return files.select("path", P.config_kind(F.col("path")).alias("kind")).filter("kind IS NOT NULL")


def environment_names(files: DataFrame) -> DataFrame:
    """name and the sorted paths that refer to it or declare it (in ``.env*`` files); values are never read out."""
    found = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in ENVIRONMENT]))
    declared = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*="), F.lit(1))
    names = F.when(P.basename(F.col("path")).startswith(".env"), declared).otherwise(found)
    pairs = files.filter("text IS NOT NULL").select("path", F.explode(F.array_distinct(names)).alias("name"))
    return pairs.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def packages(files: DataFrame) -> DataFrame:
    """path, name, version and dev flag of each dependency in package.json, requirements and go.mod manifests."""
    base = P.basename(F.col("path"))
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = files.filter(base == "package.json").select("path", F.from_json("text", schema).alias("m"))
    parts = [
        parsed.select("path", F.explode(f"m.{c}").alias("name", "version"), F.lit(c == "devDependencies").alias("dev")) for c in ("dependencies", "devDependencies")
    ]
    lines = files.select("path", base.alias("base"), F.explode(F.split("text", "\n")).alias("line"))
    for test, pattern in ((F.col("base").rlike(r"^requirements.*\.txt$"), r"^\s*([A-Za-z0-9_.-]+)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?[^;#\s]*)?)"), (F.col("base") == "go.mod", r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+(v\S+)")):
        named = lines.filter(test).select("path", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"), F.lit(False).alias("dev"))
        parts.append(named.filter("name <> ''"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """One Parquet folder a table under a new version; Spark's commit protocol leaves whole tables or none."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{version}/{name}")


def load_table(spark: SparkSession, root: str, version: str, name: str, schema: str) -> DataFrame:
    """A stored table, or an empty one of that schema where none was stored."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{version}/{name}")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(str(at))
    return spark.createDataFrame([], schema)
