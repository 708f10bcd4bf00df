"""Mixing sources to target weights, by exponential keys and token budgets.

Each source gets a budget of words: complete epochs first, and the rest by Efraimidis-Spirakis sampling. A document's
key is -ln(u) / w with u drawn from a hash of its doc_id and text and w its quality weight; documents are taken by ascending key
and a prefix sum of their sizes is cut at the budget. The document at the cut is taken in part, so a source's words
meet the budget to the word.

Scale: a source may hold any share of the rows, so its prefix sum is never one window. exp(-key * mean weight) is a
monotone image of the key that is about uniform; it deals a source into buckets of about ``BUCKET_ROWS`` rows. Bucket
sums (combined before the shuffle) are prefix-summed instead, one row a bucket, and only the buckets in which a budget
ends are ordered, a row for all rows of equal doc_id, text and source, which share a key. Rows without words take none and
are not ordered. Tables joined back have one row a source, and are broadcast only when counted as small.

Everything is built-in expressions; no user function runs.

Defined results for odd input: a null text has size 0; a null source is a source of its own, ordered last; a null
doc_id draws its key by the text, like any other, and so do different texts of one doc_id; repeated rows share one key and
are taken one after another; weights that are null or not positive count as the least weight; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import materialize, n_words_of, small, words_of

BUCKET_ROWS = 1000
#: Equal rows that are told apart at once when they are counted out again.
RUN = 10_000
LEAST_WEIGHT = 0.05
SEED = "mix-1"
WEIGHTS = (3.0, 1.0, 2.0)


def uniform(doc_id: Column, mark: Column, seed: str = SEED) -> Column:
    """A draw in (0, 1) from 52 bits of a hash of seed, doc_id and the text's digest; the same in every run."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), mark)
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def quality_weight(text: Column) -> Column:
    """Fewer symbols a word weigh more: 1 / (1 + symbols / words), at least ``LEAST_WEIGHT``."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 / (1 + symbols / F.greatest(n_words_of(text), F.lit(1))))


def targets(sources: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """Target words of each source (columns source, source_size): shares by weight, capped, the excess reshared.

    The fixed point of resharing is a common level: the sources with the smallest cap per weight are full, the others
    get level * weight. One row a source is ordered here, never the documents.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    # Of the sources that are not full, the first in order of cap per weight has the common level.
    first = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("common", first)
    return w.select(
        "source", "source_size", "n_docs", "mean_weight",
        F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column,
    quality: Column,
    mark: Column,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken words of every row of ``docs`` (columns doc_id, source).

    ``mark`` is the text's digest, which tells rows of one doc_id, or of none, apart. Other columns named in ``keep`` (small ones, such as a digest) are carried along.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            *keep,
            F.col("source").cast("string").alias("source"),
            size.cast("long").alias("size"),
            F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(quality, F.lit(LEAST_WEIGHT))).alias("weight"),
            uniform(F.col("doc_id"), mark, seed).alias("u"),
        ),
        "mix-rows",
    )
    per_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.avg("weight").alias("mean_weight")
    )
    goals = materialize(targets(per_source, share, most, weights), "mix-targets", 0)
    n_sources, n_docs = goals.agg(F.count("*"), F.sum("n_docs")).first()
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = goals.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    g = goals.withColumnRenamed("source", "_source")
    keyed = rows.join(small(g, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = -F.log("u") / F.col("weight")
    image = F.exp(-key * F.col("mean_weight"))  # 1 for the first of the source, about uniform
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    keyed = keyed.withColumn("key", key).withColumn("bucket", F.least(buckets - 1, F.floor((1 - image) * buckets)))

    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    #: 1: all of the bucket is taken; 0: none; null: the budget ends in it.
    whole = F.when(F.col("before") + F.col("words") <= F.col("budget"), 1).when(F.col("before") >= F.col("budget"), 0)
    sums = materialize(sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before", whole.alias("whole")), "mix-buckets", n_docs or 0)
    known = small(sums, (n_docs or 0) // BUCKET_ROWS + 2 * n_sources)
    dealt = keyed.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))).drop("_source", "_bucket")

    columns = ("doc_id", *keep, "source", "size", "source_size", "target")
    epochs = F.col("epochs") * F.col("size")
    settled = dealt.filter(F.col("whole").isNotNull() | (F.col("size") == 0))
    settled = settled.select(*columns, (epochs + F.coalesce("whole", F.lit(0)) * F.col("size")).cast("long").alias("taken"))
    cut = dealt.filter(F.col("whole").isNull() & (F.col("size") > 0))
    cut = cut.groupBy(*columns, "epochs", "before", "budget", "bucket", "key").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("_n")).over(in_order), F.lit(0)))
    cut = cut.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    cut = cut.withColumn("_row", F.explode(F.sequence("_run", F.least(F.col("_run") + RUN, F.col("_n")) - 1)))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - F.col("_at") - F.col("_row") * F.col("size")))
    return settled.unionByName(cut.select(*columns, (epochs + part).cast("long").alias("taken")))


def draw(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` (with text) for each time it is taken, with ``copy`` from 1.

    The document at which a budget ends is cut to the words that are taken, joined by single spaces. Other columns are
    carried as they are, whatever their names, but for an input column ``copy``, which the number replaces.
    """
    others = [c for c in docs.columns if c not in ("text", "copy")]
    mark = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    marked = docs.select(F.struct(F.lit(0), *others).alias("_row"), "doc_id", "source", "text", mark.alias("_mark"))
    mixed = mix(marked, n_words_of(F.col("text")), quality_weight(F.col("text")), F.lower(F.hex("_mark")), keep=("_mark",), **options)
    # Of equal rows some are taken once more, one in part, the others not: at most three counts, the most words first.
    counts = mixed.groupBy("doc_id", "_mark", "source", "size", "taken").agg(F.count("*").alias("n"))
    takes = F.reverse(F.array_sort(F.collect_list(F.struct("taken", "n"))))
    taken = counts.groupBy(F.col("doc_id").alias("_id"), F.col("_mark").alias("_of"), F.col("source").alias("_from"), F.col("size").alias("_size")).agg(takes.alias("_takes"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of")) & F.col("source").cast("string").eqNullSafe(F.col("_from"))
    met = marked.join(taken.filter(F.get("_takes", F.lit(0))["taken"] > 0), same)
    # Rows are numbered only where a budget ends among equal ones: in one group a source at most.
    alike = met.filter(F.size("_takes") == 1).withColumn("_n", F.lit(1))
    unlike = met.filter(F.size("_takes") > 1).withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_of", "_from").orderBy(F.lit(0))))
    of = lambda k, name: F.get("_takes", F.lit(k))[name]
    words = F.when((F.size("_takes") == 1) | (F.col("_n") <= of(0, "n")), of(0, "taken")).when(F.col("_n") <= of(0, "n") + of(1, "n"), of(1, "taken")).otherwise(of(2, "taken"))
    met = alike.unionByName(unlike).withColumn("_words", words).filter("_words > 0")
    size, words = F.col("_size"), F.col("_words")
    copies = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(words / size))))
    rest = (words - (F.col("copy") - 1) * size).cast("int")
    text = F.when(rest >= size, F.col("text")).otherwise(F.array_join(F.slice(words_of(F.col("text")), F.lit(1), rest), " "))
    kept = [(text if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns if c != "copy"]
    return copies.select(*kept, "copy")


def op1(docs: DataFrame) -> DataFrame:
    mixed = mix(docs, n_words_of(F.col("text")), quality_weight(F.col("text")), F.md5(F.coalesce("text", F.lit(""))))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as symbols,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from {rel}
), k as (
  select *, -ln(u) / greatest(0.05, 1 / (1 + symbols / greatest(size, 1)::double)) as key from d
), s as (
  select source, sum(size)::bigint as source_size, 2.0 * sum(size) as cap,
         [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from d group by source
), l as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (o rows between current row and unbounded following) as level
  from s window o as (order by cap / weight, source nulls last)
), c as (
  select (select level from l where level * weight < cap order by cap / weight, source nulls last limit 1) as common
), t as (
  select source, source_size, coalesce(least(cap, common * weight), cap)::double as target from l, c
), e as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t
), p as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size) as budget,
         coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as before
  from k join e on k.source is not distinct from e.source
)
select doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, budget - before)))::bigint as taken from p
"""


def sql(rel: str = "documents") -> str:
    return SQL.replace("{rel}", rel)
