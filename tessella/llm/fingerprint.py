"""Document fingerprints: a Merkle tree over sections, paragraphs and segments.

A section is a run of lines up to a blank one and that line with it, a paragraph is a line, and a paragraph is cut into
segments of up to ``SEGMENT`` code points, so that an edit inside a long paragraph can be located too. So the sections
hold every character, blanks between them too. Digests are SHA-256 all the way: a paragraph's is that of its segments'
digests, a section's that of its paragraphs', the root that of its sections'. Equal roots mean equal texts.

The fingerprint string is ``root:section|section`` where a section is ``digest=segment,segment;...``, one list of segments
a paragraph; there sections are cut to 16 and segments to 8 hex digits. These short digests serve the likeness and the
search for differing branches, never equality. Likeness is twice the number of distinct segments in common over the sum
of both numbers (1 for two empty texts and whenever the roots are equal, 0 with nothing in common).

All of it is built-in expressions over the row's own text. The neighbour in descending doc_id comes from a table of ids:
ids are ordered in ranges, each range's own window gives the next id, and the ends of ranges are joined by one row a
range. Texts move twice: a document's needed head goes to the one before it, and both meet by doc_id.

Defined results for odd input: a null text counts as empty; null doc_ids come last in descending order; rows of equal
doc_id are ordered by their text's digest, equal ones arbitrarily (their results are equal too); a single row is its
own next document; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import let, materialize

SEGMENT = 64
#: Everything up to a blank line, and with it: the sections of a text, laid end to end, are the text.
SECTIONS = r"(?s).+?(?:\n[ \t]*\n|\z)"
SEGMENTS = f"(?s).{{1,{SEGMENT}}}"
#: Ids that one range of the ordering holds.
RANGE_ROWS = 5000
#: Stands for a null doc_id while documents are matched.
NO_ID = -(2**63)


def tree(text: Column) -> Column:
    """The fingerprint string of a text."""

    def paragraph(p: Column) -> Column:
        digests = F.transform(F.regexp_extract_all(p, F.lit(SEGMENTS), F.lit(0)), lambda x: F.sha2(x, 256))
        short = lambda d: F.concat_ws(",", F.transform(d, lambda x: F.substring(x, 1, 8)))
        return let(digests, lambda d: F.struct(F.sha2(F.concat_ws("", d), 256).alias("digest"), short(d).alias("leaves")))

    def section(s: Column) -> Column:
        digest = lambda ps: F.sha2(F.concat_ws(";", F.transform(ps, lambda p: p["digest"])), 256)
        lines = lambda ps: F.concat_ws(";", F.transform(ps, lambda p: p["leaves"]))
        return let(F.transform(F.split(s, "\n", -1), paragraph), lambda ps: F.struct(digest(ps).alias("digest"), lines(ps).alias("leaves")))

    def whole(sections: Column) -> Column:
        named = F.transform(sections, lambda s: F.concat(F.substring(s["digest"], 1, 16), F.lit("="), s["leaves"]))
        return F.concat(F.sha2(F.concat_ws("|", F.transform(sections, lambda s: s["digest"])), 256), F.lit(":"), F.concat_ws("|", named))

    body = F.coalesce(text, F.lit(""))
    return let(F.transform(F.regexp_extract_all(body, F.lit(SECTIONS), F.lit(0)), section), whole)


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ":", 1)


def leaves(fingerprint: Column) -> Column:
    """The distinct segment digests in a fingerprint string."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit(r"(?<=[=,;])[0-9a-f]{8}(?=[,;|]|$)"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct segments in common, of two fingerprint strings."""

    def share(x: Column, y: Column) -> Column:
        n = F.size(x) + F.size(y)
        return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / n).cast("double")

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(let(leaves(a), lambda x: let(leaves(b), lambda y: share(x, y))))

#: Copies of a row that are made at once.
COPIES = 4096


def neighbours(ids: DataFrame) -> DataFrame:
    """Each row's (doc_id, no) with (next_id, next_no) and the row's ``need``; the order is a ring, descending.

    ``ids``: doc_id, no (to tell rows of one doc_id apart), need.
    """
    n = ids.count()
    parts = max(1, -(-n // RANGE_ROWS))
    order = (F.col("doc_id").desc_nulls_last(), F.col("no"))
    # The range is written down, so that no later stage can see other range ends.
    ranged = materialize(ids.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ring-ranges", n)
    w = Window.partitionBy("range").orderBy(*order)
    inside = ranged.withColumn("next", F.lead(F.struct("doc_id", "no")).over(w))
    inside = inside.withColumn("rn", F.row_number().over(w))
    firsts = inside.filter(F.col("rn") == 1).select("range", F.struct("doc_id", "no").alias("first"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("range")  # one row a range
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = firsts.select("range", F.coalesce(F.lead("first").over(by_range), F.first("first").over(everything)).alias("turn"))
    ring = inside.join(turn, "range").withColumn("next", F.coalesce("next", "turn"))
    return ring.select("doc_id", "no", "need", F.col("next.doc_id").alias("next_id"), F.col("next.no").alias("next_no"))


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """root and fingerprint of every whole text, beside the kept columns."""
    return docs.select(*keep, tree(F.col(text)).alias("fingerprint")).select(*keep, root(F.col("fingerprint")).alias("root"), "fingerprint")


def differing_sections(a: Column, b: Column) -> Column:
    """(only_a, only_b): places (from 0) of the sections of either fingerprint string whose digest the other one lacks.

    An inserted section is one place, and those behind it are none. Where sections were only moved or repeated, the
    places at which the two differ are given on both sides. Equal roots give empty lists.
    """

    def sections(x: Column) -> Column:
        return F.filter(F.split(F.substring_index(x, ":", -1), r"\|", -1), lambda s: s != "")

    def digests(x: Column) -> Column:
        return F.transform(x, lambda s: F.substring_index(s, "=", 1))

    def places(x: Column, y: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - 1)), lambda i: (i < F.size(x)) & ~F.array_contains(y, F.get(x, i)))

    def moved(x: Column, y: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - 1)), lambda i: (i < F.size(x)) & ~F.get(x, i).eqNullSafe(F.get(y, i)))

    def differ(x: Column, y: Column) -> Column:
        only = F.struct(places(x, y).alias("only_a"), places(y, x).alias("only_b"))
        shuffled = F.struct(moved(x, y).alias("only_a"), moved(y, x).alias("only_b"))
        return let(only, lambda o: F.when((F.size(o["only_a"]) == 0) & (F.size(o["only_b"]) == 0) & (root(a) != root(b)), shuffled).otherwise(o))

    return let(digests(sections(a)), lambda x: let(digests(sections(b)), lambda y: differ(x, y)))


def op8(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))  # a null id is the last in descending order
    keyed = docs.select(key.alias("key"), F.unhex(F.md5(body)).alias("digest"), F.floor(F.length(body) / 2).cast("int").alias("need"), body.alias("body"))
    # Rows of one id are told apart by their texts; rows that are equal in both are one node of the ring, and all but the
    # last of them have a copy of themselves as their next.
    ids = keyed.groupBy("key", "digest").agg(F.first("need").alias("need"), F.count("*").alias("copies"))
    ids = materialize(ids.select(F.col("key").alias("doc_id"), F.col("digest").alias("no"), "need", "copies"), "ring-ids")  # no text is moved for the ids
    ring = neighbours(ids.drop("copies")).withColumn("times", F.lit(1).cast("long"))
    selves = ids.filter("copies > 1").select("doc_id", "no", "need", F.col("doc_id").alias("next_id"), F.col("no").alias("next_no"), (F.col("copies") - 1).alias("times"))
    donors = ring.unionByName(selves).select(F.col("doc_id").alias("owner"), F.col("no").alias("owner_no"), "need", "times", "next_id", "next_no")
    # Texts are dealt by id and digest once; both joins use that exchange.
    rows = keyed.groupBy("key", "digest").agg(F.first("body").alias("body"))
    given = rows.join(donors, (F.col("key") == F.col("next_id")) & (F.col("digest") == F.col("next_no"))).select(
        "owner", "owner_no", "times", F.substring(F.col("body"), F.lit(1), F.col("need")).alias("head"), tree(F.col("body")).alias("next_fingerprint")
    )
    both = rows.join(given, (F.col("key") == F.col("owner")) & (F.col("digest") == F.col("owner_no")))
    half = F.floor(F.length("body") / 2).cast("int")
    edited = both.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "times", F.length("body").cast("long").alias("n_chars"), "next_fingerprint", tree(F.col("body")).alias("fingerprint"),
        F.concat(F.substring(F.col("body"), F.lit(1), F.length("body") - half), F.col("head")).alias("edited"),
    )
    done = edited.select(
        "doc_id", "times", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", tree(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint"
    )
    found = done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "times",
    )
    # as many rows as there are copies, some thousand at a time
    chunk = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))
    parts = found.withColumn("_chunk", F.explode(chunk))
    one_by_one = F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("_chunk") * COPIES))
    return parts.withColumn("_copy", F.explode(one_by_one)).drop("times", "_chunk", "_copy")


_TREE = """
{p}_g as (
  select rid, list_transform(regexp_extract_all({t}, '(?s).+?(?:\\n[ \\t]*\\n|\\z)'), lambda s: list_transform(string_split(s, chr(10)),
    lambda l: list_transform(regexp_extract_all(l, '(?s).{1,64}'), lambda g: sha256(g)))) as tree from {rel}
), {p}_p as (
  select rid, list_transform(tree, lambda s: list_transform(s, lambda l: {'d': sha256(array_to_string(l, '')), 'c': array_to_string(list_transform(l, lambda g: left(g, 8)), ',')})) as ps,
    list_distinct(list_transform(flatten(flatten(tree)), lambda g: left(g, 8))) as leaves from {p}_g
), {p}_s as (
  select rid, leaves, list_transform(ps, lambda s: {'d': sha256(array_to_string(list_transform(s, lambda p: p.d), ';')), 'c': array_to_string(list_transform(s, lambda p: p.c), ';')}) as ss from {p}_p
), {p}_t as (
  select rid, leaves, sha256(array_to_string(list_transform(ss, lambda s: s.d), '|')) as root,
    sha256(array_to_string(list_transform(ss, lambda s: s.d), '|')) || ':' || array_to_string(list_transform(ss, lambda s: left(s.d, 16) || '=' || s.c), '|') as fingerprint from {p}_s
)"""
SQL = (
    """
with d as materialized (
  select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id desc nulls last, md5(coalesce(text, ''))) as rid from {rel}
), n as (
  select a.*, b.t as nt, b.rid as nrid from d a join d b on b.rid = a.rid % (select count(*) from d) + 1
), e as materialized (
  select doc_id, t, rid, nrid, t[1:length(t) - length(t) // 2] || nt[1:length(t) // 2] as ed from n
), """
    + _TREE.replace("{p}", "a").replace("{t}", "t").replace("{rel}", "d").replace("a_t as (", "a_t as materialized (")
    + ", "
    + _TREE.replace("{p}", "b").replace("{t}", "ed").replace("{rel}", "e")
    + """
select doc_id, length(t)::bigint as n_chars, sha256(ed) as edited_sha256, x.fingerprint, y.fingerprint as edited_fingerprint,
  case when x.root = y.root or len(x.leaves) + len(y.leaves) = 0 then 1.0 else 2.0 * len(list_intersect(x.leaves, y.leaves)) / (len(x.leaves) + len(y.leaves)) end::double as near_edited,
  case when x.root = z.root or len(x.leaves) + len(z.leaves) = 0 then 1.0 else 2.0 * len(list_intersect(x.leaves, z.leaves)) / (len(x.leaves) + len(z.leaves)) end::double as near_next
from e join a_t x using (rid) join b_t y using (rid) join a_t z on z.rid = e.nrid
"""
)


def sql(rel: str = "documents") -> str:
    return SQL.replace("{rel}", rel)
