"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line is the set of its words. A line with a word is removed when an earlier line, by (doc_id, line number), has a
Jaccard similarity of at least the threshold with it, both judged on the input.

* Equal lines are found by their digest; the first of each stays in the join, as the set of its words' hashes, written
  once for the three passes below.
* Words are ordered by rarity: a count of their hash bucket over the lines, on a scale of half powers of two, then their
  hash. Any order that all lines share makes the join exact; the rarer the first words, the fewer candidates.
* The prefix of a line (n - ceil(t n) + 1 words) is indexed. Two similar lines share a prefix word, at which the length
  and positional filters hold. Their parities (64 bits, 128 from 64 words and 256 from 192; each word flips one) differ in no more
  bits than the lines may differ in words. Pairs that pass are verified on the words themselves.
* Long posting lists come first: each line is held against the earliest line of each of its long lists, then against
  the earliest of those that are left, for some rounds. Only the existence of an earlier match matters, so this settles large groups of variants without
  their pairs. Lines that found none are then joined with all earlier lines. The index is dealt by word once for both sides; the lists
  of over ``SPLIT`` lines are dealt anew, cut by line on one side and repeated on the other, so no task has a whole one.

Line numbers by document are broadcast up to ``BROADCAST_BYTES``, else joined by document. No user function runs.

Where doc_ids repeat (or several are null), a document is its doc_id and the digest of its text, and equal documents are
judged once; the order stays that of doc_ids.

Defined results for odd input: a null text has no lines and is returned as null; lines without a word are kept; a null
doc_id is the smallest; lines at the same place in rows of one doc_id do not remove each other; an empty table gives an
empty table; other columns are carried by ``dedup_lines`` as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, materialize

SIMILARITY = 0.8
CLASSES = 1 << 19
PLACE = ("doc", "sub", "line")
NO_ID = -(2**63)
#: Bytes of line numbers that may be broadcast at once.
BROADCAST_BYTES = 32 << 20
#: Lines of one class of lengths from which the posting list of a word is long.
LIST = 64
ROUNDS = 3
#: Lines of a posting list that one task joins.
SPLIT = 8192
#: Lines of so many words have the parity of their halves, or of their quarters.
MIDDLE, LONG = 64, 192
#: How tables of hashes are written: a dictionary of them only costs time.
NUMBERS = {"parquet.enable.dictionary": "false"}


def _plain(text: str) -> Column:
    """The text with spaces for other white space but newlines; few texts need the slow way."""
    tab, vt, ff, cr = (F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r")
    return F.when(tab | vt | ff | cr, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(F.col(text))


def _numbered(text: str) -> Column:
    return F.posexplode(F.split(_plain(text), "\n", -1)).alias("line", "body")


def words_of_line(body: Column) -> Column:
    """The set of words of a line with no other white space than spaces."""
    return F.array_distinct(F.array_remove(F.split(body, " "), ""))


def _but(numbers: str, lines: str) -> Column:
    """(line, body) of all lines but those of the numbers (null: none)."""
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(numbers, F.array().cast("array<int>")))
    return F.transform(at, lambda i: F.struct(i.alias("line"), F.get(lines, i).alias("body")))


def _has_word(body: Column) -> Column:
    return F.length(F.trim(body)) > 0


def rarity(sets: DataFrame) -> Column:
    """2 log2(count) by hash bucket, eight buckets in a number: a constant array whose size does not grow with the input."""
    counts = sets.select(F.explode("hashes").alias("h")).groupBy(F.col("h").bitwiseAND(CLASSES - 1).cast("int").alias("bucket")).agg(
        F.floor(2 * F.log2(F.count("*"))).cast("int").alias("c")
    )
    found = counts.toArrow()  # at most CLASSES rows of two numbers
    table = np.zeros(CLASSES, dtype=np.int8)
    table[np.asarray(found.column("bucket"))] = np.minimum(63, np.asarray(found.column("c")))
    return F.from_json(F.lit(str(table.view("<i8").tolist())), "array<bigint>")  # folded into one literal when planned


def _tokens(hashes: str, classes: Column) -> Column:
    """Sorted numbers of the words: 6 bits of rarity, then 57 bits of hash."""

    def number(h: Column) -> Column:
        eight = classes[F.shiftright(h, 3).bitwiseAND(CLASSES // 8 - 1)]
        rare = F.call_function("shiftright", eight, F.shiftleft(h.bitwiseAND(7), 3).cast("int")).bitwiseAND(63)
        # never null, which lets the numbers be sorted as they are and not as objects
        return F.coalesce(F.shiftleft(rare, 57).bitwiseOR(F.shiftrightunsigned(h, 7)), F.lit(0).cast("long"))

    return F.sort_array(F.transform(hashes, number))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _sub(keyed: bool, text: str) -> Column:
    """What tells documents of one doc_id apart: the text's digest, or nothing if every doc_id has one row."""
    return F.unhex(F.md5(text)) if keyed else F.lit(b"")


def _repeated(docs: DataFrame) -> bool:
    """Whether a doc_id (or null) has several rows."""
    return not docs.groupBy(_doc().alias("doc")).count().filter("count > 1").isEmpty()


def _by_document(places: DataFrame, n: int, n_bytes: int = 24) -> DataFrame:
    """doc, sub, numbers: line numbers gathered by document, broadcast if they are small."""
    lists = places.groupBy("doc", "sub").agg(F.collect_set("line").alias("numbers"))
    return F.broadcast(lists) if n * n_bytes <= BROADCAST_BYTES else lists


def _parity(mask: int) -> Column:
    """Bits 0 to 5 of a word name the one of 64 bits that it flips; only words with the bits of ``mask`` do."""
    one = F.lit(1).cast("long")

    def flip(acc: Column, x: Column) -> Column:
        flipped = acc.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int")))
        return F.when(x.bitwiseAND(mask) == mask, flipped).otherwise(acc) if mask else flipped

    return F.aggregate("tokens", F.lit(0).cast("long"), flip)


def _parities() -> list[Column]:
    """Of all words, of every second in longer lines, and for long ones of two quarters: together the parities of four quarters."""
    more = ((64, MIDDLE, "p1"), (128, LONG, "p2"), (192, LONG, "p3"))
    return [_parity(0).alias("p0"), *[F.when(F.col("n") >= least, _parity(mask)).otherwise(F.lit(0).cast("long")).alias(c) for mask, least, c in more]]


PARITIES = ("p0", "p1", "p2", "p3")


def _all(x: str) -> tuple[Column, ...]:
    return (F.col(f"{x}.p0"),)


def _halves(x: str) -> tuple[Column, Column]:
    return F.col(f"{x}.p1"), F.col(f"{x}.p0").bitwiseXOR(F.col(f"{x}.p1"))


def _quarters(x: str) -> tuple[Column, ...]:
    p0, p1, p2, p3 = (F.col(f"{x}.{p}") for p in PARITIES)
    return p3, p1.bitwiseXOR(p3), p2.bitwiseXOR(p3), p0.bitwiseXOR(p1).bitwiseXOR(p2).bitwiseXOR(p3)


def _differ(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    bits = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(bits[1:], bits[0])


def _passes(a: str, b: str, t: float) -> Column:
    """The length, positional and parity filters for rows of the index."""
    an, bn = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(F.lit(t / (1 + t)) * (an + bn) - 1e-9)
    most = an + bn - 2 * need
    return (
        (F.least(an, bn) >= F.lit(t) * F.greatest(an, bn) - 1e-9)
        & (1 + F.least(an - F.col(f"{a}.pos"), bn - F.col(f"{b}.pos")) >= need)
        & (_differ(_all(a), _all(b)) <= most)
        & ((F.least(an, bn) < MIDDLE) | (_differ(_halves(a), _halves(b)) <= most))
        & ((F.least(an, bn) < LONG) | (_differ(_quarters(a), _quarters(b)) <= most))
    )


def _order() -> Column:
    """The order of lines as one number, as a minimum of structs is aggregated by sorting."""
    return F.col("doc").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("line")


def _earlier(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc") < F.col(f"{b}.doc")) | ((F.col(f"{a}.doc") == F.col(f"{b}.doc")) & (F.col(f"{a}.line") < F.col(f"{b}.line")))


def _end(x: str) -> list[Column]:
    return [F.col(f"{x}_{c}").alias(c) for c in PLACE]


def _verified(pairs: DataFrame, rows: DataFrame, t: float, scratch: Scratch, n_lines: int) -> DataFrame:
    """(doc, sub, line) of those ``b`` of ``pairs`` (doc, sub and line of a and b) whose words match ``a``'s."""
    pairs = scratch.keep(pairs, "pairs", n_lines)
    ends = pairs.select(*_end("a")).union(pairs.select(*_end("b"))).distinct()
    wanted = scratch.keep(ends, "ends", n_lines)
    lists = _by_document(wanted, wanted.count())
    picked = rows.join(lists, ["doc", "sub"]).select("doc", "sub", "numbers", F.split(_plain("text"), "\n", -1).alias("lines"))
    bodies = picked.select("doc", "sub", F.explode(F.transform("numbers", lambda i: F.struct(i.alias("line"), F.get("lines", i).alias("body")))).alias("e"))
    bodies = scratch.keep(bodies.select("doc", "sub", "e.line", words_of_line(F.col("e.body")).alias("body")), "bodies")
    a = bodies.toDF("a_doc", "a_sub", "a_line", "a_body")
    b = bodies.toDF("b_doc", "b_sub", "b_line", "b_body")
    met = pairs.join(a, ["a_doc", "a_sub", "a_line"]).join(b, ["b_doc", "b_sub", "b_line"])
    sizes = met.select(
        "b_doc", "b_sub", "b_line", F.size(F.array_intersect("a_body", "b_body")).alias("k"), F.size("a_body").alias("n"), F.size("b_body").alias("m")
    )
    good = sizes.filter(F.col("k") >= F.lit(t) * (F.col("n") + F.col("m") - F.col("k")) - 1e-9)
    return good.select(*_end("b")).distinct()


def _word_sets(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(Lines that an earlier one equals, hashes of the words of each other line, lines)."""
    lines = rows.select("doc", "sub", _numbered("text")).filter(_has_word(F.col("body")))
    places = scratch.keep(lines.select(*PLACE, F.unhex(F.md5("body")).alias("key")), "places")
    n_lines = places.count()
    first = places.groupBy("key").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.keep(first.select("key", "first"), "first", n_lines)
    repeat = places.join(first, "key").filter(_order() > F.col("first"))
    copies = scratch.keep(repeat.select(*PLACE), "copies", n_lines)
    known = rows.join(_by_document(copies, copies.count()), ["doc", "sub"], "left")
    split = known.select("doc", "sub", "numbers", F.split(_plain("text"), "\n", -1).alias("lines"))
    new = split.select("doc", "sub", F.explode(_but("numbers", "lines")).alias("e")).select("doc", "sub", "e.line", "e.body").filter(_has_word(F.col("body")))
    hashes = F.array_distinct(F.transform(F.array_remove(F.split("body", " "), ""), lambda w: F.xxhash64(w)))
    return copies, scratch.keep(new.select(*PLACE, hashes.alias("hashes")), "sets", **NUMBERS, compression="none"), n_lines


def _prefixes(sets: DataFrame, t: float) -> DataFrame:
    """A row for each line: its number of words, what the filters need, and the words of its prefix in order."""
    numbered = sets.select(*PLACE, F.size("hashes").alias("n"), _tokens("hashes", rarity(sets)).alias("tokens"))
    prefix = F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).cast("int"))
    return numbered.select(*PLACE, "n", *_parities(), prefix.alias("prefix"))


def _index(lines: DataFrame) -> DataFrame:
    """A row for each prefix word that another line may have: one alone in its bucket (class 0) is in a single line."""
    rows = lines.select(*PLACE, "n", *PARITIES, F.posexplode("prefix").alias("at", "token"))
    return rows.filter(F.col("token") >= 1 << 57).withColumn("pos", F.col("at") + 1).drop("at")


def _settled(index: DataFrame, rows: DataFrame, t: float, scratch: Scratch, n_lines: int) -> tuple[DataFrame, int, DataFrame]:
    """Lines that match the earliest line of a long posting list, their number, and the words of the longest lists with the parts to cut them to."""
    # a list of LIST lines is in a bucket of no fewer words
    sized = index.filter(F.col("token") >= int(2 * math.log2(LIST)) << 57).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / t))).cast("int"))
    long = scratch.keep(sized.groupBy("token", "size").count().filter(F.col("count") >= LIST), "long")
    few = long.count() * 32 <= BROADCAST_BYTES
    hot = scratch.keep(sized.join(F.broadcast(long.select("token", "size")) if few else long.select("token", "size"), ["token", "size"]), "hot")
    settled, n, led = None, 0, None
    for _ in range(ROUNDS):
        left = hot if settled is None else hot.join(settled, [*PLACE], "left_anti")
        fresh = left if led is None else left.join(led, [*PLACE], "left_anti")
        top = F.min(F.struct("doc", "line", "sub", "n", "pos", *PARITIES))
        leaders = scratch.keep(fresh.groupBy("token", "size").agg(top.alias("first")).select("token", "size", "first.*"), "leaders", n_lines)
        close = (F.col("a.token") == F.col("b.token")) & (F.abs(F.col("a.size") - F.col("b.size")) <= 1)
        met = left.alias("b").join(leaders.alias("a"), close & _earlier("a", "b") & _passes("a", "b", t))
        nearest = met.groupBy(*[F.col(f"b.{c}").alias(f"b_{c}") for c in PLACE]).agg(
            F.min(F.struct(_differ(_all("a"), _all("b")).alias("far"), *[F.col(f"a.{c}").alias(c) for c in ("doc", "line", "sub")])).alias("a")
        )
        pairs = nearest.select(*[F.col(f"a.{c}").alias(f"a_{c}") for c in PLACE], *[f"b_{c}" for c in PLACE])
        found = scratch.keep(_verified(pairs, rows, t, scratch, n_lines), "settled", n_lines)
        settled = found if settled is None else settled.unionByName(found)
        led = leaders.select(*PLACE).distinct() if led is None else led.unionByName(leaders.select(*PLACE)).distinct()
        new = found.count()
        n += new
        if not new:
            break
    heavy = long.groupBy("token").agg(F.sum("count").alias("n")).filter(F.col("n") > SPLIT)
    return settled, n, heavy.select("token", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))


def _met(left: DataFrame, index: DataFrame, heavy: DataFrame, t: float) -> DataFrame:
    """Pairs (place of a, place of b) of an earlier line of ``index`` and a line of ``left`` that meet in a word and pass the filters."""

    def pairs(b: DataFrame, a: DataFrame, *more: Column) -> DataFrame:
        close = (F.col("a.token") == F.col("b.token")) & _earlier("a", "b") & _passes("a", "b", t)
        for m in more:
            close = close & m
        return b.alias("b").join(a.alias("a"), close).select(*[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in PLACE])

    n = heavy.count()
    if not n:
        return pairs(left, index).distinct()
    heavy = F.broadcast(heavy) if n * 32 <= BROADCAST_BYTES else heavy
    rest = pairs(left.join(heavy, "token", "left_anti"), index.join(heavy, "token", "left_anti"))
    cut = left.join(heavy, "token").withColumn("part", F.pmod(F.xxhash64(*PLACE), F.col("parts")).cast("int"))
    whole = index.join(heavy, "token").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rest.unionByName(pairs(cut, whole, F.col("a.part") == F.col("b.part"))).distinct()


def matches(docs: DataFrame, similarity: float = SIMILARITY, keyed: bool = True) -> tuple[DataFrame, int]:
    """(doc, sub and line of every line that an earlier line matches, their number). ``keyed``: doc_ids may repeat."""
    t = similarity
    rows = docs.select(_doc().alias("doc"), _sub(keyed, "text").alias("sub"), "text").filter(F.col("text").isNotNull())
    with Scratch(docs.sparkSession) as scratch:
        if keyed:
            rows = scratch.keep(rows.dropDuplicates(["doc", "sub"]), "documents")
        copies, sets, n_lines = _word_sets(rows, scratch)
        # prefixes are stored as arrays: a row a word would repeat the rest ten times, and reading them so costs little
        index = _index(scratch.keep(_prefixes(sets, t), "prefixes", **NUMBERS))
        scratch.drop("sets")
        settled, n_settled, heavy = _settled(index, rows, t, scratch, n_lines)
        # Both sides of the join read one exchange, if settled lines can be left out behind it. That takes a broadcast, and an
        # outer join, as an anti join would be moved to before the exchange.
        if n_settled * 64 <= BROADCAST_BYTES:
            index = index.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
            left = index.join(F.broadcast(settled.withColumn("_settled", F.lit(True))), [*PLACE], "left").filter("_settled IS NULL").drop("_settled")
        else:
            left = index.join(settled, [*PLACE], "left_anti")
        more = _verified(_met(left, index, heavy, t), rows, t, scratch, n_lines)
        found = materialize(copies.unionByName(settled).unionByName(more), "line-matches", n_lines)
    return found, found.count()


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_removed`` and the text without its removed lines in place of the text."""
    keyed = _repeated(docs)
    found, n = matches(docs.select("doc_id", F.col(text).alias("text")), similarity, keyed)
    lists = _by_document(found, n)
    others = [c for c in docs.columns if c != text]
    marked = docs.select(F.struct(F.lit(0), *others).alias("row"), _doc().alias("doc"), _sub(keyed, text).alias("sub"), F.col(text).alias("text"))
    marked = marked.join(lists, ["doc", "sub"], "left")
    marked = marked.select("row", "text", "numbers", F.split("text", "\n", -1).alias("lines"))
    marked = marked.select("row", "text", "lines", F.when(F.col("numbers").isNotNull(), F.transform(_but("numbers", "lines"), lambda e: e["body"])).alias("kept"))
    return marked.select(
        *[F.col("row").getField(c).alias(c) for c in others],
        F.coalesce(F.size("lines"), F.lit(0)).alias("_n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).alias("_n_removed"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias(text),
    )


def op3(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_n_lines")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.col("_n_removed")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = """
with l as (
  select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as body
  from {rel} where text is not null
), w as (
  select doc_id, i, body, list_distinct(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) as w,
         dense_rank() over (order by doc_id nulls first, i) as pos from l
), d as (
  select list_sort(w) as w, min(pos) as first from w where len(w) > 0 group by list_sort(w)
), t as (
  select first, len(w) as n, unnest(w) as token from d
), p as (
  select a.first as a, b.first as b, a.n as an, b.n as bn, count(*) as k
  from t a join t b on a.token = b.token and a.first < b.first and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  group by all
), s as (
  select distinct b from p where 5 * k >= 4 * (an + bn - k)
), m as (
  select w.doc_id, w.i, w.body, (len(w.w) > 0 and (d.first < w.pos or s.b is not null)) as gone
  from w left join d on list_sort(w.w) = d.w left join s on s.b = d.first
)
select r.doc_id, count(m.i)::bigint as n_lines, coalesce(sum(gone::int), 0)::bigint as n_removed,
       sha256(coalesce(string_agg(m.body, chr(10) order by m.i) filter (where not gone), '')) as kept_sha256
from {rel} r left join m using (doc_id) group by r.doc_id
"""


def sql(rel: str = "documents") -> str:
    return SQL.replace("{rel}", rel)
