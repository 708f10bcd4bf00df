"""WARC archives: written through Spark's text sink, read back by boundary-chain verification.

Writing: a record is one row of text, so the archives are written where Spark writes, whatever the store. Payloads that
occur more than once are stored by one response (the largest page_id) and referred to by revisit records, which keep
the HTTP head of the full payload.

Reading: the text source splits the files at every occurrence of the record magic, so no task holds more than the bytes
between two of them, whether a large file is read by one task (as the compressed ones written here) or by many. Each piece is only a candidate: a payload can hold the magic too. From a
piece's head follows where its successor would begin. Offsets come from piece lengths summed up in file order, and
pointer jumping from the start of each file retains the candidates that the chain reaches. Only lengths and offsets (a few
numbers a candidate) are gathered by file. Payloads that were split by a magic inside are put together from their
pieces; all others are digested where they are read.

Defined results for odd input: a null html is an empty payload; a null page_id is written as ``null`` and is the smallest;
of rows with equal page_id and payload one is the response; line breaks in a url are percent-encoded; an empty table gives
an empty table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import materialize, scratch_root, small

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32(sha: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 8 groups of 20 bits, 4 digits each; 160 bits need no padding."""
    digits = []
    for g in range(8):
        bits = F.conv(F.substring(sha, 5 * g + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def write(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 64_000_000) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html). Payloads under ``least`` bytes are all responses.

    Files hold about ``file_bytes`` of payload before compression.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    rows = pages.select("page_id", name.alias("name"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    spark = pages.sparkSession
    keys = rows.groupBy("name", "sha").agg(F.max("page_id").alias("page_id"), F.sum(F.octet_length("payload")).alias("bytes"))
    keys = materialize(keys, "warc-keys", pages.count())
    n_bytes = keys.agg(F.sum("bytes")).first()[0] or 0
    first = keys.groupBy("sha").agg(F.max("page_id").alias("response_id"))
    roles = keys.join(first, "sha").select("name", "sha", "response_id")
    # Numbering and join share their keys, so a payload is shuffled once, over as many tasks as files are wanted: a
    # file's size follows ``file_bytes``, whatever the session's number of partitions.
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // file_bytes))
    rows = rows.repartition(files, "name", "sha")
    number = F.row_number().over(Window.partitionBy("name", "sha").orderBy("url"))
    placed = rows.withColumn("number", number).join(roles.hint("merge"), ["name", "sha"]).withColumn("digest", base32(F.lower(F.hex("sha"))))

    n = F.octet_length("payload")
    responds = (F.col("page_id").eqNullSafe(F.col("response_id")) & (F.col("number") == 1)) | (n < least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), "\r", "%0D"), "\n", "%0A")
    block = F.when(responds, F.concat(http, F.col("payload"))).otherwise(http)
    refers = F.concat(
        F.lit("WARC-Refers-To: <urn:page:"), F.coalesce(F.col("response_id").cast("string"), F.lit("null")), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n")
    )
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(responds, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("name"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(responds, F.lit("")).otherwise(refers),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block, F.lit("\r\n"),
    )
    # The sink's line separator is the second half of the record's end.
    placed.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _header(name: str) -> Column:
    return F.regexp_extract("head", f"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every run of bytes between two magics, with its place: file, block and order in it."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return raw.withColumn("seq", F.monotonically_increasing_id())


def reached(group: pd.DataFrame) -> pd.DataFrame:
    """Of one file's candidates those on the chain from the file's start, by pointer jumping.

    Each round doubles how far a pointer reaches; whatever the marked candidates point to is marked too.
    """
    group = group.sort_values("offset", kind="stable")
    offsets, after = group["offset"].to_numpy(), group["successor"].to_numpy()
    n = len(offsets)
    to = np.searchsorted(offsets, after)
    ok = (to < n) & (offsets[np.minimum(to, n - 1)] == after)
    jump = np.append(np.where(ok, to, n), n)  # n: the end of the chain
    mark = np.zeros(n + 1, dtype=bool)
    mark[0] = n > 0 and offsets[0] == 0
    while True:
        more = mark.copy()
        more[jump[mark]] = True
        jump = jump[jump]
        if (more == mark).all() and (jump == n).all():
            break
        mark = more
    return group[mark[:n]][["file", "block", "seq", "offset", "successor"]]


def read(spark: SparkSession, path: str, records: int = 0) -> DataFrame:
    """page (as written), record_type, refers_to, payload_bytes, payload_digest and digest_ok of every record.

    ``records``: about how many there are.
    """
    got = pieces(spark, path)
    head = got.withColumn("head", F.substring_index("value", END, 1)).select(
        "file", "block", "seq", "value", F.octet_length("value").cast("long").alias("len"), "head",
        F.octet_length("head").cast("long").alias("head_len"),
    )
    parsed = head.select(
        "file", "block", "seq", "value", "len", "head_len",
        F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length: *([0-9]+)', 1) AS long)").alias("block_len"),
        _header("WARC-Type").alias("record_type"),
        F.regexp_extract(_header("WARC-Record-ID"), "<urn:page:(.*)>", 1).alias("page"),
        F.regexp_extract(_header("WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("refers_to"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("stated"),
    )
    whole = F.col("len") >= F.col("head_len") + 4 + F.col("block_len") + 4
    # In bytes: the text of a piece can be cut by a byte count only as binary.
    binary = F.col("value").cast("binary")
    content = F.substring(binary, (F.col("head_len") + 5).cast("int"), F.col("block_len").cast("int"))
    local = parsed.withColumn("content", F.when(whole, content.cast("string")))
    facts = local.select(
        "file", "block", "seq", "len", "head_len", "block_len", "record_type", "page", "refers_to", "stated", whole.alias("whole"),
        F.expr("try_cast(regexp_extract(content, '(?i)Content-Length: *([0-9]+)', 1) AS long)").alias("payload_bytes"),
        base32(F.sha1(_payload(F.col("content")))).alias("computed"),
    )

    # Offsets: lengths and magics summed up within a block, then over the blocks of a file.
    step = F.col("len") + len(MAGIC)
    in_block = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = facts.groupBy("file", "block").agg(F.sum(step).alias("size"), F.min("seq").alias("_first"))
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", F.coalesce(F.sum("size").over(blocks), F.lit(0)).alias("start"))
    placed = facts.join(starts, ["file", "block"]).withColumn(
        "offset", F.col("start") + F.coalesce(F.sum(step).over(in_block), F.lit(0)) - len(MAGIC)
    )
    successor = F.col("offset") + len(MAGIC) + F.col("head_len") + 4 + F.col("block_len") + 4
    candidates = placed.filter("offset >= 0 AND block_len IS NOT NULL")
    chain = (
        candidates.select("file", "block", "seq", "offset", successor.alias("successor"))
        .groupBy("file")
        .applyInPandas(reached, "file string, block long, seq long, offset long, successor long")
    )
    true = candidates.join(chain.select("file", "block", "seq", "successor"), ["file", "block", "seq"])
    true = materialize(true, "warc-records", records)  # heads and digests only
    complete = true.filter("whole").select("page", "record_type", "refers_to", "stated", "payload_bytes", "computed")

    # Records whose content holds the magic: their pieces, in order, with the magic between them.
    split = true.filter("NOT whole").select(
        "file", F.col("offset").alias("from"), "successor", "page", "record_type", "refers_to", "stated", "head_len", "block_len"
    )
    # Each piece belongs to the last split record that begins at or before it, if it ends before that one's successor.
    begins = split.select("file", F.col("from").alias("offset"), F.struct("*").alias("record"))
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("file", "block", "seq", "offset").join(begins, ["file", "offset"], "left")
    inside = inside.withColumn("record", F.last("record", ignorenulls=True).over(before)).filter("offset < record.successor")
    parts = inside.select("block", "seq", "offset", "record.*")
    parts = materialize(parts, "warc-parts", 0)
    # Broadcast when counted as few, so that the other pieces are not shuffled to be thrown away.
    parts = small(parts, parts.count())
    again = got.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("seq").alias("_seq"), "value")
    texts = again.join(parts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.col("seq") == F.col("_seq")))
    joined = texts.groupBy("file", "from", "page", "record_type", "refers_to", "stated", "head_len", "block_len").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value")
    )
    rebuilt = joined.withColumn("content", content.cast("string")).select(
        "page", "record_type", "refers_to", "stated",
        F.expr("try_cast(regexp_extract(content, '(?i)Content-Length: *([0-9]+)', 1) AS long)").alias("payload_bytes"),
        base32(F.sha1(_payload(F.col("content")))).alias("computed"),
    )
    revisit = F.col("record_type") == "revisit"
    return complete.unionByName(rebuilt).select(
        "page", "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"), "payload_bytes",
        F.when(revisit, F.col("stated")).otherwise(F.col("computed")).alias("payload_digest"),
        (revisit | (F.col("stated") == F.col("computed"))).alias("digest_ok"),
    )


def _payload(content: Column) -> Column:
    """What follows the HTTP head."""
    return F.substring(content, F.instr(content, END) + len(END), F.length(content))


def op6(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/tessella/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    return read(spark, path, pages.count()).select(
        F.when(F.col("page") != "null", F.col("page")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to") != "null", F.col("refers_to")).cast(kind).alias("refers_to"),
    )


SQL = """
with d as (
  select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from {rel}
), b as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as digest from d
), m as (
  select *, max(page_id) over (partition by digest) as response_id, row_number() over (partition by digest order by page_id desc nulls last) as n from b
)
select page_id, strlen(t)::bigint as payload_bytes, digest as payload_digest,
       case when n = 1 then 'response' else 'revisit' end as record_type, case when n > 1 then response_id end as refers_to
from m
"""


def sql(rel: str = "pages") -> str:
    return SQL.replace("{rel}", rel)
