"""Substring dedup: words covered by windows that another document with a smaller doc_id has too.

Every window of 50 words is hashed (Rabin-Karp). Spark deals the windows by bucket and gathers them there: a chunk sends
each distinct window with the smallest doc_id that has it there, a bucket finds the smallest doc_id of all (sorted and
reduced in arrays, since a row a window would cost several times as much), and chunks whose own is larger hear of it. A
window is told apart by all 64 bits of one hash and the bucket of an independent one. The buckets grow with the corpus,
to some 86 bits at 100 TB, where less than one false pair is to be expected among 10^13 windows. Repeated windows of a
document are merged into maximal intervals of words.

Windows are judged on the input: what is removed elsewhere does not matter.

Defined results for odd input: a null text has no words; a null doc_id is not compared and keeps all its words; rows
of one doc_id never remove each other's words (their id is not smaller), repeated rows have equal results; a text of
under 50 words is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.windows import (
    Plan, by_bucket, chunk_of, chunked, found, ids, pack, runs, text_bytes, unpack, unzip, windows,
)

WIDTH = 50
BYTES = 8

SENT = "bucket int, chunk int, hashes binary, docs binary, runs binary"
HEARD = "chunk int, bucket int, hashes binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, text string"


def _chunk(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """(doc_ids, texts) in the order of doc_id, null ids first as the least number."""
    raw = table.column("doc_id").to_pylist()
    doc = np.array([-(1 << 63) if x is None else x for x in raw], dtype=np.int64)
    order = np.argsort(doc, kind="stable")
    texts = unzip(table.column("z"))
    return doc[order], [texts[k] for k in order]


def sender(width: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        table = table.filter(table.column("doc_id").is_valid())
        doc, texts = _chunk(table)
        w = windows(texts, width)
        bucket = by_bucket(w.other, buckets)
        key = ids(w.hash, bucket, BYTES)
        _, first = np.unique(key, return_index=True)  # the first has the smallest doc_id
        order = first[np.lexsort((w.doc[first], bucket[first]))]
        b, d, h = bucket[order], doc[w.doc[order]], w.hash[order]
        rows = {"bucket": [], "chunk": [], "hashes": [], "docs": [], "runs": []}
        for x, y in runs(b):
            run = np.flatnonzero(np.diff(d[x:y], prepend=d[x] - 1 if d[x] > -(1 << 63) else 0))
            rows["bucket"].append(int(b[x]))
            rows["chunk"].append(chunk)
            rows["hashes"].append(pack(h[x:y], BYTES))
            rows["docs"].append(d[x:y][run].tobytes())
            rows["runs"].append(np.diff(np.append(run, y - x)).astype("<u4").tobytes())
        return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("runs", pa.binary())]))

    return send


def judge(table: pa.Table) -> pa.Table:
    """Of one bucket's windows, those whose smallest doc_id lies in another chunk, for each chunk that has them."""
    parts = [unpack(x, BYTES) for x in table.column("hashes").to_pylist()]
    docs = [
        np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(r, dtype="<u4"))
        for d, r in zip(table.column("docs").to_pylist(), table.column("runs").to_pylist(), strict=True)
    ]
    h, d = np.concatenate(parts), np.concatenate(docs)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    least = np.repeat(np.minimum.reduceat(d[order], starts), np.diff(np.append(starts, len(h))))
    hit = least < d[order]
    row, h = row[order][hit], h[hit]
    order = np.argsort(row, kind="stable")
    row, h = row[order], h[order]
    chunks = table.column("chunk").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    out = [(chunks[row[x]], pack(h[x:y], BYTES)) for x, y in runs(row)]
    return pa.table(
        {"chunk": [x for x, _ in out], "bucket": [bucket] * len(out), "hashes": [x for _, x in out]},
        schema=pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary())]),
    )


def intervals(covered: np.ndarray) -> list[dict]:
    """Maximal runs of covered words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False]))))
    return [{"begin": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]


def remover(width: int, buckets: int):
    def remove(texts_table: pa.Table, heard: pa.Table) -> pa.Table:
        raw = texts_table.column("doc_id")
        doc, texts = _chunk(texts_table)
        w = windows(texts, width)
        key = ids(w.hash, by_bucket(w.other, buckets), BYTES)
        told = [
            ids(h := unpack(x, BYTES), np.full(len(h), b, dtype=np.int32), BYTES)
            for x, b in zip(heard.column("hashes").to_pylist(), heard.column("bucket").to_pylist(), strict=True)
        ]
        hit = found(key, np.unique(np.concatenate(told))) >= 0 if told else np.zeros(len(key), dtype=bool)
        named = doc[w.doc] != -(1 << 63)
        at = np.flatnonzero(named)
        _, first, back = np.unique(key[at], return_index=True, return_inverse=True)
        hit[at] |= doc[w.doc[at[first]]][back] < doc[w.doc[at]]
        hit &= named
        change = np.zeros(w.bounds[-1] + 1, dtype=np.int32)
        np.add.at(change, w.at[hit], 1)
        np.add.at(change, w.at[hit] + width, -1)
        covered = np.cumsum(change)[:-1] > 0
        rows = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "text": []}
        for k, t in enumerate(texts):
            c = covered[w.bounds[k] : w.bounds[k + 1]]
            n = int(c.sum())
            kept = t.split() if not n else compress(t.split(), ~c)
            rows["doc_id"].append(None if doc[k] == -(1 << 63) and raw.null_count else int(doc[k]))
            rows["n_words"].append(len(c))
            rows["n_removed"].append(n)
            rows["spans"].append(intervals(c) if n else [])
            rows["text"].append(b" ".join(kept).decode())
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("text", pa.string())]))

    return remove


def dedup_substrings(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, the removed intervals of words and the text that is left, words joined by spaces."""
    plan = Plan.of(text_bytes(docs, text))
    # Any dealing gives the same result; by the scan's partition too, so that rows without an id, or equal ones, are many chunks.
    chunks = chunked(docs, plan, chunk_of(plan, F.col(doc_id), F.col(text), F.spark_partition_id()), doc_id, text)
    sent = chunks.groupBy("chunk").applyInArrow(sender(width, plan.buckets), SENT)
    heard = sent.groupBy("bucket").applyInArrow(judge, HEARD)
    return chunks.groupBy("chunk").cogroup(heard.groupBy("chunk")).applyInArrow(remover(width, plan.buckets), RESULT)


def op2(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
