"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words; a text with fewer words is one shingle. A shingle weighs tf * idf with the smoothed
idf = 1 + ln(n / df) / (2 ln n), from 1 to 1.5, where n and df count all documents, copies included. Equal texts are one
text with a count from the start.

* Document frequencies: chunks of texts send each distinct shingle once by bucket; a bucket sums up and answers the
  chunks whose own count is not all of it.
* Candidates: if two texts are similar to the degree t, at least t of either's weight is in shingles that some other
  text has too. Texts that miss this bound have no partner and are settled there; this loses nothing.
* Signatures: ICWS draws r and c from Gamma(2, 1) and beta from U(0, 1) per shingle and draw, by a hash; the sample is
  the shingle with the least ln c - r (t - beta) - r, t = floor(ln w / r + beta), together with t. ``ROWS`` samples make a band.
* Verification: in each bucket of equal bands all texts are held against the one with the least weight to itself, by
  weighted Jaccard similarity. Verified links are joined to components. What is left are pairs of different components in
  one bucket. Three bounds rule out most of them: what a text has to itself cannot be shared, the triangle inequality
  of the Jaccard distance with the two known similarities, and the weights that either has in and outside the text
  both were held against. The others are verified too. So no pair of a bucket is left out, while a group of copies
  costs a comparison a member.

Groups are dealt over sub-groups of at most ``PART`` texts, so no task holds a large group.

Defined results for odd input: a null text counts as empty; equal texts (empty ones too) share a class; a null doc_id
is the smallest id and its class is null; different texts of one doc_id, or of none, are judged each by itself;
repeated rows get a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, small
from tessella.llm.graph import components
from tessella.llm.windows import (
    BUCKET_BASE, Plan, Windows, by_bucket, chunk_of, chunked, found, ids, mix, pack, runs, text_bytes, unpack, unzip, windows,
)

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
BYTES = 6
PART = 256
DRAWS = 1 << 16
NO_ID = -(2**63)

SENT = "bucket int, chunk int, hashes binary, counts binary"
HEARD = "chunk int, bucket int, hashes binary, counts binary"
CANDIDATE = "node long, total double, common double, bands array<long>, shingles binary, weights binary"
SCORED = "a long, b long, score double"


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray]:
    """Tables of r and ln c, each with as many values as a hash can pick; the seed fixes them on every worker."""
    rng = np.random.default_rng(20240229)
    return rng.gamma(2.0, 1.0, DRAWS), np.log(rng.gamma(2.0, 1.0, DRAWS))


def signature(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes (texts x bands) of weighted sets laid end to end; ``starts``: where each begins. None is empty."""
    table_r, table_c = draws()
    log_w = np.log(weight)
    sizes = np.diff(np.append(starts, len(shingle)))
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        joint = np.full(len(starts), band, dtype=np.uint64)
        for row in range(rows):
            z = mix(shingle + np.uint64((band * rows + row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            r = table_r[(z & np.uint64(DRAWS - 1)).astype(np.int32)]
            beta = (z >> np.uint64(32)).astype(np.float64) * 2.0**-32
            t = np.floor(log_w / r + beta)
            a = table_c[((z >> np.uint64(16)) & np.uint64(DRAWS - 1)).astype(np.int32)] - r * (t - beta) - r
            least = np.repeat(np.minimum.reduceat(a, starts), sizes)
            hit = np.flatnonzero(a == least)
            first = hit[np.searchsorted(hit, starts)]
            joint = mix(joint ^ mix(shingle[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(BUCKET_BASE)))
        out[:, band] = joint
    return out


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 1.0 + 0.5 * np.log(n / df) / math.log(max(n, 3))


class Chunk:
    """The distinct texts of a chunk that stand for their copies, with their shingles, sorted by text and shingle."""

    def __init__(self, table: pa.Table, reps: pa.Table, buckets: int):
        keys = zip(reps.column("doc_id").to_pylist(), reps.column("digest").to_pylist(), strict=True)
        want = dict(zip(keys, zip(reps.column("node").to_pylist(), reps.column("copies").to_pylist(), strict=True), strict=True))
        self.node, self.copies, texts = [], [], []
        for d, t in zip(table.column("doc_id").to_pylist(), unzip(table.column("z")), strict=True):
            rep = want.pop((d, hashlib.md5(t).digest()), None)
            if rep is not None:
                self.node.append(rep[0])
                self.copies.append(rep[1])
                texts.append(t)
        w: Windows = windows(texts, WIDTH, short=True)
        bucket = by_bucket(w.other, buckets)
        key = ids(w.hash, bucket, BYTES)
        order = np.lexsort((key, w.doc))
        doc, key = w.doc[order], key[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.zeros(0, dtype=np.int64)
        self.text = doc[new]  # of each distinct shingle of each text
        self.key = key[new]
        self.tf = np.diff(np.append(new, len(key)))
        self.hash, self.bucket = w.hash[order][new], bucket[order][new]
        # Documents of this chunk, copies counted, by shingle.
        self.names, first, self.back = np.unique(self.key, return_index=True, return_inverse=True)
        self.local = np.bincount(self.back, np.array(self.copies, dtype=np.float64)[self.text], len(self.names)).astype(np.int64)
        self.name_hash, self.name_bucket = self.hash[first], self.bucket[first]


def sender(buckets: int):
    def send(texts: pa.Table, reps: pa.Table) -> pa.Table:
        rows = {"bucket": [], "chunk": [], "hashes": [], "counts": []}
        if texts.num_rows and reps.num_rows:
            chunk = reps.column("chunk")[0].as_py()
            c = Chunk(texts, reps, buckets)
            order = np.lexsort((c.local, c.name_bucket))
            h, b, n = c.name_hash[order], c.name_bucket[order], c.local[order]
            for x, y in runs(b):
                rows["bucket"].append(int(b[x]))
                rows["chunk"].append(chunk)
                rows["hashes"].append(pack(h[x:y], BYTES))
                rows["counts"].append(n[x:y].astype("<i8").tobytes())
        return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    return send


def tally(table: pa.Table) -> pa.Table:
    """Of one bucket: the documents with each shingle, told to each chunk that has only some of them."""
    parts = [unpack(x, BYTES) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(parts)
    n = np.concatenate([np.frombuffer(x, dtype="<i8") for x in table.column("counts").to_pylist()])
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(h, kind="stable")
    h, n, row = h[order], n[order], row[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    total = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(h))))
    more = np.flatnonzero(total > n)
    more = more[np.argsort(row[more], kind="stable")]
    h, total, row = h[more], total[more], row[more]
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    out = [(chunks[row[x]], pack(h[x:y], BYTES), total[x:y].astype("<i8").tobytes()) for x, y in runs(row)]
    return pa.table(
        {"chunk": [x[0] for x in out], "bucket": [bucket] * len(out), "hashes": [x[1] for x in out], "counts": [x[2] for x in out]},
        schema=pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]),
    )


def weigher(buckets: int, n_docs: int, similarity: float):
    def weigh(texts: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("total", pa.float64()), ("common", pa.float64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary()), ("weights", pa.binary())])
        answers, reps = told.filter(told.column("bucket").is_valid()), told.filter(told.column("digest").is_valid())
        if not texts.num_rows or not reps.num_rows:
            return schema.empty_table()
        c = Chunk(texts, reps, buckets)
        if not len(c.key):
            return schema.empty_table()
        df = c.local.copy()
        names, totals = [], []
        for b, x, n in zip(answers.column("bucket").to_pylist(), answers.column("hashes").to_pylist(), answers.column("counts").to_pylist(), strict=True):
            h = unpack(x, BYTES)
            names.append(ids(h, np.full(len(h), b, dtype=np.int32), BYTES))
            totals.append(np.frombuffer(n, dtype="<i8"))
        if names:
            at = found(np.concatenate(names), c.names)
            df[at[at >= 0]] = np.concatenate(totals)[at >= 0]
        df = df[c.back]
        weight = (c.tf * idf(df, n_docs)).astype(np.float32).astype(np.float64)
        shared = df > np.array(c.copies)[c.text]
        size = len(c.node)
        total = np.bincount(c.text, weight, size)
        common = np.bincount(c.text, weight * shared, size)
        fit = (total > 0) & (common >= similarity * total * (1 - 1e-9))
        keep = fit[c.text]
        key, w, text, shared = c.key[keep], weight[keep], c.text[keep], shared[keep]
        if not len(key):
            return schema.empty_table()
        spans = runs(text)
        bands = signature(key, w, np.array([x for x, _ in spans])).view(np.int64)
        rows = {"node": [], "total": [], "common": [], "bands": list(bands), "shingles": [], "weights": []}
        for x, y in spans:
            s = shared[x:y]
            rows["node"].append(c.node[text[x]])
            rows["total"].append(total[text[x]])
            rows["common"].append(common[text[x]])
            rows["shingles"].append(key[x:y][s].tobytes())
            rows["weights"].append(w[x:y][s].astype("<f4").tobytes())
        return pa.table(rows, schema=schema)

    return weigh


def score(table: pa.Table) -> pa.Table:
    """Weighted Jaccard similarity of one text (``b`` null) with each other text of its part."""
    head, rest = table.filter(table.column("b").is_null()), table.filter(table.column("b").is_valid())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
    if not head.num_rows or not rest.num_rows:
        return schema.empty_table()
    mine = np.frombuffer(head.column("shingles")[0].as_py(), dtype=np.uint64)
    w = np.frombuffer(head.column("weights")[0].as_py(), dtype="<f4").astype(np.float64)
    out = []
    for x, y in zip(rest.column("shingles").to_pylist(), rest.column("weights").to_pylist(), strict=True):
        at = found(np.frombuffer(x, dtype=np.uint64), mine)
        both = at >= 0
        out.append(np.minimum(w[at[both]], np.frombuffer(y, dtype="<f4").astype(np.float64)[both]).sum())
    common = np.array(out)
    total = np.array(rest.column("total").to_pylist()) + head.column("total")[0].as_py()
    return pa.table({"a": rest.column("a").to_pylist(), "b": rest.column("b").to_pylist(), "score": common / (total - common)}, schema=schema)


def verify(pairs: DataFrame, candidates: DataFrame, rows: int) -> DataFrame:
    """Score distinct pairs (a, b), about ``rows``. The pairs of one ``a`` are dealt over parts, each with a copy of its set."""
    pairs = materialize(pairs, "pairs", rows)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    n_pairs = pairs.count()
    sized = materialize(sizes, "pair-parts", n_pairs)
    n_heads = sized.count()
    dealt = pairs.join(small(sized, n_heads), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = candidates.join(small(dealt.select("a", "b", "part"), n_pairs), F.col("node") == F.col("b"))
    heads = candidates.join(
        small(sized.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), n_heads + n_pairs // PART), F.col("node") == F.col("a")
    ).withColumn("b", F.lit(None).cast("long"))
    columns = ("a", "part", "b", "total", "shingles", "weights")
    return members.select(*columns).unionByName(heads.select(*columns)).groupBy("a", "part").applyInArrow(score, SCORED)


def candidate_sets(docs: DataFrame, reps: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """Texts that can have a partner: total weight, band hashes and the shingles that other texts have too."""
    plan = Plan.of(text_bytes(docs))
    # Dealt by id and text, so rows that share an id, or have none, are not one chunk.
    texts = chunked(docs.select(F.xxhash64("doc_id", F.unhex(F.md5("text"))).alias("doc_id"), "text"), plan, chunk_of(plan, F.col("doc_id")))
    keyed = reps.withColumn("doc_id", F.xxhash64("doc_id", "digest"))
    stand = keyed.select(chunk_of(plan, F.col("doc_id")).alias("chunk"), "doc_id", "digest", "node", "copies")
    sent = texts.groupBy("chunk").cogroup(stand.groupBy("chunk")).applyInArrow(sender(plan.buckets), SENT)
    heard = sent.groupBy("bucket").applyInArrow(tally, HEARD)
    told = heard.unionByName(stand, allowMissingColumns=True).select("chunk", "bucket", "hashes", "counts", "doc_id", "digest", "node", "copies")
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(weigher(plan.buckets, n_docs, similarity), CANDIDATE)


def links(candidates: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect every two texts of a bucket whose similarity reaches the threshold."""
    own = 1 - F.col("common") / F.col("total")  # the share of weight that no other text has
    n = candidates.count()
    slots = candidates.select("node", "total", "common", own.alias("own"), "bands", F.posexplode("bands").alias("band", "value"))
    shared = slots.groupBy("band", "value").agg(F.min(F.struct("own", "node", "total", "common")).alias("top"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(shared.select("band", "value", F.col("top").alias("leader")), "buckets", n * BANDS // 2)
    members = materialize(slots.join(small(shared, shared.count()), ["band", "value"]), "bucket-members", n * BANDS)
    first = members.filter((F.col("node") != F.col("leader.node")) & _possible("leader.", "", similarity))
    scores = materialize(verify(first.select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct(), candidates, n), "scores", n)
    good = scores.filter(F.col("score") >= similarity)

    # What is left in a bucket: pairs of different components, unless the bounds rule them out.
    labels = components(good, n)
    known = scores.select(F.col("a").alias("_leader"), F.col("b").alias("node"), "score")
    placed = members.withColumn("_leader", F.col("leader.node")).join(known, ["_leader", "node"], "left").join(labels, "node", "left")
    placed = materialize(placed.select(
        "band", "value", "bands", "node", "total", "common", "own", F.coalesce("label", "node").alias("label"),
        F.when(F.col("node") == F.col("_leader"), 1.0).otherwise(F.col("score")).alias("score"),
        F.when(F.col("node") == F.col("_leader"), F.col("common")).otherwise(
            F.col("score") * (F.col("total") + F.col("leader.total")) / (1 + F.col("score"))
        ).alias("met"),
    ), "bucket-labels", n * BANDS)
    parts = placed.groupBy("band", "value", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("band", "value").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).filter("labels > 1")
    main = materialize(main.select("band", "value", F.col("top.label").alias("main")), "mixed-buckets", n)
    mixed = placed.join(small(main, main.count()), ["band", "value"])
    inner = F.col("own") <= _own_bound(similarity)
    strays = mixed.filter(F.col("label") != F.col("main"))
    rest = _rest(strays.filter(inner), mixed, similarity).unionByName(_rest(strays.filter(~inner), mixed.filter(inner), similarity))
    rest = rest.distinct().join(scores.select("a", "b"), ["a", "b"], "left_anti").join(scores.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = verify(rest, candidates, n).filter(F.col("score") >= similarity)
    return materialize(good.unionByName(more), "verified", n)  # read twice below


def _own_bound(similarity: float) -> float:
    """Of two similar texts one has no more of its weight to itself: else (1 - u) / (1 + u) is under the threshold."""
    return (1 - similarity) / (1 + similarity) + 1e-9


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether the weights of two texts allow the similarity: they share at most the lesser of what each shares with any."""
    most = F.least(F.col(f"{x}common"), F.col(f"{y}common"))
    return most >= F.lit(similarity * (1 - 1e-9)) * (F.col(f"{x}total") + F.col(f"{y}total") - most)


def _rest(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one bucket and different components that neither the weights nor the scores with the leader rule out.

    1 - similarity is a metric: two texts whose distances to a third differ by more than the bound are too far apart.
    What two texts share is at most the lesser of what they share with the leader (``met``), and the lesser of the weight
    outside the leader that each shares with any text.
    """
    x, y = left.alias("x"), right.alias("y")
    most = F.least("x.met", "y.met") + F.least(F.col("x.common") - F.col("x.met"), F.col("y.common") - F.col("y.met"))
    apart = F.coalesce(most * (1 + 1e-6) < F.lit(similarity) * (F.col("x.total") + F.col("y.total") - most), F.lit(False))
    far = F.coalesce(F.abs(F.col("x.score") - F.col("y.score")) > 1 - similarity + 1e-9, F.lit(False))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value"))
    # A pair is met in the first band that it shares, once.
    again = F.exists(F.slice(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), F.lit(1), F.col("x.band")), lambda p: p)
    met = x.join(y, same & (F.col("x.label") != F.col("y.label")) & _possible("x.", "y.", similarity) & ~far & ~apart & ~again)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id (NO_ID for null), digest and class_id of every row of ``docs``, and the text that stands for its class.

    ``stands`` is the digest of the class's text with the smallest doc_id, by digest where several have it.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), body.alias("text"))
    n = rows.count()
    digests = materialize(rows.select("doc_id", F.unhex(F.md5("text")).alias("digest")), "digests", n)
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    # A node of the graph is a text, not a doc_id: ids may repeat or be null.
    reps = materialize(first.withColumn("node", F.monotonically_increasing_id()), "reps", n)
    candidates = materialize(candidate_sets(rows, reps, n, similarity).hint("rebalance"), "candidates")
    labels = components(links(candidates, similarity), candidates.count())
    placed = materialize(reps.join(labels, "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label")), "placed", n)
    tops = placed.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("top"))
    classes = placed.join(tops, "label").select("digest", F.col("top.doc_id").alias("class_id"), F.col("top.digest").alias("stands"))
    return digests.join(classes, "digest")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, of every row of ``docs`` (doc_id, text)."""

    def real(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c)).alias(c)

    return _classes(docs, similarity).select(real("doc_id"), real("class_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The row of ``docs`` that stays of each class: that with the smallest doc_id, by its text's digest if it has several."""
    tops = _classes(docs.select("doc_id", "text"), similarity).filter(F.col("digest") == F.col("stands"))
    tops = tops.groupBy("digest").agg(F.min("doc_id").alias("id"))
    same = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    others = [c for c in docs.columns if c != "text"]  # in a struct, where no name clashes
    packed = docs.select(F.struct(F.lit(0), *others).alias("row"), "text", same.alias("same")).select("row", "text", "same", "same.id", "same.digest")
    left = packed.join(tops, ["id", "digest"], "left_semi").dropDuplicates(["same"])
    return left.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
