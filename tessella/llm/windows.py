"""Hashes of every fixed-length window of words, and their exchange between chunks of documents.

A word has two independent hashes: sums of its bytes times random odd 64-bit weights by place (multilinear hashing),
which no pattern of letters cancels as it can a polynomial modulo a power of two. Windows are hashed by Rabin-Karp
polynomials over either hash, one to tell them apart and one to choose their bucket, from prefix sums modulo 2^64 (the base
is odd, so a division by its powers is a product), which numpy does for a whole chunk at once. Memory follows ``SLICE``
bytes of text and the chunk, not the corpus.

A chunk is a set of documents, dealt by a hash, some MB of text. A chunk sends each of its distinct windows once,
packed by bucket (a second hash), so a passage in very many documents costs a row's part a chunk, not a document. What
a bucket finds out goes back to the chunks that asked. Texts are shuffled once, compressed: both passes over a chunk
read the same exchange.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
WINDOW_BASE, BUCKET_BASE = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
SLICE = 1 << 20
#: Seeds of the two word hashes, and places of a word whose weights are kept in a table.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PLACES = 1 << 12
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
EMPTY = np.zeros(0, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def powers(base: int, bits: int) -> np.ndarray:
    """base ** i modulo 2^64 for i below 2 ** bits."""
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def power(base: int, n: int) -> np.ndarray:
    return powers(base, max(10, int(n).bit_length()))[:n]


def inverse(base: int, n: int) -> np.ndarray:
    return power(pow(base, -1, 1 << 64), n)


def _weights(seed: int, place: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)) | np.uint64(1)


@lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    return _weights(seed, np.arange(PLACES))


def _slice_words(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(where words begin, their two hashes); data begins and ends between words."""
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return begin, [EMPTY, EMPTY]
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    letters = data[~blank].astype(np.uint64) + np.uint64(1)
    far = np.flatnonzero(place >= PLACES)
    near = np.minimum(place, PLACES - 1) if len(far) else place
    hashes = []
    for seed in SEEDS:
        weights = _table(seed)[near]
        if len(far):
            weights[far] = _weights(seed, place[far])
        hashes.append(mix(np.add.reduceat(letters * weights, first) + size.astype(np.uint64) * np.uint64(seed)))
    return begin, hashes


def words(texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(two hashes of every word, index of the first word of each text and the number of words)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    begins, hashes, at = [], ([], []), 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not BLANK[data[end - 1]]:  # never inside a word
            step = np.flatnonzero(BLANK[data[end : end + SLICE]])
            end = end + int(step[0]) + 1 if len(step) else min(end + SLICE, len(data))
        b, h = _slice_words(data[at:end])
        begins.append(b + at)
        for known, new in zip(hashes, h, strict=True):
            known.append(new)
        at = end
    begin = np.concatenate(begins) if begins else np.zeros(0, dtype=np.int64)
    one, two = (np.concatenate(h) if h else EMPTY for h in hashes)
    return (one, two), np.searchsorted(begin, starts)


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of every run of ``width`` entries."""
    n = len(h)
    if n < width:
        return EMPTY
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * power(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse(base, n)[: n - width + 1])


@dataclass
class Windows:
    """Every window of every text of a chunk: its first word (in the chunk), its text, its hash and bucket hash."""

    at: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    other: np.ndarray
    bounds: np.ndarray


def windows(texts: list[bytes], width: int, short: bool = False) -> Windows:
    """``short``: a text with fewer words than ``width`` (but some) is one window."""
    (h, g), bounds = words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    n = max(0, len(h) - width + 1)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :]) if n else np.zeros(0, dtype=np.int64)
    one, two = rolling(h, width, WINDOW_BASE), rolling(g, width, BUCKET_BASE)
    out = Windows(at, doc[at], one[at], two[at], bounds)
    if short:
        size = np.diff(bounds)
        few = np.flatnonzero((size > 0) & (size < width))
        if len(few):
            spans = [(bounds[k], bounds[k + 1]) for k in few]
            extra = [np.array([rolling(x[p:q], q - p, base)[0] for p, q in spans], dtype=np.uint64) for x, base in ((h, WINDOW_BASE), (g, BUCKET_BASE))]
            order = np.argsort(np.concatenate((out.doc, few)), kind="stable")
            out = Windows(
                np.concatenate((out.at, bounds[few]))[order], np.concatenate((out.doc, few))[order],
                np.concatenate((out.hash, extra[0]))[order], np.concatenate((out.other, extra[1]))[order], bounds,
            )
    return out


def pack(h: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values; none for no values."""
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))).tolist() if len(values) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))


def cut(h: np.ndarray, width: int) -> np.ndarray:
    return h & np.uint64((1 << (8 * width)) - 1)


@dataclass(frozen=True)
class Plan:
    """How many chunks and buckets: both grow with the input, and a chunk or a bucket grows with its root up to a bound."""

    chunks: int
    buckets: int

    @classmethod
    def of(cls, n_bytes: int) -> Plan:
        grow = min(32.0, max(1.0, (n_bytes / 4e9) ** 0.5))
        return cls(max(1, -(-n_bytes // int(1e6 * grow))), max(1, -(-n_bytes // int(1.5e6 * min(16.0, grow)))))


def zipped(text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        return texts.map(lambda t: c.compress((t or "").encode()))

    return run(text)


def unzip(column: pa.ChunkedArray) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in column.to_pylist()]


def chunk_of(plan: Plan, *by: Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(plan.chunks)).cast("int")


def chunked(docs: DataFrame, plan: Plan, chunk: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk, doc_id and compressed text. Every use of it must take all three columns, so the exchange is shared."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(chunk.alias("chunk"), F.col(doc_id).cast("long").alias("doc_id"), zipped(body).alias("z"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def by_bucket(other: np.ndarray, buckets: int) -> np.ndarray:
    return (other % np.uint64(buckets)).astype(np.int32)


def ids(h: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """One number for a packed hash and its bucket."""
    return mix(cut(h, width) + bucket.astype(np.uint64) * np.uint64(BUCKET_BASE))


def found(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index of each ``x`` in the sorted array, or -1."""
    if not len(among):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, -1)
