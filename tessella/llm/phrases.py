"""Phrase collocation mining: frequent phrases of 2 to 5 words a language, by position bitmaps of shards.

A shard is some MB of the pieces of one language that one task reads: its words in a small dictionary, and the sequence of
their codes with a break between pieces. Within a shard every word has a compressed bitmap of the positions where it
stands: the 64-position blocks that are not empty, and their bits. Moving a bitmap by one position and intersecting it
with that of another word gives the ends of a longer phrase; a break is no word, so no phrase reaches over it. Counts are
sums over shards of the bits that are set, and what is counted over all shards steers the next step:

1. Words: their counts over all shards; those under the threshold are in no candidate. The others get a number.
2. Pairs: bitmaps of two frequent words in a row, for each shard; pairs under the threshold are in no candidate. Then
   triples, as two frequent pairs in a row, in the same way: what a pair is to words, a triple is to pairs.
3. Phrases of 4 and 5 words: a shard starts from its frequent triples, a group of them at a time, and extends each by the
   frequent triples that begin with its last pair, to the full depth before the next group, so memory follows a group.
   The bitmap of an extension is the phrase's, moved by one, and the triple's: block by block, all of a group at once.

So no phrase is lost by being rare in every shard: pruning is by counts of the whole corpus only. A shard hears which of
its words, pairs and triples are frequent through joins, a row for each of its own; nothing that grows with the corpus is broadcast
or collected. Shards are written to the shared folder with their number, so a lost task reads the same again.

Scores and the removal of phrases inside longer ones are joins and decimals of 38 digits, exact up to 10^13 words a language.

Defined results for odd input: a null text has no pieces; a null lang is 'und', as is the lang 'und'; doc_ids do not take
part; repeated rows count as often as they stand; a word is any run without space and tab, however long; equal scores and
counts are ordered by the bytes of the phrase; an empty table gives an empty table. Memory follows a shard, or one text if
that is larger. Extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, materialize
from tessella.llm.windows import runs

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text of a shard, and bitmap blocks that a group of starting pairs brings at most (a single pair may bring more).
SHARD, GROUP = 16 << 20, 1 << 18
#: Texts that are cut into words at once.
SLICE = 1 << 20
ONE, SIX, BIT = np.uint64(1), np.uint64(6), np.uint64(63)

_PIECES = bytes(0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
PARTS = ["a", "b", "c", "d", "e"]


class Shard:
    """Words of one language as they come in: a dictionary, and codes with 0 as the break between pieces."""

    def __init__(self) -> None:
        self.code: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.waiting: list[bytes] = []
        self.bytes = self.held = 0

    def add(self, text: str) -> None:
        raw = text.encode()
        self.bytes += len(raw)
        self.held += len(raw)
        self.waiting.append(raw)
        if self.held >= SLICE:
            self.cut()

    def cut(self) -> None:
        """Words of the waiting texts."""
        tokens = [w for w in b"\n".join([*self.waiting, b""]).lower().translate(_PIECES).replace(b"\n", b" \n ").split(b" ") if w]
        self.waiting, self.held = [], 0
        if tokens:
            codes, distinct = pd.factorize(np.array(tokens, dtype=object))
            known = self.code
            to = np.array([0 if w == b"\n" else known.setdefault(w, len(known) + 1) for w in distinct], dtype=np.int32)
            out = to[codes]
            # one break between pieces is enough
            self.parts.append(out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))])

    def row(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(codes, words, counts)"""
        self.cut()
        codes = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=np.int32)
        return codes, list(self.code), np.bincount(codes, minlength=len(self.code) + 1)[1:]


SHARDS = "shard long, lang string, first long, n long, words array<string>, counts array<long>, codes binary"


def _packed(codes: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(codes.astype("<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<i4")


def shards_of(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The shards, built where the texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        first = TaskContext.get().partitionId() << 40
        open_: dict[str, Shard] = {}

        def close(key: str) -> pa.RecordBatch:
            nonlocal number, first
            number += 1
            codes, words, counts = open_.pop(key).row()
            first += len(words)
            return pa.record_batch(
                {
                    "shard": pa.array([number], pa.int64()), "lang": pa.array([key]), "first": pa.array([first - len(words)], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64()),
                    "words": pa.array([[w.decode() for w in words]], pa.list_(pa.string())), "counts": pa.array([counts], pa.list_(pa.int64())),
                    "codes": pa.array([_packed(codes)], pa.binary()),
                }
            )

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = open_.setdefault(key, Shard())
                shard.add(t)
                if shard.bytes >= SHARD:
                    yield close(key)
        for key in list(open_):
            yield close(key)

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, SHARDS)


def _numbered(words: pa.Table, n_words: int) -> np.ndarray:
    """Global number of each local code, 0 where the word is not frequent."""
    to = np.zeros(n_words + 1, dtype=np.int64)
    to[np.asarray(words.column("code"), dtype=np.int64)] = np.asarray(words.column("word"), dtype=np.int64)
    return to


def _frequent(shard: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(global numbers of the shard's frequent words by their order, codes of the text in that order from 1, else 0)."""
    codes = _unpacked(shard.column("codes")[0].as_py())
    to = _numbered(words, int(codes.max(initial=0)))
    numbers = np.unique(to[to > 0])
    return numbers, (np.searchsorted(numbers, to) + 1)[codes] * (to[codes] > 0)


def bitmaps(key: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, block, bits) sorted by key and block: the compressed bitmaps of where each key stands."""
    block = position >> 6
    order = np.lexsort((block, key))
    k, b = key[order], block[order]
    if not len(k):
        return k, b, np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1]))))
    return k[first], b[first], np.bitwise_or.reduceat(ONE << (position[order].astype(np.uint64) & BIT), first)


def pair_bitmaps(text: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, block, bits): the ends of each two words in a row; a pair is first * n_words + second, codes from 0."""
    at = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0)) + 1
    return bitmaps((text[at - 1].astype(np.int64) - 1) * n_words + text[at] - 1, at)


def popcounts(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, bits set in all their blocks) of keys in order."""
    if not len(key):
        return key, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)


PAIRS = "shard long, a long, b long, n long"
TRIPLES = "shard long, a long, b long, c long, n long"
PHRASES = ", ".join(f"{c} long" for c in PARTS) + ", n long"


def _table(shape: str, columns: list[np.ndarray]) -> pa.Table:
    return pa.table(columns, schema=pa.schema([(c.split()[0], pa.int64()) for c in shape.split(", ")]))


def count_pairs(shard: pa.Table, words: pa.Table) -> pa.Table:
    """Counts of a shard's pairs of frequent words."""
    if not len(shard) or not len(words):
        return _table(PAIRS, [[]] * 4)
    numbers, text = _frequent(shard, words)
    pair, _, bits = pair_bitmaps(text, len(numbers))
    pair, n = popcounts(pair, bits)
    return _table(PAIRS, [np.full(len(n), shard.column("shard")[0].as_py()), numbers[pair // len(numbers)], numbers[pair % len(numbers)], n])


def _split(heard: pa.Table, part: str) -> tuple[pa.Table, list[np.ndarray]]:
    """(words, frequent phrases by column) of what a shard hears; ``part``: the last word of a phrase."""
    phrase = heard.column(part).is_valid()
    return heard.filter(pa.compute.invert(phrase)), [np.asarray(heard.filter(phrase).column(c), dtype=np.int64) for c in PARTS[: PARTS.index(part) + 1]]


def pair_text(text: np.ndarray, n_words: int, pairs: np.ndarray) -> np.ndarray:
    """At the end of each of ``pairs`` (in order) its place among them from 1, else 0."""
    here = (text[:-1] - 1) * n_words + text[1:] - 1
    at = np.minimum(np.searchsorted(pairs, here), len(pairs) - 1)
    return np.concatenate(([0], np.where((text[:-1] > 0) & (text[1:] > 0) & (pairs[at] == here), at + 1, 0)))


def count_triples(shard: pa.Table, heard: pa.Table) -> pa.Table:
    """Counts of a shard's triples whose pairs are frequent; ``heard``: its words (code, word) and pairs (a, b)."""
    words, pairs = _split(heard, "b")
    if not len(shard) or not len(pairs[0]):
        return _table(TRIPLES, [[]] * 5)
    numbers, text = _frequent(shard, words)
    a, b = (np.searchsorted(numbers, x) for x in pairs)
    pairs = np.unique(a * len(numbers) + b)
    triple, _, bits = pair_bitmaps(pair_text(text, len(numbers), pairs), len(pairs))
    triple, n = popcounts(triple, bits)
    first, second = pairs[triple // len(pairs)], pairs[triple % len(pairs)]
    parts = [first // len(numbers), first % len(numbers), second % len(numbers)]
    return _table(TRIPLES, [np.full(len(n), shard.column("shard")[0].as_py()), *[numbers[x] for x in parts], n])


def count_phrases(shard: pa.Table, heard: pa.Table) -> pa.Table:
    """Counts of a shard's phrases of 4 and 5 words whose triples are all frequent; ``heard``: its words (code, word) and triples (a, b, c)."""
    words, triples = _split(heard, "c")
    if not len(shard) or not len(triples[0]):
        return _table(PHRASES, [[]] * 6)
    numbers, text = _frequent(shard, words)
    a, b, c = (np.searchsorted(numbers, x) for x in triples)
    first, second = a * len(numbers) + b, b * len(numbers) + c
    pairs = np.unique(np.concatenate((first, second)))
    triples = np.unique(np.searchsorted(pairs, first) * len(pairs) + np.searchsorted(pairs, second))
    found = list(Extension(pair_text(text, len(numbers), pairs), len(pairs), triples).phrases(LONGEST - 1))
    if not found:
        return _table(PHRASES, [[]] * 6)
    spelt = [[*pairs[u] // len(numbers), pairs[u[-1]] % len(numbers)] for u, _ in found]
    columns = [np.concatenate([numbers[w[k]] if k < len(w) else np.zeros(len(n), dtype=np.int64) for w, (_, n) in zip(spelt, found, strict=True)]) for k in range(LONGEST)]
    return _table(PHRASES, [*columns, np.concatenate([n for _, n in found])])


class Extension:
    """Phrases of a shard from its frequent pairs of units, which are words, or pairs of words that overlap by one."""

    def __init__(self, text: np.ndarray, n_words: int, pairs: np.ndarray):
        """``pairs``: the frequent ones, in order."""
        self.n_words = n_words
        pair, block, bits = pair_bitmaps(text, n_words)
        keep = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair
        self.pair, self.block, self.bits = pair[keep], block[keep], bits[keep]
        # the same bitmaps by first unit and block: what can follow a phrase there
        self.stride = int(len(text) >> 6) + 2
        after = self.pair // n_words * self.stride + self.block
        order = np.argsort(after, kind="stable")
        self.after, self.next_word, self.next_bits = after[order], (self.pair % n_words)[order], self.bits[order]

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs' bitmaps, some pairs at a time."""
        edges = [x for x, _ in runs(self.pair)] + [len(self.pair)]
        begin = 0
        for k in range(1, len(edges)):
            if k == len(edges) - 1 or edges[k + 1] - edges[begin] > GROUP:
                at = slice(edges[begin], edges[k])
                yield self.pair[at], self.block[at], self.bits[at]
                begin = k

    def step(self, phrase: np.ndarray, last: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase * n_words + next word, next word, block, bits) of all extensions by one word, by phrase and block."""
        carried = bits >> BIT
        over = np.flatnonzero(carried)
        phrase, last = np.concatenate((phrase, phrase[over])), np.concatenate((last, last[over]))
        block, bits = np.concatenate((block, block[over] + 1)), np.concatenate((bits << ONE, carried[over]))
        key = last * self.stride + block
        low, high = np.searchsorted(self.after, key), np.searchsorted(self.after, key, side="right")
        size = high - low
        row = np.repeat(np.arange(len(key)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]
        both = bits[row] & self.next_bits[at]
        hit = np.flatnonzero(both)
        row, at, both = row[hit], at[hit], both[hit]
        child = phrase[row] * self.n_words + self.next_word[at]
        order = np.lexsort((block[row], child))
        return child[order], self.next_word[at][order], block[row][order], both[order]

    def phrases(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(units of each phrase by column, counts) for 3 to ``longest`` units, group by group."""
        for pair, block, bits in self.groups():
            words = np.array(sorted(set(pair.tolist())), dtype=np.int64)
            node = np.searchsorted(words, pair)
            columns = [words // self.n_words, words % self.n_words]
            last = pair % self.n_words
            for _ in range(3, longest + 1):
                child, last, block, bits = self.step(node, last, block, bits)
                if not len(child):
                    break
                found, n = popcounts(child, bits)
                parent, word = found // self.n_words, found % self.n_words
                columns = [c[parent] for c in columns] + [word]
                node = np.searchsorted(found, child)
                yield np.stack(columns), n


def mine(scratch: Scratch, docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, text, word, f; phrases: a to e, size, f; totals: lang, n), all of frequency ``least`` or more.

    A word's number tells its language too; the parts of a phrase are numbers, 0 after the last.
    """
    shards = scratch.keep(shards_of(docs, lang, text), "phrase_shards")
    entry = F.transform(F.arrays_zip("words", "counts"), lambda x, k: F.struct((k + 1).alias("code"), x["words"].alias("text"), x["counts"].alias("n")))
    held = shards.select("shard", "lang", "first", F.explode(entry).alias("w")).select("shard", "lang", "w.*", (F.col("first") + F.col("w.code")).alias("entry"))
    # a word's number is the smallest of those that the shards' dictionaries gave it
    same = Window.partitionBy("lang", "text")
    over = held.withColumns({"f": F.sum("n").over(same), "word": F.min("entry").over(same)}).filter(F.col("f") >= least)
    names = F.when(F.col("entry") == F.col("word"), F.struct("lang", "text", "f"))
    known = scratch.keep(over.select("shard", "code", "word", names.alias("named")), "phrase_known")
    words = known.filter("named IS NOT NULL").select("word", "named.*")
    known = known.select("shard", "code", "word")
    codes = shards.select("shard", "codes")

    def counted(count, shape: str, heard: DataFrame) -> DataFrame:
        return codes.groupBy("shard").cogroup(heard.groupBy("shard")).applyInArrow(count, shape)

    def frequent(found: DataFrame, parts: list[str]) -> DataFrame:
        """(shard, parts, f) where the counts of all shards reach the threshold."""
        over = found.withColumn("f", F.sum("n").over(Window.partitionBy(*parts))).filter(F.col("f") >= least)
        return scratch.keep(over.select("shard", *parts, "f"), "phrase_parts")

    def hears(parts: DataFrame) -> DataFrame:
        return known.unionByName(parts.drop("f"), allowMissingColumns=True)

    pairs = frequent(counted(count_pairs, PAIRS, known), PARTS[:2])
    triples = frequent(counted(count_triples, TRIPLES, hears(pairs)), PARTS[:3])
    longer = counted(count_phrases, PHRASES, hears(triples)).groupBy(*PARTS).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    every = longer
    for table, parts in ((pairs, PARTS[:2]), (triples, PARTS[:3])):
        every = every.unionByName(table.groupBy(*parts).agg(F.first("f").alias("f")), allowMissingColumns=True)
    every = every.fillna(0, PARTS)
    size = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in PARTS[1:]), F.lit(1))
    phrases = scratch.keep(every.select(*PARTS, size.alias("size"), "f"), "phrase_found")
    return words, phrases, shards.groupBy("lang").agg(F.sum("n").alias("n"))


def rank(words: DataFrame, phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language that no longer phrase of the same count contains."""
    whole = phrases.select("f", "size", F.slice(F.array(*PARTS), F.lit(1), F.col("size")).alias("key"))
    inside = whole.filter("size > 2").select(F.explode(F.array(F.slice("key", F.lit(1), F.col("size") - 1), F.slice("key", F.lit(2), F.col("size") - 1))).alias("key"), "f").distinct()
    kept = whole.join(inside, ["key", "f"], "left_anti")

    known = whole.select("key", "f").unionByName(words.select(F.array("word").alias("key"), "f"))
    cuts = kept.select("key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.slice("key", F.lit(1), F.col("k")).alias("left"), F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")).alias("right"))
    left, right = known.select(F.col("key").alias("left"), F.col("f").alias("l")), known.select(F.col("key").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, "left").join(right, "right")
    named = words.select(F.col("word").alias("first"), "lang", F.col("text"))
    cuts = cuts.withColumn("first", F.get("key", F.lit(0))).join(named.select("first", "lang"), "first").join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("best")).select("key", "best.*")

    spelt = best.select("key", F.posexplode("key").alias("place", "first")).join(named.select("first", "text"), "first")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelt, "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: a written table, while those that led to it are dropped."""
    with Scratch(docs.sparkSession) as scratch:
        return materialize(rank(*mine(scratch, docs, least, lang, text), top), "phrases")


def op12(docs: DataFrame) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    return mine_phrases(docs)


def sql() -> str:
    return r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
t as (select lang, row_number() over () as piece, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from t group by lang),
u as (select lang, piece, unnest(w) as w, generate_subscripts(w, 1) as i from t),
g as (
    select lang, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4, lead(w, 4) over o as w5 from u
    window o as (partition by lang, piece order by i)
),
f as (
    select lang, [w] as p, count(*) as f from g group by lang, w
    union all select lang, [w, w2], count(*) from g where w2 is not null group by lang, w, w2
    union all select lang, [w, w2, w3], count(*) from g where w3 is not null group by lang, w, w2, w3
    union all select lang, [w, w2, w3, w4], count(*) from g where w4 is not null group by lang, w, w2, w3, w4
    union all select lang, [w, w2, w3, w4, w5], count(*) from g where w5 is not null group by lang, w, w2, w3, w4, w5
),
c as (select lang, p, f as a from f where len(p) >= 2 and f >= {least}),
inside as (select distinct lang, a, p[b:b + size - 1] as p from c, range(2, 5) s(size), range(1, 6) t(b) where size < len(p) and b + size - 1 <= len(p)),
kept as (select * from c anti join inside using (lang, p, a)),
cuts as (select lang, p, a, unnest(range(1, len(p))) as k from kept),
scored as (
    select cuts.*, x.f as l, y.f as r, n, 1000 * a::hugeint * n::hugeint // (x.f::hugeint * y.f::hugeint) as score
    from cuts join total using (lang) join f x on x.lang = cuts.lang and x.p = cuts.p[1:k] join f y on y.lang = cuts.lang and y.p = cuts.p[k + 1:]
),
best as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank, array_to_string(p, ' ') as phrase, a, l, r, n, score::bigint as score from best)
select * from ranked where rank <= {top}
""".replace("{least}", str(LEAST)).replace("{top}", str(TOP))
