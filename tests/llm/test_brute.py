"""Operators without SQL, and the pipeline's stages, against their plain forms."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from tessella.llm import bpe, lines, mixing, near, quality, sharding, substrings, tokens
from tests.compare import SF_DIR
from tests.llm import brute
from tests.llm.test_oracle import odd_documents


def place_of(d: int | None) -> int:
    return -(1 << 63) if d is None else d


def texts_of(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def planted(spark):
    """Copies, near copies, shared passages of 49, 50, 51 and 120 words, and short texts; a null id and a null text."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "tu", "ü", "你") for b in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = {n: prose(n) for n in (49, 50, 51, 120)}
    rows = [(k, " ".join(prose(rng.randint(0, 200)))) for k in range(40)]
    for k in range(40, 80):
        p = passages[rng.choice(list(passages))]
        rows.append((k, " ".join(prose(rng.randint(0, 60)) + p + prose(rng.randint(0, 60)))))
    base = prose(300)
    for k in range(80, 110):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " \n".join(w) if k % 2 else " ".join(w)))
    rows += [(110 + k, " ".join(base)) for k in range(30)]
    rows += [(200, None), (201, ""), (202, " \t "), (203, "one two three"), (204, "one two three"), (205, "one two  three"), (None, " ".join(base[:100]))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("table", ["given", "planted"])
def test_substrings(request, table):
    docs = request.getfixturevalue(table)
    got = substrings.op2(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute.substrings(texts_of(docs))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r[2] for r in want) > 0


def test_substring_intervals_are_maximal(planted):
    for r in substrings.dedup_substrings(planted).collect():
        ends = [(s.begin, s.end) for s in r.spans]
        assert sum(e - b for b, e in ends) == r.n_removed
        assert all(e >= b + 50 for b, e in ends) and all(ends[k][1] < ends[k + 1][0] for k in range(len(ends) - 1))


@pytest.mark.parametrize("table", ["given", "planted"])
def test_near_duplicates(request, table):
    docs = request.getfixturevalue(table)
    got = {r.doc_id: r.class_id for r in near.op5(docs).collect()}
    want = brute.near_classes(texts_of(docs))
    assert got == want
    assert len(set(want.values())) < len(want)


def test_token_counts(spark, given):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    long = [
        "x" * 40_000, "你好世界" * 9_000, "a  b   c\t\n d" * 6_000, "word " * 20_000, " " * 40_000, "\U0001f600 é" * 12_000,
        " ".join(rng.choice(["the", "of", "Straße", "naïve", "é", "<s>", "</s>", "▁", "1234", "\x00"]) for _ in range(30_000)),
    ]
    docs = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(long)], "doc_id long, text string").union(given.select("doc_id", "text")).union(odd_documents(spark).select("doc_id", "text"))
    for r, (_, text) in zip(tokens.op4(docs).collect(), texts_of(docs), strict=True):
        n = len(model.encode(text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 4096)


@pytest.mark.parametrize("chunk", [64, 500])
def test_small_chunks_splice_to_the_same_count(given, chunk):
    c = tokens.counter(public_tokenizers.path("piece_bpe_32k.model"))
    for _, text in texts_of(given)[:60]:
        if text:
            assert c.long(text, chunk=chunk, overlap=16) == c.short([text])[0]


def test_bpe(spark, given):
    path = public_tokenizers.path("word_bpe_49k.json")
    special = ["<|startoftext|> a<|endoftext|>b <|endoftext", "İstanbul ΣΑΣ ß ﬁ", "don't we'll I'M", "aaaaaaaaaaaaaaaaaaaaaaaa" * 50, "​ \x85 x", "é é"]
    docs = spark.createDataFrame([(2000 + k, t) for k, t in enumerate(special)], "doc_id long, text string").union(given.select("doc_id", "text")).union(odd_documents(spark).select("doc_id", "text"))
    got = [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10(docs).collect()]
    assert got == brute.bpe([t for _, t in texts_of(docs)], path)


@pytest.mark.parametrize("table", ["given", "planted"])
def test_sharding(request, table):
    docs = request.getfixturevalue(table)
    got = sharding.op9(docs).collect()
    texts = texts_of(docs)
    assert sorted((str(r.doc_id), r.text_crc32, r.size) for r in got) == sorted((str(d), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t in texts)
    groups: dict[str, list] = defaultdict(lambda: [1 << 62, 0])
    for d, t in texts:
        g = groups[t or ""]
        g[0], g[1] = min(g[0], 1 << 61 if d is None else d), g[1] + len((t or "").encode()) + 16
    ordered = [s for _, s in sorted(groups.values())]
    load, slots, place = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        place[r.text_crc32].add(r.shard)
    assert max(load.values()) == brute.smallest_capacity(ordered, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in place.values())
    assert {r.law for r in got} == {"bytes"} and all(0 <= r.shard < 40 and r.grown_shard is None for r in got)


def sql_rows(df, sql: str) -> list[dict]:
    con = duckdb.connect()
    con.register("stage_docs", df.toPandas())
    return con.execute(sql).df().to_dict("records")


def plain_stage(name: str, docs) -> list[tuple]:
    """Sorted (doc_id, text) of a stage's result, or the digests of the last one."""
    rows = texts_of(docs)
    if name == "quality_rules":
        stay = {r["doc_id"] for r in sql_rows(docs, quality.sql("stage_docs")) if r["kept"]}
        return sorted(r for r in rows if r[0] in stay)
    if name == "line_dedup":
        return sorted((d, t) for d, t in brute.lines_removed(rows).items() if brute.words(t))
    if name == "near_dedup":
        return sorted((d, t) for d, t in rows if brute.near_classes(rows)[d] == d) if len(rows) < 5 else (lambda c: sorted((d, t) for d, t in rows if c[d] == d))(brute.near_classes(rows))
    if name == "mix_sources":
        taken = {r["doc_id"]: (int(r["size"]), int(r["taken"])) for r in sql_rows(docs, mixing.sql("stage_docs"))}
        out = []
        for d, t in rows:
            size, n = taken[d]
            while n > 0:
                out.append((d, t if n >= size else " ".join(brute.words(t)[:n])))
                n -= size
        return sorted(out)
    digests = brute.bpe([t for _, t in rows], bpe.default_path())
    return sorted((d, *x) for (d, _), x in zip(rows, digests, strict=True))


def test_pipeline_stages(spark, given):
    docs = given
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF_DIR)
        last = name == corpus_pipeline.STAGES[-1][0]
        got = sorted(tuple(r) for r in done.select(*("doc_id", "n_tokens", "ids_sha256", "decoded_sha256") if last else ("doc_id", "text")).collect())
        assert got == plain_stage(name, docs), name
        if not last:
            assert done.columns == given.columns
            docs = spark.createDataFrame(done.collect(), given.schema)
    assert got


def test_line_dedup_keeps_other_columns(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    want = brute.lines_removed(texts_of(docs))
    assert {d: r.text for d, r in got.items()} == want
    assert all(r["_text"] == "clash" for d, r in got.items() if d != 99)


def repeated_ids() -> list[tuple]:
    """Many null ids and shared ids with different texts, equal rows among them."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    some = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 15))] for _ in range(25)]

    def line() -> str:
        w = list(rng.choice(some)) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(9)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    rows = [(rng.choice([None, None, 1, 2, 2, k + 10]), "\n".join(line() for _ in range(rng.randint(1, 6)))) for k in range(90)]
    return [*rows, *rows[:15], (None, None), (2, ""), (None, "")]


def test_line_dedup_of_repeated_ids(spark):
    rows = repeated_ids()
    placed = [(place_of(d), k, frozenset(brute.words(x))) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))]

    def gone(d, k: int, x: str) -> bool:
        w = frozenset(brute.words(x))
        return bool(w) and any((e, j) < (place_of(d), k) and v and 5 * len(v & w) >= 4 * len(v | w) for e, j, v in placed)

    want = [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not gone(d, k, x))) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(str, texts_of(lines.dedup_lines(docs)))) == sorted(map(str, want))
    assert 20 < sum(a != b for a, b in zip(rows, want, strict=True)) < len(rows)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(900)]
    bases = [[rng.choice(vocabulary) for _ in range(150)] for _ in range(12)]
    rows = []
    for k in range(70):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((rng.choice([None, None, 1, 2, 2, k + 10]), " ".join(w)))
    rows += [*rows[:10], (None, None), (None, ""), (3, "a b")]
    least = {}
    for d, t in rows:
        least[t or ""] = min(place_of(d), least.get(t or "", place_of(d)))
    order = sorted(least, key=lambda t: (least[t], hashlib.md5(t.encode()).digest()))
    node = {t: k for k, t in enumerate(order)}
    classes = brute.near_classes([(node[t or ""], t) for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    want = sorted((place_of(d), least[order[classes[node[t or ""]]]]) for d, t in rows)
    assert sorted((place_of(r.doc_id), place_of(r.class_id)) for r in near.op5(docs).collect()) == want
    table = docs.selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "0L AS n_chars")
    left = texts_of(corpus_pipeline.near_dedup(spark, table, SF_DIR))
    assert sorted((place_of(d), t or "") for d, t in left) == sorted((least[order[c]], order[c]) for c in set(classes.values()))
    assert len(set(classes.values())) < len(order)


def test_empty_stages(spark, given):
    docs = given.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0, name
