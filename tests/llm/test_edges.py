"""Cases that go wrong easily: colliding words, blanks between sections, endless words, magics in payloads, clashing names, large groups."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, fingerprint, lines, mixing, near, quality, sharding, substrings, warc
from tests.compare import SF_DIR, folder
from tests.llm import brute


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_in_a_pattern_do_not_collide(spark):
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rest = [f"w{k}" for k in range(49)]
    rows = [(1, " ".join([x, *rest])), (2, " ".join([y, *rest])), (3, " ".join([x, *rest])), (4, "a " * 3 + x * 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.op2(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 50, 4: 0}
    two = spark.createDataFrame([(1, " ".join([x, *rest[:4]])), (2, " ".join([y, *rest[:4]])), (3, " ".join([x, *rest[:4]]))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near.op5(two).collect()} == {1: 1, 2: 2, 3: 1}


def test_roots_tell_all_texts_apart(spark):
    texts = ["one two\n\nthree four", "one two\n \nthree four", "one two\n\t\t\nthree four", "one two\n\nthree four\n", "\none two\n\nthree four", "", "\n", "\n\n", "\n\n\n", "a" * 64 + "b", "a" * 64 + "\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fingerprint.fingerprint(docs)
    assert len({r.root for r in got.collect()}) == len(texts)
    pairs = got.alias("a").join(got.alias("b"), F.expr("a.doc_id < b.doc_id"))
    like = pairs.select(fingerprint.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("x"), "a.doc_id", F.col("b.doc_id").alias("b")).collect()
    assert all(0 <= r.x <= 1 for r in like) and {(r.doc_id, r.b): r.x for r in like}[(0, 1)] < 1


def test_differing_sections(spark):
    parts = [f"part {k}\nmore of {k}\n\n" for k in range(6)]
    cases = {
        "same": (parts, parts), "inserted": (parts, [*parts[:2], "new\n\n", *parts[2:]]), "edited": (parts, [*parts[:3], "other\n\n", *parts[4:]]),
        "moved": (parts, [parts[1], parts[0], *parts[2:]]), "empty": ([], parts[:1]),
    }
    docs = spark.createDataFrame([(k, "".join(a), "".join(b)) for k, (a, b) in cases.items()], "k string, a string, b string")
    found = docs.select("k", fingerprint.differing_sections(fingerprint.tree(F.col("a")), fingerprint.tree(F.col("b"))).alias("d"))
    got = {r.k: (r.d.only_a, r.d.only_b) for r in found.collect()}
    assert got == {"same": ([], []), "inserted": ([], [2]), "edited": ([3], [3]), "moved": ([0, 1], [0, 1]), "empty": ([], [0])}


def test_endless_words(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghiü") for _ in range(20_000)), "a" * 20_000, "ab" * 5000]
    for w in words:
        assert b"".join(bpe.coder(bpe.default_path()).encode(w)) == b"".join(i.to_bytes(4, "little") for i in t.encode(w, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(1, "z" * 1_000_000)], "doc_id long, text string")
    assert bpe.op10(docs).first().n_tokens > 1000


def test_magics_inside_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n"
    rows = [(k, f"http://x/{k}", h) for k, h in enumerate(["plain", fake * 300, "WARC/1.0\r\n" * 500, None, fake + "é", "plain", "WARC/1.0\r\n", "a" + fake * 300])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.op6(pages).collect()}
    assert set(got) == set(range(8)) and all(got[k].payload_bytes == len((h or "").encode()) for k, _, h in rows)
    assert {k for k, r in got.items() if r.record_type == "revisit"} == {0} and got[0].refers_to == 5


def test_small_files(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html"))
    warc.write(pages, f"file://{tmp_path}/w", file_bytes=20_000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 30
    assert warc.read(spark, f"file://{tmp_path}/w", 400).filter("digest_ok").count() == 400


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    names = ("_doc", "_id", "_mark", "copy", "kept", "n_words", "_row", "_body", "lines", "numbers", "row", "sub", "doc", "_digest", "_same", "size", "taken", "key", "chunk", "z", "node")
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in names])


def test_clashing_names_are_carried(spark, clashing):
    names = clashing.columns
    want = {r.doc_id: r for r in clashing.collect()}
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    for op, left_out in ((quality.keep_good, ()), (lines.dedup_lines, ()), (mixing.draw, ("copy",)), (near.one_of_each, ())):
        rows, bare = op(clashing).collect(), op(plain).collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in bare)
        assert rows and all(r[c] == want[r.doc_id][c] for r in rows for c in names if c not in ("text", "doc_id", *left_out)), op
    for op in (substrings.op2, near.op5, sharding.op9, bpe.op10, quality.op7, lines.op3, mixing.op1, fingerprint.op8):
        assert sorted(map(str, op(clashing).collect())) == sorted(map(str, op(plain).collect())), op


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(rng.choice(vocabulary) for _ in range(60)) + " " + " ".join(base[:60])) for k in range(100)]
    got = {r.doc_id: r.class_id for r in near.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.near_classes(rows)
    linked = [d for d in want if list(want.values()).count(want[d]) > 1]
    assert len(linked) > 150
    caught = sum(got[d] == want[d] for d in linked) / len(linked)
    assert caught >= 0.9 and all(got[d] == d for d in want if list(want.values()).count(want[d]) == 1), caught


def test_lines_are_indexed_by_words_that_another_line_may_have(spark):
    rows = [(d, b"", 0, [w << 20 | d << 4 | w for w in range(8)] + [7, 11]) for d in range(1, 6)]  # eight own words, two in common
    sets = spark.createDataFrame(rows, "doc long, sub binary, line int, hashes array<long>")
    prefixes = lines._prefixes(sets, 0.1)  # ten words of ten
    assert {len(r.prefix) for r in prefixes.collect()} == {10}
    got = [(r.doc, r.pos) for r in lines._index(prefixes).collect()]
    assert sorted(got) == [(d, pos) for d in range(1, 6) for pos in (9, 10)]


def test_lines_are_ordered_by_their_rarer_words(spark):
    """Two words of 300 and 3 lines whose hashes agree in 17 bits are told apart, and numbers are sorted without nulls among them."""
    common, rare = 5, 5 + (1 << 17)
    rows = [(d, b"", 0, [common, *([rare] if d < 3 else []), -1 - (d << 3)]) for d in range(300)]
    sets = spark.createDataFrame(rows, "doc long, sub binary, line int, hashes array<long>")
    assert not lines._prefixes(sets, 0.1).schema["prefix"].dataType.containsNull
    got = {r.doc: r.prefix for r in lines._prefixes(sets, 0.1).collect()}
    assert all(list(p) == sorted(p) for p in got.values())
    assert [x >> 57 for x in got[0]] == [0, 3, 16] and [x >> 57 for x in got[9]] == [0, 16]  # 2 log2 of 1, 3 and 300 lines
    long = spark.range(64).select(F.floor(2 * F.log2(F.count("*"))).alias("c")).first().c
    assert long >= int(2 * math.log2(lines.LIST))  # so lists of LIST lines are not passed over


@pytest.mark.parametrize("n", [30, 70, 200])
def test_lines_of_all_parities(spark, n):
    """Near copies at the threshold, and just below it, of lines with one, two and four parities."""
    base = [f"w{k}" for k in range(n)]
    most = n // 9  # so many words may be others
    rows = [(1, " ".join(base)), (2, " ".join(base[most:] + [f"x{k}" for k in range(most)])), (3, " ".join(base[: n - most - 1] + [f"y{k}" for k in range(most + 1)])), (4, " ".join(base[: -(-4 * n // 5)]))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.lines_removed(rows) and got[2] == "" and got[3] and got[4] == ""


def test_lines_of_a_large_group(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for k in range(300):
        body = []
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            body.append(" ".join(w))
        rows.append((k, "\n".join(body)))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.lines_removed(rows)


def test_equal_rows_and_shared_ids(spark):
    docs = [(1, "a b c d e f\n\nsame line here now\n"), (1, "a b c d e f\n\nsame line here now\n"), (1, "other text of one id"), (None, None), (None, None), (None, "x"), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    for op in (substrings.op2, near.op5, sharding.op9, bpe.op10, quality.op7, lines.op3, mixing.op1, fingerprint.op8):
        rows = op(df).collect()
        assert len(rows) == len(docs), op
    same = [r for r in fingerprint.op8(df).collect() if r.doc_id == 1]
    assert len({r.fingerprint for r in same}) == 2


def test_pipeline_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(80)
    at = folder(spark, documents=docs)
    by_stage = docs
    for _, stage in corpus_pipeline.STAGES:
        by_stage = stage(spark, by_stage, at)
    assert sorted(map(str, corpus_pipeline.run(spark, at).collect())) == sorted(map(str, by_stage.collect()))


@pytest.fixture(scope="module")
def half_null_ids(spark):
    """Half of the ids null, a third of the rows of one id, all of distinct texts but for some repeated rows."""
    rng = random.Random(11)
    text = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 40))) + f" {k}"
    rows = [(None if k % 2 else 7 if k % 3 else k, text(k)) for k in range(400)]
    return spark.createDataFrame(rows + [rows[1]] * 5 + [rows[2]] * 3, "doc_id long, text string")


def test_shards_of_texts_without_ids(half_null_ids):
    got = sharding.op9(half_null_ids).collect()
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
    sizes = {}
    for r in half_null_ids.collect():
        sizes[r.text] = sizes.get(r.text, 0) + len(r.text) + 16
    assert len(load) == 40 and max(load.values()) <= sum(load.values()) / 40 + max(sizes.values())


def test_fingerprints_of_texts_without_ids(half_null_ids, spark):
    from tests.compare import assert_same

    at = folder(spark, documents=half_null_ids)
    assert_same(fingerprint.op8(half_null_ids), fingerprint.sql(f"read_parquet('{at}/documents.parquet/*.parquet')"))
    copies = spark.createDataFrame([(5, "one\ntwo")] * 5000 + [(None, "x")] * 9, "doc_id long, text string")
    got = {(r.doc_id, r.near_next): r["count"] for r in fingerprint.op8(copies).groupBy("doc_id", "near_next").count().collect()}
    assert got == {(5, 1.0): 4999, (5, 0.0): 1, (None, 1.0): 8, (None, 0.0): 1}


def test_mix_of_texts_without_ids(half_null_ids, spark):
    from tests.compare import assert_same

    docs = half_null_ids.withColumn("source", F.when(F.length("text") % 3 > 0, "web"))
    at = folder(spark, documents=docs)
    assert_same(mixing.op1(docs), mixing.sql(f"read_parquet('{at}/documents.parquet/*.parquet')"))
    taken = mixing.op1(docs).filter("doc_id IS NULL").agg(F.countDistinct(F.expr("taken / size")), F.sum("taken"), F.sum("size")).first()
    assert taken[0] > 1 and 1.2 < taken[1] / taken[2] < 1.8  # a draw for each text, not one for all of them


@pytest.mark.parametrize("share", [0.3, 0.73, 1.5])
def test_mix_of_equal_rows(spark, monkeypatch, share):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(None, "a b c", "web")] * 300 + [(None, None, "web")] * 50 + [(4, "d e", None)] * 40 + [(k, f"x y {k}", "book") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.mix(docs, F.size(F.split(F.coalesce("text", F.lit("")), " ")) * F.isnotnull("text").cast("int"), F.lit(1.0), F.md5(F.coalesce("text", F.lit(""))), share=share)
    per = {r.source: r for r in mixed.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert {s: r.n for s, r in per.items()} == {"web": 350, None: 40, "book": 30}
    assert all(abs(r.taken - r.target) <= 0.5 for r in per.values())
    drawn = mixing.draw(docs, share=share).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words")).collect()
    assert {r.source: r.words for r in drawn} == {s: r.taken for s, r in per.items()}


def test_windows_of_texts_without_ids(half_null_ids, spark):
    from tessella.llm.windows import Plan, chunk_of

    rows = [(r.doc_id, (r.text + " ") * 4) for r in half_null_ids.collect()]
    docs = spark.createDataFrame([*rows, *[(None, "z " * 60)] * 200, *[(7, "z " * 60)] * 200], "doc_id long, text string").repartition(8)
    got = substrings.op2(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.substrings([tuple(r) for r in docs.collect()])))
    dealt = docs.groupBy(chunk_of(Plan(32, 8), F.col("doc_id"), F.col("text"), F.spark_partition_id()).alias("chunk")).count().agg(F.max("count"), F.sum("count")).first()
    assert dealt[0] < dealt[1] / 3
