"""Licences, phrases and whitening against plain forms and exact arithmetic."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import licences, phrases, whitening
from tests.compare import SF_DIR, folder
from tests.llm.test_oracle import odd_embeddings

DOCS = "doc_id long, text string, lang string, n long, words string"


def plain_phrases(docs: list[tuple[str | None, str | None]], least: int, top: int) -> list[tuple]:
    import re

    total, f = Counter(), Counter()
    low = {c: c + 32 for c in range(65, 91)}
    for lang, text in docs:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {(lang, p[i:j]) for (lang, p), a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[lang, p[i:j]] <= a}
    out = []
    for lang in total:
        rows = []
        for (of, p), a in candidates.items():
            if of == lang and (lang, p) not in gone:
                score, _, left, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, k + 1, p.decode(), -a, left, r, total[lang], -s) for k, (s, a, p, left, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(docs, least: int, top: int) -> list[tuple]:
    return sorted(map(tuple, phrases.mine_phrases(docs, least, top).collect()))


@pytest.fixture
def small_shards(monkeypatch):
    """Shards of 2 kB and groups of 3 pairs. Workers take a function's module with its values only if it is sent whole."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(phrases)
    monkeypatch.setattr(phrases, "SHARD", 2000)
    monkeypatch.setattr(phrases, "SLICE", 300)
    monkeypatch.setattr(phrases, "GROUP", 40)
    yield
    cloudpickle.unregister_pickle_by_value(phrases)


@pytest.mark.parametrize("least,top", [(2, 10_000), (5, 40)])
def test_phrases_of_shards(spark, small_shards, least, top):
    rng = random.Random(7)
    words = ["the", "The", "of", "a", "ünï", "你好", "x\x00y", " ", "rare", "\x1cq"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b!"]) for _ in range(n))
    rows = [(k, text(rng.choice([0, 3, 40, 400])), rng.choice(["en", "de", None, "und"]), 1, "clash") for k in range(60)]
    rows += [(1, "the of a the of a the of a", "en", None, None)] * 70 + [(None, None, None, None, None), (9, "", "fr", 1, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = plain_phrases([(r[2], r[1]) for r in rows], least, top)
    assert mined(docs, least, top) == want
    assert len(want) > 50


def test_phrases_of_given_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = plain_phrases([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 10, 2000)
    assert mined(docs, 10, 2000) == want


def test_bitmaps_move_over_blocks(spark):
    text = np.array(([1, 2, 3] * 100 + [0] + [1, 2] * 70), dtype=np.int64)
    pairs = np.array([0 * 3 + 1, 1 * 3 + 2, 2 * 3 + 0])
    found = {}
    for w, n in phrases.Extension(text, 3, pairs).phrases(5):
        found |= {tuple(int(x) for x in w[:, k]): int(n[k]) for k in range(len(n))}
    want = Counter(tuple(int(x) - 1 for x in text[i : i + k]) for k in (3, 4, 5) for i in range(len(text) - k + 1))
    assert found == {p: n for p, n in want.items() if -1 not in p and all(a * 3 + b in pairs for a, b in zip(p, p[1:]))}


def test_licences_in_edited_notices(spark):
    texts = {
        "exact": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction",
        "edited": "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation (the 'Software'), to deal in the Software without restriction",
        "no key phrase": "Permission is hereby granted, for money, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction",
        "scattered": "software hereby copy person granted charge restriction obtaining documentation permission associated free files deal without",
        "two": "Licensed under the Apache License, Version 2.0.\n" + "word " * 3000 + "licensed under CC BY-SA 4.0",
        "name only": "ask about the MIT license",
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = dict(zip(texts, sorted(licences.op11(docs).collect(), key=lambda r: r.doc_id), strict=True))
    assert {k: r.labels for k, r in got.items()} == {"exact": "mit", "edited": "mit", "no key phrase": "", "scattered": "", "two": "apache,apache-2.0,cc-by,cc-by-sa-4.0", "name only": "mit"}
    assert got["exact"].score == 1 > got["edited"].score > 0.75 and got["name only"].score == 0.5 and got["scattered"].score == 0
    assert got["two"].n_base == 2 and got["two"].first_word == 3 and got["two"].last_word == 3010


def test_licences_follow_the_rarity_of_the_corpus(spark):
    rows = [(k, "permission is hereby granted software copy person charge free") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = licences.document_counts(docs)
    assert counts[b"hereby"] == 50 and b"warranty" not in counts
    index = licences.Index(counts)
    k = next(k for k, t in enumerate(licences.templates()) if t.words[0] == b"permission" and t.label == "mit")
    assert b"hereby" not in index.rarest[k][: licences.RARE]


def exact_fit(vectors: list[list[float]]) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(n, sums, covariance in rounded exact arithmetic, distinct vectors)."""
    x = [tuple(int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v) for v in vectors]
    distinct = sorted(set(x))
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[k] for v in distinct) for k in range(d)]
    gap = [[n * v[k] - sums[k] for k in range(d)] for v in distinct]
    cov = np.array([[float(Fraction(sum(g[i] * g[j] for g in gap), n**3)) for j in range(d)] for i in range(d)])
    return n, sums, cov, np.array(distinct, dtype=np.int64)


def test_whitening_of_odd_vectors(spark):
    table = odd_embeddings(spark)
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    n, sums, cov, _ = exact_fit([v for _, v in rows])
    got = whitening.op13(table).collect()
    assert len(got) == 3 * len(rows) and {r.n for r in got} == {n}
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-12
    want = Counter((i, sum((n * (int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000) - s) ** 2 for c, s in zip(v, sums))) for i, v in rows)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want


def test_whitening_of_given_table(spark):
    at = f"{SF_DIR}/embeddings.parquet"
    table = spark.read.parquet(at).select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    n, sums, cov, _ = exact_fit([v for _, v in rows])
    found = whitening.whiten(table.repartition(5)).collect()
    got = {(r.vec_id, r.component): r.whitened for r in found}
    assert len(got) == 16 * len(rows)
    long = cov.astype(np.longdouble)
    values, vectors = np.linalg.eigh(cov)
    for k in range(16):
        v, e = vectors[:, -1 - k].astype(np.longdouble), np.longdouble(values[-1 - k])
        for _ in range(3):  # one vector, refined by inverse iteration
            y = np.linalg.solve((long - e * np.eye(len(cov))).astype(float) + 1e-13 * np.eye(len(cov)), v.astype(float))
            v = y / np.linalg.norm(y)
        x = np.array([[Fraction(int(np.floor(np.float64(c) * 64)) + 1_000_000) - Fraction(int(s), n) for c, s in zip(u, sums)] for _, u in rows], dtype=object).astype(float)
        want = x @ v.astype(float) / np.sqrt(float(e))
        mine = np.array([got[i, k + 1] for i, _ in rows])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


def test_outer_sums_are_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 40), 1 << 40, (3000, 4))
    low = rng.uniform(-(2.0**-14), 2.0**-14, (3000, 4))
    high, error = whitening.outer_sums(x.astype(float), low)
    for i in range(4):
        for j in range(4):
            want = sum((Fraction(int(a[i])) + Fraction(float(b[i]))) * (Fraction(int(a[j])) + Fraction(float(b[j]))) for a, b in zip(x, low))
            assert abs(Fraction(float(high[i, j])) + Fraction(float(error[i, j])) - want) <= abs(want) * Fraction(1, 1 << 85)


def test_eigenvectors_of_close_values():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    for values in ([5, 5 - 1e-7, 3, 3, 3, 2, 1, 1, 0.5, 1e-3, 1e-9, 0], [1.0] * 12, list(range(12, 0, -1))):
        a = q.astype(np.longdouble) @ np.diag(np.array(values, dtype=np.longdouble)) @ q.T.astype(np.longdouble)
        high = a.astype(float)
        e, v = whitening.eigen(high, (a - high).astype(float))
        assert np.abs(e - values).max() < 1e-15 * 12 and np.abs(v.T @ v - np.eye(12)).max() < 1e-14
        assert np.abs(a @ v - v * e).max() < 1e-14


@pytest.mark.parametrize("apart", [1e-15, 1e-14, 1e-13, 1e-12])
def test_eigenvectors_of_runs_of_close_values(apart):
    values = 1 + np.arange(11, -1, -1) * np.longdouble(apart)
    for seed in range(20):
        q = whitening._orthonormal(np.linalg.qr(np.random.default_rng(seed).normal(size=(12, 12)))[0].astype(np.longdouble))
        a = q @ np.diag(values) @ q.T
        high = a.astype(float)
        e, v = whitening.eigen(high, (a - high).astype(float))
        assert np.abs(v.T @ v - np.eye(12)).max() < 1e-14 and np.abs(a @ v - v * e).max() < 1e-14
        assert np.abs(np.abs(q.T @ v) - np.eye(12)).max() < 1e-18 / apart + 1e-6  # what extended precision can tell


def test_whitening_without_variance_or_of_unlike_lengths(spark):
    one = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<float>")
    assert whitening.op13(one).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitening.op13(line).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    with pytest.raises(ValueError, match="one length"):
        whitening.op13(one.union(line))


def test_whitening_of_far_entries(spark):
    rows = [(k, [1e30 if k % 2 else -1e30, 1e12 + k, 0.25 * k]) for k in range(8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.op13(table).collect()
    assert got and {r.deviation for r in got} == {None}
    near = spark.createDataFrame([(k, [3e7 * k, 1.0 * k * k]) for k in range(20)], "vec_id long, embedding array<double>")
    n, sums, _, _ = exact_fit([[3e7 * k, 1.0 * k * k] for k in range(20)])
    want = {k: (n * (int(64 * 3e7 * k) + 1_000_000) - sums[0]) ** 2 + (n * (64 * k * k + 1_000_000) - sums[1]) ** 2 for k in range(20)}
    assert {r.vec_id: r.deviation for r in whitening.op13(near).collect()} == {k: v if v < 1 << 63 else None for k, v in want.items()}


def test_queries_take_clashing_columns(spark):
    at = folder(spark, embeddings=odd_embeddings(spark).withColumns({c: F.lit("clash") for c in ("row", "salt", "high", "low", "_c", "component")}))
    from tessella.llm import queries

    assert queries.op13_whitening(spark, at).count() > 0
