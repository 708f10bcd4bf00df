"""The numbered operators that SQL can express, against their SQL, on the given tables and on odd ones."""

from __future__ import annotations

import pytest

from tessella.llm import queries as llm
from tests.compare import SF_DIR, assert_same, folder

QUERIES, SQL = llm.queries(), llm.oracle_sql()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _text string"
PAGES = "page_id long, url string, html string, payload string, sha string"


def odd_documents(spark):
    """Null, empty, blank, long, repeated and tied texts; null columns; columns that clash with names used inside."""
    words = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [
        "", " \t\n\n", "one", "a b c d e f g h " * 6, "line one is here\nline one is here\n\nother line",
        "Ünïcödé 你好 \U0001f600 naïve word end", words, words, "x" * 5000, "the of and to " * 10 + "#*$%&|<> !!!",
        "same text again", "same text again", None, "nul \x00 byte", "tab\tsep\x0bvt\x0cff\rcr\nlf",
    ]
    rows = [(i, t, "en", [None, "a", "b", "a"][i % 4], None if t is None else len(t), True, "clash") for i, t in enumerate(texts)]
    rows.append((99, "the last of the texts", None, None, None, None, None))
    return spark.createDataFrame(rows, DOCS)


def odd_pages(spark):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [
        (1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "u", magic), (6, "u", "pre " + magic + magic + " post"),
        (7, "u", "WARC/1.0\r\n"), (8, "u", "WARC/1.0\r\n" * 50), (9, "u", "ünï 你好 \U0001f600" * 100), (10, "u", "\r\n\r\n" * 3), (11, "u", "x" * 300_000), (12, "u", magic),
        (13, "u", "ends in magic WARC/1.0\r\n"), (14, "u", "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def odd_embeddings(spark):
    """Null vectors and entries, entries that are no numbers, repeated rows and vectors, a null id, columns that clash."""
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [4.0, -1.0, 0.5], [0.0, 0.0, 7.0], None, [None, 1.0, 1.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [-2.0, 5.0, 1.0], [1.001, 2.0, 3.0]]
    rows = [(k, v, 0, 5, "x") for k, v in enumerate(vectors)] + [(None, [9.0, 9.0, -9.0], None, None, None), (2, [4.0, -1.0, 0.5], 0, 5, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, x string")


@pytest.mark.parametrize("name", sorted(SQL))
def test_given_tables(spark, name):
    assert assert_same(QUERIES[name](spark, SF_DIR), SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_odd_tables(spark, name):
    at = folder(spark, documents=odd_documents(spark), pages=odd_pages(spark))
    sql = SQL[name]
    for t in ("documents", "pages"):
        sql = sql.replace(f"from {t}", f"from read_parquet('{at}/{t}.parquet/*.parquet')")
    assert_same(QUERIES[name](spark, at), sql)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name):
    at = folder(spark, documents=odd_documents(spark).limit(0), pages=odd_pages(spark).limit(0), embeddings=odd_embeddings(spark).limit(0))
    assert QUERIES[name](spark, at).count() == 0
