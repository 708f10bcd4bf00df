"""What spans lines in source texts, graphs with written frontiers, and folds over long groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import pieces
from tessella.functions import text as T
from tessella.sources import files
from tessella.operators import code, compare, graph, joins, packing, reconcile, versions

SCRIPT = "let a = 'x // y'; // gone {\n/* { fetch(1)\n */ let b = \"/* no */\";\nfunction f() {\n  if (g('}')) { h(); }\n}\nfunction open() {\n"
PYTHON = 'x = "# no"  # gone\ndef outer():\n    """text # stays"""\n    def inner():\n        return call(1)\n\n    return inner()\n\ny = 2\n'


def table(spark):
    rows = [("a.js", "javascript", SCRIPT), ("b.py", "python", PYTHON), ("c.js", "javascript", None), ("d.js", "javascript", ""), ("e.js", "javascript", "a /* open\n b(")]
    return spark.createDataFrame(rows, "path string, language string, text string")


def test_comments_are_blanked_in_place(spark):
    got = {r.path: r.text for r in code.uncommented(table(spark)).collect()}
    assert got["c.js"] is None and got["d.js"] == ""
    assert [len(x) for x in got["a.js"].split("\n")] == [len(x) for x in SCRIPT.split("\n")]
    assert "gone" not in got["a.js"] and "fetch" not in got["a.js"] and "'x // y'" in got["a.js"] and '"/* no */"' in got["a.js"]
    assert "gone" not in got["b.py"] and '"# no"' in got["b.py"] and "text # stays" in got["b.py"]
    assert got["e.js"] == "a        \n   "


def test_symbols_end_with_their_block(spark):
    got = {(r.file, r.name): (r.line, r.end) for r in code.symbols(table(spark)).collect()}
    assert got[("a.js", "f")] == (4, 6) and got[("a.js", "open")] == (7, 8)
    assert got[("b.py", "outer")] == (2, 8) and got[("b.py", "inner")] == (4, 6)


def test_calls_belong_to_the_innermost_symbol(spark):
    got = {(r.file, r.symbol, r.name, r.line) for r in code.calls(table(spark)).collect()}
    assert got == {("a.js", "f", "g", 5), ("a.js", "f", "h", 5), ("b.py", "inner", "call", 5), ("b.py", "outer", "inner", 7)}


def test_columns_of_odd_tables(spark):
    ddl = "create table \"t\" (a int default (f(1, 2)), b text /* , c int */ unique, primary key (a, b),\n constraint k foreign key (b) references u(x)); create table e ();"
    files = spark.createDataFrame([("x.sql", "sql", ddl), ("y.sql", "sql", None)], "path string, language string, text string")
    got = {(r.entity, r.field): (r.type, r.is_unique, r.is_key, r.refers_to, r.refers_field) for r in code.table_columns(files).collect()}
    assert got == {("t", "a"): ("int", False, True, None, None), ("t", "b"): ("text", True, True, "u", "x")}


def test_imported_names(spark):
    rows = [
        ("w/a.js", "javascript", "import D, { p as q, r } from '../lib/m';\nconst { s: t } = require('./n.js');\nimport x from 'far';\n// import no from './n.js'\n"),
        ("w/n.js", "javascript", ""), ("lib/m/index.js", "javascript", ""), ("k/b.py", "python", "from k.c import d as e, f\n"), ("k/c.py", "python", ""),
    ]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    got = {(r.file, r.local, r.target, r.imported) for r in code.bindings(files).collect()}
    assert got == {
        ("w/a.js", "D", "lib/m/index.js", "default"), ("w/a.js", "q", "lib/m/index.js", "p"), ("w/a.js", "r", "lib/m/index.js", "r"), ("w/a.js", "t", "w/n.js", "s"),
        ("w/a.js", "x", None, "default"), ("k/b.py", "e", "k/c.py", "d"), ("k/b.py", "f", "k/c.py", "f"),
    }


def test_a_search_plans_one_scan_a_step(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graph.reach(edges, spark.createDataFrame([(0,)], "start long"), 8)
    assert {(r.node, r.depth) for r in found.collect()} == {(k, k) for k in range(1, 9)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 9
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert {(r.node, r.depth) for r in graph.reach(ring, spark.createDataFrame([(1,)], "start long"), 50).collect()} == {(2, 1), (3, 2)}


def test_batches_of_a_long_group(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).alias("size")).unionByName(spark.createDataFrame([(None, -1, None), ("h", 5, 99)], "g string, id long, size long"))
    got = packing.batches(rows, ["g"], ["id"], "id", "size", 50, 10)
    by = {r.g: (r.n, r.last) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.max("batch").alias("last")).collect()}
    assert by[None] == (1, 1) and by["h"] == (1, 1) and by["g"] == (n, n // 10)
    assert got.filter("g = 'g'").groupBy("batch").agg(F.sum("size").alias("s"), F.count("*").alias("n")).filter("s > 50 OR n > 10").isEmpty()


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 5, 1), (2, 50, 1), (3, 6, 9), (4, 4, 2), (5, 1, 1)], "id long, size long, lines long").withColumn("g", F.lit(1))
    got = {r.id: r.reason for r in packing.budgeted(rows, ["g"], ["id"], "id", "size", 10, 9, 20, "lines", 3).collect()}
    assert got == {1: None, 2: "too_large", 3: "no_size", 4: None, 5: "no_lines"}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    many = one(T.numbered(F.lit("\n" * 10_000))).split("\n")
    assert many[0] == "   1| " and many[9_999] == "10000| " and many[10_000] == "10001| "
    assert one(T.readable_route(F.lit(r"^books/(?P<pk>\d+)/([a-z]+)/$"))) == "books/:pk/:param/"
    assert one(T.replace_once(F.lit("a.b.c"), F.lit("b"), F.lit("x"))) == "a.x.c" and one(T.replace_once(F.lit("aa"), F.lit("a"), F.lit("x"))) is None
    assert one(T.offline_wait(F.lit(10000.0))) == 15000.0 and one(T.offline_wait(F.lit(29000.0))) == 30000.0
    assert one(T.find_json(F.lit("see\n```json\n{\"a\": 1}\n```\nend"))) == ['{"a": 1}\n']


def lcs(a, b) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_line_diffs_are_shortest(spark):
    rng = random.Random(4)
    rows = [("\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12))), "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for _ in range(60)]
    rows += [(None, "x\ny"), ("x", None), ("", ""), ("a\nb", "a\nb")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", pieces.line_diff(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        a, b = ([] if x is None else x.split("\n") for x in (r.a, r.b))
        assert [x[1:] for x in r.d if x[0] != "+"] == a and [x[1:] for x in r.d if x[0] != "-"] == b
        assert sum(x[0] == " " for x in r.d) == lcs(a, b)


def plain_walk(a, b) -> list[str]:
    """A diff from the whole table, removals first where two ways are as long."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out, i, j = [*out, " " + a[i]], i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out, i = [*out, "-" + a[i]], i + 1
        else:
            out, j = [*out, "+" + b[j]], j + 1
    return out


def plain_hunks(diff: list[str], context: int) -> list[tuple]:
    changes = [k for k, x in enumerate(diff) if x[0] != " "]
    groups: list[list[int]] = []
    for k in changes:
        if groups and k - groups[-1][-1] <= context + 1:
            groups[-1].append(k)
        else:
            groups.append([k])
    out = []
    for n, g in enumerate(groups, 1):
        low, high = max(0, g[0] - context), min(len(diff), g[-1] + context + 1)
        at = [1 + sum(x[0] != other for x in diff[:low]) for other in "+-"]
        size = [sum(x[0] != other for x in diff[low:high]) for other in "+-"]
        out.append((n, f"@@ -{at[0]},{size[0]} +{at[1]},{size[1]} @@", "\n".join(diff[low:high])))
    return out


@pytest.mark.parametrize("letters", [2, 4, 30])
def test_diffs_and_hunks_against_the_whole_table(spark, letters):
    rng = random.Random(letters)
    line = lambda: str(rng.randrange(letters))
    rows = []
    for k in range(60):
        a = [line() for _ in range(rng.randint(1, 70))]
        b = [x for x in a if rng.random() > 0.1] + [line()] if k % 2 else [line() for _ in range(rng.randint(1, 70))]
        rows.append((k, "\n".join(a), "\n".join(b)))
    rows += [(100, None, "x\ny"), (101, "x", None), (102, "", ""), (103, None, None), (104, "a\nb", "a\nb")]
    diffs = spark.createDataFrame(rows, "k long, a string, b string").select("k", "a", "b", pieces.line_diff(F.col("a"), F.col("b")).alias("diff"))
    want = {k: plain_walk(*([] if x is None else x.split("\n") for x in (a, b))) for k, a, b in rows}
    assert {r.k: r["diff"] for r in diffs.collect()} == want
    for context in (3, 1, 0):
        got = sorted((r.k, r.hunk, r.head, r.body) for r in compare.hunks(diffs, "k", context=context).collect())
        assert got == [(k, *h) for k, d in sorted(want.items()) for h in plain_hunks(d, context)]


def test_diffs_of_rarely_repeated_lines_take_no_rows_of_bits(monkeypatch):
    rng = random.Random(9)
    for most in (0, 1 << 60):  # always by bits, always by pairs
        monkeypatch.setattr(pieces, "PAIRS", most)
        for n in range(400):
            letters = rng.choice((2, 5, 40))
            a, b = ([str(rng.randrange(letters)) for _ in range(rng.randrange(30))] for _ in range(2))
            b = b if n % 2 else [x for x in a if rng.random() > 0.2] + b[:2]
            runs = pieces._diff(a, b)
            found = [" -+"[k] + x for k, at, size in zip(runs[::3], runs[1::3], runs[2::3]) for x in (b if k == 2 else a)[at : at + size]]
            assert found == plain_walk(a, b)
    monkeypatch.undo()
    monkeypatch.setattr(pieces, "_Longest", None)
    old = [f"line {k}" for k in range(100_000)]
    new = [x for k, x in enumerate(old) if k % 7] + ["new"]
    runs = pieces._diff(old, new)
    assert sum(runs[k + 2] for k in range(0, len(runs), 3) if runs[k] == 0) == len(new) - 1 and runs[-3:] == [2, len(new) - 1, 1]


def test_diff_of_long_texts(spark):
    """5,000 by 5,000 lines, of few and of many different lines: both are compared, none given up."""
    rng = random.Random(6)
    for letters in (50, 100_000):
        a = [f"line {rng.randrange(letters)}" for _ in range(5000)]
        b = [x for x in a if rng.random() > 0.05]
        for _ in range(200):
            b.insert(rng.randrange(len(b)), f"other {rng.random()}")
        b += a[:5000 - len(b)]
        runs = pieces._diff(a, b)
        d = [" -+"[kind] + line for kind, at, n in zip(*(runs[k::3] for k in range(3))) for line in (b if kind == 2 else a)[at : at + n]]
        assert [x[1:] for x in d if x[0] != "+"] == a and [x[1:] for x in d if x[0] != "-"] == b
        row = np.zeros(len(b) + 1, dtype=np.int64)
        numbers = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
        bs = np.array([numbers[x] for x in b])
        for x in a:
            row[1:] = np.maximum.accumulate(np.where(bs == numbers[x], row[:-1] + 1, row[1:]))
        assert sum(x[0] == " " for x in d) == row[-1]


def test_texts_are_cut_between_lines(spark):
    rows = [
        ("aa\nb\ncc", ["aa\nb\n", "cc"]), ("abcdefgh\nx", ["abcde", "fgh\nx"]), ("short", ["short"]), (None, None), ("", [""]), ("a\n" * 6, ["a\na\n", "a\na\n", "a\na\n"]),
        ("\n\nabcdef\n\n\nxyz", ["\n\n", "abcde", "f\n\n\n", "xyz"]), ("\n" * 7, ["\n" * 5, "\n" * 2]), ("x\n" + "y" * 12, ["x\n", "yyyyy", "yyyyy", "yy"]),
    ]
    assert all(b is None or "".join(b) == a for a, b in rows)
    docs = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r.p for r in docs.select(pieces.split_text(F.col("t"), 5).alias("p")).collect()] == [b for _, b in rows]


def test_reading_order_takes_the_longest_entry(spark):
    files = spark.createDataFrame([("add/a/x.py", "PARTIAL"), ("add/base/y.py", None), ("add/base/__manifest__.py", "PARTIAL"), ("core/z.py", "NOT_ANALYZED"), ("core/b.py", "OUTDATED")], "path string, status string")
    got = [r.path for r in joins.reading_order(files, ["add/base"], ["add"]).orderBy("place").collect()]
    assert got == ["add/base/__manifest__.py", "add/base/y.py", "core/z.py", "core/b.py", "add/a/x.py"]


def test_objects_outside_strings(spark):
    rows = [
        (r'{"s": "}\"x{"}', [r'{"s": "}\"x{"}']), ('{ open, then {"a": {"b": 1}} and {"c": 2}', ['{"a": {"b": 1}}', '{"c": 2}']),
        ('} {"a": "\\\\"} {}', ['{"a": "\\\\"}', "{}"]), ("none", []), (None, []),
    ]
    docs = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r.o for r in docs.select(pieces.json_objects(F.col("t")).alias("o")).collect()] == [b for _, b in rows]


def test_routes_that_differ_in_parameters_only(spark):
    routes = ["/a/:id/", "/A/{id}", "/a/<int:id>", "/a/[id]", "/a/*rest", "/file.{ext}/", "/file.:ext", "/"]
    got = [r.p for r in spark.createDataFrame([(r,) for r in routes], "r string").select(T.comparison_path(F.col("r")).alias("p")).collect()]
    assert got == ["/a/:p"] * 5 + ["/file.:p"] * 2 + ["/"]


def test_declared_names_may_be_in_lower_case(spark):
    rows = [(".env", "db_url=x\nexport _TOKEN = y\n# no=z\nPORT=1")]
    got = files.environment_names(spark.createDataFrame(rows, "path string, text string"))
    assert sorted(r.name for r in got.collect()) == ["PORT", "_TOKEN", "db_url"]
