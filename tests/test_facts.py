"""Source trees, line rules and message streams on small inputs."""

from __future__ import annotations

import re
import tempfile
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from tessella.operators import extract
from tessella.plans import facts
from tessella.sources import files
from tests.compare import SF_DIR

TREE = {
    "web/cart.js": "import { get } from './http';\n// fetch('/never')\nexport async function total(x) {\n  await fetch('/api/cart', {method: 'POST'});\n  return process.env.CART_URL;\n}\n",
    "api/app.py": "from flask import Flask\nimport os\n@app.get('/items')\ndef items():\n    return Item.objects.filter(key=os.getenv('ITEM_KEY'))\nclass Item(Base):\n    pass\n",
    "db/schema.sql": "CREATE TABLE orders (id int);\nCREATE TABLE lines (order_id int REFERENCES orders(id));\n-- DROP\nSELECT * FROM lines;\n",
    "package.json": '{"dependencies": {"left": "^1.0"}, "devDependencies": {"right": "2"}}',
    "requirements.txt": "flask==2.0\n# no\nnumpy>=1\n",
    ".env": "SECRET_ONE=abc\nexport SECRET_TWO=def\n",
    "node_modules/x/y.js": "function hidden() {}\n",
}


def tree() -> str:
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "logo.png").write_bytes(b"\x89PNG\x00\x01")
    return str(root)


def test_scan(spark):
    got = {r.path: r for r in files.scan(spark, tree(), ["node_modules"]).collect()}
    assert set(got) == {*TREE, "logo.png"} - {"node_modules/x/y.js", ".env"}  # hidden files are not listed
    assert got["logo.png"].is_binary and got["logo.png"].text is None and got["logo.png"].hash is None
    assert got["web/cart.js"].text == TREE["web/cart.js"] and got["web/cart.js"].bytes == len(TREE["web/cart.js"])


def test_names_and_packages(spark):
    found = files.scan(spark, tree())
    hidden = spark.createDataFrame([(".env", TREE[".env"])], "path string, text string")
    names = {r.name: r.paths for r in files.environment_names(found.select("path", "text").union(hidden)).collect()}
    assert names == {"CART_URL": ["web/cart.js"], "ITEM_KEY": ["api/app.py"], "SECRET_ONE": [".env"], "SECRET_TWO": [".env"]}
    got = {(r.name, r.version, r.dev) for r in files.packages(found).collect()}
    assert got == {("left", "^1.0", False), ("right", "2", True), ("flask", "==2.0", False), ("numpy", ">=1", False)}


def test_facts(spark):
    found = files.scan(spark, tree(), ["node_modules"])
    got = {(r.path, r.line, r.kind, r.name, r.detail) for r in extract.facts(found).collect()}
    for want in (
        ("web/cart.js", 1, "import", "./http", ""), ("web/cart.js", 3, "function", "total", ""), ("web/cart.js", 4, "client_call", "/api/cart", "POST"),
        ("api/app.py", 1, "import", "flask", "Flask"), ("api/app.py", 3, "route", "get", "/items"), ("api/app.py", 4, "function", "items", ""), ("api/app.py", 5, "orm_read", "Item", "filter"),
        ("api/app.py", 6, "class", "Item", "Base"), ("db/schema.sql", 1, "table", "orders", ""), ("db/schema.sql", 2, "foreign_key", "orders", "id"), ("db/schema.sql", 4, "select", "lines", ""),
    ):
        assert want in got
    assert not any(n == "/never" for _, _, _, n, _ in got)


def test_every_match_of_a_line(spark):
    rows = [
        (1, "html", '<!-- x --><a href="/1">1</a><a class="b" href="http://x.org/2">2</a><script src="s.js"></script><script src="t.js"></script>\n<!-- <a href="/no"> -->'),
        (2, "html", '* <a href="/3">3</a> # <a href="/3">3</a><form action="/f"><form action="">'),
        (3, "javascript", "/* a */ fetch('/b'); fetch('/c', {method: 'PUT'})\n// fetch('/no')\n/* fetch('/no')\n*/ A.find(1) + B.find(2)\n#p = fetch('/d')"),
        (4, "html", None),
    ]
    files = spark.createDataFrame(rows, "path long, language string, text string")
    got = sorted((r.path, r.line, r.kind, r.name, r.detail) for r in extract.facts(files, extract.PAGES + extract.CLIENT_CALLS + extract.DATABASE).collect())
    assert got == sorted([
        (1, 1, "link", "/1", ""), (1, 1, "link", "http://x.org/2", ""), (1, 1, "service_host", "x.org", ""), (1, 1, "script", "s.js", ""), (1, 1, "script", "t.js", ""),
        (2, 1, "link", "/3", ""), (2, 1, "link", "/3", ""), (2, 1, "form", "/f", ""), (2, 1, "form", "", ""),
        (3, 1, "client_call", "/b", ""), (3, 1, "client_call", "/c", "PUT"), (3, 4, "orm_read", "A", "find"), (3, 4, "orm_read", "B", "find"), (3, 5, "client_call", "/d", ""),
    ])


def test_page_facts_are_whole(spark):
    got = sorted((r.page_id, r.line, r.kind, r.name) for r in facts.x22_page_facts(spark, SF_DIR).collect())
    want = []
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        for k, line in enumerate(r.html.split("\n"), 1):
            line = re.sub(r"^(?:\s*<!--.*?-->)+", "", line)
            if not re.match(r"\s*<!--", line):
                want += [(r.page_id, k, rule.kind, m.group(1)) for rule in extract.PAGES for m in re.finditer(rule.pattern, line)]
    assert got == sorted(want) and len({g[:3] for g in got}) < len(got)


def test_stored_tables(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    files.save_snapshot({"a": spark.range(3)}, root, "v1")
    assert files.load_table(spark, root, "v1", "a", "id long").count() == 3
    assert files.load_table(spark, root, "v1", "b", "id long").count() == 0


def test_rate_limit(spark):
    got = {r.event_id: r.allowed for r in facts.st9_rate_limit(spark, SF_DIR).collect()}
    users = defaultdict(list)
    for r in spark.read.parquet(f"{SF_DIR}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).collect():
        users[r.user_id].append((r.at, r.event_id))
    want = {}
    for rows in users.values():
        tokens, last = 2.0, None
        for at, e in sorted(rows):
            tokens = tokens if last is None else min(2.0, tokens + (at - last) / 1e6 / 86400)
            want[e], last = tokens >= 1, at
            tokens -= want[e]
    assert got == want and len(set(want.values())) == 2
