"""A small bookshop in three languages, and queries over it whose rows are worked out by hand.

The supplied tables hold no source code, so what reads code is checked on these files: a script front end, a script server
and a Python service that share one domain. Each has a trap, such as a call in a comment or a name in a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as T
from tessella.operators import code as C
from tessella.operators import compare as Cmp
from tessella.operators import extract, graph
from tessella.operators import joins as J
from tessella.operators import models as M
from tessella.operators import verify as V
from tessella.sources import files as S

FILES = (
    ("web/src/components/BasketView.jsx", """import { useState } from 'react';
import { sendBasket } from '../services/basketService';

export default function BasketView() {
  const [books, setBooks] = useState([]);
  const submit = async () => {
    await sendBasket(books);
    setBooks([]);
  };
  return <button onClick={submit}>Buy</button>;
}
"""),
    ("web/src/services/basketService.js", """/* fetch('/api/old-baskets') was here
   until the server changed */
export async function sendBasket(books) {
  // fetch('/api/unused')
  const note = 'not a // comment';
  return fetch('/api/baskets', { method: 'POST', body: JSON.stringify({ books, note }) });
}
"""),
    ("server/routes/basketRoutes.js", """const express = require('express');
const { addBasket, listBaskets } = require('../controllers/basketController');
const router = express.Router();
router.get('/baskets', listBaskets);
router.post('/baskets', requireReader, addBasket);
module.exports = router;
"""),
    ("server/app.js", """const express = require('express');
const basketRoutes = require('./routes/basketRoutes');
const app = express();
app.use('/api', basketRoutes);
app.listen(process.env.PORT);
"""),
    ("server/controllers/basketController.js", """const store = require('../services/basketStore');
async function addBasket(req, res) {
  const saved = await saveBasket(req.body);
  res.json(saved);
}
async function listBaskets(req, res) {
  res.json(await Basket.find({ open: true }));
}
"""),
    ("server/services/basketStore.js", """async function saveBasket(body) {
  const total = sumPrices(body.books);
  return Basket.create({ books: body.books, total });
}
function sumPrices(books) {
  return books.reduce((a, b) => a + b.price, 0);
}
"""),
    ("server/db/schema.sql", """CREATE TABLE readers (
  id INTEGER PRIMARY KEY,
  email VARCHAR(200) NOT NULL UNIQUE
);
-- CREATE TABLE ghosts (id INTEGER);
CREATE TABLE IF NOT EXISTS baskets (
  id INTEGER PRIMARY KEY,
  reader_id INTEGER NOT NULL REFERENCES readers(id),
  total DECIMAL(10,2),
  FOREIGN KEY (reader_id) REFERENCES readers (id)
);
"""),
    ("stock/models.py", """from django.db import models


class Shelf(models.Model):
    room = models.CharField(max_length=20)


class Book(models.Model):
    title = models.CharField(max_length=80, unique=True)
    pages = models.IntegerField(null=True)
    shelf = models.ForeignKey(Shelf, on_delete=models.CASCADE)
    # ghost = models.TextField()
"""),
    ("stock/views.py", """import os
from stock.models import Book


def count_books(request):
    return Book.objects.filter(pages=None).count()


TOKEN = os.environ.get("STOCK_TOKEN")
"""),
    ("stock/test_views.py", """from stock.views import count_books


def test_count():
    assert count_books(None) == 0
"""),
    ("package.json", """{"dependencies": {"express": "4.1.0"}, "devDependencies": {"vitest": "1.0.0"}}
"""),
    (".env.example", """STOCK_TOKEN=
"""),
    (".github/workflows/test.yml", """on: push
"""),
)


#: The stock's models once more, as other languages declare them.
DIALECTS = (
    ("jvm/Book.java", """import jakarta.persistence.*;
@Entity
public class Book {
  @NotBlank
  @Column(unique = true)
  private String title;
  private Integer pages;
  @ManyToOne
  private Shelf shelf;
}
@Entity
class Shelf {
  @Size(max = 20) // @NotNull
  private String room;
}
class Helper {
  private String none;
}
"""),
    ("net/Book.cs", """public class ShopContext : DbContext {
  public DbSet<Book> Books { get; set; }
}
public class Book {
  [Required]
  [StringLength(80)]
  public string Title { get; set; }
  public int? Pages { get; set; }
}
"""),
    ("go/book.go", """package stock
type Book struct {
  Title string `gorm:"unique;not null" validate:"required,max=80"`
  Pages *int
  Shelf Shelf
}
type Shelf struct {
  Room string `gorm:"size:20"`
}
type Note struct {
  Text string
}
"""),
    ("rails/schema.rb", """create_table "books" do |t|
  t.string "title", null: false
  t.integer "pages"
  t.references :shelf
end
class Book < ApplicationRecord
  validates :title, :isbn, presence: true, length: { maximum: 80 }
end
"""),
    ("rust/book.rs", """#[derive(Queryable)]
pub struct Book {
  #[validate(length(max = 80))]
  pub title: String,
  pub pages: Option<i32>,
}
"""),
    ("node/schema.prisma", """model Book {
  id    Int    @id
  title String @unique
  shelf Shelf?
}
model Shelf {
  books Book[]
}
"""),
    ("php/BookRequest.php", """<?php
class BookRequest {
  public function rules() {
    return ['title' => 'required|max:80'];
  }
}
"""),
)


def dialects(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(DIALECTS), "path string, text string")
    return rows.select("path", P.language(F.col("path")).alias("language"), "text")


def x15_dialect_models(spark, d):
    return M.declared_fields(dialects(spark))


def x21_dialect_rules(spark, d):
    return M.validation_rules(dialects(spark))


def x19_technologies(spark, d):
    return M.technology_signs(files(spark).union(dialects(spark)))


def files(spark: SparkSession) -> DataFrame:
    """path, language, text of the fixture."""
    rows = spark.createDataFrame(list(FILES), "path string, text string")
    return rows.select("path", P.language(F.col("path")).alias("language"), "text")


def p02_p05_classes(spark, d):
    p = F.col("path")
    return files(spark).select(
        "path", "language", P.is_source(p).alias("source"), P.is_test(p).alias("test"), P.role(p).alias("role"), P.config_kind(p).alias("config"),
        P.feature_word(p).alias("word"), P.feature_key(p).alias("feature"),
    )


def x01_x12_line_facts(spark, d):
    """Symbols, imports, routes, client calls and database calls of the scripts and Python files."""
    kinds = ("function", "class", "import", "route", "client_call", "orm_read", "orm_write")
    return extract.facts(C.uncommented(files(spark)).filter(P.is_source(F.col("path")))).filter(F.col("kind").isin(*kinds)).select("path", "line", "kind", "name", "detail")


def x13_tables(spark, d):
    return C.table_columns(files(spark))


def x14_models(spark, d):
    return C.model_fields(files(spark))


def x16_relations(spark, d):
    return C.relations(C.table_columns(files(spark)), C.model_fields(files(spark)))


def x02_calls(spark, d):
    """Calls of functions by the innermost symbol around them."""
    return C.calls(files(spark))


def g03_call_graph(spark, d):
    src = files(spark)
    return graph.call_edges(C.calls(src), C.symbols(src), C.bindings(src))


def g05_trace_up(spark, d):
    edges = g03_call_graph(spark, d).select("src", "dst", F.col("line").alias("ord"))
    starts = edges.select(F.col("dst").alias("start")).distinct()
    bound = spark.createDataFrame([("web/src/components/BasketView.jsx#submit",)], "node string")
    return graph.trace_up(edges, starts, bound, 8)


def src07_environment(spark, d):
    return S.environment_names(files(spark)).select("name", F.array_join("paths", ",").alias("paths"))


def src05_packages(spark, d):
    return S.packages(files(spark))


def p06_entry_points(spark, d):
    src = files(spark)
    uses = C.bindings(src).filter("target IS NOT NULL AND target <> file").select("file", F.col("target").alias("path")).distinct().groupBy("path").agg(F.count("*").alias("dependents"))
    return src.filter(P.is_source(F.col("path"))).join(uses, "path", "left").select("path", P.is_entry(F.col("path"), F.col("dependents")).alias("entry"))


def a07_layers(spark, d):
    """Sorted files by role of the source files."""
    src = files(spark).filter(P.is_source(F.col("path")))
    return src.groupBy(P.role(F.col("path")).alias("role")).agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files"))


def x11_endpoints(spark, d):
    """Routes with the prefix under which their file is mounted, and their handler and middleware."""
    return C.endpoints(files(spark)).select("file", "line", "method", "endpoint", F.array_join("middleware", ",").alias("middleware"), "handler")


def j01_client_links(spark, d):
    """Client calls and the routes they reach, by path and method."""
    src = files(spark)
    sent = extract.facts(C.uncommented(src), extract.CLIENT_CALLS).select("path", "line", F.upper(F.when(F.col("detail") == "", "get").otherwise(F.col("detail"))).alias("m"), T.comparison_path(T.url_path(F.col("name"))).alias("k"))
    routes = C.endpoints(src).select(F.col("file").alias("route_file"), F.col("line").alias("route_line"), F.upper("method").alias("route_m"), T.comparison_path(F.col("endpoint")).alias("k"))
    return sent.join(routes, "k").filter("m = route_m OR route_m IN ('ANY', 'ALL')").select("path", "line", "route_file", "route_line")


def g06_handlers(spark, d):
    """Steps behind each route: the handler and what it calls, with the entities that are read or written there."""
    src = files(spark)
    edges = graph.call_edges(C.calls(src), C.symbols(src), C.bindings(src))
    handled = graph.call_edges(C.endpoints(src).select("file", F.concat_ws(" ", F.upper("method"), "endpoint").alias("symbol"), F.col("handler").alias("name"), "line"), C.symbols(src), C.bindings(src))
    starts = handled.select(F.col("src").alias("route"), F.col("dst").alias("start"))
    down = graph.reach(edges, starts.select("start").distinct(), 8, include_start=True)
    used = C.database_uses(src).select(F.concat_ws("#", "file", "symbol").alias("node"), F.concat_ws(":", "kind", "entity").alias("use"))
    met = starts.join(down, "start").join(used, "node", "left")
    return met.groupBy("route", "depth", "node").agg(F.array_join(F.array_sort(F.collect_set("use")), ",").alias("uses"))


CLAIMS = (
    ("true", "VERIFIED", "sumPrices", "", [("server/services/basketStore.js", "saveBasket", 1, 4, None)]),
    ("made up", "VERIFIED", "refund", "", [("server/services/basketStore.js", None, None, None, None)]),
    ("forged", "VERIFIED", "x", "", [("stock/views.py", None, None, None, "old")]),
    ("foreign", "VERIFIED", "x", "", [("../etc/passwd", None, None, None, None), ("none.js", None, None, None, None)]),
    ("bare", "VERIFIED", "x", "", []),
    ("symbol", "VERIFIED", "", "It counts.", [("stock/views.py", "count_books", 5, None, None)]),
    ("vague", "VERIFIED", "", "It counts.", [("stock/views.py", None, 1, 2, None)]),
    ("lines", "VERIFIED", "x", "", [("stock/views.py", None, 5, 900, None)]),
    ("guess", "INFERRED", "x", "", [("stock/views.py", None, None, None, None)]),
    ("hunch", "INFERRED", "x", "", []),
    ("other", "UNKNOWN", "x", "", []),
)


def _claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLAIMS), f"claim string, status string, subject string, body string, evidence {V.REFERENCES}")


def m08_claim_verdicts(spark, d):
    src = files(spark)
    known = src.select("path", "text", F.sha2("text", 256).alias("hash"))
    return V.claim_verdicts(_claims(spark), V.check_references(_claims(spark), known, C.symbols(src)))


def m13_sanitised(spark, d):
    batch = files(spark).filter("path LIKE 'stock/%'").select("path", F.lit("h").alias("hash"))
    return V.sanitised(_claims(spark), batch).select("claim", "status", F.size("evidence").cast("long").alias("kept"))


def m15_places(spark, d):
    asked = spark.createDataFrame([("server/app.js",), ("app.js",), ("server/services/",), ("ices/basketStore.js",), ("server/none.js",)], "place string")
    return V.places_exist(asked, files(spark))


#: The tables of a second shop.
OTHER = """CREATE TABLE reader (id BIGINT PRIMARY KEY, email TEXT, nick TEXT);
CREATE TABLE loans (id UUID PRIMARY KEY);
"""


def c03_compare(spark, d):
    """The bookshop and a second shop side by side."""
    return _compared(spark).select("category", "key", "label", "side", F.array_join("why", ", ").alias("why"))


def c04_suggestions(spark, d):
    return Cmp.suggestions(_compared(spark))


def a16_totals(spark, d):
    return Cmp.totals(_compared(spark))


def _compared(spark: SparkSession) -> DataFrame:
    src = files(spark)
    routes = C.endpoints(src).select("method", "endpoint", F.exists("middleware", lambda m: m.rlike("(?i)auth|requireReader")).alias("protected"))
    a = Cmp.items(C.table_columns(src), routes, S.packages(src).select("name", "version"), src.groupBy("language").agg(F.count("*").alias("files")).filter("language = 'python'"))
    ddl = spark.createDataFrame([("o.sql", "sql", OTHER)], "path string, language string, text string")
    theirs = spark.createDataFrame([("get", "/api/baskets", False), ("post", "/api/baskets", False), ("get", "/api/loans/{id}", True)], "method string, endpoint string, protected boolean")
    b = Cmp.items(C.table_columns(ddl), theirs, spark.createDataFrame([("express", "5.0.1")], "name string, version string"), spark.createDataFrame([("go", 3)], "language string, files long"))
    return Cmp.compare(a, b)


def o01_order(spark, d):
    """Reading order of the bookshop: the stock service first, the front end last but for its services."""
    rows = files(spark).select("path", F.when(F.col("path").endswith(".sql"), "OUTDATED").otherwise("NOT_ANALYZED").alias("status"))
    return J.reading_order(rows, ["stock", "web/src/services"], ["web"])


QUERIES = {f.__name__: f for f in (
    x15_dialect_models, x21_dialect_rules, x19_technologies,
    p06_entry_points, a07_layers, x11_endpoints, j01_client_links, g06_handlers, m08_claim_verdicts, m13_sanitised, m15_places, c03_compare, c04_suggestions, a16_totals, o01_order,
    p02_p05_classes, x01_x12_line_facts, x13_tables, x14_models, x16_relations, x02_calls, g03_call_graph, g05_trace_up, src07_environment, src05_packages,
)}


def _rows(columns: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) t({columns})"


#: Rows worked out by hand from the files above.
ORACLES = {
    "p02_p05_classes": _rows(
        "path, language, source, test, role, config, word, feature",
        "('web/src/components/BasketView.jsx', 'javascript', true, false, 'component', null, 'basket', 'web')",
        "('web/src/services/basketService.js', 'javascript', true, false, 'service', null, 'basket', 'web')",
        "('server/routes/basketRoutes.js', 'javascript', true, false, 'route', null, 'basket', 'basket')",
        "('server/app.js', 'javascript', true, false, 'other', null, 'app', null)",
        "('server/controllers/basketController.js', 'javascript', true, false, 'controller', null, 'basket', 'basket')",
        "('server/services/basketStore.js', 'javascript', true, false, 'service', null, 'basket', 'basket')",
        "('server/db/schema.sql', 'sql', false, false, 'other', null, 'schema', 'db')",
        "('stock/models.py', 'python', true, false, 'model', null, 'models', 'stock')",
        "('stock/views.py', 'python', true, false, 'controller', null, 'views', 'stock')",
        "('stock/test_views.py', 'python', true, true, 'test', null, 'test', 'stock')",
        "('package.json', 'json', false, false, 'other', null, 'package', 'package')",
        "('.env.example', 'env', false, false, 'other', 'environment', 'env', 'env')",
        "('.github/workflows/test.yml', 'yaml', false, false, 'other', 'ci', 'test', '')",
    ),
    "x01_x12_line_facts": _rows(
        "path, line, kind, name, detail",
        "('web/src/components/BasketView.jsx', 1::bigint, 'import', 'react', '')",
        "('web/src/components/BasketView.jsx', 2, 'import', '../services/basketService', '')",
        "('web/src/components/BasketView.jsx', 4, 'function', 'BasketView', '')",
        "('web/src/components/BasketView.jsx', 6, 'function', 'submit', '')",
        "('web/src/services/basketService.js', 3, 'function', 'sendBasket', '')",
        "('web/src/services/basketService.js', 6, 'client_call', '/api/baskets', 'POST')",
        "('server/routes/basketRoutes.js', 1, 'import', 'express', '')",
        "('server/routes/basketRoutes.js', 2, 'import', '../controllers/basketController', '')",
        "('server/routes/basketRoutes.js', 4, 'route', 'get', '/baskets')",
        "('server/routes/basketRoutes.js', 5, 'route', 'post', '/baskets')",
        "('server/app.js', 1, 'import', 'express', '')",
        "('server/app.js', 2, 'import', './routes/basketRoutes', '')",
        "('server/app.js', 4, 'route', 'use', '/api')",
        "('server/controllers/basketController.js', 1, 'import', '../services/basketStore', '')",
        "('server/controllers/basketController.js', 2, 'function', 'addBasket', '')",
        "('server/controllers/basketController.js', 6, 'function', 'listBaskets', '')",
        "('server/controllers/basketController.js', 7, 'orm_read', 'Basket', 'find')",
        "('server/services/basketStore.js', 1, 'function', 'saveBasket', '')",
        "('server/services/basketStore.js', 3, 'orm_write', 'Basket', 'create')",
        "('server/services/basketStore.js', 5, 'function', 'sumPrices', '')",
        "('stock/models.py', 1, 'import', 'django.db', 'models')",
        "('stock/models.py', 4, 'class', 'Shelf', 'models.Model')",
        "('stock/models.py', 8, 'class', 'Book', 'models.Model')",
        "('stock/views.py', 1, 'import', 'os', '')",
        "('stock/views.py', 2, 'import', 'stock.models', 'Book')",
        "('stock/views.py', 5, 'function', 'count_books', '')",
        "('stock/views.py', 6, 'orm_read', 'Book', 'filter')",
        "('stock/test_views.py', 1, 'import', 'stock.views', 'count_books')",
        "('stock/test_views.py', 4, 'function', 'test_count', '')",
    ),
    "x13_tables": _rows(
        "path, entity, field, type, required, is_unique, is_key, refers_to, refers_field",
        "('server/db/schema.sql', 'readers', 'id', 'INTEGER', false, false, true, null, null)",
        "('server/db/schema.sql', 'readers', 'email', 'VARCHAR(200)', true, true, false, null, null)",
        "('server/db/schema.sql', 'baskets', 'id', 'INTEGER', false, false, true, null, null)",
        "('server/db/schema.sql', 'baskets', 'reader_id', 'INTEGER', true, false, false, 'readers', 'id')",
        "('server/db/schema.sql', 'baskets', 'total', 'DECIMAL(10,2)', false, false, false, null, null)",
    ),
    "x14_models": _rows(
        "path, entity, field, type, required, is_unique, refers_to",
        "('stock/models.py', 'Shelf', 'room', 'CharField', true, false, null)",
        "('stock/models.py', 'Book', 'title', 'CharField', true, true, null)",
        "('stock/models.py', 'Book', 'pages', 'IntegerField', false, false, null)",
        "('stock/models.py', 'Book', 'shelf', 'ForeignKey', true, false, 'Shelf')",
    ),
    "x16_relations": _rows(
        "from_entity, to_entity, field, status",
        "('baskets', 'readers', 'reader_id', 'VERIFIED')",
        "('Book', 'Shelf', 'shelf', 'VERIFIED')",
    ),
    "x02_calls": _rows(
        "file, symbol, name, line",
        "('web/src/components/BasketView.jsx', 'BasketView', 'useState', 5::bigint)",
        "('web/src/components/BasketView.jsx', 'submit', 'sendBasket', 7)",
        "('web/src/components/BasketView.jsx', 'submit', 'setBooks', 8)",
        "('web/src/services/basketService.js', 'sendBasket', 'fetch', 6)",
        "('server/controllers/basketController.js', 'addBasket', 'saveBasket', 3)",
        "('server/services/basketStore.js', 'saveBasket', 'sumPrices', 2)",
        "('stock/test_views.py', 'test_count', 'count_books', 5)",
    ),
    "g03_call_graph": _rows(
        "src, dst, line, status",
        "('web/src/components/BasketView.jsx#submit', 'web/src/services/basketService.js#sendBasket', 7::bigint, 'VERIFIED')",
        "('server/controllers/basketController.js#addBasket', 'server/services/basketStore.js#saveBasket', 3, 'INFERRED')",
        "('server/services/basketStore.js#saveBasket', 'server/services/basketStore.js#sumPrices', 2, 'VERIFIED')",
        "('stock/test_views.py#test_count', 'stock/views.py#count_books', 5, 'VERIFIED')",
    ),
    "g05_trace_up": _rows(
        "start, step, node",
        "('web/src/services/basketService.js#sendBasket', 0, 'web/src/services/basketService.js#sendBasket')",
        "('web/src/services/basketService.js#sendBasket', 1, 'web/src/components/BasketView.jsx#submit')",
        "('server/services/basketStore.js#saveBasket', 0, 'server/services/basketStore.js#saveBasket')",
        "('server/services/basketStore.js#saveBasket', 1, 'server/controllers/basketController.js#addBasket')",
        "('server/services/basketStore.js#sumPrices', 0, 'server/services/basketStore.js#sumPrices')",
        "('server/services/basketStore.js#sumPrices', 1, 'server/services/basketStore.js#saveBasket')",
        "('server/services/basketStore.js#sumPrices', 2, 'server/controllers/basketController.js#addBasket')",
        "('stock/views.py#count_books', 0, 'stock/views.py#count_books')",
        "('stock/views.py#count_books', 1, 'stock/test_views.py#test_count')",
    ),
    "src07_environment": _rows("name, paths", "('PORT', 'server/app.js')", "('STOCK_TOKEN', '.env.example,stock/views.py')"),
    "src05_packages": _rows("path, name, version, dev", "('package.json', 'express', '4.1.0', false)", "('package.json', 'vitest', '1.0.0', true)"),
    "p06_entry_points": _rows(
        "path, entry",
        "('web/src/components/BasketView.jsx', false)", "('web/src/services/basketService.js', false)", "('server/routes/basketRoutes.js', false)", "('server/app.js', true)",
        "('server/controllers/basketController.js', false)", "('server/services/basketStore.js', false)", "('stock/models.py', false)", "('stock/views.py', false)", "('stock/test_views.py', false)",
    ),
    "a07_layers": _rows(
        "role, files",
        "('component', 'web/src/components/BasketView.jsx')", "('service', 'server/services/basketStore.js,web/src/services/basketService.js')", "('route', 'server/routes/basketRoutes.js')",
        "('controller', 'server/controllers/basketController.js,stock/views.py')", "('model', 'stock/models.py')", "('test', 'stock/test_views.py')", "('other', 'server/app.js')",
    ),
    "x11_endpoints": _rows(
        "file, line, method, endpoint, middleware, handler",
        "('server/routes/basketRoutes.js', 4::bigint, 'get', '/api/baskets', '', 'listBaskets')",
        "('server/routes/basketRoutes.js', 5, 'post', '/api/baskets', 'requireReader', 'addBasket')",
    ),
    "j01_client_links": "select 'web/src/services/basketService.js' as path, 6::bigint as line, 'server/routes/basketRoutes.js' as route_file, 5::bigint as route_line",
    "g06_handlers": _rows(
        "route, depth, node, uses",
        "('server/routes/basketRoutes.js#GET /api/baskets', 0, 'server/controllers/basketController.js#listBaskets', 'read:baskets')",
        "('server/routes/basketRoutes.js#POST /api/baskets', 0, 'server/controllers/basketController.js#addBasket', '')",
        "('server/routes/basketRoutes.js#POST /api/baskets', 1, 'server/services/basketStore.js#saveBasket', 'write:baskets')",
        "('server/routes/basketRoutes.js#POST /api/baskets', 2, 'server/services/basketStore.js#sumPrices', '')",
    ),
    "m08_claim_verdicts": _rows(
        "claim, verdict, why",
        "('true', 'VERIFIED', 'found in source')", "('made up', 'UNKNOWN', 'subject not in evidence')", "('forged', 'UNKNOWN', 'stale evidence')", "('foreign', 'UNKNOWN', 'evidence does not hold')",
        "('bare', 'INFERRED', 'no evidence')", "('symbol', 'VERIFIED', 'symbol exists')", "('vague', 'INFERRED', 'not checkable')", "('lines', 'UNKNOWN', 'evidence does not hold')",
        "('guess', 'INFERRED', 'kept with evidence')", "('hunch', 'INFERRED', 'kept without evidence')", "('other', 'UNKNOWN', 'as given')",
    ),
    "m13_sanitised": _rows(
        "claim, status, kept",
        "('true', 'INFERRED', 0::bigint)", "('made up', 'INFERRED', 0)", "('forged', 'VERIFIED', 1)", "('foreign', 'INFERRED', 0)", "('bare', 'INFERRED', 0)", "('symbol', 'VERIFIED', 1)",
        "('vague', 'VERIFIED', 1)", "('lines', 'VERIFIED', 1)", "('guess', 'INFERRED', 1)", "('hunch', 'INFERRED', 0)", "('other', 'UNKNOWN', 0)",
    ),
    "m15_places": _rows('place, "exists"', "('server/app.js', true)", "('app.js', true)", "('server/services/', true)", "('ices/basketStore.js', false)", "('server/none.js', false)"),
    "c03_compare": _rows(
        "category, key, label, side, why",
        "('tables', 'reader', 'readers', 'common', '')", "('tables', 'basket', 'baskets', 'only_a', '')", "('tables', 'loan', 'loans', 'only_b', '')",
        "('fields', 'reader.id', 'readers.id', 'common', '')", "('fields', 'reader.email', 'readers.email', 'common', 'required differs')", "('fields', 'reader.nick', 'reader.nick', 'only_b', '')",
        "('fields', 'basket.id', 'baskets.id', 'only_a', '')", "('fields', 'basket.readerid', 'baskets.reader_id', 'only_a', '')", "('fields', 'basket.total', 'baskets.total', 'only_a', '')",
        "('fields', 'loan.id', 'loans.id', 'only_b', '')",
        "('apis', 'GET /api/baskets', 'GET /api/baskets', 'common', '')", "('apis', 'POST /api/baskets', 'POST /api/baskets', 'common', 'protection differs')",
        "('apis', 'GET /api/loans/:p', 'GET /api/loans/{id}', 'only_b', '')",
        "('modules', 'express', 'express', 'common', 'major version differs')", "('modules', 'vitest', 'vitest', 'only_a', '')",
        "('stack', 'lang:python', 'python', 'only_a', '')", "('stack', 'lang:go', 'go', 'only_b', '')",
    ),
    "c04_suggestions": _rows(
        "category, direction, items, more",
        "('tables', 'keep', 'baskets', 0::bigint)", "('tables', 'adopt', 'loans', 0)", "('fields', 'review', 'readers.email (required differs)', 0)", "('fields', 'adopt', 'loans.id; reader.nick', 0)",
        "('fields', 'keep', 'baskets.id; baskets.reader_id; baskets.total', 0)", "('apis', 'review', 'POST /api/baskets (protection differs)', 0)", "('apis', 'adopt', 'GET /api/loans/{id}', 0)",
        "('modules', 'review', 'express (major version differs)', 0)", "('modules', 'keep', 'vitest', 0)", "('stack', 'keep', 'python', 0)", "('stack', 'adopt', 'go', 0)",
    ),
    "a16_totals": _rows(
        "category, common, only_a, only_b, different",
        "('tables', 1::bigint, 1::bigint, 1::bigint, 0::bigint)", "('fields', 2, 3, 2, 1)", "('apis', 2, 0, 1, 1)", "('modules', 1, 1, 0, 1)", "('stack', 0, 1, 1, 0)", "(null, 6, 6, 5, 3)",
    ),
    "o01_order": _rows(
        "path, place",
        "('stock/models.py', 1::bigint)", "('stock/test_views.py', 2)", "('stock/views.py', 3)", "('web/src/services/basketService.js', 4)", "('package.json', 5)", "('.env.example', 6)",
        "('.github/workflows/test.yml', 7)", "('server/app.js', 8)", "('server/controllers/basketController.js', 9)", "('server/routes/basketRoutes.js', 10)", "('server/services/basketStore.js', 11)",
        "('server/db/schema.sql', 12)", "('web/src/components/BasketView.jsx', 13)",
    ),
    "x15_dialect_models": _rows(
        "path, entity, field, type, required, is_unique, refers_to",
        "('jvm/Book.java', 'Book', 'title', 'String', true, true, null)", "('jvm/Book.java', 'Book', 'pages', 'Integer', false, false, null)", "('jvm/Book.java', 'Book', 'shelf', 'Shelf', false, false, 'Shelf')",
        "('jvm/Book.java', 'Shelf', 'room', 'String', false, false, null)",
        "('net/Book.cs', 'Book', 'Title', 'string', true, false, null)", "('net/Book.cs', 'Book', 'Pages', 'int?', false, false, null)",
        "('go/book.go', 'Book', 'Title', 'string', true, true, null)", "('go/book.go', 'Book', 'Pages', '*int', false, false, null)", "('go/book.go', 'Book', 'Shelf', 'Shelf', false, false, 'Shelf')",
        "('go/book.go', 'Shelf', 'Room', 'string', false, false, null)",
        "('rails/schema.rb', 'books', 'title', 'string', true, false, null)", "('rails/schema.rb', 'books', 'pages', 'integer', false, false, null)", "('rails/schema.rb', 'books', 'shelf', 'references', false, false, 'shelf')",
        "('rust/book.rs', 'Book', 'title', 'String', true, false, null)", "('rust/book.rs', 'Book', 'pages', 'Option<i32>', false, false, null)",
        "('node/schema.prisma', 'Book', 'id', 'Int', true, true, null)", "('node/schema.prisma', 'Book', 'title', 'String', true, true, null)", "('node/schema.prisma', 'Book', 'shelf', 'Shelf?', false, false, 'Shelf')",
        "('node/schema.prisma', 'Shelf', 'books', 'Book[]', false, false, 'Book')",
    ),
    "x21_dialect_rules": _rows(
        "path, entity, field, rule",
        "('jvm/Book.java', 'Book', 'title', 'required')", "('jvm/Book.java', 'Shelf', 'room', 'size')", "('net/Book.cs', 'Book', 'Title', 'required')", "('net/Book.cs', 'Book', 'Title', 'stringlength')",
        "('go/book.go', 'Book', 'Title', 'required')", "('go/book.go', 'Book', 'Title', 'max')", "('rails/schema.rb', 'Book', 'title', 'presence')", "('rails/schema.rb', 'Book', 'title', 'length')",
        "('rails/schema.rb', 'Book', 'isbn', 'presence')", "('rails/schema.rb', 'Book', 'isbn', 'length')", "('rust/book.rs', 'Book', 'title', 'length')",
        "('php/BookRequest.php', null, 'title', 'required')", "('php/BookRequest.php', null, 'title', 'max')",
    ),
    "x19_technologies": _rows(
        "technology, path, line",
        "('django-orm', 'stock/models.py', 1::bigint)", "('gorm', 'go/book.go', 3)", "('jpa', 'jvm/Book.java', 1)", "('entity-framework', 'net/Book.cs', 1)", "('activerecord', 'rails/schema.rb', 6)",
        "('prisma', 'node/schema.prisma', 1)", "('sql', 'server/db/schema.sql', 1)",
    ),
}
