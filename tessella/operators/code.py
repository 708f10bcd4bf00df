"""What spans lines in source texts: comments, blocks, calls, imported names, table definitions and models.

A text is cut into strings, comments and the rest by one regular expression, so comments can be blanked with every offset
kept, and brackets in strings do not count. Blocks are found on exploded lines: by a running sum of braces, or by indent.
All is built-in expressions and joins by file; a file is bounded (1 MiB is analysed), so its lines are too.

Defined results for odd input: a null text has no lines; an open comment or block ends with the file; a repeated file
gives its rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import paths as P
from tessella.functions import text as T
from tessella.operators.extract import DATABASE, SYMBOLS, facts

HASHED = ("python", "ruby", "shell", "yaml", "toml", "env")
_STRINGS = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
_TRIPLE = r"\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''"
#: A text as strings, comments and single other characters or runs of them; group 0 is all there is.
_SLASHED = rf"/\*(?s:.*?)(?:\*/|\z)|//[^\n]*|{_STRINGS}|`(?:[^`\\]++|\\.)*+`|[^\"'`/]++|(?s:.)"
_HASH = rf"#[^\n]*|{_TRIPLE}|{_STRINGS}|[^\"'#]++|(?s:.)"
_SQL = rf"/\*(?s:.*?)(?:\*/|\z)|--[^\n]*|{_STRINGS}|[^\"'/-]++|(?s:.)"
#: Words before a bracket that are no calls.
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "await", "async", "typeof", "require", "import", "elif", "and", "or", "not", "in", "with", "super", "print")
EXTENSIONS = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".vue", "/index.js", "/index.ts", ".py", "/__init__.py")


def _blank(part: Column) -> Column:
    return F.regexp_replace(part, r"[^\n]", " ")


def _parts(text: Column, language: Column) -> Column:
    found = F.when(language.isin(*HASHED), F.regexp_extract_all(text, F.lit(_HASH), F.lit(0)))
    return found.when(language == "sql", F.regexp_extract_all(text, F.lit(_SQL), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(_SLASHED), F.lit(0)))


def blanked(text: Column, language: Column, strings: bool = False) -> Column:
    """The text with comments (and the insides of strings) as blanks; every offset and line stays."""
    comment = F.when(language.isin(*HASHED), r"^#").when(language == "sql", r"^(/\*|--)").otherwise(r"^(/\*|//)")

    def part(x: Column) -> Column:
        bare = F.when(F.regexp_like(x, comment), _blank(x))
        if strings:
            bare = bare.when(x.rlike(r"(?s)^([\"'`]).*\1$"), _blank(x))
        return bare.otherwise(x)

    return F.array_join(F.transform(_parts(text, language), part), "")


def uncommented(files: DataFrame) -> DataFrame:
    """``files`` (path, language, text) with comments blanked."""
    return files.withColumn("text", blanked(F.col("text"), F.col("language")))


def _lines(files: DataFrame) -> DataFrame:
    """path, language, line (from 1), body without comments, and plain, without strings too."""
    kinds = files.select("path", "language", blanked(F.col("text"), F.col("language")).alias("code"), blanked(F.col("text"), F.col("language"), True).alias("plain"))
    both = kinds.select("path", "language", F.arrays_zip(F.split("code", "\n", -1).alias("body"), F.split("plain", "\n", -1).alias("plain")).alias("x"))
    return both.select("path", "language", F.posexplode("x").alias("at", "x")).select("path", "language", (F.col("at") + 1).cast("long").alias("line"), "x.body", "x.plain")


def symbols(files: DataFrame) -> DataFrame:
    """file, name, kind, line and end of each function and class: its closing brace, or the last line indented below it."""
    lines = _lines(files)
    order = Window.partitionBy("path").orderBy("line")
    depth = F.sum(F.regexp_count("plain", F.lit(r"\{")) - F.regexp_count("plain", F.lit(r"\}"))).over(order)
    indent = F.when(F.trim("plain") != "", F.length(F.regexp_extract("plain", r"^\s*", 0)))
    # Where a block stands: python by its indent, others by the depth of braces after the line.
    placed = lines.select("path", "language", "line", depth.alias("depth"), indent.alias("indent"), (F.trim("plain") != "").alias("full"))
    placed = placed.withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0)))
    found = facts(uncommented(files), SYMBOLS).select("path", "line", "kind", "name").distinct()
    heads = found.join(placed, ["path", "line"]).select("path", "line", "kind", "name", "language", "before", F.col("indent").alias("own"), F.col("depth").alias("after"))
    rest = placed.select("path", F.col("line").alias("at"), F.col("depth").alias("at_depth"), F.col("indent").alias("at_indent"), "full")
    met = heads.join(rest, "path")
    hashed = F.col("language").isin(*HASHED)
    closes = (F.col("at") >= F.col("line")) & (F.col("at_depth") <= F.col("before")) & ((F.col("at") > F.col("line")) | (F.col("after") <= F.col("before")))
    leaves = (F.col("at") > F.col("line")) & F.col("full") & (F.col("at_indent") <= F.col("own"))
    last = met.groupBy("path", "line", "kind", "name", "language").agg(
        F.min(F.when(closes, F.col("at"))).alias("brace"), F.min(F.when(leaves, F.col("at"))).alias("left"), F.max("at").alias("eof")
    )
    # The last full line before the one that is indented no deeper.
    end = F.when(hashed, F.coalesce(F.col("left") - 1, "eof")).otherwise(F.coalesce("brace", "eof"))
    return last.select(F.col("path").alias("file"), "name", "kind", "line", end.alias("end"))


def calls(files: DataFrame) -> DataFrame:
    """file, symbol, name and line of each call of a plain name, by the innermost symbol around it."""
    called = F.regexp_extract_all("plain", F.lit(r"(?<![\w.$])(?<!\bfunction )(?<!\bdef )(?<!\bclass )([A-Za-z_$][\w$]*)\s*\("), F.lit(1))
    found = _lines(files).filter(P.is_source(F.col("path"))).select(F.col("path").alias("file"), F.col("line").alias("at"), F.explode(called).alias("call"))
    found = found.filter(~F.col("call").isin(*KEYWORDS)).distinct()
    around = found.join(symbols(files), "file").filter((F.col("line") <= F.col("at")) & (F.col("at") <= F.col("end")) & ((F.col("line") < F.col("at")) | (F.col("name") != F.col("call"))))
    inner = around.groupBy("file", "at", "call").agg(F.max_by("name", F.struct("line", F.col("kind") == "function")).alias("symbol"))
    return inner.select("file", "symbol", F.col("call").alias("name"), F.col("at").alias("line"))


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` seen from the folder ``base``, with . and .. resolved."""
    parts = F.split(F.concat_ws("/", F.when(base != "", base), relative), "/")
    out = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).when((s == ".") | (s == ""), acc).otherwise(F.array_append(acc, s)),
    )
    return F.array_join(out, "/")


def bindings(files: DataFrame) -> DataFrame:
    """file, local name, target (the imported file, null outside the project) and imported name of each import."""
    js = r"(?:import\s+(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s*|(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*)['\"]([^'\"]+)['\"]"
    py = r"(?m)^\s*from\s+([.\w]+)\s+import\s+([^\n(]+)"
    code = uncommented(files)

    def each(pattern: str, *groups: int) -> Column:
        return F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])

    script = code.filter(F.col("language").isin("javascript", "typescript", "vue", "svelte")).select("path", F.explode(each(js, 1, 2, 3, 4, 5)).alias("m"))
    named = F.split(F.concat_ws(",", F.nullif("m.g2", F.lit("")), F.nullif("m.g4", F.lit(""))), ",")
    whole = F.concat("m.g1", "m.g3")
    script = script.select("path", F.col("m.g5").alias("module"), F.concat(F.array(F.when(whole != "", F.concat(F.lit("default as "), whole))), named).alias("names"))
    python = code.filter("language = 'python'").select("path", F.explode(each(py, 1, 2)).alias("m")).select("path", F.col("m.g1").alias("module"), F.split("m.g2", ",").alias("names"))
    one = script.unionByName(python).select("path", "module", F.explode(F.array_compact("names")).alias("item")).filter(F.trim("item") != "")
    pieces = F.split(F.trim("item"), r"\s+as\s+|\s*:\s*")
    named_rows = one.select("path", "module", pieces[0].alias("imported"), F.element_at(pieces, -1).alias("local"))
    # Where the module may lie: beside the file for a leading dot, else from the root with dots as folders.
    here = joined_path(P.dirname(F.col("path")), F.col("module"))
    root = F.when(F.col("path").endswith(".py"), F.regexp_replace("module", r"\.", "/")).when(F.startswith("module", F.lit(".")), here)
    tries = F.transform(F.array(*map(F.lit, EXTENSIONS)), lambda e: F.concat(root, e))
    candidates = named_rows.withColumn("_try", F.when(root.isNotNull(), tries))
    placed = candidates.select("*", F.posexplode_outer("_try").alias("_rank", "_at"))
    known = files.select(F.col("path").alias("_at"), F.lit(1).alias("_there")).distinct()
    met = placed.join(known, "_at", "left").groupBy(F.col("path").alias("file"), "local", "imported").agg(F.min_by("_at", F.when(F.col("_there") == 1, F.col("_rank"))).alias("target"))
    return met


_NAME = r"[`\"\[]?([\w.]+)[`\"\]]?"
_TABLE = rf"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s*\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)"
#: A comma that no closing bracket follows before an opening one: at most two brackets deep.
_COMMA = r",(?![^()]*+(?:\([^()]*+\)[^()]*+)*+\))"


def table_columns(files: DataFrame) -> DataFrame:
    """path, entity, field, type, required, is_unique, is_key, refers_to and refers_field of each column that DDL defines."""
    code = uncommented(files)
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(_TABLE), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(_TABLE), F.lit(2)).alias("body"))
    tables = code.select("path", F.explode(zipped).alias("t")).select("path", F.col("t.name").alias("entity"), F.split("t.body", _COMMA).alias("parts"))
    parts = tables.select("path", "entity", F.posexplode("parts").alias("at", "part")).withColumn("part", F.trim(F.regexp_replace("part", r"\s+", " ")))
    rule = r"(?i)^(constraint \S+ )?(primary key|foreign key|unique|check|exclude|index|key)\b"
    names = lambda pattern: F.split(F.regexp_replace(F.regexp_extract("part", pattern, 1), r"[`\"\s\[\]]", ""), ",")
    keys = parts.filter(F.col("part").rlike(rule)).select(
        "path", "entity",
        F.when(F.col("part").rlike("(?i)primary key"), "key").when(F.col("part").rlike("(?i)foreign key"), "foreign").when(F.col("part").rlike("(?i)unique"), "unique").alias("what"),
        F.explode(names(r"\(([^)]*)\)")).alias("field"), F.regexp_extract("part", rf"(?i)references {_NAME}", 1).alias("to"),
        F.regexp_extract("part", rf"(?i)references {_NAME}\s*\(\s*{_NAME}", 2).alias("to_field"),
    )
    keys = keys.groupBy("path", "entity", "field").agg(
        F.bool_or(F.col("what") == "key").alias("_key"), F.bool_or(F.col("what") == "unique").alias("_unique"),
        F.max(F.nullif("to", F.lit(""))).alias("_to"), F.max(F.nullif("to_field", F.lit(""))).alias("_to_field"),
    )
    own = parts.filter(~F.col("part").rlike(rule) & (F.col("part") != ""))
    inline = rf"(?i)\breferences {_NAME}"
    cols = own.select(
        "path", "entity", "at", F.regexp_extract("part", rf"^{_NAME}", 1).alias("field"), F.regexp_extract("part", rf"^{_NAME}\s+(\w+(?:\s?\([^)]*\))?)", 2).alias("type"),
        F.col("part").rlike(r"(?i)\bnot null\b").alias("required"), F.col("part").rlike(r"(?i)\bunique\b").alias("is_unique"), F.col("part").rlike(r"(?i)\bprimary key\b").alias("is_key"),
        F.nullif(F.regexp_extract("part", inline, 1), F.lit("")).alias("refers_to"), F.nullif(F.regexp_extract("part", rf"{inline}\s*\(\s*{_NAME}", 2), F.lit("")).alias("refers_field"),
    )
    met = cols.join(keys, ["path", "entity", "field"], "left")
    return met.select(
        "path", "entity", "field", "type", "required", (F.col("is_unique") | F.coalesce("_unique", F.lit(False))).alias("is_unique"),
        (F.col("is_key") | F.coalesce("_key", F.lit(False))).alias("is_key"), F.coalesce("refers_to", "_to").alias("refers_to"), F.coalesce("refers_field", "_to_field").alias("refers_field"),
    )


def model_fields(files: DataFrame) -> DataFrame:
    """path, entity, field, type, required, is_unique and refers_to of each field of a Django model."""
    python = files.filter("language = 'python'")
    pattern = r"^\s+(\w+)\s*=\s*models\.(\w+)\((.*)\)\s*$"
    fields = _lines(python).filter(F.col("body").rlike(pattern)).select(
        "path", F.col("line").alias("at"), *[F.regexp_extract("body", pattern, g).alias(c) for g, c in ((1, "field"), (2, "type"), (3, "args"))]
    )
    classes = symbols(python).filter("kind = 'class'").select(F.col("file").alias("path"), F.col("name").alias("entity"), "line", "end")
    met = fields.join(classes, "path").filter((F.col("line") < F.col("at")) & (F.col("at") <= F.col("end")))
    inner = met.groupBy("path", "at", "field", "type", "args").agg(F.max_by("entity", "line").alias("entity"))
    target = F.when(F.col("type").isin("ForeignKey", "OneToOneField", "ManyToManyField"), F.regexp_extract("args", r"^\s*(?:to\s*=\s*)?['\"]?(?:\w+\.)?(\w+)", 1))
    return inner.select(
        "path", "entity", "field", "type", (~F.col("args").rlike(r"\bnull\s*=\s*True")).alias("required"), F.col("args").rlike(r"\bunique\s*=\s*True").alias("is_unique"), target.alias("refers_to")
    )


def relations(*entities: DataFrame) -> DataFrame:
    """from_entity, to_entity, field and status: VERIFIED where the target is a known entity, in any case, else INFERRED."""
    rows = None
    for e in entities:
        part = e.select("entity", "field", "refers_to")
        rows = part if rows is None else rows.unionByName(part)
    known = rows.select(F.lower("entity").alias("_key")).distinct()
    met = rows.filter("refers_to IS NOT NULL").join(known, F.lower("refers_to") == F.col("_key"), "left")
    return met.select(F.col("entity").alias("from_entity"), F.col("refers_to").alias("to_entity"), "field", F.when(F.col("_key").isNotNull(), "VERIFIED").otherwise("INFERRED").alias("status")).distinct()


def endpoints(files: DataFrame) -> DataFrame:
    """file, line, method, endpoint, middleware and handler of each script route, once for each prefix its file is mounted under.

    A mount is a ``use`` of a name that is imported from a file; what is not mounted keeps its own path.
    """
    pattern = r"\b(?:app|router|server|api)\.(get|post|put|patch|delete|head|options|all|use)\(\s*['\"`]([^'\"`]+)['\"`]\s*,?([^;]*)\)"
    lines = _lines(files.filter(F.col("language").isin("javascript", "typescript")))
    one = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3)])
    found = lines.select(F.col("path").alias("file"), "line", F.explode(one).alias("m")).select("file", "line", F.col("m.g1").alias("method"), F.col("m.g2").alias("own"), F.split(F.trim("m.g3"), r"\s*,\s*").alias("args"))
    mounts = found.filter("method = 'use'").select(F.col("file").alias("_parent"), F.element_at("args", -1).alias("_local"), F.col("own").alias("prefix"))
    named = bindings(files).filter("target IS NOT NULL").select(F.col("file").alias("_parent"), F.col("local").alias("_local"), F.col("target").alias("file"))
    placed = mounts.join(named, ["_parent", "_local"]).select("file", "prefix").distinct()
    routes = found.filter("method <> 'use'").join(placed, "file", "left")
    path = F.regexp_replace(F.concat(F.coalesce(F.regexp_replace("prefix", "/+$", ""), F.lit("")), "own"), "/{2,}", "/")
    return routes.select("file", "line", "method", T.endpoint(path).alias("endpoint"), F.slice("args", F.lit(1), F.greatest(F.lit(0), F.size("args") - 1)).alias("middleware"), F.element_at("args", -1).alias("handler"))


def database_uses(files: DataFrame) -> DataFrame:
    """file, symbol, kind (read or write) and entity of each ORM call on a known entity, by the innermost symbol around it.

    The receiver is looked up as it is, then as a key, then in the singular; receivers that are no entity are dropped.
    """
    known = table_columns(files).select("entity").union(model_fields(files).select("entity")).distinct()
    keyed = known.select("entity", T.singular(T.name_key(F.col("entity"))).alias("key")).groupBy("key").agg(F.min("entity").alias("entity"))
    found = facts(uncommented(files), DATABASE).filter("kind IN ('orm_read', 'orm_write')")
    named = found.select(F.col("path").alias("file"), F.col("line").alias("at"), F.substring_index("kind", "_", -1).alias("use"), T.singular(T.name_key(F.col("name"))).alias("key"))
    around = named.join(keyed, "key").join(symbols(files), "file").filter((F.col("line") <= F.col("at")) & (F.col("at") <= F.col("end")))
    inner = around.groupBy("file", "at", "use", "entity").agg(F.max_by("name", "line").alias("symbol"))
    return inner.select("file", "symbol", F.col("use").alias("kind"), "entity").distinct()
