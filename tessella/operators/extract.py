"""Facts from texts: a table of line rules compiled into one projection.

A rule names a kind of fact, the languages it holds for and a pattern whose first group is the fact's name (a second
one its detail). All rules that apply are one array expression over a line, so a corpus is read once whatever the number of rules,
nothing is shuffled, and no user function runs.

Defined results for odd input: a null text has no facts; a line gives a fact for each match of each rule, however many;
comments at a line's start give none, by the marks of its language, and what follows a closed one is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineRule:
    kind: str
    pattern: str
    languages: tuple[str, ...] = ()  # none: any


JS = ("javascript", "typescript", "vue", "svelte")
JVM = ("java", "kotlin")
VERB = "get|post|put|patch|delete|head|options"

SYMBOLS = (
    LineRule("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", JS),
    LineRule("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>", JS),
    LineRule("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?", JS),
    LineRule("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", ("python",)),
    LineRule("class", r"^\s*class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?", ("python",)),
    LineRule("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", ("go",)),
    LineRule("class", r"^type\s+([A-Za-z_]\w*)\s+(struct|interface)", ("go",)),
    LineRule("class", r"^\s*(?:public\s+|final\s+|abstract\s+|data\s+|sealed\s+|partial\s+|static\s+|internal\s+)*(?:class|interface|record)\s+([A-Za-z_]\w*)", (*JVM, "csharp")),
    LineRule("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", ("rust",)),
    LineRule("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", ("ruby",)),
    LineRule("function", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+([A-Za-z_]\w*)", ("php",)),
    LineRule("class", r"^\s*class\s+([A-Z]\w*)(?:\s*<\s*([\w:]+))?", ("ruby",)),
    LineRule("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)", ("rust",)),
    LineRule("table", r"^\s*create_table\s+[\"':](\w+)", ("ruby",)),
    LineRule("table", r"^\s*model\s+(\w+)\s*\{", ("prisma",)),
)
IMPORTS = (
    LineRule("import", r"^\s*(?:import|export)\b[^'\"]*['\"]([^'\"]+)['\"]", JS),
    LineRule("import", r"\b(?:require|import)\(\s*['\"]([^'\"]+)['\"]\s*\)", JS),
    LineRule("import", r"^\s*from\s+([.\w]+)\s+import\s+(.+)", ("python",)),
    LineRule("import", r"^\s*import\s+([\w.]+)", ("python", *JVM)),
    LineRule("import", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", ("csharp",)),
    LineRule("import", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", ("go",)),
    LineRule("import", r"^\s*use\s+([\w\\:]+)", ("php", "rust")),
    LineRule("import", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", ("ruby",)),
)
ROUTES = (
    LineRule("route", rf"\b(?:app|router|server|api)\.({VERB}|all|use)\(\s*['\"`]([^'\"`]+)['\"`]", JS),
    LineRule("route", rf"^\s*@\w+\.({VERB}|route)\(\s*['\"]([^'\"]*)['\"]", ("python",)),
    LineRule("route", r"^\s*@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"", JVM),
    LineRule("route", r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"", ("csharp",)),
    LineRule("route", r"\.(GET|POST|PUT|PATCH|DELETE|HandleFunc|Handle)\(\s*\"([^\"]+)\"", ("go",)),
    LineRule("route", r"^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]", ("ruby",)),
    LineRule("route", r"Route::(get|post|put|patch|delete|any)\(\s*['\"]([^'\"]+)['\"]", ("php",)),
    LineRule("route", r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", ("rust",)),
)
CLIENT_CALLS = (
    LineRule("client_call", r"\bfetch\(\s*['\"`]([^'\"`]+)['\"`](?:(?:(?!\bfetch\().)*method:\s*['\"](\w+)['\"])?", JS),
    LineRule("client_call", rf"\b(?:axios|http|client|\$http)\.(?:{VERB})\(\s*['\"`]([^'\"`]+)['\"`]", JS),
    LineRule("client_call", rf"\b(?:requests|httpx|session)\.(?:{VERB})\(\s*f?['\"]([^'\"]+)['\"]", ("python",)),
)
DATABASE = (
    LineRule("table", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)"),
    LineRule("foreign_key", r"(?i)\breferences\s+[`\"\[]?([\w.]+)[`\"\]]?\s*\(\s*[`\"\[]?(\w+)"),
    LineRule("select", r"(?i)\bselect\b.+?\bfrom\s+[`\"\[]?([A-Za-z_][\w.]*)"),
    LineRule("insert", r"(?i)\binsert\s+into\s+[`\"\[]?([A-Za-z_][\w.]*)"),
    LineRule("update", r"(?i)\bupdate\s+[`\"\[]?([A-Za-z_][\w.]*)[`\"\]]?\s+set\b"),
    LineRule("delete", r"(?i)\bdelete\s+from\s+[`\"\[]?([A-Za-z_][\w.]*)"),
    LineRule("orm_read", r"\b([A-Z]\w*)\.(find|findOne|findAll|findById|findMany|count|aggregate)\(", JS),
    LineRule("orm_write", r"\b([A-Z]\w*)\.(create|insertMany|updateOne|updateMany|deleteOne|deleteMany|destroy|upsert|bulkCreate)\(", JS),
    LineRule("orm_read", r"\b([A-Z]\w*)\.objects\.(all|get|filter|exclude|count|first)\(", ("python",)),
    LineRule("orm_write", r"\b([A-Z]\w*)\.objects\.(create|update|delete|bulk_create|get_or_create)\(", ("python",)),
)
EVIDENCE = (
    LineRule("auth", r"(?i)\b(jsonwebtoken|jwt|bcrypt|passport|oauth2?|login_required|IsAuthenticated|Authorize|PreAuthorize|session_token)\b"),
    LineRule("service_host", r"https?://([A-Za-z0-9.-]+\.[A-Za-z]{2,})"),
    LineRule("event", r"\.(emit|publish|dispatch|send_task|delay)\(\s*['\"]([^'\"]+)['\"]"),
    LineRule("validation", r"\b(?:body|check|param|query)\(\s*['\"](\w+)['\"]\s*\)\.(is\w+|not\w*|exists)", JS),
)
RULES = SYMBOLS + IMPORTS + ROUTES + CLIENT_CALLS + DATABASE + EVIDENCE
PAGES = (
    LineRule("title", r"<title>([^<]*)</title>"),
    LineRule("link", r"<a\s[^>]*href=\"([^\"]+)\""),
    LineRule("script", r"<script\s[^>]*src=\"([^\"]+)\""),
    LineRule("form", r"<form\s[^>]*action=\"([^\"]*)\""),
    LineRule("service_host", r"https?://([A-Za-z0-9.-]+)"),
)
#: Marks that open a comment where the language is not listed in ``MARKS``.
COMMENT = r"^\s*(?://|#[^\[]|#$|\*|/\*|--|<!--)"
SLASHES = r"//|\*|/\*"
#: By language: what opens a comment, and closed comments (or their ends) after which the line goes on.
MARKS = (
    (("html",), r"^\s*<!--", r"^(?:\s*<!--.*?-->)+"),
    (("python", "ruby"), r"^\s*#", None),
    (("javascript", "typescript", *JVM, "csharp", "go", "rust"), rf"^\s*(?:{SLASHES})", r"^(?:\s*(?:/\*.*?\*/|\*/))+\s*"),
    (("vue", "svelte"), rf"^\s*(?:{SLASHES}|<!--)", r"^(?:\s*(?:/\*.*?\*/|\*/|<!--.*?-->))+\s*"),
    (("php",), rf"^\s*(?:{SLASHES}|#[^\[]|#$|<!--)", r"^(?:\s*(?:/\*.*?\*/|\*/|<!--.*?-->))+\s*"),
)
CLOSED = r"^(?:\s*(?:/\*.*?\*/|\*/|<!--.*?-->))+\s*"


def _content(line: Column, language: Column) -> Column:
    """The line after the comments that open it; null if it is one."""

    def rest(mark: str, closed: str | None) -> Column:
        left = F.regexp_replace(line, closed, "") if closed else line
        return F.when(~left.rlike(mark), left)

    out = F
    for languages, mark, closed in MARKS:
        out = out.when(language.isin(*languages), rest(mark, closed))
    return out.otherwise(rest(COMMENT, CLOSED))


def compile_lines(rules: tuple[LineRule, ...], line: Column, language: Column) -> Column:
    """One array of (kind, name, detail) for a line, with every match of every rule."""

    def fact(kind: str) -> Callable[[Column, Column], Column]:
        return lambda n, d: F.struct(F.lit(kind).alias("kind"), n.alias("name"), d.alias("detail"))

    facts = []
    for r in rules:
        names = F.regexp_extract_all(line, F.lit(r.pattern), F.lit(1))
        details = F.regexp_extract_all(line, F.lit(r.pattern), F.lit(2)) if _groups(r.pattern) > 1 else F.transform(names, lambda _: F.lit(""))
        hit = line.rlike(r.pattern)
        if r.languages:
            hit = language.isin(*r.languages) & hit
        facts.append(F.when(hit, F.zip_with(names, details, fact(r.kind))))
    return F.flatten(F.array_compact(F.array(*facts)))


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def facts(files: DataFrame, rules: tuple[LineRule, ...] = RULES, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The kept columns, line (from 1), kind, name and detail of each fact in ``files`` (with language and text)."""
    lines = files.select(*keep, "language", F.posexplode(F.split("text", "\n", -1)).alias("line", "_line"))
    lines = lines.withColumn("_body", _content(F.col("_line"), F.col("language"))).filter("_body IS NOT NULL")
    found = lines.select(*keep, (F.col("line") + 1).cast("long").alias("line"), F.explode(compile_lines(rules, F.col("_body"), F.col("language"))).alias("f"))
    return found.select(*keep, "line", "f.kind", "f.name", "f.detail")
