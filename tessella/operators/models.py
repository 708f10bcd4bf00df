"""Fields of data models and their validation rules in languages that declare them line by line.

A table has, for each language, the pattern of a field's line, what makes a class a model, and what makes a field required
or unique. Annotations in the lines above belong to the line below them. Everything is one projection over exploded lines
and joins by file.

Defined results for odd input: a null text declares nothing; a field outside any model is dropped; a type that is no known
model refers to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators.code import _lines, symbols

ANNOTATION = r"^\s*(@\w+(\([^)]*\))?|\[[A-Z][^\]]*\]|#\[[^\]]*\])\s*$"


@dataclass(frozen=True)
class Model:
    """``field``: the pattern of a field's line; groups of its name, its type and the rest. ``marked``: what stands above a model."""

    language: str
    field: str
    name: int
    kind: int
    marked: str | None
    required: str
    unique: str
    optional: str | None = None  # a type that a missing value may have: others are required


MODELS = (
    Model("java", r"^\s*(?:private|protected|public)\s+(?:final\s+)?([\w<>\[\]]+)\s+(\w+)\s*(?:=[^;]*)?;", 2, 1, r"@(Entity|Table|Document)\b", r"@Not(Null|Blank|Empty)\b|nullable\s*=\s*false|optional\s*=\s*false", r"unique\s*=\s*true"),
    Model("csharp", r"^\s*public\s+(?:virtual\s+)?([\w<>?\[\]]+)\s+(\w+)\s*\{\s*get;", 2, 1, r"\[Table\b", r"\[Required\b", r"IsUnique\s*=\s*true"),
    Model("go", r"^\s+([A-Z]\w*)\s+([*\[\]\w.]+)\s*(?:`[^`]*`)?\s*$", 1, 2, None, r"not null|[\",]required", r"unique"),
    Model("rust", r"^\s*(?:pub\s+)?(\w+)\s*:\s*([\w<>:]+)\s*,?\s*$", 1, 2, r"Queryable|Insertable|Identifiable|FromRow|DeriveEntityModel", r"(?!)", r"#\[sea_orm\([^\]]*unique", r"^Option<"),
    Model("ruby", r"^\s*t\.(\w+)\s+[\"':](\w+)", 2, 1, None, r"null:\s*false", r"unique:\s*true"),
    Model("prisma", r"^\s+(\w+)\s+(\w+(?:\[\]|\?)?)", 1, 2, None, r"(?!)", r"@unique|@id", r"\?$|\[\]$"),
)
#: How each language names rules; the first group is the rule.
RULES = {
    "java": r"@(NotNull|NotBlank|NotEmpty|Size|Min|Max|Email|Pattern|Past|Future|Positive)\b", "csharp": r"\[(Required|StringLength|MaxLength|MinLength|Range|EmailAddress|RegularExpression|Phone|Url|Compare)\b",
    "rust": r"[(, ](email|url|length|range|regex|custom|phone)\b",
}


def annotated(files: DataFrame) -> DataFrame:
    """path, language, line, body and above: each line that is no annotation, with those directly above it."""
    lines = _lines(files)
    mark = F.col("body").rlike(ANNOTATION)
    count = F.sum(F.when(mark, 0).otherwise(1)).over(Window.partitionBy("path").orderBy("line"))
    grouped = lines.withColumn("mark", mark).withColumn("block", F.when(F.col("mark"), count + 1).otherwise(count))
    out = grouped.groupBy("path", "language", "block").agg(
        F.max(F.when(~F.col("mark"), F.struct("line", "body"))).alias("own"), F.array_sort(F.collect_list(F.when(F.col("mark"), F.struct("line", "body")))).alias("marks")
    )
    above = F.array_join(F.transform(F.array_compact("marks"), lambda m: m["body"]), " ")
    return out.filter("own IS NOT NULL").select("path", "language", "own.line", "own.body", above.alias("above"))


def _in_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (path, line) with the name of the innermost class around each."""
    spans = classes.select(F.col("file").alias("path"), "name", F.col("line").alias("_from"), "end")
    met = rows.join(spans, "path").filter((F.col("_from") < F.col("line")) & (F.col("line") <= F.col("end")))
    keys = [c for c in rows.columns]
    return met.groupBy(*keys).agg(F.max_by("name", "_from").alias("entity"))


def _classes(files: DataFrame) -> DataFrame:
    return symbols(files).filter("kind IN ('class', 'table')")


def declared_fields(files: DataFrame) -> DataFrame:
    """path, entity, field, type, required, is_unique and refers_to of each field of a model."""
    lines = annotated(files)
    classes = _classes(files)
    heads = lines.select(F.col("path").alias("file"), "line", "above", "language")
    sets = _lines(files).select(F.explode(F.regexp_extract_all("body", F.lit(r"\bDbSet<(\w+)>"), F.lit(1))).alias("name")).distinct().withColumn("listed", F.lit(True))
    named = classes.join(heads, ["file", "line"], "left").join(sets, "name", "left")
    found, is_model = None, F.lit(False)
    for m in MODELS:
        own = lines.filter((F.col("language") == m.language) & F.col("body").rlike(m.field))
        text = F.concat_ws(" ", "above", "body")
        kind = F.regexp_extract("body", m.field, m.kind)
        required = text.rlike(m.required) if m.optional is None else ~kind.rlike(m.optional)
        part = own.select("path", "language", "line", F.regexp_extract("body", m.field, m.name).alias("field"), kind.alias("type"), required.alias("required"), text.rlike(m.unique).alias("is_unique"), text.rlike(r"\b(gorm|db):\"").alias("_tagged"))
        found = part if found is None else found.unionByName(part)
        marked = F.col("above").rlike(m.marked) | F.coalesce("listed", F.lit(False)) if m.marked else F.lit(True)
        is_model = is_model | ((F.col("language") == m.language) & marked)
    found = _in_class(found, named.filter(is_model))
    # A struct is a model if one of its fields has a column tag.
    tagged = F.max("_tagged").over(Window.partitionBy("path", "entity"))
    found = found.withColumn("_any", tagged).filter("language <> 'go' OR _any")
    known = found.select(F.lower("entity").alias("_key"), F.col("entity").alias("_to")).distinct()
    bare = F.lower(F.regexp_replace("type", r"^[*\[\]]+|^\w+<|>$|\?$|\[\]$", ""))
    met = found.join(known, bare == F.col("_key"), "left")
    refers = F.when(F.col("type").isin("references", "belongs_to"), F.col("field")).otherwise(F.col("_to"))
    return met.select("path", "entity", "field", "type", "required", "is_unique", refers.alias("refers_to"))


def validation_rules(files: DataFrame) -> DataFrame:
    """path, entity (null outside a class), field and canonical rule of each validation."""
    lines = annotated(files)
    text = F.concat_ws(" ", "above", "body")
    parts = []
    for m in MODELS:
        if m.language in RULES:
            rules = F.regexp_extract_all(text, F.lit(RULES[m.language]), F.lit(1))
            parts.append(lines.filter((F.col("language") == m.language) & F.col("body").rlike(m.field)).select("path", "line", F.array(F.regexp_extract("body", m.field, m.name)).alias("fields"), rules.alias("rules")))
    go = next(m for m in MODELS if m.language == "go")
    tags = F.split(F.regexp_extract("body", r"\b(?:binding|validate):\"([^\"]*)\"", 1), ",")
    parts.append(lines.filter((F.col("language") == "go") & F.col("body").rlike(go.field)).select("path", "line", F.array(F.regexp_extract("body", go.field, 1)).alias("fields"), F.transform(tags, lambda x: F.substring_index(x, "=", 1)).alias("rules")))
    names = F.regexp_extract_all(F.regexp_extract("body", r"^\s*validates\s+((?::\w+\s*,\s*)+)", 1), F.lit(r":(\w+)"), F.lit(1))
    keys = F.regexp_extract_all(F.regexp_replace(F.regexp_extract("body", r"^\s*validates\s+(?::\w+\s*,\s*)+(.*)$", 1), r"\{[^}]*\}", ""), F.lit(r"(\w+):"), F.lit(1))
    parts.append(lines.filter((F.col("language") == "ruby") & F.col("body").rlike(r"^\s*validates\s")).select("path", "line", names.alias("fields"), keys.alias("rules")))
    laravel = r"['\"](\w+)['\"]\s*=>\s*['\"]([a-z_]+(?::[^'\"|]*)?(?:\|[^'\"]*)?)['\"]"
    piped = F.transform(F.split(F.regexp_extract("body", laravel, 2), r"\|"), lambda x: F.substring_index(x, ":", 1))
    parts.append(lines.filter((F.col("language") == "php") & F.col("body").rlike(laravel)).select("path", "line", F.array(F.regexp_extract("body", laravel, 1)).alias("fields"), piped.alias("rules")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    one = out.select("path", "line", F.explode("fields").alias("field"), "rules").select("path", "line", "field", F.explode("rules").alias("rule")).filter("rule <> ''").distinct()
    inside = _in_class(one, _classes(files))
    met = one.join(inside, ["path", "line", "field", "rule"], "left")
    return met.select("path", "entity", "field", T.rule_name(F.col("rule")).alias("rule")).distinct()


def technology_signs(files: DataFrame) -> DataFrame:
    """Database technologies and the first path and line that shows each."""
    lines = _lines(files)
    signs = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), F.lit(name)) for name, p in SIGNS.items()]))
    found = lines.select("path", "line", F.explode(signs).alias("technology"))
    return found.groupBy("technology").agg(F.min(F.struct("path", "line")).alias("x")).select("technology", "x.path", "x.line")


#: What shows the use of a database, our own list.
SIGNS: dict[str, str] = {
    "django-orm": r"\bfrom django\.db import\b", "gorm": r"gorm\.io/|\bgorm:\"", "jpa": r"\b(javax|jakarta)\.persistence\b", "entity-framework": r"\bDbSet<|\bDbContext\b", "activerecord": r"\bApplicationRecord\b|\bActiveRecord::",
    "prisma": r"\bPrismaClient\b|^\s*model\s+\w+\s*\{", "diesel": r"\bdiesel::", "sql": r"(?i)\bcreate\s+table\b",
}
