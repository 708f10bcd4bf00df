"""Predicates and classes of paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by extension.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "vue": "vue", "svelte": "svelte",
    "py": "python", "php": "php", "rb": "ruby", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "rs": "rust", "swift": "swift", "dart": "dart",
    "sql": "sql", "prisma": "prisma", "proto": "protobuf", "kts": "kotlin", "graphql": "graphql", "gql": "graphql",
    "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "xml": "xml", "ini": "ini",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "less": "less", "md": "markdown", "sh": "shell", "env": "env", "properties": "properties",
}
#: Language by whole name; names that begin with .env are env.
SPECIAL = {"Dockerfile": "dockerfile", "Makefile": "makefile"}
#: Languages of source files.
SOURCE = ("javascript", "typescript", "vue", "svelte", "python", "php", "ruby", "go", "java", "kotlin", "csharp", "rust", "swift", "dart")
#: Extensions of files that are not text.
BINARY = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "svg", "pdf", "zip", "gz", "tar", "tgz", "rar", "7z",
    "woff", "woff2", "ttf", "eot", "otf", "mp3", "mp4", "mov", "avi", "wav", "exe", "dll", "so", "dylib", "class", "jar",
    "pyc", "lock", "map", "psd", "sqlite", "db",
)
MOST_TEXT = 2 * 1024 * 1024
MOST_ANALYZED = 1024 * 1024


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """By special name or extension; ``unknown`` for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv])
    name = basename(path)
    by_name = F.coalesce(F.try_element_at(names, name), F.when(F.startswith(name, F.lit(".env")), F.lit("env")))
    return F.coalesce(by_name, F.try_element_at(table, extension(path)), F.lit("unknown"))


def is_source(path: Column) -> Column:
    return language(path).isin(*SOURCE)


def is_analysable(path: Column, size: Column, api_description: Column) -> Column:
    """Whether a file is analysed: no binary by its name, 1 MiB at most, in a source language or an API description."""
    return ~extension(path).isin(*BINARY) & (size <= MOST_ANALYZED) & (is_source(path) | F.coalesce(api_description, F.lit(False)))


#: Fixed value: paths of tests.
TEST = r"(^|/)(__tests__|tests?|spec|e2e)/|\.(test|spec)\.[a-z]+$|(^|/)test_[\w]+\.py$|_test\.(go|py|rb)$|Test\.(java|php)$"


def is_test(path: Column) -> Column:
    return path.rlike(TEST)


def is_binary(path: Column, size: Column, content: Column) -> Column:
    """By extension, or size, or a NUL byte."""
    return extension(path).isin(*BINARY) | (size > MOST_TEXT) | F.contains(F.decode(content, "ISO-8859-1"), F.lit("\x00"))


#: Roles by path, the first that matches; (?i) where case does not matter.
ROLES = (
    ("test", r"(^|/)(__tests__|tests?|spec|e2e)/|\.(test|spec)\.[a-z]+$|(^|/)test_\w+\.py$"),
    ("migration", r"(^|/)(migrations?|seeds?)/"),
    ("model", r"(?i)(^|/)(models?|entities|schemas?)/|\.(model|entity)\.[a-z]+$|Model\.[a-z]+$|(^|/)(models?|schemas?|serializers?)\.py$|_models?\.(go|py)$"),
    ("controller", r"(?i)(^|/)(controllers?|handlers?)/|\.controller\.[a-z]+$|Controller\.[a-z]+$|(^|/)views?\.py$|_views?\.py$|(^|/|_)handlers?\.go$|_controllers?\.(go|py)$"),
    ("route", r"(?i)(^|/)(routes?|routers?)/|\.routes?\.[a-z]+$|Routes?\.[a-z]+$|(^|/)pages/api/|(^|/)app/.*route\.[a-z]+$|(^|/)urls\.py$|(^|/|_)routes?\.(py|go)$|(^|/|_)routers?\.(py|go)$"),
    ("repository", r"(?i)(^|/)(repositor(y|ies)|dao)/|Repository\.[a-z]+$|(^|/|_)repositor(y|ies)\.(py|go)$"),
    ("service", r"(?i)(^|/)(services?)/|\.service\.[a-z]+$|Service\.[a-z]+$|(^|/|_)services?\.(py|go)$"),
    ("middleware", r"(?i)(^|/)middlewares?/|\.middleware\.[a-z]+$|Middleware\.[a-z]+$|(^|/|_)middlewares?\.(py|go)$"),
    ("state", r"(?i)(^|/)(store|stores|state|redux|context|contexts)/|(Slice|Store|Reducer|Context)\.[a-z]+$"),
    ("hook", r"(^|/)hooks?/|(^|/)use[A-Z]\w*\.[jt]sx?$"),
    ("component", r"(^|/)(components?|widgets?|views?)/|\.(jsx|tsx|vue|svelte)$"),
    ("page", r"(^|/)(pages|screens|app)/"),
    ("api-client", r"(?i)(^|/)(api|clients?)/|Api\.[a-z]+$"),
    ("util", r"(^|/)(utils?|helpers?|lib|common|shared)/"),
    ("config", r"(?i)(^|/)(config|configs)/|\.config\.[a-z]+$|(^|/)(config|settings)\.(go|py)$"),
)


def role(path: Column) -> Column:
    out = F
    for name, pattern in ROLES:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise("other")


#: Fixed value: names of files that start a program.
ENTRY = r"(?i)^(index|main|app|server|manage|wsgi|asgi|program|application)\.[a-z]+$"


def is_entry(path: Column, dependents: Column) -> Column:
    """A conventional name, and either nothing depends on it or it lies at most one folder deep."""
    return basename(path).rlike(ENTRY) & ((F.coalesce(dependents, F.lit(0)) == 0) | (F.size(F.split(path, "/")) <= 2))


#: Configuration files by base name, the first that matches.
CONFIGS = (
    ("lint", r"^(\.eslintrc.*|eslint\.config\..*)$"),
    ("format", r"^(\.prettierrc.*|prettier\.config\..*)$"),
    ("build-or-test", r"^(webpack|vite|rollup|esbuild|next|nuxt|vue|angular|babel|jest|vitest|playwright|cypress)\.config\..*$"),
    ("compiler", r"^(tsconfig|jsconfig)\.json$"),
    ("deployment", r"^(Dockerfile|docker-compose\.ya?ml|compose\.ya?ml)$"),
    ("deployment", r"^(vercel\.json|netlify\.toml|serverless\.ya?ml|firebase\.json|app\.yaml|Procfile|fly\.toml)$"),
    ("ci", r"^(\.gitlab-ci\.yml|Jenkinsfile|azure-pipelines\.yml|\.travis\.yml|bitbucket-pipelines\.yml)$"),
    ("environment", r"^\.env(\..*)?$"),
    ("database", r"^(schema\.prisma|knexfile\..*|ormconfig\..*|sequelize\.config\..*|\.sequelizerc)$"),
    ("framework", r"^(wp-config\.php|artisan|manage\.py|settings\.py|application\.(properties|ya?ml)|appsettings.*\.json)$"),
)


def config_kind(path: Column) -> Column:
    """Kind of a configuration file, the first that matches; files of the workflow folder are ci; else null."""
    out = F.when(F.startswith(path, F.lit(".github/workflows/")), "ci")
    for kind, pattern in CONFIGS:
        out = out.when(basename(path).rlike(pattern), kind)
    return out


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**`` is anything, ``*`` anything but a slash, ``?`` one character."""
    out = ""
    for part in re.split(r"(\*\*|\*|\?)", glob):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return out


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path is excluded, in any case: a bare name is any segment, ``a/b`` a leading path, a glob without a slash
    any segment, a glob with one the whole path."""
    parts = []
    for p in patterns:
        body = glob_pattern(p.strip("/").lower())
        if "*" in p or "?" in p:
            parts.append(f"^{body}$" if "/" in p.strip("/") else f"(^|/){body}(/|$)")
        else:
            parts.append(f"^{body}(/|$)" if "/" in p.strip("/") else f"(^|/){body}(/|$)")
    return F.lower(path).rlike("|".join(f"(?:{x})" for x in parts)) if parts else F.lit(False)


def is_safe(path: Column) -> Column:
    """Whether a path stays inside its root: not absolute, no drive, no NUL, never above the root on its way."""
    bad = path.rlike(r"^(/|\\|[A-Za-z]:)") | F.contains(path, F.lit("\x00"))
    depth = F.aggregate(
        F.split(F.regexp_replace(path, r"\\", "/"), "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda acc, s: F.struct(
            (acc["at"] + F.when(s == "..", -1).when((s == ".") | (s == ""), 0).otherwise(1)).alias("at"),
            F.least(acc["least"], acc["at"] + F.when(s == "..", -1).otherwise(0)).alias("least"),
        ),
    )
    return ~bad & (depth["least"] >= 0)


def ancestors(path: Column) -> Column:
    """Every folder above a path, the nearest last; none for a path without a slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )


#: What the parts of a file name say about its role, not about its feature.
MARKS = r"(?i)[_-](controllers?|services?|models?|routes?|routers?|repositor(?:y|ies)|handlers?|views?|serializers?|schemas?|apis?|stores?|forms?|dto|entity|entities|tests?)(?=\.|$)"
SUFFIX = r"(Controller|Service|Model|Routes?|Router|Repository|Store|Slice|Reducer|Context|Page|Form|List|Card|View|Screen|Api|Client|Hook|Modal|Table|Container|Provider|Schema|Entity|Dto|Guard|Middleware|Handler)s?$"


def feature_word(path: Column) -> Column:
    """What a file is about, from its name: without extension, test marks, role suffixes and hook prefix, in kebab case."""
    s = F.regexp_replace(basename(path), MARKS, "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\.(test|spec)\.[a-z]+$", ""), r"^test_", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\.[a-z]+$", ""), r"^use(?=[A-Z])", "")
    s = F.regexp_replace(F.regexp_replace(s, SUFFIX, ""), r"([a-z0-9])([A-Z])", "$1-$2")
    return F.regexp_replace(F.lower(F.regexp_replace(s, r"[_\s.]+", "-")), r"^-|-$", "")


#: Folders that hold all features of a kind.
CONTAINERS = (
    "components", "pages", "features", "modules", "routes", "controllers", "services", "models", "views", "screens", "store", "stores", "hooks", "api", "apis", "app", "src", "lib",
    "server", "client", "backend", "frontend", "utils", "helpers", "entities", "repositories", "middleware", "middlewares", "handlers", "tests", "test", "__tests__", "internal",
    "pkg", "cmd", "handler", "routers", "router", "repository", "domain", "usecase", "usecases", "entity", "dto", "schemas", "serializers", "templates", "static", "migrations",
    "config", "common", "shared",
)


def feature_key(path: Column, roots: Column | None = None) -> Column:
    """The first of ``roots`` (an array of folders) above the file, else its first folder that is no mere container, else its word; null of a start file."""
    folders = F.filter(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), lambda x: ~F.lower(x).isin(*CONTAINERS))
    word = feature_word(path)
    named = F.when((word != "") & ~word.isin("index", "app", "main", "server"), word)
    own = F.when(F.size(folders) > 0, feature_word(F.get(folders, F.lit(0)))).otherwise(named)
    if roots is None:
        return own
    root = F.get(F.filter(roots, lambda r: F.startswith(path, F.concat(r, F.lit("/")))), F.lit(0))
    return F.coalesce(feature_word(root), own)
