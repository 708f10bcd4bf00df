"""Scalar functions over names, paths, urls and texts. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.6


def token_estimate(text: Column) -> Column:
    """Code points over 3.6, rounded up; a null or empty text has none."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(CHARS_PER_TOKEN).cast("double")).cast("long")


def lines_scan(text: Column) -> Column:
    """Lines as a scanner counts them: an empty text has none, a trailing newline adds one."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")


def lines_analyze(text: Column) -> Column:
    """Lines as an analyzer counts them: an empty text has one."""
    return F.size(F.split(text, "\n", -1)).cast("long")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def line_of_offset(text: Column, offset: Column) -> Column:
    """Line number, from 1, of a code point's offset, from 0."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def url_path(url: Column) -> Column:
    """Path of a url: without scheme and host, query, fragment, template variables and trailing slash."""
    p = F.regexp_replace(url, r"^[a-z]+://[^/]*", "")
    p = F.regexp_replace(F.regexp_replace(p, r"[?#].*$", ""), r"\$\{[^}]*\}", ":param")
    p = F.regexp_replace(p, r"/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


#: The ways in which routes write a parameter, each as one path segment.
PARAMETERS = (r"\{[^}/]+\}", r"<[^>/]+>", r":[A-Za-z_][A-Za-z0-9_]*\*?", r"\[[^\]/]+\]", r"\*[A-Za-z_][A-Za-z0-9_]*")


def endpoint(path: Column) -> Column:
    """A route's path with every parameter as ``:param``."""
    for p in PARAMETERS:
        path = F.regexp_replace(path, f"(^|/){p}", "$1:param")
    return path


#: A parameter anywhere in a path: a whole segment or a part of one.
ANY_PARAMETER = r":[a-z_][a-z0-9_]*|\{[^}]+\}|\[[^\]]+\]|<[^>]+>|\*[a-z0-9_]*"


def comparison_path(path: Column) -> Column:
    """Lower case, every parameter as ``:p``, no slash at the end: equal for routes that only name parameters differently."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(path), ANY_PARAMETER, ":p"), "/+$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def name_key(name: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def singular(word: Column) -> Column:
    """English singular of a key of over three letters: ies -> y, a plain s goes, ss stays."""
    long = F.length(word) > 3
    return (
        F.when(long & F.endswith(word, F.lit("ies")), F.regexp_replace(word, "ies$", "y"))
        .when(long & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def feature_singular(word: Column) -> Column:
    """As ``singular``, but words in ss, us, is, os and as stay."""
    return F.when(word.rlike("(ss|us|is|os|as)$"), word).otherwise(singular(word))


def camel_to_snake(name: Column) -> Column:
    s = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1_$2"))


def camel_to_kebab(name: Column) -> Column:
    return F.regexp_replace(camel_to_snake(name), "_", "-")


#: Spellings of column types by family.
TYPE_FAMILIES = {
    "string": (
        "string", "str", "char", "varchar", "nvarchar", "text", "longtext", "mediumtext", "tinytext", "email", "slug", "url", "charfield", "textfield", "emailfield", "enum",
        "citext", "symbol",
    ),
    "number": (
        "number", "int", "integer", "bigint", "smallint", "tinyint", "mediumint", "uint", "serial", "bigserial", "numeric", "decimal", "float", "double", "real", "money",
        "integerfield", "floatfield", "decimalfield", "autofield", "bigautofield", "biginteger", "positiveinteger", "int32", "int64", "float32", "float64", "long", "short",
    ),
    "bool": ("bool", "boolean", "bit", "booleanfield"),
    "datetime": ("date", "datetime", "timestamp", "timestamptz", "time", "datefield", "datetimefield", "timestamps", "instant", "localdatetime"),
    "uuid": ("uuid", "guid", "uuidfield"),
    "json": ("json", "jsonb", "object", "dict", "map", "mixed", "jsonfield", "hstore"),
    "bytes": ("blob", "bytea", "bytes", "binary", "byte", "varbinary", "buffer"),
}


def type_family(kind: Column) -> Column:
    """Family of a column type, its size, brackets and sign left out; the bare type where none is known, ``unknown`` of nothing."""
    given = F.when(F.coalesce(kind, F.lit("")) == "", F.lit("unknown")).otherwise(kind)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(given), r"(?s)\(.*$", ""), r"[\s\[\]<>*]", ""), r"unsigned$", "")
    table = F.create_map(*[F.lit(x) for family, names in TYPE_FAMILIES.items() for name in names for x in (name, family)])
    return F.coalesce(F.try_element_at(table, bare), bare)


#: Other names of validation rules.
RULE_ALIASES = {
    "notnull": "required", "notempty": "required", "isnotempty": "required", "notblank": "required", "nonempty": "required",
    "gte": "min", "ge": "min", "minvalue": "min", "minvaluevalidator": "min", "lte": "max", "le": "max", "maxvalue": "max", "maxvaluevalidator": "max",
    "minlength": "minlength", "minlen": "minlength", "length": "length", "uniqueindex": "unique", "isemail": "email", "emailvalidator": "email",
    "isurl": "url", "isuuid": "uuid", "gt": "greater", "lt": "less", "maxlength": "maxlength", "maxlen": "maxlength",
}


def rule_name(rule: Column) -> Column:
    """Canonical name of a validation rule; ``type(x)`` is x, other arguments are left out."""
    whole = r"^type\(([^)]*)\)$"
    bare = name_key(F.when(rule.rlike(whole), F.regexp_extract(rule, whole, 1)).otherwise(F.regexp_replace(rule, r"(?s)\(.*$", "")))
    table = F.create_map(*[F.lit(x) for kv in RULE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, bare), bare)


def major_version(version: Column) -> Column:
    return F.nullif(F.regexp_extract(version, r"(\d+)", 1), F.lit("")).cast("int")


#: Ranks of evidence.
STATUSES = ("UNKNOWN", "INFERRED", "VERIFIED")


def status_rank(status: Column) -> Column:
    """2 verified, 1 inferred, 0 for all else."""
    return F.when(status == "VERIFIED", 2).when(status == "INFERRED", 1).otherwise(0)


def stronger(a: Column, b: Column) -> Column:
    """The status of higher rank; the first on a tie."""
    return F.when(status_rank(b) > status_rank(a), b).otherwise(a)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_id(text: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), 1, most)


def portable_segment(text: Column) -> Column:
    """A file name that differs for names which only differ in what is replaced."""
    return F.concat(F.substring(slug(text), 1, 40), F.lit("-"), F.substring(F.sha1(text), 1, 8))


def middle_cut(text: Column, most: int) -> Column:
    """At most ``most`` code points: 70 % from the start, 25 % from the end, a mark between."""
    head, tail = int(most * 0.7), int(most * 0.25)
    cut = F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > most, cut).otherwise(text)


def numbered(text: Column) -> Column:
    """Every line with its number, at least four wide, and a bar."""

    def line(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 4 - F.length(n))), n, F.lit("| "), x)

    lines = F.transform(F.split(text, "\n", -1), line)
    return F.array_join(lines, "\n")


def percent(part: Column, whole: Column) -> Column:
    """Rounded share of a hundred; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole)).otherwise(F.lit(0.0)).cast("long")


def backoff_minutes(base: Column, attempt: Column) -> Column:
    """base doubled by attempt, at most 16 times and 15 bases."""
    return F.least(base * 15, base * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(4))))


def contains_word(text: Column, word: Column) -> Column:
    """Whether ``word`` stands in ``text`` between characters that are no letters, digits or underscores, in any case."""
    pattern = F.concat(F.lit(r"(^|[^a-z0-9_])"), F.regexp_replace(F.lower(word), r"([^a-z0-9_])", r"\\$1"), F.lit(r"([^a-z0-9_]|$)"))
    return F.regexp_like(F.lower(text), pattern)


#: Our own patterns of secrets and the names of what they find.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "token": r"(sk|pk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,}",
    "password": r"(?i)(password|passwd|pwd|secret|api_key|apikey)[ ]*[=:][ ]*[^ \n]{4,}",
    "url_credentials": r"[a-z][a-z0-9+]*://[^ /:@]+:[^ /@]+@",
}
MARK = "[REDACTED_SECRET]"


#: What a text holds, in lower case, wherever a pattern matches: looked for first, as most texts have none of it.
HINTS = {
    "private_key": ("-----begin ",), "aws_key": ("akia",), "token": ("sk-", "sk_", "pk-", "pk_", "ghp-", "ghp_", "xoxb-", "xoxb_"),
    "password": ("password", "passwd", "pwd", "secret", "api_key", "apikey"), "url_credentials": ("://",),
}


def _hinted(text: Column, kind: str) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for hint in HINTS[kind]:
        out = out | F.contains(low, F.lit(hint))
    return out


def redact(text: Column) -> Column:
    for kind, p in SECRETS.items():
        text = F.when(_hinted(text, kind), F.regexp_replace(text, p, MARK)).otherwise(text)
    return text


def secret_counts(text: Column) -> Column:
    """Findings by kind, as a map."""
    counts = {k: F.when(_hinted(text, k), F.regexp_count(text, F.lit(p))).otherwise(F.lit(0)).cast("long") for k, p in SECRETS.items()}
    return F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.when(text.isNotNull(), n))])


def identifiers(text: Column) -> Column:
    """The first 8 distinct words of prose that look like names in code: quoted first, then snake and camel case."""
    quoted = F.regexp_extract_all(text, F.lit("`([A-Za-z_][A-Za-z0-9_.]{2,})`"), F.lit(1))
    named = F.regexp_extract_all(text, F.lit("([a-z]+_[a-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]+|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(quoted, named)), 1, 8)


#: What a provider's page says when it has a problem, by code, in order.
PROBLEMS = (
    ("LIMIT", r"usage (?:cap|limit)|reached (?:the |your )?(?:current )?(?:message |usage )?limit|message limit|out of (?:free )?messages|too many requests|rate limit|quota|try again (?:later|in)|come back (?:later|at)"),
    ("CONTEXT_TOO_LARGE", r"message (?:is )?too long|too long|input (?:is )?too large|exceeds? the (?:maximum )?(?:context|length)|context (?:length|window)|prompt is too long"),
    ("LOGIN", r"log ?in to continue|sign ?in to continue|please (?:log|sign) ?in|session (?:has )?expired"),
    ("CAPTCHA", r"verify you are (?:a )?human|captcha|unusual activity"),
    ("NETWORK", r"network error|something went wrong|an error occurred|failed to (?:generate|fetch|load)|connection (?:lost|error)|couldn['’]t (?:generate|complete)"),
)


def problem_kind(text: Column) -> Column:
    """Code of the first problem that a message names, in any case; else null."""
    out = F
    for code, pattern in PROBLEMS:
        out = out.when(text.rlike(f"(?i){pattern}"), code)
    return out


def find_json(text: Column) -> Column:
    """The parts of a fenced block marked json, or else the text itself: candidates to parse."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)```"), F.lit(1))
    return F.when(F.size(fenced) > 0, fenced).otherwise(F.array(text))


def readable_route(pattern: Column) -> Column:
    """A route written as a regular expression as a path: anchors go, each group is a parameter by its name."""
    s = F.regexp_replace(F.regexp_replace(pattern, r"^\^", ""), r"\$$", "")
    s = F.regexp_replace(s, r"\(\?P?<(\w+)>[^)]*\)", ":$1")
    return F.regexp_replace(F.regexp_replace(s, r"\([^?)][^)]*\)", ":param"), r"\\(.)", "$1")


def replace_once(text: Column, find: Column, put: Column) -> Column:
    """The text with its one occurrence of ``find`` replaced; null if it has none or several."""
    n = F.floor((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find))
    return F.when((F.length(find) > 0) & (n == 1), F.replace(text, find, put))


def offline_wait(base: Column) -> Column:
    """Milliseconds before the next try without a connection: half as long again, 30 seconds at most."""
    return F.least(F.lit(30000.0), base * 1.5)
