"""Scalar functions and predicates applied to the supplied tables, by the ids of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as T


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s01_s30_measures(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select(
        "doc_id", T.token_estimate(t).alias("tokens"), T.lines_scan(t).alias("lines_scan"), T.lines_analyze(t).alias("lines_analyze"), T.content_hash(t).alias("hash")
    )


def s02_line_of_offset(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", T.line_of_offset(F.col("text"), (F.col("n_chars") / 2).cast("int")).cast("long").alias("line"))


def s06_identifiers(spark, d):
    text = F.concat(F.lit("call `load_all` then "), F.col("p_brand"), F.lit(" maxItems of part_key and "), F.regexp_replace("p_name", " ", "_"))
    return _table(spark, d, "part").select("p_partkey", F.array_join(T.identifiers(text), ",").alias("names"))


def s07_contains_word(spark, d):
    return _table(spark, d, "documents").select(
        "doc_id", T.contains_word(F.col("text"), F.lit("the")).alias("has_the"), T.contains_word(F.col("text"), F.col("lang")).alias("has_lang")
    )


def s08_s10_urls(spark, d):
    p = T.url_path(F.col("url"))
    route = F.regexp_replace(p, "/[0-9]+(?=/|$)", "/{id}")
    return _table(spark, d, "pages").select("page_id", p.alias("path"), T.endpoint(route).alias("endpoint"), T.comparison_path(F.concat(route, F.lit(".{Format}/"))).alias("comparison"))


def s11_s13_keys(spark, d):
    word = F.substring_index("p_type", " ", -1)
    return _table(spark, d, "part").select(
        "p_partkey", T.name_key(F.col("p_name")).alias("name_key"), T.singular(T.name_key(F.col("p_name"))).alias("singular"),
        T.feature_singular(F.lower(word)).alias("feature"), T.camel_to_snake(F.regexp_replace("p_brand", "#", "No")).alias("snake"),
    )


def s14_s16_features(spark, d):
    segment = F.lower(F.regexp_replace("c_mktsegment", " ", ""))
    tails = ["Service.test.ts", "_controller.py", "Store.js", "List.vue", ".cjs", "Dockerfile", "_router.go"]
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("c_nationkey") % len(tails) + 1).cast("int"))
    folder = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("src/"), segment, F.lit("/"))).otherwise(F.lit("server/Services/"))
    p = F.concat(folder, F.when(tail == "Dockerfile", F.lit("")).otherwise(F.concat(F.lit("use"), F.initcap(segment))), tail)
    return _table(spark, d, "customer").select(
        "c_custkey", P.feature_word(p).alias("word"), P.feature_key(p).alias("key"), P.role(p).alias("role"), P.is_test(p).alias("test"), P.language(p).alias("language")
    )


#: Types and rules as they are written, and what they are, worked out by hand.
KINDS = {
    "VARCHAR(20)": "string", "int unsigned": "number", "Numeric(10,2)": "number", "timestamptz": "datetime", "JSONB": "json", "bytea": "bytes", "text[]": "string",
    "geometry(Point)": "geometry", "BOOL": "bool", "List<String>": "liststring", "uuid": "uuid", "": "unknown", "EmailField": "string",
}
RULES = {
    "notNull": "required", "Min-Length(3)": "minlength", "type(email)": "email", "required": "required", "Matches(/x/)": "matches", "gte(5)": "min", "le": "max",
    "type(isUUID)": "uuid", "gt": "greater", "UniqueIndex": "unique", "type(a)(b)": "type",
}


def _nth(values: dict[str, str], n: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(n) % len(values) + 1).cast("int"))


def _nth_sql(values: dict[str, str], n: str) -> str:
    listed = ", ".join("'" + x + "'" for x in values), ", ".join("'" + x + "'" for x in values.values())
    return f"[{listed[0]}][{n} % {len(values)} + 1]", f"[{listed[1]}][{n} % {len(values)} + 1]"


def s17_type_family(spark, d):
    kind = _nth(KINDS, "p_partkey")
    return _table(spark, d, "part").select("p_partkey", kind.alias("kind"), T.type_family(kind).alias("family"))


def s18_rule_name(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.rule_name(_nth(RULES, "p_partkey")).alias("rule"))


_FAMILY_SQL = "select p_partkey, {} as kind, {} as family from part".format(*_nth_sql(KINDS, "p_partkey"))
_RULE_SQL = "select p_partkey, {} as rule from part".format(_nth_sql(RULES, "p_partkey")[1])


def s19_major_version(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.major_version(F.col("p_brand")).alias("major"))


def s20_evidence(spark, d):
    a = F.element_at(F.array(*map(F.lit, T.STATUSES)), (F.col("o_custkey") % 3 + 1).cast("int"))
    b = F.element_at(F.array(*map(F.lit, T.STATUSES)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _table(spark, d, "orders").select("o_orderkey", T.status_rank(a).alias("rank"), T.stronger(a, b).alias("stronger"))


def s21_slugs(spark, d):
    return _table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.safe_id(F.col("url"), 30).alias("safe_id"), T.portable_segment(F.col("url")).alias("segment"))


def s23_numbered(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.middle_cut(F.col("text"), 100).alias("cut"), F.sha2(T.numbered(F.col("text")), 256).alias("numbered_sha"))


def s26_redaction(spark, d):
    t = F.col("text")
    counts = T.secret_counts(t)
    return _table(spark, d, "documents").select(
        "doc_id", F.sha2(T.redact(t), 256).alias("redacted_sha"), *[F.element_at(counts, k).alias(k) for k in T.SECRETS]
    )


def s31_s32_percent_backoff(spark, d):
    return _table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", T.percent(F.col("l_quantity"), F.lit(50)).alias("pct"), T.backoff_minutes(F.lit(5.0), F.col("l_linenumber")).alias("wait")
    )


def s35_json(spark, d):
    v = F.try_parse_json("props")
    return _table(spark, d, "events").select("event_id", v.isNotNull().alias("valid"), F.get_json_object("props", "$.k").alias("k"))


def p01_exclusion(spark, d):
    path = F.substring(T.url_path(F.col("url")), F.lit(2), F.length("url"))
    return _table(spark, d, "pages").select("page_id", P.excluded(path, ["node_modules", "*.min.js", "blog/*", "a/**/z", "docs"]).alias("excluded"))


def p10_listing(spark, d):
    o = _table(spark, d, "orders").filter((F.col("o_orderstatus") == "O") & F.contains(F.lower("o_orderpriority"), F.lit("high")))
    return o.orderBy("o_orderkey").limit(5000).select("o_orderkey", "o_orderpriority")


def p12_problem(spark, d):
    texts = ["Too many requests, slow down", "Please sign in", "The context length is exceeded", "Connection lost", "All good", "captcha needed", "Message too long: quota"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % len(texts) + 1).cast("int"))
    return _table(spark, d, "events").select("event_id", T.problem_kind(t).alias("kind"))


def p13_safe_paths(spark, d):
    forms = ["a/b.txt", "../x", "a/../../x", "/etc/x", "C:\\x", "a/./b", "a/../b"]
    p = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    return _table(spark, d, "events").select("event_id", p.alias("path"), P.is_safe(p).alias("safe"))


QUERIES = {f.__name__: f for f in (
    s01_s30_measures, s02_line_of_offset, s06_identifiers, s07_contains_word, s08_s10_urls, s11_s13_keys, s14_s16_features, s17_type_family, s18_rule_name,
    s19_major_version, s20_evidence, s21_slugs, s23_numbered, s26_redaction, s31_s32_percent_backoff, s35_json, p01_exclusion, p10_listing, p12_problem, p13_safe_paths,
)}

_SINGULAR = """case when length({x}) > 3 and {x} like '%ies' then {x}[:-4] || 'y' when length({x}) > 3 and {x} like '%s' and {x} not like '%ss' then {x}[:-2] else {x} end"""
_PATH = """(select case when p = '' then '/' else p end from (select regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '\\$\\{[^}]*\\}', ':param', 'g'), '/+$', '') as p))"""
_KEY = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"

ORACLES = {
    "s01_s30_measures": """select doc_id, ceil(length(text) / 3.6::double)::bigint as tokens, (case when text = '' then 0 else len(string_split(text, chr(10))) end)::bigint as lines_scan,
  len(string_split(text, chr(10)))::bigint as lines_analyze, 'sha256:' || sha256(text) as hash from documents""",
    "s02_line_of_offset": "select doc_id, len(string_split(text[1:n_chars // 2], chr(10)))::bigint as line from documents",
    "s06_identifiers": """select p_partkey, 'load_all,maxItems,part_key' || case when contains(p_name, ' ') then ',' || regexp_extract(replace(p_name, ' ', '_'), '[a-z]+_[a-z0-9_]+') else '' end as names from part""",
    "s07_contains_word": """select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)') as has_the,
  regexp_matches(lower(text), '(^|[^a-z0-9_])' || lang || '([^a-z0-9_]|$)') as has_lang from documents""",
    "s08_s10_urls": f"""with p as (select page_id, {_PATH} as path from pages), r as (select *, regexp_replace(path, '/[0-9]+(/|$)', '/{{id}}\\1') as r1 from p),
  q as (select *, regexp_replace(regexp_replace(r1, '/[0-9]+(/|$)', '/{{id}}\\1', 'g'), '(^|/)\\{{[^}}/]+\\}}', '\\1:param', 'g') as endpoint from r)
  select page_id, path, endpoint, replace(lower(endpoint), ':param', ':p') || '.:p' as comparison from q""",
    "s11_s13_keys": f"""with k as (select *, {_KEY.format(x='p_name')} as k, lower(string_split(p_type, ' ')[-1]) as w from part)
  select p_partkey, k as name_key, {_SINGULAR.format(x='k')} as singular, case when regexp_matches(w, '(ss|us|is|os|as)$') then w else {_SINGULAR.format(x='w')} end as feature,
  lower(regexp_replace(regexp_replace(replace(p_brand, '#', 'No'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')) as snake from k""",
    "s14_s16_features": """with c as (select c_custkey, replace(lower(c_mktsegment), ' ', '') as seg, c_nationkey % 7 as k, c_custkey % 2 = 0 as own from customer)
  select c_custkey, case k when 5 then 'dockerfile' else seg end as word, case when own then seg when k = 5 then 'dockerfile' else seg end as key,
  case when k in (0) then 'test' when k = 6 then 'route' when k = 1 and own then 'controller' when not own and k <> 1 then 'service' when not own then 'controller' when k = 2 then 'state' when k = 3 then 'component' else 'other' end as role,
  k = 0 as test, ['typescript', 'python', 'javascript', 'vue', 'javascript', 'dockerfile', 'go'][k + 1] as language from c""",
    "s17_type_family": _FAMILY_SQL,
    "s18_rule_name": _RULE_SQL,
    "s19_major_version": "select p_partkey, regexp_extract(p_brand, '[0-9]+')::int as major from part",
    "s20_evidence": """with s as (select o_orderkey, o_custkey % 3 as a, o_orderkey % 3 as b from orders)
  select o_orderkey, a::int as rank, ['UNKNOWN', 'INFERRED', 'VERIFIED'][greatest(a, b) + 1] as stronger from s""",
    "s21_slugs": """with s as (select page_id, url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from pages)
  select page_id, slug, substr(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 30) as safe_id, substr(slug, 1, 40) || '-' || substr(sha1(url), 1, 8) as segment from s""",
    "s23_numbered": """select doc_id, case when length(text) > 100 then text[1:70] || '...' || text[-25:] else text end as cut,
  sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: repeat(' ', greatest(0, 4 - length(i::varchar))) || i::varchar || '| ' || x), chr(10))) as numbered_sha from documents""",
    "s26_redaction": """with p as (select doc_id, text, '-----BEGIN [A-Z ]*PRIVATE KEY-----' as p1, 'AKIA[0-9A-Z]{16}' as p2, '(?:sk|pk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,}' as p3,
  '(?i)(?:password|passwd|pwd|secret|api_key|apikey)[ ]*[=:][ ]*[^ \\n]{4,}' as p4, '[a-z][a-z0-9+]*://[^ /:@]+:[^ /@]+@' as p5, '[REDACTED_SECRET]' as m from documents)
  select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, p1, m, 'g'), p2, m, 'g'), p3, m, 'g'), p4, m, 'g'), p5, m, 'g')) as redacted_sha,
  len(regexp_extract_all(text, p1))::bigint as private_key, len(regexp_extract_all(text, p2))::bigint as aws_key, len(regexp_extract_all(text, p3))::bigint as token,
  len(regexp_extract_all(text, p4))::bigint as password, len(regexp_extract_all(text, p5))::bigint as url_credentials from p""",
    "s31_s32_percent_backoff": "select l_orderkey, l_linenumber, round(100.0 * l_quantity / 50)::bigint as pct, least(75.0, 5.0 * pow(2, least(l_linenumber - 1, 4)))::double as wait from lineitem",
    "s35_json": "select event_id, json_valid(props) as valid, json_extract_string(props, '$.k') as k from events",
    "p01_exclusion": f"""select page_id, regexp_matches(lower({_PATH}[2:]), '(^|/)node_modules(/|$)|(^|/)[^/]*\\.min\\.js(/|$)|^blog/[^/]*$|^a/.*/z$|(^|/)docs(/|$)') as excluded from pages""",
    "p10_listing": "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' and contains(lower(o_orderpriority), 'high') order by o_orderkey limit 5000",
    "p12_problem": "select event_id, ['LIMIT', 'LOGIN', 'CONTEXT_TOO_LARGE', 'NETWORK', null, 'CAPTCHA', 'LIMIT'][event_id % 7 + 1] as kind from events",
    "p13_safe_paths": """select event_id, ['a/b.txt', '../x', 'a/../../x', '/etc/x', 'C:\\x', 'a/./b', 'a/../b'][event_id % 7 + 1] as path,
  [true, false, false, false, false, true, true][event_id % 7 + 1] as safe from events""",
}
