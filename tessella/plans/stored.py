"""Knowledge and documents that are kept: checked claims reconciled with a store, versions, orders of dependencies, lists cut to fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import compare as C
from tessella.operators import graph as G
from tessella.operators import joins as J
from tessella.operators import orders as D
from tessella.operators import packing as P
from tessella.operators import reconcile as R
from tessella.operators import versions as V
from tessella.operators import workflows as W


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def m10_fields(spark, d):
    """Languages that labels claim for a document's source, against those it is known to have, and the text as evidence."""
    docs = _t(spark, d, "documents")
    known = docs.groupBy(F.col("source").alias("entity"), F.col("lang").alias("field")).agg(F.when(F.count("*") > 60, "often").otherwise("seldom").alias("type"))
    labelled = docs.join(_t(spark, d, "labels"), "doc_id")
    field = F.when(F.col("toxic") == 1, F.concat(F.lit("word_"), F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)))).when(F.col("quality") == 1, F.upper("lang")).otherwise(F.concat("lang", F.lit("_x")))
    claims = labelled.select(F.col("source").alias("entity"), field.alias("field"), F.when(F.col("quality") == 1, "often").otherwise("rare").alias("type"))
    evidence = labelled.select(F.col("source").alias("entity"), field.alias("field"), F.concat(F.lit("word "), "text").alias("text"))
    found = R.check_fields(claims, known, evidence)
    return found.groupBy("entity", "field", "type", "status", "basis", "claimed_type", "conflict").agg(F.count("*").alias("claims"))


def m11_relations(spark, d):
    """Claimed links between suppliers' and customers' nations, against lines that were shipped."""
    nation = _t(spark, d, "nation")
    sold = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    known = sold.filter("l_returnflag = 'R'").groupBy(F.col("s_nationkey").alias("a"), F.col("l_linenumber").alias("b")).agg(F.when(F.count("*") % 2 == 0, "one-to-many").otherwise("many-to-one").alias("type"))
    names = nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("src")), nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("dst"))
    known = known.join(names[0], "a").join(names[1], "b").select("src", "dst", "type")
    claims = nation.join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = claims.select(F.col("n_name").alias("src"), F.col("n_regionkey").cast("int").alias("b"), "r_name").join(names[1], "b").select("dst", "src", F.lit("one-to-many").alias("type"), "r_name")
    claims = pairs.select(F.col("src"), F.col("dst"), "type").unionByName(pairs.select("src", F.col("r_name").alias("dst"), F.lit("part-of").alias("type")))
    evidence = pairs.select("src", F.col("r_name").alias("dst"), F.when(F.length("src") % 2 == 0, F.concat_ws(" lies in ", "src", "r_name")).otherwise(F.col("src")).alias("text"))
    return R.check_relations(claims, known, evidence).distinct()


def m11_features(spark, d):
    """Kinds of parts that a brand claims, based on words of the kind, against the names of the brand's parts."""
    part = _t(spark, d, "part")
    vocabulary = part.select(F.col("p_brand").alias("module"), F.explode(F.split("p_name", " ")).alias("name"))
    claims = _t(spark, d, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey"), "right").select(
        F.coalesce(F.col("s_name"), F.col("p_brand")).alias("module"), F.col("p_type").alias("feature"), F.when(F.col("p_size") > 25, "VERIFIED").alias("status"),
        F.array(F.col("p_name"), F.concat(F.lit("x, "), F.substring_index("p_name", " ", 1))).alias("based_on"),
    )
    found = R.check_features(claims, vocabulary)
    return found.groupBy("module", "status").agg(F.count("*").alias("features"), F.sum(F.size("matched")).alias("matched"))


def _cells(df, kind, ident, part, item, value, status, **more):
    return df.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), F.lit(part).alias("part"), item.cast("string").alias("item"), value.cast("string").alias("value"), status.alias("status"), *[v.alias(k) for k, v in more.items()])


def _knowledge(spark, d):
    """(store, found): cells of seven kinds of subjects from the given tables, as they were known and as a run finds them."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    turns, bench, nation, part = (_t(spark, d, n) for n in ("conversations", "benchmark", "nation", "part"))
    none, ai = F.lit(None).cast("string"), {"origin": F.lit("AI"), "stale": F.lit(False), "run": F.lit("r0"), "version": F.lit(1).cast("long")}
    source = ai | {"origin": F.lit("SOURCE")}
    verified = lambda c: F.when(c, "VERIFIED").otherwise("INFERRED")
    langs = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))
    old = [
        _cells(docs, "file", "doc_id", "purpose", none, F.col("lang"), verified(F.col("quality") == 1), **(ai | {"stale": F.coalesce(F.col("toxic") == 1, F.lit(False))})),
        _cells(docs.filter("quality IS NOT NULL"), "file", "doc_id", "claim", F.lit("size"), F.col("n_chars"), verified(F.col("quality") == 1), **ai),
        _cells(langs, "feature", "source", "language", F.col("lang"), F.col("n"), F.lit("VERIFIED"), **source),
        _cells(turns, "workflow", "conv_id", "step", F.col("turn"), F.col("role"), verified(F.col("turn") % 2 == 0), **ai),
        _cells(bench, "entity", "item_id", "field", F.lit("words"), F.size(F.split("text", " ")), F.lit("VERIFIED"), **source),
        _cells(nation.withColumn("link", F.concat_ws(">", "n_name", F.col("n_regionkey").cast("string"))), "relationship", "link", "type", none, F.lit("part-of"), F.lit("INFERRED"), **ai),
        _cells(part.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_type").alias("least")), "module", "p_brand", "purpose", none, F.col("least"), verified(F.col("n") % 2 == 0), **ai),
        _cells(docs.agg(F.count("*").alias("n"), F.max("lang").alias("last")).withColumn("id", F.lit("all")), "architecture", "id", "overview", none, F.col("n"), F.lit("INFERRED"), **ai),
    ]
    new = [
        _cells(docs.filter("quality IS NOT NULL"), "file", "doc_id", "purpose", none, F.when(F.col("toxic") == 1, "junk").otherwise(F.col("lang")), verified(F.col("quality") == 0)),
        _cells(docs.filter("toxic = 0"), "file", "doc_id", "claim", F.lit("size"), F.length("text") + F.col("quality"), F.lit("INFERRED")),
        _cells(langs, "feature", "source", "language", F.col("lang"), F.col("labelled"), F.lit("VERIFIED")),
        _cells(turns, "workflow", "conv_id", "step", F.col("turn") + 1, F.col("role"), F.lit("INFERRED")),
        _cells(bench, "entity", "item_id", "field", F.when(F.col("item_id") % 2 == 0, "words").otherwise("letters"), F.when(F.length("text") % 2 == 0, F.size(F.split("text", " "))).otherwise(F.length("text")), F.lit("INFERRED")),
        _cells(bench.withColumn("name", F.concat(F.lit("new-"), "item_id")), "entity", "name", "field", F.lit("text"), F.lit("string"), F.when(F.length("text") % 3 == 0, "UNKNOWN").otherwise("VERIFIED")),
        _cells(nation.withColumn("link", F.concat_ws(">", F.col("n_regionkey").cast("string"), "n_name")), "relationship", "link", "type", none, F.lit("has"), F.lit("VERIFIED")),
        _cells(part.groupBy("p_brand").agg(F.max("p_type").alias("most")), "module", "p_brand", "purpose", none, F.col("most"), F.lit("VERIFIED")),
        _cells(docs.agg(F.max("lang").alias("last")).withColumn("id", F.lit("all")), "architecture", "id", "overview", none, F.col("last"), F.lit("INFERRED")),
    ]
    store, found = old[0], new[0]
    for x in old[1:]:
        store = store.unionByName(x)
    for x in new[1:]:
        found = found.unionByName(x)
    return store, found


def m12_reconcile(spark, d):
    """Every cell of the store after a run."""
    return R.reconcile(*_knowledge(spark, d), "r1")


def m12_conflicts(spark, d):
    """Claims that the source contradicts."""
    return R.conflicts(m12_reconcile(spark, d))


def m12_changes(spark, d):
    return R.changes(m12_reconcile(spark, d))


def snk05_versions(spark, d):
    """Documents after two loads: labelled bad ones come with the second one only and toxic ones are gone in it; good ones are edited, and all have another time stamp."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    stamped = lambda day, more: F.concat(F.lit(f"Generated: day {day}\n"), "text", more)
    first = docs.filter("quality IS NULL OR quality <> 0 OR toxic = 1").select("doc_id", stamped(1, F.lit("")).alias("body"))
    second = docs.filter("toxic IS NULL OR toxic <> 1").select("doc_id", stamped(2, F.when(F.col("quality") == 1, "\nGenerated: more").otherwise("")).alias("body"))
    day = lambda k: F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp")
    kept = V.next_versions(V.first_versions(first, "doc_id", "body", day(1)), second, "doc_id", "body", day(2), close_missing=True)
    return kept.select("doc_id", "version", F.sha2("body", 256).alias("body"), "valid_from", "valid_to")


def o02_topological(spark, d):
    """Parts and suppliers by number, a part after its suppliers; numbers that depend on each other are one component."""
    return G.topological(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))).withColumn("layer", F.col("layer").cast("long"))


def o03_clustered(spark, d):
    """Parts by number in the order of a search along what they are shipped with, numbers of nations first."""
    starts = _t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").cast("long").alias("place"))
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return D.clustered(parts.join(starts, "node", "left"), _t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


def g07_workflows(spark, d):
    """Orders as routes with the first part that was not returned as handler, events as calls of an order, and full-discount returns as the calls between parts."""
    li = _t(spark, d, "lineitem")
    kept = li.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("entry"))
    routes = _t(spark, d, "orders").join(kept, "o_orderkey", "left").select(F.col("o_orderkey").alias("route"), "entry")
    links = _t(spark, d, "events").select(F.col("event_id").alias("call"), F.col("user_id").alias("caller"), F.col("user_id").alias("route"))
    status = F.when(F.col("l_linestatus") == "F", "VERIFIED").otherwise("INFERRED")
    edges = li.filter("l_returnflag = 'R' AND l_discount >= 0.1").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("ord"), status.alias("status"))
    edges = edges.groupBy("src", "dst").agg(F.min("ord").alias("ord"), F.max("status").alias("status"))
    return W.assemble(routes, links, edges, _t(spark, d, "nation").select(F.col("n_nationkey").alias("node")), 4, 3)


def o08_shrunk(spark, d):
    """Documents of each language that a source keeps within 60,000 characters."""
    items = J.ranked(_t(spark, d, "documents"), ["source", "lang"], F.col("doc_id"))
    return P.shrink(items, "source", "lang", "rank", "n_chars", 60_000)


def _sets(spark, d):
    """Words, languages and sizes of each source's documents."""
    docs = _t(spark, d, "documents")
    item = lambda kind, value: docs.select("source", F.lit(kind).alias("category"), value.cast("string").alias("item"))
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")))
    return item("lang", F.col("lang")).unionByName(item("size", F.floor(F.col("n_chars") / 50))).unionByName(docs.select("source", F.lit("word").alias("category"), words.alias("item")).filter("item <> ''"))


def set06_overlaps(spark, d):
    """What every two sources have in common, by category."""
    return C.set_overlaps(_sets(spark, d), "source", "category", "item")


def c06_matrix(spark, d):
    return C.overlap_matrix(set06_overlaps(spark, d), ["lang", "size", "word"])


QUERIES = {f.__name__: f for f in (m10_fields, m11_relations, m11_features, m12_reconcile, m12_conflicts, m12_changes, snk05_versions, o02_topological, o03_clustered, g07_workflows, o08_shrunk, set06_overlaps, c06_matrix)}

_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')".format
_RANK = "case {0} when 'VERIFIED' then 2 when 'INFERRED' then 1 else 0 end".format
_CELLS = """docs as (select * from documents left join labels using (doc_id)),
langs as (select source, lang, count(*) as n, count(quality) as labelled from docs group by all),
store as (
  select 'file' as kind, doc_id::varchar as id, 'purpose' as part, null::varchar as item, lang as value, case when quality = 1 then 'VERIFIED' else 'INFERRED' end as status, 'AI' as origin, coalesce(toxic = 1, false) as stale from docs
  union all select 'file', doc_id::varchar, 'claim', 'size', n_chars::varchar, case when quality = 1 then 'VERIFIED' else 'INFERRED' end, 'AI', false from docs where quality is not null
  union all select 'feature', source, 'language', lang, n::varchar, 'VERIFIED', 'SOURCE', false from langs
  union all select 'workflow', conv_id::varchar, 'step', turn::varchar, role, case when turn % 2 = 0 then 'VERIFIED' else 'INFERRED' end, 'AI', false from conversations
  union all select 'entity', item_id::varchar, 'field', 'words', len(string_split(text, ' '))::varchar, 'VERIFIED', 'SOURCE', false from benchmark
  union all select 'relationship', list_aggregate(list_sort([n_name, n_regionkey::varchar]), 'string_agg', '>'), 'type', null, 'part-of', 'INFERRED', 'AI', false from nation
  union all select 'module', p_brand, 'purpose', null, min(p_type), case when count(*) % 2 = 0 then 'VERIFIED' else 'INFERRED' end, 'AI', false from part group by p_brand
  union all select 'architecture', 'all', 'overview', null, count(*)::varchar, 'INFERRED', 'AI', false from docs
),
found as (
  select 'file' as kind, doc_id::varchar as id, 'purpose' as part, null::varchar as item, case when toxic = 1 then 'junk' else lang end as value, case when quality = 0 then 'VERIFIED' else 'INFERRED' end as status from docs where quality is not null
  union all select 'file', doc_id::varchar, 'claim', 'size', (length(text) + quality)::varchar, 'INFERRED' from docs where toxic = 0
  union all select 'feature', source, 'language', lang, labelled::varchar, 'VERIFIED' from langs
  union all select 'workflow', conv_id::varchar, 'step', (turn + 1)::varchar, role, 'INFERRED' from conversations
  union all select 'entity', item_id::varchar, 'field', case when item_id % 2 = 0 then 'words' else 'letters' end, (case when length(text) % 2 = 0 then len(string_split(text, ' ')) else length(text) end)::varchar, 'INFERRED' from benchmark
  union all select 'entity', 'new-' || item_id, 'field', 'text', 'string', case when length(text) % 3 = 0 then 'UNKNOWN' else 'VERIFIED' end from benchmark
  union all select 'relationship', list_aggregate(list_sort([n_name, n_regionkey::varchar]), 'string_agg', '>'), 'type', null, 'has', 'VERIFIED' from nation
  union all select 'module', p_brand, 'purpose', null, max(p_type), 'VERIFIED' from part group by p_brand
  union all select 'architecture', 'all', 'overview', null, max(lang), 'INFERRED' from docs
),
met as (
  select coalesce(s.kind, f.kind) as kind, coalesce(s.id, f.id) as id, coalesce(s.part, f.part) as part, coalesce(s.item, f.item) as item, s.kind is not null as old, f.kind is not null as new,
    s.value as ov, s.status as os, s.origin, s.stale, f.value as nv, f.status as ns, {old} as r, {new} as q
  from store s full join found f on s.kind = f.kind and s.id = f.id and s.part = f.part and s.item is not distinct from f.item
),
judged as (
  select *, case when not new then 'kept' when not old then case when ns = 'UNKNOWN' then 'unverified' else 'added' end
    when origin = 'SOURCE' then case when ov is distinct from nv then 'conflict' else 'kept' end
    when kind = 'relationship' then 'kept'
    when item is null then case when (ov = nv and q > r) or (ov <> nv and (stale or q > r)) then 'changed' else 'kept' end
    when q > r or (q = r and ov <> nv) then 'changed' else 'kept' end as outcome from met
),
moved as (select kind, id, bool_or(old) as old, bool_or(outcome in ('added', 'changed')) as changed from judged where outcome <> 'unverified' group by kind, id),
cells as (
  select kind, id, part, item, case when outcome in ('changed', 'added', 'unverified') then nv else ov end as value, case when outcome in ('changed', 'added', 'unverified') then ns else os end as status,
    coalesce(origin, 'AI') as origin, case when outcome in ('changed', 'added', 'unverified') then 'r1' else 'r0' end as run,
    case when outcome <> 'unverified' then m.old::bigint + m.changed::bigint end as version, case when j.old and new and ov <> nv then case when outcome = 'changed' then ov else nv end end as alternative, outcome
  from judged j left join moved m using (kind, id)
)""".replace("{old}", _RANK("s.status")).replace("{new}", _RANK("f.status"))

_OVERLAPS = """i as (select distinct source, 'lang' as category, lang as item from documents union select source, 'size', (n_chars // 50)::varchar from documents
  union select source, 'word', w from (select source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) as w from documents)),
  n as (select source, category, count(*) as n from i group by 1, 2), m as (select x.category, x.source as a, y.source as b, count(*) as common from i x join i y using (category, item) where x.source < y.source group by all),
  o as (select x.category, x.source as a, y.source as b, coalesce(common, 0) as common, x.n - coalesce(common, 0) as only_a, y.n - coalesce(common, 0) as only_b
    from n x join n y on x.category = y.category and x.source < y.source left join m on m.category = x.category and m.a = x.source and m.b = y.source)"""

ORACLES = {
    "set06_overlaps": f"with {_OVERLAPS} select * from o",
    "c06_matrix": f"""with {_OVERLAPS} select a, b, sum(common) filter (category = 'lang')::bigint as lang, sum(common) filter (category = 'size')::bigint as size, sum(common) filter (category = 'word')::bigint as word,
  string_agg(category || ': common ' || common || ', only A ' || only_a || ', only B ' || only_b, '; ' order by category) as line from o group by a, b""",
    "m10_fields": f"""with known as (select source as entity, lang as field, case when count(*) > 60 then 'often' else 'seldom' end as type from documents group by 1, 2),
  claims as (select source as entity, case when toxic = 1 then 'word_' || lower(regexp_extract(text, '[A-Za-z]+')) when quality = 1 then upper(lang) else lang || '_x' end as field,
    case when quality = 1 then 'often' else 'rare' end as type, 'word ' || text as text from documents join labels using (doc_id)),
  seen as (select distinct entity, field from claims where {_KEY('field')} <> '' and contains({_KEY('text')}, {_KEY('field')})),
  met as (select c.entity, coalesce(k.field, c.field) as field, coalesce(k.type, c.type) as type, c.type as said, k.type as is_type, s.field is not null as seen, k.field is not null as static
    from claims c left join known k on {_KEY('c.entity')} = {_KEY('k.entity')} and {_KEY('c.field')} = {_KEY('k.field')} left join seen s on s.entity = c.entity and s.field = c.field)
  select entity, field, type, case when static or seen then 'VERIFIED' else 'UNKNOWN' end as status, case when static then 'static analysis' when seen then 'source text' end as basis,
    case when static then said end as claimed_type, static and said <> is_type as conflict, count(*) as claims from met group by all""",
    "m11_relations": """with sold as (select s_nationkey as a, l_linenumber as b, case when count(*) % 2 = 0 then 'one-to-many' else 'many-to-one' end as type
    from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag = 'R' group by 1, 2),
  known as (select least(x.n_name, y.n_name) as lo, greatest(x.n_name, y.n_name) as hi, min((x.n_name, y.n_name, type)) as k from sold join nation x on x.n_nationkey = a join nation y on y.n_nationkey = b group by 1, 2),
  base as (select x.n_name as src, y.n_name as dst, r_name from nation x join nation y on y.n_nationkey = x.n_regionkey join region on r_regionkey = x.n_regionkey),
  claims as (select src, dst, 'one-to-many' as type, false as seen from base union all select src, r_name, 'part-of', length(src) % 2 = 0 from base)
  select distinct coalesce(k[1], src) as src, coalesce(k[2], dst) as dst, coalesce(k[3], type) as type, case when k is not null then 'VERIFIED' when seen then 'INFERRED' else 'UNKNOWN' end as status,
    case when k is not null then 'static analysis' when seen then 'both entities appear in cited source' end as basis, case when k is not null then type end as claimed_type,
    coalesce(k is not null and type <> 'one-to-many', false) as conflict from claims left join known on lo = least(src, dst) and hi = greatest(src, dst)""",
    "m11_features": f"""with v as (select distinct p_brand as module, {_KEY("unnest(string_split(p_name, ' '))")} as key from part),
  c as (select row_number() over () as r, coalesce(s_name, p_brand) as module, case when p_size > 25 then 'VERIFIED' end as status, p_type as feature, p_name, string_split(p_name, ' ')[1] as head from part left join supplier on s_suppkey = p_partkey),
  n as (select r, module, feature, p_name as b, {_KEY('p_name')} as key from c union select r, module, feature, p_name, {_KEY("unnest(string_split(p_name, ' '))")} from c
    union select r, module, feature, 'x, ' || head, {_KEY('head')} from c union select r, module, feature, 'x, ' || head, {_KEY("'x' || head")} from c),
  h as (select r, count(distinct b) as hits from n join v using (module, key) where length(key) > 2 group by r)
  select module, case when module not in (select module from v) then 'UNKNOWN' when status = 'VERIFIED' and coalesce(hits, 0) = 0 then 'INFERRED' else coalesce(status, 'INFERRED') end as status,
    count(*) as features, sum(coalesce(hits, 0))::bigint as matched from c left join h using (r) group by 1, 2""",
    "m12_reconcile": f"with {_CELLS} select * from cells",
    "m12_conflicts": f"with {_CELLS} select kind, id, part, item, value as source_value, alternative as claimed, 'source wins' as resolution from cells where outcome = 'conflict'",
    "m12_changes": f"with {_CELLS} select kind, outcome, count(*) as cells, count(distinct id) as subjects from cells group by 1, 2",
    "snk05_versions": """with d as (select *, timestamp '2024-01-01' as d1, timestamp '2024-01-02' as d2 from documents left join labels using (doc_id)),
  x as (select *, quality is null or quality <> 0 or toxic = 1 as one, toxic is null or toxic <> 1 as two, coalesce(quality = 1, false) as edited from d)
  select doc_id, 1::bigint as version, sha256('Generated: day 1' || chr(10) || text) as body, d1 as valid_from, case when not two or edited then d2 end as valid_to from x where one
  union all select doc_id, case when one then 2 else 1 end, sha256('Generated: day 2' || chr(10) || text || case when edited then chr(10) || 'Generated: more' else '' end), d2, null from x where two and (not one or edited)""",
    "o02_topological": """with recursive e as (select distinct l_partkey as s, l_suppkey as t from lineitem where l_partkey <> l_suppkey), n as (select s as v from e union select t from e union select l_partkey from lineitem),
  r(s, t) as (select s, t from e union select r.s, e.t from r join e on r.t = e.s),
  c as (select v as node, least(v, coalesce(min(a.t), v)) as component from n left join (select r.s, r.t from r join r b on b.s = r.t and b.t = r.s) a on a.s = v group by v),
  ce as (select distinct x.component as s, y.component as t from e join c x on x.node = e.s join c y on y.node = e.t where x.component <> y.component),
  l(component, layer) as (select distinct component, 0 from c where component not in (select s from ce) union select ce.s, layer + 1 from l join ce on ce.t = l.component)
  select node, component, max(layer)::bigint as layer from c join l using (component) group by 1, 2""",
    "g07_workflows": """with recursive e as (select l_partkey as s, l_suppkey as t, min(l_orderkey) as o, max(case when l_linestatus = 'F' then 1 else 0 end) as sure from lineitem
    where l_returnflag = 'R' and l_discount >= 0.1 and l_partkey <> l_suppkey group by 1, 2),
  k as (select o_orderkey as route, min(l_partkey) as entry from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag <> 'R' group by 1),
  f as (select event_id as call, route, entry, user_id as caller from events join k on route = user_id union all select null, route, entry, null from k where route not in (select user_id from events)),
  ways(entry, node, depth, way, sure) as (select distinct entry, entry, 0, [0, entry], 1 from f where entry is not null union all select w.entry, e.t, depth + 1, way || [o, e.t], e.sure from ways w join e on e.s = w.node where depth < 4),
  least as (select entry, node, min((depth, way, sure)) as b from ways group by 1, 2),
  down as (select entry, node, b[3] = 0 as open, row_number() over (partition by entry order by b[2]) as step from least),
  up(start, step, node, chain) as (select distinct caller, 0, caller, [caller] from f where caller is not null union all
    select start, step + 1, s, list_append(chain, s) from (select start, step, chain, s, row_number() over (partition by start order by o, s) as rn from up join e on e.t = up.node
      where not list_contains(chain, s) and step < 3 and up.node not in (select n_nationkey from nation)) where rn = 1),
  g as (select f.*, top, case when call is null then 0 else coalesce(top + 1, 0) + 1 end as above, case when entry is null or coalesce(open, false) then 'PARTIAL' else 'VERIFIED' end as status
    from f left join (select start, max(step) as top from up group by 1) on start = caller left join (select entry as en, bool_or(open) as open from down group by 1) on en = entry)
  select call, route, (top - step + 1)::bigint as place, 'caller' as kind, node, 'VERIFIED' as step_status, status from g join up on start = caller
  union all select call, route, above, 'call', null, 'VERIFIED', status from g where call is not null
  union all select call, route, above + 1, 'route', null, 'VERIFIED', status from g
  union all select call, route, above + 2, 'handler', null, 'UNKNOWN', status from g where entry is null
  union all select call, route, above + 1 + step, case when step = 1 then 'handler' else 'step' end, node, case when open then 'INFERRED' else 'VERIFIED' end, status from g join down using (entry)""",
    "o03_clustered": """with recursive k as (select p_partkey as v, min(coalesce(n_regionkey, 4611686018427387904::bigint)) as p from part left join nation on n_nationkey = p_partkey group by 1),
  e as (select distinct l_partkey as s, l_suppkey as t from lineitem where l_partkey <> l_suppkey and l_partkey in (select v from k) and l_suppkey in (select v from k)),
  r(s, t) as (select v, v from k union select r.s, e.t from r join e on r.t = e.s),
  l as (select t as v, min((p, s)) as root from r join k on k.v = r.s group by 1),
  d(v, depth) as (select l.v, 0 from l join k on k.v = l.v where l.root = (k.p, k.v) union select e.t, depth + 1 from d join e on e.s = d.v join l a on a.v = e.s join l b on b.v = e.t where a.root = b.root and depth < 40),
  m as (select v, min(depth) as depth from d group by 1),
  h as (select e.t as v, min(e.s) as parent from e join m a on a.v = e.s join m b on b.v = e.t join l x on x.v = e.s join l y on y.v = e.t where b.depth = a.depth + 1 and x.root = y.root group by 1),
  w(v, way) as (select v, [v] from m where depth = 0 union all select h.v, list_append(way, h.v) from w join h on h.parent = w.v)
  select v as node, row_number() over (order by root, way) as place from w join l using (v)""",
    "o08_shrunk": """with recursive items as (select source, lang, n_chars, row_number() over (partition by source, lang order by doc_id) as p from documents),
  lists as (select source, lang, count(*) as n, sum(n_chars) as cost from items group by 1, 2),
  ladder(source, lang, size) as (select source, lang, n from lists union all select source, lang, floor(size * 0.7::double)::bigint from ladder where size > 0),
  cuts as (select l.source, l.lang, size, (select coalesce(sum(n_chars), 0) from items i where i.source = l.source and i.lang = l.lang and p <= size and p > floor(size * 0.7::double)) as saved from ladder l where size > 0),
  run as (select *, (select sum(cost) from lists t where t.source = cuts.source) - coalesce(sum(saved) over (partition by source order by size desc, lang rows between unbounded preceding and 1 preceding), 0) as held from cuts)
  select source, lang, n, coalesce((select min(floor(size * 0.7::double))::bigint from run where run.source = lists.source and run.lang = lists.lang and held > 60000), n)::bigint as kept from lists""",
}
