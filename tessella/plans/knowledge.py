"""Graphs, packing, merging, checking, comparison and read models applied to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import graph as G
from tessella.operators import joins as J
from tessella.operators import knowledge as K
from tessella.operators import packing as B


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Categories of the second project.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _edges(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("flag"))


def g01_r03_degrees(spark, d):
    return G.degrees(_edges(spark, d))


def g02_reach(spark, d):
    starts = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("start"))
    return G.reach(_edges(spark, d), starts, 8)


def g04_trace(spark, d):
    e = _edges(spark, d).select("src", "dst", F.when(F.col("flag") == "N", "VERIFIED").otherwise("INFERRED").alias("status"))
    return G.trace(e, _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("start")), 8)


def g08_mounts(spark, d):
    n = _t(spark, d, "nation")
    roots = _t(spark, d, "region").select(F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("file"), F.concat(F.lit("/"), F.lower("r_name")).alias("prefix"))
    mid = n.join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("file"), F.concat(F.lit("/"), F.lower("n_name")).alias("prefix"))
    leaf = _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("file"), F.concat(F.lit("/s"), F.col("s_suppkey")).alias("prefix"))
    return G.mount_prefixes(roots.unionByName(mid).unionByName(leaf), 3)


def g09_induced(spark, d):
    return G.induced(G.distinct_edges(_edges(spark, d)), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("node")))


def g10_g11_impact(spark, d):
    deg = G.degrees(_edges(spark, d)).select("node", F.col("in_degree").alias("dependents"))
    return G.risk(deg.select("node", "dependents", (F.col("node") % 11 == 0).alias("in_workflow"), (F.col("node") % 13 == 0).alias("is_route"), (F.col("node") % 17 == 0).alias("is_schema"))).select("node", "risk", "reasons")


def w03_cx7_batches(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    return B.batches(docs, ["source"], ["doc_id"], "doc_id", "tokens", 8000, 10)


def w04_cx6_budget(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    return B.budgeted(docs, ["source"], ["doc_id"], "doc_id", "tokens", 12000, 20, 4000)


def o09_reduced(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "text")
    return B.reduced(docs, ["source"], ["doc_id"], "doc_id", "text", 40, 12, 600, 8000, 300).select("doc_id", "source", "lines", "tokens", "cut", "reason")


def a18_batch_stats(spark, d):
    return w03_cx7_batches(spark, d).groupBy("source", "batch").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


def m01_m02_merge(spark, d):
    st = F.element_at(F.array(*map(F.lit, T.STATUSES)), (F.col("o_custkey") % 3 + 1).cast("int"))
    o = _t(spark, d, "orders")
    old = o.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("value"), st.alias("status"), (F.col("o_orderkey") % 5 == 0).alias("stale"))
    st2 = F.element_at(F.array(*map(F.lit, T.STATUSES)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    new = o.filter("o_orderkey % 6 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("9-OTHER").alias("value"), st2.alias("status"))
    return K.merge_values(old, new, ["o_orderkey"])


def m03_merge_batches(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", F.when(F.col("turn") > 0, F.col("text")).otherwise("").alias("text"), F.col("role").alias("last_role"), F.array("role").alias("roles"), "turn")
    return K.merge_batches(c, ["conv_id"], "text", "last_role", "roles", "turn").withColumn("roles", F.array_join("roles", ","))


def _claims(spark, d):
    docs = _t(spark, d, "documents")
    path = F.when(F.col("doc_id") % 17 == 0, F.lit("../x")).when(F.col("doc_id") % 13 == 0, F.lit("none")).otherwise(F.col("doc_id").cast("string"))
    h = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.sha2("text", 256))
    quote = F.when(F.col("doc_id") % 5 == 0, F.lit("not in there 123")).otherwise(F.substring("text", 1, 20))
    claims = docs.select((F.col("doc_id") % 300).alias("claim"), path.alias("path"), h.alias("hash"), F.lit(1).alias("first"), (F.col("doc_id") % 12 + 1).alias("last"), quote.alias("quote"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), "text", F.sha2("text", 256).alias("hash"), T.lines_analyze(F.col("text")).alias("lines"))
    return K.check_evidence(claims, files)


def m07_evidence(spark, d):
    return _claims(spark, d).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def m08_verdicts(spark, d):
    return K.verdicts(_claims(spark, d), ["claim"])


def m04_m05_status(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    done = _t(spark, d, "labels").join(docs, F.col("doc_id") == F.col("path")).select("path", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("hash")).alias("hash"), (F.col("quality") == 1).alias("complete"))
    return K.file_status(docs, done)


def m06_stale_docs(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), "source")
    sources = docs.select(F.col("source").alias("doc"), "path", F.when(F.col("path") % 200 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return K.stale_documents(sources, docs)


def m14_cache(spark, d):
    files = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), F.lit(3).alias("revision"))
    cache = files.filter("path % 3 <> 0").withColumn("revision", F.when(F.col("path") % 5 == 0, 2).otherwise(3))
    return K.cache_misses(files, cache).select("path")


def c01_c04_suggestions(spark, d):
    side = F.col("side")
    a = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n")).select("category", "key", (F.col("n") % 3).alias("detail"))
    b = _t(spark, d, "supplier").select(F.explode(F.array(*map(F.lit, SEGMENTS))).alias("category"), F.col("s_nationkey").alias("key")).distinct().withColumn("detail", (F.col("key") % 3).cast("long"))
    met = J.compare(a, b, ["category", "key"], "detail")
    advice = F.when(side == "only_b", "adopt").when(side == "only_a", "keep").when(side == "different", "review")
    keys = F.array_sort(F.collect_list("key"))
    return met.withColumn("advice", advice).filter("advice IS NOT NULL").groupBy("category", "advice").agg(F.array_join(F.slice(keys, 1, 12), ",").alias("first"), F.greatest(F.size(keys) - 12, F.lit(0)).cast("long").alias("more"))


def cx1_cx2_neighbourhood(spark, d):
    e = _edges(spark, d).select("src", "dst").distinct()
    primary = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("start"))
    down = G.reach(e, primary, 2).select("node", (F.lit(1) + F.col("depth")).alias("priority"))
    up = G.reach(G.reverse(e), primary, 1).select("node", F.lit(2).alias("priority"))
    every = primary.select(F.col("start").alias("node"), F.lit(0).alias("priority")).unionByName(down).unionByName(up)
    return every.groupBy("node").agg(F.min("priority").alias("priority"))


def cx5_halves(spark, d):
    b = w03_cx7_batches(spark, d)
    half = F.ntile(2).over(Window.partitionBy("source", "batch").orderBy("doc_id"))
    return b.select("source", "batch", "doc_id", half.alias("half"))


def st5_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) <= 1_800_000_000, 0).otherwise(1)
    marked = _t(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


def st10_slices(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("event_id", "user_id", F.floor((F.row_number().over(w) - 1) / 12).alias("slice"))


def r01_r11_file_view(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("lines", F.lit(0)).alias("lines"), "suppliers", "price")


def r02_module_coverage(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count("quality").alias("analysed"), F.count("*").alias("total"), T.percent(F.count("quality"), F.count("*")).alias("percent"), F.substring(F.min_by("text", F.when(F.col("quality") == 1, F.col("doc_id"))), 1, 60).alias("description"))


def r04_r05_runs(spark, d):
    e = _t(spark, d, "events").withColumn("run", F.date_trunc("day", "ts"))
    runs = e.groupBy("run").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("skipped"), F.count_if(F.col("value") < 10).alias("unfinished"))
    return runs.orderBy(F.col("run").desc()).limit(30).select(F.date_format("run", "yyyy-MM-dd").alias("run"), "total", "skipped", "unfinished")


QUERIES = {f.__name__: f for f in (
    g01_r03_degrees, g02_reach, g04_trace, g08_mounts, g09_induced, g10_g11_impact, w03_cx7_batches, w04_cx6_budget, o09_reduced, a18_batch_stats, m01_m02_merge, m03_merge_batches,
    m07_evidence, m08_verdicts, m04_m05_status, m06_stale_docs, m14_cache, c01_c04_suggestions, cx1_cx2_neighbourhood, cx5_halves, st5_sessions, st10_slices,
    r01_r11_file_view, r02_module_coverage, r04_r05_runs,
)}

_E = "e as (select distinct l_orderkey as src, l_partkey as dst, l_returnflag as flag from lineitem)"
_BATCH = """t as (select doc_id, source, ceil(length(text) / 3.6::double)::bigint as tokens, row_number() over (partition by source order by doc_id) as rn from documents),
  b as (select source, rn, doc_id, tokens, 1::bigint as batch, tokens as s, 1 as n from t where rn = 1 union all
    select t.source, t.rn, t.doc_id, t.tokens, case when b.s + t.tokens > 8000 or b.n >= 10 then b.batch + 1 else b.batch end,
      case when b.s + t.tokens > 8000 or b.n >= 10 then t.tokens else b.s + t.tokens end, case when b.s + t.tokens > 8000 or b.n >= 10 then 1 else b.n + 1 end
    from b join t on t.source = b.source and t.rn = b.rn + 1)"""
_CLAIM = """f as (select doc_id::varchar as path, text, sha256(text) as hash, len(string_split(text, chr(10))) as lines from documents),
  c as (select doc_id % 300 as claim, case when doc_id % 17 = 0 then '../x' when doc_id % 13 = 0 then 'none' else doc_id::varchar end as path, case when doc_id % 7 = 0 then 'old' else sha256(text) end as hash,
    doc_id % 12 + 1 as last, case when doc_id % 5 = 0 then 'not in there 123' else substr(text, 1, 20) end as quote from documents),
  r as (select claim, case when c.path = '../x' then 'unsafe_path' when f.hash is null then 'unknown_file' when f.hash <> c.hash then 'stale_hash' when last > lines then 'bad_lines' when not contains(text, quote) then 'not_found' end as reason from c left join f using (path))"""
ORACLES = {
    "g01_r03_degrees": f"with {_E}, x as (select distinct src, dst from e) select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select src as node, 1 as o, 0 as i from x union all select dst, 0, 1 from x) group by node",
    "g02_reach": f"""with recursive {_E}, w as (select r_regionkey::bigint as start, r_regionkey::bigint as node, 0 as depth from region union select start, dst, depth + 1 from w join e on node = src where depth < 8)
  select start, node, min(depth) as depth from w group by 1, 2 having min(depth) > 0""",
    "g04_trace": f"""with recursive {_E}, x as (select src, dst, max((flag = 'N')::int) as sure from e group by 1, 2),
  w as (select r_regionkey::bigint as start, r_regionkey::bigint as node, 0 as depth, 1 as sure from region union select start, dst, depth + 1, least(w.sure, x.sure) from w join x on node = src where depth < 8),
  m as (select start, node, min(depth) as depth from w group by 1, 2 having min(depth) > 0)
  select start, node, depth, case when max(sure) = 1 then 'VERIFIED' else 'INFERRED' end as status from m join w using (start, node, depth) group by all""",
    "g08_mounts": """select r_name as file, '/' || lower(r_name) as prefix from region union select n_name, '/' || lower(r_name) || '/' || lower(n_name) from nation join region on n_regionkey = r_regionkey
  union select s_name, '/' || lower(r_name) || '/' || lower(n_name) || '/s' || s_suppkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "g09_induced": f"with {_E} select distinct src, dst from e where src in (select s_suppkey from supplier) and dst in (select s_suppkey from supplier)",
    "g10_g11_impact": f"""with {_E}, n as (select node, (select count(distinct src) from e where dst = node) as k from (select src as node from e union select dst from e))
  select node, case when node % 17 = 0 or k >= 15 then 'HIGH' when k >= 5 or node % 11 = 0 or node % 13 = 0 then 'MEDIUM' else 'LOW' end as risk,
  array_to_string(list_filter([case when k >= 5 then 'five or more dependents' end, case when node % 11 = 0 then 'part of a workflow' end, case when node % 13 = 0 then 'defines routes' end,
    case when node % 17 = 0 then 'defines the schema' end, case when k >= 15 then 'fifteen or more dependents' end], lambda x: x is not null), '; ') as reasons from n""",
    "w03_cx7_batches": f"with recursive {_BATCH} select source, doc_id, tokens, batch from b",
    "w04_cx6_budget": """with recursive t as (select doc_id, source, ceil(length(text) / 3.6::double)::bigint as k, row_number() over (partition by source order by doc_id) as rn from documents),
  b as (select source, 0::bigint as rn, null::bigint as doc_id, null::varchar as reason, 0::bigint as s, 0 as n from (select distinct source from t) union all
    select t.source, t.rn, t.doc_id, case when k > 4000 then 'too_large' when n >= 20 then 'no_count' when s + k > 12000 then 'no_size' end,
      case when k > 4000 or n >= 20 or s + k > 12000 then s else s + k end, case when k > 4000 or n >= 20 or s + k > 12000 then n else n + 1 end from b join t on t.source = b.source and t.rn = b.rn + 1)
  select source, doc_id, reason from b where rn > 0""",
    "o09_reduced": """with recursive l as (select doc_id, source, string_split(text, chr(10)) as a from documents),
  k as (select doc_id, source, a, least(len(a), 12)::int as n from l union all select doc_id, source, a, floor(n * 0.8)::int from k where n > 10 and ceil(length(array_to_string(a[1:n], chr(10))) / 3.6::double) > 600),
  m as (select doc_id, source, any_value(a) as a, min(n) as n from k group by 1, 2),
  t as (select doc_id, source, n, n < len(a) as cut, ceil((length(array_to_string(a[1:n], chr(10))) + case when n < len(a) then 6 else 0 end) / 3.6::double)::bigint as tk, row_number() over (partition by source order by doc_id) as rn from m),
  b as (select source, 0::bigint as rn, null::bigint as doc_id, 0 as n, 0::bigint as tk, false as cut, null::varchar as reason, 0 as f, 0::bigint as s, 0 as li from (select distinct source from t) union all
    select t.source, t.rn, t.doc_id, t.n, t.tk, t.cut, case when f >= 40 then 'maxFiles' when s + t.tk > 8000 then 'maxTotalTokens' when li + t.n > 300 then 'maxTotalLines' end,
      case when f >= 40 or s + t.tk > 8000 or li + t.n > 300 then f else f + 1 end, case when f >= 40 or s + t.tk > 8000 or li + t.n > 300 then s else s + t.tk end, case when f >= 40 or s + t.tk > 8000 or li + t.n > 300 then li else li + t.n end
    from b join t on t.source = b.source and t.rn = b.rn + 1)
  select doc_id, source, n as lines, tk as tokens, cut, reason from b where rn > 0""",
    "a18_batch_stats": f"with recursive {_BATCH} select source, batch, count(*) as files, sum(tokens)::bigint as tokens from b group by 1, 2",
    "m01_m02_merge": """with o as (select o_orderkey as k, o_orderpriority as v, o_custkey % 3 as r, o_orderkey % 5 = 0 as stale from orders where o_orderkey % 4 <> 0),
  n as (select o_orderkey as k, case when o_custkey % 2 = 0 then o_orderpriority else '9-OTHER' end as v, o_orderkey % 3 as r from orders where o_orderkey % 6 <> 0),
  m as (select k, o.v as ov, o.r as orank, n.v as nv, n.r as nrank, case when n.v is null then false when o.v is null then true when o.v = n.v then n.r > o.r when stale then true else n.r > o.r end as take from o full join n using (k))
  select k as o_orderkey, case when take then nv else ov end as value, ['UNKNOWN', 'INFERRED', 'VERIFIED'][case when take then nrank else orank end + 1] as status,
    case when ov <> nv then case when take then ov else nv end end as alternative from m""",
    "m03_merge_batches": """select conv_id, coalesce(arg_min(text, turn) filter (where turn > 0 and text <> ''), null) as text, arg_max(role, turn) as last_role, array_to_string(list_sort(list(distinct role)), ',') as roles from conversations group by conv_id""",
    "m07_evidence": f"with {_CLAIM} select coalesce(reason, 'valid') as reason, count(*) as n from r group by 1",
    "m08_verdicts": f"""with {_CLAIM} select claim, case when count(*) filter (where reason is null) > 0 then 'VERIFIED' when count(*) filter (where reason = 'stale_hash') > 0 then 'OUTDATED' else 'REJECTED' end as verdict,
  count(*) filter (where reason is null) as valid, count(*) as pieces from r group by claim""",
    "m04_m05_status": "select doc_id as path, case when quality is null then 'NOT_ANALYZED' when doc_id % 9 = 0 then 'OUTDATED' when quality = 1 then 'ANALYZED' else 'PARTIAL' end as status from documents left join labels using (doc_id)",
    "m06_stale_docs": "select source as doc, bool_or(doc_id % 200 = 0) as stale from documents group by source",
    "m14_cache": "select doc_id as path from documents where doc_id % 3 = 0 or doc_id % 5 = 0",
    "c01_c04_suggestions": """with a as (select c_mktsegment as category, c_nationkey as key, count(*) % 3 as detail from customer group by 1, 2), b as (select distinct c_mktsegment as category, s_nationkey as key, (s_nationkey % 3)::bigint as detail from supplier, customer),
  m as (select category, key, case when a.detail is null then 'adopt' when b.detail is null then 'keep' when a.detail <> b.detail then 'review' end as advice from a full join b using (category, key))
  select category, advice, array_to_string(list_sort(list(key))[1:12], ',') as first, greatest(count(*) - 12, 0)::bigint as more from m where advice is not null group by 1, 2""",
    "cx1_cx2_neighbourhood": f"""with {_E}, p as (select r_regionkey::bigint as node from region), d1 as (select dst as node from e where src in (select node from p)), d2 as (select dst as node from e where src in (select node from d1)), u as (select src as node from e where dst in (select node from p))
  select node, min(priority) as priority from (select node, 0 as priority from p union all select node, 2 from d1 union all select node, 3 from d2 union all select node, 2 from u) group by node""",
    "cx5_halves": f"with recursive {_BATCH} select source, batch, doc_id, ntile(2) over (partition by source, batch order by doc_id)::int as half from b",
    "st5_sessions": """with m as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id)::bigint as session from m)
  select user_id, session, count(*) as events, round(sum(value), 4) as value from s group by 1, 2""",
    "st10_slices": "select event_id, user_id, ((row_number() over (partition by user_id order by ts, event_id) - 1) // 12)::bigint as slice from events",
    "r01_r11_file_view": """select o_orderkey, o_orderstatus, count(l_orderkey) as lines, case when count(l_orderkey) > 0 then count(distinct l_suppkey) end as suppliers, round(sum(l_extendedprice), 2) as price from orders left join lineitem on o_orderkey = l_orderkey group by 1, 2""",
    "r02_module_coverage": "select lang, count(quality) as analysed, count(*) as total, round(100.0 * count(quality) / count(*))::bigint as percent, substr(arg_min(text, doc_id) filter (where quality = 1), 1, 60) as description from documents left join labels using (doc_id) group by lang",
    "r04_r05_runs": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as run, count(*) as total, count(*) filter (where event_type = 'error') as skipped, count(*) filter (where value < 10) as unfinished from events group by 1 order by run desc limit 30",
}
