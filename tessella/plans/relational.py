"""Joins, aggregations, windows, sorts and set operations applied to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import joins as J
from tessella.sources.scratch import dealt


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def j01_wildcard_join(spark, d):
    calls = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("m"))
    routes = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.element_at(F.array(F.lit("A"), F.lit("ANY"), F.lit("N")), (F.col("p_size") % 3 + 1).cast("int")).alias("m"))
    return J.wildcard_join(calls, routes, "k", "m").select("l_orderkey", "l_linenumber", "route_m")


def j02_first_existing(spark, d):
    want = _t(spark, d, "customer").select("c_custkey", F.array(*[(F.col("c_custkey") * m).cast("long") for m in (7, 3, 1)]).alias("candidates"))
    known = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return J.first_existing(want, "candidates", known, "k", ["c_custkey"])


def j04_split_known(spark, d):
    edges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    known = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("path"))
    return J.split_known(edges, "src", "dst", known, "path")


def j05_j06_intervals(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"), "event_type")
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), (F.col("at") - 3600 * (F.col("event_id") % 5 + 1)).alias("low"), F.col("at").alias("high"))
    met = J.within_intervals(e, spans, "user_id", "at", "low", "high", 86_400)
    return J.innermost(met, ["event_id"], "low", "high", "span_id", "span_id")


def j07_longest_prefix(spark, d):
    pages = _t(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    owners = pages.select(F.explode(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("root"), (F.col("page_id") % 3).alias("m")).filter("m < 2")
    return J.longest_prefix(pages, "path", owners, "root", "page_id").select("page_id", "owner")


def j08_fallback_lookup(spark, d):
    names = _t(spark, d, "part").select("p_partkey", F.lower(F.substring_index("p_type", " ", -1)).alias("w"))
    known = _t(spark, d, "part").select(T.singular(F.lower(F.substring_index("p_type", " ", -1))).alias("k"), F.col("p_brand").alias("v")).filter("k <> 'steel'")
    return J.fallback_lookup(names, [F.col("w"), F.upper("w"), T.singular(F.col("w"))], known, "k", "v", ["p_partkey"])


def j10_both_ends(spark, d):
    edges = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey")).alias("src"), F.concat(F.lit("C"), F.col("o_orderkey")).alias("dst"))
    known = _t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("name"))
    return J.both_ends_known(edges, "src", "dst", known, "name").select("o_orderkey", "status")


def j11_j12_transitions(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("h"))
    now = o.filter("o_orderkey % 7 <> 0").withColumn("h", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("h")))
    return J.transitions(now, o.filter("o_orderkey % 3 <> 0"), "o_orderkey", "h")


def j13_c03_compare(spark, d):
    a = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).filter("n % 4 <> 0").select("k", (F.col("n") % 2).alias("v"))
    b = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).filter("n % 3 <> 0").select("k", (F.col("n") % 2).alias("v"))
    return J.compare(a, b, ["k"], "v")


def j14_r16_pairwise(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sets = o.join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("c_nationkey", "l_suppkey")
    return J.pairwise_sets(sets, "c_nationkey", "l_suppkey")


def j16_unique(spark, d):
    left = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("name"))
    right = _t(spark, d, "orders").select((F.col("o_custkey")).alias("name"), F.col("o_orderkey").alias("target"))
    return J.unique_match(left, right, "name", "target")


def j20_either_direction(spark, d):
    left = dealt(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), "a", "b").distinct()
    right = _t(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return J.either_direction(left, right, "a", "b")


def j22_first_definer(spark, d):
    ext = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("owner"))
    defs = _t(spark, d, "customer").select(F.col("c_nationkey").alias("name"), F.col("c_custkey").alias("owner"), F.col("c_custkey").alias("ord"))
    return J.first_definer(ext, defs, "name", "owner", "ord")


def a02_folder_rollup(spark, d):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    parts = F.split(p, "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return _t(spark, d, "pages").select(up.alias("folder"), F.length("html").alias("n")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("n").alias("chars"))


def a03_a04_sets(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))), ",").alias("large"),
        F.count_if(F.col("value") > 50).alias("n_large"),
    )


def a06_ordered_distinct(spark, d):
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(steps), ">").alias("roles"), F.count("*").alias("steps"))


def a09_a15_coverage(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    met = docs.join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    done = F.count("quality")
    pct = T.percent(done, F.count("*"))
    return met.groupBy("source").agg(
        F.count("*").alias("total"), done.alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), pct.alias("percent"),
        F.when(done == 0, "NOT_ANALYZED").when(done == F.count("*"), "COMPLETE").otherwise("PARTIAL").alias("status"),
    )


def a11_regroup(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_type").alias("grp"), F.substring_index("p_type", " ", 1).alias("parent"))
    sized = p.withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    return sized.select("p_partkey", F.when(F.col("n") < 14, F.col("parent")).otherwise(F.col("grp")).alias("grp")).groupBy("grp").agg(F.count("*").alias("files"))


def a13_usage(spark, d):
    edges = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_returnflag").alias("module"), F.col("s_nationkey").alias("uses"))
    uses = edges.groupBy("module").agg(F.countDistinct("uses").alias("n")).select(F.col("module").alias("name"), F.lit("uses").alias("direction"), "n")
    return uses.union(edges.groupBy(F.col("uses").cast("string").alias("name")).agg(F.countDistinct("module").alias("n")).select("name", F.lit("used_by").alias("direction"), "n"))


def a14_merge_fields(spark, d):
    f = _t(spark, d, "part").select(F.col("p_brand").alias("entity"), F.lower("p_type").alias("field"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("kind"), F.col("p_partkey").alias("ord"))
    known = F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("ord")))
    return f.groupBy("entity", "field").agg(known.alias("kind"), F.count("*").alias("n"))


def w01_w02_wins(spark, d):
    c = _t(spark, d, "conversations")
    first = J.latest_per_key(c, ["conv_id", "role"], F.col("turn")).select("conv_id", "role", F.col("turn").alias("first_turn"))
    last = J.latest_per_key(c, ["conv_id", "role"], F.length("text").desc(), F.col("turn").desc()).select("conv_id", "role", F.col("turn").alias("longest_turn"))
    return first.join(last, ["conv_id", "role"])


def w05_w06_previous(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) == 1, 1).otherwise(0)
    seen = F.coalesce(F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _t(spark, d, "events").withColumn("new", new).select("event_id", F.lag("event_id").over(w).alias("previous"), seen.alias("seen_before"))


def w07_suffix(spark, d):
    rn = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", F.when(rn == 1, F.col("p_type")).otherwise(F.concat("p_type", F.lit("-"), rn)).alias("id"))


def w08_char_budget(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = _t(spark, d, "documents").withColumn("n", F.least(F.length("text"), F.lit(6000)).cast("long"))
    left = F.lit(60000) - F.coalesce(F.sum("n").over(w), F.lit(0))
    return docs.withColumn("taken", F.least("n", left)).filter("taken > 0").select("doc_id", "source", "taken")


def w09_next_id(spark, d):
    return _t(spark, d, "part").groupBy(F.substring_index("p_brand", "#", 1).alias("prefix")).agg((F.max(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long")) + 1).alias("next"))


def w10_cap(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _t(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("event_id", F.col("rn").cast("long").alias("rn"))


def o01_reading_order(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    group = F.when(F.col("path").rlike("/(index|about)"), 0).when(F.col("path").rlike("/(tag|archive)"), 2).otherwise(1)
    status = (F.col("page_id") % 3).alias("status")
    w = Window.partitionBy(F.substring_index("path", "/", 1)).orderBy("grp", "status", "path", "page_id")
    return p.select("page_id", "path", group.alias("grp"), status).withColumn("place", F.row_number().over(w).cast("long")).select("page_id", "grp", "place")


def o06_top_with_rest(spark, d):
    g = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("all"))
    return g.select("o_custkey", F.array_join(F.slice("all", 1, 3), ",").alias("top"), F.greatest(F.size("all") - 3, F.lit(0)).cast("long").alias("more"))


def set01_multiset_diff(spark, d):
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))).alias("a"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority"))).alias("b"))
    return o.select("o_custkey", F.array_join(F.filter("a", lambda x: F.array_contains("b", x)), ";").alias("common"), F.array_join(F.filter("a", lambda x: ~F.array_contains("b", x)), ";").alias("only_a"))


def set03_set05_selection(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    chosen = o.filter("o_orderstatus = 'P'").select("o_orderkey").union(o.filter("o_totalprice > 400000").select("o_orderkey")).distinct()
    done = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return chosen.join(done, "o_orderkey", "left_anti")


def set04_boundary(spark, d):
    chosen = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(True).alias("inside"))
    edges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    edges = edges.join(chosen.toDF("a", "ia"), "a", "left").join(chosen.toDF("b", "ib"), "b", "left")
    a_in, b_in = F.col("ia").isNotNull(), F.col("ib").isNotNull()
    kind = F.when(a_in & b_in, "internal").when(a_in, "needs_outside").when(b_in, "used_by_outside")
    return edges.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("a").alias("sources"))


QUERIES = {f.__name__: f for f in (
    j01_wildcard_join, j02_first_existing, j04_split_known, j05_j06_intervals, j07_longest_prefix, j08_fallback_lookup, j10_both_ends, j11_j12_transitions,
    j13_c03_compare, j14_r16_pairwise, j16_unique, j20_either_direction, j22_first_definer, a02_folder_rollup, a03_a04_sets, a06_ordered_distinct,
    a09_a15_coverage, a11_regroup, a13_usage, a14_merge_fields, w01_w02_wins, w05_w06_previous, w07_suffix, w08_char_budget, w09_next_id, w10_cap,
    o01_reading_order, o06_top_with_rest, set01_multiset_diff, set03_set05_selection, set04_boundary,
)}

_W = "lower(string_split(p_type, ' ')[-1])"
_SING = """case when length({x}) > 3 and {x} like '%ies' then {x}[:-4] || 'y' when length({x}) > 3 and {x} like '%s' and {x} not like '%ss' then {x}[:-2] else {x} end"""
ORACLES = {
    "j01_wildcard_join": """select l_orderkey, l_linenumber, m as route_m from lineitem join (select p_partkey, ['A', 'ANY', 'N'][p_size % 3 + 1] as m from part) on l_partkey = p_partkey where l_returnflag = m or m = 'ANY'""",
    "j02_first_existing": """with k as (select distinct o_custkey as k from orders) select c_custkey, case when c_custkey * 7 in (select k from k) then c_custkey * 7
  when c_custkey * 3 in (select k from k) then c_custkey * 3 when c_custkey in (select k from k) then c_custkey end as found from customer""",
    "j04_split_known": """with e as (select l_orderkey as src, l_partkey as dst from lineitem) select src, dst, count(*) as n,
  case when dst in (select s_suppkey from supplier) then 'internal' else 'external' end as kind from e where src <> dst group by src, dst""",
    "j05_j06_intervals": """with e as (select event_id, user_id, floor(epoch(ts))::bigint as sec, event_type from events), s as (select user_id, event_id as span_id, sec - 3600 * (event_id % 5 + 1) as low, sec as high from e where event_type = 'purchase')
  select event_id, arg_min(span_id, (high - low) * 1000000000 - span_id) as span_id from e join s using (user_id) where sec between low and high group by event_id""",
    "j07_longest_prefix": """with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages), o as (select distinct unnest([string_split(path, '/')[1], array_to_string(string_split(path, '/')[1:2], '/')]) as root from p where page_id % 3 < 2)
  select page_id, (select arg_max(root, length(root)) from o where p.path = root or starts_with(p.path, root || '/')) as owner from p""",
    "j08_fallback_lookup": f"""with k as (select {_SING.format(x=_W)} as k, min(p_brand) as v from part group by 1 having k <> 'steel'), n as (select p_partkey, {_W} as w from part)
  select p_partkey, coalesce((select v from k where k = w), (select v from k where k = upper(w)), (select v from k where k = {_SING.format(x='w')})) as v from n""",
    "j10_both_ends": "select o_orderkey, case when o_custkey in (select c_custkey from customer) and o_orderkey in (select c_custkey from customer) then 'VERIFIED' else 'INFERRED' end as status from orders",
    "j11_j12_transitions": """select o_orderkey, case when o_orderkey % 3 = 0 then 'NEW' when o_orderkey % 7 = 0 then 'REMOVED' when o_orderkey % 5 <> 0 or o_orderstatus = 'X' then 'SAME' else 'CHANGED' end as transition
  from orders where o_orderkey % 7 <> 0 or o_orderkey % 3 <> 0""",
    "j13_c03_compare": """with a as (select c_nationkey as k, count(*) % 2 as v from customer group by 1 having count(*) % 4 <> 0), b as (select s_nationkey as k, count(*) % 2 as v from supplier group by 1 having count(*) % 3 <> 0)
  select k, a.v as a_detail, b.v as b_detail, case when b.k is null then 'only_a' when a.k is null then 'only_b' when a.v = b.v then 'common' else 'different' end as side from a full join b using (k)""",
    "j14_r16_pairwise": """with s as (select c_nationkey as k, list(distinct l_suppkey) as x from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1)
  select a.k as a, b.k as b, len(list_intersect(a.x, b.x))::bigint as common, (len(a.x) - len(list_intersect(a.x, b.x)))::bigint as only_a, (len(b.x) - len(list_intersect(a.x, b.x)))::bigint as only_b from s a join s b on a.k < b.k""",
    "j16_unique": """with r as (select o_custkey as name, min(o_orderkey) as target from orders group by 1 having count(distinct o_orderkey) = 1) select l_partkey as name, l_orderkey, l_linenumber, target from lineitem join r on l_partkey = name""",
    "j20_either_direction": """with r as (select o_custkey as a, o_orderkey as b from orders union select o_orderkey, o_custkey from orders) select distinct l_partkey as a, l_suppkey as b from lineitem join r on r.a = l_partkey and r.b = l_suppkey""",
    "j22_first_definer": """with f as (select c_nationkey as name, min(c_custkey) as definer from customer group by 1) select name, s_suppkey as owner, definer from supplier join f on name = s_nationkey where s_suppkey <> definer""",
    "a02_folder_rollup": """with p as (select string_split(regexp_replace(url, '^[a-z]+://', ''), '/') as s, length(html) as n from pages)
  select folder, count(*) as files, sum(n)::bigint as chars from (select unnest(list_transform(range(1, greatest(1, len(s) - 1) + 1), lambda i: array_to_string(s[1:i], '/'))) as folder, n from p) group by folder""",
    "a03_a04_sets": """select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as types, coalesce(array_to_string(list_sort(list(distinct event_type) filter (where value > 50)), ','), '') as large,
  count(*) filter (where value > 50) as n_large from events group by user_id""",
    "a06_ordered_distinct": """select conv_id, string_agg(role, '>' order by t) as roles, sum(n)::bigint as steps from (select conv_id, role, min(turn) as t, count(*) as n from conversations group by all) group by conv_id""",
    "a09_a15_coverage": """select source, count(*) as total, count(quality) as labelled, count(*) filter (where quality = 1) as good, round(100.0 * count(quality) / count(*))::bigint as percent,
  case when count(quality) = 0 then 'NOT_ANALYZED' when count(quality) = count(*) then 'COMPLETE' else 'PARTIAL' end as status from documents left join labels using (doc_id) group by source""",
    "a11_regroup": """with s as (select p_type, count(*) over (partition by p_type) as n from part) select case when n < 14 then string_split(p_type, ' ')[1] else p_type end as grp, count(*) as files from s group by 1""",
    "a13_usage": """with e as (select l_returnflag as module, s_nationkey as uses from lineitem join supplier on l_suppkey = s_suppkey) select module as name, 'uses' as direction, count(distinct uses) as n from e group by 1
  union all select uses::varchar, 'used_by', count(distinct module) from e group by 1""",
    "a14_merge_fields": """select p_brand as entity, lower(p_type) as field, arg_min(p_size, p_partkey) filter (where p_size % 3 > 0) as kind, count(*) as n from part group by 1, 2""",
    "w01_w02_wins": "select conv_id, role, min(turn) as first_turn, arg_max(turn, length(text) * 100000 + turn) as longest_turn from conversations group by 1, 2",
    "w05_w06_previous": """with e as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events), f as (select user_id, event_type, min(rn) as first from e group by 1, 2)
  select event_id, lag(event_id) over (partition by user_id order by rn) as previous, (select count(*) from f where f.user_id = e.user_id and f.first < e.rn) as seen_before from e""",
    "w07_suffix": "with r as (select p_partkey, p_type, row_number() over (partition by p_type order by p_partkey) as rn from part) select p_partkey, case when rn = 1 then p_type else p_type || '-' || rn end as id from r",
    "w08_char_budget": """with n as (select doc_id, source, least(length(text), 6000) as n from documents), r as (select *, 60000 - coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as room from n)
  select doc_id, source, least(n, room)::bigint as taken from r where least(n, room) > 0""",
    "w09_next_id": "select string_split(p_brand, '#')[1] as prefix, max(regexp_extract(p_brand, '[0-9]+$')::bigint) + 1 as next from part group by 1",
    "w10_cap": "select event_id, rn from (select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn <= 5",
    "o01_reading_order": """with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages), g as (select *, case when regexp_matches(path, '/(index|about)') then 0 when regexp_matches(path, '/(tag|archive)') then 2 else 1 end as grp from p)
  select page_id, grp, row_number() over (partition by string_split(path, '/')[1] order by grp, page_id % 3, path, page_id) as place from g""",
    "o06_top_with_rest": "select o_custkey, array_to_string(list_sort(list(o_orderkey))[1:3], ',') as top, greatest(count(*) - 3, 0)::bigint as more from orders group by 1",
    "set01_multiset_diff": """with o as (select o_custkey, coalesce(list_sort(list(o_orderpriority) filter (where o_orderkey % 2 = 0)), []) as a, coalesce(list(distinct o_orderpriority) filter (where o_orderkey % 2 = 1), []) as b from orders group by 1)
  select o_custkey, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ';') as common, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ';') as only_a from o""",
    "set03_set05_selection": "select distinct o_orderkey from orders where (o_orderstatus = 'P' or o_totalprice > 400000) and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
    "set04_boundary": """with e as (select distinct l_orderkey as a, l_partkey as b from lineitem), s as (select s_suppkey as k from supplier),
  k as (select *, case when a in (select k from s) and b in (select k from s) then 'internal' when a in (select k from s) then 'needs_outside' when b in (select k from s) then 'used_by_outside' end as kind from e)
  select kind, count(*) as edges, count(distinct a) as sources from k where kind is not null group by kind""",
}
