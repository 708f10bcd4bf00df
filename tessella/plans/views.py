"""Coverage, scopes, selections and structured texts, applied to the supplied tables.

A document stands for a file, its source for a folder, its labels for what is known of it; an order stands for a run's
item, its customer for the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import pieces
from tessella.functions import text as T
from tessella.functions import variants as V
from tessella.operators import compare
from tessella.operators import joins as J


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark, d) -> DataFrame:
    """path, folder, is_source, status."""
    status = F.when(F.col("quality").isNull(), "NOT_ANALYZED").when(F.col("toxic") == 1, "OUTDATED").when(F.col("quality") == 1, "ANALYZED").otherwise("PARTIAL")
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("path"), F.col("source").alias("folder"), (F.col("lang") == "en").alias("is_source"), status.alias("status"))


def a09_measures(spark, d):
    """The measures of a coverage report, in one aggregation."""
    done, old = F.col("status") != "NOT_ANALYZED", F.col("status") == "OUTDATED"
    found = _files(spark, d).agg(
        F.count("*").alias("files_total"), F.count_if("is_source").alias("sources"), F.count_if(done).alias("analyzed"), F.count_if(F.col("status") == "ANALYZED").alias("up_to_date"),
        F.count_if(old).alias("outdated"), F.count_distinct(F.when(done, F.col("folder"))).alias("folders"),
    )
    total = F.when(F.col("sources") > 0, F.col("sources")).otherwise(F.col("files_total"))
    state = F.when(F.col("analyzed") == 0, "NOT_ANALYZED").when((F.col("analyzed") >= total) & (F.col("outdated") == 0), "COMPLETE").otherwise("PARTIAL")
    return found.select("*", T.percent(F.col("analyzed"), total).alias("percent"), state.alias("state"))


def a10_histogram(spark, d):
    return _files(spark, d).groupBy("status").agg(F.count("*").alias("files"))


def a17_progress(spark, d):
    """Distinct parts shipped of all parts of each customer's orders, and the percentage."""
    li = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = li.groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("done"), F.count_distinct("l_partkey").alias("total"))
    return g.select("o_custkey", "done", "total", T.percent(F.col("done"), F.col("total")).alias("percent"))


def p08_p09_scopes(spark, d):
    """Edges from orders to parts that a scope keeps: with both ends in it, or with either."""
    scope = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    edges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    met = edges.join(scope.select(F.col("node").alias("a"), F.lit(1).alias("ia")), "a", "left").join(scope.select(F.col("node").alias("b"), F.lit(1).alias("ib")), "b", "left")
    return met.select("a", "b", (F.col("ia").isNotNull() & F.col("ib").isNotNull()).alias("both_ends")).filter("ia IS NOT NULL OR ib IS NOT NULL")


def p11_broad_selection(spark, d):
    """Source files of a broad run without those that were skipped, the least known first."""
    rows = _files(spark, d)
    skipped = rows.filter("status = 'OUTDATED'").select("path", F.lit(True).alias("skip"))
    left = rows.filter("is_source AND status <> 'ANALYZED'").join(skipped, "path", "left").filter("skip IS NULL")
    return J.ranked(left.withColumn("r", F.when(F.col("status") == "NOT_ANALYZED", 0).otherwise(2)), ["folder"], F.col("r"), F.col("path")).select("path", "folder", F.col("rank").cast("long").alias("place"))


def r06_remaining(spark, d):
    """Orders of a customer that hold no returned item yet."""
    done = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return _t(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


def r07_deletable(spark, d):
    """Ended orders of which no item is open."""
    live = _t(spark, d, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return _t(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P")).join(live, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def r10_modes(spark, d):
    """What a selection selects, by priority, and its summary."""
    c = _t(spark, d, "customer")
    kinds = {
        "workflows": F.col("c_nationkey") % 3, "features": F.col("c_nationkey") % 5, "entities": (F.col("c_mktsegment") == "BUILDING").cast("int"), "folders": F.col("c_nationkey") % 2,
        "files": F.col("c_nationkey") % 7,
    }
    project = F.col("c_acctbal") > 9000
    names = {"workflows": "WORKFLOW", "features": "FEATURE", "entities": "DATABASE", "folders": "FOLDER"}
    mode = F.when(project, "PROJECT")
    for k, name in names.items():
        mode = mode.when(kinds[k] > 0, name)
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {k}"))) for k, n in kinds.items()]
    said = F.array_join(F.array_compact(F.array(*parts, F.when(project, F.lit("entire project")))), ", ")
    return c.select("c_custkey", mode.otherwise("FILE").alias("mode"), F.when(said == "", "nothing selected").otherwise(said).alias("summary"))


def r14_choices(spark, d):
    """Everything that a comparison can be scoped to: features, workflows and source files."""
    files = _files(spark, d)
    flows = _t(spark, d, "events").select(F.lit("workflow").alias("kind"), F.col("event_type").alias("name"))
    return files.select(F.lit("feature").alias("kind"), F.col("folder").alias("name")).union(flows).union(files.filter("is_source").select(F.lit("file"), F.col("path").cast("string"))).distinct()


def set02_ordered_union(spark, d):
    """Event types of a user, those with a large value first, each once in the order in which it came."""
    key = F.struct("ts", "event_id", "event_type", "value")
    firsts = _t(spark, d, "events").groupBy("user_id", "event_type", (F.col("value") > 50).alias("large")).agg(F.min(key).alias("x"))
    g = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("large"), F.col("x")))).alias("a"), F.array_sort(F.collect_list(F.when(~F.col("large"), F.col("x")))).alias("b"))
    return g.select("user_id", F.array_join(F.array_union(F.transform("a", lambda x: x["event_type"]), F.transform("b", lambda x: x["event_type"])), ",").alias("types"))


def o07_largest(spark, d):
    """The five longest documents of a source, the longest first."""
    return J.ranked(_t(spark, d, "documents"), ["source"], F.length("text").desc(), F.col("doc_id")).filter("rank <= 5").select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def s24_s41_texts(spark, d):
    """Texts with the one place of a word replaced, null where it has none or several, and waits without a connection."""
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", F.sha2(T.replace_once(t, F.col("lang"), F.lit("<lang>")), 256).alias("replaced"), T.offline_wait(F.col("n_chars").cast("double")).alias("wait"))


def s34_objects(spark, d):
    """The largest balanced object in a text around a message."""
    t = F.concat(F.lit("so } far {"), F.lit('"s": "}\\\\\\"{", "p": '), "props", F.lit("} and {}"))
    return _t(spark, d, "events").select("event_id", F.get(pieces.json_objects(t), F.lit(0)).alias("object"), F.size(pieces.json_objects(t)).alias("n"))


def s36_schema(spark, d):
    """What is wrong with messages, by their schema."""
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("value") > 50, F.array("event_type")).otherwise(F.array(F.lit("ok"), F.lit("much too long"))).alias("tags")))
    schema = {"type": "object", "required": ["id", "user"], "properties": {"kind": {"enum": ["click", "view"]}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 8}}}}
    return _t(spark, d, "events").select("event_id", F.array_join(V.schema_errors(body, schema), "; ").alias("errors"))


def s27_sentences(spark, d):
    """Answers of several shapes as sentences: an object that says what and why, an array, an object that says neither, a number."""
    kind, user, large = F.col("event_type"), F.col("user_id").cast("string"), F.col("value")
    said = F.when(large > 75, F.concat(F.lit('{"why":"user '), user, F.lit('","name":"x","question":" '), kind, F.lit(' "}')))
    said = said.when(large > 50, F.concat(F.lit('["'), kind, F.lit('",null,{"title":"of '), user, F.lit('"},"",'), user, F.lit("]"))).when(large > 25, F.col("props")).otherwise(user)
    return _t(spark, d, "events").select("event_id", V.sentence(V.value(said)).alias("sentence"))


def s37_mended(spark, d):
    """Messages with an object or a number where a text is wanted, and too many and too long tags, put right; and what stays wrong."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    title = F.when(F.col("value") > 50, F.concat(F.lit('{"name":"'), kind, F.lit('","why":"w"}'))).otherwise(user)
    body = F.concat(F.lit('{"title":'), title, F.lit(',"tags":["'), kind, F.lit('",'), user, F.lit(',"more"],"id":'), F.col("event_id").cast("string"), F.lit("}"))
    schema = {
        "type": "object", "required": ["id", "owner"],
        "properties": {"id": {"type": "integer"}, "title": {"type": "string", "maxLength": 8}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 4}}},
    }
    done = _t(spark, d, "events").select("event_id", F.size(V.schema_errors(body, schema)).alias("wrong"), V.mended(body, schema).alias("body"))
    return done.withColumn("left", F.array_join(V.schema_errors(F.col("body"), schema), "; "))


def s38_without_scores(spark, d):
    body = F.concat(F.lit('{"score":1,"x":{"rank":2,"y":'), "props", F.lit('},"z":[{"score":3},4]}'))
    return _t(spark, d, "events").select("event_id", V.without_keys(body, ("score", "rank")).alias("body"))


def s39_tree_paths(spark, d):
    """Paths of the tree of regions and their nations."""
    kids = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"))))
    tree = _t(spark, d, "nation").groupBy("n_regionkey").agg(kids.alias("children")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tree.select(F.posexplode(V.tree_paths(F.to_json(F.struct(F.col("r_name").alias("name"), "children")))).alias("at", "path")).select("path", F.col("at").cast("long").alias("at"))


def s22_pieces(spark, d):
    """Documents in pieces of at most 2,000 code points, cut behind line ends."""
    cut = _t(spark, d, "documents").select("doc_id", F.posexplode(pieces.split_text(F.col("text"), 2000)).alias("at", "piece"))
    return cut.select("doc_id", F.col("at").cast("long").alias("at"), F.sha2("piece", 256).alias("piece"))


def s40_diffs(spark, d):
    """Lines kept, removed and added from each document to the next of its source."""
    docs = _t(spark, d, "documents")
    places = J.ranked(docs.select("doc_id", "source"), ["source"], F.col("doc_id"))
    after = places.select("source", (F.col("rank") - 1).alias("rank"), F.col("doc_id").alias("next_id"))
    later = docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("later"))
    pairs = places.join(after, ["source", "rank"]).select("doc_id", "next_id").join(docs.select("doc_id", "text"), "doc_id").join(later, "next_id")
    met = pairs.select("doc_id", pieces.line_diff(F.col("text"), F.col("later")).alias("diff"))
    count = lambda mark: F.size(F.filter("diff", lambda x: F.startswith(x, F.lit(mark)))).cast("long")
    return met.select("doc_id", count(" ").alias("kept"), count("-").alias("removed"), count("+").alias("added"))


def s40_hunks(spark, d):
    """Hunks between a document's numbered words, a line each, and the same with some lines gone, changed and new."""
    words = F.split(F.translate("text", "\n", " "), " ")
    old = F.transform(words, lambda w, k: F.concat(k.cast("string"), F.lit(" "), w))
    gone = lambda k: (k % 23 == 3) | (k % 31 == 30)
    new = F.transform(words, lambda w, k: F.concat(
        F.when(gone(k), "").when(k % 41 == 11, F.concat(F.lit("changed "), k.cast("string"), F.lit("\n"))).otherwise(F.concat(k.cast("string"), F.lit(" "), w, F.lit("\n"))),
        F.when(k % 53 == 8, F.concat(F.lit("new "), k.cast("string"), F.lit("\n"))).otherwise(""),
    ))
    texts = _t(spark, d, "documents").select("doc_id", F.array_join(old, "\n").alias("old"), F.rtrim(F.array_join(new, ""), F.lit("\n")).alias("new"))
    found = compare.hunks(texts.select("doc_id", pieces.line_diff(F.col("old"), F.col("new")).alias("diff")), "doc_id")
    return found.select("doc_id", "hunk", "head", "n_lines")


QUERIES = {f.__name__: f for f in (
    a09_measures, a10_histogram, a17_progress, p08_p09_scopes, p11_broad_selection, r06_remaining, r07_deletable, r10_modes, r14_choices, set02_ordered_union, o07_largest, s24_s41_texts,
    s34_objects, s27_sentences, s36_schema, s37_mended, s38_without_scores, s39_tree_paths, s22_pieces, s40_diffs, s40_hunks,
)}

_F = """f as (select doc_id as path, source as folder, lang = 'en' as is_source, case when quality is null then 'NOT_ANALYZED' when toxic = 1 then 'OUTDATED' when quality = 1 then 'ANALYZED' else 'PARTIAL' end as status
  from documents left join labels using (doc_id))"""
#: ``s40_diffs`` carries a state from line to line, which SQL does not; the tests hold it against a plain form.
ORACLES = {
    "s40_hunks": """with w as (select doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) as w, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) - 1 as k from documents),
  o as (select doc_id, k, case when k % 23 = 3 or k % 31 = 30 then ['-'] when k % 41 = 11 then ['-', '+'] else [' '] end || case when k % 53 = 8 then ['+'] else [] end as marks from w),
  m as (select doc_id, unnest(marks) as mark, k, generate_subscripts(marks, 1) as s from o),
  l as (select *, row_number() over (partition by doc_id order by k, s) - 1 as pos from m),
  n as (select *, 1 + count(*) filter (mark <> '+') over b as old_at, 1 + count(*) filter (mark <> '-') over b as new_at from l window b as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)),
  c as (select doc_id, pos, case when pos - lag(pos) over (partition by doc_id order by pos) <= 4 then 0 else 1 end as opens from l where mark <> ' '),
  i as (select doc_id, pos, sum(opens) over (partition by doc_id order by pos) as hunk from c),
  h as (select doc_id, hunk, min(pos) - 3 as lo, max(pos) + 3 as hi from i group by 1, 2)
  select doc_id, hunk::bigint as hunk, format('@@ -{},{} +{},{} @@', min(old_at), count(*) filter (mark <> '+'), min(new_at), count(*) filter (mark <> '-')) as head, count(*) as n_lines
  from h join n using (doc_id) where pos between lo and hi group by 1, 2""",
    "a09_measures": f"""with {_F}, m as (select count(*) as files_total, count(*) filter (is_source) as sources, count(*) filter (status <> 'NOT_ANALYZED') as analyzed, count(*) filter (status = 'ANALYZED') as up_to_date,
  count(*) filter (status = 'OUTDATED') as outdated, count(distinct folder) filter (status <> 'NOT_ANALYZED') as folders from f)
  select *, round(100.0 * analyzed / case when sources > 0 then sources else files_total end)::bigint as percent,
  case when analyzed = 0 then 'NOT_ANALYZED' when analyzed >= case when sources > 0 then sources else files_total end and outdated = 0 then 'COMPLETE' else 'PARTIAL' end as state from m""",
    "a10_histogram": f"with {_F} select status, count(*) as files from f group by 1",
    "a17_progress": """select o_custkey, count(distinct l_partkey) filter (l_linestatus = 'F') as done, count(distinct l_partkey) as total,
  round(100.0 * count(distinct l_partkey) filter (l_linestatus = 'F') / count(distinct l_partkey))::bigint as percent from lineitem join orders on l_orderkey = o_orderkey group by 1""",
    "p08_p09_scopes": """with s as (select s_suppkey as k from supplier), e as (select distinct l_orderkey as a, l_partkey as b from lineitem)
  select a, b, a in (select k from s) and b in (select k from s) as both_ends from e where a in (select k from s) or b in (select k from s)""",
    "p11_broad_selection": f"""with {_F} select path, folder, row_number() over (partition by folder order by case when status = 'NOT_ANALYZED' then 0 else 2 end, path) as place from f where is_source and status in ('NOT_ANALYZED', 'PARTIAL')""",
    "r06_remaining": "select o_custkey, o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')",
    "r07_deletable": "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O')",
    "r10_modes": """with c as (select c_custkey, c_acctbal > 9000 as p, c_nationkey % 3 as w, c_nationkey % 5 as f, (c_mktsegment = 'BUILDING')::int as e, c_nationkey % 2 as d, c_nationkey % 7 as n from customer)
  select c_custkey, case when p then 'PROJECT' when w > 0 then 'WORKFLOW' when f > 0 then 'FEATURE' when e > 0 then 'DATABASE' when d > 0 then 'FOLDER' else 'FILE' end as mode,
  coalesce(nullif(concat_ws(', ', case when w > 0 then w || ' workflows' end, case when f > 0 then f || ' features' end, case when e > 0 then e || ' entities' end, case when d > 0 then d || ' folders' end,
    case when n > 0 then n || ' files' end, case when p then 'entire project' end), ''), 'nothing selected') as summary from c""",
    "r14_choices": f"with {_F} select 'feature' as kind, folder as name from f union select 'workflow', event_type from events union select 'file', path::varchar from f where is_source",
    "set02_ordered_union": """with x as (select user_id, event_type, min((case when value > 50 then 0 else 1 end, ts, event_id)) as k from events group by 1, 2) select user_id, string_agg(event_type, ',' order by k) as types from x group by 1""",
    "o07_largest": "select * from (select doc_id, source, row_number() over (partition by source order by length(text) desc, doc_id) as rank from documents) where rank <= 5",
    "s24_s41_texts": """select doc_id, case when len(string_split(text, lang)) = 2 then sha256(replace(text, lang, '<lang>')) end as replaced, least(30000.0, n_chars * 1.5)::double as wait from documents""",
    "s22_pieces": """with recursive p as (
    select doc_id, text, 0 as k, 0 as b, (case when length(text) <= 2000 then length(text) when contains(text[1:2000], chr(10)) then length(regexp_extract(text[1:2000], '(?s)^.*\\n')) else 2000 end) as e from documents
    union all
    select doc_id, text, k + 1, e, e + (case when length(text) - e <= 2000 then length(text) - e when contains(text[e + 1:e + 2000], chr(10)) then length(regexp_extract(text[e + 1:e + 2000], '(?s)^.*\\n')) else 2000 end)
    from p where e < length(text)
  ) select doc_id, k::bigint as at, sha256(text[b + 1:e]) as piece from p""",
    "s34_objects": """select event_id, '{"s": "}\\\\\\"{", "p": ' || props || '}' as object, 2 as n from events""",
    "s36_schema": """select event_id, concat_ws('; ', '$.user: missing', case when event_type not in ('click', 'view') then '$.kind: not one of its values' end,
  case when value > 50 then case when length(event_type) > 8 then '$.tags[0]: too long' end else '$.tags[1]: too long' end) as errors from events""",
    "s27_sentences": """select event_id, case when value > 75 then event_type || ' — user ' || user_id when value > 50 then event_type || '; of ' || user_id || '; ' || user_id
  when value > 25 then json(props)::varchar else user_id::varchar end as sentence from events""",
    "s37_mended": """select event_id, (4 + case when length(event_type) > 4 then 1 else 0 end)::int as wrong,
  '{"id":' || event_id || ',"tags":["' || event_type[1:4] || '","' || (user_id::varchar)[1:4] || '"],"title":"' || case when value > 50 then (event_type || ' — w')[1:8] else user_id::varchar end || '"}' as body,
  '$.owner: missing' as "left" from events""",
    "s38_without_scores": """select event_id, '{"x":{"y":' || json(props)::varchar || '},"z":[{},4]}' as body from events""",
    "s39_tree_paths": """select r_name as path, 0::bigint as at from region where r_regionkey in (select n_regionkey from nation) union all
  select r_name || '/' || n_name, row_number() over (partition by r_regionkey order by n_name) from nation join region on n_regionkey = r_regionkey""",
}
