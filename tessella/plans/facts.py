"""Queries of facts in pages, and of streams of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import extract
from tessella.streaming import messages


def x22_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, links, scripts, forms and hosts by page and line: every match of every rule, after the comments that open a line."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lit("html").alias("language"), F.col("html").alias("text"))
    return extract.facts(pages, extract.PAGES, keep=("page_id",))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def st1_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, from a stream."""
    once = messages.first_of_each(_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type"), "event_id", "ts", "1 hour")
    return messages.drained(once, "st1").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def st2_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of three versions, counted by type and by why they are refused."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    version = F.concat((F.col("event_id") % 3).cast("string"), F.lit(".2"))
    value = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), version.alias("version"), F.col("event_type").alias("type"), F.col("props").alias("body")))
    raw = events.select(F.when(F.col("event_id") % 10 == 9, F.lit("{broken")).otherwise(value).alias("value"))
    return messages.envelopes(raw).groupBy("type", "problem").agg(F.count("*").alias("messages"))


def st9_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of a user a bucket of two tokens, one more a day, lets pass."""
    return messages.drained(messages.rate_limited(_stream(spark, sf_dir), "user_id", "event_id", "ts", 1 / 86400, 2.0), "st9")


#: How events move a user's run, and after how many seconds without a sign it is silent and forgotten.
MOVES = {
    ("AWAITING_ACCEPT", "signup"): "IN_PROGRESS", ("IN_PROGRESS", "view"): "PAUSED", ("PAUSED", "click"): "IN_PROGRESS", ("IN_PROGRESS", "purchase"): "COMPLETED",
    ("IN_PROGRESS", "error"): "FAILED", ("FAILED", "signup"): "IN_PROGRESS", ("PAUSED", "error"): "CANCELLED", ("SILENT", "signup"): "IN_PROGRESS",
}
GAP, TTL = 16 * 3600, 24 * 3600


def st3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the users' runs, event by event, and their silences."""
    return messages.drained(messages.run_states(_stream(spark, sf_dir), "user_id", "event_id", "ts", "event_type", MOVES, GAP, TTL, "1 hour"), "st3")


def st1_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events repeat one of the last three kinds of their user, and the value that came with its first."""
    kinds = _stream(spark, sf_dir).withColumn("kind", F.concat_ws("-", "event_type", F.floor(F.col("value") / 25).cast("string"))).select("user_id", "kind", "ts", "event_id")
    found = messages.drained(messages.remembered(kinds, "user_id", "kind", "ts", "event_id", 3), "st1r")
    return found.groupBy("user_id", "kind", "duplicate", "event_id").agg(F.count("*").alias("messages"))


def st9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as attempts, errors as failures: two in a row block a user for a day."""
    attempts = _stream(spark, sf_dir).withColumn("failed", F.col("event_type") == "error").select("user_id", "event_id", "ts", "failed")
    return messages.drained(messages.blocked(attempts, "user_id", "event_id", "ts", "failed", 2, 86_400, "1 hour"), "st9b")


def _rule_sql(r: extract.LineRule) -> str:
    return f"""select page_id, line, '{r.kind}' as kind, unnest(regexp_extract_all(body, '{r.pattern}', 1)) as name, '' as detail from l"""


QUERIES = {"x22_page_facts": x22_page_facts, "st1_dedup_stream": st1_dedup_stream, "st2_envelopes": st2_envelopes, "st3_runs": st3_runs, "st1_replies": st1_replies, "st9_blocks": st9_blocks, "st9_rate_limit": st9_rate_limit}
ORACLES = {
    "x22_page_facts": f"""
with s as (select page_id, string_split(html, chr(10)) as lines from pages),
u as (select page_id, unnest(lines) as whole, unnest(range(1, len(lines) + 1)) as line from s),
l as (select page_id, line, regexp_replace(whole, '^(?:\\s*<!--.*?-->)+', '') as body from u where not regexp_matches(regexp_replace(whole, '^(?:\\s*<!--.*?-->)+', ''), '^\\s*<!--'))
"""
    + " union all ".join(map(_rule_sql, extract.PAGES)),
    "st1_dedup_stream": "select distinct event_id, ts, user_id, event_type from events",
    "st3_runs": """
with recursive e as (select user_id, event_id, event_type, epoch_us(ts) as at_us, row_number() over (partition by user_id order by ts, event_id) as n from events),
t(status, action, after) as (values {moves}),
r(user_id, n, status, last, event_id, silent, accepted) as (
  select distinct user_id, 0::bigint, 'AWAITING_ACCEPT', null::bigint, null::bigint, null::bigint, null::boolean from e
  union all
  select x.user_id, x.n, coalesce(t.after, x.now), x.at_us, x.event_id, x.silent, t.after is not null from (
    select user_id, n, event_id, event_type, at_us, silent, case when held is not null and was in ('SILENT', 'COMPLETED', 'CANCELLED') and at_us - held > {ttl} then 'AWAITING_ACCEPT' else was end as now from (
      select *, case when silent is not null then 'SILENT' else status end as was, coalesce(silent, last) as held from (
        select e.*, r.status, r.last, case when r.status not in ('SILENT', 'COMPLETED', 'CANCELLED') and e.at_us - r.last > {gap} then r.last + {gap} end as silent from r join e on e.user_id = r.user_id and e.n = r.n + 1))
  ) x left join t on t.status = x.now and t.action = x.event_type
),
ends as (select user_id, max_by(status, n) as status, max(last) as last from r group by user_id)
select user_id, event_id, last as at, status, accepted from r where n > 0
union all select user_id, null, silent, 'SILENT', true from r where silent is not null
union all select user_id, null, last + {gap}, 'SILENT', true from ends where status not in ('SILENT', 'COMPLETED', 'CANCELLED') and (last + {gap}) // 1000 + 1 <= (select epoch_ms(max(ts)) - 3600000 from events)""".replace(
        "{moves}", ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in MOVES.items())
    ).replace("{gap}", str(GAP * 1_000_000)).replace("{ttl}", str(TTL * 1_000_000)),
    "st1_replies": """
with recursive e as (select user_id, event_type || '-' || floor(value / 25)::bigint as kind, event_id, row_number() over (partition by user_id order by ts, event_type || '-' || floor(value / 25)::bigint, event_id) as n from events),
r(user_id, n, kind, duplicate, reply, ids, replies) as (
  select distinct user_id, 0::bigint, null::varchar, null::boolean, null::bigint, []::varchar[], []::bigint[] from e
  union all
  select user_id, n, kind, p is not null, coalesce(replies[p], event_id), case when p is not null then ids else list_append(ids, kind)[-3:] end, case when p is not null then replies else list_append(replies, event_id)[-3:] end
  from (select e.*, r.ids, r.replies, nullif(list_position(r.ids, e.kind), 0) as p from r join e on e.user_id = r.user_id and e.n = r.n + 1)
) select user_id, kind, duplicate, reply as event_id, count(*) as messages from r where n > 0 group by all""",
    "st9_blocks": """
with recursive e as (select user_id, event_id, event_type = 'error' as failed, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
r(user_id, n, event_id, outcome, c, until) as (
  select distinct user_id, 0::bigint, null::bigint, null::varchar, 0::bigint, 0::bigint from e
  union all
  select user_id, n, event_id, case when u > 0 then 'blocked' when failed then 'failed' else 'passed' end, case when u > 0 then k when failed then k + 1 else 0 end,
    case when u > 0 then u when failed and k + 1 >= 2 then t + 86400000000 else 0 end
  from (select e.*, case when r.until > 0 and r.until <= e.t then 0 else r.c end as k, case when r.until > 0 and r.until <= e.t then 0 else r.until end as u from r join e on e.user_id = r.user_id and e.n = r.n + 1)
) select user_id, event_id, outcome from r where n > 0""",
    "st2_envelopes": """
select case when event_id % 10 <> 9 then event_type end as type,
       case when event_id % 10 = 9 then 'malformed' when event_id % 3 <> 1 then 'version' end as problem, count(*) as messages
from events group by all""",
}
