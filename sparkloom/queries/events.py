"""Quotas, progress and state over the event table, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_any
from ..operators import chain, metering, retrieve
from ..sources.scratch import scratch
from ..sources.tables import table
from ..streaming import answers, flows, ledger, subscriptions
from .registry import query


def usage(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tenant"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.abs("value")).alias("tokens"))


US = "u as (select event_id, 'u' || user_id as tenant, ts, floor(abs(value))::bigint as tokens from events)"


@query("daily_token_ledger", f"with {US} select 'ledger:' || tenant || ':' || strftime(ts::date, '%Y-%m-%d') as key, sum(tokens)::bigint as tokens from u group by 1")
def daily_token_ledger(spark, sf_dir):
    out = metering.ledger(usage(spark, sf_dir))
    return out.select(F.concat(F.lit("ledger:"), "tenant", F.lit(":"), F.date_format("day", "yyyy-MM-dd")).alias("key"), "tokens")


@query("budget_reject", f"with {US} select event_id, coalesce(sum(tokens) over (partition by tenant, ts::date order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as used_before, coalesce(sum(tokens) over (partition by tenant, ts::date order by ts, event_id rows between unbounded preceding and 1 preceding), 0) >= 100 as rejected from u")
def budget_reject(spark, sf_dir):
    return metering.budget(usage(spark, sf_dir), 100).select("event_id", "used_before", "rejected")


@query("rate_limit_fixed", f"with {US} select tenant, (floor(epoch(ts))::bigint // 3600) * 3600 as window_start, count(*) as requests, greatest(count(*) - 1, 0) as rejected from u group by 1, 2")
def rate_limit_fixed(spark, sf_dir):
    return metering.rate_fixed(usage(spark, sf_dir), 1, 3600)


@query("rate_limit_sliding", f"with {US} select event_id, count(*) over (partition by tenant order by floor(epoch(ts))::bigint range between 3599 preceding and current row) as in_window from u")
def rate_limit_sliding(spark, sf_dir):
    return metering.rate_sliding(usage(spark, sf_dir), 2, 3600).select("event_id", "in_window")


@query("latest_progress", "select user_id, arg_max(event_type, event_id) as stage, max(event_id) as event_id from events group by user_id")
def latest_progress(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("stage"), F.max("event_id").alias("event_id"))


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


@query("failure_runs", "with c as (select user_id as key, event_id as seq, event_type <> 'error' as ok, sum((event_type <> 'error')::int) over (partition by user_id order by event_id) as island from events) select key, seq, sum((not ok)::int) over (partition by key, island order by seq)::bigint as failures from c")
def failure_runs(spark, sf_dir):
    return metering.failure_runs(calls(spark, sf_dir)).select("key", "seq", "failures")


BREAKER = """with recursive c as (select user_id as key, event_id as seq, epoch(ts) as now, event_type <> 'error' as ok, row_number() over (partition by user_id order by event_id) as rn from events),
f as (select key, 0 as rn, 0::bigint as seq, 'CLOSED' as state, false as asked, 'CLOSED' as name, 0 as failures, 0.0::double as opened from c group by key
  union all select key, rn, seq, before, before <> 'OPEN', case when before = 'OPEN' then 'OPEN' when ok then 'CLOSED' when before = 'HALF_OPEN' or failures + 1 >= 2 then 'OPEN' else before end,
    case when before = 'OPEN' then failures when ok then 0 else failures + 1 end, case when before <> 'OPEN' and not ok and (before = 'HALF_OPEN' or failures + 1 >= 2) then now when before <> 'OPEN' and ok then 0.0 else opened end
  from (select c.*, f.failures, f.opened, case when f.name = 'OPEN' and c.now - f.opened >= 3600 then 'HALF_OPEN' else f.name end as before from f join c on c.key = f.key and c.rn = f.rn + 1))
select key, seq, state, asked as primary_asked from f where rn > 0"""


@query("circuit_breaker", BREAKER)
def circuit_breaker(spark, sf_dir):
    return metering.circuit_breaker(calls(spark, sf_dir), threshold=2, open_s=3600)


def actions(e):
    """Events as steps of approvals, three users to one; one in four comes from somebody else, and a third of the approvals from nobody that is known."""
    step = F.when(F.col("event_id") % 3 == 0, F.lit("create")).when(F.col("event_id") % 3 == 1, F.lit("approve")).otherwise(F.lit("consume"))
    return e.select(
        F.floor(F.col("user_id") / 3).alias("approval_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), step.alias("action"), F.lit("t").alias("tenant"),
        F.when(F.col("event_id") % 4 == 3, F.lit("x")).when(F.floor(F.col("user_id") / 3) % 3 != 0, F.lit("u")).alias("user"),
    )


APPROVALS = """with recursive a as (select user_id // 3 as id, event_id as seq, epoch(ts) as now, ['create', 'approve', 'consume'][event_id % 3 + 1] as action, case when event_id % 4 = 3 then 'x' when user_id // 3 % 3 <> 0 then 'u' end as who, row_number() over (partition by user_id // 3 order by event_id) as rn from events),
f as (select id, 0 as rn, 0::bigint as seq, '' as action, false as done, '' as held, null::varchar as owner, 0.0::double as until from a group by id
  union all select id, rn, seq, action, done, case when action = 'create' then 'PENDING' when done and action = 'approve' then 'APPROVED' when done then '' else held end,
    case when action = 'create' then who else owner end, case when done and action <> 'consume' then now + 7200 else until end
  from (select *, action = 'create' or owner is not distinct from who and (action = 'approve' and held = 'PENDING' or action = 'consume' and held = 'APPROVED') as done
    from (select a.*, f.owner, f.until, case when a.now >= f.until then '' else f.held end as held from f join a on a.id = f.id and a.rn = f.rn + 1)))
select id as approval_id, seq, action, done from f where rn > 0"""


@query("approval_ledger", APPROVALS)
def approval_ledger(spark, sf_dir):
    return metering.approvals(actions(table(spark, sf_dir, "events")), 7200)


@query("stream_approvals", APPROVALS)
def stream_approvals(spark, sf_dir):
    return flows.run_to_table(flows.approvals(actions(flows.event_stream(spark, sf_dir)), 7200), "append")


@query("stream_circuit_breaker", BREAKER)
def stream_circuit_breaker(spark, sf_dir):
    e = flows.event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"))
    return flows.run_to_table(flows.circuit_breaker(e, threshold=2, open_s=3600), "append")


@query("stream_rate_limit", "select 'u' || user_id as tenant, time_bucket(interval '1 hour', ts)::timestamp as start, count(*) as requests, greatest(count(*) - 1, 0) as rejected from events group by 1, 2")
def stream_rate_limit(spark, sf_dir):
    e = flows.event_stream(spark, sf_dir).withColumn("tenant", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    out = flows.run_to_table(flows.rate_windows(e, 1, "1 hour"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_daily_ledger", f"with {US} select tenant, ts::date as day, sum(tokens)::bigint as tokens from u group by 1, 2")
def stream_daily_ledger(spark, sf_dir):
    e = flows.event_stream(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tenant"), "ts", F.floor(F.abs("value")).alias("tokens"))
    return flows.run_to_table(flows.daily_ledger(e), "complete")


@query("progress_alive", "with l as (select user_id, arg_max(event_type, ts) as stage, max(ts) as ts from events group by 1) select user_id, stage from l where ts >= (select max(ts) from l) - interval '24 hours'")
def progress_alive(spark, sf_dir):
    """The last stage of each key, of those that were heard of within a day."""
    return flows.alive(flows.latest(table(spark, sf_dir, "events"))).select("user_id", "stage")


@query("event_sliding", "with e as (select event_type, time_bucket(interval '30 minutes', ts)::timestamp as b from events), w as (select event_type, b as start from e union all select event_type, b - interval '30 minutes' from e) select event_type, start, count(*) as n from w group by 1, 2")
def event_sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.tumbling(e, "1 hour", slide="30 minutes").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("budget_counters", f"with {US}, b as (select tenant, tokens, coalesce(sum(tokens) over (partition by tenant, ts::date order by ts, event_id rows between unbounded preceding and 1 preceding), 0) >= 100 as rejected from u) select tenant, sum(tokens) filter (not rejected)::bigint as tokens_used, count(*) filter (rejected) as rejections from b group by 1")
def budget_counters(spark, sf_dir):
    return metering.rate_counters(metering.budget(usage(spark, sf_dir), 100))


# ten tenants, one in a hundred requests of none and one of white space only; each asks with a text of the benchmark
REQUESTS = """q as (select event_id, ts, case when event_id % 100 = 37 then null when event_id % 100 = 73 then chr(9) || chr(10) || ' ' else 'team ' || user_id % 10 end as tenant, floor(abs(value))::bigint as tokens, event_id % (select count(*) from benchmark) as item from events),
asked as (select q.*, contains(lower(b.text), 'et ') as stopped from q left join (select text, row_number() over (order by item_id) - 1 as item from benchmark) b using (item))"""
ADMITTED = """with recursive """ + REQUESTS + """,
r as (select *, epoch_us(ts) as us, epoch_us(ts) // 86400000000 as day, row_number() over (partition by tenant order by ts, event_id) as rn from asked where tenant like 'team%'),
f as (select tenant, 0::bigint as rn, -1::bigint as event_id, 0::bigint as used_before, 0 as permits_before, null::varchar as code, -1::bigint as day, 0::bigint as used, []::bigint[] as permits from r group by tenant
  union all select tenant, rn, event_id, today, len(free), code, day, today + case when code is null and not stopped then tokens else 0 end, case when code is null then free || [us] else free end
  from (select *, case when today >= 800 then 'TOKEN_BUDGET_EXCEEDED' when len(free) >= 1 then 'RATE_LIMITED' end as code
    from (select r.*, case when r.day = f.day then f.used else 0 end as today, list_filter(f.permits, lambda t: t > r.us - 3600000000) as free from f join r on r.tenant = f.tenant and r.rn = f.rn + 1)))"""
DECIDED = " select tenant, event_id, used_before, permits_before, code as error_code from f where rn > 0 union all select tenant, event_id, 0, 0, 'IDENTITY_INCOMPLETE' from asked where tenant is null or tenant not like 'team%'"


def requests(spark, sf_dir, events=None):
    """Events as requests of ten tenants, some of none, with a text of the benchmark each."""
    e = table(spark, sf_dir, "events") if events is None else events
    texts = table(spark, sf_dir, "benchmark")
    n = texts.count()
    text = texts.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("item"), "text")  # a benchmark is one task's work
    tenant = F.when(F.col("event_id") % 100 == 73, F.lit("\t\n ")).when(F.col("event_id") % 100 != 37, F.concat(F.lit("team "), (F.col("user_id") % 10).cast("string")))
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), tenant.alias("tenant"), F.floor(F.abs("value")).alias("tokens"), (F.col("event_id") % max(n, 1)).alias("item"))
    return rows.join(retrieve.small(text), "item", "left").drop("item")


def stopped(rows):
    return rows.withColumn("stopped", has_any(F.col("text"), ["et "], True))


@query("admitted_requests", ADMITTED + DECIDED)
def admitted_requests(spark, sf_dir):
    """Quotas with feedback: only what is let through takes permits, and only what is answered books tokens."""
    return metering.admitted(stopped(requests(spark, sf_dir)), 800, 1, 3600)


@query("stream_admitted", ADMITTED + DECIDED.replace("select tenant, event_id, 0", "select null, event_id, 0"))
def stream_admitted(spark, sf_dir):
    rows = stopped(requests(spark, sf_dir, flows.event_stream(spark, sf_dir)))
    return flows.run_to_table(flows.admitted(rows, 800, 1, 3600), "append")


@query("guarded_requests", ADMITTED + """, d as (""" + DECIDED + """) select d.event_id, coalesce(error_code, case when stopped then 'PROMPT_INJECTION' end) as error_code from d join asked using (event_id)""")
def guarded_requests(spark, sf_dir):
    """Requests through all guards; the first that turns one away names its error."""
    return chain.guarded(requests(spark, sf_dir), 800, 1, 3600, ("et ",)).select("event_id", "error_code")


@query("admission_counters", ADMITTED + """, d as (""" + DECIDED + """) select d.tenant, sum(tokens) filter (error_code is null and not stopped)::bigint as tokens_used, count(*) filter (error_code = 'TOKEN_BUDGET_EXCEEDED') as over_budget, count(*) filter (error_code = 'RATE_LIMITED') as over_rate from d join asked using (event_id) group by 1""")
def admission_counters(spark, sf_dir):
    """Tokens booked and requests turned away, by tenant."""
    rows = stopped(requests(spark, sf_dir))
    judged = metering.admitted(rows, 800, 1, 3600).join(rows.select("event_id", "tokens", "stopped"), "event_id")
    return metering.admission_counters(judged)


# an answer is a conversation's assistant turns, each in two pieces; some fail, some never end, some are of tools
ANSWERS = """a as (select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as n, text from conversations where role = 'assistant'),
p as (select conv_id, 2 * n as part, substr(text, 1, length(text) // 2) as text from a union all select conv_id, 2 * n + 1, substr(text, length(text) // 2 + 1) from a),
w as (select conv_id, string_agg(text, '' order by part) as answer, list(text order by part) as pieces, conv_id % 4 = 1 as tool from p group by conv_id),
fr as (select conv_id, case when conv_id % 13 = 5 then [{'event': 'ERROR', 'data': 'model failed'}] when conv_id % 11 = 0 then [{'event': 'ERROR', 'data': 'The answer did not end in time.'}]
  else (case when contains(answer, 'ndthe') or contains(answer, 'hathe') then [{'event': 'message', 'data': 'This answer was withheld.'}] else list_transform(list_filter(pieces, lambda x: x <> ''), lambda x: {'event': 'message', 'data': x}) end)
    || (case when not tool then [{'event': 'TRACE', 'data': '{"conv":' || conv_id || '}'}] when conv_id % 8 = 1 then [{'event': 'TOOL_CALL', 'data': '{"conv":' || conv_id || '}'}] else [] end) || [{'event': 'message', 'data': '[DONE]'}] end as fs from w),
frames as (select conv_id, i - 1 as seq, fs[i].event as event, fs[i].data as data from (select conv_id, fs, unnest(range(1, len(fs) + 1)) as i from fr))"""


FORBIDDEN = ("ndthe", "hathe")


def answer_parts(spark, sf_dir):
    """The parts of all answers, with some of them twice."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    a = turns.select("conv_id", (2 * (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1)).cast("long").alias("n"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    piece = F.posexplode(F.array(F.substr("text", F.lit(1), half), F.substr("text", half + 1))).alias("h", "text")
    tokens = a.select("conv_id", "n", piece).select("conv_id", (F.col("n") + F.col("h")).alias("part"), F.lit("TOKEN").alias("kind"), "text")
    ends = a.groupBy("conv_id").agg((F.max("n") + 2).alias("part")).where("conv_id % 13 = 5 or conv_id % 11 <> 0")
    kind = F.when(F.col("conv_id") % 13 == 5, F.lit("ERROR")).when(F.col("conv_id") % 4 == 1, F.lit("END_TOOL")).otherwise(F.lit("END"))
    payload = F.when(kind == "ERROR", F.lit("model failed")).when((kind == "END") | (F.col("conv_id") % 8 == 1), F.format_string('{"conv":%d}', "conv_id")).otherwise(F.lit(""))
    both = tokens.unionByName(ends.select("conv_id", "part", kind.alias("kind"), payload.alias("text")))
    twice = both.withColumn("again", F.explode(F.sequence(F.lit(0), F.when(F.xxhash64("conv_id", "part") % 5 == 0, 1).otherwise(0)))).drop("again")
    return twice.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("part") % 60))


def answer_stream(spark, sf_dir):
    """The parts in an order that has nothing to do with theirs, over six batches, and a clock that goes on after."""
    path = scratch(spark, "parts")
    parts = answer_parts(spark, sf_dir)
    parts.repartition(6, F.xxhash64("conv_id", "part", "text")).write.parquet(f"{path}/0")
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("part"), F.lit("TOKEN").alias("kind"), F.lit("").alias("text"), F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts"))
    clock.write.parquet(f"{path}/1")
    return spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@query("answer_frames", f"with {ANSWERS} select conv_id, seq, event, sha256(data) as data from frames")
def answer_frames(spark, sf_dir):
    out = answers.frames_of_all(answer_parts(spark, sf_dir), FORBIDDEN)
    return out.select("conv_id", F.col("seq").cast("long").alias("seq"), "event", F.sha2("data", 256).alias("data"))


@query("stream_answers", f"with {ANSWERS} select conv_id, seq, event, sha256(data) as data from frames")
def stream_answers(spark, sf_dir):
    out = flows.run_to_table(answers.frames(answer_stream(spark, sf_dir), FORBIDDEN), "append")
    return out.where("conv_id >= 0").select("conv_id", F.col("seq").cast("long").alias("seq"), "event", F.sha2("data", 256).alias("data"))


@query("stream_audit", f"with {ANSWERS} select conv_id, case when max(event) filter (event = 'ERROR') is null then 'SUCCESS' else 'ERROR' end as status, sha256(string_agg(data, '' order by seq) filter (event = 'message' and data <> '[DONE]')) as answer, max(data) filter (event = 'ERROR') as error, count(*) as n_frames from frames group by conv_id")
def stream_audit(spark, sf_dir):
    """The frames of the stream to one audit row an answer, written once."""
    path = scratch(spark, "audit")
    ledger.run(answers.frames(answer_stream(spark, sf_dir), FORBIDDEN), path, answers.answered)
    out = ledger.written(spark, path, "conv_id long, status string, answer string, error string, n_frames long")
    return out.where("conv_id >= 0").withColumn("answer", F.sha2("answer", 256))


READERS = """ac as (select 't' || user_id % 20 as topic, 's' || event_id % 5 as subscriber, event_id as seq, ts, case event_type when 'signup' then 'SUBSCRIBE' else 'UNSUBSCRIBE' end as action from events where event_type in ('signup', 'view')),
sp as (select *, lead(ts) over (partition by topic, subscriber order by ts, seq) as until from ac),
dl as (select e.topic, e.id, sp.subscriber, e.body from (select 't' || user_id % 20 as topic, event_id as id, ts, event_type as body from events where event_type not in ('signup', 'view')) e
  join sp on sp.topic = e.topic and action = 'SUBSCRIBE' and e.ts >= sp.ts and (until is null or e.ts < until))"""


def _read_and_asked(e):
    """Events of twenty topics, and the actions of their five subscribers."""
    topic = F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("topic")
    ts = F.col("ts").cast("timestamp").alias("ts")
    told = e.where("event_type not in ('signup', 'view')").select(topic, F.col("event_id").alias("id"), ts, F.col("event_type").alias("body"))
    action = F.when(F.col("event_type") == "signup", F.lit("SUBSCRIBE")).otherwise(F.lit("UNSUBSCRIBE")).alias("action")
    asked = e.where("event_type in ('signup', 'view')").select(topic, F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("subscriber"), F.col("event_id").alias("seq"), ts, action)
    return told, asked


@query("subscribed_events", f"with {READERS} select * from dl")
def subscribed_events(spark, sf_dir):
    return subscriptions.delivered(*_read_and_asked(table(spark, sf_dir, "events")))


@query("stream_subscriptions", f"with {READERS} select * from dl")
def stream_subscriptions(spark, sf_dir):
    """The same of streams: the events in an order of their own over four batches, and a clock that goes on after them."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    path = scratch(spark, "events")
    e.repartition(4, F.xxhash64("event_id")).write.parquet(f"{path}/0")
    clock = e.agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("interval 90 days")).alias("ts")).select("event_id", "ts", F.lit(None).cast("long").alias("user_id"), F.lit("view").alias("event_type"))
    clock.unionByName(clock.withColumn("user_id", F.lit(0).cast("long")).withColumn("event_type", F.lit("click"))).coalesce(1).write.parquet(f"{path}/1")
    files = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    return flows.run_to_table(subscriptions.stream(*_read_and_asked(files), late="40 days"), "append")


@query("event_tumbling", "select event_type, time_bucket(interval '1 hour', ts)::timestamp as start, count(*) as n from events group by 1, 2")
def event_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.tumbling(e).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_tumbling", "select event_type, time_bucket(interval '1 hour', ts)::timestamp as start, count(*) as n from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    out = flows.run_to_table(flows.tumbling(flows.event_stream(spark, sf_dir)), "complete")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_latest_progress", "select user_id, arg_max(event_type, ts) as stage from events group by user_id")
def stream_latest_progress(spark, sf_dir):
    return flows.run_to_table(flows.latest(flows.event_stream(spark, sf_dir)), "complete").select("user_id", "stage")


@query("event_session", "with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from o) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def event_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.sessions(e).select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), "n")
