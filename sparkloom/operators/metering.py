"""Per-tenant quotas and state machines, replayed over tables of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_text
from ..sources.arrow import batches, rows_of, schema_of


def ledger(usage: DataFrame) -> DataFrame:
    """``usage(tenant, ts, tokens)`` to tokens by tenant and UTC day."""
    return usage.groupBy("tenant", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"))


def budget(usage: DataFrame, limit: float) -> DataFrame:
    """Each request with what its tenant had used that day before it, and whether that rejects it."""
    w = Window.partitionBy("tenant", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("tokens").over(w), F.lit(0))
    return usage.withColumn("used_before", used).withColumn("rejected", F.col("used_before") >= limit)


def rate_fixed(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Requests by tenant and fixed window, and how many go over the limit."""
    at = (F.floor(F.unix_timestamp("ts") / seconds) * seconds).cast("long")
    return requests.where(has_text(F.col("tenant"))).groupBy("tenant", at.alias("window_start")).agg(F.count(F.lit(1)).alias("requests")).withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0)))


def rate_sliding(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Each request with the number of its tenant's in the seconds up to it."""
    w = Window.partitionBy("tenant").orderBy(F.unix_timestamp("ts")).rangeBetween(-(seconds - 1), 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("rejected", F.col("in_window") > limit)


def failure_runs(calls: DataFrame) -> DataFrame:
    """Consecutive failures up to each call, which a success sets back."""
    order = Window.partitionBy("key").orderBy("seq")
    island = calls.withColumn("island", F.sum(F.col("ok").cast("int")).over(order))
    return island.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("key", "island").orderBy("seq"))).drop("island")


def rate_counters(judged: DataFrame) -> DataFrame:
    """Tokens used and requests turned away, by tenant, of what ``budget`` gives."""
    return judged.groupBy("tenant").agg(F.sum(F.when(~F.col("rejected"), F.col("tokens"))).alias("tokens_used"), F.count_if("rejected").alias("rejections"))


def admission_counters(judged: DataFrame) -> DataFrame:
    """Tokens booked and requests turned away by budget and by rate, by tenant, of what ``admitted`` gives, with ``tokens`` and ``stopped``."""
    booked = F.sum(F.when(F.col("error_code").isNull() & ~F.col("stopped"), F.col("tokens")))
    return judged.groupBy("tenant").agg(booked.alias("tokens_used"), F.count_if(F.col("error_code") == "TOKEN_BUDGET_EXCEEDED").alias("over_budget"), F.count_if(F.col("error_code") == "RATE_LIMITED").alias("over_rate"))


CLOSED = ("CLOSED", 0, 0.0)


def breaker_step(state: tuple[str, int, float], row: tuple, threshold: int, open_s: float) -> tuple[tuple[str, int, float], tuple]:
    """The state (name, failures, opened at) after a call ``row`` of (seq, us, ok), and (seq, the name before it, whether the primary was asked)."""
    name, failures, opened = state
    seq, us, ok = row
    now = us / 1e6
    if name == "OPEN" and now - opened >= open_s:
        name = "HALF_OPEN"
    if name == "OPEN":
        return (name, failures, opened), (seq, name, False)
    if ok:
        return CLOSED, (seq, name, True)
    failures += 1
    after = ("OPEN", failures, now) if name == "HALF_OPEN" or failures >= threshold else (name, failures, opened)
    return after, (seq, name, True)


NOBODY = ("", None, None, 0)


def approval_step(held: tuple[str, str | None, str | None, int], row: tuple, ttl_s: float) -> tuple[tuple[str, str | None, str | None, int], tuple]:
    """What is held (state, tenant, user, until) after a ``row`` of (seq, us, action, tenant, user), and (seq, action, whether it took effect).

    Nothing is held after its time. Tenant and user must be those of the
    creation; a null is equal to a null only.
    """
    seq, us, action, tenant, user = row
    if held[0] and us >= held[3]:
        held = NOBODY
    own = bool(held[0]) and (held[1], held[2]) == (tenant, user)
    until = us + round(ttl_s * 1e6)
    if action == "create":
        return ("PENDING", tenant, user, until), (seq, action, True)
    if action == "approve" and own and held[0] == "PENDING":
        return ("APPROVED", tenant, user, until), (seq, action, True)
    if action == "consume" and own and held[0] == "APPROVED":
        return NOBODY, (seq, action, True)
    return held, (seq, action, False)


#: Microseconds of a UTC day; ledgers are kept for so many days.
DAY, LEDGER_DAYS = 86_400_000_000, 2
#: What admission holds of a tenant: the days of its ledgers, the tokens booked on each, and when the permits in use were given.
IDLE = ((), (), ())


def admission_step(state: tuple[tuple, tuple, tuple], row: tuple, budget: float, limit: int, seconds: int) -> tuple[tuple, tuple]:
    """The state after a ``row`` of (event_id, us, tenant, tokens, stopped), and (event_id, used before, permits in use before, error code).

    A request is turned away when its tenant's day has used the budget, else
    when ``limit`` permits were given in the seconds before it. Only one that
    is let through takes a permit, and only one that no later guard has
    ``stopped`` books its tokens (nulls and negative numbers book nothing). A
    tenant that is null or blank holds nothing and is turned away.
    """
    event, us, tenant, tokens, stopped = row
    if tenant is None:
        return state, (event, 0, 0, "IDENTITY_INCOMPLETE")
    day = us // DAY
    ledgers = dict(zip(state[0], state[1]))
    used = ledgers.get(day, 0)
    permits = tuple(t for t in state[2] if t > us - seconds * 1_000_000)
    code = "TOKEN_BUDGET_EXCEEDED" if used >= budget else "RATE_LIMITED" if len(permits) >= limit else None
    out = (event, used, len(permits), code)
    if code is None:
        permits += (us,)
        if not stopped and (tokens or 0) > 0:
            ledgers[day] = used + tokens
    kept = sorted(d for d in ledgers if d > max(day, *ledgers) - LEDGER_DAYS) if ledgers else []
    return (tuple(kept), tuple(ledgers[d] for d in kept), permits), out


def admission_until(state: tuple[tuple, tuple, tuple], seconds: int) -> int:
    """When nothing of a tenant's state matters any longer, in microseconds."""
    return max([0, *((d + LEDGER_DAYS) * DAY for d in state[0]), *(t + seconds * 1_000_000 for t in state[2])])


BREAKER, APPROVAL = "seq long, state string, primary_asked boolean", "seq long, action string, done boolean"
ADMISSION = "event_id long, used_before long, permits_before int, error_code string"
#: Columns of a step's row; the first orders rows of one time.
CALL, ACTION, REQUEST = ("seq", "us", "ok"), ("seq", "us", "action", "tenant", "user"), ("event_id", "us", "tenant", "tokens", "stopped")


def folded(rows: DataFrame, key: str, columns: tuple[str, ...], order: tuple[str, ...], first: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]], schema: str) -> DataFrame:
    """Each row of a key with what ``step`` makes of it and of the state that the rows before it left.

    What a row does depends on what was decided before, so a key's rows are
    one task's work; they are sorted by Spark and pass by one after another,
    and the task holds the state of one key, never its rows.
    """
    whole = f"`{key}` {rows.schema[key].dataType.simpleString()}, {schema}"
    shape = schema_of(whole)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            state, now, begun = first, None, False
            for held, *row in rows_of(parts):
                if not begun or held != now:
                    state, now, begun = first, held, True
                state, out = step(state, tuple(row))
                yield held, *out

        yield from batches(made(), shape)

    ordered = rows.select(F.col(key).alias("fold_key"), *columns).repartition("fold_key").sortWithinPartitions("fold_key", *order)
    return ordered.mapInArrow(run, whole)


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")).alias("us")


def circuit_breaker(calls: DataFrame, threshold: int = 5, open_s: float = 30.0) -> DataFrame:
    """``calls(key, seq, ts, ok)`` to the state before each call and whether the primary was asked."""
    return folded(calls.select("key", "seq", micros(), "ok"), "key", CALL, ("seq",), CLOSED, lambda s, r: breaker_step(s, r, threshold, open_s), BREAKER)


def approvals(actions: DataFrame, ttl_s: float = 600.0) -> DataFrame:
    """``actions(approval_id, seq, ts, action, tenant, user)`` to whether each took effect: created, approved, consumed once, by its own tenant and user."""
    rows = actions.select("approval_id", "seq", micros(), "action", "tenant", "user")
    return folded(rows, "approval_id", ACTION, ("seq",), NOBODY, lambda s, r: approval_step(s, r, ttl_s), APPROVAL)


def admitted(requests: DataFrame, budget: float, limit: int, seconds: int = 60) -> DataFrame:
    """``requests(tenant, event_id, ts, tokens[, stopped])`` in order of time to each one's error code (null: let through), see ``admission_step``.

    ``stopped`` tells the requests that a later guard turns away. Columns:
    tenant, event_id, used_before, permits_before, error_code.
    """
    # tenants that are turned away without a state need no fold, and no common task
    rows = admission_rows(requests)
    known = folded(rows.where("tenant is not null").withColumn("key", F.col("tenant")), "key", REQUEST, ("us", "event_id"), IDLE, lambda s, r: admission_step(s, r, budget, limit, seconds), ADMISSION)
    nobody = rows.where("tenant is null").select("asked_by", "event_id", F.lit(0).cast("long").alias("used_before"), F.lit(0).alias("permits_before"), F.lit("IDENTITY_INCOMPLETE").alias("error_code"))
    return known.unionByName(nobody.withColumnRenamed("asked_by", "key")).withColumnRenamed("key", "tenant")


def admission_rows(requests: DataFrame) -> DataFrame:
    """What admission looks at: REQUEST's columns, a tenant of white space as null, and ``asked_by``, the tenant as it is."""
    stopped = F.coalesce("stopped", F.lit(False)) if "stopped" in requests.columns else F.lit(False)
    tenant = F.when(has_text(F.col("tenant")), F.col("tenant"))
    return requests.select("event_id", "ts", micros(), tenant.alias("tenant"), F.col("tokens").cast("long").alias("tokens"), stopped.alias("stopped"), F.col("tenant").alias("asked_by"))
