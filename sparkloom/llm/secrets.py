"""Secret scans over an incremental blob ledger, on DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger, a
Parquet table that is only ever appended to, has one row per blob, rule and rule
version that was scanned, with the spans found. A scan looks only at pairs that
the ledger lacks, each blob once however many paths hold it, appends what it
found, and joins all findings back to every path.

Places come from the strings between the matches: a match starts where all
strings and matches before it end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scratch, stored


class Rule(NamedTuple):
    kind: str
    version: int
    #: Java regular expression; matches are taken leftmost, not overlapping.
    pattern: str
    #: A literal without which a text has no match, or nothing.
    needs: str
    #: The least length of ``group`` (characters).
    least: int
    group: int
    #: Whether the result's contract counts it.
    base: bool


#: The key names are matched in either case, so each letter is a class.
KEY_NAMES = ("password", "passwd", "secret", "token", "api_?key")
EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in KEY_NAMES)
ASSIGN = f"({EITHER})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", 1, ASSIGN, "", 6, 2, True),
    # a run of these letters is matched whole, so the least length can stand in the expression
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", "AKIA", 20, 0, True),
    Rule("hex", 1, "[0-9a-f]{24,}", "", 24, 0, True),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----", 1, 0, False),
)
SPANS = "array<struct<start:int,stop:int>>"
LEDGER = f"blob string, kind string, version int, spans {SPANS}"
PAIR = ["blob", "kind", "version"]


def spans(text: str, rule: Rule) -> Column:
    """Code-point spans of one rule in a text column (not null), end exclusive."""
    found = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))
    if rule.needs:
        found = F.when(F.contains(F.col(text), F.lit(rule.needs)), found).otherwise(F.array().cast("array<string>"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["m"])
        fits = F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least
        one = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(fits, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def placed(matches: Column) -> Column:
        between = F.split(F.col(text), rule.pattern, -1)
        parts = F.filter(F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap"))), lambda x: x["m"].isNotNull())
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
        return F.when(F.size(matches) > 0, F.aggregate(parts, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))

    return let(found, placed)


def blobs(docs: DataFrame, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(path, blob, tk)`` and ``(path, tk, body)`` of all rows; a null text is the empty blob."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(path).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), F.xxhash64(body).alias("tk"))
    return named, docs.select(F.col(path).alias("path"), F.xxhash64(body).alias("tk"), body.alias("body"))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger at ``path``; where there is none an empty one is begun."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def scan(named: DataFrame, bodies: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows of all pairs of ``named(path, blob, tk)`` and rules that ``ledger`` lacks, each once.

    ``bodies(path, tk, body)`` has the texts; ``tk`` tells those of one path
    apart, so that SHA-256 is made once for each.

    One path of each blob, its smallest, carries the text to be scanned, so
    that a blob that a third of all paths hold does not come together in one
    task.
    """
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    due = named.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path", "tk")).alias("low")).select("blob", "low", F.explode(wanted).alias("r"))
    due = (
        due.select("blob", "low", "r.kind", "r.version").join(ledger.select(*PAIR), PAIR, "left_anti")
        .groupBy("blob", "low").agg(F.array_sort(F.collect_set(F.struct("kind", "version"))).alias("due"))
    )
    due = stored(due.select("blob", F.col("low.path").alias("low"), F.col("low.tk").alias("low_tk"), "due"))
    if not due.limit(1).count():
        bodies = bodies.limit(0)  # nothing is new, so no text is moved
    # the same join at every size: what is new grows with the texts
    picked = bodies.join(due.hint("merge"), F.col("path").eqNullSafe(F.col("low")) & (F.col("tk") == F.col("low_tk"))).select("blob", "body", "due")
    rows = [
        F.when(
            F.array_contains("due", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans("body", r).alias("spans")),
        )
        for r in rules
    ]
    return picked.select("blob", F.explode(F.array(*rows)).alias("r")).where("r is not null").select("blob", "r.*").dropDuplicates(PAIR)


def findings(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``blob`` and ``found``, all spans (start, kind's place, stop, kind, base) in order.

    ``ledger`` is the folder of a ledger in a store that all executors share:
    pairs in it are not scanned again, and what is scanned now is appended.
    Without one this run begins its own in the shared folder. Rows that two
    runs at once append twice count once. A null text is empty. Null ids and
    repeated rows are each returned, an empty table gives none, and other
    columns are not looked at.
    """
    spark = docs.sparkSession
    where = ledger or scratch(spark, "secret-ledger")
    named, bodies = blobs(docs, path, text)
    named = stored(named)
    scan(named, bodies, read_ledger(spark, where), rules).write.mode("append").parquet(where)
    known = spark.read.schema(LEDGER).parquet(where)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    base = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.base)])
    now = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    kind = F.col("kind")
    told = stored(
        known.where((F.size("spans") > 0) & (F.col("version") == now[kind])).dropDuplicates(PAIR)
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[kind].alias("place"), s["stop"].alias("stop"), kind.alias("kind"), base[kind].alias("base"))).alias("one"))
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("one"))).alias("found"))
    )
    none = F.array().cast("array<struct<start:int,place:int,stop:int,kind:string,base:boolean>>")
    return named.select("path", "blob").join(told, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("found", none).alias("found"))
