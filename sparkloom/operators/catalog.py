"""Finders, lookups and subscriptions over the tables of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: The tables' columns; ids are texts, times have no zone.
TABLES = {
    "document": "id string, tenant_id string, name string, original_name string, type string, size long, status string, parse_route string, page_count int, table_count int, image_count int, chunk_count int, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "section": "id string, doc_id string, parent_id string, title string, level int, order_index int, start_page int, end_page int",
    "chunk": "id string, doc_id string, chunk_index int, content string, original_content string, page_num int, token_count int, metadata string, chunk_type string, vector_id string, is_deleted boolean, created_at timestamp_ntz",
    "session": "id string, tenant_id string, user_id string, title string, status string, message_count int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "message": "id string, session_id string, role string, content string, created_at timestamp_ntz",
    "audit_log": "trace_id string, tenant_id string, user_id string, session_id string, mode string, query_text string, rewritten_query string, retrieval_type string, retrieved_chunks string, reranked_chunks string, final_answer string, tool_calls string, latency_ms int, token_usage string, status string, error_code string, created_at timestamp_ntz",
    "feedback": "id string, message_id string, audit_id string, rating string, comment string, tags string, resolved boolean",
    "prompt_template": "id string, name string, version int, content string, status string",
    "embedding": "id string, embedding array<float>, content string, metadata string",
}
#: Columns whose values are one of a few.
ALLOWED = {
    ("document", "status"): ("UPLOADING", "PARSING", "SUCCESS", "FAILED"),
    ("document", "parse_route"): ("NATIVE", "DEEP", "OCR"),
    ("chunk", "chunk_type"): ("TEXT", "TABLE", "IMAGE"),
}
#: (table, column, table that it names).
REFERENCES = (("section", "doc_id", "document"), ("chunk", "doc_id", "document"), ("message", "session_id", "session"), ("feedback", "message_id", "message"))


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def ensured(spark, name: str, path: str) -> DataFrame:
    """The table at ``path``; where there is none an empty one is begun."""
    spark.createDataFrame([], schema(name)).write.mode("append").parquet(path)
    return spark.read.schema(schema(name)).parquet(path)


def misfits(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a value that their column does not allow, and which column."""
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(c)) for (t, c), values in ALLOWED.items() if t == name]
    return rows.withColumn("misfit", F.coalesce(*wrong) if wrong else F.lit(None).cast("string")).where("misfit is not null")


def orphans(rows: DataFrame, column: str, named: DataFrame, key: str = "id") -> DataFrame:
    """Rows that name something that is not there; null names nothing."""
    return rows.where(F.col(column).isNotNull()).join(named.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def listed(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """Rows with their ``position`` (from 1) in the list of their ``by``: what a finder of one key gives, for all keys at once."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def newest(rows: DataFrame, *by: str, version: str) -> DataFrame:
    """Of each ``by`` the row of the highest version."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return best.select(*by, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def of_version(asked: DataFrame, templates: DataFrame) -> DataFrame:
    """``asked(name, version, ...)`` with the ``content`` of that template; of several rows of one version that of the smallest id, null for unknown ones."""
    one = templates.where(F.col("name").isNotNull() & F.col("version").isNotNull()).groupBy("name", "version").agg(F.min_by("content", "id").alias("content"))
    return asked.join(one, ["name", "version"], "left")


def chat_window(messages: DataFrame, keep: int = 20, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``keep`` messages of each conversation, and all of the system."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(turn)))
    return messages.withColumn("place", place).where((F.col("place") <= keep) | (F.col("role") == "system")).drop("place")


def looked_up(asked: DataFrame, people: DataFrame) -> DataFrame:
    """``asked(keyword)`` by id, else by name (of several of one name the smallest id); unknown ones have null."""
    ids = people.select(F.col("id").alias("keyword"), F.struct("id", "name").alias("by_id"))
    names = people.groupBy(F.col("name").alias("keyword")).agg(F.min(F.struct("id", "name")).alias("by_name"))
    found = asked.join(ids, "keyword", "left").join(names, "keyword", "left").withColumn("p", F.coalesce("by_id", "by_name"))
    return found.select(*asked.columns, F.col("p.id").alias("id"), F.col("p.name").alias("name"))


def subscribed(actions: DataFrame) -> DataFrame:
    """``actions(session, topic, seq, action)`` to the pairs whose last action is to subscribe."""
    last = actions.groupBy("session", "topic").agg(F.max_by("action", "seq").alias("action"))
    return last.where("action = 'subscribe'").select("session", "topic")


def fanned_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every event of a topic to every session that has subscribed to it."""
    return events.join(subscriptions, "topic")


def fanout_counts(events: DataFrame, subscriptions: DataFrame, event: str = "event_id") -> DataFrame:
    """How many rows ``fanned_out`` has for each session, and the smallest event of them: counted by topic before the join, so that no pair is made."""
    of_topic = events.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(event).alias("first_id"))
    return subscriptions.join(of_topic, "topic").groupBy("session").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


def frames(tokens: DataFrame, ends: DataFrame, key: str = "conv_id") -> DataFrame:
    """A stream's frames in order: its tokens ``(key, seq, data)``, the frame of ``ends(key, event, data)``, then ``[DONE]``."""
    parts = tokens.select(key, F.lit(0).alias("part"), "seq", F.lit("token").alias("event"), "data")
    parts = parts.unionByName(ends.select(key, F.lit(1).alias("part"), F.lit(0).alias("seq"), "event", "data"))
    parts = parts.unionByName(tokens.select(key).distinct().select(key, F.lit(2).alias("part"), F.lit(0).alias("seq"), F.lit("message").alias("event"), F.lit("[DONE]").alias("data")))
    return parts.withColumn("frame", F.row_number().over(Window.partitionBy(key).orderBy("part", "seq"))).select(key, "frame", "event", "data")


def parsed_frames(lines: DataFrame, key: str = "conv_id") -> DataFrame:
    """``lines(key, seq, line)`` of an event stream to its data: an ``event:`` line names the ones that follow up to a blank line."""
    order = Window.partitionBy(key).orderBy("seq")
    block = F.sum((F.trim("line") == "").cast("int")).over(order)
    marked = lines.withColumn("block", block).withColumn("name", F.when(F.col("line").startswith("event:"), F.trim(F.substring("line", 7, 1 << 30))))
    within = Window.partitionBy(key, "block").orderBy("seq")
    named = marked.withColumn("event", F.coalesce(F.last("name", True).over(within), F.lit("message")))
    return named.where(F.col("line").startswith("data:")).select(key, "seq", "event", F.trim(F.substring("line", 6, 1 << 30)).alias("data"))
