"""The engine's tables, derived from whatever corpus the input folder holds, and the same as SQL.

Times are milliseconds since 1970; `NOW` and `LEDGER_NOW` stand for the wall clock, so that results don't
depend on when a query runs. Columns that records of a live system would carry (types, validity, markers)
follow from ids by fixed arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_767_225_600_000
LEDGER_NOW = 1_706_659_200_000
HOUR, DAY = 3_600_000, 86_400_000

TYPES = ("persona", "episodic", "instruction", "work_fact", "work_task", "work_method", "work_artifact", "project_rule", "tool_experience", "mystery", "work_other")
PERSISTENCE = ("p", "s", "o", "t", None, "o")
LAYERS = {"click": "l1-extract", "view": "l1-dedup", "signup": "l2", "purchase": "l3", "error": "graph"}
EVENT_TYPES = {"signup": "turn/start", "purchase": "turn/end", "click": "user/message", "view": "assistant/message", "error": "compaction"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at.cast("int") + 1)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    k = F.col("doc_id")
    created = F.lit(NOW) - (k % 20000) * HOUR
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"),
        k.alias("seq"),
        F.col("text").alias("content"),
        pick(TYPES, k % 11).alias("type"),
        F.when(k % 4 == 0, "chat").when(k % 4 == 1, "work").alias("extracted_family"),
        (F.col("n_chars") % 101).cast("int").alias("priority"),
        F.col("source").alias("scene"),
        created.alias("created_ms"),
        (created + (k % 50) * 60_000).alias("updated_ms"),
        F.when(k % 6 == 0, created - 10 * DAY).alias("valid_from_ms"),
        F.when(k % 5 == 0, created + (k % 90) * DAY).alias("valid_to_ms"),
        pick(PERSISTENCE, k % 6).alias("persistence"),
        F.when(k % 3 == 0, "evidence").when(k % 3 == 1, "unknown").alias("valid_to_source"),
        F.when(k % 11 == 3, "manual").when(k % 11 == 5, "obsolete").when(k % 11 == 7, "conflict").when(k % 11 == 9, "merge").alias("retired_reason"),
        F.when((k % 11).isin(7, 9), F.concat(F.lit("r"), (k + 2).cast("string"))).alias("superseded_by"),
        F.when(k % 3 == 1, "workspace").otherwise("global").alias("scope"),
        F.when(k % 3 == 1, F.concat(F.lit("w"), (k % 4).cast("string"))).alias("workspace_id"),
        F.when(k % 2 == 0, F.concat(F.lit("repo"), (k % 3).cast("string"))).alias("repo_key"),
        F.when(k % 13 == 0, "cross-project").alias("applicability"),
        F.when(F.col("toxic") == 1, "health").when(F.col("quality") == 1, "work").when(F.col("quality") == 0, "general").alias("wing"),
        F.when(k % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), (k % 17).cast("string")), F.concat(F.lit("area"), (k % 5).cast("string"), F.lit("/x")))).alias("tags"),
        (k % 3 + 1).cast("int").alias("version"),
        F.when(k % 7 == 0, F.concat(F.lit("ext"), k.cast("string"))).alias("ext_key"),
        F.col("lang"),
    )


RECORDS = f"""records AS (
  SELECT 'r' || d.doc_id AS id, d.doc_id AS seq, d.text AS content,
    (['persona','episodic','instruction','work_fact','work_task','work_method','work_artifact','project_rule','tool_experience','mystery','work_other'])[CAST(d.doc_id % 11 AS INT) + 1] AS type,
    CASE WHEN d.doc_id % 4 = 0 THEN 'chat' WHEN d.doc_id % 4 = 1 THEN 'work' END AS extracted_family,
    CAST(d.n_chars % 101 AS INT) AS priority, d.source AS scene,
    {NOW} - (d.doc_id % 20000) * {HOUR} AS created_ms,
    {NOW} - (d.doc_id % 20000) * {HOUR} + (d.doc_id % 50) * 60000 AS updated_ms,
    CASE WHEN d.doc_id % 6 = 0 THEN {NOW} - (d.doc_id % 20000) * {HOUR} - 10 * {DAY} END AS valid_from_ms,
    CASE WHEN d.doc_id % 5 = 0 THEN {NOW} - (d.doc_id % 20000) * {HOUR} + (d.doc_id % 90) * {DAY} END AS valid_to_ms,
    (['p','s','o','t',NULL,'o'])[CAST(d.doc_id % 6 AS INT) + 1] AS persistence,
    CASE WHEN d.doc_id % 3 = 0 THEN 'evidence' WHEN d.doc_id % 3 = 1 THEN 'unknown' END AS valid_to_source,
    CASE d.doc_id % 11 WHEN 3 THEN 'manual' WHEN 5 THEN 'obsolete' WHEN 7 THEN 'conflict' WHEN 9 THEN 'merge' END AS retired_reason,
    CASE WHEN d.doc_id % 11 IN (7, 9) THEN 'r' || (d.doc_id + 2) END AS superseded_by,
    CASE WHEN d.doc_id % 3 = 1 THEN 'workspace' ELSE 'global' END AS scope,
    CASE WHEN d.doc_id % 3 = 1 THEN 'w' || (d.doc_id % 4) END AS workspace_id,
    CASE WHEN d.doc_id % 2 = 0 THEN 'repo' || (d.doc_id % 3) END AS repo_key,
    CASE WHEN d.doc_id % 13 = 0 THEN 'cross-project' END AS applicability,
    CASE WHEN l.toxic = 1 THEN 'health' WHEN l.quality = 1 THEN 'work' WHEN l.quality = 0 THEN 'general' END AS wing,
    CASE WHEN d.doc_id % 4 = 3 THEN CAST([] AS VARCHAR[]) ELSE ['t' || (d.doc_id % 17), 'area' || (d.doc_id % 5) || '/x'] END AS tags,
    CAST(d.doc_id % 3 + 1 AS INT) AS version,
    CASE WHEN d.doc_id % 7 = 0 THEN 'ext' || d.doc_id END AS ext_key, d.lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations")
    return talk.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        "role",
        "text",
        (F.lit(NOW - 30 * DAY) + F.col("conv_id") * HOUR + F.col("turn") * 60_000).alias("ts_ms"),
        F.when(F.col("conv_id") % 3 != 0, F.col("turn").cast("int")).alias("turn"),
        (F.col("turn") % 2).cast("int").alias("step"),
        "conv_id",
        F.col("turn").alias("n"),
    )


MESSAGES = f"""messages AS (
  SELECT conv_id || ':' || turn AS id, 's' || conv_id AS session_id, role, text, {NOW - 30 * DAY} + conv_id * {HOUR} + turn * 60000 AS ts_ms,
    CASE WHEN conv_id % 3 <> 0 THEN CAST(turn AS INT) END AS turn, CAST(turn % 2 AS INT) AS step, conv_id, turn AS n FROM conversations)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    layers = F.create_map(*(F.lit(x) for pair in LAYERS.items() for x in pair))
    return events.select(
        epoch_ms(F.col("ts")).alias("ts_ms"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"),
        layers[F.col("event_type")].alias("layer"),
        (F.col("event_id") % 5000).alias("input_chars"),
        F.floor("value").alias("output_tokens"),
        (F.col("event_id") % 7).alias("reasoning_tokens"),
        "event_id",
    )


LEDGER = """ledger AS (
  SELECT (epoch_us(ts) // 1000) AS ts_ms, 'p' || (user_id % 3) AS provider, 'm' || (user_id % 5) AS model,
    CASE event_type WHEN 'click' THEN 'l1-extract' WHEN 'view' THEN 'l1-dedup' WHEN 'signup' THEN 'l2' WHEN 'purchase' THEN 'l3' WHEN 'error' THEN 'graph' END AS layer,
    event_id % 5000 AS input_chars, CAST(floor(value) AS BIGINT) AS output_tokens, event_id % 7 AS reasoning_tokens, event_id FROM events)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kinds = F.create_map(*(F.lit(x) for pair in EVENT_TYPES.items() for x in pair))
    kind = kinds[F.col("event_type")]
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_id").alias("seq"),
        kind.alias("type"),
        epoch_ms(F.col("ts")).alias("ts_ms"),
        F.when(kind.isin("turn/start", "turn/end"), F.floor(F.col("event_id") / 400).cast("int")).alias("turn"),
        F.col("props").alias("payload"),
    )


SESSION_EVENTS = """session_events AS (
  SELECT 'u' || user_id AS session_id, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'turn/start' WHEN 'purchase' THEN 'turn/end' WHEN 'click' THEN 'user/message' WHEN 'view' THEN 'assistant/message' WHEN 'error' THEN 'compaction' END AS type,
    (epoch_us(ts) // 1000) AS ts_ms, CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(event_id // 400 AS INT) END AS turn, props AS payload FROM events)"""
