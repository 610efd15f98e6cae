"""Joins between records, messages, journals and remote copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators.shared import checkpoint


def missing(rows: DataFrame, *present: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key none of the other tables has."""
    return reduce(lambda left, other: left.join(other.select(key), key, "left_anti"), present, rows)


def nearest_in_window(messages: DataFrame, segments: DataFrame, window_ms: int = 90_000) -> DataFrame:
    """For each message (id, session_id, role, ts_ms) its turn from segments (session_id, role, turn, step, time_ms), or why there's none.

    Both sides are cut into buckets of the window's width; a message asks its own bucket and both neighbours, so sessions
    aren't joined with themselves in full. Of several segments of the one turn the nearest in time counts.
    """
    valid = segments.where("turn > 0")
    by_session = valid.select("session_id").distinct().withColumn("in_session", F.lit(True))
    by_role = valid.select("session_id", "role").distinct().withColumn("in_role", F.lit(True))
    bucket = F.floor(F.col("ts_ms") / window_ms)
    asked = messages.select("id", "session_id", "role", "ts_ms", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    held = valid.select("session_id", "role", "turn", "step", "time_ms", F.floor(F.col("time_ms") / window_ms).alias("bucket"))
    delta = F.abs(F.col("time_ms") - F.col("ts_ms"))
    near = asked.join(held, ["session_id", "role", "bucket"]).where(delta <= window_ms)
    best = near.groupBy("id").agg(F.countDistinct("turn").alias("turns"), F.min(F.struct(delta.alias("delta"), "time_ms", "turn", "step")).alias("s"))
    told = messages.select("id", "session_id", "role").join(by_session, "session_id", "left").join(by_role, ["session_id", "role"], "left").join(best, "id", "left")
    reason = F.when(F.col("in_session").isNull(), "no-session").when(F.col("in_role").isNull(), "no-role").when(F.col("turns").isNull(), "out-of-window").when(F.col("turns") > 1, "ambiguous-turn")
    fills = reason.isNull()
    return told.select("id", reason.alias("skip"), F.when(fills, F.col("s.turn")).alias("turn"), F.when(fills, F.col("s.step")).alias("step"), F.when(fills, F.col("s.delta")).alias("delta_ms"))


def tombstones(journal: DataFrame) -> DataFrame:
    """(hash, reason) that are still in force: the last event of an id is a retirement by hand or by conflict."""
    last = journal.groupBy("id").agg(F.max_by(F.struct("ev", "reason", "hash"), "seq").alias("e"), F.max("seq").alias("seq"))
    live = last.where((F.col("e.ev") == "retire") & F.col("e.reason").isin("manual", "conflict") & F.col("e.hash").isNotNull())
    return live.groupBy(F.col("e.hash").alias("hash")).agg(F.max_by("e.reason", "seq").alias("reason"))


def suppressed(records: DataFrame, journal: DataFrame) -> DataFrame:
    """(id, reason) of records whose content is under a tombstone."""
    return records.select("id", C.content_digest(F.col("content")).alias("hash")).join(tombstones(journal), "hash").select("id", "reason")


def three_way(db: DataFrame, file: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, verdict, action) of contents in three places: tables (key, content), the remote with several rows a key."""
    one = lambda df, name: df.select("key", C.content_digest(F.col("content")).alias(name))
    remotes = one(remote, "d").groupBy("key").agg(F.array_sort(F.collect_set("d")).alias("remotes"))
    rows = one(db, "db").join(one(file, "file"), "key", "full").join(remotes, "key", "full")
    has_db, has_file, has_remote = F.col("db").isNotNull(), F.col("file").isNotNull(), F.size(F.coalesce("remotes", F.array().cast("array<string>"))) > 0
    db_remote = F.coalesce(F.array_contains("remotes", F.col("db")), F.lit(False))
    file_remote = F.coalesce(F.array_contains("remotes", F.col("file")), F.lit(False))
    same = F.coalesce(F.col("db") == F.col("file"), F.lit(False))
    cases: list[tuple[Column, str, str]] = [
        (~has_db & ~has_file & ~has_remote, "no-data", "none"),
        (has_db & ~has_file & ~has_remote, "db-only", "rewrite-file"),
        (~has_db & has_file & ~has_remote, "file-only", "reimport-db"),
        (~has_db & ~has_file & has_remote, "remote-only", "pull"),
        (has_db & has_file & ~has_remote & same, "db-file", "none"),
        (has_db & has_file & ~has_remote, "all-differ", "conflict"),
        (has_db & ~has_file & db_remote, "db-remote", "rewrite-file"),
        (has_db & ~has_file, "db-remote", "push"),
        (~has_db & has_file & file_remote, "file-remote", "reimport-db"),
        (~has_db & has_file, "file-remote", "pull"),
        (same & db_remote, "all-same", "none"),
        (same, "db-file", "push"),
        (db_remote, "db-remote", "rewrite-file"),
        (file_remote, "file-remote", "reimport-db"),
    ]
    verdict = reduce(lambda c, x: c.when(x[0], x[1]), cases[1:], F.when(cases[0][0], cases[0][1])).otherwise("all-differ")
    action = reduce(lambda c, x: c.when(x[0], x[2]), cases[1:], F.when(cases[0][0], cases[0][2])).otherwise("conflict")
    return rows.select("key", verdict.alias("verdict"), action.alias("action"))


def sources_covered(records: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, covered): whether all source messages of a record are in a snapshot of ids; a record without any isn't."""
    each = records.select("id", F.explode("source_message_ids").alias("message"))
    held = each.join(snapshot.select(F.col("id").alias("message"), F.lit(True).alias("held")), "message", "left")
    covered = held.groupBy("id").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("covered"))
    return records.select("id").join(covered, "id", "left").select("id", F.coalesce("covered", F.lit(False)).alias("covered"))


def plan_preserve(facts: DataFrame, live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, fate) when a store is rebuilt from a log: what can be derived again, what must be kept and why, what is gone."""
    covered = sources_covered(facts, snapshot)
    known = facts.select("id", (F.size("source_message_ids") > 0).alias("sourced")).join(covered, "id")
    both = known.withColumn("logged", F.lit(True)).join(live.select("id", F.col("content").alias("now"), F.lit(True).alias("live")), "id", "full")
    empty = F.coalesce(F.trim("now"), F.lit("")) == ""
    fate = (
        F.when(F.col("logged").isNull(), "unprovenanced")
        .when(F.col("live").isNull(), F.when(F.col("sourced"), "gone").otherwise("retired-no-source"))
        .when(F.col("sourced") & F.col("covered"), "rederivable")
        .when(empty, "empty-content")
        .when(F.col("sourced"), "post-watermark")
        .otherwise("no-source")
    )
    return both.select("id", fate.alias("fate"))


def external_reconcile(remote: DataFrame, shadow: DataFrame, records: DataFrame, journal: DataFrame, families: list[str]) -> DataFrame:
    """What to do with each remote entry (external_id, content, category, n): the first of those that repeat an id.

    With a shadow row: unchanged, both_dirty, purged, tombstoned or refresh. Without: blank, tombstoned, filtered, relink or import.
    """
    first = remote.groupBy("external_id").agg(F.min_by(F.struct("content", "category"), "n").alias("e")).select("external_id", "e.*")
    first = first.withColumn("norm", C.content_key(F.col("content"))).withColumn("hash", F.sha2("norm", 256))
    stones = tombstones(journal).select("hash", F.lit(True).alias("stone"))
    local = records.select(F.col("id").alias("record_id"), C.content_digest(F.col("content")).alias("db_now"), F.lit(True).alias("here"))
    keys = records.where("ext_key is not null").select(F.col("ext_key").alias("external_id"), F.lit(True).alias("keyed"))
    rows = first.join(shadow, "external_id", "left").join(local, "record_id", "left").join(stones, "hash", "left").join(keys, "external_id", "left")
    known = F.col("db_digest").isNotNull()
    verdict = (
        F.when(F.col("norm") == "", "blank")
        .when(known & (F.col("content_norm") == F.col("norm")), "unchanged")
        .when(known & F.col("here").isNull(), "purged")
        .when(known & (F.col("db_now") != F.col("db_digest")), "both_dirty")
        .when(F.col("stone"), "tombstoned")
        .when(known, "refresh")
        .when(~F.col("category").isin(*families), "filtered")
        .when(F.col("keyed"), "relink")
        .otherwise("import")
    )
    return rows.select("external_id", verdict.alias("verdict"))


def settle(pending: DataFrame, listing: DataFrame, now: int) -> DataFrame:
    """(record_id, external_id, state) of pushed rows that wait for their remote id: found by content, orphan after the deadline, else pending."""
    first = listing.groupBy(C.content_key(F.col("content")).alias("content_norm")).agg(F.min_by("external_id", "n").alias("external_id"))
    found = pending.join(first, "content_norm", "left")
    state = F.when(F.col("external_id").isNotNull(), "settled").when(F.col("deadline_ms") < now, "orphan").otherwise("pending")
    return found.select("record_id", "external_id", state.alias("state"))


def supersede_chain(records: DataFrame, most: int = 5) -> DataFrame:
    """(id, chain): who replaced a record, and them in turn, `most` generations at most; a cycle or a missing record ends it."""
    step = records.select(F.col("id").alias("at"), F.col("superseded_by").alias("next"))
    known = records.select(F.col("id").alias("next_id"))
    rows = records.where("superseded_by is not null").select("id", F.col("superseded_by").alias("next"), F.array("id").alias("seen"))
    for _ in range(most):
        real = rows.join(known, F.col("next") == F.col("next_id"), "left")
        goes = F.col("next_id").isNotNull() & ~F.array_contains("seen", F.col("next_id"))
        rows = real.select("id", F.when(goes, F.concat("seen", F.array("next_id"))).otherwise(F.col("seen")).alias("seen"), F.when(goes, F.col("next_id")).alias("at_now"))
        rows = rows.join(step, F.col("at_now") == F.col("at"), "left").select("id", "seen", "next")
    return rows.select("id", F.slice("seen", 2, most).alias("chain"))


def resolve_anchors(records: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, anchors): where a record's source messages stand, different places in order."""
    each = records.select("id", F.explode("source_message_ids").alias("message"))
    places = messages.where("turn is not null").select(F.col("id").alias("message"), F.struct("session_id", "turn", "step").alias("place"))
    return each.join(places, "message").groupBy("id").agg(F.array_sort(F.collect_set("place")).alias("anchors"))


def validate_pairs(decisions: DataFrame, known: DataFrame) -> DataFrame:
    """Conflict decisions (record_id, winner, loser) with `valid`: both are known, differ, and one is the judged record."""
    ids = known.select("id").distinct()
    rows = decisions.join(ids.select(F.col("id").alias("w"), F.lit(True).alias("w_known")), F.col("winner") == F.col("w"), "left")
    rows = rows.join(ids.select(F.col("id").alias("l"), F.lit(True).alias("l_known")), F.col("loser") == F.col("l"), "left")
    names = (F.col("winner") == F.col("record_id")) | (F.col("loser") == F.col("record_id"))
    valid = F.coalesce(F.col("w_known") & F.col("l_known") & names & (F.col("winner") != F.col("loser")), F.lit(False))
    return rows.select(*decisions.columns, valid.alias("valid"))


#: Events that are evidence, and what some hosts put before the id of a session.
EVIDENCE_TYPES = ("user/message", "assistant/message", "tool/call", "tool/result")
SESSION_PREFIX = "session-"


def spelled_sessions(asked: DataFrame, there: DataFrame) -> DataFrame:
    """(session_id, found): for sessions asked for, which of those that are there it is: as it is written, else with the prefix, else without."""
    bare = F.regexp_replace(F.trim("session_id"), f"^{SESSION_PREFIX}", "")
    known = there.select(F.col("session_id").alias("found")).distinct().withColumn("bare", F.regexp_replace(F.trim("found"), f"^{SESSION_PREFIX}", ""))
    wanted = asked.select("session_id").where(F.trim("session_id") != "").distinct().withColumn("bare", bare)
    place = F.when(F.col("found") == F.trim("session_id"), 0).when(F.col("found").startswith(SESSION_PREFIX), 1).otherwise(2)
    return wanted.join(known, "bare").groupBy("session_id").agg(F.min_by("found", F.struct(place, "found")).alias("found"))


def fetch_evidence(anchors: DataFrame, events: DataFrame, most_events: int = 200, most_chars: int = 40_000, wanted: DataFrame | None = None) -> DataFrame:
    """(id, events, chars, truncated, failure): what the events (session_id, seq, turn, step, text, type?) at each record's anchors (id, session_id, turn, step?) give, in order, up to both limits.

    Only messages and tools with a text are evidence, if events have a type. An anchor without a step takes its whole turn. Sessions are found in
    either spelling (see `spelled_sessions`). failure says why a record has none: no-anchor (of the wanted ids, if given), session-unreadable if none of its
    sessions is there, anchor-not-found if they have nothing at its anchors.
    """
    said = events.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    said = said.where(F.col("type").isin(*EVIDENCE_TYPES)) if "type" in events.columns else said
    spelled = checkpoint(spelled_sessions(anchors, events))
    named = anchors.withColumnRenamed("step", "want").join(spelled, "session_id", "left")
    met = named.drop("session_id").withColumnRenamed("found", "session_id").join(said.select("session_id", "seq", "turn", "step", "text"), ["session_id", "turn"]).where(F.col("want").isNull() | (F.col("want") == F.col("step")))
    met = met.select("id", "session_id", "seq", F.length("text").alias("chars")).distinct()
    order = W.partitionBy("id").orderBy("session_id", "seq")
    met = met.withColumn("k", F.row_number().over(order)).withColumn("sum", F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, 0)))
    fits = (F.col("k") <= most_events) & (F.col("sum") <= most_chars)
    found = met.groupBy("id").agg(F.count_if(fits).alias("events"), F.coalesce(F.sum(F.when(fits, F.col("chars"))), F.lit(0)).alias("chars"), (F.count(F.lit(1)) > F.count_if(fits)).alias("truncated"))
    zero = F.lit(0).cast("long")
    readable = named.groupBy("id").agg(F.bool_or(F.col("found").isNotNull()).alias("readable"))
    every = readable if wanted is None else wanted.select("id").distinct().join(readable, "id", "left")
    failure = F.when(F.col("events").isNotNull(), F.lit(None)).when(F.col("readable").isNull(), "no-anchor").when(~F.col("readable"), "session-unreadable").otherwise("anchor-not-found")
    return every.join(found, "id", "left").select("id", F.coalesce("events", zero).alias("events"), F.coalesce("chars", zero).alias("chars"), F.coalesce("truncated", F.lit(False)).alias("truncated"), failure.alias("failure"))

