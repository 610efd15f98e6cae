"""Counts, cost windows and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import names as N
from memlake.operators.shared import checkpoint, components

DAY = 86_400_000
#: Range name and how far it looks back; 0 is everything.
RANGES = {"day": DAY, "week": 7 * DAY, "month": 30 * DAY, "all": 0}
BUCKETS = {"day": (DAY, 30), "week": (7 * DAY, 12), "month": (30 * DAY, 12)}


def layer_fold(layer: Column) -> Column:
    return F.when(layer.isin("l1-extract", "l1-dedup"), "l1").otherwise(layer)


def _costs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_chars").alias("input_chars"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"),
    ]


def _averages() -> list[Column]:
    return [F.avg("output_tokens").alias("avg_output"), F.percentile("output_tokens", F.lit(0.5)).alias("median_output")]


def in_ranges(ledger: DataFrame, now: int) -> DataFrame:
    """Each entry once for each range that holds it: an array of at most four names, exploded in the one scan."""
    held = F.filter(F.array(*(F.when(F.lit(ms == 0) | (F.col("ts_ms") >= now - ms), F.lit(name)) for name, ms in RANGES.items())), lambda x: x.isNotNull())
    return ledger.withColumn("range", F.explode(held))


def cost_windows(ledger: DataFrame, now: int) -> DataFrame:
    return in_ranges(ledger, now).groupBy("range").agg(*_costs(), *_averages())


def cost_by_model(ledger: DataFrame, now: int) -> DataFrame:
    return in_ranges(ledger, now).groupBy("range", "provider", "model").agg(*_costs())


def cost_by_layer(ledger: DataFrame, since: int) -> DataFrame:
    return ledger.where(F.col("ts_ms") >= since).groupBy(layer_fold(F.col("layer")).alias("layer")).agg(*_costs(), *_averages())


def cost_buckets(ledger: DataFrame, bucket_ms: int, offset_ms: int = 0, layer: str | None = None) -> DataFrame:
    if layer:
        ledger = ledger.where(layer_fold(F.col("layer")) == layer)
    bucket = F.floor((F.col("ts_ms") + offset_ms) / bucket_ms).alias("bucket")
    return ledger.groupBy(bucket, "provider", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"))


def cost_trend(ledger: DataFrame, now: int, granularity: str, layer: str) -> DataFrame:
    """The last buckets without gaps: (bucket, calls, output_tokens)."""
    width, count = BUCKETS[granularity]
    last = now // width
    calendar = ledger.sparkSession.range(last - count + 1, last + 1).select(F.col("id").alias("bucket"))
    sums = cost_buckets(ledger, width, 0, layer).groupBy("bucket").agg(F.sum("calls").alias("calls"), F.sum("output_tokens").alias("output_tokens"))
    zero = F.lit(0).cast("long")
    return calendar.join(sums, "bucket", "left").select("bucket", F.coalesce("calls", zero).alias("calls"), F.coalesce("output_tokens", zero).alias("output_tokens"))


def model_metrics(ledger: DataFrame) -> DataFrame:
    """Means and medians of a model's buckets with calls, for each granularity."""
    widths = F.array(*(F.struct(F.lit(name).alias("granularity"), F.lit(width).alias("width")) for name, (width, _) in BUCKETS.items()))
    rows = ledger.withColumn("g", F.explode(widths)).withColumn("bucket", F.floor(F.col("ts_ms") / F.col("g.width")))
    buckets = rows.groupBy("provider", "model", F.col("g.granularity").alias("granularity"), "bucket").agg(F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("output"))
    return buckets.groupBy(F.concat_ws("/", "provider", "model").alias("model"), "granularity").agg(F.avg("calls").alias("avg_calls"), F.avg("output").alias("avg_output"), F.percentile("output", F.lit(0.5)).alias("median_output"))


def recall_usage(attempts: DataFrame) -> DataFrame:
    """Of an attempt log (ts_ms, candidate_ids, used_ids): attempts, uses and last times of each record."""
    every = attempts.select("ts_ms", "used_ids", F.explode(F.array_union("candidate_ids", "used_ids")).alias("id"))
    used = F.array_contains("used_ids", F.col("id"))
    return every.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(used).alias("used"), F.max("ts_ms").alias("last_attempt_ms"), F.max(F.when(used, F.col("ts_ms"))).alias("last_used_ms"))


def feedback_fold(feedback: DataFrame, history: int = 12) -> DataFrame:
    """Of scores (id, score -1..5, at_ms, n): the last one, count and mean of those from 0, obsolete marks, latest history."""
    ranked = feedback.withColumn("back", F.row_number().over(W.partitionBy("id").orderBy(F.desc("at_ms"), F.desc("n"))))
    rated = F.col("score") >= 0
    recent = F.sort_array(F.collect_list(F.when(F.col("back") <= history, F.struct((-F.col("back")).alias("o"), "score"))))
    return ranked.groupBy("id").agg(
        F.max(F.when(F.col("back") == 1, F.col("score"))).alias("last_score"),
        F.count_if(rated).alias("rated"),
        F.round(F.avg(F.when(rated, F.col("score"))), 2).alias("mean"),
        F.count_if(F.col("score") == -1).alias("obsolete"),
        F.transform(recent, lambda x: x["score"]).alias("history"),
    )


def rekey(counters: DataFrame, moves: DataFrame) -> DataFrame:
    """Counters (id, attempts, used) under the ids that a map (old, new) leads to in the end, summed up.

    An old id leads to one new id (of several the least), so what hangs together has one id that leads nowhere: all go
    there, however long the chain. Where ids lead round in a circle, the least of them stays.
    """
    step = checkpoint(moves.where("old is not null and new is not null").groupBy("old").agg(F.min("new").alias("new")))
    roots = checkpoint(components(step.select(F.col("old").alias("a"), F.col("new").alias("b"))))
    last = roots.join(step.select(F.col("old").alias("node")), "node", "left_anti").groupBy("root").agg(F.min("node").alias("last"))
    target = roots.join(last, "root", "left").select(F.col("node").alias("id"), F.coalesce("last", "root").alias("target"))
    moved = counters.join(target, "id", "left").withColumn("id", F.coalesce("target", "id"))
    return moved.groupBy("id").agg(F.sum("attempts").alias("attempts"), F.sum("used").alias("used"))


def session_watermark(messages: DataFrame) -> DataFrame:
    """The last turn of each session, and of that turn the step that came first with it."""
    return messages.where("turn is not null").groupBy("session_id").agg(F.max(F.struct(F.col("turn"), (-F.col("ts_ms")).alias("t"), F.col("step"))).alias("m")).select("session_id", "m.turn", "m.step")


def claim_classes(claims: DataFrame) -> DataFrame:
    """Claims (entity, attribute, scope, value, time_ms) by subject: agreement, conditional, supersession or hard.

    All four are compared by their keys (see `claim_key`), so `5 GB` and `5gb` agree; claims without an entity are left out.
    """
    keyed = claims.select(*(N.claim_key(F.col(c)).alias(c) for c in ("entity", "attribute", "scope", "value")), "time_ms").where("entity <> ''")
    groups = keyed.groupBy("entity", "attribute").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"), F.countDistinct("scope").alias("scopes"), F.count("time_ms").alias("timed"), F.countDistinct("time_ms").alias("times")
    )
    verdict = F.when(F.col("values") <= 1, "agreement").when(F.col("scopes") > 1, "conditional").when((F.col("timed") == F.col("n")) & (F.col("times") == F.col("n")), "supersession").otherwise("hard")
    return groups.select("entity", "attribute", "n", "values", verdict.alias("verdict"))


def spellings(names: DataFrame) -> DataFrame:
    """Normalised names that are written in several ways: (key, spellings)."""
    return names.groupBy(N.claim_key(F.col("name")).alias("key")).agg(F.countDistinct("name").alias("spellings")).where("spellings > 1 and key <> ''")


def affix_pairs(names: DataFrame, least: int = 4) -> DataFrame:
    """(short, long): a name that another one begins or ends with, of `least` characters at least, and of half its length.

    Every name's affixes of that length meet the names in an equi-join, so no pairs are tried.
    """
    keys = names.select(N.claim_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    n = F.length("key")
    low = F.greatest(F.lit(least), F.ceil(n / 2).cast("int"))
    lengths = F.when(low <= n - 1, F.sequence(low, n - 1)).otherwise(F.array().cast("array<int>"))
    affixes = F.array_union(F.transform(lengths, lambda k: F.substring("key", F.lit(1), k)), F.transform(lengths, lambda k: F.substring(F.col("key"), F.length("key") - k + 1, k)))
    long = keys.select(F.col("key").alias("long"), F.explode(affixes).alias("short"))
    return long.join(keys.select(F.col("key").alias("short")), "short").select("short", "long")


def occupancy(turns: DataFrame) -> DataFrame:
    """Tokens of injected messages since a session's last compaction: (session_id, recall_tokens); 4 characters a token, 8 a message."""
    last = W.partitionBy("session_id")
    since = turns.withColumn("reset", F.max(F.when(F.col("kind") == "compaction", F.col("seq"))).over(last))
    live = (F.col("kind") == "inject") & (F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
    return since.groupBy("session_id").agg(F.coalesce(F.sum(F.when(live, F.ceil(F.col("chars") / 4) + 8)), F.lit(0)).alias("recall_tokens"))


def route_health(calls: DataFrame, now: int, stale_ms: int) -> DataFrame:
    """Least chunk that worked and the latency average (0.7 old, 0.3 new) of each route, in closed form over its calls by time."""
    by_time = W.partitionBy("provider", "model").orderBy("ts_ms", "n")
    k = F.row_number().over(by_time)
    total = F.count(F.lit(1)).over(W.partitionBy("provider", "model"))
    ranked = calls.withColumn("k", k).withColumn("total", total)
    weight = F.when(F.col("k") == 1, 1.0).otherwise(0.3) * F.pow(F.lit(0.7), F.col("total") - F.col("k"))
    return ranked.groupBy("provider", "model").agg(F.min("chunk_chars").alias("good_chunk"), F.sum(F.col("latency_ms") * weight).alias("latency_ema"), (F.lit(now) - F.max("ts_ms") > stale_ms).alias("stale"))
