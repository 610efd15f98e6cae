"""Retrieval quality and benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.retrieval import bm25, threshold
from memlake.operators.shared import checkpoint, small


def gold_match(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Hits (query_id, rank, content) against each gold string of their query: (query_id, kind, rank, gold, match)."""
    return hits.join(gold, "query_id").select("query_id", "kind", "rank", "gold", F.contains("content", "gold").alias("match"))


def recall_and_mrr(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(kind, probes, recall, mrr) for each kind of probe and for all; a probe without hits counts as missed."""
    best = gold_match(hits, gold).where("match").groupBy("query_id").agg(F.min("rank").alias("best"))
    told = gold.select("query_id", "kind").distinct().join(best, "query_id", "left")
    rates = told.rollup("kind").agg(
        F.count(F.lit(1)).alias("probes"),
        F.round(F.avg(F.col("best").isNotNull().cast("int")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
    )
    return rates.withColumn("kind", F.coalesce("kind", F.lit("all")))


def keyword_hits(probes: DataFrame, records: DataFrame, k: int = 5, pool: int = 3, least: float = 0.3) -> DataFrame:
    """(query_id, id, rank): what a search by words shows for probes (query_id, query): of the best k * pool records, those that score `least` or more, or all if they are at most k and none does; the first k."""
    found = bm25(probes, records, k * pool).withColumn("score", F.col("score") / (1 + F.col("score")))
    return threshold(found, least, k).where(F.col("rank") <= k).select("query_id", "id", "rank")


def recall_table(probes: DataFrame, records: DataFrame, k: int = 5, pool: int = 3, least: float = 0.3) -> DataFrame:
    """(type, probes, hits, recall, coverage, mrr) by type of probe, and for all: how a search by words finds what probes (probe_id, type, q, gold) ask for.

    A gold string is found if one of the `k` records that `keyword_hits` shows has it. recall is the share of probes with one that is found, coverage the mean share of a
    probe's strings that are, mrr the mean of 1 / the rank of the first record that has one. Probes without gold (those that ask for nothing) don't count.
    """
    asked = probes.where(F.size("gold") > 0)
    hits = checkpoint(keyword_hits(asked.select(F.col("probe_id").alias("query_id"), F.col("q").alias("query")), records, k, pool, least))
    shown = hits.join(records.select("id", "content"), "id").withColumnRenamed("query_id", "probe_id")
    each = asked.select("probe_id", F.posexplode("gold").alias("g", "want")).join(shown, "probe_id").where(F.contains("content", "want"))
    found = each.groupBy("probe_id").agg(F.countDistinct("g").alias("found"), F.min("rank").alias("first"))
    told = asked.select("probe_id", "type", F.size("gold").alias("n")).join(found, "probe_id", "left")
    rates = told.rollup("type").agg(
        F.grouping("type").alias("all"), F.count(F.lit(1)).alias("probes"), F.count("found").alias("hits"), F.round(F.count("found") / F.count(F.lit(1)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0))), 6).alias("coverage"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
    return rates.where("probes > 0").select(F.when(F.col("all") == 1, "all").otherwise(F.coalesce("type", F.lit("none"))).alias("type"), "probes", "hits", "recall", "coverage", "mrr")


def check_table(checks: DataFrame) -> DataFrame:
    """(arm, name, passed, checks) of workflow checks (arm, name, ok) by arm and name."""
    return checks.groupBy("arm", "name").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("checks"))


def injection_precision(lines: DataFrame, gold: DataFrame) -> DataFrame:
    """Of injected lines (query_id, line): lines, share with a gold string, mean share over probes, probes with a stale string."""
    met = lines.join(gold.select("query_id", "gold", "stale"), "query_id")
    flagged = met.groupBy("query_id", "line").agg(F.bool_or(F.contains("line", "gold")).alias("good"), F.bool_or(F.coalesce(F.contains("line", "stale"), F.lit(False))).alias("stale"))
    each = flagged.groupBy("query_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("good").alias("good"), F.bool_or("stale").alias("stale"))
    return each.agg(
        F.sum("lines").alias("lines"),
        F.round(F.sum("good") / F.sum("lines"), 6).alias("by_line"),
        F.round(F.avg(F.col("good") / F.col("lines")), 6).alias("by_probe"),
        F.count_if("stale").alias("stale_probes"),
    )


def accuracy(results: DataFrame) -> DataFrame:
    """Hits and probes by arm and kind, with the rate."""
    return results.groupBy("arm", "kind").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("probes"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


def compare_runs(a: DataFrame, b: DataFrame, band: float = 0.05) -> DataFrame:
    """Rates by kind of two runs, and whether they differ by more than a noise band."""
    left = a.groupBy("kind").agg(F.avg(F.col("hit").cast("int")).alias("before"))
    right = b.groupBy("kind").agg(F.avg(F.col("hit").cast("int")).alias("after"))
    delta = F.round(F.col("after") - F.col("before"), 6)
    verdict = F.when(F.col("before").isNull() | F.col("after").isNull(), "missing").when(F.abs(delta) <= band, "noise").when(delta > 0, "better").otherwise("worse")
    return left.join(right, "kind", "full").select("kind", delta.alias("delta"), verdict.alias("verdict"))


def compare_report(old: DataFrame, new: DataFrame, old_env: str | None, new_env: str | None, band: float = 0.05, least: float = 0.01) -> DataFrame:
    """(type, old_hits, old_probes, new_hits, new_probes, delta, verdict): probes (type, hit) of two runs by type, and the verdict in the row `all`.

    environment if the runs' environments differ (see `env_key`): nothing follows then. better if the rate of all rose by more than `band` and that of no type fell
    by more than `least`; worse if it fell by more than `band`; else noise. A type that one run lacks counts as rate 0 there.
    """
    counted = lambda df, side: df.groupBy(F.coalesce("type", F.lit("none")).alias("type")).agg(F.count_if(F.coalesce("hit", F.lit(False))).alias(f"{side}_hits"), F.count(F.lit(1)).alias(f"{side}_probes"))
    both = checkpoint(counted(old, "old").join(counted(new, "new"), "type", "full").na.fill(0))
    columns = ("old_hits", "old_probes", "new_hits", "new_probes")
    rate = lambda side: F.col(f"{side}_hits") / F.greatest(F.col(f"{side}_probes"), F.lit(1))
    fell = F.bool_or(rate("new") < rate("old") - least).alias("fell")
    total = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns), fell)
    delta = F.round(rate("new") - rate("old"), 6)
    verdict = F.when(F.lit(old_env != new_env), "environment").when((delta > band) & ~F.coalesce("fell", F.lit(False)), "better").when(delta < -band, "worse").otherwise("noise")
    each = both.select("type", *columns, delta.alias("delta"), F.lit(None).cast("string").alias("verdict"))
    return each.union(total.select(F.lit("all"), *columns, delta, verdict))


def abstention(results: DataFrame) -> DataFrame:
    """Failures of probes that ask for nothing, and hits among updates, by arm."""
    return results.groupBy("arm").agg(F.count_if((F.col("kind") == "abstention") & ~F.col("hit")).alias("abstention_failures"), F.count_if((F.col("kind") == "update") & F.col("hit")).alias("update_hits"), F.count_if(F.col("kind") == "update").alias("updates"))


def efficiency(runs: DataFrame) -> DataFrame:
    """Means of turns, steps and tokens of scenario runs by arm, and the cache rate weighted by input."""
    return runs.groupBy("arm").agg(
        F.count(F.lit(1)).alias("runs"),
        *(F.round(F.avg(c), 6).alias(c) for c in ("turns", "steps", "input_tokens", "output_tokens")),
        F.round(F.sum("cached_tokens") / F.sum("input_tokens"), 6).alias("cache_rate"),
    )


def latency_split(turns: DataFrame) -> DataFrame:
    """Mean first response of turns with and without injection, and the mean share of injected characters."""
    with_it = F.col("injected_chars") > 0
    return turns.agg(
        F.round(F.avg(F.when(with_it, F.col("first_ms"))), 6).alias("injected_ms"),
        F.round(F.avg(F.when(~with_it, F.col("first_ms"))), 6).alias("plain_ms"),
        F.round(F.avg(F.when(with_it, F.col("injected_chars") / 4 / F.col("input_tokens"))), 6).alias("share"),
        F.count_if(with_it).alias("injected"),
    )


def usage_by_layer(runs: DataFrame) -> DataFrame:
    """Of a map layer -> (calls, failures, tokens) on each run, the sums by layer."""
    each = runs.select(F.explode("layers").alias("layer", "u"))
    return each.groupBy("layer").agg(*(F.sum(f"u.{c}").alias(c) for c in ("calls", "failures", "tokens")))


def injected_recall(probes: DataFrame) -> DataFrame:
    """Probes (kind, injected, tokens, by_tool, hit): gold whose tokens all stand in what was injected, and those a tool rescued."""
    found = F.forall("tokens", lambda t: F.contains("injected", t))
    rows = probes.withColumn("found", F.coalesce(found, F.lit(False)))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("probes"), F.count_if("found").alias("found"), F.count_if(~F.col("found") & F.col("by_tool") & F.col("hit")).alias("rescued"))


def by_position(results: DataFrame, buckets: int = 3) -> DataFrame:
    """Accuracy by the third of the scenario order that a scenario falls in; scenarios are a bounded list."""
    from pyspark.sql import Window as W

    order = results.groupBy("scenario").agg(F.min("ord").alias("ord"))
    total = order.agg(F.count(F.lit(1)).alias("total"))
    placed = order.join(F.broadcast(total)).withColumn("bucket", F.ceil(F.row_number().over(W.orderBy("ord", "scenario")) * buckets / F.col("total")))
    return results.join(small(checkpoint(placed.select("scenario", "bucket"))), "scenario").groupBy("bucket").agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"), F.sum("contamination").alias("contamination"))


def token_summary(lines: DataFrame) -> DataFrame:
    """Sums by phase and arm of log lines `phase=.. arm=.. in=.. cached=.. out=.. steps=..`; other lines are skipped."""
    part = lambda name, what=r"\d+": F.regexp_extract("line", rf"\b{name}=({what})", 1)
    rows = lines.where(F.col("line").rlike(r"\bphase=\w+ arm=\w+ in=\d+")).select(part("phase", r"\w+").alias("phase"), part("arm", r"\w+").alias("arm"), *(part(n).cast("long").alias(n) for n in ("in", "cached", "out", "steps")))
    sums = rows.groupBy("phase", "arm").agg(*(F.sum(n).alias(n) for n in ("in", "cached", "out", "steps")))
    return sums.withColumn("cache_rate", F.round(F.col("cached") / F.col("in"), 6))


def step_cache(steps: DataFrame) -> DataFrame:
    """Of each step (session_id, seq, input_tokens, cached_tokens, context_chars): what wasn't cached, the miss rate, and the text that was added."""
    from pyspark.sql import Window as W

    added = F.col("context_chars") - F.lag("context_chars", 1, 0).over(W.partitionBy("session_id").orderBy("seq"))
    miss = F.col("input_tokens") - F.col("cached_tokens")
    return steps.select("session_id", "seq", miss.alias("uncached"), F.round(miss / F.col("input_tokens"), 6).alias("miss_rate"), added.alias("added_chars"))


def write_amplification(jobs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """External calls for each record that changed, of jobs (id) between two states (id, digest): none where nothing changed."""
    changed = after.join(before.withColumnRenamed("digest", "was"), "id", "left").where(F.col("was").isNull() | (F.col("was") != F.col("digest"))).select("id")
    calls = jobs.join(changed, "id", "left_semi").agg(F.count(F.lit(1)).alias("calls"))
    return calls.join(F.broadcast(changed.agg(F.count(F.lit(1)).alias("changed")))).select("calls", "changed", F.round(F.coalesce(F.try_divide("calls", "changed"), F.lit(0.0)), 6).alias("ratio"))


def lifecycle(rows: DataFrame) -> DataFrame:
    """Of checks (suite, expected, seen): positives, leaks and the rate of those that came out as expected."""
    return rows.groupBy("suite").agg(F.count_if(F.col("expected") & F.col("seen")).alias("positives"), F.count_if(~F.col("expected") & F.col("seen")).alias("leaks"), F.round(F.avg((F.col("expected") == F.col("seen")).cast("int")), 6).alias("rate"))
