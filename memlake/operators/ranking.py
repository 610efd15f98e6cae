"""Windows, budgets, orders and top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators.shared import checkpoint, containing, small

WING_FLOOR, WING_HIT, WING_NEUTRAL = 0.4, 0.75, 1.0


def recent_per_session(messages: DataFrame, most: int) -> DataFrame:
    """The last messages of each session, with their place from the oldest of them on."""
    back = W.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))
    kept = messages.withColumn("back", F.row_number().over(back)).where(F.col("back") <= most)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("back")))).drop("back")


def latest_runs(receipts: DataFrame, most: int) -> DataFrame:
    """The receipts of the latest runs: a bounded top-k of runs, then a semi-join."""
    runs = receipts.groupBy("run_id").agg(F.max("decided_ms").alias("last")).orderBy(F.desc("last"), F.desc("run_id")).limit(most)
    return receipts.join(small(checkpoint(runs.select("run_id"))), "run_id", "left_semi")


def cut(line: Column, most: Column, suffix: str) -> Column:
    """The line within so many characters, the suffix among them."""
    room = most - len(suffix)
    return F.when(F.length(line) <= most, line).when(room <= 0, F.substring(line, F.lit(1), most)).otherwise(F.concat(F.rtrim(F.substring(line, F.lit(1), room)), F.lit(suffix)))


def recall_budget(lines: DataFrame, per_line: int, total: int, suffix: str, least_tail: int = 40) -> DataFrame:
    """Lines (query_id, rank, line) cut to a length each and filled up to a total, a separator counting 1.

    All lines before the first that doesn't fit stay as they are; that one stays cut if at least `least_tail` characters
    are left for it, and nothing after it does.
    """

    rows = lines.withColumn("line", cut(F.col("line"), F.lit(per_line), suffix))
    order = W.partitionBy("query_id").orderBy("rank")
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("room", F.lit(total) - before)
    over = F.length("line") > F.col("room")
    rows = rows.withColumn("over", over).withColumn("overs", F.sum(over.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    fits = (F.col("overs") == 0) | ((F.col("overs") == 1) & F.col("over") & (F.col("room") >= least_tail))
    kept = rows.where(fits)
    return kept.select("query_id", "rank", F.when(F.col("over"), cut(F.col("line"), F.col("room"), suffix)).otherwise(F.col("line")).alias("line"))


def slot_budget(slots: DataFrame, most_bytes: int) -> DataFrame:
    """Open pinned slots by priority up to a number of bytes; the first always fits, the first that doesn't ends it."""
    order = W.partitionBy("owner").orderBy(F.desc("priority"), "id")
    rows = slots.where("pinned and status = 'open'").withColumn("k", F.row_number().over(order))
    rows = rows.withColumn("sum", F.sum(F.octet_length("body")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    over = ((F.col("sum") > most_bytes) & (F.col("k") > 1)).cast("int")
    return rows.withColumn("overs", F.sum(over).over(order.rowsBetween(W.unboundedPreceding, 0))).select("owner", "id", (F.col("overs") == 0).alias("fits"))


def digest_of(content: Column) -> Column:
    """What tells contents apart for `interleave`, in 32 bytes."""
    return F.unhex(C.content_digest(content))


def interleave(hits: DataFrame, most: int) -> DataFrame:
    """Provider hits (query_id, provider, rank, content) in turn by rank; equal contents once, where they come first. The contents aren't returned.

    Contents are told apart by their digest (a column `digest` instead of content, if hits have one), so what is sorted for a query has rows of a few bytes, and no task holds its texts.
    """
    order = [F.col("rank"), F.col("provider")]
    keyed = hits if "digest" in hits.columns else hits.withColumn("digest", digest_of(F.col("content"))).drop("content")
    first = keyed.withColumn("again", F.row_number().over(W.partitionBy("query_id", "digest").orderBy(*order))).where("again = 1").drop("again", "digest")
    dense = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "provider").orderBy("rank")))
    return dense.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most)


def char_chunks(messages: DataFrame, budget: int, overhead: int = 64) -> DataFrame:
    """Each message's chunk in its session: a chunk ends where another message would take it over the budget.

    The sum begins anew with each chunk, so it is a fold in order: sorted partitions pass by as batches, and only the session,
    its sum and its chunk are carried on. Null texts count as empty; texts stay where they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, session, total, chunk = False, None, 0, 0
        for batch in batches:
            chunks = []
            for owner, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or owner != session:
                    begun, session, total, chunk = True, owner, 0, 0
                if total > 0 and total + n > budget:
                    total, chunk = 0, chunk + 1
                total += n
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chunks, pa.int32())], ["session_id", "id", "chunk"])

    lengths = messages.select("session_id", "id", (F.coalesce(F.length("text"), F.lit(0)) + overhead).alias("n"), "ts_ms")
    ordered = lengths.repartition("session_id").sortWithinPartitions("session_id", "ts_ms", "id")
    return ordered.mapInArrow(run, f"session_id {kinds['session_id']}, id {kinds['id']}, chunk int")


def stratified(records: DataFrame, size: int) -> DataFrame:
    """A sample by type: shares in proportion (one at least, the largest remainders first), taken at even distances in id order."""
    counts = records.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    exact = F.col("n") * size / F.col("total")
    shares = counts.join(F.broadcast(total)).withColumn("share", F.least(F.col("n"), F.greatest(F.lit(1), F.floor(exact))).cast("long")).withColumn("rest", exact - F.floor(exact))
    by_rest = W.orderBy(F.desc("rest"), "type")
    shares = shares.withColumn("left", F.lit(size) - F.sum("share").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    quota = (F.col("share") + ((F.row_number().over(by_rest) <= F.col("left")) & (F.col("share") < F.col("n"))).cast("long")).alias("quota")
    quotas = small(checkpoint(shares.select("type", "n", quota)))
    ranked = records.select("id", "type", (F.row_number().over(W.partitionBy("type").orderBy("id")) - 1).alias("at"))
    # row i is taken if it is floor(j * n / quota) for some j
    met = ranked.join(quotas, "type")
    j = F.ceil(F.col("at") * F.col("quota") / F.col("n"))
    return met.where((j < F.col("quota")) & (F.floor(j * F.col("n") / F.col("quota")) == F.col("at"))).select("id", "type")


def turn_brackets(events: DataFrame, watermark: int, most: int = 2) -> DataFrame:
    """The last whole turns of each session above a watermark: (session_id, turn, start_seq, end_seq).

    A turn/end closes the latest start of its turn which nothing has closed; of a turn's brackets the last counts.
    """
    marks = events.where(F.col("type").isin("turn/start", "turn/end") & F.col("turn").isNotNull())
    order = W.partitionBy("session_id", "turn").orderBy("seq")
    marks = marks.withColumn("before", F.lag("type").over(order)).withColumn("start_seq", F.lag("seq").over(order))
    closed = marks.where("type = 'turn/end' and before = 'turn/start'").where(F.col("turn") > watermark)
    last = closed.groupBy("session_id", "turn").agg(F.max(F.struct(F.col("seq").alias("end_seq"), "start_seq")).alias("b"))
    ranked = last.withColumn("k", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))).where(F.col("k") <= most)
    return ranked.select("session_id", "turn", "b.start_seq", "b.end_seq")


def injected_set(log: DataFrame, most: int) -> DataFrame:
    """Of a log (session_id, seq, kind add or compact, id, protected): the newest ids kept, and whether a compaction came since."""
    add = log.where("kind = 'add'").groupBy("session_id", "id").agg(F.max("seq").alias("added"), F.bool_or("protected").alias("protected"))
    cut = log.where("kind = 'compact'").groupBy("session_id").agg(F.max("seq").alias("compacted"))
    k = F.row_number().over(W.partitionBy("session_id", "protected").orderBy(F.desc("added"), "id"))
    kept = add.withColumn("k", k).where(F.col("protected") | (F.col("k") <= most))
    superseded = F.coalesce(F.col("compacted") > F.col("added"), F.lit(False))
    return kept.join(cut, "session_id", "left").select("session_id", "id", "protected", superseded.alias("superseded"))


def visible_state(injected: DataFrame, known: DataFrame, visible: DataFrame) -> DataFrame:
    """Injected ids whose message is known but no longer visible are superseded; those visible are cleared; others stay."""
    rows = injected.join(known.select("id", F.lit(True).alias("known")), "id", "left").join(visible.select("id", F.lit(True).alias("seen")), "id", "left")
    return rows.select("id", F.when(F.col("seen"), "cleared").when(F.col("known"), "superseded").otherwise("unchanged").alias("mark"))


def unique_names(rows: DataFrame, taken: DataFrame, most: int = 40, tries: int = 999) -> DataFrame:
    """(id, name) from stems (id, stem): in the order of ids the first of stem, stem-2, ... stem-999 that is free, within a length.

    A row without a stem, and one for which all of those are taken, is named `mem-` with the end of its id, then with suffixes,
    then with a digest of the id: every row gets a name, and no name is taken or used twice. Names that could collide share their
    first characters without suffixes, so names are given in one pass over partitions sorted by that; a stem can name at most
    `tries` rows, and only so many of its rows are dealt, so a stem that most rows have is no long task.
    """
    root = lambda name: F.regexp_replace(F.substring(name, 1, most - len(str(tries)) - 1), r"(-[0-9]*)+$", "")
    key = rows.schema["id"].dataType.simpleString()

    def name(left: DataFrame, used: DataFrame) -> DataFrame:
        """left with its name; null where all of a stem's are taken."""
        few = left.withColumn("_k", F.row_number().over(W.partitionBy("stem").orderBy("id"))).where(F.col("_k") <= tries)
        marked = few.select(root("stem").alias("root"), F.lit(1).alias("kind"), "id", "stem").union(used.select(root("name"), F.lit(0), F.lit(None).cast(key), "name"))
        ordered = marked.repartition("root").sortWithinPartitions("root", "kind", "id")
        given = ordered.mapInArrow(run, f"id {key}, name string")
        return left.select("id", "stem").join(given, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, turn = None, set(), {}
        for batch in batches:
            ids, names = [], []
            for start, kind, who, stem in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if start != at:
                    at, used, turn = start, set(), {}
                if kind == 0:
                    used.add(stem)
                    continue
                k = turn.get(stem, 1)
                while k <= tries and (given := stem[: most - len(f"-{k}")] + f"-{k}" if k > 1 else stem) in used:
                    k += 1
                turn[stem] = k + 1
                if k <= tries:
                    used.add(given)
                    ids.append(who)
                    names.append(given)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(2).type), pa.array(names, pa.string())], ["id", "name"])

    spare = F.concat(F.lit("mem-"), F.right(F.col("id").cast("string"), F.lit(8)))
    asked = rows.select("id", F.left(F.coalesce(C.null_if_blank(F.col("stem")), spare), F.lit(most)).alias("stem"))
    first = checkpoint(name(asked, taken.select("name")))
    if first.where("name is null").isEmpty():
        return first.select("id", "name")
    done = first.where("name is not null").select("id", "name")
    second = checkpoint(name(first.where("name is null").select("id", spare.alias("stem")), taken.select("name").union(done.select("name"))))
    last = F.coalesce("name", F.concat(F.lit("mem-"), F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(36))))
    return done.union(second.select("id", last))


def budget_plan(records: DataFrame, most_records: int, most_calls: int) -> DataFrame:
    """Which records are verified: those done or without anchors cost nothing; of the others the first by order, up to both caps."""
    open_ = records.where("anchors > 0 and not done")
    fate = open_.orderBy("order", "id").limit(most_records)
    calls = F.sum("calls").over(W.orderBy("order", "id").rowsBetween(W.unboundedPreceding, 0))
    planned = fate.withColumn("sum", calls).where(F.col("sum") <= most_calls).select("id", F.lit(True).alias("planned"))
    rows = records.join(planned, "id", "left")
    return rows.select("id", F.when(F.col("done"), "done").when(F.col("anchors") == 0, "free").when(F.col("planned"), "planned").otherwise("deferred").alias("fate"))


# What a verification may cost, and characters a token.
MOST_RECORDS, MOST_ANCHORS, EVIDENCE_CHARS, MOST_CALLS, CHARS_A_TOKEN = 50, 8, 12_000, 50, 4


def verification_plan(records: DataFrame, most_records: int = MOST_RECORDS, most_anchors: int = MOST_ANCHORS, evidence_chars: int = EVIDENCE_CHARS, most_calls: int = MOST_CALLS) -> tuple[DataFrame, DataFrame]:
    """(plan, estimate) for records (id, order, chars, anchors, done): plan (id, fate, anchors), estimate one row.

    Records with anchors that are done are left out. Of the others the first `most_records` by order, then id, are in the plan, the rest is over-records; of these, those without
    anchors are free, and each other one is a call: the first `most_calls` are planned, the rest is over-calls. At most `most_anchors` anchors of a record count. The estimate has
    the texts of what stays and `evidence_chars` for each call, as characters and as tokens. Only the first `most_records` are ordered globally.
    """
    rows = records.withColumns({"anchors": F.least(F.coalesce("anchors", F.lit(0)), F.lit(most_anchors)).cast("long"), "chars": F.coalesce("chars", F.lit(0)).cast("long")})
    skipped = (F.col("anchors") > 0) & F.coalesce("done", F.lit(False))
    order = W.orderBy("order", "id")
    calls = F.sum((F.col("anchors") > 0).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    first = rows.where(~skipped).orderBy("order", "id").limit(most_records).withColumn("call", calls)
    inside = checkpoint(first.select("id", F.when(F.col("anchors") == 0, "free").when(F.col("call") <= most_calls, "planned").otherwise("over-calls").alias("in_plan")))
    plan = rows.join(small(inside), "id", "left").withColumn("fate", F.coalesce("in_plan", F.when(skipped, "done").otherwise("over-records")))
    kept = F.col("fate").isin("planned", "free")
    sums = plan.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("fate") == "planned").alias("calls"), F.count_if(F.col("anchors") == 0).alias("without_anchor"), F.count_if(F.col("fate") == "done").alias("done"), F.count_if(F.col("fate") == "over-records").alias("over_records"),
        F.count_if(F.col("fate") == "over-calls").alias("over_calls"), F.coalesce(F.sum(F.when(kept, F.col("anchors"))), F.lit(0)).alias("anchors"),
        F.coalesce(F.sum(F.when(kept, F.col("chars") + F.when(F.col("anchors") > 0, evidence_chars).otherwise(0))), F.lit(0)).alias("chars"),
    )
    return plan.select("id", "fate", "anchors"), sums.withColumn("tokens", F.ceil(F.col("chars") / CHARS_A_TOKEN))


def fold_coordinates(events: DataFrame) -> DataFrame:
    """Every event with the turn that is open (carried on from turn/start) and its step there; events before any turn go."""
    order = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    starts = F.count(F.when(F.col("type") == "turn/start", True)).over(order)
    rows = events.withColumn("open", F.last(F.when(F.col("type") == "turn/start", F.col("turn")), True).over(order)).withColumn("segment", starts)
    inside = W.partitionBy("session_id", "segment").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    step = F.count(F.when(F.col("type") == "assistant/message", True)).over(inside)
    return rows.withColumn("step", step).withColumn("turn", F.coalesce("turn", "open")).where("segment > 0").drop("open", "segment")


def pending_slices(messages: DataFrame) -> DataFrame:
    """Messages not distilled yet with their place, and their session's by its first message."""
    rows = messages.where("turn is null").withColumn("first_ms", F.min("ts_ms").over(W.partitionBy("session_id")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("ts_ms", "id"))).select("session_id", "first_ms", "id", "place")


def reordered(hits: DataFrame, *keys: Column, group: str = "query_id") -> DataFrame:
    """Hits in a new order within their query; ties keep the old one. Scores stay."""
    return hits.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*keys, F.col("rank"))))


def keyword_weights(queries: DataFrame, keywords: DataFrame, few: int = 5000) -> DataFrame:
    """(query_id, wing, weight): a wing with a keyword in the query weighs more; all alike if none has. Blank keywords count for nothing.

    Up to `few` keywords are one array; more meet the queries' runs of characters in a join.
    """
    texts = queries.select(F.col("query_id").alias("id"), F.lower("query").alias("hay"))
    lowered = checkpoint(keywords.select("wing", F.lower("keyword").alias("word")).where("word is not null").distinct())
    wings = F.broadcast(lowered.groupBy("wing").agg(F.collect_list("word").alias("words")))
    if lowered.count() <= few:
        said = texts.join(wings).select(F.col("id").alias("query_id"), "wing", F.coalesce(F.exists("words", lambda w: (w != "") & F.contains("hay", w)), F.lit(False)).alias("hit"))
    else:
        found = containing(texts, lowered).join(lowered, "word").select("id", "wing").distinct().withColumn("hit", F.lit(True))
        every = texts.select("id").join(F.broadcast(lowered.select("wing").distinct()))
        said = every.join(found, ["id", "wing"], "left").select(F.col("id").alias("query_id"), "wing", F.coalesce("hit", F.lit(False)).alias("hit"))
    some = F.max("hit").over(W.partitionBy("query_id"))
    return said.select("query_id", "wing", F.when(~some, WING_NEUTRAL).when(F.col("hit"), WING_HIT).otherwise(WING_FLOOR).alias("weight"))


def vector_weight(similarity: Column) -> Column:
    return WING_FLOOR + (1 - WING_FLOOR) * C.clamp(F.coalesce(similarity, F.lit(0.0)))


def overlap(query: Column, phrases: Column) -> Column:
    """Most tokens (two or more letters or digits) that a phrase shares with the query."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[0-9a-z一-龥]{2,}"), F.lit(0)))
    return F.coalesce(F.array_max(F.transform(phrases, lambda p: F.size(F.array_intersect(words(query), words(p))))), F.lit(0))


def conflict_queue(pairs: DataFrame, before_ms: int, most: int, tries: int = 3) -> DataFrame:
    waiting = F.coalesce("deferred_ms", "created_ms")
    return pairs.where("resolution is null").where((waiting < before_ms) & (F.col("defer_count") < tries)).withColumn("since", waiting).orderBy("since", "pair_id").limit(most)
