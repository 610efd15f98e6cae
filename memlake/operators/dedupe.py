"""Deduplication, import planning and conflict decisions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memlake.functions import columns as C
from memlake.operators.merges import merge_axes
from memlake.operators.shared import Sets, best_matches, best_of, checkpoint, meeting, query_blocks, sorted_items

DUPLICATE, RELATED = 0.62, 0.30


@functools.cache
def unsettled() -> str:
    """A pattern of all characters that NFKC may change (those that it maps, marks that combine, later parts of what it composes) and some others.

    It says which don't: the longer runs of settled characters, few enough for a pattern class, with letters, punctuation and ideographs of most texts in them.
    """
    later = {c for k in range(0x80, 0x110000) for c in unicodedata.normalize("NFKD", chr(k))[1:]}
    settled = [k < 0x80 or not (0xD800 <= k < 0xE000 or unicodedata.combining(chr(k)) or chr(k) in later or unicodedata.normalize("NFKC", chr(k)) != chr(k)) for k in range(0x10000)]
    ends = [k for k in range(1, len(settled)) if settled[k] != settled[k - 1]]
    runs = [(a, b - 1) for a, b in zip([0, *ends], [*ends, len(settled)], strict=True) if settled[a] and (b - a > 100 or (b - a > 6 and (a < 0x500 or 0x2000 <= a < 0x2070)))]
    return r"[\x{A0}-\x{10FFFF}&&[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]]"  # ASCII fails at the first range


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    def each() -> Iterator[str | None]:
        for text in texts:  # one at a time: a batch's texts as Python's would take several times its memory
            yield unicodedata.normalize("NFKC", text.as_py()) if text.is_valid else None

    return pa.array(each(), pa.string())


def dedupe_key(rows: DataFrame, text: str = "content", key: str = "key") -> DataFrame:
    """Rows with a compatibility-normalised (NFKC), folded text. Only texts with characters that this form may change go to Python, and nothing else of their rows."""
    given = F.col(text)
    wide, odd = given.rlike(r"[^\x00-\x7F]"), given.rlike(unsettled())
    normal = F.when(odd, _nfkc(F.when(odd, given))).otherwise(given)
    folded = F.trim(F.regexp_replace(F.regexp_replace(normal, r"[\x{200B}-\x{200F}\x{FEFF}]", ""), r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))
    return rows.withColumn(key, F.when(wide, folded).otherwise(C.squeezed(given)))


def exact_dedupe(items: DataFrame) -> DataFrame:
    """Items (id, seq, content, priority, timestamps) with the id that stands for them, and what it takes over.

    Equal keys are one item, blank ones never. The longest content stands for the group, then the highest priority, then the first.
    """
    keyed = dedupe_key(items).withColumn("key", F.when(F.coalesce("key", F.lit("")) == "", F.concat(F.lit("\u0000"), "id")).otherwise(F.col("key")))
    best = F.max(F.struct(F.length("content"), F.coalesce("priority", F.lit(0)), (-F.col("seq")).alias("s"), F.col("id").alias("id")))
    groups = keyed.groupBy(F.sha2("key", 256).alias("digest")).agg(best.alias("best"), F.max("priority").alias("max_priority"), F.count(F.lit(1)).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("timestamps")))).alias("all_timestamps"))
    return keyed.withColumn("digest", F.sha2("key", 256)).join(groups, "digest").select("id", F.col("best.id").alias("representative"), "members", "max_priority", "all_timestamps")


def before_store(items: DataFrame, vectors: DataFrame, tau: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """(absorbed, stages) of items (run_id, id, seq, content, priority, timestamps) that are to be stored: receipts and counts.

    Equal texts are one item (see `exact_dedupe`); of these, items whose vectors (id, seq, batch, family, type, embedding) are near enough follow their leader (see
    `leader_clusters`); one without a vector stands for itself. absorbed (run_id, record_id, action, candidate_ids, stage, input_digest) is a merge receipt for each item that another
    one has taken in, with that one as candidate; the digest is over both, so that a receipt tells which. stages (stage, n) are the items before, after equal texts, and after vectors.
    """
    exact = checkpoint(exact_dedupe(items))
    own = exact.where("id = representative").select("id")
    near = checkpoint(leader_clusters(vectors.join(own, "id", "left_semi"), tau))
    pairs = exact.where("id <> representative").select("id", F.col("representative").alias("into"), F.lit("exact").alias("stage"))
    pairs = pairs.union(near.where("id <> leader").select("id", F.col("leader").alias("into"), F.lit("vector").alias("stage")))
    told = pairs.join(items.select("id", "run_id"), "id")
    digest = C.input_digest(F.array(F.col("id").cast("string"), F.col("into").cast("string")), "absorbed/v1")
    absorbed = told.select("run_id", F.col("id").alias("record_id"), F.lit("merge").alias("action"), F.array("into").alias("candidate_ids"), "stage", digest.alias("input_digest"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    left = own.join(near.where("id <> leader"), "id", "left_anti")
    return absorbed, count(exact, "input").union(count(own, "after_exact")).union(count(left, "after_vector"))


def leader_clusters(items: DataFrame, tau: float = 0.92) -> DataFrame:
    """(id, leader) within a batch's (batch, family, type): the most similar earlier leader at tau or above, else itself; of equally similar ones the first.

    A batch is what one distillation returned. Sorted partitions pass by as batches, and only the leaders of the group at hand are kept.
    Vectors that are null, zero or not finite lead nobody and follow nobody.
    """
    least = min(0.99, max(0.85, tau))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    group = ["batch", "family", "type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, names, leaders = False, None, {}, {}
        for batch in batches:
            found = []
            for *own, record, vector in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not begun or own != at:
                    begun, at, names, leaders = True, own, {}, {}
                x = np.array([np.nan if v is None else v for v in vector or ()], dtype=np.float64)
                size = np.sqrt(x @ x) if len(x) else 0.0
                best = record
                if size > 0 and np.isfinite(size):
                    x = x / size
                    held, n = leaders.get(len(x), np.zeros((16, len(x)))), len(names.setdefault(len(x), []))
                    near = held[:n] @ x if n else np.zeros(0)
                    if n and near.max() >= least:
                        best = names[len(x)][int(np.argmax(near))]
                    else:
                        held = held if n < len(held) else np.concatenate([held, np.zeros_like(held)])
                        held[n] = x
                        leaders[len(x)] = held
                        names[len(x)].append(record)
                found.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(found, batch.schema.field(3).type)], ["id", "leader"])

    ordered = items.select(*group, "id", "embedding", "seq").repartition(*group).sortWithinPartitions(*group, "seq")
    return ordered.drop("seq").mapInArrow(run, f"id {kinds['id']}, leader {kinds['id']}")


def _runs(codes: np.ndarray, n: int) -> np.ndarray:
    """Different runs of n characters, each as one number of 21 bits a character; a text of at most n characters is one run."""
    if len(codes) <= n:
        codes = np.concatenate([codes, np.full(n - len(codes), 0x1FFFFF, dtype=np.uint64)])  # no character
    total = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = (total << np.uint64(21)) | codes[k : k + len(total)]
    return np.unique(total)


def _gram_sets(rows: DataFrame, order: str | None) -> DataFrame:
    """(id, items, weights, scale): the 3-grams (even numbers) and 2-grams (odd ones) of a content, how many of each, and its place."""

    def grams(part: pa.RecordBatch) -> pa.RecordBatch:
        items, sizes = [], []
        for text in part.column(1).to_pylist():
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
            three, two = _runs(codes, 3) << np.uint64(1), _runs(codes, 2) << np.uint64(1) | np.uint64(1)
            items.append(np.concatenate([three, two]).view(np.int64))
            sizes.append([float(len(three)), float(len(two))])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items)))
        return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes, pa.list_(pa.float64())), part.column(2)], ["id", "items", "weights", "scale"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # grams take many times the text's bytes
                yield grams(batch.slice(start, 256))

    texts = rows.select(F.col("id").cast("string").alias("id"), C.content_key(F.col("content")).alias("text"), (F.col(order).cast("double") if order else F.lit(0.0)).alias("scale"))
    return texts.where("text <> ''").mapInArrow(run, "id string, items array<long>, weights array<double>, scale double")


def resembling(a: DataFrame, b: DataFrame, least: float, most: int, order: str | None = None) -> DataFrame:
    """(a, b, score, rank): the `most` texts b (id, content) that resemble a text a best, of those that reach `least`; ties by id.

    The score is the larger of 3-gram Jaccard and 2-gram Dice. A stated set of texts against all: common
    grams are counted in arrays in a task and only the best leave it, so grams that nearly all texts have cost additions and no rows.
    With `order` (a column of both) only texts that come before a count.
    """

    def score(q: Sets, sets: Sets, floor: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        places, (sizes, q_sizes) = sets.places(), (x.weights.reshape(-1, 2) for x in (sets, q))
        items, owner, _ = sorted_items(sets)
        for first, ends, own in query_blocks(q):
            for n, at, _ in meeting(ends, q.items[own], items):
                odd, at = (items[at] & 1).astype(bool), owner[at]
                three, two = np.bincount(at[~odd], minlength=len(sets)), np.bincount(at[odd], minlength=len(sets))
                jaccard = three / np.maximum(q_sizes[first + n, 0] + sizes[:, 0] - three, 1)
                dice = 2 * two / (q_sizes[first + n, 1] + sizes[:, 1])
                rounded = np.floor(np.maximum(jaccard, dice) * 1e4 + 0.5)
                good = np.flatnonzero((rounded / 1e4 >= least) & (rounded >= floor[first + n]) & ((sets.scales < q.scales[first + n]) if order else True))
                if len(good):
                    whole = rounded[good].astype(np.int64)
                    best = best_of(whole, places[good], k) if len(good) > k else np.arange(len(good))
                    yield np.full(len(best), first + n), good[best], whole[best]

    return best_matches(_gram_sets(a, order), _gram_sets(b, order), most, score, 1e4).withColumnsRenamed({"query_id": "a", "id": "b"})


def import_plan(bundle: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, verdict, best, matched, refs) of bundle rows (seq, id, content) against existing ones: dup, near-dup, conflict-candidate or new.

    refs are the (id, score) that a verdict rests on: the existing row with the same text (the least id), up to three existing ones that resemble it, by score and
    id, or one earlier row of the bundle, as `bundle#<seq>`. Rows that nothing existing resembles are checked against earlier rows of the bundle that aren't duplicates.
    """
    hashed = lambda df: df.withColumn("hash", C.content_digest(F.col("content")))
    known = hashed(existing).groupBy("hash").agg(F.min("id").alias("dup_of"))
    rows = hashed(bundle).join(known, "hash", "left")
    fresh = rows.where("dup_of is null")
    fresh = checkpoint(fresh.select("id", "seq", "content"))
    near = resembling(fresh, existing, RELATED, 3).groupBy("a").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("matched"), F.array_sort(F.collect_list(F.struct("rank", "b", "score"))).alias("near"))
    best = near.withColumn("near", F.transform("near", lambda x: F.struct(x["b"].alias("id"), x["score"].alias("score"))))  # three at most
    numbers = fresh.select(F.col("id").cast("string").alias("b"), F.concat(F.lit("bundle#"), F.col("seq").cast("string")).alias("own_ref"))
    best = checkpoint(best)
    alone = fresh.join(best.select(F.col("a").alias("id")), "id", "left_anti")  # all texts against all: only for rows whose verdict rests on it
    own = resembling(alone, fresh, RELATED, 1, "seq").select("a", "b", F.col("score").alias("own_best")).join(numbers, "b").drop("b")
    told = rows.join(best.withColumnRenamed("a", "id"), "id", "left").join(own.withColumnRenamed("a", "id"), "id", "left")
    score = F.coalesce("best", "own_best")
    verdict = F.when(F.col("dup_of").isNotNull(), "dup").when(score >= DUPLICATE, "near-dup").when(score >= RELATED, "conflict-candidate").otherwise("new")
    one = lambda ref, score: F.array(F.struct(F.col(ref).alias("id"), score.alias("score")))
    none = F.array().cast("array<struct<id:string,score:double>>")
    refs = F.when(F.col("dup_of").isNotNull(), one("dup_of", F.lit(1.0))).when(F.col("near").isNotNull(), F.col("near")).when(F.col("own_best").isNotNull(), one("own_ref", F.col("own_best"))).otherwise(none)
    return told.select("seq", verdict.alias("verdict"), F.when(F.col("dup_of").isNotNull(), 1.0).otherwise(score).alias("best"), F.when(F.col("dup_of").isNotNull(), 1).otherwise(F.coalesce("matched", F.when(F.col("own_best").isNotNull(), 1), F.lit(0))).cast("long").alias("matched"), refs.alias("refs"))


def freeze_pairs(decisions: DataFrame, existing: DataFrame, open_hard: int, most_hard: int) -> DataFrame:
    """New pairs (seq, winner, loser, kind, in_batch) with their fate: pending, auto (the loser is retired) or unparked; those there already are left out.

    Only hard pairs use the quota; the first ones by seq get what is left of it.
    """
    named = decisions.withColumn("pair_id", C.input_digest(F.array("run_id", "winner", "loser"), "pair/v1"))
    new = named.groupBy("pair_id").agg(F.min(F.struct("seq", "kind", "in_batch")).alias("d")).select("pair_id", "d.*")  # a pair's first decision
    new = new.join(existing.select("pair_id"), "pair_id", "left_anti")
    hard = new.where("kind = 'hard'").select("pair_id", "seq").orderBy("seq").limit(max(0, most_hard - open_hard)).select("pair_id", F.lit(True).alias("fits"))
    fate = F.when((F.col("kind") != "hard") | F.col("fits"), "pending").when(F.col("in_batch"), "unparked").otherwise("auto")
    return new.join(F.broadcast(hard) if most_hard <= 10_000 else hard, "pair_id", "left").select("seq", "pair_id", fate.alias("fate"))


def resolve_pairs(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pairs after outcomes (pair_id, seq, outcome): the first counts; defer counts up to 3; winner and loser retire one side."""
    first = outcomes.groupBy("pair_id").agg(F.min_by("outcome", "seq").alias("outcome"))
    rows = pairs.join(first, "pair_id", "left")
    open_ = F.col("resolution").isNull() | (F.col("resolution") == "defer")
    defer = F.col("outcome") == "defer"
    now = F.when(open_ & F.col("outcome").isNotNull(), F.col("outcome")).otherwise(F.col("resolution"))
    count = F.when(open_ & defer, F.least(F.col("defer_count") + 1, F.lit(3))).otherwise(F.col("defer_count"))
    retired = F.when(open_ & F.col("outcome").isin("winner", "auto"), F.col("loser_id")).when(open_ & (F.col("outcome") == "loser"), F.col("winner_id"))
    return rows.select("pair_id", now.alias("resolution"), count.alias("defer_count"), retired.alias("retired"))


def _claims(decisions: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of decisions that fold records: (id, seq, target) for each target there is, and (id, member) with the new record itself."""
    act = decisions.where(F.col("action").isin("update", "merge"))
    claims = act.select("id", "seq", F.explode("targets").alias("target")).join(records.select(F.col("id").alias("target")), "target", "left_semi")
    return claims, act.select("id", F.col("id").alias("member")).union(claims.select("id", F.col("target").alias("member"))).distinct()


def merged_records(decisions: DataFrame, records: DataFrame, now: int) -> DataFrame:
    """The rows `m-<id>` that update and merge make: (id, content, tags, wing, ext_key, timestamps).

    decisions may have `merged_content`; where it is blank the new record's own content stands. Tags and wing are merged by
    `merge_axes`, the first key of another system in order is taken over, and times are those of all members, and now.
    """
    _, own = _claims(decisions, records)
    parts = own.join(records.select(F.col("id").alias("member"), "seq", "content", "tags", "wing", "ext_key", F.array("created_ms", "updated_ms").alias("times")), "member")
    members = parts.select(F.col("id").alias("survivor"), "seq", (F.col("member") == F.col("id")).alias("is_self"), "content", "tags", "wing", "ext_key", "times")
    order = F.struct((~F.col("is_self")).alias("later"), F.col("seq"))
    rest = members.groupBy("survivor").agg(
        F.max(F.when(F.col("is_self"), F.col("content"))).alias("own"),
        F.min_by("ext_key", F.when(F.col("ext_key").isNotNull(), order)).alias("ext_key"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_set("times")), F.array(F.lit(now))))).alias("timestamps"),
    )
    said = decisions.select(F.col("id").alias("survivor"), C.null_if_blank(F.trim("merged_content")).alias("merged"))
    rows = merge_axes(members).join(rest, "survivor").join(said, "survivor")
    return rows.select(F.concat(F.lit("m-"), "survivor").alias("id"), F.coalesce("merged", "own").alias("content"), "tags", "wing", "ext_key", "timestamps")


def usage_moves(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(old, new): whose counters a merged row takes over, for `analytics.rekey`: each target once, by its first claimant."""
    claims, _ = _claims(decisions, records)
    return claims.groupBy(F.col("target").alias("old")).agg(F.concat(F.lit("m-"), F.min_by("id", "seq")).alias("new"))


def conflict_pairs(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(id, winner, loser, in_batch, rejected) of conflict decisions (id, winner, loser): a pair is the new record and one that is there or
    came with it; any other is rejected, with the reason, and its record is plainly stored."""
    rows = decisions.where("action = 'conflict'").select("id", "winner", "loser")
    other = F.when(F.col("winner") == F.col("id"), F.col("loser")).when(F.col("loser") == F.col("id"), F.col("winner"))
    there = records.select(F.col("id").alias("other"), F.lit(True).alias("there"))
    batch = decisions.select(F.col("id").alias("other"), F.lit(True).alias("batch"))
    met = rows.withColumn("other", other).join(there, "other", "left").join(batch, "other", "left")
    reason = F.when(F.col("winner").isNull() | F.col("loser").isNull(), "incomplete").when(F.col("winner") == F.col("loser"), "same").when(F.col("other").isNull(), "not-its-own").when(F.col("there").isNull() & F.col("batch").isNull(), "unknown")
    return met.select("id", "winner", "loser", F.coalesce("batch", F.lit(False)).alias("in_batch"), reason.alias("rejected"))


def apply_decisions(decisions: DataFrame, records: DataFrame, now: int) -> DataFrame:
    """What becomes of records: (id, fate, by, version, valid_from_ms, valid_to_ms) for decisions (id, seq, action, targets).

    store keeps the new record; update and merge make a row `m-<id>` of it and its targets and retire both;
    skip drops it, and a conflict stores it beside the other (see `conflict_pairs`). A target falls to the first decision that claims it.
    """
    claims, own = _claims(decisions, records)
    firsts = claims.groupBy("target").agg(F.min_by("id", "seq").alias("by"))
    parts = own.join(records.select(F.col("id").alias("member"), "version", "valid_from_ms", "valid_to_ms"), "member")
    merged = parts.groupBy("id").agg(F.max("version").alias("version"), F.min("valid_from_ms").alias("valid_from_ms"), F.bool_or(F.col("valid_to_ms").isNull()).alias("open"), F.max("valid_to_ms").alias("last"))
    none = F.lit(None).cast("string")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("version", "int"), ("valid_from_ms", "long"), ("valid_to_ms", "long"))]
    made = merged.select(F.concat(F.lit("m-"), "id").alias("id"), F.lit("merged").alias("fate"), none.alias("by"), (F.col("version") + 1).cast("int").alias("version"), "valid_from_ms", F.when(~F.col("open"), F.col("last")).alias("valid_to_ms"))
    gone = firsts.select(F.col("target").alias("id"), F.lit("retired").alias("fate"), F.concat(F.lit("m-"), "by").alias("by"), *nothing)
    fate = F.when(F.col("action") == "store", "stored").when(F.col("action") == "skip", "skipped").when(F.col("action").isin("update", "merge"), "folded").otherwise("stored")
    new = decisions.select("id", fate.alias("fate"), none.alias("by"), *nothing)
    return made.union(gone).union(new)
