"""Set operations: lanes, merged records, tags and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import columns as C


def merge_axes(members: DataFrame) -> DataFrame:
    """One row for each survivor of members (survivor, seq, is_self, tags, wing): up to 6 tags in order; its own wing, else the targets' if they agree."""
    order = F.struct((~F.col("is_self")).alias("later"), F.col("seq"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "tags"))), lambda x: x["tags"])
    theirs = F.array_distinct(F.collect_list(F.when(~F.col("is_self"), F.col("wing"))))
    rows = members.groupBy("survivor").agg(C.norm_tags(F.flatten(ordered), 6).alias("tags"), F.max(F.when(F.col("is_self"), F.col("wing"))).alias("mine"), theirs.alias("theirs"))
    return rows.select("survivor", "tags", F.coalesce("mine", F.when(F.size("theirs") == 1, F.col("theirs")[0])).alias("wing"))


def merge_temporal(members: DataFrame) -> DataFrame:
    """(survivor, valid_from_ms, valid_to_ms, persistence): the earliest start; open if any is; the first persistence in order."""
    return members.groupBy("survivor").agg(
        F.min("valid_from_ms").alias("valid_from_ms"),
        F.when(~F.bool_or(F.col("valid_to_ms").isNull()), F.max("valid_to_ms")).alias("valid_to_ms"),
        F.min_by("persistence", F.when(F.col("persistence").isNotNull(), F.struct((~F.col("is_self")).alias("later"), F.col("seq")))).alias("persistence"),
    )


def rewrite_tags(records: DataFrame, renames: dict[str, str]) -> DataFrame:
    """(id, tags, changed) under renamed rooms: chains of renames are followed first, repeats go."""
    final = {}
    for old in renames:
        seen, new = {old}, renames[old]
        while new in renames and new not in seen:
            seen.add(new)
            new = renames[new]
        final[old] = new
    names = C.text_map(final)
    new = F.array_distinct(F.transform("tags", lambda t: F.coalesce(names[t], t)))
    return records.select("id", new.alias("tags"), (new != F.col("tags")).alias("changed"))


def minus_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen, ["query_id", "id"], "left_anti")


def restore_selected(current: DataFrame, snapshot: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current rows with the wanted ones as a snapshot has them, and the wanted ids that it lacks."""
    back = snapshot.join(wanted, "id", "left_semi")
    return current.join(back.select("id"), "id", "left_anti").unionByName(back), wanted.join(snapshot.select("id"), "id", "left_anti")


def snapshot_manifest(section: str, rows: DataFrame) -> DataFrame:
    """(section, n, digest) of rows, whatever their order: the sum and the exclusive or of their hashes."""
    h = F.xxhash64(*rows.columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")).alias("digest")).select(F.lit(section).alias("section"), "n", "digest")


def snapshot_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two snapshots has, with the side."""
    b = b.select(a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def retire(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records with the markers of changes (id, action retire or restore, reason); what is retired already stays as it is."""
    rows = records.join(changes.select("id", "action", F.col("reason").alias("new_reason")), "id", "left")
    reason = F.when((F.col("action") == "retire") & F.col("retired_reason").isNull(), F.col("new_reason")).when(F.col("action") == "restore", F.lit(None)).otherwise(F.col("retired_reason"))
    return rows.withColumn("retired_reason", reason).select(records.columns)


def purge(records: DataFrame, exported: DataFrame) -> DataFrame:
    """The records without those that are retired and have been exported."""
    gone = records.where("retired_reason is not null").join(exported.select("id"), "id", "left_semi")
    return records.join(gone.select("id"), "id", "left_anti")


def purge_checked(records: DataFrame, wanted: DataFrame, exported: DataFrame) -> DataFrame:
    """The records without the wanted ones that are retired, if an export (id, digest) has all of them as they are; an error if it hasn't.

    The digest is `record_digest`'s. What else the export holds, or has changed outside, doesn't matter.
    """
    gone = records.where("retired_reason is not null").join(wanted.select("id").distinct(), "id", "left_semi")
    lacking = record_digest(gone).join(exported.select("id", "digest"), ["id", "digest"], "left_anti")
    if not lacking.isEmpty():
        raise ValueError("the export lacks records that are to be purged, or has them otherwise")
    return records.join(gone.select("id"), "id", "left_anti")


def record_digest(records: DataFrame) -> DataFrame:
    """(id, digest) of whole rows."""
    return records.select("id", F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256).alias("digest"))
