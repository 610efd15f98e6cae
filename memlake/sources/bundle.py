"""Loading, projecting and exporting records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import columns as C

# The columns, versions and type codes of the format.
VERSIONS = ("1", "v1", "1.1", "v1.1")
TYPE_CODES = {
    "pe": "persona", "ep": "episodic", "in": "instruction", "wf": "work_fact", "wt": "work_task", "wm": "work_method", "wa": "work_artifact",
    "ui": "user_info", "uh": "user_hobby", "uc": "user_communication", "ub": "user_behavior",
    "pi": "project_introduction", "pt": "project_tech_stack", "pg": "project_architecture", "pb": "project_build_configuration", "pq": "project_dependency_configuration",
    "po": "project_ide_configuration", "ps": "project_scm_configuration", "pw": "project_environment_configuration", "pl": "project_rule",
    "ds": "development_code_specification", "dp": "development_practice_specification", "dv": "development_test_specification", "dn": "development_comment_specification",
    "tm": "task_summary_experience", "dk": "task_breakdown_experience", "df": "task_flow_experience", "td": "task_experience", "tl": "tool_experience", "mp": "mcp_experience",
    "sl": "skill_experience", "lk": "learned_skill_experience", "ek": "expert_experience", "im": "important_decision_experience", "cp": "common_pitfalls_experience", "hf": "history_task_reference_files",
}
COLUMNS = ("type", "created", "updated", "vf", "vt", "st", "cf", "rw", "tags", "content")


def last_per_id(log: DataFrame) -> DataFrame:
    """Of a log of record lines (id, file, seq, ...) the last line of each id."""
    last = W.partitionBy("id").orderBy(F.desc("file"), F.desc("seq"))
    return log.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def clean_messages(messages: DataFrame) -> DataFrame:
    """Messages of a known role with text, in a session (`default` where none is named), with their place in it."""
    good = messages.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    named = good.withColumn("session_id", F.coalesce("session_id", F.lit("default")))
    return named.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("ts_ms", "id")))


def parse_time(raw: Column) -> Column:
    """struct(ms, precision) of a time as text; unknown where it isn't one. Times without a zone are UTC."""
    t = F.trim(raw)
    zone = r"(Z|[+-]\d{2}:?\d{2})?"
    precision = (
        F.when(t.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?{zone}$"), "exact")
        .when(t.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}{zone}$"), "minute")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), "exact")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), "minute")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day")
    )
    at = F.when(precision.isNotNull(), F.unix_millis(t.try_cast("timestamp")))
    return F.struct(at.alias("ms"), F.when(at.isNotNull(), precision).otherwise("unknown").alias("precision"))


def load_bundle(files: DataFrame, header_mark: str = "#bundle") -> tuple[DataFrame, DataFrame]:
    """Records and errors of bundles (path, text): a first line with the format's mark and version, `#count=` and `#sha256=`, then rows of ten columns split by pipes.

    Files of a real system begin with their own mark, which header_mark names. Types are codes or whole names; others are episodic.
    tags (`key:value`, split by commas) come as an array. A version that isn't known and a digest of the rows that isn't
    the declared one (by its first 12 digits) are errors of the file.

    The last column keeps its pipes, with `\\n` and `\\\\` for a line feed and a backslash. A file with any
    error gives no records: bad flags, short content, repeated content, a count that isn't the declared one.
    An end before its start and an update before the creation are moved there.
    """
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n")).alias("seq", "line"))
    header = lines.where(F.col("line").startswith("#")).groupBy("path").agg(
        F.bool_or(F.col("line").startswith(header_mark)).alias("known"), F.max(F.regexp_extract("line", r"^#(?:.*;)?\s*count=(\d+)", 1).try_cast("int")).alias("declared"),
        F.max(C.null_if_blank(F.regexp_extract("line", r"^#(?:.*;)?\s*sha256=([0-9a-f]+)", 1))).alias("sha"),
        F.max(F.when(F.col("line").startswith(header_mark), F.trim(F.regexp_extract(F.substring("line", len(header_mark) + 1, 100), r"^([^;]*)", 1)))).alias("version"),
    )
    body = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("c", F.split("line", r"\|", len(COLUMNS)))
    rows = body.select("path", "seq", *(F.get("c", F.lit(n)).alias(name) for n, name in enumerate(COLUMNS)))
    plain = F.replace(F.replace(F.replace(F.col("content"), F.lit("\\\\"), F.lit("\u0001")), F.lit("\\n"), F.lit("\n")), F.lit("\u0001"), F.lit("\\"))
    rows = rows.withColumn("content", plain).withColumn("copies", F.count(F.lit(1)).over(W.partitionBy("path", F.sha2("content", 256))))
    fault = (
        F.when(F.col("content").isNull(), "columns")
        .when(F.length(F.trim("content")) < 4, "short")
        .when(~F.col("cf").isin("0", "1", "?") | ~F.col("rw").isin("0", "1", "?"), "flag")
        .when(~F.col("st").isin("p", "s", "o", "t", "?"), "persistence")
        .when(F.col("copies") > 1, "repeated")
    )
    rows = rows.withColumn("fault", fault)
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    bodies = F.filter(F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n"), lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    whole = files.select("path", F.substring(F.sha2(F.array_join(bodies, "\n"), 256), 1, 12).alias("digest"))
    told = whole.join(header, "path", "left").join(counts, "path", "left")
    declared = F.col("sha").isNotNull() & (F.substring("sha", 1, 12) != F.expr("substring(digest, 1, least(12, length(sha)))"))
    fault = (
        F.when(~F.coalesce("known", F.lit(False)) | (F.coalesce("declared", "n") != F.coalesce("n", F.lit(0))), "header")
        .when(~F.when(F.col("version") == "", "1").otherwise(F.col("version")).isin(*VERSIONS), "version")
        .when(declared, "sha256")
    )
    bad_file = told.withColumn("fault", fault).where("fault is not null")
    errors = rows.where("fault is not null").select("path", "seq", "fault").union(bad_file.select("path", F.lit(None).cast("int"), "fault"))
    good = rows.join(errors.select("path").distinct(), "path", "left_anti")
    updated = F.when(F.col("updated") < F.col("created"), F.col("created")).otherwise(F.col("updated"))
    ends = F.when((F.col("vt") != "-") & (F.col("vt") < F.col("vf")), F.col("vf")).otherwise(F.col("vt"))
    kind = F.coalesce(C.text_map(TYPE_CODES)[F.col("type")], F.when(F.col("type").isin(*TYPE_CODES.values()), F.col("type")), F.lit("episodic"))
    tags = F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t != "").alias("tags")
    return good.select("path", "seq", kind.alias("type"), "created", updated.alias("updated"), "vf", ends.alias("vt"), "st", "cf", "rw", tags, "content"), errors


def projection(records: DataFrame) -> DataFrame:
    """(rel_path, text) of each record as Markdown, for `write.partitionBy("type").text`; retired ones are marked disabled."""
    tail = F.when(F.col("retired_reason").isNotNull(), ".disabled").otherwise("")
    head = F.concat(F.lit("---\ntype: "), "type", F.lit("\npriority: "), F.col("priority").cast("string"), F.lit("\n---\n"))
    return records.select("type", F.concat("type", F.lit("/"), "id", F.lit(".md"), tail).alias("rel_path"), F.concat(head, "content", F.lit("\n")).alias("text"))


def csv_line(*columns: Column) -> Column:
    """One line of RFC 4180 text."""
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    return F.concat_ws(",", *quoted)


def csv_export(rows: DataFrame, columns: list[Column], order: list[Column], most: int) -> DataFrame:
    """(place, line, truncated): the first `most` rows as CSV lines, and whether there are more."""
    ranked = rows.select(csv_line(*columns).alias("line"), F.struct(*order).alias("o"))
    first = ranked.orderBy("o").limit(most + 1)  # one more tells whether any are cut
    placed = first.withColumn("place", F.row_number().over(W.orderBy("o"))).withColumn("truncated", F.max("place").over(W.partitionBy()) > most)
    return placed.where(F.col("place") <= most).select("place", "line", "truncated")


def tail(journal: DataFrame, most: int, kind: str | None = None) -> DataFrame:
    """The last entries of a journal: a bounded top-k."""
    rows = journal.where(F.col("kind") == kind) if kind else journal
    return rows.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(most)
