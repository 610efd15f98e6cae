"""Cheapest repairs of conversations: a shortest path with backward costs kept at checkpoints only."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, shuffle_partitions, table
from memlake.operators.shared import small, stored

#: The space and the ASCII controls tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: States of a repaired conversation: empty, after the system's message, after the user's, after the assistant's; those that it may end in.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
#: By state: the state after the initial of a role that may follow.
FOLLOWS = ({"u": USER, "s": SYSTEM}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: By state: the state after a message of the one role that a new or renamed message can have there.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
DELETE, RENAME, INSERT, UNFINISHED = 2, 1, 5, 5
LEGAL = {"su", "ua", "au"}
#: Messages that one task looks at together, as planned.
SHEET = 1 << 19

Costs = tuple[float, ...]


def row_options(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of what can be done with a message."""
    yield "D", DELETE, state
    if FAULTS[fault] not in ("blank", "duplicate"):
        more = UNFINISHED if FAULTS[fault] == "truncated" else 0
        if initial in FOLLOWS[state]:
            yield "K", more, FOLLOWS[state][initial]
        yield "R", RENAME + more, NEXT[state]


def relative(costs: Costs) -> Costs:
    """Costs from the least one on: only differences matter, and there are few different ones."""
    least = min(costs)
    return tuple(c - least for c in costs)


def with_inserts(costs: Costs) -> Costs:
    """The same, where messages may be inserted first; a third one leads to no new state."""
    once = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, INSERT + once[NEXT[s]]) for s, c in enumerate(once))


#: Costs by state after the last message.
LAST = with_inserts(tuple(0 if s in ENDS else math.inf for s in range(4)))


@functools.cache
def backward(initial: str, fault: int, after: Costs) -> Costs:
    """Least costs by state before a message, from those after it; both relative."""
    return relative(with_inserts(tuple(min(cost + after[to] for _, cost, to in row_options(initial, fault, s)) for s in range(4))))


@functools.cache
def forward(initial: str, fault: int, after: Costs, state: int) -> tuple[str, int, int]:
    """(edits, next state, cost) of the cheapest way past a message, of equal ones the ASCII-least: D, I, K, R."""
    on_row = [min(cost + after[to] for _, cost, to in row_options(initial, fault, s)) for s in range(4)]
    costs, done, paid = with_inserts(tuple(on_row)), "", 0
    while True:
        options = [(edit, cost, to, cost + after[to]) for edit, cost, to in row_options(initial, fault, state)]
        options.append(("I", INSERT, NEXT[state], INSERT + costs[NEXT[state]]))
        edit, cost, to, _ = min(o for o in options if o[3] == costs[state])
        done, paid, state = done + edit, paid + cost, to
        if edit != "I":
            return done, state, paid


def closing(state: int) -> str:
    """The inserts after the last message."""
    return {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]


@functools.cache
def prepended(initial: str, fault: int, rest: tuple[Costs, ...]) -> tuple[Costs, ...]:
    """Costs from state to state of a run of messages with one more before it, relative to the least."""
    columns = [with_inserts(tuple(min(cost + rest[to][end] for _, cost, to in row_options(initial, fault, s)) for s in range(4))) for end in range(4)]
    least = min(min(c) for c in columns)
    return tuple(tuple(columns[end][s] - least for end in range(4)) for s in range(4))


NOTHING = tuple(tuple(0 if s == t else math.inf for t in range(4)) for s in range(4))


def through(rest: tuple[Costs, ...], after: Costs) -> Costs:
    """Costs before a run of messages, from its costs from state to state and those after it."""
    return relative(tuple(min(rest[s][t] + after[t] for t in range(4)) for s in range(4)))


def walk(messages: list[tuple[str, int]], after: Costs, state: int) -> Iterator[tuple[str, int, int]]:
    """(edits, next state, cost) of each message (initial, fault) of a run, the costs after the run being known.

    The costs before each message are kept at every sqrt(n)-th message only; a block's are computed again from the
    checkpoint at its end when the walk gets there. So 2 sqrt(n) of them are held at a time.
    """
    every = math.isqrt(max(0, len(messages) - 1)) + 1
    kept = {}
    for k in range(len(messages) - 1, -1, -1):
        if (k + 1) % every == 0 or k + 1 == len(messages):
            kept[k // every] = after
        after = backward(*messages[k], after)
    for start in range(0, len(messages), every):
        block = messages[start : start + every]
        costs = [kept[start // every]]
        for message in reversed(block[1:]):
            costs.append(backward(*message, costs[-1]))
        for message, later in zip(block, reversed(costs), strict=True):
            edits, state, cost = forward(*message, later, state)
            yield edits, state, cost


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) % 20; a null is one space there, and as role and text.

    0 drops the message, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", "role", "text")


def _messages(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The messages with a number each, their initial, whether they are blank or finished, and a digest of role and text; written."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    known = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return stored(known.withColumns({"row": F.monotonically_increasing_id(), "initial": F.substring("role", 1, 1), "blank": end == "", "finished": end.isin(".", "!", "?"), "said": F.unhex(F.sha2(whole, 256))}))


def _in_order(messages: DataFrame) -> DataFrame:
    """(conv, turn, row, initial, fault), written in order: partitions are ranges of conversations and turns, so that a large one lies in several."""
    first = messages.where("not blank").groupBy("conv", "said").agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = small(checkpoint(first.select(F.col("conv").alias("of"), F.col("said").alias("same"), F.col("first.row").alias("first_row"))))
    narrow = messages.drop("text")
    joined = narrow.join(first, narrow["conv"].eqNullSafe(first["of"]) & (narrow["said"] == first["same"]), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("row") != F.col("first_row"), 2).when(~F.col("finished"), 3).otherwise(0)
    rows = joined.withColumn("fault", fault)
    order = ("conv", "turn", "role", "said", "row")
    parts = max(shuffle_partitions(messages.sparkSession), messages.count() // SHEET)
    return checkpoint(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "turn", "row", "initial", "fault"))


def _runs(sheet: pa.Table) -> Iterator[tuple[int, int, str]]:
    """(begin, end, name) of each conversation's messages in one partition."""
    conv = sheet["conv"]
    code = conv.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    begins = [k for k in range(len(code)) if k == 0 or code[k] != code[k - 1]]
    for a, b in zip(begins, [*begins[1:], len(code)], strict=True):
        yield a, b, repr(conv[a].as_py())


def _listed(sheet: pa.Table) -> list[tuple[str, int]]:
    return list(zip(sheet["initial"].to_pylist(), sheet["fault"].to_pylist(), strict=True))


def _junctions(ordered: DataFrame) -> dict:
    """By (partition, place of its run): (costs after it, state before it, last initial before it) of each run that is a part of a conversation in several partitions.

    Only the first and the last run of a partition can be such a part. Of each, the tasks return its costs from state to state, and then, the costs after
    it being known, the state that each state leads to: two small rows a partition, which the driver strings together.
    """
    numbered = ordered.withColumn("sheet", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            sheet = pa.Table.from_batches(held)
            runs, messages = list(_runs(sheet)), _listed(sheet)
            out = []
            for place in sorted({0, len(runs) - 1}):
                a, b, name = runs[place]
                rest = NOTHING
                for message in reversed(messages[a:b]):
                    rest = prepended(*message, rest)
                out.append((sheet["sheet"][0].as_py(), place, name, [float(x) for row in rest for x in row], messages[b - 1][0]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["sheet", "place", "name", "costs", "last"])

    found = sorted(numbered.mapInArrow(ends, "sheet long, place long, name string, costs array<double>, last string").collect())
    parts: dict[str, list] = {}
    for row in found:
        parts.setdefault(row["name"], []).append(row)
    split = [rows for rows in parts.values() if len(rows) > 1]
    if not split:
        return {}
    after: dict[tuple[int, int], Costs] = {}
    for rows in split:
        costs = LAST
        for row in reversed(rows):
            after[row["sheet"], row["place"]] = costs
            costs = through(tuple(tuple(row["costs"][4 * s : 4 * s + 4]) for s in range(4)), costs)
    known = ordered.sparkSession.sparkContext.broadcast(after)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            sheet = pa.Table.from_batches(held)
            number, runs, messages = sheet["sheet"][0].as_py(), list(_runs(sheet)), _listed(sheet)
            for place in sorted({0, len(runs) - 1}):
                if (number, place) in known.value:
                    a, b, _ = runs[place]
                    to = []
                    for state in range(4):
                        for _, state, _ in walk(messages[a:b], known.value[number, place], state):  # noqa: B020
                            pass
                        to.append(state)
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([place]), pa.array([to])], ["sheet", "place", "to"])

    leading = {(r["sheet"], r["place"]): r["to"] for r in numbered.mapInArrow(leads, "sheet long, place long, to array<long>").collect()}
    out = {}
    for rows in split:
        state, last = EMPTY, None
        for k, row in enumerate(rows):
            at = (row["sheet"], row["place"])
            out[at] = (after[at], state, last, k + 1 == len(rows))
            state, last = leading[at][state], row["last"]
    return out


def plan_repairs(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation: (messages, edits), both written.

    edits has one row for each edit: (conv, place, nth, edit, row, role, turn, fault, illegal, cost). edit is D, K, R or I; row is the message's number
    in `messages` (null for I); role is the new role of R and I; turn, fault and illegal (its pair with the message before isn't su, ua or au)
    are the message's. place and nth order the edits of a conversation.

    Messages are taken by turn, nulls first; of one turn by role, then by a digest of role and text, so that copies are adjacent. Null roles and texts are
    one space; a null conv_id is a conversation of its own. A message's first fault counts: blank (no character but white space), duplicate (role and
    text are those of an earlier one), truncated (its last character but white space isn't . ! or ?). Keeping costs 0, another role 1, deleting 2
    (a must for blank and duplicate ones), inserting an empty message 5, and 5 more for each truncated one that stays. The initials of the
    roles then are `(s?(ua)+)?`; of equally cheap lists of edits the ASCII-least is taken. An empty table gives empty ones; other columns aren't read.

    The method: see `walk`. A conversation that lies in several partitions is cut there; see `_junctions`.
    """
    messages = _messages(rows, conv_col, turn_col, role_col, text_col)
    ordered = _in_order(messages)
    known = rows.sparkSession.sparkContext.broadcast(_junctions(ordered))
    conv = ordered.schema["conv"].dataType.simpleString()
    turn = ordered.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sheet = pa.Table.from_batches(held)
        number, messages = sheet["sheet"][0].as_py(), _listed(sheet)
        at, nth, edit, new, illegal, paid = [], [], [], [], [], []
        for place, (a, b, _) in enumerate(_runs(sheet)):
            after, state, last, is_last = known.value.get((number, place), (LAST, EMPTY, None, True))
            steps = zip(messages[a:b], walk(messages[a:b], after, state), strict=True)
            for k, ((initial, _), (edits, to, cost)) in enumerate(steps, a):
                for n, e in enumerate(edits):
                    state = NEXT[state] if e == "I" else to
                    at.append(k)
                    nth.append(n)
                    edit.append(e)
                    new.append(ROLES[state] if e in "IR" else None)
                    illegal.append(e != "I" and last is not None and last + initial not in LEGAL)
                    paid.append(INSERT if e == "I" else cost - INSERT * (len(edits) - 1))
                last = initial
            for n, e in enumerate(closing(state) if is_last else "", len(edits)):
                state = NEXT[state]
                at.append(b - 1)
                nth.append(n)
                edit.append(e)
                new.append(ROLES[state])
                illegal.append(False)
                paid.append(INSERT)
        own = [e != "I" for e in edit]
        only = lambda name: pa.array([v if o else None for v, o in zip(sheet[name].take(pa.array(at)).to_pylist(), own, strict=True)], sheet.schema.field(name).type)
        columns = [sheet["conv"].take(pa.array(at)).combine_chunks(), pa.array([(number << 33) + k for k in at]), pa.array(nth, pa.int32()), pa.array(edit), only("row"), pa.array(new, pa.string()), only("turn"), only("fault"), pa.array(illegal), pa.array(paid, pa.int64())]
        whole = pa.table(columns, ["conv", "place", "nth", "edit", "row", "role", "turn", "fault", "illegal", "cost"])
        yield from whole.to_batches(max_chunksize=1 << 16)

    edits = ordered.withColumn("sheet", F.spark_partition_id()).mapInArrow(run, f"conv {conv}, place long, nth int, edit string, row long, role string, turn {turn}, fault int, illegal boolean, cost long")
    return messages, checkpoint(edits)


def with_texts(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with role and text as repaired; both null for a deleted message. Inserted ones, which have no row, aren't joined."""
    texts = messages.select(F.col("row").alias("of"), F.col("role").alias("old"), "text")
    met = edits.where("edit <> 'I'").join(texts, F.col("row") == F.col("of"))
    stays = F.col("edit") != "D"
    kept = met.select("conv", "place", "nth", "edit", F.when(stays, F.coalesce("role", "old")).alias("role"), F.when(stays, F.col("text")).alias("text"), "turn")
    return kept.union(edits.where("edit = 'I'").select("conv", "place", "nth", "edit", "role", F.lit("").alias("text"), "turn"))


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: (conv, place, nth, edit, role, text, turn) of every message that stays or is new; see `plan_repairs`."""
    return with_texts(*plan_repairs(rows, conv_col, turn_col, role_col, text_col)).where("edit <> 'D'")


def reports(edits: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost) of each conversation that has messages. gaps: turns missing between the first and the last."""
    has = lambda fault: F.sum((F.col("fault") == FAULTS.index(fault)).cast("long")).alias(fault)
    own = edits.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"), *map(has, FAULTS[1:]), F.sum(F.col("illegal").cast("long")).alias("illegal"), F.sum("cost").alias("cost"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return own.select("conv", gaps.alias("gaps"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FAULTS[1:]), "illegal", "cost")


def digests(lines: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of rows of `with_texts`: all edits' initials, and the SHA-256 of `role:text` of what stays, joined by line feeds.

    A digest is a stream: a conversation's rows pass one task in order, a batch at a time, and only its edits' initials, which are the result, are held.
    """
    conv = lines.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, sha, empty = None, [], hashlib.sha256(), True
        kind = None
        for batch in batches:
            done = []
            kind = batch.schema.field("conv").type
            for conv, edit, line in zip(*(batch.column(n).to_pylist() for n in ("conv", "edit", "line")), strict=True):
                name = repr(conv)
                if now is None or now[0] != name:
                    if now is not None:
                        done.append((now[1], "".join(audit), sha.hexdigest()))
                    now, audit, sha, empty = (name, conv), [], hashlib.sha256(), True
                audit.append(edit)
                if line is not None:
                    sha.update(b"" if empty else b"\n")
                    sha.update(line.encode("utf-8", "replace"))
                    empty = False
            audit = ["".join(audit)]
            if done:
                yield from batch_of(done, kind)
        if now is not None:
            yield from batch_of([(now[1], "".join(audit), sha.hexdigest())], kind)

    def batch_of(rows: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["conv", "audit", "repaired_sha256"])

    said = lines.select("conv", "place", "nth", "edit", F.concat("role", F.lit(":"), "text").alias("line"))
    return said.repartition("conv").sortWithinPartitions("conv", "place", "nth").select("conv", "edit", "line").mapInArrow(run, f"conv {conv}, audit string, repaired_sha256 string")


def audit_conversations(conversations: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conv_id of `conversations`: `reports` and `digests` of its messages in `rows`, as damaged; zeros, an empty audit and the empty text's digest if none is left."""
    messages, edits = plan_repairs(rows)
    every = conversations.select(F.col(conv_col).alias("conv_id")).distinct()
    counted = reports(edits).withColumnRenamed("conv", "of")
    written = digests(with_texts(messages, edits)).withColumnRenamed("conv", "whose")
    joined = every.join(counted, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("cost").isNotNull(), "left")
    joined = joined.join(written, F.col("conv_id").eqNullSafe(F.col("whose")) & F.col("audit").isNotNull(), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("conv_id").alias(conv_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after the stated damage: see `damaged` and `plan_repairs` for nulls, ties and repeated rows."""
    conversations = table(spark, sf_dir, "conversations")
    return audit_conversations(conversations, damaged(conversations))


#: CRC-32 is computed from its polynomial, costs by recursion from each conversation's end, and the edits by one from its beginning.
ORACLE = {
    "op13_checkpointed_repair": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS r,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM damaged),
faults AS (
  SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
steps AS (
  SELECT conv_id, i, n, role, text, fault, r, CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 0 END + CASE fault WHEN 3 THEN 5 ELSE 0 END AS stay FROM faults),
costs(conv_id, i, v) AS (
  SELECT DISTINCT conv_id, n + 1, [0, 10, 5, 0] FROM steps
  UNION ALL
  SELECT conv_id, i, [least(w[1], 5 + w[3], 10 + w[4]), least(w[2], 5 + w[3], 10 + w[4]), least(w[3], 5 + w[4]), least(w[4], 5 + w[3])] FROM (
    SELECT s.conv_id, s.i, [
      least(2 + v[1], stay + 1 + v[3], CASE r WHEN 'u' THEN stay + v[3] WHEN 's' THEN stay + v[2] ELSE 1000000 END),
      least(2 + v[2], stay + 1 + v[3], CASE r WHEN 'u' THEN stay + v[3] ELSE 1000000 END),
      least(2 + v[3], stay + 1 + v[4], CASE r WHEN 'a' THEN stay + v[4] ELSE 1000000 END),
      least(2 + v[4], stay + 1 + v[3], CASE r WHEN 'u' THEN stay + v[3] ELSE 1000000 END)] AS w
    FROM costs c JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.i - 1)),
ways AS (
  SELECT c.conv_id, c.i, c.v, l.v AS later, s.n, s.role, s.text, s.r, s.stay FROM costs c
  LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.i
  LEFT JOIN costs l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.i + 1),
nexts AS (SELECT [3, 3, 4, 3] AS nx, ['', '', 'user', 'assistant'] AS names),
walked(conv_id, i, s, audit, lines, cost, over) AS (
  SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[], 0, false FROM (SELECT DISTINCT conv_id FROM steps)
  UNION ALL
  SELECT conv_id, i + CASE WHEN e IN ('D', 'K', 'R') THEN 1 ELSE 0 END,
    CASE WHEN e IN ('I', 'R') THEN nx[s] WHEN e = 'K' THEN CASE r WHEN 'u' THEN 3 WHEN 'a' THEN 4 ELSE 2 END ELSE s END,
    audit || e,
    CASE e WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, names[nx[s]] || ':' || text) WHEN 'I' THEN list_append(lines, names[nx[s]] || ':') ELSE lines END,
    cost + CASE e WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN stay WHEN 'R' THEN stay + 1 ELSE 0 END, e = ''
  FROM (
    SELECT w.*, y.role, y.text, y.r, y.stay, CASE
        WHEN y.n IS NULL AND y.v[s] = 0 THEN ''
        WHEN y.n IS NOT NULL AND 2 + y.later[s] = y.v[s] THEN 'D'
        WHEN 5 + y.v[nx[s]] = y.v[s] THEN 'I'
        WHEN stay + (CASE WHEN r = 'u' AND s <> 3 THEN later[3] WHEN r = 'a' AND s = 3 THEN later[4] WHEN r = 's' AND s = 1 THEN later[2] ELSE 1000000 END) = y.v[s] THEN 'K'
        ELSE 'R' END AS e
    FROM walked w JOIN ways y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i, nexts WHERE NOT w.over), nexts),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM walked WHERE over) w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}
