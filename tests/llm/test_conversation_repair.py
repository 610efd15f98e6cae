"""Repairs of conversations against a search over all lists of edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from memlake.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least (cost, audit, repaired lines), by uniform-cost search over all edits."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        if (i, roles[:1] == "s", len(roles) > 0, roles[-1:]) in seen:
            continue
        seen.add((i, roles[:1] == "s", len(roles) > 0, roles[-1:]))
        ok = lambda r: re.fullmatch("s?(ua)*u?", r)
        for role in ("user", "assistant"):
            if ok(roles + role[0]) and audit.count("I") < 12:
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], (*lines, f"{role}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                if role and ok(roles + role[0]) and role[0] in "sua":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if ok(roles + new[0]):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))
    return None


def audit_by_hand(rows, every):
    out = {}
    for conv in every:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        faults = faults_of(own)
        cost, audit, lines = cheapest(own, faults)
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(frame):
    rows = frame.collect()
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def conversations():
    """No two messages of one turn of a conversation differ, so their order is stated."""
    draw = random.Random(4)
    rows = []
    for conv in [*range(250), None]:
        turns = sorted(draw.sample(range(-3, 12), draw.randrange(1, 8)))
        for turn in turns:
            role = draw.choices(["system", "user", "assistant", "tool", "", None, "u", "sys"], [2, 5, 5, 1, 0.3, 0.3, 0.3, 0.3])[0]
            text = draw.choice(["Yes.", "Yes.", "No! \n", "cut off", "", " \t", None, "é?", f"{turn}.", f"{turn} and {conv}"])
            rows.append((conv, turn, role, text))
        if draw.random() < 0.2:
            rows.append((conv, None, "system", "First."))
    return rows


def test_damage(spark, conversations):
    got = repair.damaged(spark.createDataFrame(conversations, SCHEMA)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(damaged_by_hand(conversations), key=key)


def test_by_search_over_all_edits(spark, conversations):
    frame = spark.createDataFrame(conversations, SCHEMA)
    want = audit_by_hand(damaged_by_hand(conversations), {r[0] for r in conversations})
    assert result(repair.audit_conversations(frame, repair.damaged(frame))) == want
    whole = audit_by_hand([(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in conversations], {r[0] for r in conversations})
    assert result(repair.audit_conversations(frame, frame)) == whole


def test_a_conversation_in_many_partitions(spark):
    """One conversation has nearly all messages: it is cut into many runs, and the cuts change nothing."""
    draw = random.Random(9)
    rows = [(7, k, draw.choice(["user", "assistant", "user", "assistant", "system", "x"]), draw.choice(["a.", f"{k}.", f"{k}.", f"{k}!", "cut"])) for k in range(3000)]
    rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for c in (1, 9) for k in range(4)]
    want = audit_by_hand(rows, {1, 7, 9})
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = result(repair.audit_conversations(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA)))
        assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_checkpoints_hold_a_root_of_the_costs(monkeypatch):
    """Walking gives what a table of all costs gives, for runs of every length."""
    draw = random.Random(1)
    for n in [*range(30), 200]:
        run = [(draw.choice("uasx"), draw.randrange(4)) for _ in range(n)]
        costs = [repair.LAST]
        for m in reversed(run):
            costs.append(repair.backward(*m, costs[-1]))
        state, want = 0, []
        for m, later in zip(run, reversed(costs[:-1]), strict=True):
            edits, state, cost = repair.forward(*m, later, state)
            want.append((edits, state, cost))
        assert list(repair.walk(run, repair.LAST, 0)) == want


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audit_conversations(empty, empty).collect() == []
    assert repair.repaired(empty).collect() == []
    one = spark.createDataFrame([(5, 1, "user", "Gone.")], SCHEMA)
    assert result(repair.audit_conversations(one, one.limit(0))) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    odd = spark.createDataFrame([("c", 1, "user", "Hi.", "x", 1), ("c", 1, "user", "Hi.", "y", 2), ("c", 2, "user", "Fine.", "z", 3)], "thread string, conv int, who string, said string, edit string, row int")
    got = [(r["edit"], r["role"], r["text"], r["turn"]) for r in sorted(repair.repaired(odd, "thread", "conv", "who", "said").collect(), key=lambda r: (r["place"], r["nth"]))]
    assert got == [("K", "user", "Hi.", 1), ("R", "assistant", "Fine.", 2)]
