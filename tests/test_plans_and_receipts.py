"""Plans of what is verified, and receipts of what is taken in, against loops over the rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import dedupe, ranking


@pytest.mark.parametrize(("records", "calls"), [(50, 50), (30, 10), (0, 5), (1000, 0)])
def test_verification_plan_by_hand(spark, records, calls):
    draw = random.Random(records)
    rows = [(f"m{k:03d}", draw.randrange(20), draw.choice([None, draw.randrange(900)]), draw.choice([None, 0, 1, 3, 20]), draw.choice([None, True, False, False])) for k in range(120)]
    fates, n, spent = {}, 0, 0
    for i, _, _, anchors, done in sorted(rows, key=lambda r: (r[1], r[0])):
        if anchors and done:
            fates[i] = "done"
            continue
        n += 1
        if n > records:
            fates[i] = "over-records"
        elif not anchors:
            fates[i] = "free"
        else:
            spent += 1
            fates[i] = "planned" if spent <= calls else "over-calls"
    plan, estimate = ranking.verification_plan(spark.createDataFrame(rows, "id string, order int, chars int, anchors int, done boolean").repartition(4), records, 8, 1000, calls)
    assert {r["id"]: r["fate"] for r in plan.collect()} == fates
    kept = [r for r in rows if fates[r[0]] in ("planned", "free")]
    chars = sum((r[2] or 0) + (1000 if r[3] else 0) for r in kept)
    told = estimate.first().asDict()
    count = lambda fate: sum(f == fate for f in fates.values())
    assert told == {"total": 120, "calls": count("planned"), "without_anchor": sum(not r[3] for r in rows), "done": count("done"), "over_records": count("over-records"), "over_calls": count("over-calls"), "anchors": sum(min(r[3] or 0, 8) for r in kept), "chars": chars, "tokens": math.ceil(chars / 4)}


def test_receipts_of_what_is_taken_in(spark):
    texts = ["Alpha  beta", "alpha beta", "Alpha beta", "gamma", "delta", "gamma ", "  ", "", "epsilon", "zeta", "delta"]
    items = [("run1" if k < 6 else "run2", f"i{k:02d}", k, t, 50 + k % 3, [k]) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(items, "run_id string, id string, seq long, content string, priority int, timestamps array<long>").repartition(3)
    draw = np.random.default_rng(1)
    base = draw.standard_normal((3, 8))
    near = {0: base[0], 1: base[0], 2: base[0] + 0.01, 3: base[1], 4: base[1] + 0.01, 8: base[2], 9: base[2] + 0.02}
    vectors = spark.createDataFrame([(f"i{k:02d}", k, 0, "chat", "x", v.tolist()) for k, v in near.items()], "id string, seq long, batch int, family string, type string, embedding array<double>")
    absorbed, stages = dedupe.before_store(frame, vectors)
    exact = {r["id"]: r["representative"] for r in dedupe.exact_dedupe(frame).collect()}
    own = {i for i, rep in exact.items() if i == rep}
    follow = {r["id"]: r["leader"] for r in dedupe.leader_clusters(vectors.where(F.col("id").isin(*own))).collect()}
    want = {(i, rep, "exact") for i, rep in exact.items() if i != rep} | {(i, lead, "vector") for i, lead in follow.items() if i != lead}
    rows = absorbed.collect()
    assert len(rows) == len(want) and {(r["record_id"], r["candidate_ids"][0], r["stage"]) for r in rows} == want
    assert {r["stage"] for r in rows} == {"exact", "vector"} and all(r["action"] == "merge" and len(r["candidate_ids"]) == 1 for r in rows)
    run = {i[1]: i[0] for i in items}
    digest = lambda *parts: hashlib.sha256(("absorbed/v1\n" + "".join(f"{len(p)}:{p}\n" for p in parts)).encode()).hexdigest()
    assert all(r["run_id"] == run[r["record_id"]] and r["input_digest"] == digest(r["record_id"], r["candidate_ids"][0]) for r in rows)
    counts = {r["stage"]: r["n"] for r in stages.collect()}
    vector = sum(s == "vector" for *_, s in want)
    assert counts == {"input": len(items), "after_exact": len(own), "after_vector": len(own) - vector}
    nothing, none = dedupe.before_store(frame.limit(0), vectors.limit(0))
    assert nothing.collect() == [] and {r["n"] for r in none.collect()} == {0}
