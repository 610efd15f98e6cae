import math
import random

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import language_id, quality

WORDS = {"en": ["the", "of", "and", "thing", "with", "where"], "de": ["der", "und", "nicht", "straße", "über", "schön"], "fr": ["le", "où", "été", "français", "avec", "qui"]}


def corpus(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        lang = draw.choice(list(WORDS))
        rows.append((k, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randrange(3, 40))), lang, "s"))
    return rows


def test_held_out_accuracy_and_edges(documents):
    rows = corpus(600) + [(9000, None, "en", "s"), (9001, "", "en", "s"), (9002, "123 ²!", "de", "s"), (9003, "the of " * 40_000, "en", "s"), (None, "der und nicht", "de", "s"), (9004, "le où été", None, "s")]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id").eqNullSafe(9004), None).otherwise(F.col("lang")))
    model = language_id.fit(docs, language_id.fold("doc_id", 3) != 1)
    assert model.labels == ["de", "en", "fr"] and 0 < (model.weights == 0).mean() < 1
    got = language_id.identify(docs.withColumnRenamed("source", "score"), model).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all((by_id[k]["lang_pred"], by_id[k]["score"]) == ("und", 0.0) for k in (9000, 9001, 9002))
    assert by_id[9003]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "de" and by_id[9004]["lang_pred"] == "fr"
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and language_id_fold(r["doc_id"]) == 1]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def language_id_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3


def test_labels_of_other_rows_are_not_used(documents):
    rows = corpus(200)
    other = [(i, t, lang if language_id_fold(i) != 1 else "xx", s) for i, t, lang, s in rows]
    one, two = (language_id.fit(documents(r), language_id.fold("doc_id", 3) != 1) for r in (rows, other))
    assert one.labels == two.labels and np.allclose(one.weights, two.weights) and one.temperature == two.temperature


def test_no_language_known(documents):
    docs = documents([])
    model = language_id.fit(docs, F.lit(True))
    assert model.labels == [] and language_id.identify(docs, model).collect() == []
    assert language_id.identify(documents([(1, "abc")]), model).first()["lang_pred"] == "und"


def test_penalty_makes_zeros():
    examples = [(np.array([0, 2]), np.array([1.0, 1.0]), 0), (np.array([1, 2]), np.array([1.0, 1.0]), 1)] * 30
    dense, sparse, none = (language_id.follow_the_leader(examples, 2, 0.5, 1.0, l1, 0.0, 2, 0) for l1 in (0.0, 2.0, 1e9))
    assert np.count_nonzero(dense) > np.count_nonzero(sparse) > np.count_nonzero(none) == 0
    assert dense[0, 0] > 0 > dense[1, 0]


def test_temperature_calibrates():
    draw = np.random.default_rng(0)
    logits = draw.standard_normal((4000, 3))
    labels = np.array([draw.choice(3, p=p) for p in language_id.softmax(logits)])
    assert 0.8 < language_id.temperature(logits, labels) < 1.25
    assert 4 < language_id.temperature(logits * 5, labels) < 6.3


def test_quality_ranks_and_cuts(spark, documents):
    draw = random.Random(2)
    rows, labels = [], []
    for k in range(500):
        good = draw.random() < 0.8
        words = [draw.choice(WORDS["en"]) for _ in range(draw.randrange(5, 60))]
        rows.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((k, int(good), 0))
    rows += [(900, None), (901, ""), (902, "the of " * 40_000), (None, "the of."), (3, rows[3][1])]
    labels += [(None, 1, 0), (901, None, 0), (3, labels[3][1], 0), (7777, 1, 0)]
    docs, known = documents(rows).withColumnRenamed("source", "predicted"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ranking = quality.fit(docs, known, language_id.fold("doc_id", 5) != 0)
    got = quality.scored(docs, ranking).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {k: q for k, q, _ in labels[:500]}
    import zlib

    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.97
    assert {r["doc_id"]: r["predicted"] for r in got}[902] == 1


def test_quality_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranking = quality.fit(documents([(1, "a b")]), none, F.lit(True))
    assert quality.scored(documents([(1, "a b")]), ranking).first()["predicted"] == 1
    assert quality.scored(documents([]), ranking).collect() == []


def test_bradley_terry_orders():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((400, 5))
    true = np.array([2.0, -1.0, 0.0, 0.5, 0.0])
    y = draw.random(400) < 1 / (1 + np.exp(-3 * x @ true))
    w = quality.bradley_terry(x, np.flatnonzero(y), np.flatnonzero(~y), 50_000, 0.1, 1e-4, 0)
    assert w @ true / math.sqrt(w @ w) / math.sqrt(true @ true) > 0.95
    assert quality.best_quantile(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 0, 1, 1]), np.ones(4)) == 2.5
