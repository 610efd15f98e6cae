"""Samples of labelled rows: many labels, repeated rows, no ids."""

import random

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import language_id
from memlake.llm.sampling import labelled_sample


def test_thousands_of_labels(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 4096).cast("string").alias("lang"))
    sample, counts = labelled_sample(rows, "lang", 2)
    got = sample.collect()
    assert len(counts) == 4096 and sum(counts.values()) == 20_000
    assert len({r["lang"] for r in got}) == 4096 and 6000 < len(got) < 11_000


def test_rows_that_are_alike_are_one(spark):
    rows = spark.createDataFrame([(None, "the same text", "en")] * 5000 + [(None, f"text {k}", "de") for k in range(3000)] + [(None, "x", None)], "id long, text string, lang string")
    sample, counts = labelled_sample(rows, "lang", 100)
    got = [tuple(r) for r in sample.collect()]
    assert counts == {"en": 5000, "de": 3000} and len(set(got)) == len(got)
    assert sum(r[2] == "en" for r in got) == 1 and 60 < sum(r[2] == "de" for r in got) < 150


def test_many_languages_are_learned_and_ids_are_not_needed(documents):
    draw = random.Random(3)
    words = {f"l{k}": ["".join(draw.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(6)] for k in range(700)}
    docs = documents([(None, " ".join(draw.choices(words[lang], k=12)), lang) for lang in words for _ in range(3)])
    model = language_id.fit(docs, F.lit(True), epochs=2)
    assert len(model.labels) == 700
    said = language_id.identify(docs, model).select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in said]) > 0.9
