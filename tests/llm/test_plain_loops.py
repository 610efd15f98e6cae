"""Features of the classifiers against plain loops; tables whose columns have the operators' own names."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import bpe, compression_rules, exact_dedup, language_id, mixing, near_dedup, quality

TEXTS = ["", " ", "a", "Ab, ab. AB", "straße über  ÜBER\n\tx", "日本 日本語 12", "éte", "퟿", "the of and " * 30, "1234 !!", "ǅ İ ß"]


def buckets_by_hand(text):
    out, codes = Counter(), []
    for c in f" {text.lower()} ":
        c = c if c.isalpha() else " "
        if not (c == " " and codes and codes[-1] == 32):
            codes.append(ord(c))
    for start in range(len(codes)):
        h = 0
        for c in codes[start : start + language_id.ORDER]:
            h = (h ^ c) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            out[(h * 0x85EBCA6B % 2**32) >> 17] += 1
    return out


def test_grams_and_frequencies(spark):
    for text in TEXTS:
        at, counts = language_id.grams(text)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == buckets_by_hand(text), text
    having, of = language_id._frequencies(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    want = Counter(b for t in TEXTS for b in buckets_by_hand(t))
    assert of == len(TEXTS) and {b: n for b, n in enumerate(having.tolist()) if n} == want


def test_weights_of_a_text():
    idf = np.linspace(1, 3, language_id.BUCKETS)
    for text in TEXTS:
        at, x = language_id.weighed(*language_id.grams(text), idf)
        raw = {b: (1 + math.log(n)) * idf[b] for b, n in buckets_by_hand(text).items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        got = dict(zip(at.tolist(), x.tolist(), strict=True))
        assert got.pop(language_id.BUCKETS) == 1.0 and set(got) == set(raw)
        assert all(math.isclose(got[b], v / length) for b, v in raw.items())


def kind(c):
    if c == "\n":
        return 1
    if c in quality.MARKS:
        return 6 + quality.MARKS.index(c)
    if c.isspace():
        return 0
    if c.isalpha():
        return 2 if c.isupper() else 3
    return 4 if c.isnumeric() else 5


def test_quality_features():
    for text in TEXTS:
        runs = []
        for c in f"\n{text}\n":
            if not runs or runs[-1] != kind(c):
                runs.append(kind(c))
        three = Counter(zip(runs, runs[1:], runs[2:], strict=False))
        shares = {a * quality.CLASSES**2 + b * quality.CLASSES + c: math.sqrt(n / sum(three.values())) for (a, b, c), n in three.items()}
        raw, lines = text.encode(), text.split("\n")
        words = raw.split()
        rest = (math.log1p(len(text) + 2) / 10, len(zlib.compress(raw, 1)) / (len(raw) + 20), len(set(lines)) / len(lines), len(set(words)) / len(words) if words else 1.0, min(1.0, len(raw) / len(words) / 20) if words else 0.0, 0.0 if words else 1.0)
        shares |= {quality.CLASSES**3 + k: v for k, v in enumerate(rest) if v}
        at, x = quality.features(text)
        got = dict(zip(at.tolist(), x.tolist(), strict=True))
        assert set(got) == set(shares) and all(math.isclose(got[k], v) for k, v in shares.items()), text


def test_columns_with_the_operators_own_names(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    long = " ".join(draw.choices(words, k=200))
    rows = [(1, long, "a"), (2, long + " end", "a"), (3, "other text", "b"), (4, "other text", "b"), (None, None, None)]
    names = ("id", "ids", "decoded", "gone_id", "gone_hash", "_id", "_hash", "_row", "_sha", "keep_id", "text_sha256", "group_size", "row", "class", "size", "target", "copies", "kept", "ratio", "n_words")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    own = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    assert {r["doc_id"] for r in bpe.encode_documents(docs).collect()} == {1, 2, 3, 4, None}
    near = near_dedup.one_of_each_class(docs)
    exact = exact_dedup.without_duplicates(docs)
    mixed = mixing.mixed_documents(docs)
    assert near.columns == exact.columns == mixed.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 1, 3] and sorted(r["doc_id"] or 0 for r in exact.collect()) == [0, 1, 2, 4]
    assert all(r[c] == f"own {c}" for df in (near, exact, mixed) for r in df.collect() for c in own)
    assert len(compression_rules.judge(docs).collect()) == len(rows)
