"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import functools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, table
from memlake.llm.language_id import fold
from memlake.llm.sampling import labelled_sample

#: Classes of characters; sequences of three of them, runs counted once, are the main features.
MARKS = ".,!?;:|#*$%&\"'()-"
CLASSES = 6 + len(MARKS)
OTHER_FEATURES = 6
FEATURES = CLASSES**3 + OTHER_FEATURES


@functools.cache
def char_classes() -> np.ndarray:
    """By code point: 0 white space, 1 line feed, 2 upper case, 3 other letters, 4 numbers, 5 the rest, then one for each mark."""
    kinds = np.full(0x110000, 5, dtype=np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isspace():
            kinds[c] = 0
        elif s.isalpha():
            kinds[c] = 2 if s.isupper() else 3
        elif s.isnumeric():
            kinds[c] = 4
    kinds[10] = 1
    for k, mark in enumerate(MARKS):
        kinds[ord(mark)] = 6 + k
    return kinds


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: how its kinds of characters follow each other, and what it repeats."""
    text = text or ""
    codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = char_classes()[codes]
    runs = kinds[np.append(True, kinds[1:] != kinds[:-1])]
    shares = np.zeros(FEATURES)
    if len(runs) > 2:
        counts = np.bincount(runs[:-2] * CLASSES**2 + runs[1:-1] * CLASSES + runs[2:], minlength=CLASSES**3)
        shares[: CLASSES**3] = np.sqrt(counts / counts.sum())
    raw = text.encode("utf-8", "replace")
    lines = text.split("\n")
    words = raw.split()
    n = len(words)
    shares[CLASSES**3 :] = (
        math.log1p(len(codes)) / 10.0,
        len(zlib.compress(raw, 1)) / (len(raw) + 20.0),
        len(set(lines)) / len(lines),
        len(set(words)) / n if n else 1.0,
        min(1.0, len(raw) / n / 20.0) if n else 0.0,
        1.0 if n == 0 else 0.0,
    )
    at = np.flatnonzero(shares)
    return at, shares[at]


@dataclass
class Ranking:
    weights: np.ndarray
    cut: float
    scale: float
    pass_score: float

    def score(self, text: str | None) -> float:
        at, x = features(text)
        z = (float(x @ self.weights[at]) - self.cut) * self.scale + math.log(self.pass_score / (1.0 - self.pass_score))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, pairs: int, rate: float, l2: float, seed: int) -> np.ndarray:
    """Weights that rank the rows `better` above the rows `worse`: P(i over j) = sigmoid(w . (x_i - x_j))."""
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    draw = np.random.default_rng(seed)
    for _ in range(pairs // 256):
        d = x[draw.choice(better, 256)] - x[draw.choice(worse, 256)]
        g = l2 * w - d.T @ (1.0 / (1.0 + np.exp(np.clip(d @ w, -60, 60)))) / 256.0
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def best_quantile(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The score quantile whose cut errs least on the labelled rows: below it 0, from it on 1."""
    order = np.argsort(scores, kind="stable")
    s, y, v = scores[order], labels[order], weight[order]
    errors = np.concatenate([[0.0], np.cumsum(np.where(y == 1, v, 0.0))]) + np.concatenate([np.cumsum(np.where(y == 0, v, 0.0)[::-1])[::-1], [0.0]])
    best = int(np.argmin(errors))
    if best == 0:
        return float(s[0]) - 1e-9
    return float(s[-1]) + 1e-9 if best == len(s) else float(s[best - 1] + s[best]) / 2.0


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 3000, pairs: int = 200_000, rate: float = 0.1, l2: float = 1e-4, pass_score: float = 0.3, seed: int = 13) -> Ranking:
    """Learn from labelled rows (1 better, 0 worse) where `learn` holds; of several labels of a document the lower counts.

    The sample has at most 2 * per_label documents of each label and is fitted in one task. Pairs are drawn from it, a
    better and a worse document each. The cut is the score quantile with the fewest errors, rows weighing as
    their label does among all labelled rows; it becomes the score `pass_score`. Without rows of both labels every
    document scores alike, above the cut.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    sample, counts = labelled_sample(known, "label", per_label)
    if set(counts) != {0, 1}:
        return Ranking(np.zeros(FEATURES), -1.0, 1.0, pass_score)
    chosen = checkpoint(sample)  # at most 4 * per_label narrow rows, so they can be broadcast
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of documents that share an id, one

    def train(group: pa.Table) -> pa.Table:
        order = np.argsort(group["key"].to_numpy(), kind="stable")
        y = group["label"].to_numpy()[order]
        x = np.zeros((len(order), FEATURES), dtype=np.float32)
        for row, k in enumerate(order):
            at, values = features(group["text"][int(k)].as_py())
            x[row, at] = values
        used = np.flatnonzero(x.any(axis=0))
        better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        w = np.zeros(FEATURES)
        if len(better) and len(worse):
            w[used] = bradley_terry(x[:, used].astype(np.float64), better, worse, pairs, rate, l2, seed)
        s = x @ w
        weight = np.where(y == 1, counts[1] / max(1, len(better)), counts[0] / max(1, len(worse)))
        spread = float(np.median(np.abs(s - np.median(s)))) or 1.0
        return pa.table({"weights": [w.tobytes()], "cut": [best_quantile(s, y, weight)], "scale": [1.0 / spread]})

    row = rows.withColumns({"key": F.xxhash64("id", "text", F.lit(seed)), "all": F.lit(0)}).groupBy("all").applyInArrow(train, "weights binary, cut double, scale double").first()
    if row is None:
        return Ranking(np.zeros(FEATURES), -1.0, 1.0, pass_score)
    return Ranking(np.frombuffer(row["weights"]), row["cut"], row["scale"], pass_score)


def scored(docs: DataFrame, ranking: Ranking, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The documents with a quality score in (0, 1), and 1 if it passes, else 0.

    Only the whole text is looked at; a null text scores as an empty one. Columns of these names are replaced;
    all others, and repeated rows, stay as they are; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    @F.pandas_udf("double")
    def predict(texts):
        import pandas as pd

        return pd.Series([shared.value.score(text) for text in texts], dtype="float64")

    kept = [c for c in docs.columns if c not in (score, predicted)]
    said = docs.select(F.struct(*docs.columns).alias("_row"), predict(F.col(text_col)).alias("_score"))
    return said.select(*(F.col("_row")[c].alias(c) for c in kept), F.col("_score").alias(score), (F.col("_score") >= ranking.pass_score).cast("int").alias(predicted))


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from four folds of five: see `fit` and `scored`; null texts score as empty ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = fit(docs, labels, fold("doc_id", 5) != 0)
    return scored(docs.select("doc_id", "text"), ranking).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
