"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import table
from memlake.llm.sampling import labelled_sample

#: Hash buckets of n-grams of 1 to ORDER characters; the bucket after the last is the constant.
BUCKETS, ORDER = 1 << 15, 3
#: Of eight documents of the sample, this many calibrate the temperature and aren't trained on.
CALIBRATE, OF = 1, 8
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams, ascending, and how often each occurs.

    The text is in lower case; what isn't a letter counts as one space, as do both ends.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    total = np.zeros(BUCKETS, dtype=np.int64)
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(ORDER):
        if len(codes) <= n:
            break
        h = (h[: len(codes) - n] ^ codes[n:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        total += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of unit length, with the constant as the last feature."""
    x = (1.0 + np.log(counts)) * idf[at]
    length = np.sqrt(x @ x)
    return np.append(at, BUCKETS), np.append(x / length if length else x, 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(examples: list, classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> np.ndarray:
    """Weights (features x classes) of softmax regression by FTRL-proximal steps with an elastic-net penalty.

    examples: (features, values, class). A weight whose summed gradient stays below l1 is exactly zero.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def shrunk(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in draw.permutation(len(examples)):
            at, x, label = examples[k]
            w = shrunk(z[at], n[at])
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    for start in range(0, len(z), 1024):  # in parts: with many classes these are the largest arrays
        z[start : start + 1024] = shrunk(z[start : start + 1024], n[start : start + 1024])
    return z


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which held-back labels are likeliest; 1 if there are none."""
    if not len(labels):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.02), np.log(20.0), 200))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, x = weighed(*grams(text), self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all these texts have each bucket, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):  # one at a time: a batch's texts as Python's would take several times its memory
                total[grams(text.as_py())[0]] += 1
                total[BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS + 1, dtype=np.int64)
    for row in rows:
        total[row["bucket"]] = row["n"]
    return total[:BUCKETS], int(total[BUCKETS])


def fit(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1000,
    max_languages: int = 1024,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
    epochs: int = 3,
    seed: int = 11,
) -> Model:
    """Learn from rows where `learn` holds and text and language are not null; nothing else of other rows is used.

    Document frequencies are of all those rows. The weights are fitted, in one task, on a sample of at most
    2 * per_language different documents of each language, of which the max_languages most frequent are learned: with 1,024 the task holds 0.6 GB of
    weights and sums, and the model that comes to the driver and is broadcast has 134 MB.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample, counts = labelled_sample(rows, "lang", per_language, max_languages)
    labels = sorted(counts)
    if not labels:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    having, of = _frequencies(rows.select("text"))
    idf = np.log((1.0 + of) / (1.0 + having)) + 1.0

    place = {label: k for k, label in enumerate(labels)}

    def train(group: pa.Table) -> pa.Table:
        order = np.argsort(group["key"].to_numpy(), kind="stable")
        langs, texts = group["lang"].to_pylist(), group["text"]
        examples = [(*weighed(*grams(texts[int(k)].as_py()), idf), place[langs[k]]) for k in order]
        held = [e for k, e in enumerate(examples) if k % OF < CALIBRATE]
        weights = follow_the_leader([e for k, e in enumerate(examples) if k % OF >= CALIBRATE], len(labels), alpha, beta, l1, l2, epochs, seed)
        logits = np.array([x @ weights[at] for at, x, _ in held]).reshape(len(held), len(labels))
        t = temperature(logits, np.array([label for *_, label in held], dtype=np.int64))
        return pa.table({"weights": [weights.astype(np.float32).tobytes()], "temperature": [t]})

    row = sample.withColumns({"key": F.xxhash64("id", "text", F.lit(seed)), "all": F.lit(0)}).groupBy("all").applyInArrow(train, "weights binary, temperature double").first()
    if row is None:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    weights = np.frombuffer(row["weights"], dtype=np.float32).reshape(BUCKETS + 1, len(labels))
    return Model(labels, idf, weights, row["temperature"])


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with the predicted language and its calibrated probability as two columns more.

    Only the whole text is looked at. A null text, and one without a letter, is `und` with score 0, and so is
    every text if nothing could be learned. Columns of these names are replaced; all others, and repeated rows, stay
    as they are; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{lang}: string, {score}: double>")
    def predict(texts: pa.Array) -> pa.Array:
        said = [shared.value.predict(text.as_py()) for text in texts]  # one at a time, as in `_frequencies`
        return pa.StructArray.from_arrays([pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], [lang, score])

    kept = [c for c in docs.columns if c not in (lang, score)]
    said = docs.select(F.struct(*docs.columns).alias("_row"), predict(F.col(text_col)).alias("_said"))
    return said.select(*(F.col("_row")[c].alias(c) for c in kept), F.col("_said")[lang].alias(lang), F.col("_said")[score].alias(score))


def fold(id_col: str, of: int) -> Column:
    """CRC-32 of the id as text, modulo `of`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0))


def op2_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from two folds of three: see `fit` and `identify`; a null id is in fold 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold("doc_id", 3) != 1)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
