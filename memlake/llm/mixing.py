"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.llm.common import WORD, checkpoint, table, text_or_empty, uniform

#: Most sources whose rates are broadcast to the documents; with more, the documents are shuffled by source.
BROADCAST_SOURCES = 50_000
#: Seeds that a source may draw with: the seed k turns all draws of one digest by k golden-ratio steps.
TURNS, STEP = 64, 0.6180339887498949


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words that each source is to give: columns source, source_size, target.

    sizes has the columns source and size. Sources in code-point order, the null source last, weigh
    `weights` over and over. They share `budget` times all words; no source gives over `cap` times its
    own, and what it can't give goes to the others by weight. That level is found in closed form: in
    the order of cap over weight, a source is at its cap if the level that the sources from it on would
    share is at least its own. A source without words has the target 0. The windows here run over one row
    for each source, never over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(named) - 1) % len(weights) + 1)
    weighed = per_source.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    rising = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levelled = (
        weighed.withColumn("all_words", F.lit(float(budget)) * F.sum("source_size").over(every))
        .withColumn("before", F.coalesce(F.sum("most").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_on", F.sum("weight").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("full", F.col("most") * F.col("weight_on") <= (F.col("all_words") - F.col("before")) * F.col("weight"))
    )
    given = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    level = (F.col("all_words") - given) / open_weight
    return levelled.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _turned(draw: Column, turn: Column) -> Column:
    """The draw of a document under another seed: still uniform in [0, 1), and by the digest of its id alone."""
    moved = draw + turn * F.lit(STEP)
    return moved - F.floor(moved)


def source_rates(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """(source, source_size, target, rate, turn) from the columns source, size and draw of each document.

    turn is the seed, of TURNS fixed ones, whose Bernoulli copies bring the source's words nearest its target (of
    equally near ones the first). The draws of all seeds come from one number for each document; over a whole
    turn the words taken are right on the average, so some seed lies within about one document of the target.
    """
    rated = source_targets(sizes, weights, budget, cap).withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    rated = checkpoint(rated.select(F.struct("source").alias("of"), "source_size", "target", "rate"))  # a row for each source
    few = rated.count() <= BROADCAST_SOURCES
    rates = F.broadcast(rated) if few else rated
    fraction = F.col("rate") - F.floor("rate")
    tried = sizes.select(F.struct("source").alias("of_row"), "size", "draw").join(rates, F.col("of_row").eqNullSafe(F.col("of")))
    tried = tried.select("of", "size", "draw", fraction.alias("fraction"), F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"))
    extra = F.sum(F.when(_turned(F.col("draw"), F.col("turn")) < F.col("fraction"), F.col("size")).otherwise(0)).alias("extra")
    sums = tried.groupBy("of", "turn").agg(extra).withColumnRenamed("of", "summed")
    off = F.abs(F.floor("rate") * F.col("source_size") + F.col("extra") - F.col("target"))
    nearest = sums.join(rates, F.col("summed").eqNullSafe(F.col("of"))).groupBy("summed").agg(F.min(F.struct(off.alias("off"), "turn"))["turn"].alias("turn"))
    chosen = nearest.join(rates, F.col("summed").eqNullSafe(F.col("of"))).select("of", "source_size", "target", "rate", "turn")
    chosen = checkpoint(chosen)
    return F.broadcast(chosen) if few else chosen


def _copies() -> Column:
    rate = F.col("rate")
    return F.floor(rate) + (_turned(F.col("draw"), F.col("turn")) < rate - F.floor(rate)).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document: one row (id, size, source_size, target, copies) a document.

    The rate of a source is its target over its words. A document is taken floor(rate) times, and once more
    if a number seeded by its id is below the rate's fraction, so reruns agree whatever the partitions. See
    `source_rates` for the seed. Null texts have size 0, null ids draw as the word null, a null source is a source,
    rows that repeat an id draw alike, an empty table gives an empty result; other columns are not read. A source
    whose words are nearly all in one document can't come nearer its target than that document allows.
    """
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), uniform(id_col, F.lit(seed)).alias("draw"))
    sizes = checkpoint(sizes)  # narrow columns, so that texts are counted once
    rates = source_rates(sizes, weights, budget, cap)
    mixed = sizes.join(rates, F.struct("source").eqNullSafe(F.col("of")))
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", _copies().alias("copies"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The mixed corpus: every document as often as `mix` takes it, with its own columns and no others.

    The rates come from all rows, so each source's words come near its target in the rows that are returned.
    """
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    draw = uniform(id_col, F.lit(seed))
    rates = source_rates(checkpoint(docs.select(F.col(source_col).alias("source"), size.alias("size"), draw.alias("draw"))), weights, budget, cap)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.struct(F.col(source_col).alias("source")).alias("_from"), draw.alias("draw"))
    mixed = whole.join(rates, F.col("_from").eqNullSafe(F.col("of")))
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(True), _copies().cast("int")))).select("_row.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of all documents: see `mix` for nulls, ties and empty sources."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = {
    "op6_source_mix": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS DOUBLE) AS weight, CAST(2.0 AS DOUBLE) * source_size AS most FROM per_source),
levelled AS (
  SELECT *, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) AS all_words,
    coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given_before,
    sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM weighed),
marked AS (SELECT *, most * weight_on <= (all_words - given_before) * weight AS is_full FROM levelled),
levels AS (
  SELECT *, (all_words - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () AS water FROM marked),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE water * weight END AS target FROM levels),
rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
    CAST(CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turned AS (SELECT *, u + turn * CAST(0.6180339887498949 AS DOUBLE) AS moved FROM rated, (SELECT unnest(range(64)) AS turn)),
drawn AS (SELECT *, CASE WHEN moved - floor(moved) < rate - floor(rate) THEN 1 ELSE 0 END AS more FROM turned),
tried AS (SELECT source, turn, abs(floor(any_value(rate)) * any_value(source_size) + CAST(sum(size * more) AS BIGINT) - any_value(target)) AS off FROM drawn GROUP BY source, turn),
chosen AS (SELECT source, arg_min(turn, (off, turn)) AS turn FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + more) AS BIGINT) AS taken FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.turn = c.turn
""",
}
