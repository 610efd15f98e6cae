"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import uniform


def labelled_sample(rows: DataFrame, label_col: str, per_label: int, max_labels: int = 4096, seed: int = 29) -> tuple[DataFrame, dict]:
    """About `per_label` different rows of each label (all, if there are fewer), drawn by a hash of the whole row, and all rows' counts by label.

    The labels are those of the rows that have one, at most max_labels of them (the most frequent, ties by label). Of each label at least the row with
    the least draw is taken, so a label whose rows are all alike is there as well; rows that are alike are one row of the sample, collapsed
    before they are exchanged. At most twice per_label rows for each label are returned. The rates, one a label, are broadcast: max_labels bounds them.
    """
    draw = uniform(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(seed))
    drawn = rows.where(F.col(label_col).isNotNull()).withColumn("_draw", draw)
    counted = drawn.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), F.min("_draw").alias("least"))
    labels = counted.orderBy(F.desc("n"), label_col).limit(max_labels).collect()
    if not labels:
        return rows.limit(0), {}
    kind = rows.schema[label_col].dataType.simpleString()
    rates = rows.sparkSession.createDataFrame([(r[label_col], max(per_label / r["n"], r["least"])) for r in labels], f"_label {kind}, _rate double")
    taken = drawn.join(F.broadcast(rates), F.col(label_col) == F.col("_label")).where("_draw <= _rate").select(*rows.columns).dropDuplicates()
    return taken.limit(2 * per_label * len(labels)), {r[label_col]: r["n"] for r in labels}
