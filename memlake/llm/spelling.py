"""Spelling variants of a corpus's words, found in bidirectional FM-indexes over parts of the vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, shuffle_partitions, table
from memlake.llm.exact_dedup import LOWER, UPPER
from memlake.llm.fm_index import TwoWayIndex
from memlake.operators.shared import small, stored

#: A run of letters of ASCII and Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
#: One run of so many, by a hash of document and run, loses a character.
DROP_ONE_OF = 199
#: Words of one index, as planned; words that share half of their characters, beyond which their group is split in blocks.
CELL, BLOCK = 1 << 16, 1 << 18


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the words of at least `least_length` characters that occur at least `least_count` times in all whole texts.

    A word is a maximal run of letters (ASCII and U+00C0 to U+00FF), A-Z in lower case, from which one run in 199 loses a character: h is
    the CRC-32 of `<id>:<run>`, and if 199 divides h, the character at h modulo the length goes. A null text has none; a null id is the
    word null. Repeated rows count as often as they are there. Counted in tasks before anything is exchanged, so no word is a hot key.
    """
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)  # a shorter one doesn't get longer
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % DROP_ONE_OF == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def routed(words: DataFrame, least_length: int) -> DataFrame:
    """(word, n, exact, longer, kind, key): each word where its near words are.

    Of two words that are one edit apart, m characters long the shorter, either the first m // 2 characters are the same or the last
    m - m // 2 are. So a word goes to the groups of its beginning and of its end (kind 0 and 1), as the shorter of a pair (or of equal length) and as the longer.
    """

    def groups(m, longer: bool) -> list:
        half, rest = F.floor(m / 2).cast("int"), (m - F.floor(m / 2)).cast("int")
        end = F.substring("word", F.length("word") - rest + 1, rest)
        return [F.struct(F.lit(kind).alias("kind"), n.alias("exact"), F.lit(longer).alias("longer"), F.concat(m.cast("string"), F.lit(":"), part).alias("key")) for kind, n, part in ((0, half, F.substring("word", F.lit(1), half)), (1, rest, end))]

    own = F.array(*groups(F.length("word"), False))
    both = F.array(*groups(F.length("word"), False), *groups(F.length("word") - 1, True))
    rows = words.select("word", "n", F.explode(F.when(F.length("word") > least_length, both).otherwise(own)).alias("g"))
    return rows.select("word", "n", "g.*")


def near_words(words: DataFrame, least_length: int = 6, cell_words: int = CELL, block_words: int = BLOCK) -> DataFrame:
    """(word, n_near, best): of each word with near words, their number and (minus n, word) of the one with the largest n, ties by code points.

    words: (word, n), each word once, of at least `least_length` characters. Groups of words (see `routed`) are packed into cells, and each
    cell's task builds a bidirectional FM-index over its delimited words and asks it for all of them (see `fm_index`). A group of more
    than `block_words` words is split: a task has two of its blocks and keeps what lies across them. A pair counts where it is first
    found: by its beginning, or by its end if the beginnings differ. Tasks return one row a word, no pairs.
    """
    rows = checkpoint(routed(words, least_length))
    cells = max(shuffle_partitions(words.sparkSession), rows.count() // cell_words)
    crowded = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block_words)
    crowded = checkpoint(crowded.select("kind", "key", F.ceil(F.col("m") / block_words).cast("int").alias("blocks")))
    if crowded.isEmpty():
        rows = rows.withColumn("blocks", F.lit(1))
    else:
        rows = rows.join(small(crowded), ["kind", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    cell = F.when(F.col("blocks") > 1, F.concat(F.lit("key "), "key")).otherwise(F.concat(F.lit("cell "), F.pmod(F.xxhash64("key"), F.lit(cells)).cast("string")))
    rows = rows.withColumn("cell", cell).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def search(group: pa.Table) -> pa.Table:
        kind, across = group["kind"][0].as_py(), group["low"][0].as_py() != group["high"][0].as_py()
        spelled = group["word"].to_pylist()
        words = sorted(set(spelled))
        at = {w: k for k, w in enumerate(words)}
        number = np.array([at[w] for w in spelled])
        weight, block = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int32)
        weight[number], block[number] = group["n"].to_numpy(), group["block"].to_numpy()
        exact, longer = group["exact"].to_numpy(), group["longer"].to_numpy()
        near, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1)
        for row, found in TwoWayIndex(words).one_edit(number, exact, longer, kind == 0):
            asked = number[row]
            if across:
                apart = block[asked] != block[found]
                row, asked, found = row[apart], asked[apart], found[apart]
            if kind == 1:  # the halves before the ends must differ
                half = np.array([len(words[w]) for w in asked], dtype=np.int64) - longer[row] - exact[row]
                new = np.array([words[a][:k] != words[b][:k] for a, b, k in zip(asked, found, half, strict=True)], dtype=bool)
                asked, found = asked[new], found[new]
            np.add.at(near, asked, 1)
            for a, b in zip(asked.tolist(), found.tolist(), strict=True):
                if best[a] < 0 or (-weight[b], b) < (-weight[best[a]], best[a]):
                    best[a] = b
        has = np.flatnonzero(near)
        named = lambda at: pa.array([words[k] for k in at], pa.string())
        return pa.table({"word": named(has), "near": near[has], "less": -weight[best[has]], "best": named(best[has])})

    found = rows.groupBy("kind", "cell", "low", "high").applyInArrow(search, "word string, near long, less long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", F.col("best").alias("form"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last of each word's chain of forms. Chains double each round; counts grow along them, so they end."""
    move = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = small(move.select(F.col("word").alias("root"), F.col("root").alias("next")))
        moved = move.join(ahead, "root", "left")
        if moved.where("next is not null").isEmpty():
            return move
        move = stored(moved.select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, factor: int = 5, cell_words: int = CELL, block_words: int = BLOCK) -> DataFrame:
    """The words of a corpus with what they are variants of: (word, root, form, n, n_near, form_n).

    Words and their counts n: see `vocabulary`, for nulls and repeated rows as well. Two words are near if they differ by exactly one
    inserted, deleted or replaced code point; n_near is how many are. A word's form is its near word of largest n (ties: the smallest by code
    points) if that is at least `factor` times the word's own n, else null; form_n is the form's n. root is the last word that forms
    lead to, or the word itself. An empty table, or one without such words, gives an empty result; columns besides the two are not read.
    """
    words = checkpoint(vocabulary(docs, id_col, text_col, least_length, least_count))
    near = near_words(words, least_length, cell_words, block_words)
    is_form = -F.col("best.less") >= factor * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    known = checkpoint(known)
    last = small(roots(known.where("form is not null")))
    return known.join(last, "word", "left").select("word", F.coalesce("root", "word").alias("root"), "form", "n", "n_near", "form_n")


def op12_fm_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and their forms: see `spelling_variants` for nulls, ties and empty tables."""
    return spelling_variants(table(spark, sf_dir, "documents"))
