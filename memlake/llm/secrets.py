"""Secret scans: pattern spans, and strings that a tokenizer can't shorten."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.bpe import ROWS, encoding
from memlake.llm.common import table, text_or_empty

# The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
#: A run of 24 or more is a whole run, since it may not begin inside one.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token")

#: What the token test looks at: whole runs of the characters that keys are made of.
LEAST = 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
#: Lengths of common digests in hexadecimal digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: What separates the pieces of a path, a host or a setting, and the letters of a piece that make one word of a name.
PIECE = re.compile(r"[^/.=]+")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Least characters a token of the words in an identifier, each counted in lower case and after a space.
WORD_RATIO = 2.3


def known(piece: str, n_tokens: Callable[[str], int]) -> bool:
    """Digests, UUIDs, numbers (with at most two letters), and identifiers: their words cost few tokens, in whatever case they are."""
    if len(piece) in DIGESTS and re.fullmatch(r"[0-9A-Fa-f]+", piece):
        return True
    if UUID.fullmatch(piece):
        return True
    words = WORD.findall(piece)
    letters = sum(map(len, words))
    if letters <= 2 and sum(map(str.isdigit, piece)) > 3 * letters:
        return True
    return letters > 0 and letters >= WORD_RATIO * sum(n_tokens(f" {word.lower()}") for word in words)


def random_parts(run: str, n_tokens: Callable[[str], int], ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that look random.

    Known pieces go from both ends of the run. What is left is one part if it costs too many tokens; if words in
    it hide that, each of its longest rows of unknown pieces is judged by itself.
    """

    def trimmed(first: int, last: int) -> tuple[int, int]:
        part = run[pieces[first][0] : pieces[last][1]]
        bare = part.strip("=.-/")
        start = pieces[first][0] + part.find(bare)
        return start, start + len(bare)

    def random(start: int, end: int) -> bool:
        part = run[start:end]
        return end - start >= LEAST and not known(part, n_tokens) and end - start < ratio * n_tokens(part)

    pieces = [m.span() for m in PIECE.finditer(run)]
    unknown = [k for k, (a, b) in enumerate(pieces) if not known(run[a:b], n_tokens)]
    if not unknown:
        return []
    if random(*trimmed(unknown[0], unknown[-1])):
        return [trimmed(unknown[0], unknown[-1])]
    every = set(unknown)
    begins = [k for k in unknown if k - 1 not in every]
    ends = [k for k in unknown if k + 1 not in every]
    return [part for part in (trimmed(a, b) for a, b in zip(begins, ends, strict=True)) if random(*part)]


def spans_of(text: str, n_tokens: Callable[[str], int], ratio: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans in order."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = list(found)
    for m in RUN.finditer(text):
        for a, b in random_parts(m[0], n_tokens, ratio):
            start, end = m.start() + a, m.start() + b
            if not any(s < end and start < e for s, _, e in base):
                found.append((start, 3, end))
    return sorted(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = 2.2, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Spans of every whole text: (id, spans array<struct<kind string, start int, end int>>), in code points.

    Besides the three patterns, the token test marks a run of 20 or more key characters, or its pieces between the
    words of a path, which has fewer than `ratio` characters a token under the rank file: words cost few tokens,
    random strings many, in one case or several. Known digests, UUIDs, numbers and identifiers (whose words,
    taken alone, cost few tokens) are left alone, and so is what overlaps a base span. A null text counts as
    empty; repeated rows give repeated results; an empty table gives an empty one; other columns are not read.
    """
    key = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks_path, pattern)
        count = lambda s: len(tokens.encode_ordinary(s))
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(text, count, ratio)] for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["id", "spans"])

    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, f"id {key}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with counts and digests of the base spans: see `find_secrets` for nulls and long texts."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        of(KINDS[3]).alias("n_token"),
    )
