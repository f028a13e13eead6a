"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. The lengths of its tokens give their byte spans,
these give character spans, and the spans are joined to the sections' intervals.
A token over a section's end belongs to one section by an explicit rule: that of
its first character (``first``) or of its last one (``last``). So the counts of
a document's sections always add up to the count of the document.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabia.llm.common import slices, table, whole

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's public splitting pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character (code points) of every token of the whole text."""
        ids = np.array(self.coder.encode_ordinary(text), np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.sizes[ids])
        if not len(ids):
            return ids, ids
        return character[ends - self.sizes[ids]], character[ends - 1]


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line's break belongs to it. A text has one line at least."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.r_[0, np.flatnonzero(points == 10) + 1]


def attributed(first, last, starts, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that reach into another section."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    own = a if rule == "first" else b
    n = len(starts)
    return np.bincount(own, minlength=n), np.bincount(own[a != b], minlength=n)


def section_counts(batches, ranks, rule):
    encoder = Encoder(ranks)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                first, last = encoder.spans(text)
                starts = line_sections(text)
                counts, crossing = attributed(first, last, starts, rule)
                n = len(starts)
                ends = np.r_[starts[1:], len(text)]
                for column, values in zip(columns, ([doc_id] * n, range(n), starts, ends, counts, crossing)):
                    column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)


NAMES = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def token_counts(docs: DataFrame, path: str = RANKS, rule: str = "first") -> DataFrame:
    """One row for each line of each document: its span in code points and its tokens.

    A null or empty text has one empty section without tokens. Repeated rows
    are counted each. The ranks file is read on the driver; its size is that of
    the vocabulary. Extra columns are not read.
    """
    if rule not in ("first", "last"):
        raise ValueError(f"unknown rule {rule!r}")
    ranks = read_ranks(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return rows.mapInArrow(lambda batches: section_counts(batches, ranks, rule), COUNTS)


def op1_token_attribution(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
