"""Line deduplication over levelled sorted runs of line hashes.

An index maps the hash of a line's key to the first document that holds it. It
is kept as runs, each partitioned and sorted by hash. A new batch of documents
is reduced to its distinct hashes, loses those that any run knows (a sort-merge
anti join with each run) and becomes a run of its own. When a level has
``fanout`` runs they are merged into one of the next level, so n batches leave
O(log n) runs.
"""

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabia.llm.common import LOWER, SPACE, UPPER, ascii_lower, boxed, stored, table, unboxed, whole

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def held_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (doc_id, h) of the lines that count; h is the MD5 of the key."""
    line = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id"), F.explode(F.split(whole("text"), "\n", -1)).alias("line")
    )
    key = line.select("doc_id", line_key(F.col("line")).alias("key"))
    return (
        key.where(F.char_length("key") >= min_chars)
        .select("doc_id", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))
        .distinct()
    )


class LineRuns:
    """The index: runs of (h, first), each hash in one run only."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, held: DataFrame) -> None:
        """Takes a batch in; documents of later batches must have larger ids."""
        fresh = held.groupBy("h").agg(F.min("doc_id").alias("first"))
        for run in self.runs():
            fresh = fresh.join(run.select("h").hint("merge"), "h", "left_anti")
        self._put(0, stored(fresh.sortWithinPartitions("h")))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def index(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs())

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._put(level + 1, stored(merged.repartition("h").sortWithinPartitions("h")))


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Rising upper bounds of doc_id for all batches but the last. Any bounds give the same result."""
    cuts = [i / batches for i in range(1, batches)]
    if not cuts:
        return []
    found = docs.agg(F.percentile_approx("doc_id", cuts, 1000).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


KEPT = StructType([StructField("text", StringType()), StructField("n_dropped", LongType())])


@F.pandas_udf(KEPT)
def without_lines(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    kept, counts = [], []
    for value, gone in zip(text, dropped):
        if gone is None:
            kept.append(value)
            counts.append(0)
            continue
        gone = {bytes(h) for h in gone}
        lines = value.split("\n")
        stay = [
            x
            for x in lines
            if hashlib.md5(x.strip(SPACE).translate(_FOLD).encode()).digest() not in gone
        ]
        kept.append("\n".join(stay))
        counts.append(len(lines) - len(stay))
    return pd.DataFrame({"text": kept, "n_dropped": counts})


def line_deduplicated(
    docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Columns ``row`` (the input), ``kept_text``, ``n_lines`` and ``n_dropped``.

    A null or empty text is one empty line and stays. Repeated rows of one
    doc_id are the same document and keep the same lines. A row without doc_id
    is compared with nothing and keeps every line. Lines are compared as MD5 of
    their keys. A line held by a third of all documents is a skewed join key of
    narrow rows against one row of the index, which Spark's skew join splits.
    """
    held = stored(held_lines(docs.select("doc_id", "text"), min_chars))
    bounds = batch_bounds(held, batches)
    runs = LineRuns(fanout)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = held
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(part)
    gone = (
        held.join(runs.index().hint("merge"), "h")
        .where(F.col("doc_id") != F.col("first"))
        .groupBy(F.col("doc_id").alias("gone_id"))
        .agg(F.collect_list("h").alias("gone"))
    )
    text = whole("row.text")
    return (
        boxed(docs)
        .join(gone, F.col("row.doc_id") == F.col("gone_id"), "left")
        .withColumn("kept", without_lines(text, F.col("gone")))
        .select(
            "row",
            F.col("kept.text").alias("kept_text"),
            F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
            F.col("kept.n_dropped").alias("n_dropped"),
        )
    )


def with_lines_removed(docs: DataFrame) -> DataFrame:
    """The documents with their columns and the remaining lines; a null text stays null."""
    rows = line_deduplicated(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    return unboxed(rows, docs.columns, text=text)


def op10_line_runs(spark, sf_dir):
    rows = line_deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.owner <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN owners o ON o.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
