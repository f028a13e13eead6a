"""What several operators share: tables, words, stored intermediate frames."""

import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabia.session import settled as stored, shared_folder  # noqa: F401

# fixed values of the contracts
SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame) -> DataFrame:
    """The frame as compressed Parquet in the shared folder, for large tables; the folder's owner clears it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def whole(text) -> Column:
    """A text, where null counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def boxed(frame: DataFrame) -> DataFrame:
    """The columns of a table as one column ``row``, so that no name of theirs can clash."""
    return frame.select(F.struct("*").alias("row"))


def unboxed(frame: DataFrame, names, **replaced: Column) -> DataFrame:
    return frame.select(
        *(replaced[n].alias(n) if n in replaced else F.col(f"row.`{n}`").alias(n) for n in names)
    )


def slices(batch, column: str, limit: int):
    """An Arrow batch in runs of rows with about ``limit`` bytes of text, one row at least."""
    low, size = 0, 0
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    for k, n in enumerate(lengths):
        size += n
        if size >= limit or k == len(lengths) - 1:
            yield batch.slice(low, k + 1 - low)
            low, size = k + 1, 0
