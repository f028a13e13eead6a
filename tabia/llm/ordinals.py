"""Gapless numbers of rows inside groups, without a task that sees a whole group."""

from pyspark.sql import DataFrame, Window, functions as F

from tabia.llm.common import written


def salted(rows: DataFrame) -> DataFrame:
    """The rows stored once with a unique ``salt``, the last key of their order.

    It only orders rows that are equal in all other keys, so which of them comes
    first makes no difference, and a row repeated without limit is cut over many
    ranges.
    """
    return written(rows.withColumn("salt", F.monotonically_increasing_id()))


def numbered(stored: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``stored`` with ``idx`` (0.. in the order of ``order``, nulls first) and ``size`` of its group.

    The rows are dealt by ranges of (group, order) and their range is stored, so
    a group of any size is numbered range by range; the ranges' counts, one row
    for each group in each range, give the offsets. ``stored`` is read twice, as
    ranges are sampled first; it should be a stored table.
    """
    ranged = written(
        stored.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id())
    )
    by_part = Window.partitionBy(group).orderBy("part")
    offsets = (
        ranged.groupBy(group, "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            group,
            "part",
            (F.sum("n").over(by_part) - F.col("n")).alias("start"),
            F.sum("n").over(Window.partitionBy(group)).alias("size"),
        )
    )
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    return (
        ranged.withColumn("place", place)
        .join(offsets, [group, "part"])
        .withColumn("idx", (F.col("start") + F.col("place")).cast("long"))
        .drop("part", "place", "start")
    )
