"""Reproducible shuffle into shards: a keyed permutation of global row numbers.

Rows get global numbers 0..n-1, a Feistel network permutes the numbers, and
``shard = p % shards``, ``slot = p div shards``. Both are computable from the
number alone, shard sizes differ by one row at most, and slots have no gap.
Only DataFrame functions are used.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabia.llm.common import boxed, table, whole

SHARDS = 40
SEED = 20_240_607
ROUNDS = 6
WALK = 64
BUCKETS = 4096
COPY_BLOCK = 1 << 16


def numbered(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Columns ``row`` (all input columns), ``number`` (0..n-1) and ``total``.

    The order is that of (hash bucket, row values): it depends on the rows only,
    not on files or partitions. Equal rows are counted before the shuffle and
    numbered as one block, so a row repeated without limit is one row here; they
    are interchangeable. The offsets are one row for each bucket, which bounds
    the broadcast. Columns of map type are not orderable and are refused by Spark.
    """
    one = (
        boxed(rows)
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    )
    sizes = one.groupBy("bucket").agg(F.sum("copies").alias("n"))
    offsets = sizes.select(
        "bucket",
        (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    before = (
        Window.partitionBy("bucket")
        .orderBy("row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = one.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    return (
        placed.join(F.broadcast(offsets), "bucket")
        .withColumn("block", F.explode(F.expr(f"sequence(0L, copies - 1, {COPY_BLOCK}L)")))
        .withColumn(
            "copy",
            F.explode(F.expr(f"sequence(block, least(block + {COPY_BLOCK}L, copies) - 1)")),
        )
        .select("row", (F.col("start") + F.col("before") + F.col("copy")).alias("number"), "total")
    )


def permuted(number: Column, total: Column, seed: int = SEED) -> Column:
    """A bijection of 0..total-1: Feistel rounds over Z_a x Z_b with a*b >= total.

    a = ceil(sqrt(total)) and b = ceil(total / a), so fewer than a of the a*b
    values lie outside; those are walked on along their cycle until inside. The
    walk ends after WALK steps at most for total <= WALK**2; beyond that a longer
    walk has a chance below (1/WALK)**WALK, and it fails loudly instead of giving
    a wrong number.
    """
    a = F.ceil(F.sqrt(total)).cast("long")
    b = F.floor((total + a - 1) / a).cast("long")

    def mixed(x):
        def turn(state, i):
            left, right = state["left"], state["right"]
            even = i % 2 == 0
            return F.struct(
                F.when(even, (left + F.pmod(F.xxhash64(right, i, F.lit(seed)), a)) % a)
                .otherwise(left)
                .alias("left"),
                F.when(even, right)
                .otherwise((right + F.pmod(F.xxhash64(left, i, F.lit(seed)), b)) % b)
                .alias("right"),
            )

        start = F.struct(F.pmod(x, a).alias("left"), F.floor(x / a).cast("long").alias("right"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            start,
            turn,
            lambda s: s["right"] * a + s["left"],
        )

    first = mixed(number)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        first,
        lambda x, _: F.when(x < total, x).otherwise(mixed(x)),
    )
    return F.when(walked < total, walked).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long")
    )


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Columns ``row``, ``number``, ``shard`` (int) and ``slot`` (long), one row for each input row.

    Nulls and empty texts are values like any other; repeated rows each get a
    place of their own; an empty table gives an empty result; input columns stay
    inside ``row``, so their names can't clash.
    """
    places = numbered(rows).withColumn("p", permuted(F.col("number"), F.col("total"), seed))
    return places.select(
        "row",
        "number",
        (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {int(shards)}").alias("slot"),
    )


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes every shard as a folder ``shard=<n>`` in slot order."""
    (
        shard_rows(rows, shards, seed)
        .repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .mode("overwrite")
        .parquet(path)
    )


def op4_feistel_shards(spark, sf_dir):
    text = whole("text")
    digest = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_rows(digest).select(
        "row.*",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )
