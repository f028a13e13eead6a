"""Transaction and bureau ingest: read, validate, clean, scope, split requests."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tabia.functions.values import parse_date
from tabia.schemas import KEY, TRANSACTION_LIST, TRANSACTION_TABLE, UNIFIED_REQUEST
from tabia.session import written


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Flat transaction table with company_id, customer_id and seq."""
    return spark.read.format(fmt).schema(TRANSACTION_TABLE).options(**options).load(path)


def read_transaction_lists(spark: SparkSession, path: str, fmt: str = "json", order: str | None = None) -> DataFrame:
    """Documents with a customer's transactions, several to a customer or one; ``seq`` counts on over them."""
    schema = TRANSACTION_LIST if order is None else T.StructType([*TRANSACTION_LIST.fields, T.StructField(order, T.StringType())])
    return explode_transactions(spark.read.format(fmt).schema(schema).load(path), "transactions", order)


def explode_transactions(requests: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Rows of the lists; ``seq`` is gapless and unique in a customer, also over several lists.

    A customer's lists follow each other in the rising order of ``order``, or of
    the hash of the list where there is no such column; equal lists are
    interchangeable. A list starts where the lengths of the earlier ones end, so
    the running sum sees one narrow row for each list, and the lists themselves
    are never dealt by customer. A null list has no rows.
    """
    place = F.col(order) if order else F.xxhash64(column)
    stored = written(
        requests.select(*KEY, place.alias("_order"), F.col(column).alias("_list")).withColumn(
            "_request", F.monotonically_increasing_id()
        )
    )
    earlier = Window.partitionBy(*KEY).orderBy("_order", "_request").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.select(
        "_request", F.coalesce(F.sum(F.greatest(F.size("_list"), F.lit(0))).over(earlier), F.lit(0)).alias("_start")
    )
    return (
        stored.join(starts, "_request")
        .select(*KEY, "_start", F.posexplode("_list").alias("pos", "txn"))
        .select(*KEY, (F.col("_start") + F.col("pos")).cast("bigint").alias("seq"), "txn.*")
    )


def read_unified_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.format(fmt).schema(UNIFIED_REQUEST).load(path)


def split_unified(requests: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """The three source tables of unified requests; presence of rows decides."""
    return {
        "bank": explode_transactions(requests, "bank_transactions", order),
        "mobile": explode_transactions(requests, "mobile_money_transactions", order),
        "crb": requests.where(F.col("crb_data").isNotNull()).select(*KEY, "crb_data.*"),
    }


def has_ids() -> Column:
    """Both ids are there and not blank."""
    there = F.lit(True)
    for name in KEY:
        text = F.trim(F.col(name).cast("string"))
        there = there & text.isNotNull() & (text != "")
    return there


def scoped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with both ids, rows without)."""
    return rows.where(has_ids()), rows.where(~has_ids())


REQUIRED = ("date", "description", "amount", "type")


def has_required() -> Column:
    """Date, description, amount and type are there; an unreadable date is another matter (``dated``)."""
    there = F.lit(True)
    for name in REQUIRED:
        there = there & F.col(name).isNotNull()
    return there


def complete(txn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with all required fields, rows without)."""
    return txn.where(has_required()), txn.where(~has_required())


def dated(txn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a calendar date in ``txn_date``, rows whose date is unparsable)."""
    parsed = txn.withColumn("txn_date", parse_date(F.col("date")))
    return (
        parsed.where(F.col("txn_date").isNotNull()),
        parsed.where(F.col("txn_date").isNull()),
    )


def bureau_defaults(records: DataFrame) -> DataFrame:
    """Optional bureau fields filled with their defaults."""
    return records.withColumns(
        {
            "recent_late_payments": F.coalesce("recent_late_payments", F.lit(0)),
            "credit_inquiries": F.coalesce("credit_inquiries", F.lit(0)),
        }
    )


def valid_bureau() -> Column:
    """Required fields present and all fields in range."""
    return F.coalesce(
        F.col("credit_history_months").isNotNull()
        & F.col("payment_performance_score").between(0, 100)
        & F.col("credit_utilization_ratio").between(0, 100)
        & (F.col("recent_late_payments") >= 0)
        & (F.col("credit_inquiries") >= 0),
        F.lit(False),
    )


def read_crb(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) bureau records after defaults."""
    filled = bureau_defaults(records)
    return filled.where(valid_bureau()), filled.where(~valid_bureau())


def latest_crb(records: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one record of each customer, the others with a ``reason``), so that nobody has two scores.

    The record that is last in ``order`` stays, a time or a version; of equal
    ones, and where there is no such column, the one with the largest hash of its
    values. A valid record goes before one that is out of range. One row of each
    customer is found by a map-side maximum; equal records count as one.
    """
    values = [F.to_json(F.struct(*[c for c in records.columns if c not in KEY]))]
    by = F.struct(
        valid_bureau().alias("valid"),
        (F.col(order) if order else F.lit(0)).alias("order"),
        F.xxhash64(*values).alias("hash"),
    )
    ranked = bureau_defaults(records).withColumn("_by", by)
    last = ranked.groupBy(*KEY).agg(F.max("_by").alias("_last"))
    both = ranked.join(last, list(KEY))
    kept = both.where(F.col("_by") == F.col("_last")).dropDuplicates([*KEY])
    others = both.where(F.col("_by") != F.col("_last"))
    reason = F.lit("another record of the customer is kept").alias("reason")
    return kept.drop("_by", "_last"), others.drop("_by", "_last").select("*", reason)


def one_crb(records: DataFrame, order: str | None = None) -> DataFrame:
    """The record of each customer that ``latest_crb`` keeps, in one pass and without a join."""
    values = [c for c in records.columns if c not in KEY]
    place = F.col(order) if order else F.lit(0)
    by = F.struct(valid_bureau(), place, F.xxhash64(F.to_json(F.struct(*values))))
    return (
        bureau_defaults(records)
        .groupBy(*KEY)
        .agg(F.max_by(F.struct(*values), by).alias("_record"))
        .select(*KEY, "_record.*")
    )
