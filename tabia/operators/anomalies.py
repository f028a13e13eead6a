"""Anomalies as a long table: keys, source, type, day, seq, description, reason, amount."""

from pyspark.sql import Column, DataFrame, functions as F

from tabia.functions.values import fixed
from tabia.operators.base import Base, debit_days, large_rows, listed_splits, split_facts
from tabia.operators.features import BUSY_DAY_ROWS, mean_debits
from tabia.schemas import KEY

ANOMALY_COLUMNS = (
    "source", "type", "txn_date", "seq", "description", "reason", "txn_description", "amount",
)


def large_debit_rows(source: DataFrame | Base, keys=KEY) -> DataFrame:
    """Debits above 3 x the customer's mean daily debit and above 1000."""
    if isinstance(source, Base):
        return source.large(lambda: mean_debits(source))
    days = debit_days(source, keys)
    return large_rows(source, split_facts(days, listed_splits(days, keys), keys), keys)


def large_debits(txn: DataFrame, source: str, currency: Column, keys=KEY) -> DataFrame:
    """The large debits of a table of transactions, which may carry the tenant's currency."""
    return large_debit_lines(large_debit_rows(txn, keys), source, currency, keys)


def large_debit_lines(rows: DataFrame, source: str, currency: Column, keys=KEY) -> DataFrame:
    return rows.select(
        *keys,
        F.lit(source).alias("source"),
        F.lit("Unusually Large Debit").alias("type"),
        "txn_date",
        "seq",
        F.concat(
            F.lit("Transaction of "),
            currency,
            F.lit(" "),
            fixed(F.col("amount"), 2),
            F.lit(" is significantly larger than typical spending."),
        ).alias("description"),
        F.lit(None).cast("string").alias("reason"),
        F.col("description").alias("txn_description"),
        F.col("amount").cast("double").alias("amount"),
    )


def busy_days(txn: DataFrame | Base, source: str, keys=KEY) -> DataFrame:
    """Days with more than 10 transactions."""
    if isinstance(txn, Base):
        per_day = txn.day_counts
    else:
        per_day = txn.groupBy(*keys, "txn_date").agg(F.count(F.lit(1)).alias("n"))
    day = F.date_format("txn_date", "yyyy-MM-dd")
    return per_day.where(F.col("n") > BUSY_DAY_ROWS).select(
        *keys,
        F.lit(source).alias("source"),
        F.lit("High Transaction Frequency").alias("type"),
        "txn_date",
        F.lit(None).cast("bigint").alias("seq"),
        F.concat(
            F.lit("Multiple small transactions detected on "),
            day,
            F.lit(", potentially indicating unusual activity."),
        ).alias("description"),
        F.concat(F.col("n").cast("string"), F.lit(" transactions on this day.")).alias("reason"),
        F.lit(None).cast("string").alias("txn_description"),
        F.lit(None).cast("double").alias("amount"),
    )


def _flag(condition: Column, kind: str, description: Column, reason: Column) -> Column:
    return F.when(
        condition,
        F.struct(F.lit(kind).alias("type"), description.alias("description"), reason.alias("reason")),
    )


def _exploded(features: DataFrame, source: str, flags: list[Column], keys=KEY) -> DataFrame:
    return features.select(
        *keys, F.explode(F.array_compact(F.array(*flags))).alias("hit")
    ).select(
        *keys,
        F.lit(source).alias("source"),
        "hit.type",
        F.lit(None).cast("date").alias("txn_date"),
        F.lit(None).cast("bigint").alias("seq"),
        "hit.description",
        "hit.reason",
        F.lit(None).cast("string").alias("txn_description"),
        F.lit(None).cast("double").alias("amount"),
    )


def _count(flags: list[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + F.when(flag.isNotNull(), 1).otherwise(0)
    return total


def bank_flags(currency: Column) -> list[Column]:
    """The customer-level bank checks as nullable structs."""
    c = F.col
    return [
        _flag(
            c("has_big_income") & (c("income_volatility") > 0.5),
            "Irregular Income Pattern",
            F.concat(
                F.lit("High income volatility detected (CV: "),
                fixed(c("income_volatility"), 2),
                F.lit(")"),
            ),
            F.lit("Income varies significantly month-to-month"),
        ),
        _flag(
            c("negative_days") > c("positive_days"),
            "Negative Cash Flow Pattern",
            F.lit("More days with negative cash flow than positive"),
            F.concat(
                F.lit("Negative days: "),
                c("negative_days").cast("string"),
                F.lit(", Positive days: "),
                c("positive_days").cast("string"),
            ),
        ),
        _flag(
            c("debt_service_ratio") > 0.4,
            "High Debt Service Ratio",
            F.concat(
                F.lit("Debt payments consume "),
                fixed(c("debt_service_ratio") * 100, 1),
                F.lit("% of total income"),
            ),
            F.lit("High debt burden may indicate financial stress"),
        ),
        _flag(
            c("has_balance") & (c("emergency_fund_months") < 1),
            "Low Emergency Fund",
            F.concat(
                F.lit("Average balance covers only "),
                fixed(c("emergency_fund_months"), 1),
                F.lit(" months of expenses"),
            ),
            F.lit("Insufficient emergency fund for financial security"),
        ),
        _flag(
            F.coalesce(c("min_raw_balance") < 0, F.lit(False)),
            "Overdraft Usage",
            F.concat(
                F.lit("Account went negative to "),
                currency,
                F.lit(" "),
                fixed(c("min_raw_balance"), 2),
            ),
            F.lit("Overdraft usage indicates potential cash flow issues"),
        ),
        _flag(
            c("max_day_rows") > 20,
            "High Transaction Activity",
            F.concat(
                F.lit("Unusually high number of transactions ("),
                c("max_day_rows").cast("string"),
                F.lit(") in a single day"),
            ),
            F.lit("May indicate automated trading or unusual account activity"),
        ),
    ]


def bank_anomalies(features: DataFrame, currency: Column) -> DataFrame:
    return _exploded(features, "bank", bank_flags(currency))


def bureau_flags() -> list[Column]:
    c = F.col
    return [
        _flag(
            c("crb_credit_history_length") < 12,
            "Credit History Length Warning",
            F.lit("Credit history is less than 1 year"),
            F.lit("Short credit history may impact scoring"),
        ),
        _flag(
            c("crb_late_payments") > 2,
            "High Late Payments",
            F.concat(
                c("crb_late_payments").cast("string"),
                F.lit(" late payments in recent credit history"),
            ),
            F.lit("Frequent late payments may lower credit score"),
        ),
        _flag(
            c("crb_credit_utilization") > 75,
            "High Credit Utilization",
            F.lit("Credit utilization exceeds 75%"),
            F.lit("High utilization may indicate high credit dependency"),
        ),
        _flag(
            c("crb_inquiries") > 5,
            "Frequent Credit Inquiries",
            F.concat(c("crb_inquiries").cast("string"), F.lit(" inquiries in recent months")),
            F.lit("Frequent inquiries may indicate credit-seeking behavior"),
        ),
    ]


def bureau_anomalies(features: DataFrame) -> DataFrame:
    return _exploded(features, "crb", bureau_flags())


def cross_flags() -> list[Column]:
    """Bureau record against the anomalies found so far (bank + bureau + mobile)."""
    both = (F.col("crb_present") == 1) & (F.col("available_sources") >= 2)
    performance, found = F.col("crb_payment_performance"), F.col("anomalies_so_far")
    kind = "CRB-Transaction Mismatch"
    return [
        _flag(
            both & (performance < 50) & (found == 0),
            kind,
            F.lit("Low CRB payment performance but no transaction anomalies detected"),
            F.lit("May indicate recent improvement in financial behavior or data inconsistency"),
        ),
        _flag(
            both & (performance > 80) & (found > 3),
            kind,
            F.lit("High CRB payment performance but multiple transaction anomalies detected"),
            F.lit("May indicate recent deterioration in financial behavior"),
        ),
    ]


def cross_anomalies(unified: DataFrame) -> DataFrame:
    return _exploded(unified, "cross", cross_flags())


def with_bank_count(features: DataFrame, txn: DataFrame | Base) -> DataFrame:
    """Bank features with ``bank_anomalies``: flags, busy days and large debits."""
    return _with_large_debits(
        features.withColumn("_flags", _count(bank_flags(F.lit("")))), txn, "bank_anomalies"
    )


def with_mobile_count(features: DataFrame, txn: DataFrame | Base) -> DataFrame:
    return _with_large_debits(features.withColumn("_flags", F.lit(0)), txn, "mobile_anomalies")


def with_base_count(features: DataFrame, txn: DataFrame | Base, keys=KEY) -> DataFrame:
    """Busy days and large debits only, as for a single statement job."""
    return _with_large_debits(features.withColumn("_flags", F.lit(0)), txn, "anomalies", keys)


def _with_large_debits(features: DataFrame, txn: DataFrame | Base, name: str, keys=KEY) -> DataFrame:
    # counted before the shuffle: a hot customer's rows are never one task
    counts = large_debit_rows(txn, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_large"))
    total = F.col("_flags") + F.col("busy_days") + F.coalesce("_large", F.lit(0))
    return (
        features.join(counts, list(keys), "left")
        .withColumn(name, total.cast("bigint"))
        .drop("_flags", "_large")
    )


def with_bureau_count(features: DataFrame) -> DataFrame:
    return features.withColumn("crb_anomalies", _count(bureau_flags()).cast("bigint"))


def with_cross_count(unified: DataFrame) -> DataFrame:
    """Unified features with anomalies so far and, cross-source rows added, in all."""
    zero = F.lit(0)
    so_far = (
        F.coalesce("bank_anomalies", zero)
        + F.coalesce("crb_anomalies", zero)
        + F.coalesce("mobile_anomalies", zero)
    )
    return unified.withColumn("anomalies_so_far", so_far).withColumn(
        "anomalies", F.col("anomalies_so_far") + _count(cross_flags())
    )
