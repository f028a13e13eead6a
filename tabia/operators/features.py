"""Customer features of the bank, mobile-money and bureau sources."""

from pyspark.sql import Column, DataFrame, functions as F

from tabia.functions.text import MOBILE_LOAN_WORDS, REMITTANCE_WORDS, contains_any, lowered
from tabia.functions.values import ratio
from tabia.operators import base
from tabia.operators.base import Base, days_of
from tabia.operators.ledger import customer_days, holds_cents, money_sum
from tabia.schemas import KEY

BASE_FEATURES = (
    "avg_monthly_income",
    "income_consistency",
    "total_spending",
    "spending_to_income_ratio",
    "loan_repayments",
    "avg_daily_balance",
    "min_balance",
    "max_balance",
    "savings_rate",
)
BANK_FEATURES = (
    "income_volatility",
    "overdraft_frequency",
    "debt_service_ratio",
    "emergency_fund_months",
    "cash_flow_variance",
)
BUREAU_FEATURES = (
    "crb_credit_history_length",
    "crb_payment_performance",
    "crb_credit_utilization",
    "crb_num_credit_types",
)
MOBILE_FEATURES = ("daily_spending_mean", "loan_repayment_ratio", "remittance_frequency")
CROSS_FEATURES = ("data_completeness_score", "spending_consistency", "risk_diversification_score")
# Fixed order of the model's feature vector.
FEATURE_VECTOR = (
    *BASE_FEATURES,
    *BUREAU_FEATURES,
    *MOBILE_FEATURES,
    *CROSS_FEATURES,
    *BANK_FEATURES,
)

BUSY_DAY_ROWS = 10


def _month_moments(prefix: str, total: Column, rows: Column, cents: bool) -> list[Column]:
    """Count, sum, population variance and first/last month of the months present."""
    present = F.col("month_head") & (rows > 0)
    value = F.coalesce(total, F.lit(0))
    return [
        F.count(F.when(present, 1)).alias(f"{prefix}_present"),
        F.sum(F.when(present, value)).alias(f"{prefix}_sum"),
        F.var_pop(F.when(present, money_sum(value, cents).cast("double"))).alias(f"{prefix}_var"),
        F.min(F.when(present, F.col("month"))).alias(f"{prefix}_from"),
        F.max(F.when(present, F.col("month"))).alias(f"{prefix}_to"),
    ]


def _span_stats(prefix: str) -> tuple[Column, Column]:
    """Mean and sample deviation over all months from first to last.

    Months without rows count as 0; they are added to the moments of the
    months present instead of being generated.
    """
    present = F.col(f"{prefix}_present")
    months = F.months_between(F.col(f"{prefix}_to"), F.col(f"{prefix}_from")).cast("int") + 1
    empty = months - present
    mean = ratio(F.col(f"{prefix}_sum"), months)
    mean_present = ratio(F.col(f"{prefix}_sum"), present)
    squares = (
        F.col(f"{prefix}_var") * present + mean_present * mean_present * present * empty / months
    )
    return mean, F.when(months > 1, F.sqrt(squares / (months - 1)))


def _exact_variance(prefix: str) -> Column:
    """Sample variance from count, sum and sum of squares of whole cents: exact up to one division at the end.

    Beyond 38 digits the floating value takes over.
    """
    n, total, squares = (F.col(f"{prefix}_{c}") for c in ("n", "cents", "squares"))
    top = F.try_subtract(F.try_multiply(n.cast("decimal(12,0)"), squares), F.try_multiply(total, total))
    bottom = (n * (n - 1) * 10000).cast("double")
    return F.when(n > 1, F.coalesce(top.cast("double") / bottom, F.col(f"{prefix}_variance")))


def customer_totals(source: DataFrame | Base, keys=KEY) -> DataFrame:
    """Everything the bank features, metrics and checks need, one row per customer; stored with a base."""
    if isinstance(source, Base):
        return source.stored("totals", lambda: _totals(source.daily(), keys))
    return _totals(days_of(source, keys), keys)


# Sums over rows, and values of one row.
MONEY_SUMS = (
    "credit", "debit", "savings", "loans", "debt", "balance", "flow", "income_sum", "big_sum",
    "run_sum", "run_min", "run_max",
)
MONEY_VALUES = ("balance_min", "balance_max", "first_balance", "first_net")


def _totals(day_rows: DataFrame, keys) -> DataFrame:
    days, in_cents = customer_days(day_rows, keys), holds_cents(day_rows)
    sums = ("n", "credit", "debit", "savings", "loans", "debt", "debt_n",
            "balance", "balance_n", "overdrawn_n", "flow")
    first, carried = F.col("nth") == 1, F.col("carried")
    zero = F.lit(0).cast("decimal(38,2)")
    cents = (F.col("flow") if in_cents else F.col("flow") * 100).cast("decimal(18,0)")
    before = carried.cast("decimal(19,0)") if in_cents else carried
    grouped = days.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("month_head")).alias("months"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
        F.count_if(F.col("n") > BUSY_DAY_ROWS).alias("busy_days"),
        F.max("n").alias("max_day_rows"),
        F.count_if(F.col("debit_rows") > 0).alias("debit_days"),
        F.count_if(F.col("flow") > 0).alias("positive_days"),
        F.count_if(F.col("flow") < 0).alias("negative_days"),
        F.count("flow").alias("flow_n"),
        F.sum(cents).alias("flow_cents"),
        F.sum(cents * cents).alias("flow_squares"),
        F.var_samp(money_sum(F.col("flow"), in_cents).cast("double")).alias("flow_variance"),
        *_month_moments("income", F.col("month_income"), F.col("month_income_n"), in_cents),
        *_month_moments("big", F.col("month_big"), F.col("month_big_n"), in_cents),
        F.min("balance_min").alias("balance_min"),
        F.max("balance_max").alias("balance_max"),
        F.sum(before * F.col("n") + F.col("run_sum")).alias("run_sum"),
        F.min(carried + F.col("run_min")).alias("run_min"),
        F.max(carried + F.col("run_max")).alias("run_max"),
        F.max(F.when(first, F.col("first_balance"))).alias("first_balance"),
        F.max(F.when(first, F.col("first_net"))).alias("first_net"),
    )
    if in_cents:
        grouped = grouped.withColumns(
            {
                **{c: money_sum(F.col(c), True) for c in MONEY_SUMS},
                **{c: money_sum(F.col(c), True).cast("decimal(18,2)") for c in MONEY_VALUES},
            }
        )
    return grouped.withColumns(
        {c: F.coalesce(c, zero) for c in ("credit", "debit", "savings", "loans", "debt")}
    )


def bank_features(source: DataFrame | Base, keys=KEY) -> DataFrame:
    """Features of the bank module plus the values its metrics and checks report."""
    t = customer_totals(source, keys)
    income_mean, income_dev = _span_stats("income")
    big_mean, big_dev = _span_stats("big")
    no_gaps = F.col("balance_n") == F.col("n")
    opening = F.coalesce(F.col("first_balance") - F.col("first_net"), F.lit(0).cast("decimal(18,2)"))
    inferred_sum = F.when(no_gaps, F.col("balance")).otherwise(
        F.col("run_sum") + opening * F.col("n")
    )
    avg_balance = ratio(F.col("balance"), F.col("balance_n"))
    expenses = ratio(F.col("debit"), F.col("months"))

    def or_zero(value):
        return F.coalesce(value, F.lit(0.0))

    return t.select(
        *keys,
        F.col("n").alias("transactions"),
        "first_date",
        "last_date",
        (F.col("income_present") > 0).alias("has_income"),
        or_zero(income_mean).alias("avg_monthly_income"),
        or_zero(
            F.when(income_mean > 0, 1 - ratio(income_dev, income_mean))
        ).alias("income_consistency"),
        F.col("debit").cast("double").alias("total_spending"),
        F.col("credit").cast("double").alias("total_credit"),
        or_zero(ratio(F.col("debit"), F.col("credit"))).alias("spending_to_income_ratio"),
        F.col("loans").cast("double").alias("loan_repayments"),
        ratio(inferred_sum, F.col("n")).alias("avg_daily_balance"),
        F.when(no_gaps, F.col("balance_min"))
        .otherwise(opening + F.col("run_min"))
        .cast("double")
        .alias("min_balance"),
        F.when(no_gaps, F.col("balance_max"))
        .otherwise(opening + F.col("run_max"))
        .cast("double")
        .alias("max_balance"),
        or_zero(ratio(F.col("savings"), F.col("credit"))).alias("savings_rate"),
        (F.col("big_present") > 0).alias("has_big_income"),
        big_mean.alias("income_mean"),
        big_dev.alias("income_std"),
        or_zero(F.when(big_mean > 0, ratio(big_dev, big_mean))).alias("income_volatility"),
        "days",
        "positive_days",
        "negative_days",
        ratio(F.col("positive_days"), F.col("days")).alias("cash_flow_ratio"),
        ratio(F.col("flow"), F.col("days")).alias("avg_daily_flow"),
        or_zero(_exact_variance("flow")).alias("cash_flow_variance"),
        F.col("debt").cast("double").alias("debt_payments"),
        F.col("debt_n").alias("debt_payment_count"),
        or_zero(F.when(F.col("credit") > 0, ratio(F.col("debt"), F.col("credit")))).alias(
            "debt_service_ratio"
        ),
        (F.col("balance_n") > 0).alias("has_balance"),
        avg_balance.alias("avg_raw_balance"),
        F.col("balance_min").cast("double").alias("min_raw_balance"),
        F.col("months").alias("expense_months"),
        or_zero(F.when(expenses > 0, ratio(avg_balance, expenses))).alias("emergency_fund_months"),
        F.col("overdrawn_n").alias("overdraft_rows"),
        or_zero(
            F.when(F.col("balance_n") > 0, ratio(F.col("overdrawn_n"), F.col("n")))
        ).alias("overdraft_frequency"),
        ratio(F.col("n"), F.col("days")).alias("avg_day_rows"),
        "max_day_rows",
        "busy_days",
    )


def mean_debits(source: Base) -> DataFrame:
    """(customer) with the debits and their daily mean; a bank's follow from the totals."""
    if not source.chained:
        return base.mean_debits(source.days, source.keys)
    mean = ratio(F.col("debit"), F.col("debit_days")).alias("avg_daily_debit")
    return customer_totals(source, source.keys).select(*source.keys, mean, "debit")


def spending_by_category(source: DataFrame | Base, keys=KEY) -> DataFrame:
    if isinstance(source, Base):
        return source.spending
    return source.groupBy(*keys, "category").agg(F.sum("debit_amount").alias("spending"))


def mobile_day_rows(txn: DataFrame, keys=KEY) -> DataFrame:
    """One row per (customer, day) with what the mobile features and checks need."""
    text = lowered(F.col("description"))
    is_debit = F.col("type") == "debit"
    return txn.groupBy(*keys, "txn_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("credit_amount").alias("credit"),
        F.sum(F.when(is_debit, F.col("amount"))).alias("debit"),
        F.count(F.when(is_debit, 1)).alias("debit_rows"),
        F.sum(F.when(contains_any(text, MOBILE_LOAN_WORDS), F.col("debit_amount"))).alias("loans"),
        F.count(F.when(contains_any(text, REMITTANCE_WORDS), 1)).alias("remittances"),
    )


def mobile_features(source: DataFrame | Base, keys=KEY) -> DataFrame:
    """Mobile-money features; the three definitions are this engine's own."""
    per_day = source.days if isinstance(source, Base) else mobile_day_rows(source, keys)
    totals = per_day.groupBy(*keys).agg(
        F.sum("n").alias("transactions"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
        F.sum("credit").alias("credit"),
        F.coalesce(F.sum("debit"), F.lit(0)).alias("debit"),
        F.count(F.when(F.col("debit_rows") > 0, 1)).alias("debit_days"),
        F.sum("loans").alias("loans"),
        F.sum("remittances").alias("remittance_frequency"),
        F.count(F.when(F.col("n") > BUSY_DAY_ROWS, 1)).alias("busy_days"),
    )
    return totals.select(
        *keys,
        "transactions",
        "first_date",
        "last_date",
        F.coalesce(ratio(F.col("debit"), F.col("debit_days")), F.lit(0.0)).alias(
            "daily_spending_mean"
        ),
        F.coalesce(
            F.when(F.col("credit") > 0, ratio(F.coalesce("loans", F.lit(0)), F.col("credit"))),
            F.lit(0.0),
        ).alias("loan_repayment_ratio"),
        "remittance_frequency",
        "busy_days",
    )


def bureau_features(records: DataFrame) -> DataFrame:
    """Direct bureau features and counts from valid records."""
    return records.select(
        *KEY,
        F.col("credit_history_months").alias("crb_credit_history_length"),
        F.col("payment_performance_score").alias("crb_payment_performance"),
        F.col("credit_utilization_ratio").alias("crb_credit_utilization"),
        F.coalesce(F.size("credit_types"), F.lit(0)).alias("crb_num_credit_types"),
        F.coalesce(F.size("accounts"), F.lit(0)).alias("crb_num_accounts"),
        F.col("recent_late_payments").alias("crb_late_payments"),
        F.col("credit_inquiries").alias("crb_inquiries"),
    )


def unified_features(
    bank: DataFrame, crb: DataFrame, mobile: DataFrame
) -> DataFrame:
    """Three sources per customer, any subset present, with the cross-source features.

    Features of an absent source stay NULL; ``feature_vector`` fills them.
    """
    b = bank.select(
        *KEY,
        *BASE_FEATURES,
        *BANK_FEATURES,
        F.col("transactions").alias("bank_transactions"),
        F.col("first_date").alias("bank_first_date"),
        F.col("last_date").alias("bank_last_date"),
        F.lit(1).alias("bank_present"),
        *[c for c in ("bank_anomalies",) if c in bank.columns],
    )
    c = crb.select(
        *KEY,
        *BUREAU_FEATURES,
        "crb_num_accounts",
        F.lit(1).alias("crb_present"),
        *[c for c in ("crb_anomalies",) if c in crb.columns],
    )
    m = mobile.select(
        *KEY,
        *MOBILE_FEATURES,
        F.col("transactions").alias("mobile_transactions"),
        F.col("first_date").alias("mobile_first_date"),
        F.col("last_date").alias("mobile_last_date"),
        F.lit(1).alias("mobile_present"),
        *[c for c in ("mobile_anomalies",) if c in mobile.columns],
    )
    joined = b.join(c, list(KEY), "full_outer").join(m, list(KEY), "full_outer")
    flags = ("bank_present", "crb_present", "mobile_present")
    joined = joined.withColumns({f: F.coalesce(f, F.lit(0)) for f in flags})
    available = F.col("bank_present") + F.col("crb_present") + F.col("mobile_present")
    monthly = F.col("daily_spending_mean") * 30
    spending = F.col("total_spending")
    return joined.withColumns(
        {
            "available_sources": available,
            "data_completeness_score": ratio(available, F.lit(3)),
            "spending_consistency": F.when(
                (spending > 0) & (monthly > 0),
                1 - F.abs(spending - monthly) / F.greatest(spending, monthly),
            ),
            "risk_diversification_score": F.when(
                available >= 2, F.least(F.lit(1.0), ratio(available, F.lit(3)))
            ),
        }
    )


def feature_vector(unified: DataFrame) -> DataFrame:
    """The 24 features in fixed order, missing values as 0."""
    return unified.select(
        *KEY,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_VECTOR],
    )
