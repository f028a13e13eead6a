"""Key metrics as a long table: keys, section, name, item, value, unit, description.

``section`` tells apart metrics of equal name; ``item`` is the category of the
one metric that has a value per category.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tabia.operators.base import Base
from tabia.operators.features import spending_by_category
from tabia.schemas import KEY

METRIC_COLUMNS = ("section", "position", "name", "item", "value", "unit", "description")


def _metric(position: int, name: str, value: Column, unit: Column | None, text, present=None) -> Column:
    entry = F.struct(
        F.lit(position).alias("position"),
        F.lit(name).alias("name"),
        F.lit(None).cast("string").alias("item"),
        value.cast("double").alias("value"),
        (F.lit(None).cast("string") if unit is None else unit).alias("unit"),
        (text if isinstance(text, Column) else F.lit(text)).alias("description"),
    )
    return entry if present is None else F.when(present, entry)


def _long(rows: DataFrame, section: str, metrics: list[Column], keys=KEY) -> DataFrame:
    return rows.select(
        *keys, F.explode(F.array_compact(F.array(*metrics))).alias("metric")
    ).select(*keys, F.lit(section).alias("section"), "metric.*")


def _rounded(name: str, places: int) -> Column:
    return F.round(F.col(name).cast("double"), places)


def base_metrics(features: DataFrame, currency: Column, keys=KEY) -> DataFrame:
    """Base key metrics except spending by category; ``features`` carry the currency column."""
    no_income = F.lit("No income transactions detected.")
    has = F.col("has_income")
    metrics = [
        _metric(1, "Average Monthly Income", _rounded("avg_monthly_income", 2), currency,
                F.when(has, "Average income received per month.").otherwise(no_income)),
        _metric(2, "Income Consistency (0-1)", _rounded("income_consistency", 2), None,
                F.when(has, "Higher indicates more stable income.").otherwise(no_income)),
        _metric(3, "Total Spending", _rounded("total_spending", 2), currency, "Total amount spent."),
        _metric(4, "Spending to Income Ratio", _rounded("spending_to_income_ratio", 2), None,
                "Percentage of total credit spent."),
        _metric(6, "Total Loan Repayments", _rounded("loan_repayments", 2), currency,
                "Sum of categorized loan repayments."),
        _metric(7, "Average Daily Balance", _rounded("avg_daily_balance", 2), currency,
                "Average balance maintained over the period."),
        _metric(8, "Minimum Balance", _rounded("min_balance", 2), currency, "Lowest balance recorded."),
        _metric(9, "Maximum Balance", _rounded("max_balance", 2), currency, "Highest balance recorded."),
        _metric(10, "Savings Rate", F.round(F.col("savings_rate") * 100, 2), F.lit("%"),
                "Percentage of total credit allocated to savings."),
    ]
    return _long(features, "base", metrics, keys)


def spending_metrics(txn: DataFrame | Base, keys=KEY) -> DataFrame:
    """The spending-by-category metric, one row per category."""
    return spending_by_category(txn, keys).select(
        *keys,
        F.lit("base").alias("section"),
        F.lit(5).alias("position"),
        F.lit("Spending By Category").alias("name"),
        F.col("category").alias("item"),
        F.col("spending").cast("double").alias("value"),
        F.lit(None).cast("string").alias("unit"),
        F.lit("Breakdown of spending by categorized types.").alias("description"),
    )


def bank_metrics(features: DataFrame, currency: Column, keys=KEY) -> DataFrame:
    """The bank module's own metrics; the income and balance groups only where present."""
    income, balance = F.col("has_big_income"), F.col("has_balance")
    metrics = [
        _metric(11, "Income Volatility (CV)", _rounded("income_volatility", 3), None,
                "Coefficient of variation of monthly income (lower is more stable)", income),
        _metric(12, "Average Monthly Income", _rounded("income_mean", 2), currency,
                "Average monthly income from all sources", income),
        _metric(13, "Income Standard Deviation", _rounded("income_std", 2), currency,
                "Standard deviation of monthly income", income),
        _metric(14, "Positive Cash Flow Days", F.col("positive_days"), None,
                "Number of days with positive cash flow"),
        _metric(15, "Negative Cash Flow Days", F.col("negative_days"), None,
                "Number of days with negative cash flow"),
        _metric(16, "Cash Flow Ratio", _rounded("cash_flow_ratio", 2), None,
                "Ratio of positive to total cash flow days"),
        _metric(17, "Average Daily Cash Flow", _rounded("avg_daily_flow", 2), currency,
                "Average net cash flow per day"),
        _metric(18, "Total Debt Payments", _rounded("debt_payments", 2), currency,
                "Total amount paid towards debts"),
        _metric(19, "Debt Service Ratio", _rounded("debt_service_ratio", 3), None,
                "Ratio of debt payments to total income"),
        _metric(20, "Number of Debt Payments", F.col("debt_payment_count"), None,
                "Count of debt payment transactions"),
        _metric(21, "Average Account Balance", _rounded("avg_raw_balance", 2), currency,
                "Average account balance maintained", balance),
        _metric(22, "Minimum Balance", _rounded("min_raw_balance", 2), currency,
                "Lowest account balance recorded", balance),
        _metric(23, "Emergency Fund Coverage", _rounded("emergency_fund_months", 1), F.lit("months"),
                "Months of expenses covered by average balance", balance),
        _metric(24, "Overdraft Days", F.when(balance, F.col("overdraft_rows")).otherwise(F.lit(0)), None,
                "Number of days account balance was negative"),
        _metric(25, "Overdraft Frequency", _rounded("overdraft_frequency", 3), None,
                "Proportion of time account was overdrawn"),
        _metric(26, "Average Daily Transactions", _rounded("avg_day_rows", 1), None,
                "Average number of transactions per day"),
        _metric(27, "Maximum Daily Transactions", F.col("max_day_rows"), None,
                "Highest number of transactions in a single day"),
    ]
    return _long(features, "bank", metrics, keys)


def bureau_metrics(features: DataFrame) -> DataFrame:
    metrics = [
        _metric(28, "Credit History Length", F.col("crb_credit_history_length"), F.lit("months"),
                "Length of credit history in months"),
        _metric(29, "Number of Credit Accounts", F.col("crb_num_accounts"), None,
                "Total number of credit accounts opened"),
        _metric(30, "Payment Performance Score", F.col("crb_payment_performance"), None,
                "Historical payment performance score"),
        _metric(31, "Credit Utilization Ratio", F.col("crb_credit_utilization"), F.lit("%"),
                "Percentage of available credit being used"),
        _metric(32, "Number of Credit Types", F.col("crb_num_credit_types"), None,
                "Diversity of credit products (e.g., loans, credit cards)"),
    ]
    return _long(features, "crb", metrics)


def mobile_metrics(features: DataFrame, currency: Column, keys=KEY) -> DataFrame:
    """The mobile-money module's metrics; its features are this engine's own definitions."""
    metrics = [
        _metric(36, "Average Daily Mobile Spending", _rounded("daily_spending_mean", 2), currency,
                "Average mobile money spending on days with spending"),
        _metric(37, "Mobile Loan Repayment Ratio", _rounded("loan_repayment_ratio", 3), None,
                "Ratio of mobile loan repayments to money received"),
        _metric(38, "Number of Remittances", F.col("remittance_frequency"), None,
                "Count of money sent and received"),
        _metric(39, "High Activity Days", F.col("busy_days"), None,
                "Number of days with more than 10 mobile money transactions"),
    ]
    return _long(features, "mobile", metrics, keys)


def cross_metrics(unified: DataFrame) -> DataFrame:
    metrics = [
        _metric(33, "Data Completeness Score", _rounded("data_completeness_score", 2), None,
                F.concat(F.lit("Proportion of available data sources ("),
                         F.col("available_sources").cast("string"), F.lit("/3)"))),
        _metric(34, "Bank-Mobile Spending Consistency", _rounded("spending_consistency", 2), None,
                "Consistency between bank and mobile money spending patterns",
                F.col("spending_consistency").isNotNull()),
        _metric(35, "Financial Data Diversification", _rounded("risk_diversification_score", 2), None,
                "Score reflecting the breadth of financial data available for analysis",
                F.col("risk_diversification_score").isNotNull()),
    ]
    return _long(unified, "cross", metrics)
