"""The four scorers. Feature columns in, score, tier, breakdown and components out."""

from pyspark.sql import Column, DataFrame, functions as F

from tabia.functions.rules import MODULE_TIERS, UNIFIED_TIERS, Rule, apply_rules
from tabia.functions.values import fixed, weight
from tabia.operators.spread import attach_tenant
from tabia.schemas import KEY

START = 500  # starting score of the module scorers


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def bank_rules(w: Column) -> list[Rule]:
    steady, balance = _number("income_consistency"), _number("avg_daily_balance")
    overdraft, debt = _number("overdraft_frequency"), _number("debt_service_ratio")
    fund, savings = _number("emergency_fund_months"), _number("savings_rate")
    swing, found = _number("income_volatility"), _count("bank_anomalies")
    return [
        Rule("Income Consistency", "income_consistency_impact", F.lit(True),
             steady * 200 - 100, _say("Income consistency score: ", fixed(steady, 2))),
        Rule("High Average Balance", "balance_impact", balance > 100000,
             weight(w, "high_balance_bonus", 100),
             _say("Average balance: ", fixed(balance, 2), " > 100,000")),
        Rule("Low Average Balance", "balance_impact", balance < 5000,
             -weight(w, "low_balance_penalty", 80),
             _say("Average balance: ", fixed(balance, 2), " < 5,000")),
        Rule("Frequent Overdraft Usage", "overdraft_impact", overdraft > 0.1,
             -weight(w, "overdraft_penalty", 120),
             _say("Overdraft frequency: ", fixed(overdraft, 2), " > 0.1")),
        Rule("High Debt Service Ratio", "debt_impact", debt > 0.4,
             -weight(w, "high_debt_penalty", 100),
             _say("Debt service ratio: ", fixed(debt, 2), " > 0.4")),
        Rule("Good Emergency Fund Coverage", "emergency_fund_impact", fund >= 3,
             weight(w, "emergency_fund_bonus", 80),
             _say("Emergency fund: ", fixed(fund, 1), " months >= 3")),
        Rule("Low Emergency Fund Coverage", "emergency_fund_impact", fund < 1,
             -weight(w, "low_emergency_fund_penalty", 60),
             _say("Emergency fund: ", fixed(fund, 1), " months < 1")),
        Rule("High Savings Rate", "savings_impact", savings > 0.15,
             weight(w, "high_savings_bonus", 70),
             _say("Savings rate: ", fixed(savings, 2), " > 0.15")),
        Rule("Transaction Anomalies", "anomalies_impact", found > 0,
             -found * weight(w, "anomaly_penalty", 25),
             _say(found.cast("string"), " anomalies detected")),
        Rule("High Income Volatility", "volatility_impact", swing > 0.5,
             -weight(w, "income_volatility_penalty", 50),
             _say("Income volatility: ", fixed(swing, 2), " > 0.5")),
    ]


def bureau_rules(w: Column) -> list[Rule]:
    history, performance = _count("crb_credit_history_length"), _number("crb_payment_performance")
    used, late = _number("crb_credit_utilization"), _count("crb_late_payments")
    inquiries = _count("crb_inquiries")
    return [
        Rule("Long Credit History", "history_impact", history >= 24,
             weight(w, "long_credit_history_bonus", 50),
             _say("Credit History Length (", history.cast("string"), " months) >= 24.")),
        Rule("Payment Performance", "payment_impact", F.lit(True),
             performance / 100.0 * 200 - 100,
             _say("Payment performance score: ", performance.cast("string"))),
        Rule("High Credit Utilization", "utilization_impact", used > 75,
             -weight(w, "high_credit_utilization_penalty", 70),
             _say("Credit Utilization Ratio (", used.cast("string"), "%) > 75%.")),
        Rule("Recent Late Payments", "late_payments_impact", late > 0,
             -late * weight(w, "late_payment_penalty_per_instance", 20),
             _say(late.cast("string"), " recent late payments")),
        Rule("Frequent Credit Inquiries", "inquiries_impact", inquiries > 5,
             -weight(w, "frequent_inquiries_penalty", 50),
             _say(inquiries.cast("string"), " credit inquiries")),
    ]


def mobile_rules(w: Column) -> list[Rule]:
    daily, loans = _number("daily_spending_mean"), _number("loan_repayment_ratio")
    sent, found = _count("remittance_frequency"), _count("mobile_anomalies")
    return [
        Rule("Consistent Daily Spending", "spending_consistency_impact", (daily > 0) & (daily < 10000),
             weight(w, "consistent_spending_bonus", 30),
             _say("Daily spending mean: ", fixed(daily, 2), " within reasonable range")),
        Rule("High Daily Spending", "spending_consistency_impact", daily > 20000,
             -weight(w, "high_spending_penalty", 60),
             _say("Daily spending mean: ", fixed(daily, 2), " > 20,000")),
        Rule("High Mobile Loan Dependency", "loan_dependency_impact", loans > 0.3,
             -weight(w, "high_loan_dependency_penalty", 80),
             _say("Loan repayment ratio: ", fixed(loans, 2), " > 0.3")),
        Rule("Manageable Mobile Loan Usage", "loan_dependency_impact", (loans > 0) & (loans <= 0.1),
             weight(w, "manageable_loan_bonus", 20),
             _say("Loan repayment ratio: ", fixed(loans, 2), " <= 0.1")),
        Rule("Active Remittance Activity", "remittance_impact", sent > 5,
             weight(w, "active_remittance_bonus", 40),
             _say("Remittance frequency: ", sent.cast("string"), " > 5")),
        Rule("Mobile Money Anomalies", "anomalies_impact", found > 0,
             -found * weight(w, "anomaly_penalty", 20),
             _say(found.cast("string"), " anomalies detected")),
        Rule("Digital Financial Inclusion", "inclusion_impact", F.lit(True),
             weight(w, "digital_inclusion_bonus", 50),
             _say("Active mobile money usage indicates digital financial inclusion")),
        Rule("Strong Social Financial Network", "social_network_impact", sent > 10,
             weight(w, "strong_social_network_bonus", 25),
             _say("High P2P activity indicated by remittance frequency: ", sent.cast("string"))),
    ]


def unified_rules(w: Column) -> list[Rule]:
    spending, savings = _number("spending_to_income_ratio"), _number("savings_rate")
    performance, history = _number("crb_payment_performance"), _count("crb_credit_history_length")
    used, loans = _number("crb_credit_utilization"), _number("loan_repayment_ratio")
    complete, steady = _number("data_completeness_score"), _number("spending_consistency")
    found = _count("anomalies")
    return [
        Rule("High Spending to Income Ratio", "spending_impact", spending > 0.8,
             -weight(w, "high_spending_penalty", 50),
             _say("Spending to Income Ratio (", fixed(spending, 2), ") exceeded 0.8.")),
        Rule("High Savings Rate", "savings_impact", savings > 0.1,
             weight(w, "high_savings_bonus", 20),
             _say("Savings Rate (", fixed(savings, 2), ") exceeded 0.1.")),
        Rule("Detected Anomalies", "anomalies_impact", found > 0,
             -found * weight(w, "anomaly_penalty_per_anomaly", 20),
             _say(found.cast("string"), " anomalies detected.")),
        Rule("Excellent CRB Payment Performance", "crb_performance_impact", performance >= 80,
             weight(w, "excellent_crb_performance_bonus", 40),
             _say("CRB Payment Performance (", performance.cast("string"), ") >= 80.")),
        Rule("Poor CRB Payment Performance", "crb_performance_impact",
             (performance > 0) & (performance < 40),
             -weight(w, "poor_crb_performance_penalty", 60),
             _say("CRB Payment Performance (", performance.cast("string"), ") < 40.")),
        Rule("Long Credit History", "crb_history_impact", history >= 24,
             weight(w, "long_credit_history_bonus", 25),
             _say("Credit History Length (", history.cast("string"), " months) >= 24.")),
        Rule("High Credit Utilization", "crb_utilization_impact", used > 75,
             -weight(w, "high_credit_utilization_penalty", 35),
             _say("Credit Utilization (", used.cast("string"), "%) > 75%.")),
        Rule("High Mobile Loan Dependency", "loan_dependency_impact", loans > 0.3,
             -weight(w, "high_mobile_loan_dependency_penalty", 45),
             _say("Mobile Loan Repayment Ratio (", fixed(loans, 2), ") > 0.3.")),
        Rule("Good Data Completeness", "completeness_impact", complete >= 0.67,
             weight(w, "good_data_completeness_bonus", 15),
             _say("Data Completeness Score (", fixed(complete, 2), ") >= 0.67.")),
        Rule("Consistent Spending Patterns", "spending_consistency_impact", steady > 0.8,
             weight(w, "spending_consistency_bonus", 20),
             _say("Spending Consistency (", fixed(steady, 2), ") > 0.8.")),
    ]


def _scored(rows, tenants, small, weights, rules, base, score, tiers, keep) -> DataFrame:
    if tenants is None:
        with_weights = rows.withColumn(weights, F.lit(None).cast("map<string,double>"))
    else:
        with_weights = attach_tenant(rows, tenants, [weights, *keep], small)
    return apply_rules(with_weights, rules(F.col(weights)), base, score, tiers).drop(weights)


def bank_score(features: DataFrame, tenants, small: bool = True, keep=()) -> DataFrame:
    return _scored(features, tenants, small, "bank_scoring_weights", bank_rules,
                   F.lit(START), "bank_score", MODULE_TIERS, keep)


def bureau_score(features: DataFrame, tenants, small: bool = True, keep=()) -> DataFrame:
    return _scored(features, tenants, small, "crb_scoring_weights", bureau_rules,
                   F.lit(START), "crb_score", MODULE_TIERS, keep)


def mobile_score(features: DataFrame, tenants, small: bool = True, keep=()) -> DataFrame:
    return _scored(features, tenants, small, "mobile_money_scoring_weights", mobile_rules,
                   F.lit(START), "mobile_score", MODULE_TIERS, keep)


def unified_score(
    features: DataFrame, tenants, small: bool = True, base: Column | None = None, keep=()
) -> DataFrame:
    """``base`` is the model's prediction, or the constant 500."""
    start = F.lit(START) if base is None else base
    return _scored(features, tenants, small, "behavioral_scoring_weights", unified_rules,
                   start, "behavioral_score", UNIFIED_TIERS, keep)


def breakdown_rows(scored: DataFrame, module: str, keys=KEY) -> DataFrame:
    """The fired rules in long form."""
    return scored.select(*keys, F.explode("breakdown").alias("rule")).select(
        *keys, F.lit(module).alias("module"), "rule.*"
    )


def component_rows(scored: DataFrame, module: str, keys=KEY) -> DataFrame:
    """Score components in long form."""
    names = scored.schema["components"].dataType.names
    pairs = F.array(
        *[F.struct(F.lit(n).alias("component"), F.col(f"components.{n}").alias("impact")) for n in names]
    )
    return scored.select(*keys, F.explode(pairs).alias("part")).select(
        *keys, F.lit(module).alias("module"), "part.*"
    )
