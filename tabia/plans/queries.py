"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabia.functions.text import lowered
from tabia.operators import (
    anomalies, features, ledger, metrics, model, narrative, results, scoring,
)
from tabia.plans import modules
from tabia.plans.modules import Tenants
from tabia.schemas import KEY
from tabia.session import settled, shared_folder
from tabia.sources import driver_tables as tables
from tabia.sources import statements as stm
from tabia.sources.settings_log import SettingsLog
from tabia.sources.tenants import currency, current_settings, read_tenant_config
from tabia.sources.transactions import (
    bureau_defaults, dated, explode_transactions, has_ids, latest_crb, read_crb, valid_bureau,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# A supplied scorecard (points per unit) for the factor ranking.
SCORECARD = {
    "avg_monthly_income": 0.0004,
    "income_consistency": 120.0,
    "total_spending": -0.00002,
    "spending_to_income_ratio": -40.0,
    "loan_repayments": -0.00005,
    "avg_daily_balance": 0.0003,
    "min_balance": 0.0001,
    "max_balance": 0.00002,
    "savings_rate": 90.0,
    "crb_credit_history_length": 0.8,
    "crb_payment_performance": 0.6,
    "crb_credit_utilization": -0.5,
    "crb_num_credit_types": 3.0,
    "daily_spending_mean": -0.0007,
    "loan_repayment_ratio": -35.0,
    "remittance_frequency": 1.5,
    "data_completeness_score": 25.0,
    "spending_consistency": 15.0,
    "risk_diversification_score": 12.0,
    "income_volatility": -20.0,
    "overdraft_frequency": -110.0,
    "debt_service_ratio": -75.0,
    "emergency_fund_months": 0.5,
    "cash_flow_variance": -0.000000001,
}


#: Ridge penalty of the fitted model.
REG = 0.1


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def _dbl(name: str):
    return F.col(name).cast("double").alias(name)


_TENANTS: dict[tuple[str, str], Tenants] = {}


def _tenants(spark, d) -> Tenants:
    """Tenant settings, read and size-checked once per session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TENANTS:
        _TENANTS[key] = Tenants(read_tenant_config(current_settings(tables.tenant_updates(spark, d))))
    return _TENANTS[key]


def _bank(spark, d, tenants=None) -> DataFrame:
    return modules.prepared(
        tables.bank_txn(spark, d), tenants or _tenants(spark, d), tables.BANK_SPAN
    )


def _bank_base(spark, d, tenants=None):
    """Bank transactions as the stored tables that modules share."""
    return modules.stored_base(tables.bank_txn(spark, d), tenants or _tenants(spark, d), tables.BANK_SPAN)


def _mobile(spark, d, tenants=None) -> DataFrame:
    return modules.prepared(tables.mobile_txn(spark, d), tenants or _tenants(spark, d))


def _mobile_base(spark, d, tenants=None):
    rows = tables.mobile_txn(spark, d)
    return modules.stored_base(rows, tenants or _tenants(spark, d), day_rows=features.mobile_day_rows)


def _dated_bank(spark, d) -> DataFrame:
    return dated(tables.bank_txn(spark, d))[0]


def _unified(spark, d, tenants) -> DataFrame:
    return modules.unified_features(
        _bank_base(spark, d, tenants), tables.crb(spark, d), _mobile_base(spark, d, tenants)
    )


def _partly_linked(spark, d) -> DataFrame:
    """Combined features where customers of some segments have no bank or no bureau record."""
    tenants = _tenants(spark, d)
    bank = modules.stored_base(tables.linked_bank_txn(spark, d), tenants, tables.BANK_SPAN)
    return modules.unified_features(
        bank, tables.linked_crb(spark, d), _mobile_base(spark, d, tenants)
    )


def _scored(spark, d, tenants, scorer=None) -> DataFrame:
    return modules.unified_score(
        _bank_base(spark, d, tenants), tables.crb(spark, d), _mobile_base(spark, d, tenants), tenants, scorer
    )


# --- sources and sinks -------------------------------------------------------------------


@query
def q_crb_validate(spark, d):
    filled = bureau_defaults(tables.crb(spark, d))
    return filled.select(
        *KEY,
        F.when(valid_bureau(), "valid").otherwise("rejected").alias("verdict"),
        "recent_late_payments",
        "credit_inquiries",
        "payment_performance_score",
        "credit_utilization_ratio",
    )


@query
def q_statement_parse(spark, d):
    rows = stm.parse_statements(tables.statements(spark, d), ["statement_id", *KEY])
    return rows.select(
        "statement_id", *KEY, "seq", "date", "description", _dbl("amount"), "type",
        _dbl("balance_after"), "original_currency",
    )


@query
def q_failed_statements(spark, d):
    return stm.failed_statements(tables.statements(spark, d), ["statement_id", *KEY])


@query
def q_ocr_lines(spark, d):
    return tables.ocr_blocks(spark, d).select(
        "doc_id", stm.ocr_blocks_to_text(F.col("Blocks")).alias("text")
    )


@query
def q_ocr_entities(spark, d):
    rows = stm.ocr_entity_rows(tables.ocr_entities(spark, d), F.lit("KES"))
    return rows.select(
        "document_id", *KEY, "seq", "date", "description", _dbl("amount"), "type",
        _dbl("balance_after"), "original_currency", "verdict",
    )


@query
def q_request_seq(spark, d):
    rows = explode_transactions(tables.transaction_requests(spark, d), "transactions", "request")
    return rows.select(
        *KEY, "seq", "date", "description", _dbl("amount"), "type", _dbl("balance_after")
    )


@query
def q_crb_latest(spark, d):
    kept, others = latest_crb(tables.crb_reports(spark, d), "report")
    columns = [*KEY, "report", "payment_performance_score"]
    return kept.select(*columns, F.lit("kept").alias("verdict")).unionByName(
        others.select(*columns, F.lit("superseded").alias("verdict"))
    )


@query
def q_document_forms(spark, d):
    documents = stm.with_form(tables.documents(spark, d))
    rows = stm.document_transactions(documents, ["document_id", *KEY])
    return rows.select(
        "document_id", *KEY, "form", "verdict", "seq", "date", "description", _dbl("amount"), "type",
        _dbl("balance_after"), "original_currency",
    )


@query
def q_result_messages(spark, d):
    scored = _scored(spark, d, _tenants(spark, d)).withColumn(
        "job_id", F.concat("company_id", F.lit("-"), F.col("customer_id").cast("string"))
    )
    return results.result_messages(scored)


@query
def q_tenant_config(spark, d):
    return _config_rows(read_tenant_config(current_settings(tables.tenant_updates(spark, d))))


@query
def q_tenant_snapshot(spark, d):
    """The settings from a stored log: three batches, a snapshot of the first two."""
    log = SettingsLog.create(spark, f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}")
    updates = tables.tenant_updates(spark, d)
    for batch in range(3):
        log.append(updates.where(F.col("version") % 3 == batch), batch)
        if batch == 1:
            log.compact(batch)
    return _config_rows(read_tenant_config(log.current()))


def _config_rows(config):
    return config.select(
        "company_id",
        "version",
        "language_preference",
        "currency_preference",
        "timezone",
        "is_active",
        "max_file_size_mb",
        F.col("transaction_categorization_rules_raw").alias("rules_raw"),
        F.size("transaction_categorization_rules").cast("bigint").alias("rule_count"),
        F.get("transaction_categorization_rules", F.lit(0))["category"].alias("first_category"),
        F.element_at("bank_scoring_weights", F.lit("overdraft_penalty")).alias("overdraft_penalty"),
        F.element_at("behavioral_scoring_weights", F.lit("anomaly_penalty_per_anomaly")).alias(
            "per_anomaly"
        ),
        narrative.tone_instruction(F.col("llm_tone_guidelines")).alias("tone"),
    )


# --- projections and filters -------------------------------------------------------------


@query
def q_clean_txn(spark, d):
    return _dated_bank(spark, d).select(*KEY, "seq", _day("txn_date"), "description", _dbl("amount"))


@query
def q_txn_amounts(spark, d):
    return ledger.with_amounts(_dated_bank(spark, d)).select(
        *KEY, "seq", _dbl("credit_amount"), _dbl("debit_amount"), _dbl("net_change"), _dbl("net_flow")
    )


@query
def q_debt_rows(spark, d):
    return (
        _dated_bank(spark, d)
        .where(ledger.is_debt(lowered(F.col("description"))))
        .select(*KEY, "seq", "description", _dbl("amount"))
    )


@query
def q_categorize(spark, d):
    return _bank(spark, d).select(*KEY, "seq", "description", "category")


@query
def q_scope(spark, d):
    rows = tables.bank_txn(spark, d).withColumn(
        "company_id", F.when(F.col("segment") != "BUILDING", F.col("company_id")).otherwise(" ")
    )
    verdict = F.when(has_ids(), "scoped").otherwise("quarantine")
    return rows.select(*KEY, "seq", verdict.alias("verdict"))


@query
def q_quarantine(spark, d):
    return modules.quarantined(
        tables.bank_txn(spark, d), tables.crb(spark, d), tables.mobile_txn(spark, d)
    )


@query
def q_result_lookup(spark, d):
    return results.lookup(
        tables.asked_jobs(spark, d), tables.job_results(spark, d), tables.job_events(spark, d)
    )


# --- joins -------------------------------------------------------------------------------


@query
def q_txn_with_config(spark, d):
    tenants = _tenants(spark, d)
    rows = tenants.attach(
        _dated_bank(spark, d), "currency_preference", "language_preference", "timezone",
        salt_by=("customer_id", "seq"),
    )
    return rows.withColumn("loc", narrative.localisation()).select(
        *KEY, "seq", "loc.language", "loc.currency", "loc.timezone"
    )


@query
def q_large_debits(spark, d):
    rows = anomalies.large_debit_rows(_bank_base(spark, d))
    return rows.select(*KEY, "seq", _day("txn_date"), _dbl("amount"), "avg_daily_debit")


@query
def q_monthly_income(spark, d):
    return ledger.monthly_income(_bank(spark, d)).select(*KEY, _day("month"), _dbl("income"))


@query
def q_unified_features(spark, d):
    columns = [c for c in features.FEATURE_VECTOR if c not in ("income_consistency", "income_volatility")]
    return _partly_linked(spark, d).select(
        *KEY, "bank_present", "crb_present", "mobile_present",
        *[_dbl(c) for c in columns],
        *[F.round(c, 4).alias(c) for c in ("income_consistency", "income_volatility")],
        F.col("bank_anomalies"), F.col("crb_anomalies"), F.col("mobile_anomalies"),
    )


# --- aggregations ------------------------------------------------------------------------


def _bank_columns(*columns, **rounded):
    """Bank features by name; ``rounded`` gives the places of derived deviations."""

    def run(spark, d):
        return features.bank_features(_bank(spark, d)).select(
            *KEY, *columns, *[F.round(c, places).alias(c) for c, places in rounded.items()]
        )

    return run


QUERIES["q_income_stability"] = _bank_columns(
    "has_income", "avg_monthly_income", income_consistency=4
)
QUERIES["q_spending_profile"] = _bank_columns(
    "total_spending", "total_credit", "spending_to_income_ratio", "loan_repayments", "savings_rate"
)
QUERIES["q_balance_profile"] = _bank_columns("avg_daily_balance", "min_balance", "max_balance")
QUERIES["q_income_volatility"] = _bank_columns(
    "has_big_income", "income_mean", income_std=4, income_volatility=4
)
QUERIES["q_cash_flow"] = _bank_columns(
    "days", "positive_days", "negative_days", "cash_flow_ratio", "avg_daily_flow", "cash_flow_variance"
)
QUERIES["q_debt_service"] = _bank_columns("debt_payments", "debt_payment_count", "debt_service_ratio")
QUERIES["q_liquidity"] = _bank_columns(
    "has_balance", "avg_raw_balance", "min_raw_balance", "expense_months", "emergency_fund_months"
)
QUERIES["q_account_behavior"] = _bank_columns(
    "transactions", "overdraft_rows", "overdraft_frequency", "avg_day_rows", "max_day_rows"
)


@query
def q_spending_by_category(spark, d):
    return features.spending_by_category(_bank(spark, d)).select(*KEY, "category", _dbl("spending"))


def _metric_rows(frame):
    return frame.select(*KEY, "section", "position", "name", "item", "value", "unit", "description")


@query
def q_metrics_base(spark, d):
    tenants = _tenants(spark, d)
    txn = _bank_base(spark, d, tenants)
    table = tenants.attach(features.bank_features(txn), "currency_preference")
    return _metric_rows(
        metrics.base_metrics(table, currency()).unionByName(metrics.spending_metrics(txn))
    )


@query
def q_metrics_bank(spark, d):
    tenants = _tenants(spark, d)
    table = tenants.attach(features.bank_features(_bank(spark, d, tenants)), "currency_preference")
    return _metric_rows(metrics.bank_metrics(table, currency()))


@query
def q_crb_features(spark, d):
    return features.bureau_features(read_crb(tables.crb(spark, d))[0])


@query
def q_mobile_features(spark, d):
    return features.mobile_features(_mobile(spark, d)).select(
        *KEY, "transactions", _day("first_date"), _day("last_date"), "daily_spending_mean",
        "loan_repayment_ratio", "remittance_frequency", "busy_days",
    )


@query
def q_source_coverage(spark, d):
    return _partly_linked(spark, d).select(
        *KEY, "bank_transactions", _day("bank_first_date"), _day("bank_last_date"),
        "mobile_transactions", _day("mobile_first_date"), _day("mobile_last_date"),
        "crb_credit_history_length", "crb_num_accounts",
    )


@query
def q_data_completeness(spark, d):
    return _partly_linked(spark, d).select(
        *KEY, "bank_present", "crb_present", "mobile_present", "available_sources",
        "data_completeness_score",
    )


@query
def q_cross_source(spark, d):
    return _partly_linked(spark, d).select(
        *KEY, "spending_consistency", "risk_diversification_score"
    )


@query
def q_anomaly_counts(spark, d):
    return _unified(spark, d, _tenants(spark, d)).select(
        *KEY, "bank_anomalies", "crb_anomalies", "mobile_anomalies",
        F.col("anomalies").cast("bigint").alias("anomalies"),
    )


# --- windows and unions ------------------------------------------------------------------


@query
def q_infer_balance(spark, d):
    return ledger.infer_balances(_bank(spark, d)).select(
        *KEY, "seq", _day("txn_date"), _dbl("inferred_balance")
    )


@query
def q_infer_balance_splits(spark, d):
    """Several splits to a day: the balances are chained over splits and days, with the same result."""
    txn = modules.prepared(tables.bank_txn(spark, d), _tenants(spark, d), tables.NARROW_SPAN)
    return ledger.infer_balances(txn).select(
        *KEY, "seq", _day("txn_date"), _dbl("inferred_balance")
    )


@query
def q_balance_profile_splits(spark, d):
    txn = modules.prepared(tables.bank_txn(spark, d), _tenants(spark, d), tables.NARROW_SPAN)
    return features.bank_features(txn).select(
        *KEY, "avg_daily_balance", "min_balance", "max_balance", "has_balance", "max_day_rows", "cash_flow_variance"
    )


@query
def q_job_status(spark, d):
    return results.latest_status(tables.job_events(spark, d))


@query
def q_top_factors(spark, d):
    vectors = features.feature_vector(_unified(spark, d, _tenants(spark, d))).select(
        *KEY, *[F.round(c, 4).alias(c) for c in SCORECARD]
    )
    scorer = model.LinearScorer(SCORECARD, dict.fromkeys(SCORECARD, 0.25))
    return model.explain(vectors, scorer).select(
        *KEY, F.col("rank").cast("bigint").alias("rank"), "feature", "impact"
    )


@query
def q_metrics_all(spark, d):
    tenants = _tenants(spark, d)
    return _metric_rows(
        modules.all_metrics(
            _bank_base(spark, d, tenants), tables.crb(spark, d), _mobile_base(spark, d, tenants), tenants
        )
    )


def _anomaly_rows(frame):
    return frame.select(
        *KEY, "source", "type", _day("txn_date"), "seq", "description", "reason",
        "txn_description", "amount",
    )


@query
def q_anomalies_all(spark, d):
    tenants = _tenants(spark, d)
    return _anomaly_rows(
        modules.all_anomalies(
            _bank_base(spark, d, tenants), tables.crb(spark, d), _mobile_base(spark, d, tenants), tenants
        )
    )


@query
def q_transactions_all(spark, d):
    tenants = _tenants(spark, d)
    return modules.all_transactions(_bank(spark, d, tenants), _mobile(spark, d, tenants)).select(
        "source", *KEY, "seq", _day("txn_date"), "description", _dbl("amount"), "type", "category",
        _dbl("balance_after"),
    )


# --- anomalies ---------------------------------------------------------------------------


@query
def q_high_frequency_days(spark, d):
    return anomalies.busy_days(_bank(spark, d), "bank").select(
        *KEY, _day("txn_date"), "description", "reason"
    )


@query
def q_bank_anomalies(spark, d):
    tenants = _tenants(spark, d)
    table = tenants.attach(features.bank_features(_bank(spark, d, tenants)), "currency_preference")
    return anomalies.bank_anomalies(table, currency()).select(*KEY, "type", "description", "reason")


@query
def q_crb_anomalies(spark, d):
    return modules.bureau_anomalies(tables.crb(spark, d)).select(*KEY, "type", "description", "reason")


@query
def q_cross_source_anomalies(spark, d):
    return anomalies.cross_anomalies(_unified(spark, d, _tenants(spark, d))).select(
        *KEY, "type", "description", "reason"
    )


# --- scoring -----------------------------------------------------------------------------


def _score_rows(scored, name):
    return scored.select(
        *KEY, F.round(name, 4).alias(name), "risk_level",
        F.size("breakdown").cast("bigint").alias("rules_fired"),
    )


@query
def q_bank_features(spark, d):
    return modules.bank_features(_bank_base(spark, d)).select(
        *KEY,
        "avg_monthly_income", F.round("income_consistency", 4).alias("income_consistency"),
        "total_spending", "spending_to_income_ratio", "loan_repayments", "avg_daily_balance",
        "min_balance", "max_balance", "savings_rate",
        F.round("income_volatility", 4).alias("income_volatility"),
        "overdraft_frequency", "debt_service_ratio", "emergency_fund_months",
        "cash_flow_variance", "bank_anomalies",
    )


@query
def q_bank_score(spark, d):
    tenants = _tenants(spark, d)
    return _score_rows(modules.bank_score(_bank_base(spark, d, tenants), tenants), "bank_score")


@query
def q_bank_score_spine(spark, d):
    """Scores of all customers, where every eleventh has no readable date at all."""
    rows = tables.partly_undated_bank_txn(spark, d)
    tenants = _tenants(spark, d)
    base = modules.stored_base(rows, tenants, tables.BANK_SPAN)
    return _score_rows(modules.bank_score(base, tenants, modules.customers_of(rows)), "bank_score")


@query
def q_crb_score(spark, d):
    return _score_rows(modules.bureau_score(tables.crb(spark, d), _tenants(spark, d)), "crb_score")


@query
def q_mobile_score(spark, d):
    tenants = _tenants(spark, d)
    return _score_rows(modules.mobile_score(_mobile_base(spark, d, tenants), tenants), "mobile_score")


@query
def q_unified_score(spark, d):
    return _score_rows(_scored(spark, d, _tenants(spark, d)), "behavioral_score")


def _all_scores(spark, d):
    """The four scorers on one base of each source."""
    tenants = _tenants(spark, d)
    bank, mobile, records = _bank_base(spark, d, tenants), _mobile_base(spark, d, tenants), tables.crb(spark, d)
    return {
        "bank": modules.bank_score(bank, tenants),
        "crb": modules.bureau_score(records, tenants),
        "mobile": modules.mobile_score(mobile, tenants),
        "unified": modules.unified_score(bank, records, mobile, tenants),
    }


def _union(frames):
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


@query
def q_rule_breakdown(spark, d):
    rows = _union(scoring.breakdown_rows(s, m) for m, s in _all_scores(spark, d).items())
    return rows.select(
        *KEY, "module", "position", "rule_name", "condition_met",
        F.round("adjustment", 4).alias("adjustment"), F.round("new_score", 4).alias("new_score"),
    )


@query
def q_score_components(spark, d):
    rows = _union(scoring.component_rows(s, m) for m, s in _all_scores(spark, d).items())
    return rows.select(*KEY, "module", "component", F.round("impact", 4).alias("impact"))


# --- model -------------------------------------------------------------------------------


def _vectors(spark, d):
    """Feature vectors; fitting, means and scoring each read them once."""
    return settled(features.feature_vector(_unified(spark, d, _tenants(spark, d))))


@query
def q_feature_vector(spark, d):
    rounded = ("income_consistency", "income_volatility")
    vectors = features.feature_vector(_unified(spark, d, _tenants(spark, d)))
    return vectors.select(
        *KEY,
        *[F.round(c, 4).alias(c) if c in rounded else c for c in features.FEATURE_VECTOR],
    )


def _fitted(spark, d):
    """The model is fitted on customers' account balances as the supplied label."""
    vectors = _vectors(spark, d)
    label = tables.load(spark, d, "customer")["customer"].select(
        F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("company_id"),
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_acctbal") / 10).alias("label"),
    )
    return vectors, model.fit(vectors.join(label, list(KEY)), "label", reg=REG)


@query
def q_scorecard_score(spark, d):
    tenants = _tenants(spark, d)
    scorer = model.LinearScorer(SCORECARD, dict.fromkeys(SCORECARD, 0.25), 500.0)
    return _scored(spark, d, tenants, scorer).select(
        *KEY, F.round("base_score", 4).alias("base_score"),
        F.round("behavioral_score", 4).alias("behavioral_score"), "risk_level",
        F.size("score_explanation").cast("bigint").alias("factors"),
    )


@query
def q_model_score(spark, d):
    vectors, scorer = _fitted(spark, d)
    return vectors.select(*KEY, F.round(scorer.prediction(), 4).alias("base_score"))


@query
def q_score_explanation(spark, d):
    vectors, scorer = _fitted(spark, d)
    # one rank for each feature; adding 0 makes a rounded -0 plain
    return model.explain(vectors, scorer).select(
        *KEY, F.col("rank").cast("bigint").alias("rank"), "feature", (F.round("impact", 4) + 0.0).alias("impact")
    )


# --- texts -------------------------------------------------------------------------------


@query
def q_unified_summary(spark, d):
    return _scored(spark, d, _tenants(spark, d)).select(
        *KEY, "analysis_summary", "localization_details.language", "localization_details.currency"
    )


@query
def q_narrative_context(spark, d):
    tenants = _tenants(spark, d)
    base = _bank_base(spark, d, tenants)
    scored = modules.bank_score(base, tenants)
    customers = tenants.attach(scored.select(*KEY), "llm_tone_guidelines")
    return narrative.narrative_context(
        customers,
        modules.bank_metrics(base, tenants),
        modules.bank_anomalies(base, tenants),
        scoring.breakdown_rows(scored, "bank"),
        scored=scored,
        score="bank_score",
    )
