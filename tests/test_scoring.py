"""Each rule at, below and above its threshold; clamp, tiers, breakdown."""

import pytest
from pyspark.sql import functions as F

from tabia.functions.rules import MODULE_TIERS, UNIFIED_TIERS, clamped, tier
from tabia.operators import anomalies, features, model, scoring

BANK = {
    "income_consistency": 0.5, "avg_daily_balance": 50000.0, "overdraft_frequency": 0.0, "debt_service_ratio": 0.0,
    "emergency_fund_months": 2.0, "savings_rate": 0.0, "income_volatility": 0.0, "bank_anomalies": 0,
}
CRB = {
    "crb_credit_history_length": 0, "crb_payment_performance": 50.0, "crb_credit_utilization": 0.0,
    "crb_late_payments": 0, "crb_inquiries": 0,
}
MOBILE = {"daily_spending_mean": 15000.0, "loan_repayment_ratio": 0.2, "remittance_frequency": 0, "mobile_anomalies": 0}
UNIFIED = {
    "spending_to_income_ratio": 0.0, "savings_rate": 0.0, "anomalies": 0, "crb_payment_performance": 50.0,
    "crb_credit_history_length": 0, "crb_credit_utilization": 0.0, "loan_repayment_ratio": 0.0,
    "data_completeness_score": 0.0, "spending_consistency": 0.0,
}

CASES = {
    "bank": (scoring.bank_score, "bank_score", BANK, 500, [
        ("income_consistency", [(1.0, 600), (0.0, 400), (-1.0, 200), (None, 400)]),
        ("avg_daily_balance", [(100000.0, 500), (100000.01, 600), (5000.0, 500), (4999.99, 420)]),
        ("overdraft_frequency", [(0.1, 500), (0.11, 380)]),
        ("debt_service_ratio", [(0.4, 500), (0.41, 400)]),
        ("emergency_fund_months", [(3.0, 580), (2.99, 500), (1.0, 500), (0.99, 440)]),
        ("savings_rate", [(0.15, 500), (0.16, 570)]),
        ("bank_anomalies", [(0, 500), (1, 475), (4, 400), (40, 0)]),
        ("income_volatility", [(0.5, 500), (0.51, 450)]),
    ]),
    "crb": (scoring.bureau_score, "crb_score", CRB, 500, [
        ("crb_credit_history_length", [(23, 500), (24, 550)]),
        ("crb_payment_performance", [(0.0, 400), (100.0, 600)]),
        ("crb_credit_utilization", [(75.0, 500), (75.5, 430)]),
        ("crb_late_payments", [(0, 500), (1, 480), (3, 440)]),
        ("crb_inquiries", [(5, 500), (6, 450)]),
    ]),
    "mobile": (scoring.mobile_score, "mobile_score", MOBILE, 550, [
        ("daily_spending_mean", [(0.0, 550), (0.01, 580), (9999.99, 580), (10000.0, 550), (20000.0, 550), (20000.01, 490)]),
        ("loan_repayment_ratio", [(0.3, 550), (0.31, 470), (0.1, 570), (0.11, 550), (0.0, 550)]),
        ("remittance_frequency", [(5, 550), (6, 590), (10, 590), (11, 615)]),
        ("mobile_anomalies", [(1, 530)]),
    ]),
    "unified": (scoring.unified_score, "behavioral_score", UNIFIED, 500, [
        ("spending_to_income_ratio", [(0.8, 500), (0.81, 450)]),
        ("savings_rate", [(0.1, 500), (0.11, 520)]),
        ("anomalies", [(1, 480), (30, 0)]),
        ("crb_payment_performance", [(80.0, 540), (79.0, 500), (40.0, 500), (39.0, 440), (0.0, 500)]),
        ("crb_credit_history_length", [(23, 500), (24, 525)]),
        ("crb_credit_utilization", [(75.0, 500), (76.0, 465)]),
        ("loan_repayment_ratio", [(0.3, 500), (0.31, 455)]),
        ("data_completeness_score", [(2 / 3, 500), (0.67, 515), (1.0, 515)]),
        ("spending_consistency", [(0.8, 500), (0.81, 520), (None, 500)]),
    ]),
}


@pytest.mark.parametrize("module", CASES)
def test_thresholds(spark, module):
    score, name, base, start, cases = CASES[module]
    rows, expected = [(*base.values(),)], [start]
    for field, values in cases:
        for value, points in values:
            rows.append(tuple(value if k == field else v for k, v in base.items()))
            expected.append(points)
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in base.items())
    frame = spark.createDataFrame(
        [("A", str(i), *r) for i, r in enumerate(rows)], f"company_id string, customer_id string, {kinds}"
    )
    got = {int(r.customer_id): r for r in score(frame, None).collect()}
    assert [got[i][name] for i in range(len(rows))] == pytest.approx(expected)
    for r in got.values():
        last = r.breakdown[-1].new_score if r.breakdown else 500
        assert r[name] == max(0, min(1000, last))
        assert sum(e.adjustment for e in r.breakdown) == pytest.approx(sum(r.components))
        assert [e.position for e in r.breakdown] == sorted(e.position for e in r.breakdown)


def test_tenant_weights(spark):
    frame = spark.createDataFrame(
        [("A", "1", *{**BANK, "bank_anomalies": 2.0}.values()), ("B", "1", *{**BANK, "bank_anomalies": 2.0}.values())],
        "company_id string, customer_id string, " + ", ".join(f"{k} double" for k in BANK),
    )
    tenants = spark.createDataFrame(
        [("A", {"anomaly_penalty": 10.0, "unread": 1.0})], "company_id string, bank_scoring_weights map<string,double>"
    )
    for small in (True, False):  # broadcast and salted way give the same
        got = {r.company_id: r.bank_score for r in scoring.bank_score(frame, tenants, small).collect()}
        assert got == {"A": 480.0, "B": 450.0}


def test_clamp_and_tiers(spark):
    scores = [-1.0, 0.0, 349.9, 350.0, 500.0, 650.0, 800.0, 1000.0, 1200.0]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(
        clamped(F.col("s")).alias("c"), tier(F.col("s"), MODULE_TIERS).alias("m"), tier(F.col("s"), UNIFIED_TIERS).alias("u")
    ).collect()
    assert [r.c for r in rows] == [0, 0, 349.9, 350, 500, 650, 800, 1000, 1000]
    assert [r.m for r in rows][2:7] == ["Very High Risk", "High Risk", "Medium Risk", "Low Risk", "Very Low Risk"]
    assert [r.u for r in rows][3:7] == ["High Risk", "Medium-High Risk", "Medium Risk", "Low Risk"]


FLAG_INPUT = {
    "has_big_income": True, "income_volatility": 0.0, "negative_days": 0, "positive_days": 0, "debt_service_ratio": 0.0,
    "has_balance": True, "emergency_fund_months": 5.0, "min_raw_balance": 0.0, "max_day_rows": 20,
}


@pytest.mark.parametrize(
    "change, kind",
    [
        ({}, None),
        ({"income_volatility": 0.5}, None),
        ({"income_volatility": 0.51}, "Irregular Income Pattern"),
        ({"negative_days": 1}, "Negative Cash Flow Pattern"),
        ({"negative_days": 1, "positive_days": 1}, None),
        ({"debt_service_ratio": 0.4}, None),
        ({"debt_service_ratio": 0.41}, "High Debt Service Ratio"),
        ({"emergency_fund_months": 0.99}, "Low Emergency Fund"),
        ({"emergency_fund_months": 0.0, "has_balance": False, "min_raw_balance": None}, None),
        ({"min_raw_balance": -0.01}, "Overdraft Usage"),
        ({"max_day_rows": 21}, "High Transaction Activity"),
    ],
)
def test_bank_flags(spark, change, kind):
    row = {**FLAG_INPUT, **change}
    kinds = {bool: "boolean", int: "int", float: "double"}
    frame = spark.createDataFrame(
        [("A", "1", *row.values())],
        "company_id string, customer_id string, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in FLAG_INPUT.items()),
    )
    got = [r.type for r in anomalies.bank_anomalies(frame, F.lit("KES")).collect()]
    assert got == ([] if kind is None else [kind])


def test_bureau_flags(spark):
    frame = spark.createDataFrame(
        [("A", "calm", 12, 2, 75.0, 5), ("A", "all", 11, 3, 75.1, 6)],
        "company_id string, customer_id string, crb_credit_history_length int, crb_late_payments int,"
        " crb_credit_utilization double, crb_inquiries int",
    )
    assert {r.customer_id: r.crb_anomalies for r in anomalies.with_bureau_count(frame).collect()} == {"calm": 0, "all": 4}
    assert anomalies.bureau_anomalies(frame).count() == 4


@pytest.mark.parametrize(
    "performance, found, sources, expected",
    [(49.0, 0, 2, 1), (50.0, 0, 2, 0), (49.0, 1, 2, 0), (81.0, 4, 3, 1), (81.0, 3, 2, 0), (80.0, 4, 2, 0), (49.0, 0, 1, 0)],
)
def test_cross_flags(spark, performance, found, sources, expected):
    frame = spark.createDataFrame(
        [("A", "1", 1, sources, performance, found)],
        "company_id string, customer_id string, crb_present int, available_sources int, crb_payment_performance double,"
        " anomalies_so_far int",
    )
    assert anomalies.cross_anomalies(frame).count() == expected


def test_large_debits_and_busy_days(spark):
    from tests.helpers import prepared

    rows = [("a", i, "2023-01-01", "x", 1, "debit", None) for i in range(11)]
    rows += [("a", 20 + i, f"2023-01-{i + 2:02d}", "x", 10, "debit", None) for i in range(20)]
    rows += [("a", 90, "2023-02-01", "tv", 5000, "debit", None)]
    rows += [("b", i, "2023-01-01", "x", 1000, "debit", None) for i in range(10)]
    rows += [("c", 1, "2023-01-01", "x", 9000, "credit", None)]
    for span in (3, 1 << 20):
        txn = prepared(spark, rows, span)
        (large,) = anomalies.large_debits(txn, "bank", F.lit("KES")).collect()
        assert (large.customer_id, large.seq, large.txn_description) == ("a", 90, "tv")
        assert large.description == "Transaction of KES 5000.00 is significantly larger than typical spending."
        (busy,) = anomalies.busy_days(txn, "bank").collect()
        assert (busy.customer_id, busy.reason) == ("a", "11 transactions on this day.")
        counted = anomalies.with_base_count(features.bank_features(txn), txn)
        assert {r.customer_id: r.anomalies for r in counted.collect()} == {"a": 2, "b": 0, "c": 0}


def test_mobile_features(spark):
    from tests.helpers import by_customer, prepared

    got = by_customer(features.mobile_features(prepared(spark, [
        ("a", 1, "2024-01-01", "M-PESA Send Money", 100, "debit", None),
        ("a", 2, "2024-01-01", "Fuliza Loan Repayment", 50, "debit", None),
        ("a", 3, "2024-01-03", "Pay merchant", 50, "debit", None),
        ("a", 4, "2024-01-04", "Receive money", 200, "credit", None),
        ("b", 1, "2024-01-04", "Receive money", 200, "credit", None),
        ("c", 1, "2024-01-04", "loan", 20, "debit", None),
    ])))
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.daily_spending_mean, a.loan_repayment_ratio, a.remittance_frequency) == (100.0, 0.25, 2)
    assert (b.daily_spending_mean, b.loan_repayment_ratio, b.remittance_frequency) == (0.0, 0.0, 1)
    assert (c.daily_spending_mean, c.loan_repayment_ratio) == (20.0, 0.0)


def test_contributions_add_up_to_the_prediction(spark):
    import random

    rng = random.Random(7)
    names = ("x", "y", "z")
    rows = [("A", str(i), rng.random(), rng.random() * 5, rng.random() - 3) for i in range(200)]
    rows = [(*r, 3 * r[2] - 2 * r[3] + 0.5 * r[4] + 10) for r in rows]
    frame = spark.createDataFrame(rows, "company_id string, customer_id string, x double, y double, z double, label double")
    scorer = model.fit(frame, "label", names)
    assert scorer.coefficients == pytest.approx({"x": 3, "y": -2, "z": 0.5}, abs=1e-6)
    mean = frame.select(F.avg(scorer.prediction())).first()[0]
    long = model.explain(frame, scorer).groupBy("customer_id").agg(
        F.sum("impact").alias("s"),
        F.expr("array_sort(collect_list(struct(rank, abs(impact) as size)))").alias("ranked"),
    )
    predicted = {r.customer_id: r.p for r in frame.select("customer_id", scorer.prediction().alias("p")).collect()}
    for r in long.collect():
        assert mean + r.s == pytest.approx(predicted[r.customer_id])
        sizes = [e["size"] for e in r.ranked]
        assert sizes == sorted(sizes, reverse=True)
