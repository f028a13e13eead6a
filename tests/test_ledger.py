"""Balances, sums and spines against brute force, also where customers are cut into splits."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabia.operators import features, ledger
from tests.helpers import by_customer, money, prepared


def _random_rows(seed, customers=6, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        gaps = c % 3
        # the last customer is hot: most rows, all on two days
        size = n * 5 if c == customers - 1 else rng.randint(1, n)
        for seq in range(size):
            day = date(2023, 1, 30) + timedelta(days=rng.randint(0, 1 if size > n else 100))
            balance = rng.randint(-5000, 50000) / 100
            if gaps == 1 and rng.random() < 0.3 or gaps == 2 and seq == 0:
                balance = None
            rows.append(
                (f"c{c}", seq, day.isoformat(), rng.choice(["Salary", "Rent", "Loan", "x"]),
                 rng.randint(1, 400000) / 100, rng.choice(["credit", "debit", "unknown"]), balance)
            )
    rng.shuffle(rows)
    return rows


def _brute_balances(rows):
    out = {}
    for customer in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == customer), key=lambda r: (r[2], r[1]))
        if all(r[6] is not None for r in mine):
            out.update({(customer, r[1]): money(r[6]) for r in mine})
            continue
        net = [money(r[4]) * {"credit": 1, "debit": -1}.get(r[5], 0) for r in mine]
        start = Decimal(0) if mine[0][6] is None else money(mine[0][6]) - net[0]
        for r, change in zip(mine, net):
            start += change
            out[(customer, r[1])] = start
    return out


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
def test_inferred_balances_equal_brute_force_for_any_split(spark, span):
    rows = _random_rows(1)
    got = ledger.infer_balances(prepared(spark, rows, span)).collect()
    assert {(r.customer_id, r.seq): r.inferred_balance for r in got} == _brute_balances(rows)


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
def test_balance_features_equal_brute_force_for_any_split(spark, span):
    rows = _random_rows(2)
    brute = _brute_balances(rows)
    got = by_customer(features.bank_features(prepared(spark, rows, span)))
    for customer in {r[0] for r in rows}:
        mine = [v for (c, _), v in brute.items() if c == customer]
        assert got[customer].avg_daily_balance == float(sum(mine)) / len(mine)
        assert got[customer].min_balance == float(min(mine))
        assert got[customer].max_balance == float(max(mine))


def test_order_of_input_does_not_matter(spark):
    rows = _random_rows(3)
    one = features.bank_features(prepared(spark, rows, 5)).orderBy("customer_id").collect()
    two = features.bank_features(prepared(spark, rows[::-1], 5)).orderBy("customer_id").collect()
    for a, b in zip(one, two):
        assert a.asDict() == pytest.approx(b.asDict(), nan_ok=False)


def test_another_tenant_changes_nothing(spark):
    rows = _random_rows(4)
    alone = prepared(spark, rows)
    both = alone.unionByName(alone.withColumn("company_id", F.lit("B")).withColumn("amount", F.col("amount") * 2))
    a = by_customer(features.bank_features(alone))
    b = by_customer(features.bank_features(both).where("company_id = 'A'"))
    for customer in a:
        assert a[customer].asDict() == pytest.approx(b[customer].asDict())


def test_empty_months_count_as_zero(spark):
    rows = [
        ("a", 1, "2023-01-10", "Salary", 3000, "credit", None),
        ("a", 2, "2023-04-10", "Salary", 1000, "credit", None),
        ("b", 1, "2023-01-10", "Salary", 3000, "credit", None),
        ("c", 1, "2023-01-10", "Rent", 100, "debit", None),
        ("d", 1, "2023-01-10", "Salary advance fee", 10, "debit", None),
        ("d", 2, "2023-02-10", "Salary", 400, "credit", None),
    ]
    txn = prepared(spark, rows)
    months = {(r.customer_id, str(r.month)): r.income for r in ledger.monthly_income(txn).collect()}
    assert months[("a", "2023-02-01")] == 0 and months[("a", "2023-03-01")] == 0
    got = by_customer(features.bank_features(txn))
    assert got["a"].avg_monthly_income == 1000.0
    # months 3000, 0, 0, 1000: sample deviation sqrt(2e6)
    assert got["a"].income_consistency == pytest.approx(1 - (2e6) ** 0.5 / 1000)
    assert got["a"].income_volatility == 0.0  # one month above 1000 only
    # a single income month gives no deviation, so consistency 0
    assert (got["b"].avg_monthly_income, got["b"].income_consistency) == (3000.0, 0.0)
    assert (got["c"].has_income, got["c"].avg_monthly_income, got["c"].income_consistency) == (False, 0.0, 0.0)
    # a debit in an income category opens the span with 0 credit
    assert got["d"].avg_monthly_income == 200.0


def test_signs_of_other_types(spark):
    row = ledger.with_amounts(
        prepared(spark, [("a", 1, "2023-01-01", None, 5, "unknown", None)])
    ).first()
    assert (row.credit_amount, row.debit_amount, row.net_change, row.net_flow) == (0, 0, 0, money(-5))
    assert row.category == "Uncategorized"


def test_liquidity_and_behaviour(spark):
    rows = [
        ("a", 1, "2023-01-01", "x", 100, "debit", -50),
        ("a", 2, "2023-01-01", "x", 100, "debit", 150),
        ("a", 3, "2023-02-01", "loan", 400, "credit", None),
        ("b", 1, "2023-01-01", "x", 100, "debit", None),
    ]
    got = by_customer(features.bank_features(prepared(spark, rows)))
    a, b = got["a"], got["b"]
    assert (a.avg_raw_balance, a.min_raw_balance, a.overdraft_rows) == (50.0, -50.0, 1)
    assert a.overdraft_frequency == pytest.approx(1 / 3)
    assert a.emergency_fund_months == 0.5  # 50 / (200 / 2 months)
    assert a.debt_service_ratio == 1.0 and a.debt_payment_count == 1  # credits count as well
    assert (a.max_day_rows, a.avg_day_rows, a.days) == (2, 1.5, 2)
    assert (b.has_balance, b.emergency_fund_months, b.overdraft_frequency) == (False, 0.0, 0.0)
    assert b.cash_flow_variance == 0.0 and b.debt_service_ratio == 0.0


def test_spending_by_category_adds_up(spark):
    txn = prepared(spark, _random_rows(5))
    per = features.spending_by_category(txn).groupBy("customer_id").agg(F.sum("spending").alias("s"))
    total = by_customer(features.bank_features(txn))
    for r in per.collect():
        assert float(r.s) == total[r.customer_id].total_spending


def test_rows_are_shuffled_by_split_and_never_by_customer_alone(spark, capsys):
    """Only chunk totals may be exchanged by customer; rows go by (customer, day, split)."""
    features.bank_features(prepared(spark, _random_rows(6))).select(
        "customer_id", "avg_daily_balance"
    ).explain()
    plan = capsys.readouterr().out
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2, plan
    assert "split" not in exchanges[0] and "split" in exchanges[1] and "txn_date" in exchanges[1]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_large_debits_join_on_the_split(spark, capsys):
    """A hot customer's rows meet their facts per split, not all in one task."""
    from tabia.operators import anomalies

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        anomalies.large_debit_rows(prepared(spark, _random_rows(8))).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert "split" in join, plan
