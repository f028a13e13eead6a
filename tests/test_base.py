"""The stored base: read once, and with the same features in cents as in decimals."""

import random

import pytest
from pyspark.sql import functions as F

from tabia.operators import anomalies, features
from tabia.operators.base import Base
from tests.helpers import prepared

KEYS = ["company_id", "customer_id"]


def _rows(seed, factor=1.0):
    rng = random.Random(seed)
    return [
        (f"c{c}", seq, f"2023-0{rng.randint(1, 3)}-0{rng.randint(1, 5)}", rng.choice(["Salary", "Rent", "Loan payment"]),
         round(rng.randint(1, 900000) * factor) / 100, rng.choice(["credit", "debit", "debit", "unknown"]),
         None if c == 1 and seq % 3 == 0 else rng.randint(-5000, 50000) / 100)
        for c in range(4) for seq in range(60)
    ]


def _all(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_a_base_reads_its_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = _rows(1)
    txn = prepared(spark, rows)
    base = Base(txn.mapInArrow(counted, txn.schema))
    features.bank_features(base).collect()
    features.spending_by_category(base).collect()
    anomalies.large_debit_rows(base).collect()
    assert read.value == len(rows)


@pytest.mark.parametrize("span", [7, 1 << 20])
@pytest.mark.parametrize("factor, cents", [(1.0, True), (1e11, False)])
def test_cents_give_the_features_of_decimals(spark, span, factor, cents):
    """Amounts whose sums may pass 64 bits in cents stay decimals; both ways equal the plan without a base."""
    txn = prepared(spark, _rows(2, factor), span)
    base = Base(txn)
    assert base.cents == cents
    assert features.customer_totals(base).schema.simpleString() == features.customer_totals(txn).schema.simpleString()
    assert _all(features.bank_features(base)) == _all(features.bank_features(txn))
    columns = [*KEYS, "seq", "avg_daily_debit", F.col("debit").cast("decimal(38,2)")]
    assert _all(anomalies.large_debit_rows(base).select(*columns)) == _all(anomalies.large_debit_rows(txn).select(*columns))


def test_bank_day_rows_flow_into_the_totals_unwritten(spark):
    """Also the busy days do without them, and sorts start with the customer, who tells more rows apart."""
    txn = prepared(spark, _rows(3), 7)
    base = Base(txn)
    features.bank_features(base).collect()
    assert _all(anomalies.busy_days(base, "bank")) == _all(anomalies.busy_days(txn, "bank"))
    anomalies.large_debit_rows(base).collect()
    assert sorted(base._tables) == ["large", "rows", "totals"]
    assert "Sort [customer_id" in base.daily()._jdf.queryExecution().executedPlan().toString()


def _odd(seed):
    """Rows of which some have no position and so no split, some come twice, and some share a day and a position."""
    rows = _rows(seed)
    rows += [(*r[:1], None, *r[2:]) for r in rows[::9]] + rows[::7] + [(*r[:4], r[4] + 1, *r[5:]) for r in rows[::11]]
    return rows


@pytest.mark.parametrize("span", [7, 1 << 20])
@pytest.mark.parametrize("make", [_rows, _odd])
def test_customers_that_fit_a_task_are_dealt_once(spark, monkeypatch, make, span):
    """The rows are exchanged by customer alone, and the results are those of splits, which larger customers still get."""
    from tabia.operators import base as module

    rows = prepared(spark, [*make(4), ("c0", 1000, "2023-01-02", "Rent", 1e6, "debit", None)], span)
    whole, cut = Base(rows), Base(rows)
    assert whole.narrow and whole.cents
    plan = whole.daily()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    found = [_all(features.customer_totals(whole)), _all(anomalies.large_debit_rows(whole))]
    monkeypatch.setattr(module, "CUSTOMER_ROWS", 20)
    assert not cut.narrow
    assert cut.daily()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert [_all(features.customer_totals(cut)), _all(anomalies.large_debit_rows(cut))] == found
    assert found[1]
