"""Small hand-made inputs."""

from decimal import Decimal

from tabia.operators import ledger

TXN = (
    "company_id string, customer_id string, seq bigint, date string, description string,"
    " amount decimal(18,2), type string, balance_after decimal(18,2)"
)


def money(value):
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def txn_rows(rows, company="A"):
    """rows of (customer, seq, date, description, amount, type, balance)."""
    return [(company, c, s, d, t, money(a), k, money(b)) for c, s, d, t, a, k, b in rows]


def transactions(spark, rows, company="A"):
    return spark.createDataFrame(txn_rows(rows, company), TXN)


def prepared(spark, rows, span=1 << 20, tenants=None):
    return ledger.prepare(transactions(spark, rows), tenants, True, span)


def by_customer(frame):
    return {r["customer_id"]: r for r in frame.collect()}
