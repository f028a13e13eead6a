"""Keeping one hot customer or tenant from landing in one task.

``seq`` is the position of a transaction in its customer's input and unique
per customer. ``split = seq div span`` therefore cuts a customer into pieces of
at most ``span`` rows without looking at the data, and it keeps the order:
pieces of one day can be summed apart and chained afterwards.
"""

from pyspark.sql import DataFrame, functions as F

SPLIT_SPAN = 1 << 20

# A side is broadcast only when it was counted and is below both limits.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 64 * 1024 * 1024
TENANT_COPIES = 64


def with_split(txn: DataFrame, span: int = SPLIT_SPAN) -> DataFrame:
    return txn.withColumn("split", F.expr(f"seq div {int(span)}"))


def is_small(side: DataFrame) -> bool:
    """Counts rows and characters of a candidate broadcast side, stopping early."""
    sample = side.limit(BROADCAST_ROWS + 1)
    n, chars = sample.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    ).first()
    return n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS


def attach_tenant(
    rows: DataFrame, tenants: DataFrame, columns, small: bool, salt_by=("customer_id",)
) -> DataFrame:
    """Left join of rows to per-tenant settings.

    ``small`` is the result of ``is_small(tenants)``, taken once per run. Above
    the limit each tenant is copied under TENANT_COPIES salts and the rows are
    spread over them, so a tenant with a third of all rows is not one task.
    """
    settings = tenants.select("company_id", *columns)
    if small:
        return rows.join(F.broadcast(settings), "company_id", "left")
    salted = rows.withColumn(
        "_salt", F.pmod(F.xxhash64(*salt_by), F.lit(TENANT_COPIES)).cast("int")
    )
    copies = settings.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(TENANT_COPIES - 1)))
    )
    return salted.join(copies, ["company_id", "_salt"], "left").drop("_salt")
