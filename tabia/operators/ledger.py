"""Transactions -> chunk totals -> chained chunks of every customer.

The rows are shuffled once, by (customer, day, split): a group holds at most
``span`` rows, also for a customer that owns a third of the table. Everything
that needs the order of a customer's rows (running balances) is solved inside
the chunk and chained in two levels over chunk totals, which are shuffled by
customer: first the splits of a day, then the days of the customer. No window
is longer than the splits of one day or the days of one customer.

Amounts may be summed as whole cents in 64 bits, which is several times faster
than sums of decimals. The caller says so where it knows that they fit; the day
rows then hold cents, and ``money`` gives the decimals back.

Which columns are computed depends on what a caller selects: unused sums and
the running-balance window are pruned from the plan.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from tabia.functions.text import DEBT_WORDS, category, contains_any, lowered
from tabia.functions.values import month_of
from tabia.operators.spread import SPLIT_SPAN, attach_tenant, with_split
from tabia.schemas import KEY
from tabia.sources.transactions import dated

# Order inside a chunk; the amounts only matter for input whose ``seq`` repeats.
ROW_ORDER = ("seq", "net_change", "balance_after")
INCOME_FLOOR = 1000  # a credit above this counts as income from any source


def money(condition: Column, amount: str = "amount") -> Column:
    return F.when(condition, F.col(amount)).otherwise(F.lit(0)).cast("decimal(18,2)")


def with_amounts(txn: DataFrame) -> DataFrame:
    """credit_amount, debit_amount, net_change (other types 0) and net_flow (others negative)."""
    is_credit = F.coalesce(F.col("type") == "credit", F.lit(False))
    is_debit = F.coalesce(F.col("type") == "debit", F.lit(False))
    return txn.withColumns(
        {
            "credit_amount": money(is_credit),
            "debit_amount": money(is_debit),
            "net_change": F.when(is_credit, F.col("amount"))
            .when(is_debit, -F.col("amount"))
            .otherwise(F.lit(0))
            .cast("decimal(18,2)"),
            "net_flow": F.when(is_credit, F.col("amount")).otherwise(-F.col("amount")),
        }
    )


def is_debt(text: Column) -> Column:
    return contains_any(text, DEBT_WORDS)


def prepare(
    txn: DataFrame, tenants: DataFrame | None, small: bool = True, span: int = SPLIT_SPAN
) -> DataFrame:
    """Dated, split, categorised transactions with signed amounts and a debt flag.

    The lower-cased description is a column of its own, so it is made once per
    row and not once per keyword. Without ``tenants`` every customer gets the default category rules.
    """
    return tagged(split_rows(txn, span), tenants, small)


def split_rows(txn: DataFrame, span: int = SPLIT_SPAN) -> DataFrame:
    """The rows with a readable date, and their split."""
    return dated(with_split(txn, span))[0]


def tagged(rows: DataFrame, tenants: DataFrame | None, small: bool = True) -> DataFrame:
    """Split rows with category, signed amounts and a debt flag."""
    if tenants is None:
        rules = F.lit(None).cast("array<struct<category:string,keywords:array<string>>>")
    else:
        rows = attach_tenant(
            rows, tenants, ["transaction_categorization_rules"], small, ("customer_id", "seq")
        )
        rules = F.col("transaction_categorization_rules")
    text = F.col("_text")
    tagged = rows.withColumn("_text", lowered(F.col("description"))).withColumns(
        {"category": category(text, rules), "is_debt": is_debt(text)}
    )
    return with_amounts(tagged).drop("transaction_categorization_rules", "_text")


def holds_cents(totals: DataFrame) -> bool:
    """Whether the sums of chunk, day or customer rows are whole cents."""
    return isinstance(totals.schema["net"].dataType, LongType)


def money_sum(value: Column, cents: bool) -> Column:
    """A sum of amounts as the decimal it has without cents."""
    return (value.cast("decimal(38,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)") if cents else value


def by_customer(keys=KEY) -> list[str]:
    """The keys, the customer first: a sort compares the first bytes of its first column at once, and tenants are few."""
    return list(reversed(keys))


def flagged(txn: DataFrame, keys=KEY, cents: bool = False) -> DataFrame:
    """What the sums below need of a row. Texts are turned into flags before the shuffle, so only numbers travel."""

    def flag(condition: Column, name: str) -> Column:
        return F.coalesce(condition, F.lit(False)).alias(name)

    def number(name: str) -> Column:
        return (F.col(name) * 100).cast("bigint").alias(name) if cents else F.col(name)

    return txn.select(
        *keys,
        "txn_date",
        "split",
        "seq",
        number("amount"),
        number("balance_after"),
        number("net_change"),
        flag(F.col("type") == "credit", "is_credit"),
        flag(F.col("type") == "debit", "is_debit"),
        flag(F.col("category") == "income", "is_income"),
        flag(F.col("category") == "savings", "is_savings"),
        flag(F.col("category") == "loan_repayment", "is_loan"),
        "is_debt",
    )


def running(rows: DataFrame, order) -> DataFrame:
    """Rows with the running net change ``run`` and their ``place`` in a window's order."""
    return rows.withColumns(
        {
            "run": F.sum("net_change").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "place": F.row_number().over(order),
        }
    )


def row_sums(cents: bool) -> list[Column]:
    """Order-free sums and running extremes of flagged rows."""
    amount, balance = F.col("amount"), F.col("balance_after")
    credit, debit, income = F.col("is_credit"), F.col("is_debit"), F.col("is_income")
    debt, big_credit = F.col("is_debt"), credit & (amount > (INCOME_FLOOR * 100 if cents else INCOME_FLOOR))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, amount))

    return [
        F.count(F.lit(1)).alias("n"),
        total(credit).alias("credit"),
        total(debit).alias("debit"),
        F.count_if(debit).alias("debit_rows"),
        F.sum(F.when(credit, amount).otherwise(-amount)).alias("flow"),
        total(income & credit).alias("income"),
        F.count_if(income).alias("income_n"),
        total(F.col("is_savings") & credit).alias("savings"),
        total(F.col("is_loan") & debit).alias("loans"),
        total(big_credit).alias("big_credit"),
        F.count_if(big_credit).alias("big_credit_n"),
        total(debt).alias("debt"),
        F.count_if(debt).alias("debt_n"),
        F.sum("balance_after").alias("balance"),
        F.count("balance_after").alias("balance_n"),
        F.min("balance_after").alias("balance_min"),
        F.max("balance_after").alias("balance_max"),
        F.count_if(balance < 0).alias("overdrawn_n"),
        F.sum("net_change").alias("net"),
        # a sum of sums may pass 64 bits
        F.sum(F.col("run").cast("decimal(19,0)") if cents else F.col("run")).alias("run_sum"),
        F.min("run").alias("run_min"),
        F.max("run").alias("run_max"),
    ]


def chunk_totals(txn: DataFrame, keys=KEY, cents: bool = False) -> DataFrame:
    """One row per (customer, day, split) with order-free sums and running extremes."""
    inside = Window.partitionBy(*by_customer(keys), "txn_date", "split").orderBy(*ROW_ORDER)
    first = F.col("place") == 1
    return running(flagged(txn, keys, cents), inside).groupBy(*keys, "txn_date", "split").agg(
        *row_sums(cents),
        F.max(F.when(first, F.col("balance_after"))).alias("first_balance"),
        F.max(F.when(first, F.col("net_change"))).alias("first_net"),
    )


def carried_in_day(chunks: DataFrame, keys=KEY) -> DataFrame:
    """Chunk totals, dealt by customer, with ``before``: the net change of the day's earlier splits."""
    earlier = Window.partitionBy(*by_customer(keys), "txn_date").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint" if holds_cents(chunks) else "decimal(38,2)")
    return chunks.repartition(*keys).withColumn("before", F.coalesce(F.sum("net").over(earlier), zero))


# What adds up over the chunks of a day.
SUMS = (
    "n", "credit", "debit", "debit_rows", "flow", "income", "income_n", "savings", "loans", "big_credit",
    "big_credit_n", "debt", "debt_n", "balance", "balance_n", "overdrawn_n", "net",
)


def narrow_day_rows(txn: DataFrame, keys=KEY) -> DataFrame:
    """``day_rows`` in cents where no customer is too large for a task: the rows are dealt by customer at once.

    The order of a day's rows starts with the split, so chaining the splits is the same as running on.
    A row without a split has a place, but is nobody's first row.
    """
    day = Window.partitionBy(*by_customer(keys), "txn_date").orderBy("split", *ROW_ORDER)
    place = F.when(F.col("split").isNotNull(), F.col("place"))
    return running(flagged(txn, keys, True).repartition(*keys), day).groupBy(*keys, "txn_date").agg(
        *row_sums(True),
        F.min_by("balance_after", place).alias("first_balance"),
        F.min_by("net_change", place).alias("first_net"),
    )


def day_rows(txn: DataFrame, keys=KEY, cents: bool = False, narrow: bool = False) -> DataFrame:
    """One row per (customer, day): sums and running extremes from the day's start.

    The splits of a day are chained here, so that what follows knows days only.
    Dealt by customer; the chunk totals are exchanged once, and not at all for sums in cents where the
    caller knows that no customer has more rows than a task may hold (``narrow``).
    """
    if cents and narrow:
        return narrow_day_rows(txn, keys)
    before = F.col("before")
    carried = before.cast("decimal(19,0)") if cents else before
    return (
        carried_in_day(chunk_totals(txn, keys, cents), keys)
        .groupBy(*keys, "txn_date")
        .agg(
            *[F.sum(c).alias(c) for c in SUMS],
            F.min("balance_min").alias("balance_min"),
            F.max("balance_max").alias("balance_max"),
            F.sum(carried * F.col("n") + F.col("run_sum")).alias("run_sum"),
            F.min(before + F.col("run_min")).alias("run_min"),
            F.max(before + F.col("run_max")).alias("run_max"),
            F.min_by("first_balance", "split").alias("first_balance"),
            F.min_by("first_net", "split").alias("first_net"),
        )
    )


def in_order(keys=KEY):
    """A customer's days in time order. The month leads, so that the windows over
    customer and month below run on one sort."""
    return Window.partitionBy(*by_customer(keys)).orderBy("month", "txn_date")


def customer_days(days: DataFrame, keys=KEY) -> DataFrame:
    """Day rows chained over the customer: net change carried into each, its place, sums of its month."""
    order = in_order(keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    month = Window.partitionBy(*by_customer(keys), "month")
    zero = F.lit(0).cast("bigint" if holds_cents(days) else "decimal(38,2)")
    return days.withColumn("month", month_of(F.col("txn_date"))).withColumns(
        {
            "carried": F.coalesce(F.sum("net").over(before), zero),
            "nth": F.row_number().over(order),
            "month_head": ~F.lag("month").over(order).eqNullSafe(F.col("month")),
            "month_income": F.sum("income").over(month),
            "month_income_n": F.sum("income_n").over(month),
            "month_big": F.sum("big_credit").over(month),
            "month_big_n": F.sum("big_credit_n").over(month),
        }
    )


def infer_balances(txn: DataFrame, keys=KEY) -> DataFrame:
    """Every transaction with ``inferred_balance``.

    A customer without gaps keeps the given balances. One missing balance makes
    all of that customer's balances recomputed: from the first balance where it
    is known, else from zero.
    """
    keys = list(keys)
    chunk = [*keys, "txn_date", "split"]
    inside = Window.partitionBy(*chunk).orderBy(*ROW_ORDER)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = txn.withColumn("run", F.sum("net_change").over(running))
    # no order needed here, so these totals combine before the shuffle
    totals = txn.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("balance_after").alias("balance_n"),
        F.sum("net_change").alias("net"),
        F.min_by("balance_after", "seq").alias("first_balance"),
        F.min_by("net_change", "seq").alias("first_net"),
    )
    splits = carried_in_day(totals, keys)
    days = splits.groupBy(*keys, "txn_date").agg(
        F.sum("net").alias("net"),
        F.sum(F.col("n") - F.col("balance_n")).alias("missing"),
        F.min_by("first_balance", "split").alias("first_balance"),
        F.min_by("first_net", "split").alias("first_net"),
    )
    order = Window.partitionBy(*keys).orderBy("txn_date")
    whole = Window.partitionBy(*keys)
    zero = F.lit(0).cast("decimal(38,2)")
    first = F.when(F.col("nth") == 1, F.col("first_balance") - F.col("first_net"))
    chained = days.withColumns(
        {
            "carried": F.coalesce(F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero),
            "nth": F.row_number().over(order),
            "gaps": F.sum("missing").over(whole),
        }
    ).withColumn("opening", F.coalesce(F.max(first).over(whole), zero))
    openings = splits.join(chained.select(*keys, "txn_date", "gaps", "opening", "carried"), [*keys, "txn_date"]).select(
        *chunk, "gaps", (F.col("opening") + F.col("carried") + F.col("before")).alias("opening")
    )
    return (
        rows.join(openings, chunk)
        .withColumn(
            "inferred_balance",
            F.when(F.col("gaps") == 0, F.col("balance_after")).otherwise(
                F.col("opening") + F.col("run")
            ),
        )
        .drop("run", "gaps", "opening")
    )


def monthly_income(txn: DataFrame, keys=KEY) -> DataFrame:
    """Income per customer and month, empty months between first and last as 0."""
    keys = list(keys)
    per_month = (
        txn.where(F.col("category") == "income")
        .groupBy(*keys, month_of(F.col("txn_date")).alias("month"))
        .agg(F.sum("credit_amount").alias("income"))
    )
    spine = (
        per_month.groupBy(*keys)
        .agg(F.min("month").alias("first"), F.max("month").alias("last"))
        .select(
            *keys, F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("month")
        )
    )
    return spine.join(per_month, [*keys, "month"], "left").withColumn(
        "income", F.coalesce("income", F.lit(0).cast("decimal(28,2)"))
    )
