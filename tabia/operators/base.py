"""One transaction source, stored in small tables that every module reads.

The source is read once: its rows are written with the columns that the tables
below need. From them follow a row per customer and day, the totals of each
customer, which give the features and the daily debit mean, the spending per
category, and the debits that are unusually large for the customer, which need
that mean. Bank day rows are wide; they flow into the totals without being
written, and the busy days are counted from the rows.
"""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType

from tabia.functions.values import ratio
from tabia.operators import ledger
from tabia.operators.spread import SPLIT_SPAN
from tabia.schemas import KEY
from tabia.session import written

LARGE_DEBIT_FACTOR = 3
LARGE_DEBIT_FLOOR = 1000
ROW_COLUMNS = ("split", "seq", "txn_date", "type", "description", "amount", "balance_after")
TAGS = ("category", "is_debt")
#: Amounts and balances of a source, added without signs, below which every sum of them fits 64 bits in cents.
CENTS_LIMIT = 1e16
#: Customers are counted in so many classes of their ids, which bounds the rows of each from above.
CUSTOMER_CLASSES = 1 << 16
#: The rows of a customer that may meet in one task, those of a split.
CUSTOMER_ROWS = SPLIT_SPAN


class Base:
    """The tables of a source, each written when it is first asked for.

    The rows are prepared, or ``tag`` prepares their stored form further. Rows that
    are derived from several tables are better tagged when they are stored: with all
    in one stage the generated method is too long to be compiled.
    """

    def __init__(
        self, txn: DataFrame, keys=KEY, day_rows: Callable = ledger.day_rows, tag: Callable | None = None
    ):
        self.txn, self.keys = txn, tuple(keys)
        self._day_rows, self._tag = day_rows, tag
        self._tables: dict[str, DataFrame] = {}

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name, written the first time."""
        if name not in self._tables:
            self._tables[name] = written(make())
        return self._tables[name]

    @property
    def stored_rows(self) -> DataFrame:
        tags = TAGS if self._tag is None else ()
        return self.stored("rows", lambda: self.txn.select(*self.keys, *ROW_COLUMNS, *tags))

    @property
    def rows(self) -> DataFrame:
        rows = self.stored_rows
        return ledger.with_amounts(rows) if self._tag is None else self._tag(rows)

    @cached_property
    def _measured(self) -> tuple[int, float]:
        """From one pass over all rows: most rows of a class of customers, amounts and balances without signs."""
        money = ("amount", "balance_after")
        kinds = [self.stored_rows.schema[c].dataType for c in money]
        sizes = [F.coalesce(F.sum(F.abs(F.col(c).cast("double"))), F.lit(0.0)) for c in money]
        exact = all(isinstance(k, DecimalType) and k.scale <= 2 for k in kinds)
        classes = self.stored_rows.groupBy(F.pmod(F.xxhash64(*self.keys), F.lit(CUSTOMER_CLASSES)).alias("class")).agg(
            F.count(F.lit(1)).alias("n"), (sizes[0] + sizes[1] if exact else F.lit(CENTS_LIMIT)).alias("size")
        )
        most, size = classes.agg(F.max("n"), F.sum("size")).first()
        return most or 0, size or (0.0 if exact else CENTS_LIMIT)

    @property
    def cents(self) -> bool:
        """Whether amounts may be summed as whole cents; taken from all rows."""
        return self._measured[1] < CENTS_LIMIT

    @property
    def narrow(self) -> bool:
        """Whether no customer has more rows than one task may hold, so that splits are not needed."""
        return self._measured[0] <= CUSTOMER_ROWS

    @property
    def chained(self) -> bool:
        """Whether the day rows carry running balances, as those of a bank do."""
        return self._day_rows is ledger.day_rows

    def daily(self) -> DataFrame:
        """The day rows, computed anew where they are not stored."""
        if "days" in self._tables:
            return self._tables["days"]
        more = {"cents": self.cents, "narrow": self.narrow} if self.chained else {}
        return self._day_rows(self.rows, self.keys, **more)

    @property
    def days(self) -> DataFrame:
        return self.stored("days", self.daily)

    @property
    def day_counts(self) -> DataFrame:
        """(customer, day) with the number of rows ``n``."""
        if not self.chained:
            return self.days
        return self.rows.groupBy(*self.keys, "txn_date").agg(F.count(F.lit(1)).alias("n"))

    @property
    def spending(self) -> DataFrame:
        """(customer, category) with the spending, of customers with all ids; summed before the shuffle."""
        known = self.rows.dropna(subset=[*self.keys, "split"])
        return self.stored(
            "spending",
            lambda: known.groupBy(*self.keys, "category").agg(
                F.sum("debit_amount").cast("decimal(38,2)").alias("spending")
            ),
        )

    def large(self, means: Callable[[], DataFrame]) -> DataFrame:
        """The debits that are unusually large for their customer; only debits above the floor are dealt.

        ``means`` gives each customer's debits and their daily mean.
        """
        keys = self.keys

        def facts():
            if self.narrow:
                return means()
            return self.rows.select(*keys, "split").distinct().join(means(), list(keys))

        return self.stored("large", lambda: large_rows(
            self.stored_rows.select(*keys, "split", "seq", "txn_date", "description", "amount", "type"), facts(), keys,
        ).select(*keys, "avg_daily_debit", "debit", "seq", "txn_date", "description", "amount"))


def days_of(source: DataFrame | Base, keys=KEY) -> DataFrame:
    return source.days if isinstance(source, Base) else ledger.day_rows(source, keys)


def debit_days(txn: DataFrame, keys=KEY) -> DataFrame:
    """What the daily debit mean needs, for a source that is read once: a row per (customer, day)."""
    is_debit = F.col("type") == "debit"
    return txn.groupBy(*keys, "txn_date").agg(
        F.sum(F.when(is_debit, F.col("amount"))).alias("debit"),
        F.count(F.when(is_debit, 1)).alias("debit_rows"),
        F.collect_set("split").alias("splits"),
    )


def listed_splits(days: DataFrame, keys=KEY) -> DataFrame:
    return days.select(*keys, F.explode("splits").alias("split")).distinct()


def mean_debits(days: DataFrame, keys=KEY) -> DataFrame:
    """(customer) with the debits and their mean over the days that have one."""
    total = F.sum("debit")
    return days.groupBy(*keys).agg(
        ratio(total, F.count_if(F.col("debit_rows") > 0)).alias("avg_daily_debit"), total.alias("debit")
    )


def split_facts(days: DataFrame, splits: DataFrame, keys=KEY) -> DataFrame:
    """(customer, split) with the customer's debits and their daily mean.

    A copy for each split that occurs, so that rows meet them without a hot key.
    """
    return splits.join(mean_debits(days, keys), list(keys))


def is_large(amount, mean, total):
    """Above the customer's mean daily debit times three; the floor is checked before."""
    return (total > 0) & (amount.cast("double") > mean * LARGE_DEBIT_FACTOR)


def large_rows(txn: DataFrame, facts: DataFrame, keys=KEY) -> DataFrame:
    """Debits above the floor and far above the customer's mean; a (customer, split) has ``span`` rows at most.

    ``facts`` without splits are joined by customer; as with them, a row needs a split.
    """
    big = txn.where((F.col("type") == "debit") & (F.col("amount") > LARGE_DEBIT_FLOOR) & F.col("split").isNotNull())
    on = [*keys, "split"] if "split" in facts.columns else list(keys)
    return big.join(facts, on).where(
        is_large(F.col("amount"), F.col("avg_daily_debit"), F.col("debit"))
    )
