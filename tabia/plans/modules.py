"""The modules end to end: source tables in, named result tables out (all lazy)."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tabia.operators import anomalies, features, ledger, metrics, narrative, scoring
from tabia.operators.base import Base
from tabia.operators.model import LinearScorer
from tabia.operators.spread import SPLIT_SPAN, attach_tenant, is_small
from tabia.schemas import KEY
from tabia.sources.tenants import currency
from tabia.sources.transactions import complete, dated, latest_crb, one_crb, read_crb

MONEY_NAME = ["currency_preference"]


@dataclass
class Tenants:
    """Parsed tenant settings with the size check that decides about a broadcast.

    Made once per run. Settings found small are kept in memory, as every module
    looks them up.
    """

    settings: DataFrame
    small: bool | None = None

    def __post_init__(self):
        if self.small is None:
            self.settings = self.settings.persist()
            self.small = is_small(self.settings)
            if not self.small:
                self.settings.unpersist()

    def attach(self, rows: DataFrame, *columns: str, salt_by=("customer_id",)) -> DataFrame:
        return attach_tenant(rows, self.settings, list(columns), self.small, salt_by)


def prepared(txn: DataFrame, tenants: Tenants, span: int = SPLIT_SPAN) -> DataFrame:
    """The rows with all required fields and a readable date; ``quarantined`` lists the others."""
    return ledger.prepare(complete(txn)[0], tenants.settings, tenants.small, span)


def stored_base(txn: DataFrame, tenants: Tenants, span: int = SPLIT_SPAN, day_rows=ledger.day_rows) -> Base:
    """The base of unprepared rows: those that ``prepared`` keeps are stored, then categorised."""
    return Base(
        ledger.split_rows(complete(txn)[0], span),
        day_rows=day_rows,
        tag=lambda rows: ledger.tagged(rows, tenants.settings, tenants.small),
    )


def customers_of(txn: DataFrame) -> DataFrame:
    """All customers of an unprepared source, also those without one usable row."""
    return txn.select(*KEY).distinct()


def with_customers(rows: DataFrame, customers: DataFrame | None, count: str) -> DataFrame:
    """A row for each of ``customers``; one without usable transactions has no features and no anomalies."""
    if customers is None:
        return rows
    spine = customers.select(*KEY).distinct()
    return spine.join(rows, list(KEY), "left").withColumn(count, F.coalesce(count, F.lit(0)))


def bureau_records(records: DataFrame) -> DataFrame:
    """The valid bureau records, one of each customer."""
    return read_crb(one_crb(records))[0]


def bank_base(txn: DataFrame) -> Base:
    """A prepared bank source for several modules: they share its stored tables."""
    return Base(txn)


def mobile_base(txn: DataFrame) -> Base:
    return Base(txn, day_rows=features.mobile_day_rows)


def quarantined(bank: DataFrame, records: DataFrame, mobile: DataFrame) -> DataFrame:
    """The input rows that the modules leave out, with the reason, for the caller to store."""
    keys = [F.col(k) for k in KEY]

    def unusable(txn, source):
        full, lacking = complete(txn)
        undated = dated(full)[1].select(*keys, "seq", F.lit("unparsable date").alias("reason"))
        lacking = lacking.select(*keys, "seq", F.lit("required field missing").alias("reason"))
        return undated.unionByName(lacking).select(F.lit(source).alias("source"), "*")

    def left_out(rows, reason):
        return rows.select(
            F.lit("crb").alias("source"), *keys, F.lit(None).cast("bigint").alias("seq"), reason.alias("reason")
        )

    kept, others = latest_crb(records)
    refused = left_out(read_crb(kept)[1], F.lit("missing or out of range"))
    return (
        unusable(bank, "bank")
        .unionByName(unusable(mobile, "mobile"))
        .unionByName(refused)
        .unionByName(left_out(others, F.col("reason")))
    )


def bank_features(txn: DataFrame | Base, customers: DataFrame | None = None) -> DataFrame:
    """Bank features with the module's own anomaly count, for all ``customers`` where they are given."""
    rows = anomalies.with_bank_count(features.bank_features(txn), txn)
    return with_customers(rows, customers, "bank_anomalies")


def mobile_features(txn: DataFrame | Base, customers: DataFrame | None = None) -> DataFrame:
    rows = anomalies.with_mobile_count(features.mobile_features(txn), txn)
    return with_customers(rows, customers, "mobile_anomalies")


def bureau_features(records: DataFrame) -> DataFrame:
    return anomalies.with_bureau_count(features.bureau_features(bureau_records(records)))


def bank_score(
    txn: DataFrame | Base, tenants: Tenants, customers: DataFrame | None = None
) -> DataFrame:
    """With ``customers`` (``customers_of`` the unprepared rows) nobody is missing for want of a usable row."""
    return scoring.bank_score(bank_features(txn, customers), tenants.settings, tenants.small)


def bureau_score(records: DataFrame, tenants: Tenants) -> DataFrame:
    return scoring.bureau_score(bureau_features(records), tenants.settings, tenants.small)


def mobile_score(
    txn: DataFrame | Base, tenants: Tenants, customers: DataFrame | None = None
) -> DataFrame:
    return scoring.mobile_score(mobile_features(txn, customers), tenants.settings, tenants.small)


def unified_features(
    bank: DataFrame | Base,
    records: DataFrame,
    mobile: DataFrame | Base,
    bank_customers: DataFrame | None = None,
    mobile_customers: DataFrame | None = None,
) -> DataFrame:
    """Combined features with all anomaly counts, from prepared transactions.

    A source counts as present for all its customers, where these are given.
    """
    return anomalies.with_cross_count(
        features.unified_features(
            bank_features(bank, bank_customers),
            bureau_features(records),
            mobile_features(mobile, mobile_customers),
        )
    )


def unified_score(
    bank: DataFrame | Base,
    records: DataFrame,
    mobile: DataFrame | Base,
    tenants: Tenants,
    scorer: LinearScorer | None = None,
    bank_customers: DataFrame | None = None,
    mobile_customers: DataFrame | None = None,
) -> DataFrame:
    """Combined score with summary and localisation.

    With a ``scorer`` the rules start from its prediction, kept in ``base_score``,
    and ``score_explanation`` holds its factors; else they start from 500.
    """
    rows = unified_features(bank, records, mobile, bank_customers, mobile_customers)
    if scorer is not None:
        rows = rows.withColumns(
            {"base_score": scorer.prediction(), "score_explanation": scorer.contributions()}
        )
    scored = scoring.unified_score(
        rows,
        tenants.settings,
        tenants.small,
        None if scorer is None else F.col("base_score"),
        keep=("currency_preference", "language_preference", "timezone"),
    )
    return scored.withColumns(
        {
            "analysis_summary": narrative.unified_summary(currency()),
            "localization_details": narrative.localisation(),
        }
    ).drop("currency_preference", "language_preference", "timezone")


def bank_metrics(txn: DataFrame | Base, tenants: Tenants) -> DataFrame:
    table = tenants.attach(features.bank_features(txn), *MONEY_NAME)
    return (
        metrics.base_metrics(table, currency())
        .unionByName(metrics.spending_metrics(txn))
        .unionByName(metrics.bank_metrics(table, currency()))
    )


def transaction_anomalies(txn: DataFrame | Base, tenants: Tenants, source: str) -> DataFrame:
    """Row- and day-level anomalies of one transaction source."""
    rows = tenants.attach(anomalies.large_debit_rows(txn), *MONEY_NAME, salt_by=("customer_id", "seq"))
    return anomalies.large_debit_lines(rows, source, currency()).unionByName(
        anomalies.busy_days(txn, source)
    )


def bank_anomalies(txn: DataFrame | Base, tenants: Tenants) -> DataFrame:
    table = tenants.attach(features.bank_features(txn), *MONEY_NAME)
    return transaction_anomalies(txn, tenants, "bank").unionByName(
        anomalies.bank_anomalies(table, currency())
    )


def bureau_anomalies(records: DataFrame) -> DataFrame:
    return anomalies.bureau_anomalies(features.bureau_features(bureau_records(records)))


def all_anomalies(
    bank: DataFrame | Base, records: DataFrame, mobile: DataFrame | Base, tenants: Tenants
) -> DataFrame:
    return (
        bank_anomalies(bank, tenants)
        .unionByName(bureau_anomalies(records))
        .unionByName(transaction_anomalies(mobile, tenants, "mobile"))
        .unionByName(anomalies.cross_anomalies(unified_features(bank, records, mobile)))
    )


def all_metrics(
    bank: DataFrame | Base, records: DataFrame, mobile: DataFrame | Base, tenants: Tenants
) -> DataFrame:
    crb = features.bureau_features(bureau_records(records))
    mobile_rows = features.mobile_features(mobile)
    unified = features.unified_features(features.bank_features(bank), crb, mobile_rows)
    return (
        bank_metrics(bank, tenants)
        .unionByName(metrics.bureau_metrics(crb))
        .unionByName(metrics.mobile_metrics(tenants.attach(mobile_rows, *MONEY_NAME), currency()))
        .unionByName(metrics.cross_metrics(unified))
    )


def all_transactions(bank: DataFrame, mobile: DataFrame) -> DataFrame:
    """Categorised transactions of both sources with inferred bank balances."""
    columns = (*KEY, "seq", "txn_date", "description", "amount", "type", "category")
    b = ledger.infer_balances(bank).select(
        F.lit("bank").alias("source"), *columns, F.col("inferred_balance").alias("balance_after")
    )
    m = ledger.infer_balances(mobile).select(
        F.lit("mobile").alias("source"), *columns, F.col("inferred_balance").alias("balance_after")
    )
    return b.unionByName(m)
