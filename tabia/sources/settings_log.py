"""The tenant settings log in storage: batches of updates, and snapshots that spare reading all of them.

A snapshot holds, for each tenant and setting, the last value with its version,
which is all that later updates need: folding a snapshot with the batches after
it gives the same as folding the whole log. A snapshot counts once a row in
``commits`` names it, so a job lost while it is written leaves the earlier one
in force.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabia.sources.tenants import SETTINGS, encoded

TYPES = {"is_active": "boolean", "max_file_size_mb": "int"}
BATCH, UPTO = "batch", "upto"
#: The number of the empty batch and snapshot that a new log starts with.
FIRST = -1


def _type(name: str) -> str:
    return TYPES.get(name, "string")


UPDATE_FIELDS = "company_id string, version bigint, " + ", ".join(f"{c} {_type(c)}" for c in SETTINGS)
STATE_FIELDS = "company_id string, version bigint, " + ", ".join(
    f"{c} struct<version: bigint, value: {_type(c)}>" for c in SETTINGS
)


def _dated_value(name: str) -> Column:
    """A setting with its version, NULL where the update leaves it out."""
    value = F.col(name)
    return F.when(value.isNotNull(), F.struct(F.col("version"), value.alias("value"))).alias(name)


def state_of(updates: DataFrame) -> DataFrame:
    """Updates as rows of the shape of a snapshot."""
    return updates.select("company_id", "version", *[_dated_value(c) for c in SETTINGS])


def merged(states: DataFrame) -> DataFrame:
    """One row of each tenant with the latest value of each setting; of equal versions the larger value.

    Maxima are combined before the shuffle, so a tenant with many updates is no hot task.
    """
    return states.groupBy("company_id").agg(
        F.max("version").alias("version"), *[F.max(c).alias(c) for c in SETTINGS]
    )


class SettingsLog:
    """Updates under ``log/batch=<n>``, snapshots under ``snapshots/upto=<n>``; both replaced on replay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> "SettingsLog":
        """A new log without updates."""
        log = cls(spark, path)
        spark.createDataFrame([], UPDATE_FIELDS).write.parquet(log._batch(FIRST))
        spark.createDataFrame([], STATE_FIELDS).write.parquet(log._snapshot(FIRST))
        log._commit(FIRST)
        return log

    def append(self, updates: DataFrame, batch: int) -> None:
        """Stores a batch of partial updates; columns that it lacks count as left out.

        Batches are numbered upward, as those of a stream are. The replay of a
        batch replaces it, and does nothing once a snapshot covers it.
        """
        if batch <= self.covered():
            return
        rows = encoded(updates)
        there = set(rows.columns)
        rows.select(
            "company_id",
            F.col("version").cast("bigint").alias("version"),
            *[(F.col(c) if c in there else F.lit(None)).cast(_type(c)).alias(c) for c in SETTINGS],
        ).write.mode("overwrite").parquet(self._batch(batch))

    def compact(self, upto: int) -> None:
        """A snapshot of all batches up to ``upto``, from the snapshot in force and the batches after it.

        Nothing to do if a snapshot covers them. All batches up to ``upto`` must be there.
        """
        covered = self.covered()
        if upto > covered:
            merged(self._states(covered, upto)).write.mode("overwrite").parquet(self._snapshot(upto))
            self._commit(upto)

    def current(self) -> DataFrame:
        """Per tenant the last value of each setting, as ``current_settings`` gives it for the whole log."""
        last = merged(self._states(self.covered()))
        return last.select("company_id", "version", *[F.col(c)["value"].alias(c) for c in SETTINGS])

    def covered(self) -> int:
        """The last batch of the snapshot in force: one number of a table with a row for each snapshot."""
        return self.spark.read.schema(f"{UPTO} bigint").parquet(f"{self.path}/commits").agg(F.max(UPTO)).first()[0]

    def tail(self, after: int, upto: int | None = None) -> DataFrame:
        """The updates of the batches after ``after``: the others' folders are not read."""
        rows = (
            self.spark.read.schema(f"{UPDATE_FIELDS}, {BATCH} bigint")
            .option("basePath", f"{self.path}/log")
            .parquet(f"{self.path}/log")
            .where(F.col(BATCH) > after)
        )
        return rows if upto is None else rows.where(F.col(BATCH) <= upto)

    def _states(self, covered: int, upto: int | None = None) -> DataFrame:
        snapshot = self.spark.read.schema(STATE_FIELDS).parquet(self._snapshot(covered))
        return snapshot.unionByName(state_of(self.tail(covered, upto)))

    def _batch(self, batch: int) -> str:
        return f"{self.path}/log/{BATCH}={batch}"

    def _snapshot(self, upto: int) -> str:
        return f"{self.path}/snapshots/{UPTO}={upto}"

    def _commit(self, upto: int) -> None:
        self.spark.range(1).select(F.lit(upto).cast("bigint").alias(UPTO)).write.mode("append").parquet(
            f"{self.path}/commits"
        )
