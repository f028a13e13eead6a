"""Which job ids a stream has run before: keyed state that outlives batches and restarts."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tabia.sources.transactions import has_ids

USED = StructType([StructField("used", LongType())])


def with_earlier(jobs: DataFrame, remember_ms: int | None = None) -> DataFrame:
    """A stream of jobs with ``earlier``: how many usable jobs of their id came in earlier batches.

    The state is one number for each job id, kept with the stream's checkpoint:
    a restart reads it back and a replayed batch finds it as it was before that
    batch. It is kept for good, or dropped when an id was not seen for
    ``remember_ms``. Jobs without an id, or without a company or customer, do not
    use an id up and leave no state; each is a group of its own, so that they
    are no hot key.
    """
    names = jobs.columns
    usable = F.col("job_id").isNotNull() & has_ids()
    tagged = jobs.withColumns(
        {
            "_usable": usable,
            "_id": F.coalesce("job_id", F.lit("")),
            "_apart": F.when(usable, F.lit(0).cast("long")).otherwise(F.xxhash64(*names)),
        }
    )

    def earlier(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        used = 0
        for rows in batches:
            used += int(rows["_usable"].sum())
            yield rows[names].assign(earlier=before)
        if used:
            state.update((before + used,))
            if remember_ms is not None:
                state.setTimeoutDuration(remember_ms)

    out = StructType([*jobs.schema.fields, StructField("earlier", LongType())])
    timeout = GroupStateTimeout.NoTimeout if remember_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return tagged.groupBy("_id", "_apart").applyInPandasWithState(earlier, out, USED, "append", timeout)
