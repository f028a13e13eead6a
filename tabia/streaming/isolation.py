"""Finding the jobs whose analysis raises, so that the others of their batch go on."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

#: More failing jobs than this in one batch mean that something else is broken: the error is raised.
MOST_FAILING = 100


def reason(error: BaseException) -> str:
    """First line of an error's message."""
    text = str(error).strip().splitlines()
    return text[0] if text else type(error).__name__


def failing_jobs(
    jobs: DataFrame, attempt: Callable[[DataFrame], None], error: Exception, most: int = MOST_FAILING
) -> list[tuple[str, str]]:
    """(job_id, reason) of the jobs on which ``attempt`` raises.

    A part that raises is cut in two by a bit of the hash of its job ids, which
    are unique, until one job is left: about 2 log2(n) attempts for each failing
    job. A part that does not raise is done with one attempt. A plan that can't
    be analysed fails whatever the data, and so does a batch with more than
    ``most`` failing jobs: both raise.
    """
    if isinstance(error, AnalysisException):
        raise error
    found, parts = [], [(jobs, 0, error)]
    while parts:
        part, bit, why = parts.pop()
        ids = [r.job_id for r in part.select("job_id").limit(2).collect()]
        if len(ids) == 1:
            found.append((ids[0], reason(why)))
            if len(found) > most:
                raise error
            continue
        for side in (0, 1):
            half = part.where(F.shiftright(F.xxhash64("job_id"), bit).bitwiseAND(1) == side)
            if half.isEmpty():
                continue
            try:
                attempt(half)
            except AnalysisException:
                raise
            except Exception as again:
                parts.append((half, bit + 1, again))
    return found
