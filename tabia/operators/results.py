"""Job statuses, result messages, result lookup and result tables."""

from pyspark.sql import Column, DataFrame, functions as F

BRIEF = 200  # characters of a summary sent with a result message
RESULT_URL = "/api/v1/analytics/results/"


def latest_status(statuses: DataFrame) -> DataFrame:
    """Latest status row per job; ``max_by`` combines before the shuffle.

    Rows with a time ``at`` are ordered by it, then by step, so a job that runs
    again shows its last run. A log without times is ordered by step.
    """
    order = F.struct("at", "step") if "at" in statuses.columns else F.col("step")
    return statuses.groupBy("job_id").agg(
        F.max_by(F.struct("status", "message"), order).alias("last")
    ).select("job_id", "last.status", "last.message")


def result_url(job_id: Column) -> Column:
    return F.concat(F.lit(RESULT_URL), job_id)


def result_messages(results: DataFrame) -> DataFrame:
    """Messages of completed jobs, with the first 200 characters of the summary."""
    return results.select(
        "job_id",
        "company_id",
        "customer_id",
        F.lit("COMPLETED").alias("status"),
        result_url(F.col("job_id")).alias("result_url"),
        F.concat(F.substring("analysis_summary", 1, BRIEF), F.lit("...")).alias("brief_summary"),
    )


def failure_messages(failures: DataFrame) -> DataFrame:
    return failures.select(
        "job_id",
        "company_id",
        "customer_id",
        F.lit("FAILED").alias("status"),
        F.concat(F.lit("Analysis failed: "), "error").alias("error_message"),
    )


def as_json_messages(messages: DataFrame, key: str = "job_id") -> DataFrame:
    """key/value rows for a message sink."""
    return messages.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def lookup(job_ids: DataFrame, results: DataFrame, statuses: DataFrame) -> DataFrame:
    """Reply per asked job: its result, or why there is none."""
    last = latest_status(statuses)
    wanted = job_ids.select("job_id").distinct()
    found = results.select("job_id", F.col("behavioral_score"), F.lit(True).alias("_found"))
    lowered = F.lower("status")
    return (
        wanted.join(found, "job_id", "left")
        .join(last, "job_id", "left")
        .select(
            "job_id",
            F.when(F.col("_found"), 200)
            .when(F.col("status") == "FAILED", 400)
            .when(F.col("status") != "COMPLETED", 202)
            .otherwise(404)
            .alias("reply_code"),
            "behavioral_score",
            F.when(F.col("_found"), F.lit(None).cast("string"))
            .when(
                F.col("status") == "FAILED",
                F.concat(F.lit("Job "), "job_id", F.lit(" failed: "), "message"),
            )
            .when(
                F.col("status") != "COMPLETED",
                F.concat(
                    F.lit("Job "), "job_id", F.lit(" is still "), lowered,
                    F.lit(". Results not yet available."),
                ),
            )
            .otherwise("Analytics results not found or job ID invalid.")
            .alias("detail"),
        )
    )


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by tenant. The rebalance keeps small tenants in few files and cuts
    a tenant with a third of the rows into several tasks."""
    results.hint("rebalance", "company_id").write.mode(mode).partitionBy("company_id").parquet(path)
