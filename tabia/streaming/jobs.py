"""Statement jobs as a stream: every micro-batch runs the batch operators.

Tables are written under ``out/<table>/run_id=<id>/batch_id=<n>`` and replaced when a batch
is replayed, so a restart after a lost driver or executor leaves no duplicates. An id runs
once: what the stream has run before is keyed state of its checkpoint. A job whose analysis
raises is found by halving its batch and listed as failed; the others go on.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tabia.functions.values import ratio
from tabia.operators import anomalies, features, metrics, narrative, results, scoring
from tabia.operators.base import Base
from tabia.operators.model import LinearScorer
from tabia.operators.spread import SPLIT_SPAN
from tabia.plans.modules import Tenants, prepared
from tabia.schemas import KEY
from tabia.sources.statements import (
    document_transactions, failed_statements, parse_statements, with_form, without_transactions,
)
from tabia.sources.tenants import currency, missing_tenants
from tabia.sources.transactions import dated, scoped
from tabia.streaming.isolation import failing_jobs
from tabia.streaming.job_ids import with_earlier

JOB_KEY = (*KEY, "job_id")
# Features a bank statement alone does not have.
ABSENT = (
    *features.BUREAU_FEATURES,
    *features.MOBILE_FEATURES,
    *features.CROSS_FEATURES,
)


def status_rows(jobs: DataFrame, step: int, status: str, message) -> DataFrame:
    return jobs.select(
        "job_id",
        F.lit(step).alias("step"),
        F.lit(status).alias("status"),
        message.alias("message"),
        F.current_timestamp().alias("at"),
    )


# The messages of a job's steps.
QUEUED = "Job queued for processing."
STEPS = (
    "Starting IDP processing...",
    "Performing feature engineering...",
    "Calculating behavioral score...",
    "Generating LLM insights...",
)
COMPLETED = "Analysis completed successfully."
NO_TRANSACTIONS = "Failed to extract any transactions from the document."


def parsed_jobs(jobs: DataFrame, tenants: Tenants) -> DataFrame:
    """Transactions of the jobs' texts, with their form and verdict where the jobs carry documents."""
    if not is_document(jobs):
        texts = tenants.attach(jobs.select(*JOB_KEY, "text"), "currency_preference", salt_by=("job_id",))
        return parse_statements(texts, JOB_KEY)
    held = [c for c in ("text", "content", "answer") if c in jobs.columns]
    documents = tenants.attach(
        jobs.select(*JOB_KEY, *held), "currency_preference", "bank_statement_formats", salt_by=("job_id",)
    )
    return document_transactions(with_form(documents), JOB_KEY)


def is_document(jobs: DataFrame) -> bool:
    return "answer" in jobs.columns or "content" in jobs.columns


def failed_jobs(jobs: DataFrame, tenants: Tenants, log) -> DataFrame:
    """The jobs without a single readable transaction, with the text that was read."""
    if not is_document(jobs):
        return failed_statements(jobs, [*JOB_KEY, *log])
    formats = tenants.attach(jobs, "bank_statement_formats", salt_by=("job_id",))
    documents = with_form(formats)
    return documents.where(without_transactions(documents)).select(
        *JOB_KEY,
        *log,
        F.col("text").alias("raw_text_extracted"),
        F.lit("failed").alias("status"),
        F.lit("No transactions extracted by IDP.").alias("error"),
    )


def job_results(
    parsed: DataFrame, tenants: Tenants, span: int = SPLIT_SPAN, scorer: LinearScorer | None = None
) -> dict[str, DataFrame]:
    """Result tables of all jobs with transactions, keyed by tenant, customer and job.

    The score starts from the ``scorer``'s prediction, or from 500 without one.
    """
    keys = JOB_KEY
    txn = prepared(parsed, tenants, span)
    base = Base(txn, keys)
    # a job whose dates are all unparsable has transactions but no features
    spine = parsed.select(*keys).distinct()
    table = spine.join(
        anomalies.with_base_count(features.bank_features(base, keys), base, keys), list(keys), "left"
    ).withColumns(
        {
            **{name: F.lit(None).cast("double") for name in ABSENT},
            "bank_present": F.lit(1),
            "mobile_present": F.lit(0),
            "crb_present": F.lit(0),
            "anomalies": F.coalesce("anomalies", F.lit(0)),
        }
    )
    factors = "array<struct<feature:string,impact:double>>"
    table = table.withColumns(
        {
            "base_score": F.lit(500.0) if scorer is None else scorer.prediction(),
            "score_explanation": F.array().cast(factors) if scorer is None else scorer.contributions(),
        }
    )
    scored = scoring.unified_score(
        table,
        tenants.settings,
        tenants.small,
        F.col("base_score"),
        keep=("currency_preference", "language_preference", "timezone"),
    ).withColumn("data_completeness_score", ratio(F.lit(1), F.lit(3)))
    tone = tenants.attach(spine, "llm_tone_guidelines", salt_by=("job_id",))
    result = scored.select(
        *keys,
        F.lit("completed").alias("status"),
        "behavioral_score",
        "risk_level",
        "score_explanation",
        "breakdown",
        narrative.unified_summary(currency()).alias("analysis_summary"),
        narrative.localisation().alias("localization_details"),
        F.col("anomalies").alias("anomaly_count"),
        "data_completeness_score",
        F.current_timestamp().alias("processed_at"),
    )
    named = tenants.attach(
        features.bank_features(base, keys), "currency_preference", salt_by=("job_id",)
    )
    rows = tenants.attach(
        anomalies.large_debit_rows(base, keys), "currency_preference", salt_by=("job_id", "seq")
    )
    figures = metrics.base_metrics(named, currency(), keys).unionByName(metrics.spending_metrics(base, keys))
    unusual = anomalies.large_debit_lines(rows, "bank", currency(), keys).unionByName(
        anomalies.busy_days(base, "bank", keys)
    )
    return {
        "results": result,
        "transactions": txn.select(
            *keys, "seq", "txn_date", "description", "amount", "type", "category",
            "balance_after", "original_currency",
        ),
        "metrics": figures,
        "anomalies": unusual,
        "narrative": narrative.narrative_context(
            tone, figures, unusual, scoring.breakdown_rows(result, "unified", keys), keys, result, "behavioral_score"
        ),
    }


def process_batch(
    jobs: DataFrame,
    batch_id: int,
    tenants: Tenants,
    out: str,
    span: int = SPLIT_SPAN,
    scorer: LinearScorer | None = None,
    run_id: str = "batch",
) -> None:
    """Parse, score, store, notify and log one micro-batch of jobs with their texts or documents.

    A batch is stored under its run and batch id and replaced on replay. Of
    several messages with one job id the first in the order of their columns is
    run, and none if an earlier batch has run the id (``earlier``, which ``start``
    adds); the others are listed as rejected. A job whose analysis raises is
    listed in ``broken`` and FAILED; the batch goes on without it. Tenants that no
    earlier batch has met get their row of default settings.
    """
    spark = jobs.sparkSession

    def path(table: str) -> str:
        return f"{out}/{table}/run_id={run_id}/batch_id={batch_id}"

    def store(table: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(path(table))
        return spark.read.schema(frame.schema).parquet(path(table))

    # written once; every later step reads these tables, not the source again
    if "earlier" not in jobs.columns:
        jobs = jobs.withColumn("earlier", F.lit(0).cast("long"))
    usable, unusable = scoped(jobs)
    has_id = F.col("job_id").isNotNull()
    turn = Window.partitionBy("job_id").orderBy(*sorted(usable.columns))
    turns = store("received", usable.where(has_id).withColumn("turn", F.row_number().over(turn)))
    first = (F.col("turn") == 1) & (F.col("earlier") == 0)
    inbox = store("jobs", turns.where(first).drop("turn", "earlier"))
    again = F.when(F.col("earlier") > 0, "job id of an earlier batch").otherwise("job id repeated")
    store(
        "rejected",
        usable.where(~has_id)
        .withColumn("reason", F.lit("no job id"))
        .unionByName(unusable.withColumn("reason", F.lit("company or customer id missing")))
        .unionByName(turns.where(~first).drop("turn").withColumn("reason", again))
        .drop("earlier"),
    )
    store_new_tenants(inbox, tenants, out, path("tenant_defaults"), run_id, batch_id)
    log = [c for c in ("filename", "file_url") if c in inbox.columns]

    def analysed(part: DataFrame, keep) -> dict[str, DataFrame]:
        items = keep("items", parsed_jobs(part, tenants))
        parsed = items.where("verdict = 'kept'").drop("form", "verdict") if "verdict" in items.columns else items
        keep("undated", dated(parsed)[1].drop("txn_date"))
        tables = job_results(parsed, tenants, span, scorer)
        result = keep("results", tables.pop("results").hint("rebalance"))
        for name, frame in tables.items():
            keep(name, frame)
        return {"result": result, "failures": keep("failures", failed_jobs(part, tenants, log))}

    def tried(table: str, frame: DataFrame) -> DataFrame:
        frame.write.format("noop").mode("overwrite").save()
        return frame

    broken: list[tuple[str, str]] = []
    try:
        tables = analysed(inbox, store)
    except Exception as error:  # whatever a job's own data raises
        broken = failing_jobs(inbox, lambda part: analysed(part, tried), error)
        ids = F.broadcast(spark.createDataFrame(broken, "job_id string, error string").select("job_id"))
        tables = analysed(inbox.join(ids, "job_id", "left_anti"), store)
    reasons = F.broadcast(spark.createDataFrame(broken, "job_id string, error string"))
    crashed = store(
        "broken",
        inbox.join(reasons, "job_id").select(*JOB_KEY, *log, F.lit("failed").alias("status"), "error"),
    )
    result, failures = tables["result"], tables["failures"]
    completed = results.result_messages(result)
    failed = results.failure_messages(failures.select(*JOB_KEY, "error").unionByName(crashed.select(*JOB_KEY, "error")))
    store("messages", results.as_json_messages(completed).unionByName(results.as_json_messages(failed)))
    steps = status_rows(inbox, 1, "QUEUED", F.lit(QUEUED)).unionByName(
        status_rows(inbox, 2, "PROCESSING", F.lit(STEPS[0]))
    )
    for step, message in enumerate(STEPS[1:], 3):
        steps = steps.unionByName(status_rows(result, step, "PROCESSING", F.lit(message)))
    last = 2 + len(STEPS)
    store(
        "statuses",
        steps.unionByName(status_rows(result, last, "COMPLETED", F.lit(COMPLETED)))
        .unionByName(status_rows(failures, last, "FAILED", F.lit(NO_TRANSACTIONS)))
        .unionByName(status_rows(crashed, last, "FAILED", F.concat(F.lit("Analysis failed: "), "error"))),
    )


def store_new_tenants(inbox: DataFrame, tenants: Tenants, out: str, path: str, run_id: str, batch_id: int) -> None:
    """Default rows of the batch's tenants that neither the settings nor an earlier batch of the run has."""
    spark = inbox.sparkSession
    known = tenants.settings.select("company_id")
    if batch_id > 0 and run_id != "batch":
        fields = "company_id string, run_id string, batch_id bigint"
        earlier = spark.read.schema(fields).option("basePath", f"{out}/tenant_defaults").option(
            "ignoreMissingFiles", "true"
        ).parquet(f"{out}/tenant_defaults")
        known = known.unionByName(
            earlier.where((F.col("run_id") == run_id) & (F.col("batch_id") < batch_id)).select("company_id")
        )
    missing_tenants(known, inbox).write.mode("overwrite").parquet(path)


def start(
    jobs: DataFrame,
    tenants: Tenants | Callable[[], Tenants],
    out: str,
    checkpoint: str,
    span: int = SPLIT_SPAN,
    scorer: LinearScorer | None = None,
    remember_ms: int | None = None,
    **trigger,
):
    """Starts the stream over jobs with ``text``, or ``content`` and ``answer``; default trigger availableNow.

    An id that an earlier batch has run is rejected, also after a restart from
    the checkpoint; ``remember_ms`` bounds how long an id is kept.

    ``tenants`` may be a function returning them: it is called for every batch, so
    that changed settings take effect without a restart.
    Tables are stored under the id that Spark keeps in the checkpoint, so a new
    checkpoint never replaces the results of an earlier run.
    """

    def run_id(spark) -> str:
        return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]

    def run(batch: DataFrame, batch_id: int) -> None:
        if not callable(tenants):
            process_batch(batch, batch_id, tenants, out, span, scorer, run_id(batch.sparkSession))
            return
        current = tenants()
        process_batch(batch, batch_id, current, out, span, scorer, run_id(batch.sparkSession))
        current.settings.unpersist()

    return (
        with_earlier(jobs, remember_ms).writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(run)
        .start()
    )
