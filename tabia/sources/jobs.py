"""Statement jobs: message source and sink, and the text of each job's file."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabia.operators.results import as_json_messages
from tabia.schemas import JOB
from tabia.sources.statements import decode_statement


def read_jobs(spark: SparkSession, fmt: str = "kafka", streaming: bool = True, path=None, **options) -> DataFrame:
    """Job messages: a topic from its earliest offset, or files with one JSON per line.

    A checkpoint takes the place of a consumer group. Messages that are no job
    come out with a NULL job_id and the text in ``message``.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "earliest", **options}
        raw = reader.options(**options).load().select(F.col("value").cast("string").alias("message"))
    else:
        raw = reader.schema("value string").options(**options).load(path).select(
            F.col("value").alias("message")
        )
    return raw.select("message", F.from_json("message", JOB).alias("job")).select("job.*", "message")


def jobs_from_files(files: DataFrame) -> DataFrame:
    """A job per accepted file, with its text; works on a stream of files as well.

    The id follows from the file, so a replay keeps it.
    """
    return files.select(
        F.sha2(F.concat_ws("|", "file_url", F.col("modificationTime").cast("string")), 256).alias("job_id"),
        "company_id",
        "customer_id",
        "file_url",
        "filename",
        F.lit(None).cast("string").alias("callback_url"),
        decode_statement(F.col("content")).alias("text"),
    )


def job_messages(jobs: DataFrame) -> DataFrame:
    return as_json_messages(jobs.select(*JOB.fieldNames()))


def write_messages(messages: DataFrame, fmt: str = "kafka", path=None, mode="append", **options) -> None:
    writer = messages.write.format(fmt).mode(mode).options(**options)
    writer.save(path) if path else writer.save()


def with_text(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with the decoded text of their file; NULL where the file is missing."""
    texts = files.select("file_url", decode_statement(F.col("content")).alias("text"))
    return jobs.join(texts, "file_url", "left")
