"""Plans that read or evaluate once, with generated methods that the JVM compiles."""

import re

from tabia.functions.values import LINE_DATE
from tabia.plans.queries import QUERIES
from tabia.schemas import OCR_ENTITIES
from tabia.sources import statements as stm
from tests.conftest import SMALL

#: Bytes of a method beyond which the JVM interprets it.
COMPILED = 8000


def method_sizes(frame):
    """The largest generated method of each stage's code."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.PythonSQLUtils.explainString(frame.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]


def test_entities_get_both_verdicts_in_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    entities = [
        ("header", ("2023-01-01", "Statement", None, None, None)),
        ("transaction_line", ("2023-01-02", "Rent", "KES -1,500.00", "DEBIT", "20.00")),
        ("transaction_line", ("2023-01-03", None, "7.00", None, None)),
        ("transaction_line", None),
        (None, ("2023-01-03", "x", "7.00", None, None)),
    ]
    docs = spark.createDataFrame([("d1", "c", "1", entities), ("d2", "c", "1", None)], OCR_ENTITIES)
    rows = stm.ocr_entity_rows(docs.mapInArrow(counted, docs.schema)).collect()
    assert sorted((r["seq"], r["verdict"]) for r in rows) == [(1, "kept"), (2, "malformed"), (3, "malformed")]
    assert read.value == 2
    kept, malformed = stm.flatten_ocr_entities(docs)
    assert [r["seq"] for r in kept.collect()] == [1] and kept.columns == malformed.columns


def test_the_entity_query_reads_its_source_once_in_compiled_code(spark):
    frame = QUERIES["q_ocr_entities"](spark, SMALL)
    assert frame._jdf.queryExecution().sparkPlan().toString().count("lineitem.parquet") == 1
    assert max(method_sizes(frame)) < COMPILED


def test_a_statement_line_is_matched_once(spark):
    texts = spark.createDataFrame(
        [("s", "c", "1", "opening\n2023-01-02 Rent 1,500.00 DR 20.00\nnothing"), ("t", "c", "1", None)],
        "statement_id string, company_id string, customer_id string, text string",
    )
    rows = stm.parse_statements(texts, ["statement_id"])
    assert [(r["seq"], r["description"], r["type"]) for r in rows.collect()] == [(1, "Rent", "debit")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(LINE_DATE) == 1
