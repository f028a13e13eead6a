"""Jobs as a stream: equal to one batch, failures set apart, replays harmless."""

import json

import pytest
from pyspark.sql import functions as F

from tabia.operators import results
from tabia.plans.modules import Tenants
from tabia.schemas import JOB
from tabia.sources import jobs as job_src
from tabia.sources.statements import gate_files, read_statement_files
from tabia.sources.tenants import current_settings, read_tenant_config
from tabia.streaming import jobs as stream
from tabia.streaming.isolation import failing_jobs


def _statement(n):
    lines = [f"2023-0{1 + i % 4}-{1 + i:02d} SALARY {1000 + n * i}.00 CR" for i in range(8)]
    lines += [f"2023-01-0{1 + i} Rent {100 * n + i}.50 DR 9{i}.00" for i in range(5)]
    return "STATEMENT\n" + "\n".join(lines)


TEXTS = {("T1", "c1", "a.pdf"): _statement(1), ("T1", "c2", "b.pdf"): _statement(20), ("T2", "c3", "c.png"): "junk only",
         ("T2", "c4", "d.pdf"): _statement(7), ("T2", "c5", "e.pdf"): "31 Feb 2023 ODD 5.00 CR"}


@pytest.fixture(scope="module")
def tenants(spark):
    log = spark.createDataFrame(
        [("T1", 1, "UGX", '{"anomaly_penalty_per_anomaly": 5}')],
        "company_id string, version bigint, currency_preference string, behavioral_scoring_weights string",
    )
    return Tenants(read_tenant_config(current_settings(log)))


@pytest.fixture()
def root(tmp_path):
    for (company, customer, name), text in TEXTS.items():
        folder = tmp_path / "files" / company / customer / "bank_statements"
        folder.mkdir(parents=True)
        (folder / f"20230101120000_{name}").write_text(text)
    return tmp_path


def _read(spark, out, table):
    return spark.read.parquet(f"{out}/{table}")


def _comparable(frame):
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in frame.drop("batch_id", "run_id", "at", "processed_at").collect())


def test_stream_of_files_equals_batch(spark, tenants, root):
    files = read_statement_files(spark, str(root / "files"))
    accepted, _ = gate_files(files)
    stream.process_batch(job_src.jobs_from_files(accepted), 0, tenants, str(root / "batch"))

    live = read_statement_files(spark, str(root / "files"), streaming=True, maxFilesPerTrigger=2)
    texts = job_src.jobs_from_files(gate_files(live)[0])
    query = stream.start(texts, lambda: tenants, str(root / "live"), str(root / "checkpoint"))
    query.awaitTermination(240)
    assert query.exception() is None
    assert query.lastProgress["batchId"] >= 2  # several micro-batches
    for table in ("results", "transactions", "metrics", "anomalies", "narrative", "failures", "messages", "statuses"):
        assert _comparable(_read(spark, root / "live", table)) == _comparable(_read(spark, root / "batch", table)), table

    scored = {r.customer_id: r for r in _read(spark, root / "live", "results").collect()}
    assert set(scored) == {"c1", "c2", "c4", "c5"}
    assert scored["c5"].behavioral_score == 500.0  # transactions, but no date to analyse
    assert scored["c1"].localization_details.currency == "UGX"
    (failure,) = _read(spark, root / "live", "failures").collect()
    assert (failure.customer_id, failure.raw_text_extracted, failure.filename) == ("c3", "junk only", "c.png")
    (undated,) = _read(spark, root / "live", "undated").collect()
    assert (undated.customer_id, undated.date) == ("c5", "31 Feb 2023")
    last = results.latest_status(_read(spark, root / "live", "statuses"))
    assert sorted(r.status for r in last.collect()) == ["COMPLETED"] * 4 + ["FAILED"]


def test_replayed_batch_leaves_no_duplicates(spark, tenants, root):
    files = read_statement_files(spark, str(root / "files"))
    jobs = job_src.jobs_from_files(files)
    out = str(root / "replay")
    stream.process_batch(jobs.unionByName(jobs), 3, tenants, out)
    first = _comparable(_read(spark, out, "statuses"))
    stream.process_batch(jobs, 3, tenants, out)
    assert _comparable(_read(spark, out, "statuses")) == first
    assert len(first) == 4 * 6 + 3  # completed jobs pass six steps, the failed one three


def test_job_messages_round_trip(spark, root):
    files = read_statement_files(spark, str(root / "files"))
    jobs = job_src.jobs_from_files(files).drop("text")
    job_src.write_messages(job_src.job_messages(jobs).select("value"), "text", str(root / "topic"), "overwrite")
    (root / "topic" / "bad.txt").write_text("not a job\n")
    live = job_src.read_jobs(spark, "text", path=str(root / "topic"))
    query = live.writeStream.format("memory").queryName("jobs_in").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("jobs_in")
    assert got.where("job_id is not null").count() == len(TEXTS)
    assert [r.message for r in got.where("job_id is null").collect()] == ["not a job"]
    assert _comparable(got.where("job_id is not null").select(*JOB.fieldNames())) == _comparable(jobs)
    found = job_src.with_text(jobs, files)
    assert sorted(r.text for r in found.collect()) == sorted(TEXTS.values())
    missing = jobs.withColumn("file_url", jobs.job_id)
    assert job_src.with_text(missing, files).where("text is null").count() == len(TEXTS)


def test_message_is_plain_json(spark):
    jobs = spark.createDataFrame([("j", "A", "1", "u", "f", None)], JOB)
    assert json.loads(job_src.job_messages(jobs).first().value) == {
        "job_id": "j", "company_id": "A", "customer_id": "1", "file_url": "u", "filename": "f",
    }


def test_unusable_jobs_are_set_apart_and_a_scorer_gives_the_base(spark, tenants, tmp_path):
    from tabia.operators.model import LinearScorer

    text = "2023-01-01 SALARY 1,000.00 CR"
    jobs = spark.createDataFrame(
        [("j1", "T1", "c", text), (None, "T1", "c", text), ("j2", "", "c", text), ("j3", "T9", "c", None)],
        "job_id string, company_id string, customer_id string, text string",
    )
    scorer = LinearScorer({"avg_monthly_income": 0.1, "savings_rate": 5.0}, {"avg_monthly_income": 400.0, "savings_rate": 0.0}, 300.0)
    stream.process_batch(jobs, 0, tenants, str(tmp_path), scorer=scorer)
    reasons = sorted(r.reason for r in _read(spark, tmp_path, "rejected").collect())
    assert reasons == ["company or customer id missing", "no job id"]
    (row,) = _read(spark, tmp_path, "results").collect()
    assert (row.job_id, row.behavioral_score) == ("j1", 400.0)
    assert [(e.feature, e.impact) for e in row.score_explanation] == [("avg_monthly_income", 60.0), ("savings_rate", 0.0)]
    assert [r.job_id for r in _read(spark, tmp_path, "failures").collect()] == ["j3"]


def test_a_new_checkpoint_keeps_earlier_results(spark, tenants, tmp_path):
    schema = "job_id string, company_id string, customer_id string, text string"
    for run in ("one", "two"):
        source = tmp_path / run
        rows = [(run, "T1", run, "2023-01-01 SALARY 1,000.00 CR")]
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(source))
        jobs = spark.readStream.schema(schema).json(str(source))
        query = stream.start(jobs, tenants, str(tmp_path / "out"), str(tmp_path / f"checkpoint_{run}"))
        query.awaitTermination(240)
        assert query.exception() is None
    assert {r.job_id for r in _read(spark, tmp_path / "out", "results").collect()} == {"one", "two"}


def test_repeated_job_ids_are_listed(spark, tenants, tmp_path):
    rows = [("j", "T1", "b", "2023-01-01 Rent 5.00 DR"), ("j", "T1", "a", "2023-01-01 SALARY 1,000.00 CR")]
    jobs = spark.createDataFrame(rows, "job_id string, company_id string, customer_id string, text string")
    stream.process_batch(jobs, 0, tenants, str(tmp_path))
    (row,) = _read(spark, tmp_path, "results").collect()
    assert row.customer_id == "a"
    (other,) = _read(spark, tmp_path, "rejected").collect()
    assert (other.customer_id, other.reason) == ("b", "job id repeated")


def test_status_of_a_job_that_runs_again(spark):
    rows = [("j", 3, "FAILED", "m", 1), ("j", 1, "QUEUED", "m", 2), ("j", 2, "PROCESSING", "m", 2)]
    log = spark.createDataFrame(rows, "job_id string, step int, status string, message string, at int")
    assert results.latest_status(log).first().status == "PROCESSING"


IDS = "job_id string, company_id string, customer_id string, text string"


def _send(spark, folder, rows, schema=IDS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def _run(spark, tenants, root, schema=IDS, **options):
    jobs = spark.readStream.schema(schema).json(str(root / "in"))
    query = stream.start(jobs, tenants, str(root / "out"), str(root / "checkpoint"), **options)
    query.awaitTermination(300)
    assert query.exception() is None


def test_an_id_runs_once_across_batches_and_a_restart(spark, tenants, tmp_path):
    text = "2023-01-01 SALARY 1,000.00 CR"
    _send(spark, tmp_path / "in", [("j1", "T1", "a", text), ("j2", "T1", "b", text), (None, "T1", "x", text), ("j3", "", "y", text)])
    _run(spark, tenants, tmp_path)
    # a restart from the checkpoint: j1 was run, j3 was not usable and is still free
    _send(spark, tmp_path / "in", [("j1", "T1", "late", text), ("j3", "T7", "c", text), (None, "T1", "x", text), ("j4", "T7", "d", text)])
    _run(spark, tenants, tmp_path)
    _send(spark, tmp_path / "in", [("j4", "T1", "e", text), ("j4", "T1", "f", text)])
    _run(spark, tenants, tmp_path)
    done = _read(spark, tmp_path / "out", "results").collect()
    assert sorted((r.job_id, r.customer_id) for r in done) == [("j1", "a"), ("j2", "b"), ("j3", "c"), ("j4", "d")]
    refused = _read(spark, tmp_path / "out", "rejected").collect()
    assert sorted((r.reason, r.customer_id) for r in refused) == [
        ("company or customer id missing", "y"), ("job id of an earlier batch", "e"), ("job id of an earlier batch", "f"),
        ("job id of an earlier batch", "late"), ("no job id", "x"), ("no job id", "x"),
    ]
    # T7 has no settings: its default row comes with the batch that meets it first, once
    defaults = _read(spark, tmp_path / "out", "tenant_defaults").collect()
    assert [(r.company_id, r.currency_preference, r.version) for r in defaults] == [("T7", "KES", 0)]


class Fussy:
    """A scorer that raises on some customers."""

    def __init__(self, *customers):
        self.bad = F.col("customer_id").isin(*customers)

    def prediction(self):
        return F.when(self.bad, F.raise_error(F.concat(F.lit("no score for "), F.col("customer_id"))).cast("double")).otherwise(F.lit(400.0))

    def contributions(self):
        return F.array().cast("array<struct<feature:string,impact:double>>")


def test_a_job_that_raises_does_not_stop_the_others(spark, tenants, tmp_path):
    text = "2023-01-01 SALARY 1,000.00 CR"
    rows = [(f"j{k}", "T1", f"c{k}", text if k != 3 else "junk") for k in range(4)]
    _send(spark, tmp_path / "in", rows)
    _run(spark, tenants, tmp_path, scorer=Fussy("c1"))
    _send(spark, tmp_path / "in", [("j9", "T1", "c9", text)])
    _run(spark, tenants, tmp_path, scorer=Fussy("c1"))
    out = tmp_path / "out"
    assert sorted(r.job_id for r in _read(spark, out, "results").collect()) == ["j0", "j2", "j9"]
    broken = {r.job_id: r.error for r in _read(spark, out, "broken").collect()}
    assert set(broken) == {"j1"} and all(f"no score for c{j[1]}" in e for j, e in broken.items())
    last = {r.job_id: r for r in results.latest_status(_read(spark, out, "statuses")).collect()}
    assert {j: r.status for j, r in last.items()} == {
        **dict.fromkeys(["j0", "j2", "j9"], "COMPLETED"), **dict.fromkeys(["j1", "j3"], "FAILED")
    }
    assert last["j1"].message.startswith("Analysis failed: ")
    sent = {r.key: json.loads(r.value)["status"] for r in _read(spark, out, "messages").collect()}
    assert sent == {j: r.status for j, r in last.items()}


def test_a_batch_in_which_too_much_fails_raises(spark):
    jobs = spark.range(40).select(F.col("id").cast("string").alias("job_id"))

    def attempt(part):
        raise RuntimeError("store is gone")

    with pytest.raises(RuntimeError, match="store is gone"):
        failing_jobs(jobs, attempt, RuntimeError("store is gone"), most=5)
    tried = []

    def some(part):
        ids = [r.job_id for r in part.collect()]
        tried.append(len(ids))
        if {"7", "30"} & set(ids):
            raise ValueError(f"bad\nmore of {ids}")

    assert sorted(failing_jobs(jobs, some, ValueError("bad"))) == [("30", "bad"), ("7", "bad")]
    assert len(tried) < 40


def _entity(kind="transaction_line", **values):
    return {"type_": kind, "confidence": 0.9, "properties": {k: v for k, v in values.items()}}


def test_documents_of_three_forms_in_one_batch(spark, tmp_path):
    log = spark.createDataFrame(
        [("T2", 1, '["lines", "bytes"]')], "company_id string, version bigint, bank_statement_formats string"
    )
    tenants = Tenants(read_tenant_config(current_settings(log)))
    line = "2023-01-0{} SALARY 1{}00.00 CR"
    entities = {"text": "scan", "pages": [1, {"x": None}], "entities": [
        _entity("header", date="2023-01-01"),
        _entity(date="2023-01-02", description="Shop", amount="KES -1,500.00", type="DEBIT", balance="9,000.00"),
        _entity(date=None, description="no date", amount="1.00"),
        _entity(date="2023-01-03", description="Bad", amount="1.00", balance="overdrawn"),
    ]}
    blocks = {"JobStatus": "SUCCEEDED", "Blocks": [
        {"BlockType": "PAGE"}, {"BlockType": "LINE", "Text": line.format(1, 1), "Page": 1},
        {"BlockType": "WORD", "Text": "SALARY"}, {"BlockType": "LINE", "Text": line.format(2, 2)}]}
    failed = {**blocks, "JobStatus": "FAILED"}
    rows = [
        ("e", "T1", json.dumps(entities), b"junk"),
        ("l", "T1", json.dumps(blocks), b"junk"),
        ("b", "T1", None, line.format(5, 5).encode() + b"\xff"),
        ("f", "T1", json.dumps(failed), line.format(6, 6).encode()),
        ("n", "T1", "{not json", line.format(7, 7).encode()),
        ("t", "T2", json.dumps({**entities, **blocks}), b"junk"),
        ("x", "T1", json.dumps({"entities": [_entity("header"), _entity(date=None)]}), line.format(8, 8).encode()),
        ("y", "T1", json.dumps({"Blocks": []}), None),
    ]
    jobs = spark.createDataFrame(
        [(j, c, j, "u", a, b) for j, c, a, b in rows],
        "job_id string, company_id string, customer_id string, file_url string, answer string, content binary",
    )
    source = tmp_path / "in"
    jobs.coalesce(1).write.parquet(str(source))
    live = spark.readStream.schema(jobs.schema).parquet(str(source))
    query = stream.start(live, tenants, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(300)
    assert query.exception() is None
    found = {}
    for r in _read(spark, tmp_path / "out", "items").collect():
        found.setdefault(r.job_id, []).append((r.form, r.verdict, r.seq, r.date, float(r.amount), r.type))
    assert {j: sorted(v) for j, v in found.items()} == {
        "e": [("entities", "kept", 1, "2023-01-02", 1500.0, "debit"), ("entities", "malformed", 2, None, 1.0, "unknown"),
              ("entities", "malformed", 3, "2023-01-03", 1.0, "unknown")],
        "l": [("lines", "kept", 0, "2023-01-01", 1100.0, "credit"), ("lines", "kept", 1, "2023-01-02", 1200.0, "credit")],
        "b": [("bytes", "kept", 0, "2023-01-05", 1500.0, "credit")],
        "f": [("bytes", "kept", 0, "2023-01-06", 1600.0, "credit")],
        "n": [("bytes", "kept", 0, "2023-01-07", 1700.0, "credit")],
        "t": [("lines", "kept", 0, "2023-01-01", 1100.0, "credit"), ("lines", "kept", 1, "2023-01-02", 1200.0, "credit")],
        "x": [("entities", "malformed", 1, None, 0.0, "unknown")],
    }
    last = results.latest_status(_read(spark, tmp_path / "out", "statuses")).collect()
    assert {r.job_id for r in last if r.status == "FAILED"} == {"x", "y"}
    told = _read(spark, tmp_path / "out", "narrative")
    assert {r.customer_id for r in told.where("block = 'score'").collect()} == {"e", "l", "b", "f", "n", "t"}
    assert {r.block for r in told.where("customer_id = 'e'").collect()} >= {"metrics", "tone", "score", "anomalies", "rules"}
