"""Tenant settings, narrative lines, statuses, messages and lookups."""

from pyspark.sql import functions as F

from tabia.operators import narrative, results
from tabia.operators.spread import is_small
from tabia.plans.modules import Tenants
from tabia.sources import tenants as tn

LOG = (
    "company_id string, version bigint, currency_preference string, transaction_categorization_rules string,"
    " bank_scoring_weights string, llm_tone_guidelines string, max_file_size_mb int"
)


def _log(spark):
    return spark.createDataFrame(
        [
            ("A", 1, "UGX", '{"b": ["X", "y"], "a": ["z"], "c": []}', None, None, 5),
            ("A", 2, None, None, '{"w": 7}', None, None),
            ("A", 3, "TZS", None, "not json", '{"concise": true}', None),
            ("B", 1, None, '[{"category":"k","keywords":["Q"]}]', None, "{}", None),
        ],
        LOG,
    )


def test_fold_defaults_and_parsing(spark):
    config = {r.company_id: r for r in tn.read_tenant_config(tn.current_settings(_log(spark))).collect()}
    a, b = config["A"], config["B"]
    assert (a.version, a.currency_preference, a.max_file_size_mb, a.language_preference) == (3, "TZS", 5, "en")
    # the order of an object is kept, keywords are lower-cased
    assert [(r.category, r.keywords) for r in a.transaction_categorization_rules] == [("b", ["x", "y"]), ("a", ["z"]), ("c", [])]
    assert a.bank_scoring_weights is None and a.bank_scoring_weights_raw == "not json"
    assert (b.currency_preference, b.is_active, b.max_file_size_mb) == ("KES", True, 20)
    assert b.transaction_categorization_rules[0].keywords == ["q"]
    assert b.supported_file_types == ["pdf", "jpg", "png"]


def test_upsert_appends_a_version_and_checks_the_tenant(spark):
    updates = spark.createDataFrame(
        [("A", "A", 4, {"w": 9.0}), ("B", "A", 4, {"w": 1.0}), ("B", None, 5, {"w": 1.0})],
        "company_id string, path_company_id string, version bigint, bank_scoring_weights map<string,double>",
    )
    allowed, forbidden = tn.own_tenant_only(updates)
    assert forbidden.count() == 2
    log = tn.append_updates(_log(spark), allowed.drop("path_company_id"))
    a = tn.read_tenant_config(tn.current_settings(log)).where("company_id = 'A'").first()
    assert a.bank_scoring_weights == {"w": 9.0} and a.currency_preference == "TZS"


def test_new_tenants_get_a_default_row(spark):
    companies = spark.createDataFrame([("A",), ("N",), ("N",)], "company_id string")
    log = tn.append_updates(_log(spark), tn.missing_tenants(_log(spark), companies))
    config = {r.company_id: r for r in tn.read_tenant_config(tn.current_settings(log)).collect()}
    assert set(config) == {"A", "B", "N"} and config["A"].version == 3
    new = config["N"]
    assert (new.currency_preference, new.max_file_size_mb) == ("KES", 20)
    assert new.transaction_categorization_rules[0].category == "income"
    assert new.behavioral_scoring_weights["anomaly_penalty"] == 0.1


def test_tone(spark):
    frame = spark.createDataFrame(
        [({"professional": True, "include_disclaimers": True, "avoid_jargon": False},), ({},), (None,)], "t map<string,boolean>"
    )
    got = [r[0] for r in frame.select(narrative.tone_instruction(F.col("t"))).collect()]
    neutral = "The tone should be neutral and informative."
    assert got == ["The tone should be professional, include clear disclaimers.", neutral, neutral]


def test_salted_lookup_equals_broadcast(spark):
    settings = tn.read_tenant_config(tn.current_settings(_log(spark)))
    assert is_small(settings)
    rows = spark.range(300).selectExpr(
        "case when id % 3 = 0 then 'C' when id < 250 then 'A' else 'B' end company_id", "id customer_id", "id seq"
    )
    small, large = Tenants(settings, True), Tenants(settings, False)
    one = small.attach(rows, "currency_preference", salt_by=("customer_id", "seq"))
    two = large.attach(rows, "currency_preference", salt_by=("customer_id", "seq"))
    key = lambda r: r.customer_id
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key) and two.count() == 300


def test_status_messages_and_lookup(spark):
    statuses = spark.createDataFrame(
        [("a", 1, "QUEUED", "q"), ("a", 3, "COMPLETED", "c"), ("a", 2, "PROCESSING", "p"), ("b", 1, "QUEUED", "q"),
         ("c", 3, "FAILED", "no text"), ("d", 3, "COMPLETED", "c")],
        "job_id string, step int, status string, message string",
    )
    latest = {r.job_id: r.status for r in results.latest_status(statuses).collect()}
    assert latest == {"a": "COMPLETED", "b": "QUEUED", "c": "FAILED", "d": "COMPLETED"}
    stored = spark.createDataFrame([("a", 700.0)], "job_id string, behavioral_score double")
    asked = spark.createDataFrame([(j,) for j in "aabcde"], "job_id string")
    reply = {r.job_id: (r.reply_code, r.detail) for r in results.lookup(asked, stored, statuses).collect()}
    assert reply["a"] == (200, None)
    assert reply["b"] == (202, "Job b is still queued. Results not yet available.")
    assert reply["c"] == (400, "Job c failed: no text")
    assert reply["d"][0] == reply["e"][0] == 404
    done = spark.createDataFrame([("j", "A", "1", "x" * 300)], "job_id string, company_id string, customer_id string, analysis_summary string")
    message = results.result_messages(done).first()
    assert message.brief_summary == "x" * 200 + "..." and message.result_url.endswith("/j")
    assert '"status":"COMPLETED"' in results.as_json_messages(results.result_messages(done)).first().value


def test_results_are_written_by_tenant(spark, tmp_path):
    frame = spark.range(100).selectExpr("case when id < 70 then 'A' else 'B' end company_id", "id job_id")
    results.write_results(frame, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["company_id=A", "company_id=B"]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 100


def test_settled_frames_are_read_from_the_shared_folder(spark, capsys):
    from tabia.session import settled

    frame = spark.range(3).selectExpr("id * 2 as v")
    kept = settled(frame)
    assert sorted(r.v for r in kept.collect()) == [0, 2, 4]
    if spark.conf.get("spark.checkpoint.dir", None):
        kept.explain()
        assert "ExistingRDD" in capsys.readouterr().out
    else:
        assert kept is frame


def test_settings_log_equals_the_full_fold(spark, tmp_path):
    from tabia.sources.settings_log import SettingsLog

    log = SettingsLog.create(spark, str(tmp_path / "settings"))
    assert log.current().count() == 0
    fields = "company_id string, version bigint, currency_preference string, timezone string, max_file_size_mb int"
    batches = [
        [("A", 1, "UGX", None, 5), ("B", 7, None, "Z", None), ("C", 1, None, None, None)],
        [("A", 5, None, "X", None), ("B", 2, "TZS", "late", 3)],  # an older version in a later batch
        [("A", 5, "KES", "Y", None), ("D", 1, "USD", None, 1), (None, 1, "USD", None, None)],
        [("B", 8, None, None, 9)],
    ]
    seen = []

    def check():
        want = tn.current_settings(spark.createDataFrame(seen, fields))
        got = log.current().select(*want.columns)
        key = lambda row: tuple(str(v) for v in row)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)

    for number, rows in enumerate(batches):
        log.append(spark.createDataFrame(rows, fields), number)
        seen += rows
        check()
        if number == 1:
            log.compact(1)
            check()
    # the replay of a batch replaces it, that of a covered one changes nothing
    log.append(spark.createDataFrame(batches[3], fields), 3)
    log.append(spark.createDataFrame(batches[0], fields), 0)
    check()
    # a snapshot that no commit names is not read, and is written again
    spark.createDataFrame([("A", 99)], "company_id string, version bigint").write.parquet(str(tmp_path / "settings/snapshots/upto=3"))
    check()
    log.compact(3)
    log.compact(2)
    assert log.covered() == 3 and log.tail(3).count() == 0
    check()
    plan = log.tail(1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
