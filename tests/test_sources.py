"""Ingest, cleaning, statements, OCR output, files and requests."""

import json

import pytest
from pyspark.sql import functions as F

from tabia.functions.text import category, lowered
from tabia.functions.values import clean_amount, clean_date, line_type, parse_date
from tabia.sources import statements as stm
from tabia.sources import transactions as src
from tests.helpers import money


def column(spark, expr, values, kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in frame.select(expr(F.col("v"))).collect()]


def test_parse_date(spark):
    got = column(
        spark,
        parse_date,
        ["2023-01-05", "5 Jan 2023", "05  Jan  2023", "2023-01-05T10:11:12", "2023-01-05 23:59:59+02:00", "nope", "", None, "2023-02-30"],
    )
    assert [str(d) if d else None for d in got] == ["2023-01-05"] * 5 + [None] * 4


def test_clean_date_keeps_unparsable_text(spark):
    assert column(spark, clean_date, ["1 Jan 2023", "31  Dec 2023", "2023-02-30", "2023-02-03"]) == [
        "2023-01-01", "2023-12-31", "2023-02-30", "2023-02-03",
    ]


def test_clean_amount(spark):
    assert column(spark, clean_amount, ["KSh 1,500.00", "-KES 12.50", "1500.00", "abc", ""]) == [
        money(1500), money("-12.5"), money(1500), None, None,
    ]


def test_line_type(spark):
    frame = spark.createDataFrame([("DR", 5), ("DR", -5), ("CR", 5), ("", -5), ("", 5)], "h string, a int")
    got = [r[0] for r in frame.select(line_type(F.col("h"), F.col("a"))).collect()]
    assert got == ["debit", "debit", "credit", "debit", "credit"]


def test_parse_statements(spark):
    text = "\n".join(
        [
            "HEADER",
            "  01 Jan 2023 SALARY 1,500.00 CR 2,000.00",
            "2023-01-02 PAYMENT KES 100.00 DR",
            "2023-01-03 FEE -KSh 12.50",
            "2023-01-04 PLAIN 1500.00",
            "2023-01-05 REF 12 UNIT 3 20.00 1234567.89 trailing",
            "no date 12.00",
            "2023-01-06 TAB\tHERE\r 7.00 CR",
            "31 Feb 2023 ODD 1.00",
        ]
    )
    rows = stm.parse_statements(
        spark.createDataFrame([("s", "A", "c", text)], "id string, company_id string, customer_id string, text string"),
        ["id"],
    ).orderBy("seq").collect()
    got = [(r.seq, r.date, r.description, r.amount, r.type, r.balance_after) for r in rows]
    assert got == [
        (1, "2023-01-01", "SALARY", money(1500), "credit", money(2000)),
        (2, "2023-01-02", "PAYMENT", money(100), "debit", None),
        (3, "2023-01-03", "FEE", money("12.5"), "debit", None),
        (4, "2023-01-04", "PLAIN", money(1500), "credit", None),
        (5, "2023-01-05", "REF 12 UNIT 3", money(20), "credit", money("1234567.89")),
        (7, "2023-01-06", "TAB\tHERE", money(7), "credit", None),
        (8, "31 Feb 2023", "ODD", money(1), "credit", None),
    ]
    assert {r.original_currency for r in rows} == {"KES"}


def test_statement_separator_in_text_is_harmless(spark):
    frame = spark.createDataFrame([("s", "a\u001fb\u001fc\n2023-01-01 X\u001fY 1.00")], "id string, text string")
    (row,) = stm.parse_statements(frame, ["id"]).collect()
    assert (row.description, row.amount) == ("X\u001fY", money(1))


def test_failed_statements(spark):
    frame = spark.createDataFrame([("a", "2023-01-01 X 1.00"), ("b", "junk"), ("c", None)], "id string, text string")
    failed = stm.failed_statements(frame, ["id"]).orderBy("id").collect()
    assert [(r.id, r.raw_text_extracted) for r in failed] == [("b", "junk"), ("c", None)]


def test_ocr_entities(spark, tmp_path):
    def entity(kind="transaction_line", **p):
        return {"type_": kind, "properties": p}

    doc = {
        "document_id": "d", "company_id": "A", "customer_id": "c",
        "entities": [
            entity("total", amount="1"),
            entity(date="2023-01-01", description="x", amount="KES -1,200.50", type="DEBIT", balance="300.00"),
            entity(date="2023-01-02", description="y", amount="7"),
            entity(date="2023-01-02", description="z"),
            entity(date="2023-01-03", description="bad", amount="..", type="CREDIT"),
        ],
    }
    path = tmp_path / "ocr.json"
    path.write_text(json.dumps(doc))
    from tabia.schemas import OCR_ENTITIES

    kept, malformed = stm.flatten_ocr_entities(spark.read.schema(OCR_ENTITIES).json(str(path)), F.lit("UGX"))
    got = [(r.seq, r.amount, r.type, r.balance_after, r.original_currency) for r in kept.orderBy("seq").collect()]
    assert got == [
        (1, money("1200.5"), "debit", money(300), "UGX"),
        (2, money(7), "unknown", None, "UGX"),
        (3, money(0), "unknown", None, "UGX"),
    ]
    assert [r.description for r in malformed.collect()] == ["bad"]


def test_ocr_blocks(spark):
    frame = spark.createDataFrame(
        [([("PAGE", None), ("LINE", "a"), ("WORD", "w"), ("LINE", "b")],), ([("PAGE", None)],)],
        "b array<struct<BlockType:string,Text:string>>",
    )
    assert [r[0] for r in frame.select(stm.ocr_blocks_to_text(F.col("b"))).collect()] == ["a\nb\n", ""]


def test_files_ids_decode_and_gate(spark, tmp_path):
    folder = tmp_path / "T1" / "c9" / "bank_statements"
    folder.mkdir(parents=True)
    (folder / "20230101120000_jan.pdf").write_bytes(b"2023-01-01 X\xff 1.00 CR\n")
    (folder / "20230101120001_page.JPEG").write_bytes(b"x")
    (folder / "20230101120002_note.txt").write_bytes(b"x")
    (folder / "20230101120003_big.png").write_bytes(b"x" * (1024 * 1024 + 1))
    files = stm.read_statement_files(spark, str(tmp_path))
    accepted, refused = stm.gate_files(files)
    assert sorted(r.filename for r in accepted.collect()) == ["big.png", "jan.pdf", "page.JPEG"]
    assert [r.filename for r in refused.collect()] == ["note.txt"]
    limited, _ = stm.gate_files(files.withColumn("max_file_size_mb", F.lit(1)), enforce_size=True)
    assert sorted(r.filename for r in limited.collect()) == ["jan.pdf", "page.JPEG"]
    pdf_only, _ = stm.gate_files(files.withColumn("supported_file_types", F.array(F.lit("pdf"))))
    assert [r.filename for r in pdf_only.collect()] == ["jan.pdf"]
    row = (
        files.where("filename = 'jan.pdf'")
        .select("company_id", "customer_id", stm.decode_statement(F.col("content")).alias("text"))
        .first()
    )
    assert (row.company_id, row.customer_id, row.text) == ("T1", "c9", "2023-01-01 X 1.00 CR\n")


def test_transaction_lists_and_unified_split(spark, tmp_path):
    txn = {"date": "2023-01-01", "description": "d", "amount": 5, "type": "debit"}
    request = {
        "company_id": "A", "customer_id": "1", "bank_transactions": [txn, {**txn, "amount": 6}],
        "crb_data": {"credit_history_months": 5, "payment_performance_score": 50, "credit_utilization_ratio": 10,
                     "credit_types": {"loan": 1}, "accounts": [{"account_type": "loan", "status": "open"}]},
        "data_sources": ["bank_transactions", "crb_data"],
    }
    other = {"company_id": "A", "customer_id": "2", "mobile_money_transactions": [txn], "data_sources": []}
    (tmp_path / "r.json").write_text(json.dumps(request) + "\n" + json.dumps(other))
    parts = src.split_unified(src.read_unified_requests(spark, str(tmp_path / "r.json")))
    assert [(r.customer_id, r.seq, r.amount) for r in parts["bank"].orderBy("seq").collect()] == [
        ("1", 0, money(5)), ("1", 1, money(6)),
    ]
    assert [r.customer_id for r in parts["mobile"].collect()] == ["2"]
    (crb,) = parts["crb"].collect()
    assert crb.credit_history_months == 5 and crb.credit_types == {"loan": 1}
    (tmp_path / "l.json").write_text(json.dumps({"company_id": "A", "customer_id": "1", "transactions": [txn]}))
    assert src.read_transaction_lists(spark, str(tmp_path / "l.json")).first().seq == 0
    parts["bank"].write.parquet(str(tmp_path / "t"))
    assert src.read_transactions(spark, str(tmp_path / "t")).count() == 2


def test_bureau_validation(spark):
    frame = spark.createDataFrame(
        [
            ("ok", 1, 100.0, None, 0.0, None),
            ("high", 1, 100.5, 0, 0.0, 0),
            ("low", 1, -0.5, 0, 0.0, 0),
            ("late", 1, 50.0, -1, 0.0, 0),
            ("used", 1, 50.0, 0, 101.0, 0),
            ("none", None, 50.0, 0, 1.0, 0),
        ],
        "customer_id string, credit_history_months int, payment_performance_score double,"
        " recent_late_payments int, credit_utilization_ratio double, credit_inquiries int",
    )
    valid, rejected = src.read_crb(frame)
    (row,) = valid.collect()
    assert (row.customer_id, row.recent_late_payments, row.credit_inquiries) == ("ok", 0, 0)
    assert rejected.count() == 5


def test_scope(spark):
    frame = spark.createDataFrame([("A", "1"), ("", "1"), ("A", None), (" ", "2")], "company_id string, customer_id string")
    inside, outside = src.scoped(frame)
    assert inside.count() == 1 and outside.count() == 3


RULES = "array<struct<category:string,keywords:array<string>>>"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Savings deposit", "income"),  # the first rule wins
        ("INVESTMENT", "savings"),
        ("Insurance premium", "Uncategorized"),
        ("Uber trip", "transport"),
        (None, "Uncategorized"),
        ("Transfer FROM x", "transfer_in"),
    ],
)
def test_default_categories(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "d string")
    assert frame.select(category(lowered(F.col("d")), F.lit(None).cast(RULES))).first()[0] == expected


def test_tenant_categories_keep_rule_order(spark):
    frame = spark.createDataFrame(
        [("Savings deposit", [("savings", ["savings"]), ("income", ["deposit"])]), ("zzz", [("a", ["b"])]), ("rent", [])],
        f"d string, r {RULES}",
    )
    got = [r[0] for r in frame.select(category(lowered(F.col("d")), F.col("r"))).collect()]
    assert got == ["savings", "Uncategorized", "rent"]


def test_seq_counts_on_over_the_lists_of_a_customer(spark, tmp_path):
    from tabia.sources.transactions import read_transaction_lists

    def txn(n):
        return {"date": "2023-01-01", "description": f"d{n}", "amount": n, "type": "debit"}

    lists = [("a", "1", "t2", [1, 2]), ("a", "1", "t1", [3]), ("a", "1", "t3", []), ("a", "1", "t4", [4, 5, 6]),
             ("a", "1", "t4", [4, 5, 6]), ("b", "1", "t1", [7]), ("a", "1", "t0", None)]
    rows = [{"company_id": c, "customer_id": k, "sent": t, "transactions": None if x is None else list(map(txn, x))} for c, k, t, x in lists]
    (tmp_path / "lists.json").write_text("\n".join(map(json.dumps, rows)))
    got = read_transaction_lists(spark, str(tmp_path / "lists.json"), order="sent").collect()
    by = {}
    for r in got:
        by.setdefault(r.company_id, []).append((r.seq, r.description))
    assert [d for _, d in sorted(by["a"])] == ["d3", "d1", "d2", "d4", "d5", "d6", "d4", "d5", "d6"]
    assert [s for s, _ in sorted(by["a"])] == list(range(9)) and by["b"] == [(0, "d7")]
    hashed = read_transaction_lists(spark, str(tmp_path / "lists.json")).where("company_id = 'a'").collect()
    assert sorted(r.seq for r in hashed) == list(range(9))


def test_one_bureau_record_of_a_customer(spark):
    from tabia.sources.transactions import latest_crb

    fields = "company_id string, customer_id string, day int, credit_history_months int, payment_performance_score double, credit_utilization_ratio double, recent_late_payments int, credit_inquiries int"
    rows = [("a", "1", 1, 5, 50.0, 10.0, None, 1), ("a", "1", 2, 6, 60.0, 10.0, 0, None), ("a", "1", 3, 7, 170.0, 10.0, 0, 0),
            ("a", "2", 1, 5, 50.0, 10.0, 0, 0), ("a", "2", 1, 5, 50.0, 10.0, 0, 0), ("b", "1", 1, None, 1.0, 1.0, 0, 0)]
    kept, others = latest_crb(spark.createDataFrame(rows, fields), "day")
    assert sorted((r.company_id, r.customer_id, r.day) for r in kept.collect()) == [("a", "1", 2), ("a", "2", 1), ("b", "1", 1)]
    assert sorted((r.customer_id, r.day) for r in others.collect()) == [("1", 1), ("1", 3)]
    from tabia.sources.transactions import one_crb

    frame = spark.createDataFrame(rows, fields)
    for order in ("day", None):
        kept, _ = latest_crb(frame, order)
        assert sorted(map(str, one_crb(frame, order).select(*kept.columns).collect())) == sorted(map(str, kept.collect()))


def test_required_fields_and_customers_without_a_usable_row(spark):
    from tabia.plans import modules
    from tabia.sources.tenants import current_settings, read_tenant_config
    from tests.helpers import TXN, transactions

    good = ("1", 1, "2023-01-01", "SALARY", 2000, "credit", None)
    rows = transactions(spark, [
        good, ("1", 2, "2023-01-02", "x", None, "debit", None), ("1", 3, "2023-01-02", None, 5, "debit", None),
        ("1", 4, "2023-01-02", "x", 5, None, None), ("1", 5, None, "x", 5, "debit", None),
        ("2", 1, "soon", "x", 5, "debit", None), ("3", 1, "2023-01-01", "x", None, "debit", None),
    ])
    log = spark.createDataFrame([], "company_id string, version bigint, currency_preference string")
    tenants = modules.Tenants(read_tenant_config(current_settings(log)))
    txn = modules.prepared(rows, tenants)
    assert [r.seq for r in txn.collect()] == [1]
    alone = {r.customer_id: r.bank_score for r in modules.bank_score(modules.prepared(transactions(spark, [good]), tenants), tenants).collect()}
    scores = {r.customer_id: r for r in modules.bank_score(txn, tenants, modules.customers_of(rows)).collect()}
    assert set(scores) == {"1", "2", "3"} and scores["1"].bank_score == alone["1"]
    assert scores["2"].bank_score == scores["3"].bank_score and scores["2"].components == scores["3"].components
    none = spark.createDataFrame([], TXN)
    records = spark.createDataFrame(
        [("A", "1", 5, 50.0, 10.0, 0, 0), ("A", "1", 5, 60.0, 10.0, 0, 0), ("A", "2", 5, 160.0, 10.0, 0, 0)],
        "company_id string, customer_id string, credit_history_months int, payment_performance_score double, credit_utilization_ratio double, recent_late_payments int, credit_inquiries int",
    )
    found = sorted((r.source, r.customer_id, r.seq or 0, r.reason) for r in modules.quarantined(rows, records, none).collect())
    missing = "required field missing"
    assert found == [
        ("bank", "1", 2, missing), ("bank", "1", 3, missing), ("bank", "1", 4, missing), ("bank", "1", 5, missing),
        ("bank", "2", 1, "unparsable date"), ("bank", "3", 1, missing),
        ("crb", "1", 0, "another record of the customer is kept"), ("crb", "2", 0, "missing or out of range"),
    ]
