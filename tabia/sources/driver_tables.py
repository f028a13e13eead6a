"""The engine's inputs derived from the star-schema test tables.

Plain arithmetic over whole tables, the same rows on every run. Which customers
miss a source follows from their market segment.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ``seq`` below is made of keys and numbers a customer's rows sparsely (an order
# takes 10 million), so a split covers a wider range of it.
BANK_SPAN = 10**14
# A span that cuts many of the days of the test tables into several splits.
NARROW_SPAN = 10**10

BANK_TXN = """
select concat('T', cast(c_nationkey as string)) company_id, c_custkey customer_id,
 (l_orderkey*10+l_linenumber)*1000000 + l_partkey%1000*1000 + l_suppkey%1000 seq,
 case when l_suppkey=13 and l_partkey%4=0 then 'not-a-date' else cast(date_add(date'2023-01-01', cast(case when c_custkey%10=0 then l_orderkey%3 when c_custkey%10=1 then l_orderkey%28 else l_orderkey%180 end as int)) as string) end date,
 case when (l_orderkey+l_linenumber)%3=0 then element_at(array('SALARY DEPOSIT','Payroll credit','Savings deposit','Investment payout','Transfer from J','Loan disbursement','Refund','Dividend'), cast(l_partkey%8 as int)+1) else element_at(array('RENT PAYMENT','KPLC prepaid','Uber trip','NAIVAS grocery','Loan payment','Restaurant','ATM withdrawal','Transfer to K','Insurance premium','Mortgage instalment','Fuel','Misc','Water bill','Cinema movie','Carrefour','Cash out'), cast(l_partkey%16 as int)+1) end description,
 cast(case when (l_orderkey+l_linenumber)%3=0 then l_extendedprice*(1+c_custkey%4) else l_extendedprice*(case when l_partkey%37=0 then 10 else 1 end)/(1+(c_custkey%3)*20) end as decimal(18,2)) amount,
 case when l_partkey%97=0 then 'unknown' when (l_orderkey+l_linenumber)%3=0 then 'credit' else 'debit' end type,
 case when c_custkey%7=0 or (c_custkey%5=0 and l_linenumber%2=0) then null else cast(c_acctbal*(c_custkey%30)+l_linenumber*100 as decimal(18,2)) end balance_after,
 c_mktsegment segment
from {lineitem} join ({orders} join {customer} on o_custkey=c_custkey) on l_orderkey=o_orderkey
"""

MOBILE_TXN = """
select concat('T', cast(c_nationkey as string)) company_id, user_id customer_id, event_id seq, cast(cast(ts as date) as string) date,
 case when user_id%4=3 and event_type in ('click','view') and event_id%5<>0 then 'Airtime' when user_id%4=2 and event_type='error' and event_id%9<>0 then 'Airtime' else case event_type when 'purchase' then 'M-PESA Pay Merchant' when 'click' then 'M-PESA Send Money' when 'view' then 'M-PESA Receive Money' when 'signup' then 'Agent deposit' when 'error' then 'Fuliza Loan Repayment' end end description,
 cast(value*(case when event_type in ('view','signup') then 40 else 1+(user_id%8)*60 end)*(case when event_type='error' and user_id%3=0 then 0.02D else 1.0D end) as decimal(18,2)) amount,
 case when event_type in ('view','signup') then 'credit' else 'debit' end type, cast(null as decimal(18,2)) balance_after
from {events} join {customer} on user_id=c_custkey
"""

# Some records are out of range and some optional fields are missing, for the validator.
CRB = """
select concat('T', cast(c_nationkey as string)) company_id, c_custkey customer_id,
 cast(c_custkey*7%60 as int) credit_history_months,
 cast(c_custkey*13%104 as double) payment_performance_score,
 cast(nullif(c_custkey%7, 6) as int) recent_late_payments,
 cast(c_custkey*17%103 as double) credit_utilization_ratio,
 cast(nullif(c_custkey%9, 8) as int) credit_inquiries,
 map_from_arrays(slice(array('loan','card','mortgage','overdraft'), 1, cast(c_custkey%5 as int)), slice(array(1,2,1,3), 1, cast(c_custkey%5 as int))) credit_types,
 transform(slice(array('open','closed','open'), 1, cast(c_custkey%4 as int)), s -> named_struct('account_type','loan','status',s)) accounts
from {customer}
"""

# Customers without a bank or a bureau record, for the queries about absent sources.
LINKED_BANK = "segment <> 'FURNITURE'"
LINKED_CRB = " where c_mktsegment <> 'MACHINERY' and (c_mktsegment <> 'FURNITURE' or c_acctbal >= 0)"

# JSON settings that the derived updates carry.
RULES_JSON = (
    '[{"category":"savings","keywords":["savings","investment"]},'
    '{"category":"income","keywords":["salary","payroll","deposit"]},'
    '{"category":"loan_repayment","keywords":["loan payment","instalment"]}]'
)
RULES_OBJECT_JSON = (
    '{"income":["Salary","dividend"],"housing":["rent","mortgage"],"savings":["deposit"]}'
)
BANK_WEIGHTS_JSON = '{"high_balance_bonus":150,"overdraft_penalty":90,"anomaly_penalty":10}'
CRB_WEIGHTS_JSON = '{"long_credit_history_bonus":30,"late_payment_penalty_per_instance":25}'
MOBILE_WEIGHTS_JSON = '{"digital_inclusion_bonus":40,"high_loan_dependency_penalty":70}'
UNIFIED_WEIGHTS_JSON = '{"good_data_completeness_bonus":10,"anomaly_penalty_per_anomaly":5}'
BAD_JSON = "none yet"
TONE_JSON = '{"professional":false,"concise":true,"avoid_jargon":true}'


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def bank_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BANK_TXN, **load(spark, sf_dir, "lineitem", "orders", "customer"))


def linked_bank_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank transactions of the customers that link a bank in a unified request."""
    return bank_txn(spark, sf_dir).where(LINKED_BANK)


def partly_undated_bank_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bank transactions; those of every eleventh customer have no readable date."""
    date = F.when(F.col("customer_id") % 11 == 0, "not-a-date").otherwise(F.col("date"))
    return bank_txn(spark, sf_dir).withColumn("date", date)


def transaction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a list of bank transactions, one for each order of a customer."""
    fields = "date", "description", "amount", "type", "balance_after"
    listed = bank_txn(spark, sf_dir).groupBy(
        "company_id", "customer_id", F.expr("seq div 10000000").alias("request")
    ).agg(F.sort_array(F.collect_list(F.struct("seq", *fields))).alias("rows"))
    return listed.select(
        "company_id", "customer_id", "request",
        F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in fields])).alias("transactions"),
    )


def crb_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bureau records by report: a customer has one, two or three, some of them out of range."""
    number = F.explode(F.sequence(F.lit(1), (F.col("customer_id") % 3 + 1).cast("int")))
    return crb(spark, sf_dir).withColumn("report", number).withColumn(
        "payment_performance_score", (F.col("customer_id") * 13 + F.col("report") * 31) % 104 * 1.0
    )


def mobile_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MOBILE_TXN, **load(spark, sf_dir, "events", "customer"))


def crb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CRB, **load(spark, sf_dir, "customer"))


def linked_crb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bureau records of the customers that have one in a unified request."""
    return spark.sql(CRB + LINKED_CRB, **load(spark, sf_dir, "customer"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job documents: by turns an OCR answer with entities, one with blocks, and plain bytes."""
    turn = F.col("seq") % 3
    blocks = F.transform(
        F.split("text", "\n"),
        lambda line: F.array(
            F.struct(F.lit("LINE").alias("BlockType"), line.alias("Text")),
            F.struct(F.lit("WORD").alias("BlockType"), line.alias("Text")),
        ),
    )
    by_blocks = F.to_json(F.struct(F.lit("SUCCEEDED").alias("JobStatus"), F.flatten(blocks).alias("Blocks")))
    by_entities = F.to_json(F.struct(F.expr(ENTITIES).alias("entities")))
    return (
        bank_txn(spark, sf_dir)
        .withColumn("text", slip_text())
        .select(
            *_slip_keys("document_id"),
            F.when(turn == 0, by_entities).when(turn == 1, by_blocks).alias("answer"),
            F.col("text").cast("binary").alias("content"),
        )
    )


def tenant_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of partial tenant updates, one per supplier; region 0 has none."""
    t = load(spark, sf_dir, "supplier", "nation")
    key, nation = F.col("s_suppkey"), F.col("n_nationkey")

    def some(condition, text):
        return F.when(condition, F.lit(text))

    return (
        t["supplier"]
        .join(t["nation"].where(F.col("n_regionkey") != 0), F.col("s_nationkey") == nation)
        .select(
            F.concat(F.lit("T"), nation.cast("string")).alias("company_id"),
            key.alias("version"),
            F.when(nation % 3 == 0, "KES").when(nation % 3 == 1, "UGX").alias("currency_preference"),
            some(key % 4 == 1, "sw").alias("language_preference"),
            F.when(nation % 5 == 2, RULES_JSON)
            .when(nation % 5 == 4, RULES_OBJECT_JSON)
            .when(nation % 5 == 0, BAD_JSON)
            .alias("transaction_categorization_rules"),
            some(nation % 5 == 1, BANK_WEIGHTS_JSON).alias("bank_scoring_weights"),
            some(nation % 5 == 1, CRB_WEIGHTS_JSON).alias("crb_scoring_weights"),
            some(nation % 5 == 3, MOBILE_WEIGHTS_JSON).alias("mobile_money_scoring_weights"),
            some(nation % 5 == 3, UNIFIED_WEIGHTS_JSON).alias("behavioral_scoring_weights"),
            some(nation % 2 == 0, TONE_JSON).alias("llm_tone_guidelines"),
            F.when(key % 3 == 0, (key % 40).cast("int") + 1).alias("max_file_size_mb"),
        )
    )


def slip_text() -> Column:
    """A statement text of one bank transaction, with a fee line."""
    c = F.col
    iso = c("customer_id") % 2 == 0
    day = F.when(iso, c("date")).otherwise(
        F.coalesce(F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "d MMM yyyy"), c("date"))
    )
    return F.concat(
        F.lit("STATEMENT OF ACCOUNT\nopening balance 0.00\n"),
        day,
        F.lit("  "),
        c("description"),
        F.lit(" "),
        F.when(c("seq") % 5 == 0, "KES ").otherwise(""),
        F.when((c("type") == "debit") & (c("seq") % 3 == 0), "-").otherwise(""),
        F.when(c("seq") % 2 == 0, F.format_number("amount", 2)).otherwise(c("amount").cast("string")),
        F.when(c("seq") % 3 == 0, "").when(c("type") == "debit", " DR").otherwise(" CR"),
        F.when(c("balance_after").isNull() | (c("balance_after") < 0), "").otherwise(
            F.concat(F.lit(" "), F.format_number("balance_after", 2))
        ),
        F.lit("\n"),
        day,
        F.lit(" LEDGER FEE -KSh 12.50\nend of statement 2023"),
    )


# A header and one transaction_line of a bank transaction.
ENTITIES = """array(
  named_struct('type_','header','properties', named_struct('date',date,'description','Statement',
    'amount',cast(null as string),'type',cast(null as string),'balance',cast(null as string))),
  named_struct('type_','transaction_line','properties', named_struct('date',date,'description',description,
    'amount', concat('KES ', case when type='debit' then '-' else '' end, format_number(amount,2)),
    'type', case when type='unknown' then cast(null as string) else upper(type) end,
    'balance', case when balance_after < 0 then 'overdrawn' else format_number(balance_after,2) end)))"""


def _slip_keys(id_name: str) -> list[Column]:
    return [
        F.concat(F.lit("S"), F.col("seq").cast("string")).alias(id_name),
        F.col("company_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
    ]


def bank_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement text per bank transaction."""
    return bank_txn(spark, sf_dir).select(*_slip_keys("statement_id"), slip_text().alias("text"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement texts: the slips of the bank transactions, and the documents as they are."""
    c = F.col
    docs = load(spark, sf_dir, "documents")["documents"].select(
        F.concat(F.lit("D"), c("doc_id").cast("string")).alias("statement_id"),
        c("source").alias("company_id"),
        c("doc_id").cast("string").alias("customer_id"),
        "text",
    )
    return bank_slips(spark, sf_dir).unionByName(docs)


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR answers: a page block, and each document's lines as LINE blocks among WORD blocks."""
    docs = load(spark, sf_dir, "documents")["documents"]
    return docs.select(
        "doc_id",
        F.expr(
            """concat(array(named_struct('BlockType','PAGE','Text',cast(null as string))),
               flatten(transform(split(text, '\\n'), l -> array(
                 named_struct('BlockType','LINE','Text',l),
                 named_struct('BlockType','WORD','Text',substring_index(l,' ',1))))))"""
        ).alias("Blocks"),
    )


def ocr_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document entities: a header and one transaction_line per bank transaction."""
    return bank_txn(spark, sf_dir).select(*_slip_keys("document_id"), F.expr(ENTITIES).alias("entities"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status log of one job per order: open orders are being processed or queued."""
    orders = load(spark, sf_dir, "orders")["orders"]
    job = F.concat(F.lit("J"), F.col("o_orderkey").cast("string"))
    last = F.col("o_orderstatus")
    steps = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("step"), F.lit("QUEUED").alias("status"),
                     F.lit("Job queued for processing.").alias("message")),
            F.when(last != "P", F.struct(F.lit(2).alias("step"), F.lit("PROCESSING").alias("status"),
                     F.lit("Starting IDP processing...").alias("message"))),
            F.when(last == "F", F.struct(F.lit(3).alias("step"), F.lit("COMPLETED").alias("status"),
                     F.lit("Analysis completed successfully.").alias("message"))),
            F.when((last == "O") & (F.col("o_totalprice") < 100000),
                   F.struct(F.lit(3).alias("step"), F.lit("FAILED").alias("status"),
                     F.lit("Analysis failed: no text").alias("message"))),
        )
    )
    return orders.select(job.alias("job_id"), F.explode(steps).alias("s")).select("job_id", "s.*")


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of the completed jobs."""
    orders = load(spark, sf_dir, "orders")["orders"]
    return orders.where(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("J"), F.col("o_orderkey").cast("string")).alias("job_id"),
        F.least(F.lit(1000.0), F.col("o_totalprice") / 500).alias("behavioral_score"),
    )


def asked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job ids somebody asks for: all orders, and ids no job has."""
    t = load(spark, sf_dir, "orders", "events")
    return (
        t["orders"]
        .select(F.concat(F.lit("J"), F.col("o_orderkey").cast("string")).alias("job_id"))
        .unionByName(
            t["events"].select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("job_id"))
        )
    )
