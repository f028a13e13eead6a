"""Input schemas. Sources are always read with these, never inferred."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Customer key; every table of the engine carries it.
KEY = ("company_id", "customer_id")

TRANSACTION_FIELDS = [
    T.StructField("date", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("balance_after", MONEY),
    T.StructField("original_currency", T.StringType()),
]

TRANSACTION = T.StructType(TRANSACTION_FIELDS)

TRANSACTION_TABLE = T.StructType(
    [
        T.StructField("company_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        *TRANSACTION_FIELDS,
    ]
)

TRANSACTION_LIST = T.StructType(
    [
        T.StructField("company_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("transactions", T.ArrayType(TRANSACTION)),
    ]
)

BUREAU_RECORD = T.StructType(
    [
        T.StructField("credit_history_months", T.IntegerType()),
        T.StructField("payment_performance_score", T.DoubleType()),
        T.StructField("recent_late_payments", T.IntegerType()),
        T.StructField("credit_utilization_ratio", T.DoubleType()),
        T.StructField("credit_types", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("credit_inquiries", T.IntegerType()),
        T.StructField(
            "accounts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("account_type", T.StringType()),
                        T.StructField("status", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

UNIFIED_REQUEST = T.StructType(
    [
        T.StructField("company_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("bank_transactions", T.ArrayType(TRANSACTION)),
        T.StructField("crb_data", BUREAU_RECORD),
        T.StructField("mobile_money_transactions", T.ArrayType(TRANSACTION)),
        T.StructField("data_sources", T.ArrayType(T.StringType())),
        T.StructField("callback_url", T.StringType()),
    ]
)

ENTITY = T.StructType(
    [
        T.StructField("type_", T.StringType()),
        T.StructField(
            "properties",
            T.StructType(
                [
                    T.StructField(name, T.StringType())
                    for name in ("date", "description", "amount", "type", "balance")
                ]
            ),
        ),
    ]
)

OCR_ENTITIES = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("company_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("entities", T.ArrayType(ENTITY)),
    ]
)

OCR_BLOCKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("BlockType", T.StringType()),
            T.StructField("Text", T.StringType()),
        ]
    )
)

JOB = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("job_id", "company_id", "customer_id", "file_url", "filename", "callback_url")
    ]
)

WEIGHTS = T.MapType(T.StringType(), T.DoubleType())
TONE = T.MapType(T.StringType(), T.BooleanType())
CATEGORY_RULES = T.ArrayType(
    T.StructType(
        [
            T.StructField("category", T.StringType()),
            T.StructField("keywords", T.ArrayType(T.StringType())),
        ]
    )
)
CATEGORY_RULE_OBJECT = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
