"""Statement files, OCR output and statement text as transaction rows."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabia.functions.values import STATEMENT_LINE, clean_amount, clean_date, line_type
from tabia.schemas import ENTITY, MONEY, OCR_BLOCKS

# Accepted file endings and the declared size limit.
FILE_ENDINGS = ("pdf", "jpg", "jpeg", "png")
MAX_FILE_MB = 20

# Separates the groups of a matched line: the one character that no line holds.
UNIT = "\n"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def parse_statements(statements: DataFrame, ids, text: str = "text") -> DataFrame:
    """Transactions in statement texts; ``seq`` is the line position.

    One regular-expression pass per line, before the lines become rows, as a
    filter on it would run it again: the groups are rewritten to a separated
    string and split. Lines that do not match are left out.
    """
    has_currency = "currency_preference" in statements.columns
    lines = statements.select(
        *ids,
        *(["currency_preference"] if has_currency else []),
        F.posexplode(F.transform(_lines(text), line_groups)).alias("pos", "line"),
    )
    fields = with_line_parts(lines.where(F.col("line").contains(UNIT)))
    currency = F.coalesce("currency_preference", F.lit("KES")) if has_currency else F.lit("KES")
    return fields.select(
        *ids,
        F.col("pos").cast("bigint").alias("seq"),
        *_named(line_columns(F.col("part"), F.upper(currency))),
    )


def line_groups(line: Column) -> Column:
    """A line rewritten to the separated groups of its transaction; without one it stays as it is."""
    groups = UNIT.join(f"${i}" for i in range(1, 6))
    return F.regexp_replace(line, rf"(?s)^.*?{STATEMENT_LINE}.*$", groups)


def with_line_parts(lines: DataFrame) -> DataFrame:
    """The groups of a rewritten ``line`` as ``part``."""
    return lines.withColumn("part", F.split("line", UNIT))


def _named(columns: dict[str, Column]) -> list[Column]:
    return [value.alias(name) for name, value in columns.items()]


def line_columns(part: Column, currency: Column) -> dict[str, Column]:
    """Transaction columns of the groups of a statement line."""
    amount = clean_amount(F.get(part, F.lit(2)))
    return {
        "date": clean_date(F.get(part, F.lit(0))),
        "description": F.trim(F.get(part, F.lit(1))),
        "amount": F.abs(F.coalesce(amount, F.lit(0))).cast(MONEY),
        "type": line_type(F.get(part, F.lit(3)), amount),
        "balance_after": clean_amount(F.nullif(F.get(part, F.lit(4)), F.lit(""))),
        "original_currency": currency,
    }


def entity_columns(p: Column, currency: Column) -> dict[str, Column]:
    """Transaction columns of the properties of an OCR entity."""
    has_amount = F.coalesce(F.length(p["amount"]) > 0, F.lit(False))
    has_balance = F.coalesce(F.length(p["balance"]) > 0, F.lit(False))
    return {
        "date": p["date"],
        "description": p["description"],
        "amount": F.when(has_amount, F.abs(clean_amount(p["amount"]))).otherwise(F.lit(0)).cast(MONEY),
        "type": F.lower(F.coalesce(p["type"], F.lit("unknown"))),
        "balance_after": F.when(has_balance, clean_amount(p["balance"])),
        "original_currency": currency,
    }


def malformed_entity(p: Column) -> Column:
    """Properties without a date, a description or a readable amount or balance."""
    columns = entity_columns(p, F.lit(None).cast("string"))
    has_balance = F.coalesce(F.length(p["balance"]) > 0, F.lit(False))
    return (
        p.isNull()
        | columns["amount"].isNull()
        | columns["date"].isNull()
        | columns["description"].isNull()
        | (has_balance & columns["balance_after"].isNull())
    )


def has_transactions(text: str = "text") -> Column:
    """True where a line of the text is a transaction."""
    return F.coalesce(
        F.exists(_lines(text), lambda line: F.rlike(line, F.lit(rf"(?s){STATEMENT_LINE}"))),
        F.lit(False),
    )


def failed_statements(statements: DataFrame, ids, text: str = "text") -> DataFrame:
    """Statements without a single transaction, with the whole text kept. No shuffle."""
    return statements.where(~has_transactions(text)).select(
        *ids,
        F.col(text).alias("raw_text_extracted"),
        F.lit("failed").alias("status"),
        F.lit("No transactions extracted by IDP.").alias("error"),
    )


def ocr_entity_rows(documents: DataFrame, currency: Column | None = None) -> DataFrame:
    """Document entities of type transaction_line as rows, each with the verdict ``kept`` or ``malformed``; one pass."""
    # the function keeps the explosion out of the generated method, which with it is too long to be compiled
    items = F.transform(
        "entities",
        lambda e: F.struct((e["type_"] == "transaction_line").alias("is_line"), e["properties"].alias("properties")),
    )
    lines = documents.select(
        "document_id", "company_id", "customer_id", F.posexplode(items).alias("pos", "entity")
    ).where("entity.is_line")
    p = F.col("entity.properties")
    return lines.select(
        "document_id",
        "company_id",
        "customer_id",
        F.col("pos").cast("bigint").alias("seq"),
        *_named(entity_columns(p, currency if currency is not None else F.lit(None).cast("string"))),
        F.when(malformed_entity(p), "malformed").otherwise("kept").alias("verdict"),
    )


def flatten_ocr_entities(documents: DataFrame, currency: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(transactions, malformed) from document entities of type transaction_line."""
    rows = ocr_entity_rows(documents, currency)
    return rows.where("verdict = 'kept'").drop("verdict"), rows.where("verdict = 'malformed'").drop("verdict")


def ocr_blocks_to_text(blocks: Column) -> Column:
    """LINE blocks of one OCR answer, in order, each ended by a newline."""
    lines = F.transform(
        F.filter(blocks, lambda b: b["BlockType"] == "LINE"), lambda b: F.coalesce(b["Text"], F.lit(""))
    )
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def decode_statement(content: Column) -> Column:
    """Bytes as UTF-8 text; undecodable bytes are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


# Forms of a document, in the order in which they are tried.
FORMS = ("entities", "lines", "bytes")


def with_form(documents: DataFrame) -> DataFrame:
    """Documents with their ``form``, the ``entities`` of an OCR answer and the ``text`` to read otherwise.

    ``answer`` is the JSON of an OCR service, of any shape; ``content`` the
    file's bytes. An answer with entities is read by them, one with blocks (and
    no failed ``JobStatus``) by its LINE blocks, and any other document, also one
    whose answer is missing or no JSON, by its bytes, or its text where it has no
    bytes. A tenant's ``bank_statement_formats`` that name forms are tried first.
    """
    names = documents.columns
    answer = F.try_parse_json("answer") if "answer" in names else F.lit(None).cast("variant")
    content = decode_statement(F.col("content")) if "content" in names else F.lit(None).cast("string")
    given = F.col("text") if "text" in names else F.lit(None).cast("string")
    read = documents.withColumn("_answer", answer).withColumns(
        {
            "entities": F.try_variant_get("_answer", "$.entities", f"array<{ENTITY.simpleString()}>"),
            "_blocks": F.try_variant_get("_answer", "$.Blocks", OCR_BLOCKS.simpleString()),
            "_status": F.try_variant_get("_answer", "$.JobStatus", "string"),
            "_full": F.try_variant_get("_answer", "$.text", "string"),
        }
    )
    there = {
        "entities": F.col("entities").isNotNull(),
        "lines": F.col("_blocks").isNotNull() & (F.coalesce("_status", F.lit("SUCCEEDED")) == "SUCCEEDED"),
        "bytes": F.lit(True),
    }
    wanted = F.coalesce("bank_statement_formats", F.array()) if "bank_statement_formats" in names else F.array()
    wanted = F.concat(wanted.cast("array<string>"), F.array(*[F.lit(f) for f in FORMS]))
    having = F.array_compact(F.array(*[F.when(there[f], f) for f in FORMS]))
    text = (
        F.when(F.col("form") == "lines", ocr_blocks_to_text(F.col("_blocks")))
        .when(F.col("form") == "entities", F.col("_full"))
        .otherwise(F.coalesce(content, given))
    )
    return (
        read.withColumn("form", F.get(F.filter(wanted, lambda f: F.array_contains(having, f)), F.lit(0)))
        .withColumns({"text": text, "entities": F.when(F.col("form") == "entities", F.col("entities"))})
        .drop("_answer", "_blocks", "_status", "_full")
    )


def document_transactions(documents: DataFrame, ids) -> DataFrame:
    """Transactions of documents of any form, with ``form`` and the verdict ``kept`` or ``malformed``.

    ``documents`` come from ``with_form``. One pass: a document becomes its
    transaction entities or its lines, and every item is read by its own form.
    ``seq`` is the place of the entity or line in its document.
    """
    has_currency = "currency_preference" in documents.columns
    currency = F.coalesce("currency_preference", F.lit("KES")) if has_currency else F.lit("KES")
    nothing = F.lit(None).cast(ENTITY)
    items = F.when(
        F.col("form") == "entities",
        F.transform("entities", lambda e: F.struct(e.alias("entity"), F.lit(None).cast("string").alias("line"))),
    ).otherwise(F.transform(_lines("text"), lambda x: F.struct(nothing.alias("entity"), line_groups(x).alias("line"))))
    rows = documents.select(
        *ids, "form", F.upper(currency).alias("_currency"), F.posexplode(items).alias("pos", "item")
    ).select(*ids, "form", "_currency", "pos", "item.entity", "item.line")
    found = with_line_parts(
        rows.where(
            F.when(F.col("form") == "entities", F.col("entity.type_") == "transaction_line").otherwise(
                F.col("line").contains(UNIT)
            )
        )
    )
    p, by_entity = F.col("entity.properties"), F.col("form") == "entities"
    entity, line = entity_columns(p, F.col("_currency")), line_columns(F.col("part"), F.col("_currency"))
    return found.select(
        *ids,
        F.col("pos").cast("bigint").alias("seq"),
        *[F.when(by_entity, entity[c]).otherwise(line[c]).alias(c) for c in entity],
        "form",
        F.when(by_entity & malformed_entity(p), "malformed").otherwise("kept").alias("verdict"),
    )


def without_transactions(documents: DataFrame) -> Column:
    """True for a document of ``with_form`` in which no transaction can be read."""
    readable = F.exists(
        "entities",
        lambda e: F.coalesce(e["type_"] == "transaction_line", F.lit(False)) & ~malformed_entity(e["properties"]),
    )
    return ~F.when(F.col("form") == "entities", F.coalesce(readable, F.lit(False))).otherwise(has_transactions("text"))


def read_statement_files(spark: SparkSession, root: str, streaming: bool = False, **options) -> DataFrame:
    """Files under root/company/customer/bank_statements/<time>_<name>."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true").options(**options)
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    return with_path_ids(reader.load(root))


def with_path_ids(files: DataFrame) -> DataFrame:
    key = r"([^/]+)/([^/]+)/bank_statements/([^/]+)$"
    return files.select(
        F.regexp_extract("path", key, 1).alias("company_id"),
        F.regexp_extract("path", key, 2).alias("customer_id"),
        F.regexp_replace(F.regexp_extract("path", key, 3), r"^\d{14}_", "").alias("filename"),
        F.col("path").alias("file_url"),
        "modificationTime",
        "length",
        "content",
    ).where(F.col("company_id") != "")


def gate_files(files: DataFrame, enforce_size: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) by file ending, and by size where asked for.

    Tenant columns ``supported_file_types`` and ``max_file_size_mb`` are used
    when the files carry them.
    """
    ending = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    kind = F.when(ending == "jpeg", "jpg").otherwise(ending)
    accepted = ending.isin(*FILE_ENDINGS)
    if "supported_file_types" in files.columns:
        accepted = accepted & F.coalesce(
            F.array_contains("supported_file_types", kind) | F.array_contains("supported_file_types", ending),
            F.lit(True),
        )
    if enforce_size:
        limit = (
            F.coalesce("max_file_size_mb", F.lit(MAX_FILE_MB))
            if "max_file_size_mb" in files.columns
            else F.lit(MAX_FILE_MB)
        )
        accepted = accepted & (F.col("length") <= limit.cast("bigint") * 1024 * 1024)
    return files.where(accepted), files.where(~accepted)
