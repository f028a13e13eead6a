"""Tenant settings: an append-only log of partial updates, folded when read."""

import json

from pyspark.sql import Column, DataFrame, functions as F

from tabia.functions.text import DEFAULT_CATEGORY_RULES
from tabia.schemas import CATEGORY_RULE_OBJECT, CATEGORY_RULES, TONE, WEIGHTS

# Settings of a tenant without a row.
DEFAULTS = {
    "language_preference": "en",
    "currency_preference": "KES",
    "timezone": "Africa/Nairobi",
    "data_residency_region": "global",
    "is_active": True,
    "max_file_size_mb": 20,
}
JSON_DEFAULTS = {
    "bank_statement_formats": "[]",
    "supported_file_types": '["pdf", "jpg", "png"]',
    "llm_tone_guidelines": '{"professional": true, "concise": true, "avoid_jargon": false, "include_disclaimers": true}',
}
# Weights written for a new tenant; no scorer reads these names.
NEW_TENANT_WEIGHTS = {
    "income_stability_impact": 0.3,
    "debt_ratio_impact": 0.25,
    "savings_rate_impact": 0.2,
    "discretionary_spending_impact": 0.15,
    "anomaly_penalty": 0.1,
}
WEIGHT_COLUMNS = (
    "bank_scoring_weights",
    "crb_scoring_weights",
    "mobile_money_scoring_weights",
    "behavioral_scoring_weights",
)
SETTINGS = (*DEFAULTS, *JSON_DEFAULTS, "transaction_categorization_rules", *WEIGHT_COLUMNS)


def encoded(updates: DataFrame) -> DataFrame:
    """JSON settings as text: structured values are encoded, text is kept."""
    out = updates
    for name in (*JSON_DEFAULTS, "transaction_categorization_rules", *WEIGHT_COLUMNS):
        if name in updates.columns and updates.schema[name].dataType.typeName() != "string":
            out = out.withColumn(name, F.to_json(name))
    return out


def own_tenant_only(updates: DataFrame, path_company: str = "path_company_id") -> tuple[DataFrame, DataFrame]:
    """(allowed, forbidden) updates: the addressed tenant must be the caller's."""
    same = F.coalesce(F.col(path_company) == F.col("company_id"), F.lit(False))
    return updates.where(same), updates.where(~same)


def append_updates(log: DataFrame, updates: DataFrame) -> DataFrame:
    """The log with new versions added; columns an update leaves out stay NULL."""
    return log.unionByName(encoded(updates), allowMissingColumns=True)


def missing_tenants(log: DataFrame, companies: DataFrame) -> DataFrame:
    """A first row with all defaults for every company the log does not have."""
    values = {
        **DEFAULTS,
        **JSON_DEFAULTS,
        "transaction_categorization_rules": json.dumps(
            {name: list(words) for name, words in DEFAULT_CATEGORY_RULES}
        ),
        "behavioral_scoring_weights": json.dumps(NEW_TENANT_WEIGHTS),
    }
    known = log.select("company_id").distinct()
    new = companies.select("company_id").distinct().join(known, "company_id", "left_anti")
    return new.select(
        "company_id",
        F.lit(0).cast("bigint").alias("version"),
        *[F.lit(v).alias(c) for c, v in values.items()],
    )


def current_settings(log: DataFrame) -> DataFrame:
    """Per tenant the last non-NULL value of each setting; of equal versions the larger value.

    ``max_by`` combines on the map side, so a tenant with a long log is no
    hot task.
    """
    names = [c for c in log.columns if c in SETTINGS]
    return log.groupBy("company_id").agg(
        F.max("version").alias("version"),
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("version", c))).alias(c)
            for c in names
        ],
    )


def parse_rules(text: Column) -> Column:
    """Ordered category rules from ``[{category, keywords}]`` or ``{category: keywords}``."""
    listed = F.from_json(text, CATEGORY_RULES)
    entries = F.transform(
        F.map_entries(F.from_json(text, CATEGORY_RULE_OBJECT)),
        lambda e: F.struct(e["key"].alias("category"), e["value"].alias("keywords")),
    )
    rules = F.when(F.startswith(F.ltrim(text), F.lit("[")), listed).otherwise(entries)
    return F.transform(
        F.filter(rules, lambda r: r["category"].isNotNull() & r["keywords"].isNotNull()),
        lambda r: F.struct(
            r["category"].alias("category"),
            F.transform(r["keywords"], lambda k: F.lower(k)).alias("keywords"),
        ),
    )


def read_tenant_config(settings: DataFrame) -> DataFrame:
    """Defaults filled and JSON settings parsed, with the raw text beside them.

    Text that is no valid JSON parses to NULL and stays readable in ``*_raw``.
    """
    columns = settings.columns
    out = settings
    for name, value in DEFAULTS.items():
        default = F.lit(value)
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in columns else default)
    for name in (*JSON_DEFAULTS, "transaction_categorization_rules", *WEIGHT_COLUMNS):
        raw = F.col(name) if name in columns else F.lit(None).cast("string")
        if name in JSON_DEFAULTS:
            raw = F.coalesce(raw, F.lit(JSON_DEFAULTS[name]))
        out = out.withColumn(f"{name}_raw", raw)
    parsed = {
        "transaction_categorization_rules": parse_rules(F.col("transaction_categorization_rules_raw")),
        "llm_tone_guidelines": F.from_json("llm_tone_guidelines_raw", TONE),
        "supported_file_types": F.from_json("supported_file_types_raw", "array<string>"),
        "bank_statement_formats": F.from_json("bank_statement_formats_raw", "array<string>"),
        **{name: F.from_json(f"{name}_raw", WEIGHTS) for name in WEIGHT_COLUMNS},
    }
    return out.withColumns(parsed)


def currency(column: str = "currency_preference") -> Column:
    return F.coalesce(F.col(column), F.lit(DEFAULTS["currency_preference"]))
