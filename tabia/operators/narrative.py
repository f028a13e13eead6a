"""Texts of a result: summary, narrative context lines, tone, localisation."""

from pyspark.sql import Column, DataFrame, functions as F

from tabia.functions.rules import UNIFIED_TIERS, UNIFIED_WORDS, tier
from tabia.functions.values import fixed, grouped
from tabia.schemas import KEY, TONE
from tabia.sources.tenants import DEFAULTS, JSON_DEFAULTS, currency


def localisation() -> Column:
    return F.struct(
        F.coalesce("language_preference", F.lit(DEFAULTS["language_preference"])).alias("language"),
        currency().alias("currency"),
        F.coalesce("timezone", F.lit(DEFAULTS["timezone"])).alias("timezone"),
    )


def unified_summary(money: Column) -> Column:
    """Summary sentence over the columns of a scored unified row."""
    c = F.col
    score = c("behavioral_score")
    sources = F.concat_ws(
        ", ",
        F.when(c("bank_present") == 1, "Bank Transactions"),
        F.when(c("mobile_present") == 1, "Mobile Money"),
        F.when(c("crb_present") == 1, "Credit Bureau Data"),
    )
    complete = c("data_completeness_score")
    parts = [
        F.concat(
            F.lit("Comprehensive Behavioral Analysis for Customer "), c("customer_id").cast("string")
        ),
        F.concat(F.lit("Data Sources: "), sources),
        F.concat(
            F.lit("Overall Behavioral Score: "),
            fixed(score, 1),
            F.lit("/1000 ("),
            tier(score, UNIFIED_WORDS),
            F.lit(")"),
        ),
        F.concat(F.lit("Risk Classification: "), tier(score, UNIFIED_TIERS)),
        F.when(
            c("anomalies") > 0,
            F.concat(
                F.lit("Anomalies Detected: "),
                c("anomalies").cast("string"),
                F.lit(" patterns requiring attention"),
            ),
        ).otherwise("No significant anomalies detected in the analyzed data"),
        F.when(
            (c("bank_present") == 1) & (c("avg_monthly_income") > 0),
            F.concat(
                F.lit("Average monthly income: "), money, F.lit(" "), grouped(c("avg_monthly_income"))
            ),
        ),
        F.when(
            (c("crb_present") == 1) & (c("crb_credit_history_length") > 0),
            F.concat(
                F.lit("Credit history: "),
                c("crb_credit_history_length").cast("string"),
                F.lit(" months"),
            ),
        ),
        F.when(
            complete == 1.0,
            "Analysis based on comprehensive data from all available sources",
        )
        .when(
            complete >= 0.67, "Analysis based on good data coverage from multiple sources"
        )
        .otherwise(
            "Analysis limited by partial data availability - consider providing additional"
            " data sources for more accurate assessment"
        ),
    ]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def tone_instruction(flags: Column) -> Column:
    """Tone sentence from the tenant's flags, in fixed order."""

    def on(name):
        return F.coalesce(F.element_at(flags, F.lit(name)), F.lit(False))

    wanted = F.concat_ws(
        ", ",
        F.when(on("professional"), "professional"),
        F.when(on("concise"), "concise"),
        F.when(on("avoid_jargon"), "avoid jargon"),
        F.when(on("include_disclaimers"), "include clear disclaimers"),
    )
    return F.concat(
        F.lit("The tone should be "),
        F.when(wanted == "", "neutral and informative").otherwise(wanted),
        F.lit("."),
    )


def metric_lines(metrics: DataFrame, keys=KEY) -> DataFrame:
    label = F.when(F.col("item").isNull(), F.col("name")).otherwise(
        F.concat(F.col("name"), F.lit(" / "), F.col("item"))
    )
    return metrics.select(
        *keys,
        F.lit("metrics").alias("block"),
        "section",
        F.col("position").cast("bigint").alias("position"),
        F.concat(
            F.lit("- "),
            label,
            F.lit(": "),
            F.coalesce(fixed(F.col("value"), 2), F.lit("n/a")),
            F.lit(" "),
            F.coalesce("unit", F.lit("")),
            F.lit(" ("),
            F.coalesce("description", F.lit("None")),
            F.lit(")"),
        ).alias("line"),
    )


def anomaly_lines(anomalies: DataFrame, keys=KEY) -> DataFrame:
    return anomalies.select(
        *keys,
        F.lit("anomalies").alias("block"),
        F.col("source").alias("section"),
        F.coalesce("seq", F.lit(0)).cast("bigint").alias("position"),
        F.concat(
            F.lit("- "),
            "type",
            F.lit(": "),
            "description",
            F.lit(" (Transaction: "),
            F.coalesce("txn_description", F.lit("N/A")),
            F.lit(")"),
        ).alias("line"),
    )


def rule_lines(breakdown: DataFrame, keys=KEY) -> DataFrame:
    return breakdown.select(
        *keys,
        F.lit("rules").alias("block"),
        F.col("module").alias("section"),
        F.col("position").cast("bigint").alias("position"),
        F.concat(
            F.lit("- "),
            "rule_name",
            F.lit(": "),
            "condition_met",
            F.lit(" (Adjustment: "),
            fixed(F.col("adjustment"), 2),
            F.lit(")"),
        ).alias("line"),
    )


def tone_lines(customers: DataFrame, keys=KEY) -> DataFrame:
    """``customers`` carry the tenant's llm_tone_guidelines; no tenant row, the default tone."""
    flags = F.coalesce(
        "llm_tone_guidelines", F.from_json(F.lit(JSON_DEFAULTS["llm_tone_guidelines"]), TONE)
    )
    return customers.select(
        *keys,
        F.lit("tone").alias("block"),
        F.lit("tenant").alias("section"),
        F.lit(0).cast("bigint").alias("position"),
        tone_instruction(flags).alias("line"),
    )


def empty_block_lines(customers: DataFrame, lines: DataFrame, block: str, text: str, keys=KEY) -> DataFrame:
    """The fixed sentence for customers without a line in ``block``."""
    present = lines.select(*keys).distinct()
    return customers.select(*keys).join(present, list(keys), "left_anti").select(
        *keys,
        F.lit(block).alias("block"),
        F.lit("none").alias("section"),
        F.lit(0).cast("bigint").alias("position"),
        F.lit(text).alias("line"),
    )


def score_lines(scored: DataFrame, score: str, keys=KEY) -> DataFrame:
    """The overall score that the other blocks explain."""
    return scored.select(
        *keys,
        F.lit("score").alias("block"),
        F.lit("overall").alias("section"),
        F.lit(0).cast("bigint").alias("position"),
        F.concat(F.lit("Overall behavioral score: "), fixed(F.col(score), 2)).alias("line"),
    )


def factor_lines(scored: DataFrame, keys=KEY) -> DataFrame:
    """The drivers of a score, its components in their order and the model's factors by rank.

    A scored row carries ``score_explanation`` (feature, impact), ``components``
    or both.
    """
    columns = scored.columns
    parts = []
    if "score_explanation" in columns:
        parts.append(("model", F.transform("score_explanation", lambda e: F.struct(
            e["feature"].alias("name"), e["impact"].alias("impact")))))
    if "components" in columns:
        names = scored.schema["components"].dataType.names
        parts.append(("components", F.array(*[
            F.struct(F.lit(n).alias("name"), F.col(f"components.{n}").cast("double").alias("impact")) for n in names])))

    def placed(section, items):
        return F.transform(
            items,
            lambda e, i: F.struct(
                F.lit(section).alias("section"), i.cast("bigint").alias("position"),
                e["name"].alias("name"), e["impact"].alias("impact"),
            ),
        )

    tagged = [placed(section, items) for section, items in parts]
    rows = scored.select(*keys, F.explode(F.concat(*tagged)).alias("e"))
    return rows.select(
        *keys,
        F.lit("factors").alias("block"),
        F.col("e.section").alias("section"),
        F.col("e.position").alias("position"),
        F.concat(F.lit("- "), "e.name", F.lit(": "), fixed(F.col("e.impact"), 2)).alias("line"),
    )


def narrative_context(
    customers: DataFrame,
    metrics: DataFrame,
    anomalies: DataFrame,
    breakdown: DataFrame,
    keys=KEY,
    scored: DataFrame | None = None,
    score: str = "behavioral_score",
) -> DataFrame:
    """All context lines of all customers, one line per row.

    With ``scored`` also the score and the factors behind it. Kept long, not
    joined into one text per customer: a customer's anomaly list has no bound. A
    reader orders by (block, section, position, line).
    """
    found = anomaly_lines(anomalies, keys)
    fired = rule_lines(breakdown, keys)
    lines = (
        metric_lines(metrics, keys)
        .unionByName(found)
        .unionByName(fired)
        .unionByName(tone_lines(customers, keys))
        .unionByName(
            empty_block_lines(customers, found, "anomalies", "No significant anomalies detected.", keys)
        )
        .unionByName(
            empty_block_lines(customers, fired, "rules", "No specific tenant rules applied.", keys)
        )
    )
    if scored is None:
        return lines
    return lines.unionByName(score_lines(scored, score, keys)).unionByName(factor_lines(scored, keys))
