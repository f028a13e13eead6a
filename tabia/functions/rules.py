"""Ordered scoring rules as columns: running score, breakdown, clamp, tiers."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Score at or above the bound -> tier; the last one has no bound.
MODULE_TIERS = (
    (800, "Very Low Risk"),
    (650, "Low Risk"),
    (500, "Medium Risk"),
    (350, "High Risk"),
    (None, "Very High Risk"),
)
UNIFIED_TIERS = (
    (750, "Low Risk"),
    (600, "Medium Risk"),
    (400, "Medium-High Risk"),
    (None, "High Risk"),
)
UNIFIED_WORDS = ((750, "excellent"), (600, "good"), (400, "fair"), (None, "concerning"))


@dataclass(frozen=True)
class Rule:
    """One rule: where ``condition`` holds, ``adjustment`` is added to the score."""

    name: str
    component: str
    condition: Column
    adjustment: Column
    text: Column


def tier(score: Column, tiers) -> Column:
    case = None
    for bound, name in tiers:
        if bound is None:
            return case.otherwise(name)
        case = F.when(score >= bound, name) if case is None else case.when(score >= bound, name)
    return case


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), score))


def apply_rules(rows: DataFrame, rules: list[Rule], base: Column, score: str, tiers) -> DataFrame:
    """Adds ``score``, ``risk_level``, ``breakdown`` (rules that fired, in order, with
    the running unclamped score) and ``components`` (adjustment sums by component)."""
    fired = [F.when(F.coalesce(r.condition, F.lit(False)), r.adjustment.cast("double")) for r in rules]
    adj = [f"_adj{i}" for i in range(len(rules))]
    run = [f"_run{i}" for i in range(len(rules))]
    out = rows.withColumns({**dict(zip(adj, fired)), "_base": base.cast("double")})
    so_far, totals = F.col("_base"), {}
    for a, r in zip(adj, run):
        so_far = so_far + F.coalesce(F.col(a), F.lit(0.0))
        totals[r] = so_far
    out = out.withColumns(totals)
    entries = [
        F.when(
            F.col(a).isNotNull(),
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(rule.name).alias("rule_name"),
                rule.text.alias("condition_met"),
                F.col(a).alias("adjustment"),
                F.col(r).alias("new_score"),
            ),
        )
        for i, (rule, a, r) in enumerate(zip(rules, adj, run))
    ]
    parts: dict[str, Column] = {}
    for rule, a in zip(rules, adj):
        value = F.coalesce(F.col(a), F.lit(0.0))
        parts[rule.component] = parts[rule.component] + value if rule.component in parts else value
    final = clamped(F.col(run[-1]))
    return out.withColumns(
        {
            score: final,
            "risk_level": tier(final, tiers),
            "breakdown": F.array_compact(F.array(*entries)),
            "components": F.struct(*[v.alias(k) for k, v in parts.items()]),
        }
    ).drop(*adj, *run, "_base")
