"""Keyword and category expressions over transaction descriptions."""

from functools import reduce

from pyspark.sql import Column, functions as F

# The default category rules, tried in this order, and word lists.
DEFAULT_CATEGORY_RULES = (
    ("income", ("salary", "payroll", "deposit")),
    ("rent", ("rent", "landlord")),
    ("utilities", ("kplc", "water", "electricity", "utility", "internet")),
    ("transport", ("fuel", "petrol", "uber", "matatu", "bus")),
    ("groceries", ("supermarket", "grocery", "naivas", "carrefour")),
    ("loan_repayment", ("loan payment", "instalment", "repayment")),
    ("entertainment", ("restaurant", "bar", "club", "movie", "leisure")),
    ("savings", ("savings deposit", "fixed deposit", "investment")),
    ("withdrawal", ("atm withdrawal", "cash out")),
    ("transfer_out", ("transfer to",)),
    ("transfer_in", ("transfer from",)),
)
UNCATEGORIZED = "Uncategorized"
DEBT_WORDS = ("loan", "installment", "repayment", "emi", "mortgage")
MOBILE_LOAN_WORDS = ("loan", "fuliza", "repayment")
REMITTANCE_WORDS = ("send money", "receive money")


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def contains_any(text: Column, words) -> Column:
    """True when the lower-cased text holds one of the (lower-case) words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def default_category(text: Column) -> Column:
    """Ordered first match as one CASE, so the common tenant stays in codegen."""
    first, *rest = DEFAULT_CATEGORY_RULES
    case = F.when(contains_any(text, first[1]), first[0])
    for name, words in rest:
        case = case.when(contains_any(text, words), name)
    return case.otherwise(UNCATEGORIZED)


def category(text: Column, rules: Column) -> Column:
    """Category of a lower-cased description under the tenant's ordered rules.

    ``rules`` is ARRAY<STRUCT<category, keywords>> with lower-case keywords;
    NULL or empty stands for the default rules.
    """
    hits = F.filter(
        rules, lambda r: F.exists(r["keywords"], lambda word: F.contains(text, word))
    )
    own = F.coalesce(F.get(hits, F.lit(0))["category"], F.lit(UNCATEGORIZED))
    return F.when(F.coalesce(F.size(rules), F.lit(0)) > 0, own).otherwise(default_category(text))
