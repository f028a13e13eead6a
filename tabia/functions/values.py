"""Scalar expressions: dates, amounts, guarded ratios, weights."""

from pyspark.sql import Column, functions as F

from tabia.schemas import MONEY

# One statement line is date, description, amount, CR/DR, balance.
LINE_DATE = (
    r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}"
    r"|\d{4}-\d{2}-\d{2}"
)
LINE_NUMBER = r"(?:KSh|KES|R|\$)?\s*(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}"
STATEMENT_LINE = (
    rf"({LINE_DATE})\s+(.+?)\s+(-?\s*{LINE_NUMBER})\s*(CR|DR)?\s*({LINE_NUMBER})?"
)


def parse_date(text: Column) -> Column:
    """Calendar date of ISO dates and timestamps and of '1 Jan 2023'; else NULL."""
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(
        text.try_cast("date"),
        F.try_to_date(squeezed, "d MMM yyyy"),
        text.try_cast("timestamp_ntz").cast("date"),
    )


def clean_date(text: Column) -> Column:
    """Statement date as yyyy-MM-dd; the raw text where it is no date."""
    squeezed = F.regexp_replace(text, r"\s+", " ")
    day = F.when(text.contains("-"), F.try_to_date(text, "yyyy-MM-dd")).otherwise(
        F.try_to_date(squeezed, "d MMM yyyy")
    )
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), text)


def clean_amount(text: Column) -> Column:
    """Number in a text such as 'KES -1,500.00'; NULL where there is none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast(MONEY)


def line_type(hint: Column, amount: Column) -> Column:
    """debit for DR or a negative amount, otherwise credit."""
    return F.when((F.upper(hint) == "DR") | (amount < 0), "debit").otherwise("credit")


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom in DOUBLE; NULL where the bottom is NULL or 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def weight(weights: Column, name: str, default: float) -> Column:
    """Tenant weight, or the rule's default."""
    return F.coalesce(F.element_at(weights, F.lit(name)), F.lit(float(default)))


def fixed(value: Column, places: int) -> Column:
    """Text of a number with ``places`` decimals, rounded half up; NULL stays NULL."""
    text = F.format_string(f"%.{places}f", F.round(value.cast("double"), places))
    return F.when(value.isNotNull(), text)


def grouped(value: Column, places: int = 2) -> Column:
    """As ``fixed``, with thousands separators."""
    text = F.format_string(f"%,.{places}f", F.round(value.cast("double"), places))
    return F.when(value.isNotNull(), text)
