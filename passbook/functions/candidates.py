"""Column rules of imported candidates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from passbook.functions.categories import default_category, rule_text, suggest_category
from passbook.functions.text import blank, squeeze, strip


def has_warnings() -> Column:
    return F.coalesce(F.size("warnings"), F.lit(0)) > 0


def is_valid() -> Column:
    """Amount above zero, a title or a merchant, and a date."""
    named = ~blank(F.col("title")) | ~blank(F.col("merchant"))
    return (F.coalesce(F.col("amount"), F.lit(0)) > 0) & named & F.col("date").isNotNull()


def effective_title() -> Column:
    """Title, or the merchant where the title is blank."""
    return F.when(~blank(F.col("title")), strip(F.col("title"))).otherwise(F.col("merchant"))


def fingerprint() -> Column:
    """``yyyy-MM-dd|amount|type|name`` with the name lower-cased and its blanks collapsed."""
    name = F.when(~blank(F.col("merchant")), F.col("merchant")).otherwise(F.coalesce("title", F.lit("")))
    return F.concat_ws(
        "|",
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("no-date")),
        F.coalesce(F.col("amount"), F.lit(0)).cast("string"),
        F.col("type"),
        squeeze(F.lower(name)),
    )


def confidence_label() -> Column:
    return (
        F.when((F.col("confidence") > 0.85) & ~has_warnings(), "High confidence")
        .when((F.col("confidence") > 0.60) & ~has_warnings(), "Medium confidence")
        .otherwise("Needs review")
    )


def needs_review() -> Column:
    return (
        (F.col("confidence") <= 0.60)
        | (F.col("amount_confidence") < 0.70)
        | (F.col("merchant_confidence") < 0.50)
        | (F.col("date_confidence") < 0.40)
        | has_warnings()
    )


def needs_review_strict() -> Column:
    """The rule of the review list, which is not the same as ``needs_review``."""
    return (
        (F.col("confidence") <= 0.85)
        | F.coalesce(F.col("is_duplicate"), F.lit(False))
        | F.col("amount").isNull()
        | F.col("date").isNull()
    )


def transaction_confidence(grouping: Column, amount: Column, merchant: Column, date: Column) -> Column:
    """Weighted mean of the part scores."""
    return grouping * 0.4 + amount * 0.3 + merchant * 0.15 + date * 0.15


def needs_review_token(grouping: Column, amount: Column, merchant: Column, date: Column) -> Column:
    """Review rule of token candidates: part scores, a weak grouping, or warnings."""
    return (amount < 0.70) | (merchant < 0.50) | (date < 0.40) | (grouping < 0.60) | has_warnings()


def resolved_category(title: Column) -> Column:
    """The candidate's own category, else one by keyword, else the default of its type."""
    found = suggest_category(F.col("type"), rule_text(title, F.col("merchant")))
    own = F.when(~blank(F.col("category_id")), F.col("category_id"))
    return F.coalesce(own, found, default_category(F.col("type")))
