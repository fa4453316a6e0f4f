"""Row mapping and history views of the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from passbook.fixed_values import DEFAULT_CURRENCY, SOURCES, TYPES
from passbook.functions.categories import category_name, known_category
from passbook.functions.times import at
from passbook.plans.period import midnight


def clean_enums(df: DataFrame) -> DataFrame:
    """Unknown types become expenses, unknown sources manual entries."""
    return df.withColumns(
        {
            "type": F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("expense"),
            "source": F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("manual"),
            "currency": F.coalesce("currency", F.lit(DEFAULT_CURRENCY)),
        }
    )


def display_title() -> Column:
    return F.coalesce(F.nullif("merchant", F.lit("")), F.col("title"))


def with_category(df: DataFrame) -> DataFrame:
    """Adds the resolved category id and its display name."""
    kind, cid = F.col("type"), F.col("category_id")
    return df.withColumns(
        {"category_known": known_category(kind, cid), "category_name": category_name(kind, cid)}
    )


def by_id(df: DataFrame, row_id: str) -> DataFrame:
    return df.where(F.col("id") == row_id).limit(1)


def by_date_range(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    inside = F.col("date").between(at(start), at(end))
    return df.where(inside).orderBy(F.desc("date"), "id")


def filtered_summary(df: DataFrame) -> DataFrame:
    income = F.sum(F.when(F.col("type") == "income", F.col("amount")).otherwise(0))
    expense = F.sum(F.when(F.col("type") == "income", 0).otherwise(F.col("amount")))
    zero = F.lit(0).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(expense, zero).alias("total_expense"),
        F.coalesce(income, zero).alias("total_income"),
        F.coalesce(income - expense, zero).alias("net"),
    )


def day_label(as_of: datetime) -> Column:
    today = midnight(as_of)
    day = F.to_date("date")
    return (
        F.when(day == F.lit(today.date()), "Today")
        .when(day == F.date_sub(F.lit(today.date()), 1), "Yesterday")
        .otherwise(F.date_format("date", "MMMM d, yyyy"))
    )


def with_day_label(df: DataFrame, as_of: datetime) -> DataFrame:
    """History rows with the header they stand under; the order of the rows is kept."""
    return df.withColumn("day_label", day_label(as_of))


def day_groups(df: DataFrame, as_of: datetime) -> DataFrame:
    """One row per day header with counts and sums."""
    labelled = with_day_label(df, as_of).withColumn("day", F.to_date("date"))
    income = F.when(F.col("type") == "income", F.col("amount")).otherwise(F.lit(0).cast("long"))
    expense = F.when(F.col("type") == "income", F.lit(0).cast("long")).otherwise(F.col("amount"))
    return labelled.groupBy("day", "day_label").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(income).alias("total_income"),
        F.sum(expense).alias("total_expense"),
    )


def validate_rows(df: DataFrame) -> DataFrame:
    """Adds ``reason``: null for rows that may be written, else why not."""
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    no_amount = F.coalesce(F.col("amount"), F.lit(0)) <= 0
    reason = F.when(no_amount, "amount must be greater than zero").when(blank, "title must not be empty")
    return df.withColumn("reason", reason)


def selected_rows(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows whose id is in the chosen set."""
    return df.join(chosen.select("id"), "id", "left_semi")


def selected_total(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return selected_rows(df, chosen).agg(
        F.count(F.lit(1)).alias("selected_count"),
        F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("selected_total"),
    )
