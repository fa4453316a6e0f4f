"""Categories by keyword, and the category dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passbook.fixed_values import EXPENSE_CATEGORIES, INCOME_CATEGORIES
from passbook.functions.categories import (
    category_name,
    category_of_keyword,
    default_category,
    matched_keyword,
    rule_text,
    rule_tokens,
)


def categorise(df: DataFrame) -> DataFrame:
    """Adds category id, name and reason to any frame with type, title and merchant."""
    kind = F.col("type")
    marked = df.withColumn("_tokens", rule_tokens(rule_text(F.col("title"), F.col("merchant"))))
    marked = marked.withColumn("_keyword", matched_keyword(kind, F.col("_tokens")))
    marked = marked.withColumn("_found", category_of_keyword(kind, F.col("_keyword")))
    reason = F.concat(F.lit('Matched "'), F.col("_keyword"), F.lit('"'))
    return marked.withColumns(
        {
            "category_id": F.coalesce("_found", default_category(kind)),
            "category_name": category_name(kind, F.col("_found")),
            "reason": F.coalesce(reason, F.lit("Default fallback")),
        }
    ).drop("_tokens", "_keyword", "_found")


def category_dimension(spark: SparkSession) -> DataFrame:
    """The sixteen fixed categories as a frame."""
    rows = [
        F.struct(
            F.lit(kind).alias("type"),
            F.lit(key).alias("category_id"),
            F.lit(name).alias("category_name"),
            F.lit(pos).alias("category_pos"),
        )
        for kind, table in (("expense", EXPENSE_CATEGORIES), ("income", INCOME_CATEGORIES))
        for pos, (key, name) in enumerate(table.items())
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def join_category_names(df: DataFrame) -> DataFrame:
    """Name by a join with the dimension (fixed at sixteen rows, hence broadcast)."""
    names = F.broadcast(category_dimension(df.sparkSession).drop("category_pos"))
    return df.join(names, ["type", "category_id"], "left").withColumn(
        "category_name", F.coalesce("category_name", F.lit("Other"))
    )
