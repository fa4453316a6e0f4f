"""How well extracted rows match expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def positioned(df: DataFrame) -> DataFrame:
    """Numbers the rows of each image in the order of ``pos``."""
    w = Window.partitionBy("image_id").orderBy("pos")
    return df.withColumn("pos", F.row_number().over(w))


def extraction_quality(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Recall, precision, accuracies and error counts over rows matched by image and position."""

    def tagged(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "image_id",
            "pos",
            F.lit(True).alias(f"{prefix}row"),
            *[F.col(c).alias(prefix + c) for c in ("amount", "merchant", "type")],
        )

    both = tagged(found, "f_").join(tagged(expected, "e_"), ["image_id", "pos"], "full_outer")
    wanted, got = F.col("e_row").isNotNull(), F.col("f_row").isNotNull()
    amount = wanted & got & (F.col("f_amount") == F.col("e_amount"))
    merchant = wanted & got & (F.col("e_merchant").isNull() | F.contains(F.lower("f_merchant"), F.lower("e_merchant")))
    kind = wanted & got & (F.col("e_type").isNull() | (F.col("f_type") == F.col("e_type")))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return (
        both.agg(
            F.count_if(wanted).alias("expected_rows"),
            F.count_if(got).alias("extracted_rows"),
            F.count_if(amount).alias("_amounts"),
            F.count_if(merchant).alias("_merchants"),
            F.count_if(kind).alias("_types"),
            F.count_if(got & ~wanted).alias("false_rows"),
            F.count_if(wanted & got & ~F.coalesce(F.col("f_amount") == F.col("e_amount"), F.lit(False))).alias("wrong_amounts"),
        )
        .select(
            "expected_rows",
            "extracted_rows",
            share("extracted_rows", "expected_rows").alias("recall"),
            share("_amounts", "extracted_rows").alias("precision"),
            share("_amounts", "expected_rows").alias("amount_accuracy"),
            share("_merchants", "expected_rows").alias("merchant_accuracy"),
            share("_types", "expected_rows").alias("type_accuracy"),
            "false_rows",
            "wrong_amounts",
        )
    )
