"""CSV and JSON exports of the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Header of the CSV export, whatever the currency.
CSV_HEADER = "Date,Type,Amount (INR),Title,Merchant,Category,Note,Source"


def iso(column: str) -> Column:
    """ISO 8601 text with milliseconds, or microseconds where there are any."""
    micros = F.unix_micros(F.col(column).cast("timestamp")) % 1000
    return F.when(micros == 0, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(
        F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def csv_columns(df: DataFrame) -> DataFrame:
    size = F.abs("amount")
    major = F.concat(
        F.when(F.col("amount") < 0, "-").otherwise(""),
        F.floor(size / 100).cast("string"),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )
    names = CSV_HEADER.split(",")
    values = [
        F.date_format("date", "yyyy-MM-dd HH:mm:ss"),
        F.upper("type"),
        major,
        F.col("title"),
        F.col("merchant"),
        F.col("category_id"),
        F.col("note"),
        F.upper("source"),
    ]
    return df.select(*[v.alias(n) for v, n in zip(values, names)])


def export_csv(df: DataFrame, path: str, ordered: bool = False) -> None:
    """Part files with a header each; ``ordered`` sorts rows newest first across the files."""
    rows = df.orderBy(F.desc("date"), "id") if ordered else df
    (
        csv_columns(rows)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def json_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "title",
        "amount",
        "currency",
        "type",
        "category_id",
        iso("date").alias("date"),
        "merchant",
        "note",
        "source",
    )


def manifest(df: DataFrame, as_of: datetime, app: str = "passbook") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_transactions")).select(
        F.lit(app).alias("app"),
        F.lit(as_of.isoformat(timespec="milliseconds")).alias("exported_at"),
        "total_transactions",
    )


def export_json(df: DataFrame, path: str, as_of: datetime, app: str = "passbook") -> None:
    """``transactions`` as JSON Lines next to a one-row ``manifest``."""
    json_columns(df).write.mode("overwrite").json(f"{path}/transactions")
    manifest(df, as_of, app).write.mode("overwrite").json(f"{path}/manifest")
