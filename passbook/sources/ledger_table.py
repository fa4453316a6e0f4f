"""The ledger as a Parquet table, partitioned by month."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from passbook.functions.times import at
from passbook.schema import LEDGER
from passbook.session import scratch_path

MONTH = "month"


def _month():
    return F.date_format("date", "yyyy-MM")


def read_ledger(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """The table, narrowed to a closed date range where one is given.

    The range prunes month folders first and row groups after that.
    """
    schema = StructType(LEDGER.fields + [StructField(MONTH, StringType())])
    df = spark.read.schema(schema).parquet(path)
    if start is not None:
        df = df.where((F.col(MONTH) >= f"{start:%Y-%m}") & (F.col("date") >= at(start)))
    if end is not None:
        df = df.where((F.col(MONTH) <= f"{end:%Y-%m}") & (F.col("date") <= at(end)))
    return df.drop(MONTH)


def write_ledger(df: DataFrame, path: str, mode: str = "overwrite", files_per_month: int = 8) -> None:
    """Writes rows clustered by month and sorted by date.

    A month is spread over a few tasks by a hash of the id, so one busy month is
    not one task's work.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(files_per_month))
    (
        df.withColumn(MONTH, _month())
        .repartition(F.col(MONTH), part)
        .sortWithinPartitions(MONTH, "date")
        .write.mode(mode)
        .partitionBy(MONTH)
        .parquet(path)
    )


def key_clashes(df: DataFrame, target: DataFrame | None) -> DataFrame:
    """Ids that occur twice in the rows or already stand in the target."""
    repeated = df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if target is None:
        return repeated
    return repeated.union(df.select("id").join(target.select("id"), "id", "left_semi")).distinct()


def append(df: DataFrame, path: str, exists: bool = True) -> None:
    """Adds rows; a repeated or known id is an error, no rows are no change. One writer at a time.

    The rows are worked out once, into a staging table; tests and the append read that.
    """
    spark = df.sparkSession
    staged = _staged(df)
    clash = key_clashes(staged, read_ledger(spark, path) if exists else None).first()
    if clash is not None:
        raise ValueError(f"id already in the ledger: {clash['id']}")
    if not staged.isEmpty():
        write_ledger(staged, path, mode="append")


def _staged(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "ledger")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the same id are replaced; changes with an unknown id are left out, and each id is there once."""
    kept = ledger.join(changes.select("id"), "id", "left_anti")
    known = changes.join(ledger.select("id"), "id", "left_semi")
    return kept.unionByName(known.select(*ledger.columns))


def delete(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger without the given ids. Spark broadcasts the ids only while they are small."""
    return ledger.join(ids.select("id"), "id", "left_anti")


def _rewrite(spark: SparkSession, path: str, new: DataFrame, months: list[str]) -> None:
    """Puts new rows in place of whole months; all other months stay untouched."""
    staged = _staged(new)
    filled = {r[MONTH] for r in staged.select(_month().alias(MONTH)).distinct().collect()}
    part = F.pmod(F.xxhash64("id"), F.lit(8))
    rows = staged.withColumn(MONTH, _month()).repartition(F.col(MONTH), part).sortWithinPartitions(MONTH, "date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    for month in sorted(set(months) - filled):
        spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{path}/{MONTH}={month}")


def _months(*frames: DataFrame) -> list[str]:
    """The months of frames; their number is that of months in a ledger, not of its rows."""
    found: set[str] = set()
    for frame in frames:
        found |= {r[MONTH] for r in frame.select(_month().alias(MONTH)).distinct().collect()}
    return sorted(found)


def _only(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    schema = StructType(LEDGER.fields + [StructField(MONTH, StringType())])
    return spark.read.schema(schema).parquet(path).where(F.col(MONTH).isin(months)).drop(MONTH)


def replace_rows(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Replaces stored rows by changes of the same id; rewrites only the months of either.

    An id that is twice in the changes is an error. One writer at a time: another one would not be seen.
    """
    ledger, changes = read_ledger(spark, path), _staged(changes)
    clash = key_clashes(changes, None).first()
    if clash is not None:
        raise ValueError(f"id twice in the changes: {clash['id']}")
    old = ledger.join(changes.select("id"), "id", "left_semi")
    known = changes.join(ledger.select("id"), "id", "left_semi").select(*LEDGER.fieldNames())
    months = _months(old, known)
    if months:
        kept = _only(spark, path, months).join(changes.select("id"), "id", "left_anti")
        _rewrite(spark, path, kept.select(*LEDGER.fieldNames()).unionByName(known), months)


def delete_rows(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Deletes stored rows; rewrites only the months that hold them."""
    ids = _staged(ids.select("id"))
    months = _months(read_ledger(spark, path).join(ids, "id", "left_semi"))
    if months:
        _rewrite(spark, path, delete(_only(spark, path, months), ids), months)


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], LEDGER).withColumn(MONTH, _month()).write.mode("overwrite").partitionBy(MONTH).parquet(path)
