"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word and text contracts: space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]+"
_fallback: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session within one process, as in tests, may have none; it takes a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _fallback.setdefault("root", tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Written:
    """A frame written as Parquet in the shared folder; its rows can be taken out when they are used up."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def clear(self) -> None:
        """Nothing may read the rows after this."""
        self.spark.createDataFrame([], self.rows.schema).write.mode("overwrite").parquet(self.path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back: cuts lineage for good."""
    return Written(df, name).rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def width(df: DataFrame) -> int:
    """Partitions to deal blobs out to: what the session shuffles by."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
