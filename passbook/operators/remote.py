"""Remote responses to candidates: their own, else by the lines of their items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from passbook.functions.text import strip
from passbook.operators.lines import line_candidates
from passbook.sources.ocr_json import remote_candidates

LINE_STEP = 15.0


def effective_text() -> Column:
    norm = strip(F.coalesce("text_normalized", F.lit("")))
    return F.when(norm != "", norm).otherwise(strip(F.col("text")))


def item_lines(items: DataFrame) -> DataFrame:
    """Items as document lines in reading order; the document ends at its outermost box."""
    shown = items.withColumn("line", effective_text()).where("line <> ''")
    image = Window.partitionBy("image_id")
    # Tops within a step count as one line; a chain of small steps stays one line.
    step = F.col("min_y") - F.lag("min_y").over(image.orderBy("min_y", "token_no"))
    banded = shown.withColumn("_new", F.when(F.coalesce(step > LINE_STEP, F.lit(True)), 1).otherwise(0)).withColumn(
        "_band", F.sum("_new").over(image.orderBy("min_y", "token_no"))
    )
    placed = F.when(F.col("min_y").isNotNull(), F.col("_band"))
    numbered = banded.withColumn("line_no", F.row_number().over(image.orderBy(placed, "min_x", "token_no")).cast("long"))
    size = items.groupBy("image_id").agg(
        F.coalesce(F.max("max_x"), F.lit(720.0)).alias("width"), F.coalesce(F.max("max_y"), F.lit(1600.0)).alias("height")
    )
    return numbered.join(size, "image_id").select(
        "image_id",
        "line_no",
        F.col("line").alias("text"),
        F.col("min_x").alias("left"),
        F.col("min_y").alias("top"),
        F.col("max_x").alias("right"),
        F.col("max_y").alias("bottom"),
        "width",
        "height",
    )


def blend_confidence(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Seven parts of the row's confidence, three of the mean score of the items inside its merchant."""
    words = items.where(F.col("text") != "").select("image_id", F.lower("text").alias("_w"), F.col("score").alias("_s"))
    named = candidates.where(F.col("merchant").isNotNull()).select("image_id", "pos", F.lower("merchant").alias("_m"))
    mean = (
        named.join(words, "image_id")
        .where(F.contains("_m", F.col("_w")))
        .groupBy("image_id", "pos")
        .agg(F.avg("_s").alias("_mean"))
    )
    blended = F.when(F.col("_mean").isNull(), F.col("confidence")).otherwise(
        F.col("confidence") * 0.70 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_mean"))) * 0.30
    )
    return (
        candidates.join(mean, ["image_id", "pos"], "left").withColumn("confidence", F.round(blended, 2)).drop("_mean")
    )


_OUT = ["image_id", "pos", "amount", "type", "merchant", "title", "category_id", "date", "confidence"]


def candidates_of_responses(responses: DataFrame, items: DataFrame, as_of: datetime) -> DataFrame:
    """Own candidates of a response; where it has none, rows made from its items."""
    own = remote_candidates(responses, as_of).select(*_OUT)
    rest = items.join(own.select("image_id").distinct(), "image_id", "left_anti")
    lines = line_candidates(item_lines(rest), as_of)
    return own.unionByName(blend_confidence(lines, rest).select(*_OUT))
