"""Recognition results in JSON: per-image results, raw detections, and the tolerant remote form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passbook.functions.boxes import corner_box, normalise_box
from passbook.functions.text import let
from passbook.functions.times import at

_READING = "text string, text_normalized string, confidence double, composite_score double, bbox string"
ITEM = (
    f"reading_index int, {_READING}, token_type string, is_numeric_amount boolean, parsed_integer_amount double, "
    f"currency string, candidates array<struct<{_READING}>>, role_scores map<string,double>"
).replace(" string", ":string").replace(" double", ":double").replace(" int,", ":int,").replace(" boolean", ":boolean")
ITEM = ITEM.replace("candidates array", "candidates:array").replace("role_scores map", "role_scores:map")
RESULT = (
    "success boolean, filename string, width int, height int, engine string, items_count int, "
    f"items array<struct<{ITEM}>>, pipeline_version string, token_summary map<string,int>, "
    "transaction_candidates string, error string"
)
DETECTIONS = (
    "image string, variant string, width int, height int, engine string, detections_count int, "
    "detections array<struct<text:string,confidence:double,bbox:string>>"
)


def read_ocr(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per image with defaults for what is missing."""
    raw = spark.read.schema(RESULT).option("multiLine", one_per_file).json(path)
    return raw.select(
        F.coalesce("success", F.lit(True)).alias("success"),
        F.coalesce("filename", F.lit("")).alias("image_id"),
        F.coalesce("width", F.lit(0)).cast("double").alias("width"),
        F.coalesce("height", F.lit(0)).cast("double").alias("height"),
        F.coalesce("engine", F.lit("RapidOCR-ONNX")).alias("engine"),
        F.coalesce("items_count", F.size(F.coalesce("items", F.array()))).alias("items_count"),
        "items",
        F.coalesce("pipeline_version", F.lit("V2")).alias("pipeline_version"),
        "token_summary",
        "transaction_candidates",
        F.col("error").alias("error_message"),
    )


def ocr_tokens(results: DataFrame) -> DataFrame:
    """The items of each result as token rows."""
    each = results.select("image_id", "width", "height", F.posexplode("items").alias("pos", "i"))
    text = F.coalesce("i.text", F.lit(""))
    return each.withColumn("box", corner_box(F.col("i.bbox"))).select(
        "image_id",
        F.col("pos").cast("long").alias("token_no"),
        text.alias("text"),
        F.coalesce("i.text_normalized", F.lit("")).alias("text_normalized"),
        F.coalesce("i.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("i.composite_score", F.lit(0.0)).alias("score"),
        "box.*",
        "width",
        "height",
        F.coalesce("i.reading_index", F.lit(0)).alias("reading_index"),
        F.coalesce("i.token_type", F.lit("unknown")).alias("token_type"),
        F.coalesce("i.is_numeric_amount", F.lit(False)).alias("is_numeric_amount"),
        F.col("i.parsed_integer_amount").alias("parsed_integer_amount"),
        F.col("i.currency").alias("currency"),
    )


def read_detections(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Raw detections of images as token rows."""
    raw = spark.read.schema(DETECTIONS).option("multiLine", one_per_file).json(path)
    each = raw.select(
        F.col("image").alias("image_id"),
        F.col("width").cast("double").alias("width"),
        F.col("height").cast("double").alias("height"),
        F.posexplode("detections").alias("pos", "d"),
    )
    return each.withColumn("box", corner_box(F.col("d.bbox"))).select(
        "image_id",
        F.col("pos").cast("long").alias("token_no"),
        F.col("d.text").alias("text"),
        F.col("d.text").alias("text_normalized"),
        F.col("d.confidence").alias("confidence"),
        F.col("d.confidence").alias("score"),
        "box.*",
        "width",
        "height",
    )


# ---- the remote form: several key names for one thing -------------------------------------------

# Alternative keys, tried in order.
ITEM_LISTS = ("items", "tokens", "data", "results")
CANDIDATE_LISTS = ("transaction_candidates", "candidates")
REMOTE_ITEM = (
    "reading_index:string,index:string,text:string,text_normalized:string,composite_score:string,score:string,confidence:string,"
    "bbox:string,bounding_box:string,box:string,is_numeric_amount:boolean,parsed_integer_amount:string,amount:string,"
    "currency:string,token_type:string,type:string"
)
REMOTE_CANDIDATE = (
    "id:string,amount:string,amount_cents:string,parsed_amount:string,confidence:string,score:string,composite_score:string,"
    "date:string,timestamp:string,currency:string,merchant:string,receiver:string,payee:string,title:string,description:string,"
    "type:string,direction:string,category:string,status:string"
)
REMOTE = "success boolean, filename string, message string, " + ", ".join(
    f"{k} string" for k in (*ITEM_LISTS, *CANDIDATE_LISTS)
)


def read_remote_ocr(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per response with typed item and candidate lists."""
    raw = spark.read.schema(REMOTE).option("multiLine", one_per_file).json(path)

    def first_list(keys: tuple[str, ...], kind: str) -> Column:
        return F.from_json(F.coalesce(*keys), f"array<struct<{kind}>>")

    return raw.select(
        F.coalesce("success", F.lit(True)).alias("success"),
        F.col("filename").alias("image_id"),
        "message",
        first_list(ITEM_LISTS, REMOTE_ITEM).alias("items"),
        first_list(CANDIDATE_LISTS, REMOTE_CANDIDATE).alias("candidates"),
    )


def _score(*keys: str) -> Column:
    """First score given, clamped to 0..1; 1 where it is missing or no number."""
    value = F.coalesce(*keys).try_cast("double")
    return F.when(value.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def remote_items(responses: DataFrame) -> DataFrame:
    """Items of successful responses as token rows; boxes may be null."""
    each = responses.where("success").select("image_id", F.posexplode("items").alias("pos", "i"))
    return each.withColumn("box", normalise_box(F.coalesce("i.bbox", "i.bounding_box", "i.box"))).select(
        "image_id",
        F.coalesce(F.coalesce("i.reading_index", "i.index").try_cast("double").cast("long"), F.col("pos") + 1).alias("token_no"),
        F.coalesce("i.text", F.lit("")).alias("text"),
        F.col("i.text_normalized").alias("text_normalized"),
        _score("i.composite_score", "i.score", "i.confidence").alias("score"),
        "box.*",
        F.coalesce("i.is_numeric_amount", F.lit(False)).alias("is_numeric_amount"),
        F.coalesce("i.parsed_integer_amount", "i.amount").try_cast("double").cast("long").alias("parsed_integer_amount"),
        F.col("i.currency").alias("currency"),
        F.coalesce("i.token_type", "i.type").alias("token_type"),
    )


def _minor(text: Column) -> Column:
    """Whole numbers are minor units already, fractions are major units."""
    return let(
        text,
        lambda x: F.when(x.rlike(r"^-?\d+$"), x.try_cast("long")).otherwise(F.round(x.try_cast("double") * 100).cast("long")),
    )


def remote_candidates(responses: DataFrame, as_of: datetime) -> DataFrame:
    """Candidates that a response brings itself; those without an amount are dropped."""
    each = responses.where("success").select("image_id", F.posexplode("candidates").alias("pos", "c"))
    named = each.select(
        "image_id",
        (F.col("pos") + 1).cast("long").alias("pos"),
        "c.id",
        _minor(F.coalesce("c.amount", "c.amount_cents", "c.parsed_amount")).alias("amount"),
        F.coalesce("c.currency", F.lit("INR")).alias("currency"),
        F.coalesce("c.merchant", "c.receiver", "c.payee").alias("merchant"),
        F.coalesce("c.title", "c.description").alias("title"),
        F.coalesce("c.date", "c.timestamp").try_cast("timestamp_ntz").alias("date"),
        F.lower(F.coalesce("c.type", "c.direction")).isin("income", "credit", "received").alias("_income"),
        F.col("c.category").alias("category_id"),
        _score("c.confidence", "c.score", "c.composite_score").alias("confidence"),
    )
    income = F.coalesce("_income", F.lit(False))
    number = F.col("pos").cast("string")
    return named.where(F.coalesce("amount", F.lit(0)) > 0).select(
        "image_id",
        "pos",
        F.coalesce("id", F.concat(F.lit("candidate_"), number)).alias("id"),
        "amount",
        "currency",
        F.coalesce("title", "merchant", F.concat(F.lit("Transaction #"), number)).alias("title"),
        "merchant",
        F.coalesce("category_id", F.when(income, "income").otherwise("general")).alias("category_id"),
        F.when(income, "income").otherwise("expense").alias("type"),
        F.coalesce("date", at(as_of)).alias("date"),
        "confidence",
    )
