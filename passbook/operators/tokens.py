"""Recognised tokens to candidates, list and receipt form.

A token table has one row per text region: ``image_id, token_no, text,
text_normalized, confidence, score, min_x, min_y, max_x, max_y, cx, cy, width,
height`` (the last two of the image).

Nothing here gathers an image into one task. Facts of an image are aggregates
with map-side combine and come back by a salted join; neighbours in images of
very many tokens are found inside vertical stripes, with the few stripe edges
carried over.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from passbook.functions import tokens as t
from passbook.functions.text import contains_any, let, no_blanks, strip
from passbook.functions.times import at
from passbook.operators.skew import HOT_ROWS, in_hot_buckets, salted_left_join
from passbook.session import scratch_path

STRIPE = 512.0

# Labels of the screen around the rows.
UI_NOISE = [
    "searchtransactions", "status", "paymentmethod", "date", "amount", "amo", "search", "filter", "all",
    "transactionsuccessful", "paymentsuccessful", "paidsuccessfully", "paymentdetails", "transactiondetails",
    "transferdetails", "viewdetails", "completed", "successful", "history", "help", "home", "alerts", "rewards",
    "offers", "coinsredeemed", "viewhistory", "payagain", "sharereceipt", "debitedfrom", "checkbalance",
    "paymentlocation", "openmaps", "upitransactionid", "transactionid", "notesupiintent", "upiintent", "youvewon",
    "checknow", "investment", "explore", "insurance", "viaupi", "receivedin",
]
RECEIPT_MARKS = [
    "transactionsuccessful", "paymentsuccessful", "paidsuccessfully", "transferdetails", "upitransactionid",
    "transactionid", "paymentid", "orderid", "referencenumber", "paidvia", "notes:paidvia", "notes:upiintent",
    "upiintent",
]
RECEIPT_HINTS = [
    "payagain", "splitexpense", "sharereceipt", "sendagain", "bankingname", "support", "checkbalance",
    "paymentlocation",
]
BOTTOM_LABELS = ("history", "home", "investment", "explore", "rewards", "settings")
CUT_OFF_LABELS = ("history", "home", "investment", "explore", "insurance")
NOISE_INSIDE = (".rzp", "rzp", "coinsredeemed", "youvewon", "you'vewon", "checknow")
NOISE_STARTS = (
    r"^(?:\*\*|notes:|debited from|credited to|upi ref|txn id|utr:|via upi|received in|paid via)"
)
FOOTER_STARTS = r"(?i)^(?:debited from|credited to)"
COMBINED = r"(?i)^(.*?)\s+([+-]?\s*(?:[₹#＃Rr买尐￥¥]|INR|Rs\.?)?\s*[\d,]+(?:\.\d{1,2})?)\s*$"
W_NO_MERCHANT, W_NO_DATE = "Merchant name not detected", "Date not detected"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared scratch folder and reads it back.

    For frames used several times: the work is done once and survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def token_text() -> Column:
    """Normalised text where there is any, else the raw text."""
    return F.coalesce(F.nullif("text_normalized", F.lit("")), F.col("text"))


def split_combined(df: DataFrame, leading_seven: bool = False) -> DataFrame:
    """Tokens that hold a name and an amount become two; the box is cut at the text ratio."""
    text = strip(token_text())
    none = F.lit(None).cast("double")

    def is_amount(x: Column) -> Column:
        return t.read_amount(x, none, none, none, none, none, leading_seven)["is_amount"]

    # Only a text with a blank inside and a number at its end can be both.
    may_be = F.col("_whole").rlike(r"[\d,]$") & F.col("_whole").rlike(r"\s")

    def part_of_both(i: int) -> Column:
        return F.when(may_be, strip(F.regexp_extract("_whole", COMBINED, i))).otherwise("")

    parted = df.withColumn("_whole", text).withColumns({"_name": part_of_both(1), "_tail": part_of_both(2)})
    text = F.col("_whole")
    maybe = (
        (F.length("_name") >= 2)
        & (F.col("_tail") != "")
        & ~F.col("_name").rlike(t.DATE_LABEL)
        & ~no_blanks(F.col("_name")).isin(UI_NOISE)
    )
    # Only the tail is an amount: the whole text must not be one itself.
    tests = F.transform(F.array("_tail", "_whole"), is_amount)
    ok = F.when(maybe, let(tests, lambda v: F.get(v, F.lit(0)) & ~F.get(v, F.lit(1))))
    ratio = F.least(F.lit(0.85), F.greatest(F.lit(0.40), F.length("_name") / F.length(text)))
    cut = F.col("min_x") + (F.col("max_x") - F.col("min_x")) * ratio

    def piece(part: int, x: Column, norm: Column, left: Column, right: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), x.alias("text"), norm.alias("text_normalized"), left.alias("min_x"), right.alias("max_x"),
            ((left + right) / 2.0).alias("cx"),
        )

    whole = piece(0, F.col("text"), token_text(), F.col("min_x"), F.col("max_x"))
    pieces = F.when(
        F.coalesce(ok, F.lit(False)),
        F.array(
            piece(0, F.col("_name"), F.col("_name"), F.col("min_x"), cut - 2.0),
            piece(1, F.col("_tail"), F.col("_tail"), cut + 2.0, F.col("max_x")),
        ),
    ).otherwise(F.array(whole))
    rest = [c for c in df.columns if c not in ("text", "text_normalized", "min_x", "max_x", "cx", "token_no")]
    return (
        parted.withColumn("_piece", F.explode(pieces))
        .select(*rest, (F.col("token_no") * 2 + F.col("_piece.part")).alias("token_no"), "_piece.*")
        .drop("part")
    )


def image_facts(df: DataFrame) -> DataFrame:
    """Per image: row height, receipt marks, bottom bar. One aggregation."""
    label = no_blanks(token_text())
    strong = contains_any(label, RECEIPT_MARKS)
    hint = ~strong & (contains_any(label, RECEIPT_HINTS) | (label == "viewhistory"))
    return (
        df.select(
            "image_id",
            (F.col("min_y") - F.col("max_y")).alias("neg_h"),
            strong.alias("strong"),
            hint.alias("hint"),
            (label.isin(list(BOTTOM_LABELS)) & (F.col("cy") >= F.col("height") * 0.90)).alias("bottom"),
        )
        .groupBy("image_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr("percentile_disc(0.5) within group (order by case when neg_h < 0 then neg_h end)").alias("neg_h"),
            F.coalesce(F.bool_or("strong"), F.lit(False)).alias("strong"),
            F.count_if("hint").alias("hints"),
            F.coalesce(F.bool_or("bottom"), F.lit(False)).alias("has_bottom"),
        )
        .select(
            "image_id",
            "n",
            F.coalesce(-F.col("neg_h"), F.lit(20.0)).alias("row_h"),
            (F.col("strong") | (F.col("hints") >= 2)).alias("receipt"),
            ((F.col("hints") == 1) & ~F.col("strong")).alias("weak_receipt"),
            "has_bottom",
        )
    )


def with_image_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts on every token; an image with very many tokens is spread by salt."""
    return salted_left_join(
        df, facts.drop("n"), ["image_id"], counts=facts.select("image_id", "n"), spread=["token_no"]
    )


def classify(df: DataFrame, leading_seven: bool = False) -> DataFrame:
    """Adds token type, label and amount. Expects the image facts on each row."""

    def amount_of(x: Column) -> Column:
        return t.read_amount(x, *[F.col(c) for c in ("min_x", "cx", "cy", "width", "height")], leading_seven)

    def either(first: Column) -> Column:
        """The normalised reading counts first, the raw one only where the former is no amount."""
        second = let(amount_of(F.col("text")), lambda a: F.when(a["is_amount"], a).otherwise(first))
        return F.when(first["is_amount"] | F.col("_same"), first).otherwise(second)

    text, norm = F.col("text"), F.col("_n")
    staged = (
        df.withColumn("_n", token_text())
        .withColumns({"label": no_blanks(norm), "_same": text.eqNullSafe(norm)})
        .withColumn("is_date", norm.rlike(t.DATE_LABEL) | (~F.col("_same") & text.rlike(t.DATE_LABEL)))
    )
    label, n, h = F.col("label"), F.lower(strip(norm)), F.col("height")
    in_top = (h > 0) & (F.col("cy") < h * 0.09) & ~F.col("is_date")
    in_bottom = (h > 0) & (F.col("cy") > h * 0.90)
    avatar = ~F.col("receipt") & (F.col("width") > 0) & (F.col("cx") / F.col("width") < 0.12) & (F.length(strip(norm)) <= 2)
    known_noise = (
        label.isin(UI_NOISE)
        | text.contains("@")
        | norm.contains("@")
        | contains_any(label, NOISE_INSIDE)
        | n.rlike(NOISE_STARTS)
        | (~F.col("_same") & F.lower(strip(text)).rlike("^notes:"))
    )
    # Dates and noise are settled before amounts, so only what is neither is read as one.
    told = (
        F.when(in_top, "noise")
        .when(in_bottom & (label.isin(UI_NOISE) | F.col("has_bottom")), "noise")
        .when(avatar, "noise")
        .when(F.col("is_date"), "date")
        .when(known_noise, "noise")
    )
    kind = (
        F.when(F.col("_told").isNotNull(), F.col("_told"))
        .when(F.col("amount.is_amount"), "amount")
        .when((F.col("width") <= 0) | (F.col("cx") / F.col("width") <= 0.70), "merchant")
        .otherwise("unknown")
    )
    amount = F.when(F.col("_told").isNull(), let(amount_of(norm), either))
    read = staged.withColumn("_told", told).withColumn("amount", amount).withColumn("token_type", kind)
    return read.drop("_n", "_same", "_told", "is_date")


def neighbours(
    df: DataFrame,
    is_anchor: Column,
    anchor: Column,
    order: list[Column],
    counts: DataFrame | None = None,
    min_hot: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``above`` and ``below``: the anchors next to each row in its image.

    ``anchor`` is a struct that starts with ``cy``. Rows are shuffled once by image and sorted once. Images
    with very many rows are cut into stripes: the last anchor of earlier stripes and the first one of later
    stripes come from one row per stripe of these images. They are found at once, from ``counts`` (``n`` by
    image, at least as many as it has rows) or by a pass over the rows. An anchor row sees itself. Rows
    without a place see anchors without one only.
    """
    marked = df.withColumn("_anchor", F.when(is_anchor, anchor))
    if counts is None:
        counts = df.select("image_id", F.lit(1).alias("n"))
    many = in_hot_buckets(counts, ["image_id"], min_hot)
    keys = ["image_id"]
    if many is not None:
        marked = marked.withColumn("_stripe", F.when(many, F.floor(F.col("cy") / STRIPE)))
        keys.append("_stripe")
    # One sort serves both directions.
    ordered = Window.partitionBy(*keys).orderBy(*order)
    found = marked.withColumns(
        {
            "_up": F.last("_anchor", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            "_down": F.expr("lead(_anchor) ignore nulls").over(ordered),
        }
    ).withColumn("_down", F.coalesce("_anchor", "_down"))
    unplaced = F.col("cy").isNull()
    above, below = (F.when(unplaced == F.col(f"{c}.cy").isNull(), F.col(c)) for c in ("_up", "_down"))
    if many is not None:
        found = found.join(_carried(marked.where(many)), keys, "left")
        above, below = F.coalesce(above, "_from_above"), F.coalesce(below, "_from_below")
    return found.withColumns({"above": above, "below": below}).drop(
        "_stripe", "_anchor", "_up", "_down", "_from_above", "_from_below"
    )


def _carried(marked: DataFrame) -> DataFrame:
    """Per stripe of an image the last anchor of the stripes before it and the first one of those after it."""
    # Their number is bounded by the height of the image.
    stripes = marked.groupBy("image_id", "_stripe").agg(F.min("_anchor").alias("_first"), F.max("_anchor").alias("_last"))
    by_image = Window.partitionBy("image_id")
    up = by_image.orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    down = by_image.orderBy(F.desc("_stripe")).rowsBetween(Window.unboundedPreceding, -1)
    return stripes.where("_stripe is not null").select(
        "image_id",
        "_stripe",
        F.last("_last", ignorenulls=True).over(up).alias("_from_above"),
        F.last("_first", ignorenulls=True).over(down).alias("_from_below"),
    )


def nearest() -> Column:
    """The nearer of ``above`` and ``below``; the upper one when equally far."""
    up, down = F.abs(F.col("cy") - F.col("above.cy")), F.abs(F.col("cy") - F.col("below.cy"))
    return F.when(F.col("below").isNull() | (up <= down), F.col("above")).otherwise(F.col("below"))


def bands(amounts: DataFrame, row_h: Column) -> DataFrame:
    """Vertical band of each amount: halfway to its neighbours, open ends by eight rows or 300 pixels."""
    far = F.greatest(row_h * 8.0, F.lit(300.0))
    w = Window.partitionBy("image_id").orderBy("cy", "token_no")
    return amounts.withColumns(
        {
            "band_top": F.coalesce((F.col("cy") + F.lag("cy").over(w)) / 2.0, F.col("cy") - far),
            "band_bottom": F.coalesce((F.col("cy") + F.lead("cy").over(w)) / 2.0, F.col("cy") + far),
        }
    )


def near_marks(rows: DataFrame, marks: DataFrame, reach: float, how: str, closed: bool) -> DataFrame:
    """Semi or anti join with marks of the same image at most ``reach`` above or below.

    Marks are put into three neighbouring cells of that height, so the join is on keys.
    """
    cell = F.floor(F.col("cy") / reach)
    left = rows.withColumn("_cell", cell)
    right = marks.select(
        F.col("image_id").alias("_image"),
        F.col("cy").alias("_cy"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("_mark_cell"),
    ).distinct()
    away = F.abs(F.col("cy") - F.col("_cy"))
    hit = (
        (F.col("image_id") == F.col("_image"))
        & (F.col("_cell") == F.col("_mark_cell"))
        & ((away <= reach) if closed else (away < reach))
    )
    return left.join(right, hit, how).drop("_cell")


def group_confidence(has_merchant: Column, has_date: Column, amount_confidence: Column) -> Column:
    zero = F.lit(0.0)
    total = amount_confidence * 0.50 + F.when(has_merchant, 0.35).otherwise(zero) + F.when(has_date, 0.15).otherwise(zero)
    return F.round(F.least(total, F.lit(1.0)), 4)


def _best_score() -> Column:
    return F.when(F.col("score") > 0, F.col("score")).otherwise(F.col("confidence"))


def _candidate(df: DataFrame, layout: str) -> DataFrame:
    """Common tail of both forms: direction, warnings, confidence."""
    merchant = F.nullif("merchant_text", F.lit(""))
    return df.select(
        "image_id",
        "pos",
        "cy",
        F.lit(layout).alias("layout"),
        F.col("amount_text_raw"),
        F.col("amount_text_normalized"),
        (F.col("amount_minor") / 100.0).alias("amount_value"),
        F.col("amount_minor").alias("amount_minor_units"),
        F.col("amount_confidence"),
        merchant.alias("merchant_text"),
        F.col("date_text"),
        t.row_direction(F.concat("amount_text_raw", F.lit(" "), "amount_text_normalized"), merchant).alias("transaction_type"),
        F.array_compact(
            F.array(F.when(merchant.isNull(), W_NO_MERCHANT), F.when(F.col("date_text").isNull(), W_NO_DATE))
        ).alias("warnings"),
        group_confidence(
            F.coalesce(F.length(merchant) >= 2, F.lit(False)), F.col("date_text").isNotNull(), F.col("amount_confidence")
        ).alias("grouping_confidence"),
    )


def _amount_struct() -> Column:
    return F.struct(
        "cy",
        "token_no",
        "min_x",
        F.col("text").alias("raw"),
        token_text().alias("norm"),
        F.col("amount.minor").alias("minor"),
        _best_score().alias("conf"),
    )


def list_candidates(classified: DataFrame) -> DataFrame:
    """One candidate per amount: names and the date of its band.

    A band reaches halfway to the next amounts, so a token belongs to its
    nearest amount; exactly halfway it is the upper one's.
    """
    is_amount = F.col("token_type") == "amount"
    rows = classified.where(F.col("token_type").isin("amount", "date", "merchant"))
    placed = neighbours(rows, is_amount, _amount_struct(), [F.col("cy"), F.col("token_no")])
    placed = placed.withColumn("_own", F.when(is_amount, _amount_struct()).otherwise(nearest()))
    away = F.abs(F.col("cy") - F.col("_own.cy"))
    left = ((F.col("width") > 0) & (F.col("cx") / F.col("width") <= 0.70)) | (F.col("max_x") <= F.col("_own.min_x") + 30)
    name_near = left & (away <= F.greatest(F.lit(85.0), F.col("row_h") * 1.10))
    date_near = away <= F.greatest(F.lit(95.0), F.col("row_h") * 1.25)
    name = F.col("_cleaned")
    date = F.when((F.col("token_type") == "date") & date_near, F.struct(away.alias("away"), F.col("token_no"), token_text().alias("d")))
    grouped = (
        placed.where(F.col("_own").isNotNull())
        .withColumn("_cleaned", F.when((F.col("token_type") == "merchant") & name_near, t.clean_prefix(token_text())))
        .withColumns({"_name": F.when(name != "", F.struct("cy", "token_no", name.alias("name"))), "_date": date})
        .groupBy("image_id", F.col("_own.token_no").alias("amount_no"))
        .agg(
            F.max(F.when(is_amount, F.col("_own"))).alias("a"),
            F.max(F.when(is_amount, F.col("height"))).alias("height"),
            F.array_sort(F.collect_list("_name")).alias("names"),
            F.min("_date").alias("date"),
        )
    )
    shown = grouped.select(
        "image_id",
        F.col("amount_no").alias("pos"),
        F.col("a.cy").alias("cy"),
        "height",
        F.col("a.raw").alias("amount_text_raw"),
        F.col("a.norm").alias("amount_text_normalized"),
        F.col("a.minor").alias("amount_minor"),
        F.col("a.conf").alias("amount_confidence"),
        F.array_join(F.transform("names", lambda x: x["name"]), " ").alias("merchant_text"),
        F.col("date.d").alias("date_text"),
    )
    # Amounts cut off by the bottom bar bound their neighbours but give no row.
    bar = classified.where(F.col("label").isin(list(CUT_OFF_LABELS)))
    low = (F.col("height") > 0) & (F.col("cy") > F.col("height") * 0.88)
    kept = shown.where(~low).unionByName(near_marks(shown.where(low), bar, 45.0, "left_anti", closed=True))
    return _candidate(kept, "list")


def _pick(test: Column, *order: Column) -> Column:
    """First row of a group, by ``order``, that passes the test; its token as a struct."""
    return F.min_by(
        F.when(
            test,
            F.struct(
                "cy", "min_x", "min_y", "token_no", "conf0",
                F.col("text").alias("raw"), token_text().alias("norm"), F.col("amount.minor").alias("minor"),
            ),
        ),
        F.when(test, F.struct(*order)),
    )


def valid_receipt_amounts(classified: DataFrame) -> DataFrame:
    """Amounts that are neither account lines nor rewards at the bottom."""
    amounts = classified.where(F.col("token_type") == "amount")
    footers = classified.where(token_text().rlike(FOOTER_STARTS))
    upper = materialise(
        amounts.groupBy("image_id")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("cy") <= F.col("height") * 0.50).alias("_upper")),
        "upper",
    )
    real = near_marks(amounts, footers, 60.0, "left_anti", closed=False)
    known = salted_left_join(
        real, upper.select("image_id", "_upper"), ["image_id"], counts=upper.select("image_id", "n"), spread=["token_no"]
    )
    reward = (F.col("height") > 0) & (F.col("cy") > F.col("height") * 0.75) & F.coalesce("_upper", F.lit(False))
    return known.where(~reward).drop("_upper")


def receipt_candidates(classified: DataFrame) -> DataFrame:
    """One candidate per receipt, or none where no amount is found."""
    # 1. Hero amount: the first one with a currency sign, else the first; else a plain number in the upper half.
    has_sign = token_text().contains("₹") | F.col("text").contains("₹")
    with_conf = classified.withColumns({"conf0": _best_score(), "_prefixed": t.clean_prefix(token_text())})
    heroes = (
        valid_receipt_amounts(with_conf)
        .groupBy("image_id")
        .agg(_pick(F.lit(True), (~has_sign), F.col("token_no")).alias("hero"))
    )
    bare = t.bare_number(F.col("text"))
    plain = (
        ~F.col("token_type").isin("noise", "date")
        & bare.rlike(r"^\d{1,6}(?:\.\d{1,2})?$")
        & ~F.startswith(strip(F.col("text")), F.lit("0"))
        & ((F.col("height") <= 0) | (F.col("cy") <= F.col("height") * 0.50))
    )
    minor = t.minor_from_text(bare)
    tests = {"_plain": plain, "_anchor": F.col("label").isin("paidto", "paymentto", "to", "receivedfrom")}
    tests["_seen"] = F.col("label").contains("viewhistory")
    tests["_named"] = (
        (F.col("token_type") == "merchant")
        & F.lower(strip(token_text())).rlike("^(?:to |paid to|payment to|received from)")
        & (F.length("_prefixed") >= 2)
        & ~no_blanks(F.col("_prefixed")).isin(UI_NOISE)
    )
    # Each token is tested once; an aggregate would test it again wherever it names the test.
    spare = with_conf.withColumns(tests).withColumn("amount", F.struct(F.when(F.col("_plain"), minor).alias("minor")))
    firsts = spare.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"),
        _pick(F.col("_plain") & (F.col("amount.minor") > 0), F.col("cy"), F.col("token_no")).alias("spare"),
        _pick(F.col("_anchor"), F.col("token_no")).alias("anchor"),
        _pick(F.col("_seen"), F.col("token_no")).alias("seen"),
        _pick(F.col("_named"), F.col("token_no")).alias("named"),
        F.min_by(F.when(F.col("token_type") == "date", token_text()), F.when(F.col("token_type") == "date", F.col("token_no"))).alias("date_text"),
    )
    chosen = firsts.join(heroes, "image_id", "left").withColumn("hero", F.coalesce("hero", "spare"))
    chosen = materialise(chosen.where(F.col("hero").isNotNull()).drop("spare"), "receipts")

    # 2. Names relative to the hero and the anchors.
    counts = chosen.select("image_id", "n")
    around = salted_left_join(
        with_conf, chosen.select("image_id", "hero", "anchor", "seen"), ["image_id"], counts=counts, spread=["token_no"]
    ).where(F.col("hero").isNotNull())
    label, name = F.col("label"), F.col("_prefixed")
    quiet = ~label.isin(UI_NOISE) & ~label.contains("@")
    below = (
        (F.col("min_y") >= F.col("anchor.min_y") - 5)
        & (F.col("cy") > F.col("anchor.cy"))
        & (F.col("cy") <= F.col("anchor.cy") + 130)
        & quiet
        & ~label.contains("debitedfrom")
        & (F.col("token_type") != "amount")
        & (strip(token_text()) != "")
    )
    beside = (
        (F.abs(F.col("cy") - F.col("seen.cy")) <= 50)
        & (F.col("max_x") <= F.col("seen.min_x") + 20)
        & quiet
        & (F.length(label) >= 2)
    )
    near = (
        (F.col("token_type") == "merchant")
        & (F.abs(F.col("hero.cy") - F.col("cy")) <= 250)
        & quiet
        & ~label.rlike(r"^\+91")
        & ~label.contains("••••")
        & (F.length(name) >= 2)
        & ~no_blanks(name).isin(UI_NOISE)
    )
    around = around.withColumns({"_below": F.coalesce(below, F.lit(False)), "_beside": F.coalesce(beside, F.lit(False)), "_near": near})
    picks = around.groupBy("image_id").agg(
        _pick(F.col("_below"), F.col("cy"), F.col("token_no")).alias("below"),
        _pick(F.col("_beside"), F.col("token_no")).alias("beside"),
        _pick(F.col("_near"), F.abs(F.col("hero.cy") - F.col("cy")), F.col("token_no")).alias("near"),
    )

    # 3. Tokens on one line with the name below the anchor.
    line = (
        salted_left_join(
            around.where("_below"),
            picks.select("image_id", F.col("below.cy").alias("_line")),
            ["image_id"],
            counts=counts,
            spread=["token_no"],
        )
        .where(F.abs(F.col("cy") - F.col("_line")) <= 25)
        .where(name != "")
        .groupBy("image_id")
        .agg(F.array_sort(F.collect_list(F.struct("min_x", "token_no", name.alias("w")))).alias("words"))
        .select("image_id", line_text(F.transform("words", lambda x: x["w"])).alias("line_text"))
    )

    def longer(x: Column) -> Column:
        return F.when(F.length(x) >= 2, x)

    merged = chosen.join(picks, "image_id", "left").join(line, "image_id", "left")
    return _candidate(
        merged.select(
            "image_id",
            F.lit(0).cast("long").alias("pos"),
            F.col("hero.cy").alias("cy"),
            F.col("hero.raw").alias("amount_text_raw"),
            F.col("hero.norm").alias("amount_text_normalized"),
            F.col("hero.minor").alias("amount_minor"),
            F.col("hero.conf0").alias("amount_confidence"),
            F.coalesce(
                longer(F.col("line_text")),
                longer(t.clean_prefix(F.col("beside.norm"))),
                t.clean_prefix(F.col("named.norm")),
                t.clean_prefix(F.col("near.norm")),
            ).alias("merchant_text"),
            "date_text",
        ),
        "receipt",
    )


def line_text(words: Column) -> Column:
    """Words of one line, repeats (in any case) once; a capitalised reading is preferred."""

    def best(all_words: Column, low: Column) -> Column:
        same = F.filter(all_words, lambda w: F.lower(w) == low)
        capital = F.filter(same, lambda w: F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)))
        return F.coalesce(F.try_element_at(capital, F.lit(1)), F.try_element_at(same, F.lit(1)))

    def join(v: Column) -> Column:
        lows = F.array_distinct(F.transform(v, lambda w: F.lower(w)))
        return strip(F.array_join(F.transform(lows, lambda low: best(v, low)), " "))

    return let(words, join)


def prepare(df: DataFrame, leading_seven: bool = False) -> DataFrame:
    """Split, classified tokens with image facts, written once for the passes that follow."""
    split = materialise(split_combined(df, leading_seven), "split")
    facts = materialise(image_facts(split), "facts")
    return materialise(classify(with_image_facts(split, facts), leading_seven), "tokens")


def layout_class(classified: DataFrame) -> DataFrame:
    """Receipt or list per image, with the signals behind it."""
    amount = F.col("token_type") == "amount"
    return classified.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(amount).alias("amounts"),
        F.count_distinct(F.when(amount, F.col("amount.minor"))).alias("distinct_amounts"),
        F.bool_or("receipt").alias("receipt"),
        F.bool_or("weak_receipt").alias("weak"),
    ).withColumn(
        "layout",
        F.when(
            F.col("receipt") | (F.col("weak") & (F.col("amounts") > 0) & ((F.col("amounts") <= 2) | (F.col("distinct_amounts") <= 1))),
            "receipt",
        ).otherwise("list"),
    )


def token_candidates(df: DataFrame, leading_seven: bool = False) -> DataFrame:
    """Candidates of all images: receipts where the layout says so and an amount is found, else lists."""
    classified = prepare(df, leading_seven)
    layout = materialise(layout_class(classified).select("image_id", "n", "layout"), "layouts")
    placed = salted_left_join(
        classified, layout.select("image_id", "layout"), ["image_id"], counts=layout.select("image_id", "n"), spread=["token_no"]
    )
    # Written, as either form reads its part several times: else each time all tokens are shuffled again.
    placed = materialise(placed, "placed")
    receipts = materialise(receipt_candidates(placed.where("layout = 'receipt'").drop("layout")), "receipt_rows")
    done = receipts.select("image_id").distinct()
    lists = placed.drop("layout").join(done, "image_id", "left_anti")
    return receipts.unionByName(list_candidates(lists))


def token_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("image_id", "token_type").agg(F.count(F.lit(1)).alias("n"))


def reading_order(df: DataFrame) -> DataFrame:
    """Numbers tokens of an image by centre line, then left edge."""
    w = Window.partitionBy("image_id").orderBy("cy", "min_x", "token_no")
    return df.withColumn("reading_index", F.row_number().over(w))


def fill_dates(df: DataFrame, as_of: datetime, column: str = "date") -> DataFrame:
    """Missing dates from the nearest earlier row of the image, else the nearest later, else ``as_of``.

    Rows of an image go by ``cy`` and ``pos``, or by ``pos`` alone where there is no ``cy``. Dates are
    carried over the edges of stripes, so an image with very many rows is not one task. Inferred
    rows lose the warning about the date.
    """
    placed = df if "cy" in df.columns else df.withColumn("cy", F.col("pos").cast("double"))
    anchor = F.struct("cy", "pos", F.col(column).alias("day"))
    filled = neighbours(placed, F.col(column).isNotNull(), anchor, [F.col("cy"), F.col("pos")])
    carried = F.coalesce("above.day", "below.day")
    inferred = F.col(column).isNull() & carried.isNotNull()
    return filled.withColumns(
        {
            "date_inferred": inferred,
            column: F.coalesce(F.col(column), carried, at(as_of)),
            "warnings": F.when(inferred, F.array_remove("warnings", W_NO_DATE)).otherwise(F.col("warnings")),
        }
    ).select(*df.columns, "date_inferred")
