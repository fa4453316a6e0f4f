"""Period analytics. One scan feeds all headline figures.

``period_facts`` first groups by category, then folds the few category rows
into a single row; map-side partial aggregation keeps both shuffles tiny, and
no join or global window is needed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passbook.functions.categories import category_name
from passbook.functions.money import fixed_text, rounded_mean, whole_major_text
from passbook.functions.times import at
from passbook.operators.history import display_title
from passbook.plans.filters import in_period
from passbook.plans.period import Period



def _zero() -> Column:
    return F.lit(0).cast("long")


def _sum_if(test: Column, value: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("amount") if value is None else value)), _zero())


def _is_income() -> Column:
    return F.col("type") == "income"


def _category_key() -> Column:
    return F.lower(F.coalesce("category_id", F.lit("other")))


def two_periods(df: DataFrame, period: Period) -> DataFrame:
    """Rows of the period and of the one before, with a flag for the current one."""
    before = period.previous()
    return df.where(in_period(period) | in_period(before)).withColumn("is_current", in_period(period))


def period_facts(df: DataFrame, period: Period) -> DataFrame:
    """One row with every figure that metrics, comparison and insights need."""
    cur, inc = F.col("is_current"), _is_income()
    spent = cur & ~inc
    weekend = F.weekday("date") >= 5
    # The smallest of these is the largest amount, then the newest, then the lowest id.
    rank = F.struct(
        (-F.col("amount")).alias("neg_amount"),
        (-F.unix_micros(F.col("date").cast("timestamp"))).alias("neg_time"),
        F.col("id"),
        display_title().alias("label"),
    )
    per_category = (
        two_periods(df, period)
        .groupBy(_category_key().alias("category_id"))
        .agg(
            _sum_if(cur & inc).alias("income"),
            _sum_if(spent).alias("expense"),
            F.count_if(cur & inc).alias("income_count"),
            F.count_if(spent).alias("expense_count"),
            F.max(F.when(cur & inc, F.col("amount"))).alias("max_income"),
            F.min(F.when(spent & (F.col("amount") > 0), rank)).alias("top_row"),
            _sum_if(~cur & inc).alias("prev_income"),
            _sum_if(~cur & ~inc).alias("prev_expense"),
            F.count_if(~cur).alias("prev_count"),
            _sum_if(spent & weekend).alias("weekend_sum"),
            F.count_if(spent & weekend).alias("weekend_count"),
        )
    )
    top_category = F.min(
        F.when(
            F.col("expense_count") > 0,
            F.struct((-F.col("expense")).alias("neg_total"), F.col("category_id")),
        )
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), _zero()).alias(name)

    return per_category.agg(
        *[
            total(n)
            for n in (
                "income",
                "expense",
                "income_count",
                "expense_count",
                "prev_income",
                "prev_expense",
                "prev_count",
                "weekend_sum",
                "weekend_count",
            )
        ],
        F.coalesce(F.max("max_income"), _zero()).alias("largest_income"),
        F.min("top_row").alias("top_row"),
        top_category.alias("top_category"),
    ).withColumns(
        {
            "net": F.col("income") - F.col("expense"),
            "avg_expense": rounded_mean(F.col("expense"), F.col("expense_count")),
            "largest_expense": F.coalesce(-F.col("top_row.neg_amount"), _zero()),
            "largest_income": F.greatest("largest_income", _zero()),
        }
    )


def metrics(df: DataFrame, period: Period) -> DataFrame:
    """Totals, counts, mean and largest amounts of a period; zeros when it is empty."""
    cur = df.where(in_period(period))
    inc = _is_income()
    folded = cur.agg(
        _sum_if(inc).alias("total_income"),
        _sum_if(~inc).alias("total_expense"),
        F.count_if(inc).alias("income_count"),
        F.count_if(~inc).alias("expense_count"),
        F.greatest(F.coalesce(F.max(F.when(inc, F.col("amount"))), _zero()), _zero()).alias("largest_income"),
        F.greatest(F.coalesce(F.max(F.when(~inc, F.col("amount"))), _zero()), _zero()).alias("largest_expense"),
    )
    return folded.withColumns(
        {
            "net": F.col("total_income") - F.col("total_expense"),
            "avg_expense": rounded_mean(F.col("total_expense"), F.col("expense_count")),
        }
    )


def largest_expense(df: DataFrame, period: Period) -> DataFrame:
    """The row with the largest expense; newest, then lowest id, wins ties."""
    spent = df.where(in_period(period) & (F.col("type") == "expense") & (F.col("amount") > 0))
    return spent.orderBy(F.desc("amount"), F.desc("date"), "id").limit(1)


def _comparison_columns(facts: DataFrame, period: Period) -> DataFrame:
    """Adds percent change, text and flags to a row of facts."""
    word = period.previous_word
    expense, prev = F.col("expense"), F.col("prev_expense")
    nothing = (F.col("prev_count") == 0) & (expense == 0) & (F.col("income") == 0)
    percent = F.try_divide(expense - prev, prev) * 100
    shown = fixed_text(F.abs(percent), 1)
    steady = F.abs(percent) < 1.0
    text = (
        F.when(nothing, "No previous period data")
        .when((prev == 0) & (expense == 0), f"Unchanged vs {word}")
        .when(prev == 0, F.concat(F.lit("₹"), whole_major_text(expense), F.lit(f" more than {word}")))
        .when(steady, f"Roughly unchanged vs {word}")
        .when(percent > 0, F.concat(shown, F.lit(f"% higher than {word}")))
        .otherwise(F.concat(shown, F.lit(f"% lower than {word}")))
    )
    return facts.withColumns(
        {
            "percent_change": F.when(nothing, F.lit(None).cast("double"))
            .when((prev == 0) & (expense == 0), F.lit(0.0))
            .when(prev == 0, F.lit(None).cast("double"))
            .otherwise(percent),
            "comparison_text": text,
            "is_higher": F.when(nothing, False)
            .when(prev == 0, expense != 0)
            .otherwise(~steady & (percent > 0)),
            "is_steady": F.when(nothing, True).when(prev == 0, expense == 0).otherwise(steady),
            "has_previous": ~nothing,
        }
    )


_COMPARISON = (
    "prev_income",
    "prev_expense",
    "percent_change",
    "comparison_text",
    "is_higher",
    "is_steady",
    "has_previous",
)


def comparison(df: DataFrame, period: Period) -> DataFrame:
    """This period against the one before, from one scan over both."""
    cur, inc = F.col("is_current"), _is_income()
    sums = two_periods(df, period).agg(
        _sum_if(cur & inc).alias("income"),
        _sum_if(cur & ~inc).alias("expense"),
        _sum_if(~cur & inc).alias("prev_income"),
        _sum_if(~cur & ~inc).alias("prev_expense"),
        F.count_if(~cur).alias("prev_count"),
    )
    return _comparison_columns(sums, period).select(*_COMPARISON)


def _bucket_pos(period: Period) -> Column:
    chain = None
    for b in period.buckets():
        hit = F.col("date").between(at(b.start), at(b.end))
        chain = F.when(hit, F.lit(b.pos)) if chain is None else chain.when(hit, F.lit(b.pos))
    return chain


def _bucket_spine(spark: SparkSession, period: Period) -> DataFrame:
    rows = [
        F.struct(
            F.lit(b.pos).alias("pos"), F.lit(b.label).alias("label"), at(b.start).alias("bucket_start")
        )
        for b in period.buckets()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def trend(df: DataFrame, period: Period) -> DataFrame:
    """Income and expense per chart bucket; empty buckets stand with zeros.

    The bucket is a column of the row, so a plain grouped sum does it; the
    spine of at most twelve rows is added as zero rows instead of a range join.
    """
    spine = _bucket_spine(df.sparkSession, period)
    rows = df.where(in_period(period)).select(
        _bucket_pos(period).alias("pos"),
        F.when(_is_income(), 0).otherwise(F.col("amount")).alias("expense"),
        F.when(_is_income(), F.col("amount")).otherwise(0).alias("income"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("timestamp_ntz").alias("bucket_start"),
    )
    zeros = spine.select("pos", _zero().alias("expense"), _zero().alias("income"), "label", "bucket_start")
    return (
        rows.where(F.col("pos").isNotNull())
        .unionByName(zeros)
        .groupBy("pos")
        .agg(
            F.max("label").alias("label"),
            F.max("bucket_start").alias("bucket_start"),
            F.sum("expense").alias("expense"),
            F.sum("income").alias("income"),
        )
        .orderBy("pos")
    )


def category_breakdown(df: DataFrame, period: Period) -> DataFrame:
    """Expense per category with its share of the total, largest first.

    The total is a scalar subquery over the grouped rows, so no window draws all
    groups into one task. It asks for the same aggregates as the main plan: the
    grouped exchange is then made once and used twice.
    """
    grouped = (
        df.where(in_period(period) & ~_is_income())
        .groupBy(_category_key().alias("category_id"))
        .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count"))
    )
    return with_share(grouped).select(
        "category_id",
        category_name(F.lit("expense"), F.col("category_id")).alias("category_name"),
        "total",
        F.when(F.col("whole") > 0, F.col("share")).otherwise(F.lit(0.0)).alias("percentage"),
        "count",
    ).orderBy(F.desc("total"), "category_id")


def with_share(grouped: DataFrame) -> DataFrame:
    """Adds the whole and the percentage of it to grouped rows with ``total`` and ``count``."""
    both = F.struct(F.sum("total").alias("total"), F.sum("count").alias("count"))
    return grouped.withColumn("_whole", grouped.select(both).scalar()).withColumns(
        {"whole": F.col("_whole.total"), "share": F.try_divide("total", F.col("_whole.total")) * 100}
    ).drop("_whole")


def top_expenses(df: DataFrame, period: Period, k: int = 5) -> DataFrame:
    spent = df.where(in_period(period) & (F.col("type") == "expense"))
    return spent.orderBy(F.desc("amount"), F.desc("date"), "id").limit(k)


def recent(df: DataFrame, k: int = 5) -> DataFrame:
    """Newest rows of the whole ledger."""
    return df.orderBy(F.desc("date"), "id").limit(k)


def _weekend_columns(facts: DataFrame, period: Period) -> DataFrame:
    weekend = F.try_divide("weekend_sum", "weekend_count")
    weekday = F.try_divide(
        F.col("expense") - F.col("weekend_sum"), F.col("expense_count") - F.col("weekend_count")
    )
    enough = (F.col("income_count") + F.col("expense_count") >= 4) & F.lit(period.span_days >= 6)
    shown = enough & (weekend > weekday * 1.25)
    return facts.withColumns(
        {
            "weekend_mean": weekend,
            "weekday_mean": weekday,
            "weekend_percent": F.try_divide(weekend - weekday, weekday) * 100,
            "weekend_shown": F.coalesce(shown, F.lit(False)),
        }
    )


def weekend_pattern(df: DataFrame, period: Period) -> DataFrame:
    """Mean expense at weekends and on weekdays, and whether the gap is worth a note."""
    inc, weekend = _is_income(), F.weekday("date") >= 5
    sums = df.where(in_period(period)).agg(
        _sum_if(~inc).alias("expense"),
        F.count_if(inc).alias("income_count"),
        F.count_if(~inc).alias("expense_count"),
        _sum_if(~inc & weekend).alias("weekend_sum"),
        F.count_if(~inc & weekend).alias("weekend_count"),
    )
    return _weekend_columns(sums, period).select(
        "weekend_count",
        (F.col("expense_count") - F.col("weekend_count")).alias("weekday_count"),
        "weekend_mean",
        "weekday_mean",
        "weekend_percent",
        "weekend_shown",
    )


def _message(key: str, title: Column | str, text: Column, tone: Column | str) -> Column:
    def lit(x: Column | str) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.lit(key).alias("insight_id"), lit(title).alias("title"), text.alias("message"), lit(tone).alias("tone")
    )


def _insight_rows(facts: DataFrame, period: Period) -> DataFrame:
    f = _weekend_columns(_comparison_columns(facts, period), period)
    expense, income, net = F.col("expense"), F.col("income"), F.col("net")
    spending = F.concat(F.lit("Your spending is "), F.col("comparison_text"), F.lit("."))
    moved = F.col("has_previous") & F.col("percent_change").isNotNull() & ~F.col("is_steady")
    top_share = F.try_divide(-F.col("top_category.neg_total"), expense) * 100
    top_name = category_name(F.lit("expense"), F.col("top_category.category_id"))
    both = (income > 0) & (expense > 0)
    kept = F.try_divide(net, income) * 100
    messages = F.array(
        F.when(
            moved,
            _message(
                "comparison_trend",
                F.when(F.col("is_higher"), "Spending Increased").otherwise("Spending Decreased"),
                spending,
                F.when(F.col("is_higher"), "warning").otherwise("positive"),
            ),
        ),
        F.when(
            F.col("has_previous") & F.col("is_steady"),
            _message("comparison_steady", "Steady Spending", spending, "neutral"),
        ),
        F.when(
            top_share > 0,
            _message(
                "top_category",
                "Top Category",
                F.concat(
                    top_name,
                    F.lit(" is your largest expense category ("),
                    fixed_text(top_share, 0),
                    F.lit("% of total spending)."),
                ),
                "neutral",
            ),
        ),
        F.when(
            both & (net > 0),
            _message(
                "positive_savings",
                "Positive Cash Flow",
                F.concat(
                    F.lit("You retained ₹"),
                    whole_major_text(net),
                    F.lit(" ("),
                    fixed_text(F.abs(kept), 0),
                    F.lit("% of income) this period."),
                ),
                "positive",
            ),
        ),
        F.when(
            both & (net < 0),
            _message(
                "negative_cash_flow",
                "Expenses Exceeded Income",
                F.concat(
                    F.lit("Your expenses exceeded your income by ₹"), whole_major_text(-net), F.lit(".")
                ),
                "warning",
            ),
        ),
        F.when(
            F.col("largest_expense") > 0,
            _message(
                "largest_single_expense",
                "Largest Expense",
                F.concat(
                    F.lit("Your largest single expense was ₹"),
                    whole_major_text(F.col("largest_expense")),
                    F.lit(' on "'),
                    F.col("top_row.label"),
                    F.lit('".'),
                ),
                "neutral",
            ),
        ),
        F.when(
            F.col("weekend_shown"),
            _message(
                "weekend_spending",
                "Weekend Spending Pattern",
                F.concat(
                    F.lit("You spend roughly "),
                    fixed_text(F.abs(F.col("weekend_percent")), 0),
                    F.lit("% more per transaction on weekends than on weekdays."),
                ),
                "neutral",
            ),
        ),
        F.when(
            F.col("expense_count") > 0,
            _message(
                "transaction_volume",
                "Activity Summary",
                F.concat(
                    F.lit("You recorded "),
                    F.col("expense_count").cast("string"),
                    F.lit(" expenses with an average spend of ₹"),
                    whole_major_text(F.col("avg_expense")),
                    F.lit("."),
                ),
                "neutral",
            ),
        ),
    )
    return f.select(F.posexplode(F.array_compact(messages)).alias("pos", "m")).select("pos", "m.*")


def insights(df: DataFrame, period: Period) -> DataFrame:
    """Up to six messages in a fixed order."""
    return _insight_rows(period_facts(df, period), period)


def avg_daily(df: DataFrame, period: Period, as_of: datetime) -> DataFrame:
    """Expense per elapsed day, rounded."""
    days = period.elapsed_days(as_of)
    spent = df.where(in_period(period)).agg(_sum_if(~_is_income()).alias("total_expense"))
    return spent.select(
        "total_expense",
        F.lit(days).alias("days"),
        rounded_mean(F.col("total_expense"), F.lit(days)).alias("avg_daily"),
    )


def dashboard(df: DataFrame, period: Period, as_of: datetime) -> dict[str, DataFrame]:
    """The parts of a dashboard; each is a small frame of its own."""
    days = period.elapsed_days(as_of)
    facts = _comparison_columns(period_facts(df, period), period)
    any_row = df.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("n"))
    summary = facts.select(
        "net",
        "income",
        "expense",
        *_COMPARISON,
        rounded_mean(F.col("expense"), F.lit(days)).alias("avg_daily"),
        (F.col("income_count") + F.col("expense_count") == 0).alias("is_period_empty"),
        (any_row.scalar() == 0).alias("is_ledger_empty"),
    )
    return {
        "summary": summary,
        "trend": trend(df, period),
        "categories": category_breakdown(df, period),
        "recent": recent(df),
        "largest": largest_expense(df, period),
        "insights": insights(df, period),
    }


def dashboard_rows(df: DataFrame, period: Period, as_of: datetime) -> DataFrame:
    """The dashboard as one long frame ``(section, pos, label, amount, text)``."""
    parts = dashboard(df, period, as_of)
    head = parts["summary"]
    null_text = F.lit(None).cast("string")
    figures = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(n).alias("label"), F.col(n).cast("long").alias("amount"))
            for i, n in enumerate(
                ["net", "income", "expense", "prev_income", "prev_expense", "avg_daily", "is_period_empty", "is_ledger_empty"]
            )
        ]
    )

    def rows(section: str, frame: DataFrame, pos: Column, label: Column, amount: Column, text: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"),
            pos.cast("int").alias("pos"),
            label.alias("label"),
            amount.cast("long").alias("amount"),
            text.alias("text"),
        )

    none = F.lit(None)
    return (
        rows("summary", head.select(F.inline(figures)), F.col("pos"), F.col("label"), F.col("amount"), null_text)
        .unionByName(rows("comparison", head, none, F.lit("text"), none, F.col("comparison_text")))
        .unionByName(rows("trend", parts["trend"], F.col("pos"), F.col("label"), F.col("expense"), null_text))
        .unionByName(
            rows("category", parts["categories"], none, F.col("category_id"), F.col("total"), F.col("category_name"))
        )
        .unionByName(rows("recent", parts["recent"], none, F.col("id"), F.col("amount"), F.col("title")))
        .unionByName(rows("largest", parts["largest"], none, F.col("id"), F.col("amount"), F.col("title")))
        .unionByName(
            rows("insight", parts["insights"], F.col("pos"), F.col("insight_id"), none, F.col("message"))
        )
    )
