"""Queries of the ledger: scans, mapping, filters, analytics, sorts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from passbook.catalog.registry import query
from passbook.catalog.views import AS_OF, AS_OF_FINE
from passbook.fixed_values import EXPENSE_CATEGORIES, INCOME_CATEGORIES
from passbook.functions import money
from passbook.operators import analytics, history
from passbook.plans import filters
from passbook.plans.filters import FilterSpec
from passbook.plans.period import Period

MONTH = Period.resolve("this_month", AS_OF)
WEEK = Period.resolve("this_week", AS_OF)
QUARTER = Period.resolve("last_3_months", AS_OF)
YEAR = Period.resolve("this_year", AS_OF)
DAY_FINE = Period.resolve("today", AS_OF_FINE)
WEEK_FINE = Period.resolve("this_week", AS_OF_FINE)
MONTH_FINE = Period.resolve("this_month", AS_OF_FINE)
CUSTOM_FINE = Period.resolve("custom", AS_OF_FINE, datetime(2024, 1, 3, 6), datetime(2024, 1, 24, 18, 30))

ALL = "id, type, amount, currency, title, merchant, category_id, date, note, source, created_at, updated_at"


def ts(moment: datetime) -> str:
    return f"timestamp '{moment:%Y-%m-%d %H:%M:%S.%f}'"


def inside(p: Period) -> str:
    return f"date between {ts(p.start)} and {ts(p.end)}"


def case_names(categories: dict[str, str], column: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in categories.items())
    return f"case {column} {whens} else 'Other' end"


def name_sql(kind: str = "type", cid: str = "category_id") -> str:
    return (
        f"case when {kind} = 'income' then {case_names(INCOME_CATEGORIES, cid)} "
        f"else {case_names(EXPENSE_CATEGORIES, cid)} end"
    )


def fixed_sql(x: str, decimals: int) -> str:
    """Fixed decimals of the exact binary value, ties up, in integers."""
    one, scale = 1 << 52, 10**decimals
    units = (
        f"(cast(floor({x}) as bigint) * {scale} + "
        f"((cast(trunc(({x} - floor({x})) * {one}.0::double) as bigint) * {scale} + {one >> 1}) >> 52))"
    )
    if decimals == 0:
        return f"cast({units} as varchar)"
    return f"concat(cast({units} // {scale} as varchar), '.', lpad(cast({units} % {scale} as varchar), {decimals}, '0'))"


# ---- scans -------------------------------------------------------------------------------


@query("scan_ledger", f"select {ALL} from ledger", "ledger")
def _(t):
    return filters.sorted_history(t.ledger)


@query("scan_by_id", f"select {ALL} from ledger where id = '4711'", "ledger")
def _(t):
    return history.by_id(t.ledger, "4711")


@query("scan_date_range", f"select {ALL} from ledger where {inside(QUARTER)}", "ledger")
def _(t):
    return history.by_date_range(t.ledger, QUARTER.start, QUARTER.end)


# ---- mapping -----------------------------------------------------------------------------


@query(
    "map_enum_default",
    """select id, case when o in ('income','expense') then o else 'expense' end as type,
              case when s in ('manual','screenshot','import','sms') then s else 'manual' end as source, currency
       from (select id, case when amount % 5 = 0 then 'refund' else type end as o,
                    case when amount % 7 = 0 then 'fax' else source end as s, currency from ledger) x""",
    "ledger",
)
def _(t):
    raw = t.ledger.withColumns(
        {
            "type": F.when(F.col("amount") % 5 == 0, "refund").otherwise(F.col("type")),
            "source": F.when(F.col("amount") % 7 == 0, "fax").otherwise(F.col("source")),
        }
    )
    return history.clean_enums(raw).select("id", "type", "source", "currency")


@query("money_to_minor", "select o_orderkey, cast(round(o_totalprice * 100) as bigint) as minor from orders")
def _(t):
    return t.orders.select("o_orderkey", money.to_minor(F.col("o_totalprice")).alias("minor"))


@query("money_to_major", "select id, amount / 100.0::double as major from ledger", "ledger")
def _(t):
    return t.ledger.select("id", money.to_major(F.col("amount")).alias("major"))


@query(
    "money_format",
    """select id, concat('₹', case when length(w) <= 3 then w else concat(
              reverse(trim(trailing ',' from regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)', '\\1,', 'g'))),
              ',', right(w, 3)) end, '.', c) as shown
       from (select id, cast(amount // 100 as varchar) as w, lpad(cast(amount % 100 as varchar), 2, '0') as c from ledger) x""",
    "ledger",
)
def _(t):
    return t.ledger.select("id", money.format_minor(F.col("amount")).alias("shown"))


@query(
    "category_lookup",
    f"""select id, type, category_id,
          case when type = 'income' then case when category_id in ({', '.join(repr(c) for c in INCOME_CATEGORIES)}) then category_id else 'other_income' end
               else case when category_id in ({', '.join(repr(c) for c in EXPENSE_CATEGORIES)}) then category_id else 'other' end end as category_known,
          {name_sql()} as category_name from ledger""",
    "ledger",
)
def _(t):
    return history.with_category(t.ledger).select("id", "type", "category_id", "category_known", "category_name")


@query(
    "title_display",
    "select id, coalesce(nullif(merchant, ''), title) as display_title from candidates",
    "candidates",
)
def _(t):
    return t.candidates.select("id", history.display_title().alias("display_title"))


@query(
    "insert_valid",
    """select id, case when coalesce(amount, 0) <= 0 then 'amount must be greater than zero'
                      when coalesce(trim(title), '') = '' then 'title must not be empty' end as reason from candidates""",
    "candidates",
)
def _(t):
    return history.validate_rows(t.candidates).select("id", "reason")


# ---- filters -----------------------------------------------------------------------------


@query(
    "filter_search",
    f"""select {ALL} from ledger where contains(lower(title), 'food') or contains(lower(merchant), 'food')
        or contains(lower(coalesce(note, '')), 'food') or contains(lower({name_sql()}), 'food')
        or contains(lower(coalesce(category_id, '')), 'food')""",
    "ledger",
)
def _(t):
    return filters.apply_filter(t.ledger, FilterSpec(query="  FOOD "), AS_OF)


@query("filter_type", f"select {ALL} from ledger where type = 'income'", "ledger")
def _(t):
    return filters.apply_filter(t.ledger, FilterSpec(type="income"), AS_OF)


@query("filter_category", f"select {ALL} from ledger_fine where lower(category_id) = 'shopping'", "ledger_fine")
def _(t):
    return filters.apply_filter(t.ledger_fine, FilterSpec(category_id="SHOPPING"), AS_OF)


@query("filter_source", f"select {ALL} from ledger where source = 'sms'", "ledger")
def _(t):
    return filters.apply_filter(t.ledger, FilterSpec(source="sms"), AS_OF)


@query(
    "filter_amount_preset",
    """select 'under_500' as preset, count(*) as n, cast(sum(amount) as bigint) as total from ledger_fine where amount < 50000
       union all select '500_1000', count(*), cast(sum(amount) as bigint) from ledger_big where amount between 50000 and 100000
       union all select '1000_5000', count(*), cast(sum(amount) as bigint) from ledger_big where amount between 100000 and 500000
       union all select 'above_5000', count(*), cast(sum(amount) as bigint) from ledger_big where amount > 500000
       union all select 'custom', count(*), cast(sum(amount) as bigint) from ledger_big where amount between 250000 and 750000""",
    "ledger_fine ledger_big",
)
def _(t):
    def one(df, preset, **bounds):
        spec = FilterSpec(amount_preset=preset, **bounds)
        return (
            filters.apply_filter(df, spec, AS_OF)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
            .select(F.lit(preset).alias("preset"), "n", "total")
        )

    big = t.ledger_big
    return (
        one(t.ledger_fine, "under_500")
        .unionByName(one(big, "500_1000"))
        .unionByName(one(big, "1000_5000"))
        .unionByName(one(big, "above_5000"))
        .unionByName(one(big, "custom", min_amount=250_000, max_amount=750_000))
    )


def _date_bounds(preset: str) -> tuple[datetime, datetime]:
    from datetime import timedelta

    if preset == "yesterday":
        p = Period.resolve("today", AS_OF_FINE - timedelta(days=1))
    else:
        p = Period.resolve(preset, AS_OF_FINE)
    return p.start, p.end


_DATE_PRESETS = ("today", "yesterday", "this_week", "this_month", "last_month")


@query(
    "filter_date_preset",
    " union all ".join(
        f"select '{p}' as preset, count(*) as n, coalesce(cast(sum(amount) as bigint), 0) as total from ledger_fine "
        f"where date between {ts(_date_bounds(p)[0])} and {ts(_date_bounds(p)[1])}"
        for p in _DATE_PRESETS
    )
    + " union all select 'custom', count(*), coalesce(cast(sum(amount) as bigint), 0) from ledger_fine "
    "where date >= timestamp '2024-01-05 00:00:00' and date <= timestamp '2024-01-09 23:59:59.999'",
    "ledger_fine",
)
def _(t):
    tests = {p: filters.date_in(p, AS_OF_FINE) for p in _DATE_PRESETS}
    tests["custom"] = filters.date_in("custom", AS_OF_FINE, datetime(2024, 1, 5, 9), datetime(2024, 1, 9, 1))
    sums = t.ledger_fine.agg(
        *[F.count_if(c).alias(f"n_{p}") for p, c in tests.items()],
        *[F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0).cast("long")).alias(f"t_{p}") for p, c in tests.items()],
    )
    rows = [F.struct(F.lit(p).alias("preset"), F.col(f"n_{p}").alias("n"), F.col(f"t_{p}").alias("total")) for p in tests]
    return sums.select(F.inline(F.array(*rows)))


@query(
    "filter_all",
    f"""select {ALL} from ledger where {inside(MONTH)} and type = 'expense' and lower(category_id) = 'health'
        and source = 'manual' and amount between 1000000 and 40000000 and contains(lower(merchant), 'customer')
        order by amount desc, id""",
    "ledger",
)
def _(t):
    spec = FilterSpec(
        query="customer",
        type="expense",
        category_id="Health",
        source="manual",
        amount_preset="custom",
        min_amount=1_000_000,
        max_amount=40_000_000,
        date_preset="this_month",
    )
    return filters.apply_filter(t.ledger, spec, AS_OF).orderBy(*filters.sort_columns("highest"))


@query(
    "filter_sql_search",
    f"select {ALL} from ledger where (title ilike '%urgent%' or merchant ilike '%urgent%') and type = 'expense'",
    "ledger",
)
def _(t):
    return t.ledger.where(filters.title_or_merchant_matches("Urgent", "expense"))


@query("filter_period", f"select {ALL} from ledger where {inside(YEAR)}", "ledger")
def _(t):
    return t.ledger.where(filters.in_period(YEAR))


# ---- analytics ---------------------------------------------------------------------------

_INC, _EXP = "type = 'income'", "type <> 'income'"


def _sum(cond: str) -> str:
    return f"cast(coalesce(sum(case when {cond} then amount end), 0) as bigint)"


def _count(cond: str) -> str:
    return f"count(case when {cond} then 1 end)"


def metrics_sql(table: str, p: Period) -> str:
    return f"""select *, total_income - total_expense as net,
          case when expense_count > 0 then (2 * total_expense + expense_count) // (2 * expense_count) else 0 end as avg_expense
        from (select {_sum(_INC)} as total_income, {_sum(_EXP)} as total_expense,
              {_count(_INC)} as income_count, {_count(_EXP)} as expense_count,
              coalesce(max(case when {_INC} then amount end), 0) as largest_income,
              coalesce(max(case when {_EXP} then amount end), 0) as largest_expense
              from {table} where {inside(p)}) m"""


@query("agg_metrics", metrics_sql("ledger", MONTH), "ledger")
def _(t):
    return analytics.metrics(t.ledger, MONTH)


@query(
    "agg_largest_expense",
    f"select {ALL} from ledger where {inside(YEAR)} and type = 'expense' and amount > 0 order by amount desc, date desc, id limit 1",
    "ledger",
)
def _(t):
    return analytics.largest_expense(t.ledger, YEAR)


def facts_sql(table: str, p: Period) -> str:
    q = p.previous()
    cur, prev = inside(p), inside(q)
    return f"""select {_sum(f'{cur} and {_INC}')} as income, {_sum(f'{cur} and {_EXP}')} as expense,
        {_count(f'{cur} and {_INC}')} as income_count, {_count(f'{cur} and {_EXP}')} as expense_count,
        {_sum(f'{prev} and {_INC}')} as prev_income, {_sum(f'{prev} and {_EXP}')} as prev_expense,
        {_count(prev)} as prev_count,
        {_sum(f'{cur} and {_EXP} and isodow(date) >= 6')} as weekend_sum,
        {_count(f'{cur} and {_EXP} and isodow(date) >= 6')} as weekend_count from {table}"""


def comparison_sql(facts: str, word: str) -> str:
    pct = "((expense - prev_expense)::double / prev_expense * 100)"
    shown = fixed_sql(f"abs{pct}", 1)
    nothing = "(prev_count = 0 and expense = 0 and income = 0)"
    return f"""select *, case when {nothing} then null when prev_expense = 0 and expense = 0 then 0.0::double
             when prev_expense = 0 then null else {pct} end as percent_change,
           case when {nothing} then 'No previous period data'
             when prev_expense = 0 and expense = 0 then 'Unchanged vs {word}'
             when prev_expense = 0 then concat('₹', cast((expense + 50) // 100 as varchar), ' more than {word}')
             when abs{pct} < 1 then 'Roughly unchanged vs {word}'
             when {pct} > 0 then concat({shown}, '% higher than {word}')
             else concat({shown}, '% lower than {word}') end as comparison_text,
           case when {nothing} then false when prev_expense = 0 then expense <> 0
             else abs{pct} >= 1 and {pct} > 0 end as is_higher,
           case when {nothing} then true when prev_expense = 0 then expense = 0 else abs{pct} < 1 end as is_steady,
           not {nothing} as has_previous from ({facts}) f"""


_CMP = "prev_income, prev_expense, percent_change, comparison_text, is_higher, is_steady, has_previous"


@query(
    "agg_comparison",
    f"select {_CMP} from ({comparison_sql(facts_sql('ledger', MONTH), MONTH.previous_word)}) c",
    "ledger",
)
def _(t):
    return analytics.comparison(t.ledger, MONTH)


def trend_sql(table: str, p: Period) -> str:
    spine = ", ".join(f"({b.pos}, '{b.label}', {ts(b.start)}, {ts(b.end)})" for b in p.buckets())
    return f"""select pos, label, bucket_start,
          cast(coalesce(sum(case when {_EXP} then amount end), 0) as bigint) as expense,
          cast(coalesce(sum(case when {_INC} then amount end), 0) as bigint) as income
        from (values {spine}) b(pos, label, bucket_start, bucket_end)
        left join {table} on date between bucket_start and bucket_end and {inside(p)}
        group by pos, label, bucket_start"""


@query("agg_trend", trend_sql("ledger", MONTH), "ledger")
def _(t):
    return analytics.trend(t.ledger, MONTH)


@query("agg_trend_day", trend_sql("ledger_fine", DAY_FINE), "ledger_fine")
def _(t):
    return analytics.trend(t.ledger_fine, DAY_FINE)


@query("agg_trend_week", trend_sql("ledger_fine", WEEK_FINE), "ledger_fine")
def _(t):
    return analytics.trend(t.ledger_fine, WEEK_FINE)


@query("agg_trend_quarter", trend_sql("ledger_big", QUARTER), "ledger_big")
def _(t):
    return analytics.trend(t.ledger_big, QUARTER)


@query("agg_trend_year", trend_sql("ledger_big", YEAR), "ledger_big")
def _(t):
    return analytics.trend(t.ledger_big, YEAR)


@query("agg_trend_custom", trend_sql("ledger_fine", CUSTOM_FINE), "ledger_fine")
def _(t):
    return analytics.trend(t.ledger_fine, CUSTOM_FINE)


def category_sql(table: str, p: Period) -> str:
    return f"""select category_id, {case_names(EXPENSE_CATEGORIES, 'category_id')} as category_name, total,
          case when sum(total) over () > 0 then total::double / (sum(total) over ())::double * 100 else 0.0 end as percentage, count
        from (select lower(coalesce(category_id, 'other')) as category_id, cast(sum(amount) as bigint) as total, count(*) as count
              from {table} where {inside(p)} and type <> 'income' group by 1) g"""


@query("agg_category", category_sql("ledger", MONTH), "ledger")
def _(t):
    return analytics.category_breakdown(t.ledger, MONTH)


@query(
    "win_share",
    """select merchant, total, total::double / (sum(total) over ())::double * 100 as share
       from (select merchant, cast(sum(amount) as bigint) as total from ledger_big group by merchant) g""",
    "ledger_big",
)
def _(t):
    """Share of the whole for many groups: the total is a scalar, not a one-task window."""
    grouped = t.ledger_big.groupBy("merchant").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count"))
    return analytics.with_share(grouped).select("merchant", "total", "share")


def insights_sql(table: str, p: Period) -> str:
    top_pct = "(top_total::double / expense * 100)"
    kept = "((income - expense)::double / income * 100)"
    wk, wd = "(weekend_sum::double / weekend_count)", "((expense - weekend_sum)::double / (expense_count - weekend_count))"
    gap = f"(({wk} - {wd}) / {wd} * 100)"
    return f"""select cast(row_number() over (order by k) - 1 as integer) as pos, insight_id, title, message, tone from (
        with f as (select * from ({comparison_sql(facts_sql(table, p), p.previous_word)}) c),
             g as (select lower(coalesce(category_id, 'other')) as cid, cast(sum(amount) as bigint) as top_total from {table}
                   where {inside(p)} and {_EXP} group by 1 order by 2 desc, 1 limit 1),
             l as (select amount, coalesce(nullif(merchant, ''), title) as label from {table}
                   where {inside(p)} and {_EXP} and amount > 0 order by amount desc, date desc, id limit 1)
        select 1 as k, 'comparison_trend' as insight_id,
               case when is_higher then 'Spending Increased' else 'Spending Decreased' end as title,
               concat('Your spending is ', comparison_text, '.') as message,
               case when is_higher then 'warning' else 'positive' end as tone
        from f where has_previous and percent_change is not null and not is_steady
        union all select 1, 'comparison_steady', 'Steady Spending', concat('Your spending is ', comparison_text, '.'), 'neutral'
        from f where has_previous and is_steady
        union all select 2, 'top_category', 'Top Category', concat({case_names(EXPENSE_CATEGORIES, 'cid')},
               ' is your largest expense category (', {fixed_sql(top_pct, 0)}, '% of total spending).'), 'neutral'
        from f, g where top_total > 0
        union all select 3, 'positive_savings', 'Positive Cash Flow', concat('You retained ₹', cast((income - expense + 50) // 100 as varchar),
               ' (', {fixed_sql(f'abs{kept}', 0)}, '% of income) this period.'), 'positive'
        from f where income > 0 and expense > 0 and income > expense
        union all select 3, 'negative_cash_flow', 'Expenses Exceeded Income',
               concat('Your expenses exceeded your income by ₹', cast((expense - income + 50) // 100 as varchar), '.'), 'warning'
        from f where income > 0 and expense > 0 and income < expense
        union all select 4, 'largest_single_expense', 'Largest Expense', concat('Your largest single expense was ₹',
               cast((amount + 50) // 100 as varchar), ' on "', label, '".'), 'neutral' from l
        union all select 5, 'weekend_spending', 'Weekend Spending Pattern', concat('You spend roughly ', {fixed_sql(f'abs{gap}', 0)},
               '% more per transaction on weekends than on weekdays.'), 'neutral'
        from f where income_count + expense_count >= 4 and {p.span_days} >= 6 and weekend_count > 0
             and expense_count > weekend_count and {wk} > {wd} * 1.25
        union all select 6, 'transaction_volume', 'Activity Summary', concat('You recorded ', cast(expense_count as varchar),
               ' expenses with an average spend of ₹',
               cast(((2 * expense + expense_count) // (2 * expense_count) + 50) // 100 as varchar), '.'), 'neutral'
        from f where expense_count > 0) i"""


@query("agg_insights", insights_sql("ledger", WEEK), "ledger")
def _(t):
    return analytics.insights(t.ledger, WEEK)


@query("agg_insights_month", insights_sql("ledger_fine", MONTH_FINE), "ledger_fine")
def _(t):
    return analytics.insights(t.ledger_fine, MONTH_FINE)


@query(
    "agg_weekend",
    f"""select weekend_count, weekday_count, weekend_mean, weekday_mean,
          (weekend_mean - weekday_mean) / weekday_mean * 100 as weekend_percent,
          coalesce(n >= 4 and {WEEK.span_days} >= 6 and weekend_mean > weekday_mean * 1.25, false) as weekend_shown
        from (select {_count(f'{_EXP} and isodow(date) >= 6')} as weekend_count,
              {_count(f'{_EXP} and isodow(date) < 6')} as weekday_count, count(*) as n,
              sum(case when {_EXP} and isodow(date) >= 6 then amount end)::double / nullif({_count(f'{_EXP} and isodow(date) >= 6')}, 0) as weekend_mean,
              sum(case when {_EXP} and isodow(date) < 6 then amount end)::double / nullif({_count(f'{_EXP} and isodow(date) < 6')}, 0) as weekday_mean
              from ledger where {inside(WEEK)}) w""",
    "ledger",
)
def _(t):
    return analytics.weekend_pattern(t.ledger, WEEK)


def dashboard_sql(table: str, p: Period, as_of: datetime) -> str:
    days = p.elapsed_days(as_of)
    facts = comparison_sql(facts_sql(table, p), p.previous_word)
    cols = {
        "net": "income - expense",
        "income": "income",
        "expense": "expense",
        "prev_income": "prev_income",
        "prev_expense": "prev_expense",
        "avg_daily": f"(2 * expense + {days}) // {2 * days}",
        "is_period_empty": "case when income_count + expense_count = 0 then 1 else 0 end",
        "is_ledger_empty": f"case when (select count(*) from {table}) = 0 then 1 else 0 end",
    }
    head = " union all ".join(
        f"select 'summary' as section, {i} as pos, '{n}' as label, cast({e} as bigint) as amount, cast(null as varchar) as text from ({facts}) f"
        for i, (n, e) in enumerate(cols.items())
    )
    return f"""{head}
        union all select 'comparison', null, 'text', null, comparison_text from ({facts}) f
        union all select 'trend', pos, label, expense, null from ({trend_sql(table, p)}) x
        union all select 'category', null, category_id, total, category_name from ({category_sql(table, p)}) x
        union all select 'recent', null, id, amount, title from (select * from {table} order by date desc, id limit 5) x
        union all select 'largest', null, id, amount, title from (select * from {table} where {inside(p)} and type = 'expense' and amount > 0
                    order by amount desc, date desc, id limit 1) x
        union all select 'insight', pos, insight_id, null, message from ({insights_sql(table, p)}) x"""


@query("agg_dashboard", dashboard_sql("ledger", MONTH, AS_OF), "ledger")
def _(t):
    return analytics.dashboard_rows(t.ledger, MONTH, AS_OF)


@query(
    "agg_avg_daily",
    f"""select total_expense, {MONTH.elapsed_days(AS_OF)} as days,
          (2 * total_expense + {MONTH.elapsed_days(AS_OF)}) // {2 * MONTH.elapsed_days(AS_OF)} as avg_daily
        from (select {_sum(_EXP)} as total_expense from ledger where {inside(MONTH)}) x""",
    "ledger",
)
def _(t):
    return analytics.avg_daily(t.ledger, MONTH, AS_OF)


@query(
    "agg_filtered_summary",
    f"""select count(*) as count, {_sum(_EXP)} as total_expense, {_sum(_INC)} as total_income,
          {_sum(_INC)} - {_sum(_EXP)} as net from ledger where source = 'sms' and amount > 500000""",
    "ledger",
)
def _(t):
    spec = FilterSpec(source="sms", amount_preset="above_5000")
    return history.filtered_summary(filters.apply_filter(t.ledger, spec, AS_OF))


@query(
    "agg_day_groups",
    f"""select cast(date as date) as day, case when cast(date as date) = date '{AS_OF_FINE:%Y-%m-%d}' then 'Today'
          when cast(date as date) = date '{AS_OF_FINE:%Y-%m-%d}' - 1 then 'Yesterday'
          else strftime(date, '%B %-d, %Y') end as day_label, count(*) as count,
          {_sum(_INC)} as total_income, {_sum(_EXP)} as total_expense from ledger_fine group by 1, 2""",
    "ledger_fine",
)
def _(t):
    return history.day_groups(t.ledger_fine, AS_OF_FINE)


# ---- sorts and top-k -----------------------------------------------------------------------


@query("sort_orders", f"select {ALL} from ledger", "ledger")
def _(t):
    return filters.sorted_history(t.ledger, "a_to_z")


@query(
    "topk_expenses",
    f"select {ALL} from ledger where {inside(MONTH)} and type = 'expense' order by amount desc, date desc, id limit 5",
    "ledger",
)
def _(t):
    return analytics.top_expenses(t.ledger, MONTH)


@query("topk_recent", f"select {ALL} from ledger order by date desc, id limit 5", "ledger")
def _(t):
    return analytics.recent(t.ledger)


@query(
    "join_selected",
    """select count(*) as selected_count, coalesce(cast(sum(amount) as bigint), 0) as selected_total
       from ledger_big where exists (select 1 from ledger_fine f where f.id = split_part(ledger_big.id, '-', 1))""",
    "ledger_big ledger_fine",
)
def _(t):
    keyed = t.ledger_big.withColumn("id", F.substring_index("id", "-", 1))
    return history.selected_total(keyed, t.ledger_fine)
