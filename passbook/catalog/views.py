"""Views that turn the given tables into ledger, message and token tables.

Each text runs unchanged in Spark SQL and in the checking engine. Braces name
the inputs. The ledger is a pure projection of one table, so predicates on it
reach the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime

AS_OF = datetime(1998, 6, 17, 14, 30)
AS_OF_FINE = datetime(2024, 1, 17, 14, 30)

LEDGER = """
select cast(o_orderkey as string) as id,
       case when o_orderstatus = 'P' then 'income' else 'expense' end as type,
       cast(round(o_totalprice * 100) as bigint) as amount, 'INR' as currency,
       concat('Order ', o_orderpriority) as title,
       concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) as merchant,
       case o_orderpriority when '1-URGENT' then 'health' when '2-HIGH' then 'food'
            when '3-MEDIUM' then 'transport' when '5-LOW' then 'groceries' end as category_id,
       o_orderdate as date, cast(null as string) as note,
       case o_orderkey % 4 when 0 then 'manual' when 1 then 'screenshot' when 2 then 'import' else 'sms' end as source,
       o_orderdate as created_at, o_orderdate as updated_at
from {orders}
"""

LEDGER_FINE = """
select cast(event_id as string) as id,
       case when event_type = 'signup' then 'income' else 'expense' end as type,
       cast(round(value * 100) as bigint) as amount, 'INR' as currency,
       concat('Event ', event_type) as title, concat('User ', cast(user_id as string)) as merchant,
       case event_type when 'purchase' then 'Shopping' when 'click' then 'bills'
            when 'view' then 'entertainment' end as category_id,
       ts as date, props as note, 'import' as source, ts as created_at, ts as updated_at
from {events}
"""

LEDGER_BIG = """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
              cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
       case when l_returnflag = 'R' then 'income' else 'expense' end as type,
       cast(round(l_extendedprice * 100) as bigint) as amount, 'INR' as currency,
       concat('Part ', cast(l_partkey as string)) as title,
       concat('Supplier ', cast(l_suppkey as string)) as merchant,
       case when l_linestatus = 'O' then 'shopping' else 'bills' end as category_id,
       l_shipdate as date, cast(null as string) as note, 'import' as source,
       l_shipdate as created_at, l_shipdate as updated_at
from {lineitem}
"""

# Every order line as an imported candidate; the batch is the order. Lines of one
# order repeat its total (flag N: as in the ledger, flag A: one rupee off), others do not.
CANDIDATES = """
select cast(o_orderkey as string) as batch_id,
       l_linenumber * 100000000 + cast(round(l_extendedprice * 100) as bigint) as pos,
       concat(cast(o_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
              cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
       case when l_quantity = 50 then cast(null as timestamp_ntz) else o_orderdate end as date,
       case when l_quantity = 1 then cast(null as bigint)
            when l_returnflag = 'N' then cast(round(o_totalprice * 100) as bigint)
            when l_returnflag = 'A' then cast(round(o_totalprice * 100) as bigint) + 100
            else cast(round(l_extendedprice * 100) as bigint) end as amount,
       'INR' as currency,
       case when l_tax = 0 then '  ' else concat('Order ', o_orderpriority) end as title,
       case when l_linestatus = 'O' then concat('  CUSTOMER#', lpad(cast(o_custkey as string), 9, '0'), ' ')
            when l_quantity = 2 then cast(null as string)
            else concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) end as merchant,
       case when l_discount = 0 then 'food' end as category_id,
       case when o_orderstatus = 'P' then 'income' else 'expense' end as type,
       round(1.0 - l_discount * 5, 2) as confidence,
       round(0.98 - l_tax * 4, 2) as amount_confidence,
       case when l_quantity = 2 then 0.4 else 0.9 end as merchant_confidence,
       case when l_quantity = 50 then 0.3 else 0.95 end as date_confidence,
       case when l_quantity = 50 then 'Date not detected' end as warning,
       cast(null as string) as note, 'screenshot' as source
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

MESSAGES = """
select cast(event_id as string) as sms_id,
       case event_id % 6 when 0 then 'VK-HDFCBK' when 1 then 'AD-SBIUPI' when 2 then 'AD-ICICIB'
            when 3 then 'TX-OFFERS' when 4 then 'AD-HDFCBK' else '' end as sender,
       case event_id % 6
         when 0 then concat('HDFC Bank: Rs ', amt, ' debited from a/c **4321 on ', dd, '-', mm, '-24 to SWIGGY. UPI Ref ',
              cast(382910 + event_id as string), '. Avl bal: Rs 12,345.00')
         when 1 then concat('Dear SBI User, your A/C ending 1234 credited by Rs. ', amt, ' on ', dd, '-Jan-24',
              ' by transfer from USER ', cast(user_id as string), ' / UPI-Ref 123456.')
         when 2 then concat(cast(100000 + event_id as string), ' is the OTP for your payment of Rs. ', amt, '. Do not share it.')
         when 3 then concat('Congratulations! User ', cast(user_id as string), ' you are eligible. Apply now')
         when 4 then concat('Sent Rs.', amt, chr(10), 'From HDFC Bank A/C *2711', chr(10), 'To STORE ',
              cast(user_id as string), chr(10), 'On ', dd, '/', mm, '/24', chr(10), 'Ref 129959218177')
         else concat('Paid Rs. ', amt, ' to Chai Point using UPI ref 234141. Your A/C XX7890 debited. Avl bal Rs 3,450.')
       end as body,
       ts, event_id, user_id, minor, event_type
from (select event_id, user_id, ts, event_type, cast(round(value * 100) as bigint) as minor,
             concat(cast(cast(floor(round(value * 100) / 100) as bigint) as string), '.',
                    lpad(cast(cast(round(value * 100) as bigint) % 100 as string), 2, '0')) as amt,
             lpad(cast(extract(day from ts) as string), 2, '0') as dd,
             lpad(cast(extract(month from ts) as string), 2, '0') as mm
      from {events}) e
"""

# What the messages tell, as rows that ledger and inbox may hold already, with names spelt another way.
SMS_KNOWN = """
select event_id, concat('k', sms_id) as id, concat('b', sms_id) as batch_id, minor as amount,
       case event_id % 6 when 1 then 'income' else 'expense' end as type, cast(null as string) as title,
       case event_id % 6 when 0 then ' SWIGGY ' when 1 then concat('user  ', cast(user_id as string))
            when 4 then concat('STORE ', cast(user_id as string)) else 'Chai  Point' end as merchant,
       cast(case when event_id % 6 = 5 then ts else date_trunc('day', ts) end as timestamp_ntz) as date
from {sms} where event_id % 6 not in (2, 3)
"""

# One inbox batch per order; open orders wait for review, status P is still processing.
BATCHES = """
select cast(o_orderkey as string) as id,
       case when o_orderstatus = 'P' then 'processing' when o_orderpriority = '5-LOW' then 'discarded'
            when o_orderpriority = '1-URGENT' then 'completed' when o_orderstatus = 'F' then 'failed'
            else 'readyForReview' end as status,
       o_orderdate as created_at, concat('Priority ', o_orderpriority) as source,
       concat('img_', cast(o_custkey % 50 as string), '.png') as path_a,
       concat('img_', o_orderpriority, '.png') as path_b, o_orderkey
from {orders}
"""

# Messages of few distinct bodies: one text per event type.
PROMOS = """
select cast(event_id as string) as sms_id, concat('Notice: ', event_type, case when event_id % 3 = 0 then ' ' else '' end) as body, ts
from {events}
"""

_MONEY = (
    "concat(cast(cast(floor(minor / 100) as bigint) as string), '.', lpad(cast(minor % 100 as string), 2, '0'))"
)

# Order lines numbered inside their order, with what a screen shows of them.
SHOWN = f"""
select image, rn, minor, shop, day, has_date, {_MONEY} as money from (
  select cast(l_orderkey as string) as image,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as rn,
         cast(round(l_extendedprice * 100) as bigint) as minor,
         concat('Shop ', chr(cast(65 + l_suppkey % 26 as int)), chr(cast(65 + l_partkey % 26 as int))) as shop,
         concat(cast(extract(day from l_shipdate) as string), ' September') as day,
         l_partkey % 5 <> 0 as has_date
  from {{lineitem}}) x
"""

_BOX = """0.95 as confidence, 0.95 as score, x1 as min_x, y1 as min_y, x2 as max_x, y2 as max_y,
       (x1 + x2) / 2.0 as cx, (y1 + y2) / 2.0 as cy, 900.0 as width, 1600.0 as height"""
_BOX = _BOX.replace("0.95", "cast(0.95 as double)").replace("2.0", "cast(2 as double)")
_BOX = _BOX.replace("900.0", "cast(900 as double)").replace("1600.0", "cast(1600 as double)")

# A list screen per order: name at the left, amount at the right, date below; and a receipt per order.
TOKENS = f"""
select image_id, token_no, text, text as text_normalized, {_BOX} from (
  select image as image_id, rn * 10 as token_no, shop as text, cast(50 as double) as x1, cast(200 + 90 * rn as double) as y1,
         cast(200 as double) as x2, cast(230 + 90 * rn as double) as y2 from {{shown}}
  union all select image, rn * 10 + 1, concat('₹', money), cast(700 as double), cast(200 + 90 * rn as double), cast(820 as double),
         cast(230 + 90 * rn as double) from {{shown}}
  union all select image, rn * 10 + 2, day, cast(50 as double), cast(236 + 90 * rn as double), cast(180 as double),
         cast(258 + 90 * rn as double) from {{shown}} where has_date
  union all select concat('r', cast(o_orderkey as string)), n, txt, cast(100 as double), cast(80 + 100 * n as double), cast(420 as double),
         cast(120 + 100 * n as double) from (
    select o_orderkey, 1 as n, 'Payment Successful' as txt from {{orders}}
    union all select o_orderkey, 2, concat('₹', cast(cast(round(o_totalprice) as bigint) as string)) from {{orders}}
    union all select o_orderkey, 3, concat('Paid to Store ', chr(cast(65 + o_custkey % 26 as int)), 'x') from {{orders}}
    union all select o_orderkey, 4, concat(cast(extract(day from o_orderdate) as string), ' September 2026') from {{orders}}
    union all select o_orderkey, 5, concat('Transaction ID: T', cast(100000000 + o_orderkey as string)) from {{orders}}) r) t
"""


def _piece(no: str, text: str, *box: str) -> str:
    sides = ", ".join(f"cast({side} as double) as {name}" for side, name in zip(box, ("x1", "y1", "x2", "y2"), strict=True))
    return f"struct({no} as token_no, {text} as text, {sides})"


def _line(no: int, text: str) -> str:
    return _piece(str(no), text, "100", f"80 + 100 * {no}", "420", f"120 + 100 * {no}")


# The rows of TOKENS in Spark's own SQL: each input is passed over once and order lines are not written between.
# For queries that read the tokens once, as columns that are not asked for are made all the same.
_SCREEN = [
    _piece("rn * 10", "shop", "50", "200 + 90 * rn", "200", "230 + 90 * rn"),
    _piece("rn * 10 + 1", "concat('₹', money)", "700", "200 + 90 * rn", "820", "230 + 90 * rn"),
    _piece("rn * 10 + 2", "day", "50", "236 + 90 * rn", "180", "258 + 90 * rn"),
]
_SLIP = [
    _line(1, "'Payment Successful'"),
    _line(2, "concat('₹', cast(cast(round(o_totalprice) as bigint) as string))"),
    _line(3, "concat('Paid to Store ', chr(cast(65 + o_custkey % 26 as int)), 'x')"),
    _line(4, "concat(cast(extract(day from o_orderdate) as string), ' September 2026')"),
    _line(5, "concat('Transaction ID: T', cast(100000000 + o_orderkey as string))"),
]
TOKENS_AT_ONCE = f"""
select image_id, token_no, text, text as text_normalized, {_BOX} from (
  select image as image_id, s.* from {{shown}}
    lateral view inline(if(has_date, array({", ".join(_SCREEN)}), array({", ".join(_SCREEN[:2])}))) s
  union all
  select concat('r', cast(o_orderkey as string)), s.* from {{orders}} lateral view inline(array({", ".join(_SLIP)})) s) t
"""

# No image has more tokens than the sum of its n.
TOKENS_MOST = f"""
select image as image_id, {len(_SCREEN)} as n from {{shown}}
union all select concat('r', cast(o_orderkey as string)), {len(_SLIP)} from {{orders}}
"""

# Raw detections: every token twice, the second reading weaker and a little aside, amounts misread.
DETECTIONS = """
select image_id, token_no * 2 as token_no, text, confidence, min_x, min_y, max_x, max_y, cx, cy, width, height from {tokens}
union all
select image_id, token_no * 2 + 1, replace(text, '₹', 'R'), confidence - cast(0.25 as double), min_x + 3, min_y + 2, max_x + 3, max_y + 2,
       cx + 3, cy + 2, width, height from {tokens}
"""

# Document lines: orders with an even key as rows with names and amounts on one line (the first
# wrapped), odd ones as a timeline of blocks without places.
LINES = """
select image_id, line_no, text, x1 as left, y1 as top, x2 as right, y2 as bottom,
       cast(900 as double) as width, cast(1600 as double) as height from (
  select image as image_id, rn * 10 as line_no, 'THE GRAND' as text, cast(50 as double) as x1, cast(70 * rn as double) as y1,
         cast(300 as double) as x2, cast(70 * rn + 18 as double) as y2 from {shown} where cast(image as bigint) % 2 = 0 and rn = 1
  union all select image, rn * 10 + 1, concat(shop, ' ₹', money), 50, 70 * rn + 20, 800, 70 * rn + 40 from {shown} where cast(image as bigint) % 2 = 0
  union all select image, rn * 10 + 2, day, 50, 70 * rn + 44, 200, 70 * rn + 58 from {shown} where cast(image as bigint) % 2 = 0 and has_date
  union all select image, rn * 10 + 3, 'Paid to', null, null, null, null from {shown} where cast(image as bigint) % 2 = 1
  union all select image, rn * 10 + 4, shop, null, null, null, null from {shown} where cast(image as bigint) % 2 = 1
  union all select image, rn * 10 + 5, '₹', null, null, null, null from {shown} where cast(image as bigint) % 2 = 1
  union all select image, rn * 10 + 6, money, null, null, null, null from {shown} where cast(image as bigint) % 2 = 1
  union all select image, rn * 10 + 7, concat(cast(rn as string), ' days ago'), null, null, null, null from {shown} where cast(image as bigint) % 2 = 1 and has_date
  union all select image, rn * 10 + 8, 'Debited from', null, null, null, null from {shown} where cast(image as bigint) % 2 = 1) x
"""

_DAY = "timestamp_ntz '2026-08-31 00:00:00' + cast({} as int) * interval '1' day"

# The same screens in batches of one order each; every seventh order was photographed twice.
SCREEN_TOKENS = """
select image_id, token_no, text, text_normalized, confidence, score, min_x, min_y, max_x, max_y, cx, cy, width, height from {tokens}
union all
select concat(image_id, 'x'), token_no, text, text_normalized, confidence, score, min_x, min_y, max_x, max_y, cx, cy, width, height
from {tokens} where cast(replace(image_id, 'r', '') as bigint) % 7 = 0
"""
SCREENS = """
select image_id, replace(replace(image_id, 'r', ''), 'x', '') as batch_id,
       case when image_id like 'r%' then 1 else 0 end + case when image_id like '%x' then 2 else 0 end as screen_no
from (select distinct image_id from {screen_tokens}) s
"""

# What the ledger holds of these screens: every third receipt and every second row with a date.
SCREEN_LEDGER = f"""
select id, 'expense' as type, minor as amount, 'INR' as currency, 'Seen before' as title, shop as merchant, cast(null as string) as category_id,
       date, cast(null as string) as note, 'manual' as source, date as created_at, date as updated_at from (
  select concat('r', cast(o_orderkey as string)) as id, cast(round(o_totalprice) as bigint) * 100 as minor,
         concat('  STORE   ', chr(cast(65 + o_custkey % 26 as int)), 'X ') as shop, {_DAY.format("extract(day from o_orderdate)")} as date
  from {{orders}} where o_orderkey % 3 = 0
  union all
  select concat('s', image, '-', cast(rn as string)), minor, shop, {_DAY.format("split_part(day, ' ', 1)")} from {{shown}}
  where has_date and rn % 2 = 0) l
"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ledger": (("orders",), LEDGER),
    "ledger_fine": (("events",), LEDGER_FINE),
    "ledger_big": (("lineitem",), LEDGER_BIG),
    "candidates": (("lineitem", "orders"), CANDIDATES),
    "sms": (("events",), MESSAGES),
    "sms_known": (("sms",), SMS_KNOWN),
    "batches": (("orders",), BATCHES),
    "promos": (("events",), PROMOS),
    "shown": (("lineitem",), SHOWN),
    "tokens": (("shown", "orders"), TOKENS),
    "detections": (("tokens",), DETECTIONS),
    "lines": (("shown",), LINES),
    "screen_tokens": (("tokens",), SCREEN_TOKENS),
    "screens": (("screen_tokens",), SCREENS),
    "screen_ledger": (("orders", "shown"), SCREEN_LEDGER),
}

#: Views for Spark alone; the checking SQL does not know them.
SPARK_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tokens_at_once": (("shown", "orders"), TOKENS_AT_ONCE),
    "tokens_most": (("shown", "orders"), TOKENS_MOST),
}


def view_clause(names: list[str]) -> str:
    """A WITH clause that defines the views for the checking SQL."""
    if not names:
        return ""
    parts, seen = [], set()

    def add(name: str) -> None:
        needs, text = VIEWS[name]
        for n in needs:
            if n in VIEWS and n not in seen:
                add(n)
        if name not in seen:
            seen.add(name)
            body = text.format(**{n: n for n in needs}).replace("timestamp_ntz", "timestamp")
            parts.append(f"{name} as ({body})")

    for name in names:
        add(name)
    return "with recursive " + ",\n".join(parts) + "\n"
