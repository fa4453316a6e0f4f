"""Text of recognised tokens: dates, amounts, roles, merchant scores. Patterns are fixed values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from passbook.functions.messages import minor_from_text, rolled_date
from passbook.functions.text import EDGE, END, contains_any, let, no_blanks, strip, whole_number
from passbook.functions.times import at

MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
]
_MON = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
_CLOCK = r"\d{1,2}:\d{2}(?:\s*[ap]m)?"

DATE_LABEL = (
    r"(?i)^\s*(?:"
    rf"(?:paid\s+on|debited\s+on|credited\s+on)?\s*\d{{1,2}}\s*(?:{_MON})[a-z]*(?:\s*,?\s*\d{{2,4}})?(?:\s*(?:at|,)?\s*{_CLOCK})?"
    rf"|{_CLOCK}\s+on\s+\d{{1,2}}\s*(?:{_MON})[a-z]*(?:\s*,?\s*\d{{2,4}})?"
    rf"|(?:{'|'.join(MONTH_NAMES)})\s+\d{{4}}"
    r"|\d+\s+(?:hour|hours|hr|hrs|day|days|min|mins|minute|minutes)\s+ago"
    rf"|(?:yesterday|today)(?:\s*,?\s*{_CLOCK})?"
    r")\s*$"
)

# ---- dates ---------------------------------------------------------------------------------

PURE_TIME = r"(?i)^\s*(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap]m)?\s*\??\s*$"
AGO = (
    r"(?i)^\s*\d+\s*(?:sec|secs|second|seconds|min|mins|minute|minutes|hr|hrs|hour|hours|day|days|week|weeks|month|months)"
    r"\s+ago\s*$"
)
RELATIVE = r"(?i)^\s*(today|yesterday)(?:(?:\s+at|\s*,)?\s*(\d{1,2}:\d{2}(?::\d{2})?\s*[ap]m?))?\s*$"
COMPACT = r"(?i)^\s*(\d{1,2})\s*([a-z]{3,9})\s*(\d{2,4})?\s*$"
MONTH_FIRST = r"(?i)^\s*([a-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?(?:\s*,?\s*(\d{2,4}))?\s*$"
COMPOUND = (
    r"(?i)^\s*(?:paid\s+on|debited\s+on|credited\s+on|received\s+on|transferred\s+on|on\s+)?"
    r"(\d{1,2})\s+([a-z]{3,9})(?:\s*,?\s*(\d{2,4}))?(?:(?:\s+at|\s*,)\s*(\d{1,2}:\d{2}(?::\d{2})?\s*[ap]?m?))?\s*$"
)
# All forms start with a digit or a letter, and hold a digit or one of two words.
MAY_BE_DATE = r"(?is)^(?:today|yesterday|\d|[a-z].*\d)"
NUMERIC = r"^\s*(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{1,4})\s*$"


_ABBREVIATIONS = " ".join(m[:3] for m in MONTH_NAMES)
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"


def _month_words(lenient: bool) -> str:
    """Pattern of month names: any prefix of three letters or more, and ``sept``."""
    if lenient:
        return rf"(?=(?:{_ABBREVIATIONS.replace(' ', '|')}))[a-z]{{3,9}}"
    return "(?:" + "|".join([m[:k] for m in MONTH_NAMES for k in range(len(m), 2, -1)] + ["sept"]) + ")"


def date_kind(text: Column, lenient: bool = False) -> Column:
    """Kind of a date text by pattern alone: date, time, datetime or null; see ``detect_date``."""
    month = _month_words(lenient)
    clock = r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]m)?"
    worded = (
        rf"{_DAY}\s*{month}\s*(?:\d{{2,4}})?|{month}\s+{_DAY}(?:st|nd|rd|th)?(?:\s*,?\s*\d{{2,4}})?"
        rf"|(?:paid\s+on|debited\s+on|credited\s+on|received\s+on|transferred\s+on|on\s+)?{_DAY}\s+{month}(?:\s*,?\s*\d{{2,4}})?"
    )
    stamped = (
        rf"(?:paid\s+on|debited\s+on|credited\s+on|received\s+on|transferred\s+on|on\s+)?{_DAY}\s+{month}"
        rf"(?:\s*,?\s*\d{{2,4}})?(?:\s+at|\s*,)\s*{clock}"
    )
    numeric = rf"(?:[1-9]\d{{3}}[/\-.](?:0?[1-9]|1[0-2])[/\-.]{_DAY}|{_DAY}[/\-.](?:0?[1-9]|1[0-2])[/\-.]\d{{1,4}})"

    def read(x: Column) -> Column:
        return (
            F.when(x.rlike(r"(?i)^(?:at\s+)?(?:[01]?\d|2[0-3]):[0-5]\d(?::\d{2})?\s*(?:[ap]m)?\s*\??$"), "time")
            .when(x.rlike(AGO), "datetime")
            .when(x.rlike(rf"(?i)^(?:(?:today|yesterday)(?:\s+at|\s*,)?\s*{clock}|{stamped})$"), "datetime")
            .when(x.rlike(rf"(?i)^(?:today|yesterday|{worded}|{numeric})$"), "date")
        )

    return let(strip(text), lambda v: F.when(v.rlike(MAY_BE_DATE), read(v)))


def month_of(name: Column, lenient: bool = False) -> Column:
    """Month by name; a lenient reading takes any word that starts like a month."""

    def read(low: Column) -> Column:
        at = F.instr(F.lit(_ABBREVIATIONS), F.substring(low, 1, 3))
        month = F.when((F.length(low) >= 3) & (at > 0), F.floor((at + 3) / 4).cast("int"))
        if lenient:
            return month
        whole = F.get(F.split(F.lit(" ".join(MONTH_NAMES)), " "), month - 1)
        return F.when(F.startswith(whole, low) | (low == "sept"), month)

    return let(F.lower(name), read)


def _at(day: Column, clock: Column) -> Column:
    """A day with the time of a clock text, or the bare day where there is none."""

    def part(i: int) -> Column:
        return F.coalesce(whole_number(F.regexp_extract(clock, PURE_TIME, i)), F.lit(0))

    half = F.lower(F.regexp_extract(clock, PURE_TIME, 4))
    hour = F.when((half == "pm") & (part(1) < 12), part(1) + 12).when((half == "am") & (part(1) == 12), 0).otherwise(part(1))
    shifted = day + F.make_dt_interval(F.lit(0), hour, part(2), part(3))
    return F.when(clock.rlike(PURE_TIME), shifted).otherwise(day)


def detect_date(text: Column, as_of: datetime, lenient: bool = False) -> Column:
    """``struct(kind, date, confidence, explicit_year)``; kind is date, time, datetime or null."""
    today = at(as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    now = at(as_of)

    def make(kind: str | Column, date: Column, confidence: float, year: Column | bool = False) -> Column:
        return F.struct(
            (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
            date.alias("date"),
            F.lit(confidence).alias("confidence"),
            (year if isinstance(year, Column) else F.lit(year)).alias("explicit_year"),
        )

    def group(x: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(x, pattern, i)

    def number(x: Column, pattern: str, i: int) -> Column:
        return whole_number(group(x, pattern, i))

    def year_of(given: Column) -> Column:
        return F.when(given.isNull(), F.lit(as_of.year)).when(given < 100, given + 2000).otherwise(given)

    def worded(x: Column, pattern: str, day: int, month: int, year: int, clock: int | None) -> Column:
        def dated(d: Column, m: Column, y: Column) -> Column:
            date = rolled_date(year_of(y), m, d)
            kind: Column = F.lit("date")
            if clock:
                time = group(x, pattern, clock)
                kind = F.when(time.rlike(PURE_TIME), "datetime").otherwise("date")
                date = _at(date, time)
            return F.when(m.isNotNull() & d.between(1, 31), make(kind, date, 0.95, y.isNotNull()))

        parts = F.struct(
            number(x, pattern, day).alias("d"),
            month_of(group(x, pattern, month), lenient).alias("m"),
            number(x, pattern, year).alias("y"),
        )
        return let(parts, lambda p: dated(p["d"], p["m"], p["y"]))

    def read(x: Column) -> Column:
        clock_ok = (number(x, PURE_TIME, 1) < 24) & (number(x, PURE_TIME, 2) < 60)
        base = F.when(F.lower(group(x, RELATIVE, 1)) == "yesterday", at(as_of) - F.expr("interval 1 day")).otherwise(now)
        spoken = group(x, RELATIVE, 2)
        base_day = F.to_date(base).cast("timestamp_ntz")
        relative = make(
            F.when(spoken.rlike(PURE_TIME), "datetime").otherwise("date"),
            F.when(spoken.rlike(PURE_TIME), _at(base_day, spoken)).otherwise(base),
            0.95,
        )
        p1, p2, p3 = (number(x, NUMERIC, i) for i in (1, 2, 3))
        century = F.when(p3 > 100, p3).when(p3 < 50, p3 + 2000).otherwise(p3 + 1900)
        numeric = F.when(
            (p1 > 1000) & p2.between(1, 12) & p3.between(1, 31), make("date", rolled_date(p1, p2, p3), 0.95, True)
        ).when(p1.between(1, 31) & p2.between(1, 12), make("date", rolled_date(century, p2, p1), 0.90, True))
        return F.coalesce(
            F.when(x.rlike(PURE_TIME) & clock_ok, make("time", _at(today, x), 0.95)),
            F.when(x.rlike(AGO), make("datetime", now, 0.90)),
            F.when(x.rlike(RELATIVE), relative),
            F.when(x.rlike(COMPACT), worded(x, COMPACT, 1, 2, 3, None)),
            F.when(x.rlike(MONTH_FIRST), worded(x, MONTH_FIRST, 2, 1, 3, None)),
            F.when(x.rlike(COMPOUND), worded(x, COMPOUND, 1, 2, 3, 4)),
            F.when(x.rlike(NUMERIC), numeric),
        )

    return let(strip(text), lambda v: F.when(v.rlike(MAY_BE_DATE), read(v)))


def date_confidence(text: Column) -> Column:
    """How sure a date text is: less for spans of time and for day-first numbers."""
    day_first = rf"^\s*{_DAY}[/\-.]\d{{1,2}}[/\-.]\d{{1,4}}\s*$"
    return let(text, lambda x: F.when(x.rlike(AGO) | x.rlike(day_first), 0.90).otherwise(0.95))


# ---- amounts -------------------------------------------------------------------------------

UI_LABELS = [
    "searchtransactions", "status", "paymentmethod", "date", "amount", "amo", "search", "filter", "all", "today",
    "yesterday", "coinsredeemed", "viewhistory", "payagain", "sharereceipt", "debitedfrom", "checkbalance",
    "paymentlocation", "openmaps", "upitransactionid", "transactionid", "referencenumber", "investment", "explore",
    "insurance", "history", "help", "viaupi", "receivedin", "upiintent",
]
REWARD_WORDS = ("coins", "redeemed", "youvewon", "you'vewon", "checknow")
ACCOUNT_SUFFIX = r"(?i)^(?:.*-\s*|\*{2,}|x{2,})\d{3,5}$"
MISREAD = r"[买尐￥¥尺¿?]"
PLAIN_NUMBER = r"^\s*\d{1,3}(?:,\d{2,3})*(?:\.\d{1,2})?\s*$|^\s*\d+(?:\.\d{1,2})?\s*$"
SIGNED_MISREAD = r"^[+-]?\s*[#＃Rr买尐￥¥尺]\s*\d"


def repair_symbol(text: Column, leading_seven: bool = False) -> Column:
    """Misread rupee signs before digits put right; with ``leading_seven`` a leading 7 counts as one, too."""

    def repaired(x: Column) -> Column:
        s = F.regexp_replace(x, r"^([+-]?)\s*(?:(?i:rs\.?|inr)|[Rr#＃买尐￥¥尺?¿*])\s*(\d)", "$1 ₹$2")
        s = F.regexp_replace(s, rf"^([+-]?)\s*[zZFf]\s*(\d{{1,3}}(?:,\d{{2,3}})*(?:\.\d{{1,2}})?){END}", "$1 ₹$2")
        if leading_seven:
            s = F.regexp_replace(s, rf"^([+-]?)\s*7(\d{{1,2}},\d{{3}}(?:\.\d{{1,2}})?|\d{{2,4}}(?:\.\d{{1,2}})?){END}", "$1 ₹$2")
        s = F.regexp_replace(strip(s), r"₹\s+(\d)", "₹$1")
        return F.regexp_replace(s, r"^([+-])\s*₹", "$1 ₹")

    # What none of the replacements can start on stays as it is: one test for most texts.
    seven = "7" if leading_seven else ""
    starts = rf"^[+-]?\s*(?:(?i:rs\.?|inr)|[Rr#＃买尐￥¥尺?¿*zZFf{seven}])\s*\d|₹\s+\d|^[+-]\s*₹"
    return let(strip(text), lambda x: F.when(x.rlike(starts), repaired(x)).otherwise(x))


def bare_number(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^[₹#＃+\-\s]+", ""))


def classify_amount(
    text: Column, date_kind: Column, min_x: Column, cx: Column, cy: Column, width: Column, height: Column, leading_seven: bool = False
) -> Column:
    """``struct(is_amount, minor, normalized, reason, has_currency, right_aligned)`` of a token.

    ``date_kind`` is the kind found by ``detect_date``: dates are settled before amounts.
    """

    def result(minor: Column, normalized: Column, reason: Column, currency: Column, right: Column) -> Column:
        ok = reason.isNull()
        return F.struct(
            ok.alias("is_amount"),
            F.when(ok, minor).alias("minor"),
            normalized.alias("normalized"),
            reason.alias("reason"),
            (ok & currency).alias("has_currency"),
            right.alias("right_aligned"),
        )

    def read(s: Column, n: Column, bare: Column, date_kind: Column, label: Column, minor: Column) -> Column:
        lower = F.lower(s)
        digits = F.length(F.regexp_replace(s, r"[^0-9]+", ""))
        letters = F.length(F.regexp_replace(s, r"[^A-Za-z]+", ""))
        currency = s.contains("₹") | n.contains("₹") | s.rlike(SIGNED_MISREAD) | F.startswith(lower, F.lit("rs"))
        right = F.coalesce(F.when(width > 0, (min_x / width >= 0.40) | (cx / width >= 0.45)), F.lit(True))
        in_bar = F.coalesce((height > 0) & (cy < height * 0.09), F.lit(False))
        reason = (
            F.when(s == "", "empty text")
            .when(date_kind.isNotNull(), F.when(date_kind != "date", "time_pattern").otherwise("date_label_pattern"))
            .when(label.isin(UI_LABELS), "ui_label")
            .when(s.contains("@"), "vpa_handle")
            .when(contains_any(label, REWARD_WORDS), "reward_points_count")
            .when(s.rlike(ACCOUNT_SUFFIX), "bank_account_suffix")
            .when(s.rlike(rf"[^\u0000-\u007F₹{MISREAD[1:]}"), "non_ascii_garbage")
            .when(s.rlike("[0-9]") & s.rlike("[A-Za-z]") & let(letters, lambda k: (k >= 2) & (k > digits)), "alpha_dominant_token")
            .when(~bare.rlike(PLAIN_NUMBER), "no_valid_number")
            .when(F.coalesce(minor, F.lit(0)) <= 0, "zero_or_negative_amount")
            .when(~currency & in_bar, "status_bar_element")
            .when(~currency & (F.length(F.regexp_replace(bare, r"[^0-9]", "")) >= 7), "unformatted_large_identifier")
            .when(~currency & bare.rlike(r"^0\d+"), "leading_zero_identifier")
            .when(~currency & bare.rlike(r"^20[2-3]\d$"), "calendar_year_number")
            .when(~currency & ~n.rlike("^[+-]") & ~right & (F.length(bare) == 1), "single_digit_left_aligned")
        )
        return let(reason, lambda r: result(minor, n, r, n.contains("₹") | F.startswith(s, F.lit("R")), right))

    # Each step is worked out once; what the reason and the result share comes in by name.
    def with_number(s: Column, n: Column, b: Column) -> Column:
        return let(date_kind, lambda d: let(no_blanks(s), lambda lab: let(minor_from_text(b), lambda m: read(s, n, b, d, lab, m))))

    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda s: let(repair_symbol(s, leading_seven), lambda n: let(bare_number(n), lambda b: with_number(s, n, b))),
    )


#: A sign and digits and nothing else: no other kind of text starts with a rupee sign.
SIGNED_NUMBER = r"^[+-]? ?₹ ?(?:\d{1,3}(?:,\d{2,3})*|\d+)(?:\.\d{1,2})?\z"


def read_amount(
    text: Column, min_x: Column, cx: Column, cy: Column, width: Column, height: Column, leading_seven: bool = False
) -> Column:
    """``struct(is_amount, minor, has_currency)`` of a token: the same fields as ``classify_amount`` gives.

    A text without a digit is none and a rupee sign before a number is one, wherever it stands; only what is
    neither is tested by all rules.
    """

    def fields(ok: Column, minor: Column, currency: Column) -> Column:
        return F.struct(ok.alias("is_amount"), minor.alias("minor"), currency.alias("has_currency"))

    def signed(minor: Column) -> Column:
        ok = F.coalesce(minor > 0, F.lit(False))
        return fields(ok, F.when(ok, minor), ok)

    def tested(s: Column) -> Column:
        found = classify_amount(s, date_kind(s), min_x, cx, cy, width, height, leading_seven)
        return let(found, lambda a: fields(a["is_amount"], a["minor"], a["has_currency"]))

    none = fields(F.lit(False), F.lit(None).cast("long"), F.lit(False))
    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda s: F.when(~s.rlike("[0-9]"), none)
        .when(s.rlike(SIGNED_NUMBER), let(minor_from_text(bare_number(s)), signed))
        .otherwise(tested(s)),
    )


def candidate_score(text: Column, confidence: Column, leading_seven: bool = False) -> Column:
    """Rank of one reading among others of the same region."""
    n = repair_symbol(text, leading_seven)
    number = strip(F.regexp_replace(n, r"(?i)^[₹$+\-\s]+|[₹$]|inr|rs\.?", ""))
    marked = text.contains("₹") | text.contains("Rs") | text.contains("INR")
    foreign = F.regexp_replace(text, "[买尐￥¥尺]", "").rlike("[一-鿿]")
    odd = (F.length(text) == 1) & ~text.rlike("[0-9₹]")
    zero = F.lit(0.0)
    return F.round(
        confidence
        + F.when(marked, 0.40).when(n.contains("₹"), 0.25).otherwise(zero)
        + F.when(number.rlike(r"^\d{1,3}(,\d{2,3})*(\.\d{2})?$"), 0.30).otherwise(zero)
        + F.when(number.rlike(r"\d{1,2},\d{3}"), 0.15).otherwise(zero)
        - F.when(foreign, 0.50).otherwise(zero)
        - F.when(odd, 0.20).otherwise(zero),
        4,
    )


# ---- names and directions --------------------------------------------------------------------

PREFIX_WORDS = ("paid to", "payment to", "received from", "sent to", "transfer to", "paid", "to", "from")


def clean_prefix(text: Column) -> Column:
    """Direction words and a doubled avatar initial off the front; a bare direction gives ''."""

    def cut(s: Column) -> Column:
        rest = F.regexp_replace(
            s, r"(?i)^(?:Paid to|Payment to|Received from|Sent to|Transfer to|Paid|To:?|From:?)\s+", ""
        )
        rest = F.regexp_replace(rest, r"(?i)^([a-z])\s+(?=\1)", "")
        return F.when(F.lower(s).isin(list(PREFIX_WORDS)), "").otherwise(strip(rest))

    return let(strip(text), cut)


INCOME_WORDS = ("received", "credited", "refund", "cashback")


def row_direction(amount_text: Column, merchant: Column) -> Column:
    """A plus sign, then income words in the merchant text, else an expense."""
    return F.when(
        amount_text.contains("+") | contains_any(F.coalesce(F.lower(merchant), F.lit("")), INCOME_WORDS), "income"
    ).otherwise("expense")


# ---- roles ---------------------------------------------------------------------------------

BATTERY = r"^\s*\d{1,3}%\s*$"
NETWORK = r"(?i)^\s*(?:[·•*\-~]*\s*(?:5g|4g|3g|lte|volte|wifi|三)[·•*\-~]*\s*)+$"
HANDLE = r"^[a-zA-Z0-9.\-_]{2,}@[a-zA-Z0-9]{2,}$"
PHONE = r"^\s*(?:\+91[\-\s]?)?[6-9]\d{9}\s*$"
REFERENCE_ID = (
    r"(?i)(?:upi\s*transaction\s*id|utr|rrn|txn\s*id|transaction\s*id|ref\s*(?:no|id)|order\s*id|google\s*transaction\s*id)"
    r"\s*[:\-\s]*([0-9a-zA-Z]{6,36})"
)
#: Without blanks, every text that REFERENCE_ID fits holds one of these.
REFERENCE_MARKS = ("id", "ref", "utr", "rrn")
BANK_ACCOUNT = r"(?i)(?:a/c|acct|account|bank\s*account|\*{2,}|x{2,}|(?<![A-Za-z0-9_])xx)\s*(?:no\.?|number)?\s*[:\-\s]*(\d{3,6})"
STATUS = (
    r"(?i)^\s*(?:payment|transaction|transfer|paid)?\s*(?:successful|successfully|completed|success|failed|declined|pending|"
    r"processing)\s*$"
)
HEADER = r"(?i)^\s*(?:payment\s+details|transaction\s+details|transfer\s+details|bill\s+details|receipt\s+details|summary)\s*$"
PERSON = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+$"
ENTITY_TERMS = (
    "store|cafe|petrol|pump|mart|shop|tech|solutions|service|services|hospital|clinic|bakery|restaurant|dhaba|tea|chai"
)
NAVIGATION_WORDS = [
    "back", "home", "settings", "help", "close", "menu", "search", "filter", "all", "share", "done", "openmaps",
    "payagain", "sharereceipt", "checkbalance", "viewhistory", "history", "explore", "searchtransactions",
]
PROMOTION_WORDS = [
    "cashback", "reward", "rewards", "points", "coins", "coin", "scratchcard", "youvewon", "you'vewon", "checknow",
    "redeemed", "discount", "coupon", "offer", "offers",
]
DIRECTION_STARTS = (
    "paidto|paymentto|sentto|transferredto|debitedfrom|paidvia|receivedfrom|receivedin|creditedto"
)
DIRECTION_WORDS = ("debited", "spent", "paid", "credited", "received", "refund")


def role_scores(text: Column, norm: Column, date_kind: Column, date_confidence: Column, amount: Column, cy: Column, height: Column) -> Column:
    """Roles a token may play, as a map from role to score.

    Decisive tests come first and give one role; what remains may have several.
    """

    def one(*pairs: tuple[str, float | Column]) -> Column:
        flat = []
        for role, score in pairs:
            flat += [F.lit(role), score if isinstance(score, Column) else F.lit(score)]
        return F.create_map(*flat)

    def entry(test: Column, role: str, score: float | Column) -> Column:
        value = score if isinstance(score, Column) else F.lit(score)
        return F.when(test, F.struct(F.lit(role).alias("key"), value.alias("value")))

    def read(raw: Column, n: Column, label: Column) -> Column:
        lower = F.lower(n)
        digits = F.length(F.regexp_replace(n, r"[^0-9]", ""))
        letters = F.length(F.regexp_replace(n, r"[^A-Za-z]", ""))
        in_bar = F.coalesce((height > 0) & (cy < height * 0.06), F.lit(False)) & (F.length(raw) <= 8) & ~raw.contains("₹")
        direction = (
            F.when(label.rlike(f"^(?:{DIRECTION_STARTS})") | label.isin(list(DIRECTION_WORDS)) | label.contains("cashbackreceived"), 0.95)
            .when(label.isin("to", "from"), 0.80)
        )
        merchant = F.when(
            (F.length(n) >= 2) & (letters > 0) & ~((digits > letters) & (digits >= 4)),
            F.least(
                F.lit(1.0),
                F.lit(0.70)
                + F.when(n.rlike("^[A-Z0-9]"), 0.15).otherwise(0.0)
                + F.when(n.rlike(rf"(?i){EDGE}(?:{ENTITY_TERMS}){END}"), 0.15).otherwise(0.0),
            ),
        )
        bare_id = (F.length(label) >= 9) & label.rlike(r"^\d+$")
        fee = lower.contains("fee") | lower.contains("tax") | lower.contains("discount")
        primary = F.least(
            F.lit(1.0),
            F.lit(0.80)
            + F.when(amount["has_currency"], 0.15).otherwise(0.0)
            + F.when(n.contains(",") | n.contains("."), 0.05).otherwise(0.0),
        )

        def several(p: Column) -> Column:
            roles = F.array_compact(
                F.array(
                    entry(in_bar, "SYSTEM_CHROME", 0.85),
                    entry(p["d"].isNotNull(), "DIRECTION_SIGNAL", p["d"]),
                    entry(p["m"].isNotNull(), "MERCHANT_CANDIDATE", p["m"]),
                    entry(p["m"].isNotNull() & n.rlike(PERSON), "PERSON_CANDIDATE", p["m"]),
                )
            )
            return let(roles, lambda v: F.when(F.size(v) > 0, F.map_from_entries(v)).otherwise(one(("UNKNOWN", 0.50))))

        rest = let(F.struct(direction.alias("d"), merchant.alias("m")), several)
        bar = F.array_compact(F.array(entry(in_bar, "SYSTEM_CHROME", 0.85)))
        signs = F.array_compact(
            F.array(
                entry(in_bar, "SYSTEM_CHROME", 0.85), entry(direction.isNotNull(), "DIRECTION_SIGNAL", direction)
            )
        )

        def after(known: Column, *pairs: tuple[str, float | Column]) -> Column:
            return F.map_concat(F.map_from_entries(known), one(*pairs))

        promotion = contains_any(label, PROMOTION_WORDS)
        balance = label.contains("balance")
        time_in_bar = F.coalesce((height > 0) & (cy < height * 0.08), F.lit(False))
        # Of a sign and digits no other rule speaks; what holds no digit is no number or account, and ids have a name.
        signed = amount["is_amount"] & (raw == n) & n.rlike(SIGNED_NUMBER)
        numbered = n.rlike("[0-9]")
        named = contains_any(label, REFERENCE_MARKS)
        return (
            F.when((raw == "") & (n == ""), one(("UNKNOWN", 1.0)))
            .when(date_kind == "datetime", one(("DATETIME", date_confidence)))
            .when((date_kind == "time") & time_in_bar, one(("TIME", date_confidence), ("SYSTEM_CHROME", 0.90)))
            .when(date_kind == "time", one(("TIME", date_confidence)))
            .when(date_kind == "date", one(("DATE", date_confidence)))
            .when(signed, one(("AMOUNT_PRIMARY", primary)))
            .when(raw.rlike(BATTERY) | raw.rlike(NETWORK) | raw.contains("5G"), one(("SYSTEM_CHROME", 0.95)))
            .when(label.isin(NAVIGATION_WORDS), after(bar, ("NAVIGATION", 0.95)))
            .when(n.rlike(STATUS), after(bar, ("STATUS", 0.98)))
            .when(n.rlike(HEADER) | label.isin("paymentdetails", "transactiondetails"), after(bar, ("HEADER", 0.95)))
            .when(named & (n.rlike(REFERENCE_ID) | label.contains("transactionid")), after(signs, ("TRANSACTION_REFERENCE", 0.98)))
            .when(n.contains("@") & (label.rlike(HANDLE) | (F.length(n) >= 5)), after(signs, ("TRANSACTION_REFERENCE", 0.92)))
            .when(numbered & n.rlike(PHONE), after(signs, ("TRANSACTION_REFERENCE", 0.70)))
            .when(numbered & bare_id, after(signs, ("TRANSACTION_REFERENCE", 0.95)))
            .when(numbered & (n.rlike(BANK_ACCOUNT) | n.rlike(ACCOUNT_SUFFIX)), after(signs, ("ACCOUNT_NUMBER", 0.95)))
            .when(
                promotion,
                F.when(balance, after(signs, ("REWARD", 0.90), ("PROMOTION", 0.85), ("BALANCE", 0.95))).otherwise(
                    after(signs, ("REWARD", 0.90), ("PROMOTION", 0.85))
                ),
            )
            .when(balance | F.startswith(label, F.lit("availbal")), after(signs, ("BALANCE", 0.95)))
            .when(amount["is_amount"] & fee, after(signs, ("AMOUNT_SECONDARY", 0.85)))
            .when(amount["is_amount"], after(signs, ("AMOUNT_PRIMARY", primary)))
            .otherwise(rest)
        )

    return let(strip(text), lambda r: let(strip(norm), lambda n: let(no_blanks(n), lambda lab: read(r, n, lab))))


def top_role(scores: Column) -> Column:
    """Role with the highest score; the one listed first wins ties."""

    def best(entries: Column) -> Column:
        top = F.array_max(F.map_values(scores))
        return let(top, lambda b: F.try_element_at(F.filter(entries, lambda e: e["value"] == b), F.lit(1))["key"])

    return F.when(F.size(scores) == 1, F.get(F.map_keys(scores), F.lit(0))).otherwise(best(F.map_entries(scores)))


# ---- merchant scores -------------------------------------------------------------------------

MERCHANT_PREFIX = (
    r"(?i)^(?:paid\s+to|payment\s+to|sent\s+to|transferred\s+to|received\s+from|from|to|merchant\s*:?|beneficiary\s*:?|"
    r"payee\s*:?)\s+"
)
BANKING = (
    rf"(?i){EDGE}(?:(?:debited\s+from|credited\s+to|savings\s+account|bank|a/c|account|xx\d{{2,4}}|upi\s*id|vpa|"
    rf"google\s*transaction\s*id|utr|rrn){END})"
)
SYSTEM_TEXT = (
    rf"(?i){EDGE}(?:payment\s+successful|paid\s+successfully|transaction\s+successful|completed|failed|view\s+history|history|"
    rf"home|search|filter|share|pay\s+again|open\s+maps|check\s+balance){END}"
)
NOT_MERCHANT_ROLES = (
    "AMOUNT_PRIMARY",
    "AMOUNT_SECONDARY",
    "DATE",
    "TIME",
    "DATETIME",
    "SYSTEM_CHROME",
    "NAVIGATION",
    "STATUS",
    "HEADER",
    "TRANSACTION_REFERENCE",
    "ACCOUNT_NUMBER",
)


def merchant_name(norm: Column) -> Column:
    return strip(F.regexp_replace(strip(norm), MERCHANT_PREFIX, ""))


def may_be_merchant(role: Column, norm: Column) -> Column:
    def test(t: Column) -> Column:
        return (F.length(t) >= 2) & ~t.contains("@") & ~t.rlike(BANKING) & ~t.rlike(SYSTEM_TEXT)

    return ~role.isin(list(NOT_MERCHANT_ROLES)) & let(strip(norm), test)


def merchant_score(name: Column, cy: Column, amount_cy: Column, anchor_cy: Column, confidence: Column) -> Column:
    """Shape, length and place of a name, clamped to 0..1; null for an empty name."""

    def score(t: Column) -> Column:
        digits = F.length(F.regexp_replace(t, r"[^0-9]", ""))
        letters = F.length(F.regexp_replace(t, r"[^A-Za-z]", ""))
        away = F.abs(cy - amount_cy)
        zero = F.lit(0.0)
        total = (
            F.lit(0.50)
            + F.when(letters >= 2, 0.20).otherwise(zero)
            + F.when(t.rlike("^[A-Z]"), 0.15).otherwise(zero)
            + F.when(t.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"), 0.10).otherwise(zero)
            + F.when(digits > 0, F.when(letters >= digits, 0.05).otherwise(-0.30)).otherwise(zero)
            + F.when(F.length(t).between(3, 35), 0.10).when(F.length(t) > 50, -0.20).otherwise(zero)
            + F.when(away < 60, 0.15).when(away < 120, 0.05).otherwise(-0.10)
            + F.when((cy - anchor_cy >= 0) & (cy - anchor_cy < 120), 0.25).otherwise(zero)
            + confidence * 0.10
        )
        return F.when(t != "", F.least(F.lit(1.0), F.greatest(zero, total)))

    return let(name, score)
