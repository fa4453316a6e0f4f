"""Fields of bank and payment messages as column expressions.

Each function takes and returns a Column; ``operators.messages`` applies them to
a whole table or stream. Patterns are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from passbook.fixed_values import (
    BODY_BANK_WORDS,
    LIKELY_ACTIONS,
    LIKELY_MARKS,
    LIKELY_OTP,
    OTP_PHRASES,
    PROMOTION_PHRASES,
    SENDER_CODES,
)
from passbook.functions.text import EDGE, END, contains_any, first_value, let, strip, whole_number

# ---- fixed patterns ------------------------------------------------------------------------

DEBIT_WORDS = (
    "debited|debit|spent|paid|sent|withdrawn|charged|deducted|purchase of|txn of|transferred to|deducted from|"
    "payment of|transfer of|auto-debited|swiped at|used at|purchase at|cleared"
)
CREDIT_WORDS = (
    "credited|credit|received|deposited|refunded|refund|cashback|added to|transferred from|received from|salary|"
    "reversed|reversal|credited with|credited by"
)
NUMBER = r"([\d,]+(?:\.\d{1,2})?)"
MARK = r"(?:Rs\.?|INR|₹)"
BALANCE_TAG = r"((?:bal |bal: |bal\.|balance |balance: |limit |limit: )?)"
MARKED_AMOUNT = rf"(?i){BALANCE_TAG}{MARK}\s*{NUMBER}"
VERB_AMOUNT = rf"(?i){EDGE}(?:debited|credited|spent|paid|for)\s+(?:by|of|for)?\s*{MARK}?\s*{NUMBER}"

DISCLAIMER = (
    rf"(?is){EDGE}(?:if not (?:done )?by (?:you|u)|not you\??|if not you|to block(?: your)?|to report|"
    rf"forward (?:this )?sms|call \d{{4,}}|sms block{END}).*"
)
ACCOUNT = r"(?i)(?:a/c|acct|acc|account|card|card ending)\s*(?:no\.?)?\s*(?:ending\s*)?([xX*]*\d{3,4})"
REFERENCE = (
    rf"(?i){EDGE}(?:ref(?:\s+no\.?|\s+id)?|txn(?:\s+id|\s+no\.?)?|rrn)\s*[:.]?\s*([A-Za-z0-9]{{6,20}}){END}"
)

NAME = r"([A-Za-z0-9\s.@\-_&]+?)"
SNIPPET = r"([A-Za-z0-9\s.@\-_&*/]+?)"
STOP_WORDS = "ref|avl|avail|bal|balance|upi|and|for|with|dated|through|not|if|call|block|help|query|desc|msg|message"


def _stop(first: str = "", marks: str = r"[/.,;:?!]") -> str:
    """What ends a name: a joining word after a blank, a mark, or the end."""
    lead = f"{first}|" if first else ""
    return rf"(?:\s+(?:(?:{lead}using|via){END}|on\s+\d|(?:{STOP_WORDS}){END})|{marks}|$)"


PAID_TO = rf"(?i){EDGE}(?:to|at|info:|towards|transfer to|paid to|vpa|swiped at|used at|purchase at|at pos)\s+{NAME}{_stop()}"
GOT_FROM = (
    rf"(?i){EDGE}(?:from|received from|transferred by|remitted by|by transfer from|refund from|cashback from|"
    rf"deposited by)\s+{NAME}{_stop()}"
)
GOT_BY = rf"(?i){EDGE}by\s+{NAME}{_stop()}"
UPI_PATH = r"UPI[/-][A-Za-z0-9]+/([A-Za-z0-9\s\-_]+)"
PAID_TO_LINE = r"(?i)^(?:to|paid to|towards|vpa)[:\s-]+\s*([A-Za-z0-9\s.@\-_&]+)$"
GOT_FROM_LINE = r"(?i)^(?:from|by|received from|sender)[:\s-]+\s*([A-Za-z0-9\s.@\-_&]+)$"

FROM_LINE = r"(?i)^(?:from|received from|debited from|sent from)[:\s-]+\s*(.+)$"
TO_LINE = r"(?i)^(?:to|paid to|transferred to|credited to|towards)[:\s-]+\s*(.+)$"
FROM_INLINE = (
    rf"(?i){EDGE}(?:debited from|sent from|received from|transferred from|transfer from|from)\s+"
    rf"{SNIPPET}{_stop('to', r'[.,;:?!]')}"
)
TO_INLINE = (
    rf"(?i){EDGE}(?:paid to|transferred to|credited to|towards|transfer to|to|at)\s+{SNIPPET}{_stop('from')}"
)

NAME_PREFIX = r"(?i)^(?:to|paid to|towards|vpa\s+|info:\s*|transfer\s+from\s*|from\s*)"
SNIPPET_PREFIX = (
    r"(?i)^(?:to|paid to|transferred to|towards|transfer to|from|received from|debited from|sent from)\s*[:\s-]*\s*"
)
JOINING = r"(?is)\s+(?:and|for|with|dated|through|bal|balance|msg|message)\s+.*$"
OWN_ACCOUNT_PHRASES = (
    "card ending",
    "account ending",
    "a/c ending",
    "acct ending",
    "your card",
    "your account",
    "your a/c",
)
OWN_ACCOUNT_WORDS = ("card", "account", "a/c", "acct")
DISCLAIMER_PHRASES = ("block", "dispute", "report", "not you", "call ", "sms ")
GENERIC_WORDS = [
    "your", "account", "bank", "the", "rs", "inr", "ref", "avl", "bal", "credit", "debit", "card", "upi", "transfer",
    "via", "using", "no", "neft", "imps", "rtgs", "cash", "atm", "pos", "branch", "limit", "message",
]
SNIPPET_REJECTS = ("block", "call ", "report", "fraud", "not you", "if not")

NUMERIC_DATE = r"(?<![A-Za-z0-9_])(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})(?![A-Za-z0-9_])"
NAMED_DATE = r"(?<![A-Za-z0-9_])(\d{1,2})[-/\s]([A-Za-z]{3})[-/\s](\d{2,4})(?![A-Za-z0-9_])"
MONTHS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]


# ---- filters -------------------------------------------------------------------------------


def is_spam(text: Column, sender: Column, excluded: Iterable[str] = ()) -> Column:
    """One-time passwords, promotions, and the user's own keywords; all plain substrings."""
    own = [w.strip().lower() for w in excluded if w.strip()]
    found = contains_any(F.lower(text), [*OTP_PHRASES, *_minimal(PROMOTION_PHRASES), *own])
    return found | contains_any(F.coalesce(F.lower(sender), F.lit("")), own) if own else found


def _minimal(phrases: Iterable[str]) -> list[str]:
    """Phrases without those that contain a shorter one of the list; the test is the same."""
    listed = list(phrases)
    return [p for p in listed if not any(q != p and q in p for q in listed)]


def is_likely(body: Column) -> Column:
    """Cheap prefilter: an action word, a currency mark, no one-time password."""

    def test(x: Column) -> Column:
        return contains_any(x, LIKELY_ACTIONS) & contains_any(x, LIKELY_MARKS) & ~contains_any(x, LIKELY_OTP)

    return let(F.lower(body), test)


# ---- amount, direction, bank, references ------------------------------------------------------


def minor_from_text(x: Column) -> Column:
    """Digits with commas and up to two decimals, as integer minor units; no double on the way."""

    def parts(clean: Column) -> Column:
        cents = F.substring(F.split_part(clean, F.lit("."), F.lit(2)), 1, 2)
        digits = F.concat(F.split_part(clean, F.lit("."), F.lit(1)), F.rpad(cents, 2, "0"))
        # What holds a letter, or more after a blank, is no number: the cast would fail, which is slow.
        return F.when(clean.rlike(r"^\d"), let(digits, lambda d: F.when(~d.rlike(r"[A-Za-z]|\s[^\s\p{Cntrl}]"), d.try_cast("long"))))

    return let(F.replace(x, F.lit(","), F.lit("")), parts)


def direction(text: Column) -> Column:
    """Debit or credit words; with both, the earlier one decides."""

    def first(word: Column) -> Column:
        return F.when(word.rlike(rf"(?i)^(?:{DEBIT_WORDS})$"), "expense").when(word != "", "income")

    return let(F.regexp_extract(text, rf"(?i){EDGE}(?:{DEBIT_WORDS}|{CREDIT_WORDS}){END}", 0), first)


def amount(text: Column) -> Column:
    """The first marked amount that is not a balance or limit; else after a verb."""

    def pick(x: Column) -> Column:
        tags = F.regexp_extract_all(x, F.lit(MARKED_AMOUNT), F.lit(1))
        values = F.transform(F.regexp_extract_all(x, F.lit(MARKED_AMOUNT), F.lit(2)), minor_from_text)
        return F.when(x.rlike(rf"(?i){MARK}\s*[\d,]"), let(values, lambda v: usable(tags, v))).otherwise(
            minor_from_text(F.regexp_extract(x, VERB_AMOUNT, 1))
        )

    def usable(tags: Column, values: Column) -> Column:
        spent = F.zip_with(tags, values, lambda tag, v: F.when((tag == "") & (v > 0), v))
        return F.coalesce(first_value(spent), F.try_element_at(values, F.lit(1)))

    return let(text, pick)


def bank_name(text: Column, sender: Column) -> Column:
    """By sender code, else by a name in the text, else ``Bank``."""

    def first(x: Column, table: dict[str, str]) -> Column:
        rows = F.array(*[F.struct(F.lit(k).alias("mark"), F.lit(v).alias("bank")) for k, v in table.items()])
        hit = F.filter(rows, lambda r: F.contains(x, r["mark"]))
        return F.try_element_at(hit, F.lit(1))["bank"]

    code = F.upper(F.regexp_replace(F.coalesce(sender, F.lit("")), "^[A-Za-z]{2}-", ""))
    by_code = let(code, lambda x: first(x, SENDER_CODES))
    by_text = let(F.lower(text), lambda x: first(x, BODY_BANK_WORDS))
    return F.coalesce(by_code, by_text, F.lit("Bank"))


def account_ref(text: Column) -> Column:
    """Last digits of an account or card; a match always holds digits."""
    digits = F.regexp_replace(F.regexp_extract(text, ACCOUNT, 1), "[xX*]", "")
    return F.concat(F.lit("A/C **"), F.nullif(digits, F.lit("")))


def reference_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, REFERENCE, 1), F.lit(""))


def strip_disclaimer(text: Column) -> Column:
    """Cuts security notes and helpline numbers to the end."""
    return strip(F.regexp_replace(text, DISCLAIMER, ""))


# ---- names ---------------------------------------------------------------------------------


def capitalise(x: Column) -> Column:
    """First letter up, rest down; short words already in capitals stay."""

    def one(w: Column) -> Column:
        acronym = (F.length(w) <= 3) & (w == F.upper(w))
        return F.when(acronym, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    return F.array_join(F.transform(F.split(x, " "), one), " ")


def _before_slash(x: Column) -> Column:
    """Text before a spaced slash, or before any slash unless it names an account."""

    def cut(c: Column) -> Column:
        account = c.rlike(rf"(?i){EDGE}a/c{END}")
        return (
            F.when(c.contains(" / "), strip(F.regexp_replace(c, r"(?s) / .*$", "")))
            .when(c.contains("/") & ~account, strip(F.regexp_replace(c, r"(?s)/.*$", "")))
            .otherwise(c)
        )

    return let(x, cut)


def _four_words(x: Column) -> Column:
    def cut(words: Column) -> Column:
        return F.array_join(F.slice(words, 1, 4), " ")

    return let(x, lambda c: let(F.split(c, r"\s+"), lambda w: F.when(F.size(w) > 4, cut(w)).otherwise(c)))


_PUNCTUATION = "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$"


def clean_merchant(raw: Column) -> Column:
    """A payee name, or null where the text is no name."""
    c = _before_slash(strip(raw))
    c = F.regexp_replace(c, NAME_PREFIX, "")
    c = strip(F.regexp_replace(c, JOINING, ""))
    c = strip(F.regexp_replace(c, rf"(?i)\s+(?:using|via|on|ref){END}", ""))
    c = F.regexp_replace(c, "(?s)@.*$", "")
    c = strip(F.regexp_replace(c, _PUNCTUATION, ""))

    def judge(name: Column) -> Column:
        lower = F.lower(name)
        rejected = (
            (F.length(name) < 2)
            | contains_any(lower, OWN_ACCOUNT_PHRASES)
            | lower.isin(list(OWN_ACCOUNT_WORDS))
            | contains_any(lower, DISCLAIMER_PHRASES)
            | lower.isin(GENERIC_WORDS)
        )
        return F.when(~rejected, capitalise(name))

    return let(_four_words(c), judge)


def clean_snippet(raw: Column) -> Column:
    """From or to text; keeps account names, at most 50 characters."""
    c = strip_disclaimer(strip(raw))
    c = strip(F.regexp_replace(c, SNIPPET_PREFIX, ""))
    c = strip(F.regexp_replace(c, JOINING, ""))
    c = strip(
        F.regexp_replace(
            c, rf"(?i)\s+(?:on\s+\d|(?:ref|avl|avail|bal){END}|upi\s+ref|(?:using|via|credited|debited){END}).*$", ""
        )
    )
    c = F.regexp_replace(c, rf"(?i){EDGE}a/c{END}", "A/C")
    c = strip(F.regexp_replace(c, r"(?i)\s*/\s*(?:upi|ref|rrn|txn|imp|neft).*$", ""))
    c = strip(F.regexp_replace(_before_slash(c), _PUNCTUATION, ""))
    c = let(c, lambda x: F.when(x.rlike(rf"(?i){EDGE}a/c{END}"), x).otherwise(_four_words(x)))

    def judge(x: Column) -> Column:
        lower = F.lower(x)
        rejected = (
            (F.length(x) < 2) | contains_any(lower, SNIPPET_REJECTS) | lower.isin("card", "account", "a/c")
        )
        return F.when(~rejected, F.when(F.length(x) > 50, strip(F.substring(x, 1, 50))).otherwise(x))

    return let(c, judge)


def message_lines(body: Column) -> Column:
    """Lines without disclaimers, empty ones left out."""
    return F.filter(F.transform(F.split(body, r"\r?\n"), strip_disclaimer), lambda x: x != "")


def _from_lines(lines: Column, pattern: str, clean) -> Column:
    hits = F.filter(lines, lambda x: x.rlike(pattern))
    return first_value(F.transform(hits, lambda x: clean(F.regexp_extract(x, pattern, 1))))


def _inline(text: Column, pattern: str, clean) -> Column:
    """First of all inline matches that survives cleaning."""
    return first_value(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), clean))


def _inline_first(text: Column, pattern: str, clean) -> Column:
    return clean(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def from_snippet(lines: Column, text: Column) -> Column:
    return F.coalesce(_from_lines(lines, FROM_LINE, clean_snippet), _inline_first(text, FROM_INLINE, clean_snippet))


def to_snippet(lines: Column, text: Column) -> Column:
    return F.coalesce(_from_lines(lines, TO_LINE, clean_snippet), _inline_first(text, TO_INLINE, clean_snippet))


def merchant(kind: Column, lines: Column, text: Column) -> Column:
    """Line form, then inline forms by direction, then the UPI path form."""
    paid = F.coalesce(_from_lines(lines, PAID_TO_LINE, clean_merchant), _inline(text, PAID_TO, clean_merchant))
    got = F.coalesce(
        _from_lines(lines, GOT_FROM_LINE, clean_merchant),
        _inline(text, GOT_FROM, clean_merchant),
        _inline(text, GOT_BY, clean_merchant),
    )
    return F.coalesce(F.when(kind == "expense", paid).otherwise(got), _inline(text, UPI_PATH, clean_merchant))


def title(kind: Column, target: Column, bank: Column) -> Column:
    """Counterparty without lead words, cut at joining words; else the bank and the direction."""
    paid = F.regexp_replace(target, r"(?i)^(?:to|paid to|towards)\s*[:\s-]*\s*", "")
    paid = strip(F.regexp_replace(strip(paid), r"(?is)\s+and\s+.*$", ""))
    paid = strip(F.regexp_replace(paid, r"(?is)\s+for\s+.*$", ""))
    got = F.regexp_replace(target, r"(?i)^(?:from|received from|by)\s*[:\s-]*\s*", "")
    got = strip(F.regexp_replace(strip(got), r"(?is)\s+and\s+.*$", ""))
    words = F.when(kind == "expense", paid).otherwise(got)
    return F.coalesce(F.nullif(words, F.lit("")), default_title(kind, bank))


def default_title(kind: Column, bank: Column) -> Column:
    return F.concat(bank, F.when(kind == "expense", " Expense").otherwise(" Income"))


def note(body: Column, sender_text: Column, receiver_text: Column, account: Column, bank: Column, ref: Column) -> Column:
    """Header lines, a blank line, the whole message."""
    bank_known = (bank != "Bank") & (
        sender_text.isNull() | ~F.coalesce(F.lower(sender_text), F.lit("")).contains(F.lower(bank))
    )
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("From: "), sender_text),
        F.concat(F.lit("To: "), receiver_text),
        F.when(sender_text.isNull(), F.concat(F.lit("Account: "), account)),
        F.when(bank_known, F.concat(F.lit("Bank: "), bank)),
        F.concat(F.lit("Ref: "), ref),
    )
    return F.concat_ws("\n\n", F.nullif(header, F.lit("")), strip(body))


# ---- dates ---------------------------------------------------------------------------------


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """Date parts with overflow: month 13 is the next January, day 0 the day before the first."""
    january = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(january, month - 1), day - 1).cast("timestamp_ntz")


def month_number(name: Column) -> Column:
    """Month of a three-letter name, null when there is none."""
    pairs = [F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def full_year(text: Column) -> Column:
    """Years below 100 are of this century."""
    return let(whole_number(text), lambda y: F.when(y < 100, y + 2000).otherwise(y))


def message_date(text: Column) -> Column:
    """The first numeric date, else the first with a month name."""
    return let(text, _message_date)


def _message_date(text: Column) -> Column:
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    numeric = rolled_date(
        full_year(part(NUMERIC_DATE, 3)),
        whole_number(part(NUMERIC_DATE, 2)),
        whole_number(part(NUMERIC_DATE, 1)),
    )
    named = rolled_date(
        full_year(part(NAMED_DATE, 3)), month_number(part(NAMED_DATE, 2)), whole_number(part(NAMED_DATE, 1))
    )
    return F.when(text.rlike(NUMERIC_DATE), numeric).when(text.rlike(NAMED_DATE), named)
