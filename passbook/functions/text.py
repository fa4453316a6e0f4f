"""Small text expressions shared by the jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


# Blank characters beyond ASCII count as blanks too.
_BLANKS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{_BLANKS}]"
# The same characters one by one.
BLANK_CHARACTERS = " \t\n\x0b\f\r" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

# Word edges by ASCII word characters, whatever the engine's own idea of a letter.
EDGE = r"(?<![A-Za-z0-9_])"
END = r"(?![A-Za-z0-9_])"


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def whole_number(x: Column, kind: str = "int") -> Column:
    """A whole number read from the group of a pattern, null where the pattern found none.

    An empty text is not handed to the cast: one that fails costs several times the pattern.
    """
    return let(x, lambda v: F.when(v != "", v.try_cast(kind)))


def squeeze(x: Column) -> Column:
    """All blanks to one, ends trimmed."""
    return F.trim(F.regexp_replace(x, WS + "+", " "))


def strip(x: Column) -> Column:
    """Whitespace of any kind off both ends."""
    return F.btrim(x, F.lit(BLANK_CHARACTERS))


def blank(x: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(x.rlike(f"[^{_BLANKS}]"), F.lit(False))


def blank_to_null(x: Column) -> Column:
    return F.when(~blank(x), x)


def no_blanks(x: Column) -> Column:
    """Lower case without any whitespace, the form in which labels are compared."""
    return F.translate(F.lower(x), BLANK_CHARACTERS, "")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(x: Column, phrases) -> Column:
    """Plain substring test for any of the phrases; the text is worked out once."""
    listed = F.array(*[F.lit(p) for p in phrases])
    return let(x, lambda v: F.exists(listed, lambda p: F.contains(v, p)))


def first_group(x: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def first_value(values: Column) -> Column:
    """First non-null element of an array, else null."""
    return F.try_element_at(F.array_compact(values), F.lit(1))
