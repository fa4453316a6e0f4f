"""Category names and keyword rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from passbook.fixed_values import (
    EXPENSE_CATEGORIES,
    EXPENSE_KEYWORDS,
    INCOME_CATEGORIES,
    INCOME_KEYWORDS,
)
from passbook.functions.text import let


def _constant_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def default_category(kind: Column) -> Column:
    return F.when(kind == "income", F.lit("other_income")).otherwise(F.lit("other"))


def known_category(kind: Column, category_id: Column) -> Column:
    """The id when it exists within the type, else the type's default."""
    known = F.when(kind == "income", category_id.isin(list(INCOME_CATEGORIES))).otherwise(
        category_id.isin(list(EXPENSE_CATEGORIES))
    )
    return F.when(known, category_id).otherwise(default_category(kind))


def category_name(kind: Column, category_id: Column) -> Column:
    """Display name; unknown and missing ids are named like the default."""
    income = F.try_element_at(_constant_map(INCOME_CATEGORIES), category_id)
    expense = F.try_element_at(_constant_map(EXPENSE_CATEGORIES), category_id)
    return F.coalesce(F.when(kind == "income", income).otherwise(expense), F.lit("Other"))


def is_phrase(keyword: str) -> bool:
    """Keywords with a blank, an ampersand or a dot match anywhere, others as whole words."""
    return any(mark in keyword for mark in " &.")


def rule_text(title: Column, merchant: Column) -> Column:
    return F.concat(F.lower(title), F.lit(" "), F.coalesce(F.lower(merchant), F.lit("")))


def rule_tokens(text: Column) -> Column:
    """Words of the text, and the phrases that occur in it.

    The words are read once, as runs of ASCII word characters; all rules then are one look-up
    in a hash set instead of a regular expression per category. A pattern to split at would be
    compiled anew for every row, one to find is kept.
    """
    rules = (EXPENSE_KEYWORDS, INCOME_KEYWORDS)
    phrases = F.array(*[F.lit(k) for r in rules for line in r.values() for k in line if is_phrase(k)])
    return let(text, lambda x: F.concat(F.regexp_extract_all(x, F.lit("[a-z0-9_]+"), F.lit(0)), F.filter(phrases, lambda p: F.contains(x, p))))


def _first_keyword(tokens: Column, rules: dict[str, str]) -> Column:
    """First keyword in rule order: an intersection keeps the order of its left side. Most texts hold none."""
    ordered = list(dict.fromkeys(k for line in rules.values() for k in line))
    found = F.filter(tokens, lambda word: word.isin(ordered))
    first = F.array(*[F.lit(k) for k in ordered])
    return let(found, lambda held: F.when(F.size(held) > 0, F.try_element_at(F.array_intersect(first, held), F.lit(1))))


def matched_keyword(kind: Column, tokens: Column) -> Column:
    """The keyword that decides, null when none occurs."""
    return F.when(kind == "income", _first_keyword(tokens, INCOME_KEYWORDS)).otherwise(
        _first_keyword(tokens, EXPENSE_KEYWORDS)
    )


def category_of_keyword(kind: Column, keyword: Column) -> Column:
    """Category a keyword stands for; one listed twice belongs to the earlier category."""

    def owner(rules: dict[str, str]) -> Column:
        owners: dict[str, str] = {}
        for category, line in rules.items():
            for k in line:
                owners.setdefault(k, category)
        return F.try_element_at(_constant_map(owners), keyword)

    return F.when(kind == "income", owner(INCOME_KEYWORDS)).otherwise(owner(EXPENSE_KEYWORDS))


def suggest_category(kind: Column, text: Column) -> Column:
    """Category by keyword, null when no keyword occurs."""
    return category_of_keyword(kind, matched_keyword(kind, rule_tokens(text)))
