"""Keyword rules as SQL text for the checking engine."""

from __future__ import annotations

import re

from passbook.fixed_values import EXPENSE_KEYWORDS, INCOME_KEYWORDS


def _hit(text: str, keyword: str) -> str:
    if any(mark in keyword for mark in " &."):
        return f"contains({text}, '{keyword}')"
    # The checking engine's word boundary is ASCII; so is the one asked for here.
    return f"regexp_matches({text}, '(^|[^a-z0-9_]){re.escape(keyword)}($|[^a-z0-9_])')"


def category_sql(text: str, kind: str = "type") -> str:
    def chain(rules: dict[str, str]) -> str:
        whens = " ".join(
            "when " + " or ".join(_hit(text, k) for k in line) + f" then '{name}'" for name, line in rules.items()
        )
        return f"case {whens} end"

    return f"case when {kind} = 'income' then {chain(INCOME_KEYWORDS)} else {chain(EXPENSE_KEYWORDS)} end"


def keyword_sql(text: str, kind: str = "type") -> str:
    def chain(rules: dict[str, str]) -> str:
        whens = " ".join(f"when {_hit(text, k)} then '{k}'" for line in rules.values() for k in line)
        return f"case {whens} end"

    return f"case when {kind} = 'income' then {chain(INCOME_KEYWORDS)} else {chain(EXPENSE_KEYWORDS)} end"
