"""Ordered keyword rules over text, in Spark and in SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# (words, label); the first rule with a matching word wins.
KeywordRules = Sequence[tuple[Sequence[str], str]]


def any_word(words: Sequence[str], word_boundary: bool = False) -> str:
    """Regex that finds any of the words as plain substrings (or whole words)."""
    body = "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
    return rf"\b(?:{body})\b" if word_boundary else body


def minimal(words: Sequence[str]) -> list[str]:
    """The words without those that contain another one: a text holds any of the
    words exactly when it holds any of these."""
    unique = list(dict.fromkeys(words))
    return [w for w in unique if not any(v != w and v in w for v in unique)]


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Plain substring test; byte search, no regex."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in minimal(words)])


def has_word(text: Column, words: Sequence[str], word_boundary: bool = False) -> Column:
    low = F.lower(text)
    return low.rlike(any_word(words, True)) if word_boundary else holds_any(low, words)


def first_match(text: Column, rules: KeywordRules, default: str | None, word_boundary: bool = False) -> Column:
    """Label of the first rule that matches the lower-cased text."""
    low = F.coalesce(text, F.lit(""))
    chain = F
    for words, label in rules:
        chain = chain.when(has_word(low, words, word_boundary), F.lit(label))
    return chain.otherwise(F.lit(default))


def sql_has_word(text: str, words: Sequence[str]) -> str:
    return f"regexp_matches(lower({text}), '{any_word(words)}')"


def sql_first_match(text: str, rules: KeywordRules, default: str | None) -> str:
    arms = " ".join(f"WHEN {sql_has_word(f'coalesce({text}, chr(0))', w)} THEN '{label}'" for w, label in rules)
    tail = "NULL" if default is None else f"'{default}'"
    return f"CASE {arms} ELSE {tail} END"
