"""The three spellings of unknown, and ordered lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import UNKNOWN


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed, and stands in the plan, once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def known(c: str | Column) -> Column:
    """The value, NULL where it is null, empty or the sentinel."""
    return F.when(col(c).isin("", UNKNOWN), F.lit(None)).otherwise(col(c))


def is_unknown(c: str | Column) -> Column:
    return known(c).isNull()


def or_unknown(c: str | Column) -> Column:
    """For sinks: the value, the sentinel where it is unknown."""
    return F.coalesce(known(c), F.lit(UNKNOWN))


def first_known(*columns: str | Column) -> Column:
    return F.coalesce(*(known(c) for c in columns))


def unique(items: str | Column) -> Column:
    """Distinct items in order of first appearance, without nulls and empty strings."""
    return F.array_distinct(F.filter(col(items), lambda x: x.isNotNull() & (x != "")))


def present(pairs: Iterable[tuple[Column, str | Column]]) -> Column:
    """The labels whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(label) if isinstance(label, str) else label) for cond, label in pairs)))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strings(items: str | Column) -> Column:
    """Trimmed items, without blank ones; an empty list for null."""
    return F.coalesce(F.filter(F.transform(col(items), F.trim), lambda x: x != ""), no_strings())


def any_word(words: Iterable[str]) -> str:
    """A pattern for one of the words; where none begins, a look at the first character is enough."""
    words = list(words)
    first = "(?=[" + "".join(re.escape(c) for c in sorted({w[0] for w in words})) + "])" if words and all(words) else ""
    return first + "(?:" + "|".join(map(re.escape, words)) + ")"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a word occurs in the text: one pattern, so that long lists stay short plans."""
    return text.rlike(any_word(words))


def first_in_list(text: Column, words: Iterable[str]) -> Column:
    """The first of the words, in the list's order, that the text contains."""
    return F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))


def parsed(stamp: str | Column) -> Column:
    """An ISO 8601 string as a timestamp, NULL where it is none."""
    return F.expr("try_cast(x as timestamp)") if stamp is None else col(stamp).try_cast("timestamp")


def whole_json(text: Column) -> Column:
    """The text as a variant if all of it is one JSON value, else NULL.

    The parser stops behind the first value, so that "12 of them" would be a number. Hence the text is read as the first
    item of a list whose second and last is the text's digest: only a whole value lets the parser come to that.
    """
    end = F.md5(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), end, F.lit('"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == end, F.try_variant_get(pair, "$[0]", "variant"))
