"""Small helpers shared by the Column-function libraries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lets(values: dict[str, Column], body: Callable[..., Column]) -> Column:
    """``body(**values)`` with all values worked out once, side by side: one level of nesting for any number of them."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), lambda s: body(**{k: s[k] for k in values}))


def any_contained(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs anywhere in the text: one pass of one pattern, in which words of one first letter share it."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(re.escape(w[1:]))
    return text.rlike("|".join(f"{re.escape(c)}(?:{'|'.join(r)})" for c, r in rest.items()))


def blank_null(text: Column) -> Column:
    """NULL for an empty string."""
    return F.when(text != "", text)


def strings(values: Iterable[str]) -> Column:
    """A constant array; one literal, which the optimizer splits once, not one for each value."""
    return F.split(F.lit("\n".join(values)), "\n")


def no_strings() -> Column:
    return F.array().cast("array<string>")
