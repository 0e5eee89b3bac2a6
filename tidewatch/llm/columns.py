"""Words as column expressions: built-in functions only."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words: every ASCII character but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain ASCII takes the fast way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def raw_words(text: Column) -> Column:
    """Words of a text as they stand; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def ahead(array: Column, index: Column, count: int) -> list[Column]:
    """The elements that follow ``index``: index + 1 .. index + count; null behind the end."""
    return [F.get(array, index + k) for k in range(1, count + 1)]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used.

    A plain column used inside lambdas may be inlined by the optimizer and computed anew for each element.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def first_of(array: Column, count: Column) -> Column:
    """The first ``count`` elements, none if it is negative."""
    return F.slice(array, F.lit(1), F.greatest(count, F.lit(0)))
