"""Text predicates and presentation formats."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, functions as F


def is_missing(col: Column) -> Column:
    """NULL, empty or blank."""
    return col.isNull() | (F.trim(col.cast("string")) == F.lit(""))


def labelled(key: Column, labels: Mapping[str, str]) -> Column:
    """Display label of a key; the key itself where it has none."""
    pairs = F.create_map(*[F.lit(text) for text in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(pairs, key), key)


def title(col: Column) -> Column:
    """``view_to_cart`` -> ``View To Cart``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def pct_text(col: Column) -> Column:
    return F.format_string("%.2f%%", col)


def count_text(col: Column) -> Column:
    return F.format_number(col, 0)
