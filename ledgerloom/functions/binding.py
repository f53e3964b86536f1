"""Binding a column once for many uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """A lambda variable is evaluated once, an alias may be inlined wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)
