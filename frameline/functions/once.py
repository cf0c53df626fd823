"""Binding a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once a row however often ``use`` names it, inside functions over arrays too and wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)
