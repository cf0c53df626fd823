"""Greedy one-to-one matching as rounds of locally best pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import stage


def greedy_pairs(edges: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """The rows of ``edges`` that a greedy choice by falling ``weight`` takes, each ``left`` and ``right`` of the same ``keys`` once at most.

    Of equal weights the larger ``left`` goes first, then the larger ``right``; a null weight
    is no edge, and of edges with the same ends the heaviest counts.  An edge that is the
    best one of both its ends is taken by the greedy choice whatever the others are, so all
    of these are taken at once, what touches them goes, and so on until no edge is left.
    """
    def best(df: DataFrame, *end: str):
        return F.row_number().over(Window.partitionBy(*keys, *end).orderBy(F.desc(weight), F.desc(left), F.desc(right)))

    rest = edges.where(F.col(weight).isNotNull())
    rest = stage(rest.withColumn("__n", best(rest, left, right)).where("__n = 1").drop("__n"), "matching-edges")
    taken = rest.limit(0)
    while not rest.isEmpty():
        ranked = rest.withColumns({"__l": best(rest, left), "__r": best(rest, right)})
        new = stage(ranked.where("__l = 1 and __r = 1").drop("__l", "__r"), "matching-taken")
        taken = taken.unionByName(new)
        left_out = rest.join(new.select(*keys, left), [*keys, left], "left_anti").join(new.select(*keys, right), [*keys, right], "left_anti")
        rest = stage(left_out, "matching-edges")
    return taken
