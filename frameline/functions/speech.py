"""Speech segments from JSON, and transcripts as lines.

A segment is an object {start, end[, gender]} or a list [start, end[, gender]].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import named
from .text import gender as canonical
from .text import timestamp

SEGMENTS = "array<struct<start:double,end:double,gender:string>>"


def _parts(item: Column) -> Column:
    """(start, end, gender) of one segment's JSON text, in either form; null starts and ends where they are no numbers."""
    named = F.from_json(item, "start string, end string, gender string")
    listed = F.from_json(item, "array<string>")
    by_name = F.ltrim(item).startswith("{")
    of = lambda name, k: F.when(by_name, named[name]).otherwise(F.try_element_at(listed, F.lit(k)))
    return F.struct(of("start", 1).try_cast("double").alias("start"), of("end", 2).try_cast("double").alias("end"), canonical(of("gender", 3)).alias("gender"))


def valid_segments(segments: Column, strict: bool = True) -> Column:
    """Segments that end after they start, by start (equal starts stay in order).  One without a number as start or end is an error, or left out if not ``strict``."""
    whole = lambda s: s["start"].isNotNull() & s["end"].isNotNull()
    placed = F.transform(F.filter(segments, lambda s: whole(s) & (s["end"] > s["start"])), lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["gender"].alias("gender")))
    good = F.transform(F.array_sort(placed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["gender"].alias("gender")))
    if not strict:
        return good
    wrong = F.raise_error(F.lit("a segment has no start and end, or they are no numbers")).cast(SEGMENTS)
    return F.when(F.exists(segments, lambda s: ~whole(s)), wrong).otherwise(good)


def parse_segments(value: Column, strict: bool = True) -> Column:
    """Segments of a JSON text.  Null or blank text is null ("not known"), ``[]`` is empty ("no speech"); text that is no JSON list is an error."""
    items = F.from_json(value, "array<string>", {"mode": "PERMISSIVE"})
    is_list = F.ltrim(value).startswith("[") & items.isNotNull()
    wrong = F.raise_error(F.concat(F.lit("not a JSON list of segments: "), value)).cast(SEGMENTS)
    parsed = valid_segments(F.transform(items, _parts), strict)
    return F.when(value.isNull() | (F.trim(value) == ""), F.lit(None).cast(SEGMENTS)).when(is_list, parsed).otherwise(wrong)


def transcript(df: DataFrame, form: str, keys: list[str], order: list[str], start: str, end: str, text: str) -> DataFrame:
    """(keys, pos, entry): one entry a segment in the form txt, vtt or srt, in order; ``pos`` counts from 1.

    An entry holds its line breaks; vtt files begin with the line WEBVTT and an empty one.
    """
    if form not in ("txt", "vtt", "srt"):
        raise ValueError(f"unknown form: {form}")
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    words = F.btrim(F.col(text), F.lit(" \t\n\r\x0b\x0c"))
    said = F.replace(words, F.lit("-->"), F.lit("->"))
    stamp = lambda c: timestamp(F.col(c), form == "srt", "," if form == "srt" else ".")
    times = F.concat(stamp(start), F.lit(" --> "), stamp(end), F.lit("\n"))
    entry = {"txt": words, "vtt": F.concat(times, said, F.lit("\n")), "srt": F.concat(F.col("pos").cast("string"), F.lit("\n"), times, said, F.lit("\n"))}[form]
    return df.withColumn("pos", pos).select(*keys, "pos", entry.alias("entry"))


def write_transcripts(entries: DataFrame, form: str, key: str, path: str) -> None:
    """One file a key, named ``key``.``form``, its entries in order; a key's transcript fits a row.  Files that are there stay."""
    placed = F.array_sort(F.collect_list(F.struct("pos", "entry")))
    lines = F.transform(placed, lambda e: F.concat(e["entry"], F.lit("\n")))
    text = F.concat(F.lit("WEBVTT\n\n" if form == "vtt" else ""), F.array_join(lines, ""))
    texts = entries.groupBy(F.col(key).cast("string").alias("k")).agg(text.alias("t"))
    named.write(texts, F.concat("k", F.lit(f".{form}")), F.col("t"), path)
