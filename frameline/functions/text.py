"""Text expressions; those Spark has no function for are Arrow-batched."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(seconds: Column, hours: bool = False, mark: str = ".") -> Column:
    """[hh:]mm:ss.mmm, milliseconds rounded half to even; hours appear when there are any or they are asked for."""
    ms = F.bround(seconds * 1000).cast("bigint")
    h, m, s, rest = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    tail = F.format_string(f"%02d:%02d{mark}%03d", m, s, rest)
    return F.when(F.lit(hours) | (h > 0), F.concat(F.format_string("%02d:", h), tail)).otherwise(tail)


def gender(value: Column) -> Column:
    """Canonical gender; null for anything else."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("m", "male", "man"), "male").when(v.isin("f", "female", "woman"), "female")


def frame_rate(value: Column) -> Column:
    """"num/den" or a decimal; an error for blank text or a zero denominator."""
    part = F.split(value, "/")
    top, bottom = F.try_element_at(part, F.lit(1)).cast("double"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("1")).cast("double")
    return F.when((F.trim(value) == "") | (bottom == 0), F.raise_error(F.concat(F.lit("bad frame rate: "), value))).otherwise(top / bottom)


def file_kind(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ending.isin("jpg", "jpeg", "png", "bmp", "tif", "tiff"), "image").when(ending.isin("avi", "mp4", "mov", "flv", "mkv"), "video").otherwise("unsupported")


def compression_ratio(text: Column | str) -> Column:
    """Characters over bytes of the compressed text; null for null."""

    @F.pandas_udf("double")
    def ratio(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else len(x) / len(zlib.compress(x.encode())))

    return ratio(text)


#: Letters that do not decompose, and what they are folded to.
FOLDS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
#: White space as Python's texts have it: Unicode's, and four separators of ASCII.
SPACE = r"(?U)[\s\x1C-\x1F]+"


def normal_form(text: Column | str, form: str) -> Column:
    """A Unicode normal form, which Spark has no function for.

    A batch is gone through in slices of few characters: Python's own texts, several times as
    large as Arrow's, are made for one slice at a time, and for texts outside ASCII alone.
    """

    @F.arrow_udf("string")
    def formed(t: pa.Array) -> pa.Array:
        return _in_slices(t, lambda x: unicodedata.normalize(form, x))

    return formed(text)


#: Bytes of text that are Python objects at one time.
SLICE_BYTES = 1 << 20


def _in_slices(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The texts outside ASCII changed, the others as they are."""
    kind, parts, at = texts.type, [], 0
    while at < len(texts):
        size = max(1, SLICE_BYTES * (len(texts) - at) // max(1, texts[at:].nbytes))
        part = texts.slice(at, size)
        at += len(part)
        plain = pc.fill_null(pc.string_is_ascii(part), True)
        if pc.all(plain).as_py():
            parts.append(part)
        else:
            other = pc.invert(plain)
            changed = pa.array([change(x) for x in part.filter(other).to_pylist()], kind)
            parts.append(pc.replace_with_mask(part, other, changed))
    return pa.concat_arrays(parts) if parts else texts


def _signs_to_spaces(text: Column, keep: str = "") -> Column:
    """Every mark, symbol and punctuation sign outside ``keep`` becomes a space."""
    kept = "".join(f"\\{c}" for c in keep)
    return F.regexp_replace(text, rf"[\p{{M}}\p{{S}}\p{{P}}&&[^{kept}]]" if keep else r"[\p{M}\p{S}\p{P}]", " ")


def folded(text: Column, keep: str = "") -> Column:
    """Letters without their diacritics; signs outside ``keep`` become spaces."""
    plain = F.regexp_replace(normal_form(text, "NFKD"), r"\p{Mn}", "")
    single = {a: b for a, b in FOLDS.items() if len(b) == 1}
    plain = F.translate(plain, "".join(single), "".join(single.values()))
    for letter, to in FOLDS.items():
        if letter not in single:
            plain = F.replace(plain, F.lit(letter), F.lit(to))
    return _signs_to_spaces(plain, keep)


def unfolded(text: Column) -> Column:
    """Letters as they are, in composed form; signs become spaces."""
    return _signs_to_spaces(normal_form(text, "NFKC"))


def without_brackets(text: Column) -> Column:
    """Neither what stands in angle or square brackets nor what stands in parentheses."""
    return F.regexp_replace(F.regexp_replace(text, r"[<\[][^>\]]*[>\]]", ""), r"\([^)]+?\)", "")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def normalised(remove_diacritics: bool = False, split_letters: bool = False):
    """Lower case, bracketed text gone, signs to spaces, spaces squeezed; optionally one space between letters (as a reader counts them)."""

    def apply(text: Column | str) -> Column:
        bare = without_brackets(F.lower(F.col(text) if isinstance(text, str) else text))
        clean = F.lower(folded(bare) if remove_diacritics else unfolded(bare))
        if split_letters:
            clean = F.array_join(F.regexp_extract_all(clean, F.lit(r"\X"), 0), " ")
        return squeezed(clean)

    return apply


def strict_boolean(value: Column) -> Column:
    """"True" or "False"; an error for any other text."""
    wrong = F.raise_error(F.concat(F.lit("neither True nor False: "), F.coalesce(value, F.lit("null")))).cast("boolean")
    return F.when(value == "True", True).when(value == "False", False).otherwise(wrong)


def optional_number(value: Column, kind: str = "int") -> Column:
    """Null for "None", else the number; an error for any other text."""
    number = value.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(value, F.lit("null")))).cast(kind)
    return F.when(value == "None", F.lit(None).cast(kind)).when(number.isNotNull(), number).otherwise(wrong)


def stem(path: Column) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def frame_name(number: Column, width: int = 8) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", number)
