"""Box and score expressions.  A box is four columns x1, y1, x2, y2; null means no box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]


def area(b: Box) -> Column:
    """0 without a box; negative sides count as 0."""
    return F.coalesce(F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if a box is missing or they do not meet."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = w * h
    union = area(a) + area(b) - inter
    missing = a[0].isNull() | b[0].isNull()
    return F.when(missing | (w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(inter / union)


def center_distance(a: Box, b: Box) -> Column:
    """Infinite if a box is missing."""
    d = F.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    return F.coalesce(d, F.lit(float("inf")))


def scaled(b: Box, sx: float, sy: float) -> list[Column]:
    """Rounded half to even."""
    return [F.bround(c * s) for c, s in zip(b, (sx, sy, sx, sy))]


def clamped(b: Box, width: float, height: float) -> list[Column]:
    """Clamped to the frame; null if a side is not over one pixel."""
    x1, x2 = (F.least(F.greatest(c, F.lit(0.0)), F.lit(float(width))) for c in (b[0], b[2]))
    y1, y2 = (F.least(F.greatest(c, F.lit(0.0)), F.lit(float(height))) for c in (b[1], b[3]))
    keep = (x2 - x1 > 1) & (y2 - y1 > 1)
    return [F.when(keep, c) for c in (x1, y1, x2, y2)]


def expanded(b: Box, width: float, height: float, side: float = 0.35, up: float = 0.55, down: float = 0.45) -> list[Column]:
    w, h = b[2] - b[0], b[3] - b[1]
    zero = F.lit(0.0)
    return [F.greatest(zero, b[0] - w * side), F.greatest(zero, b[1] - h * up), F.least(F.lit(float(width)), b[2] + w * side), F.least(F.lit(float(height)), b[3] + h * down)]


def crop_square(b: Box, expand: float) -> list[Column]:
    """Square around the box's centre, with floored halves."""
    xc, yc = F.floor((b[0] + b[2]) / 2), F.floor((b[1] + b[3]) / 2)
    s = F.floor(F.floor(F.greatest(b[2] - b[0], b[3] - b[1]) / 2) * expand)
    return [xc - s, yc - s, xc + s, yc + s]


def seed_score(b: Box, width: float, height: float) -> Column:
    """Area times nearness to the frame's centre, the latter at least 0.2."""
    d = F.hypot((b[0] + b[2]) / 2 - width / 2, (b[1] + b[3]) / 2 - height / 2) / ((width / 2) ** 2 + (height / 2) ** 2) ** 0.5
    return area(b) * F.greatest(F.lit(0.2), 1 - d)


def soft_closed(open_prob: Column, mar: Column, threshold: float) -> Column:
    """Scores of mouths less open than ``threshold`` fall in proportion."""
    return F.when(mar < threshold, open_prob * F.greatest(F.lit(0.0), mar / threshold)).otherwise(open_prob)


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def decibel(x: Column, floor_db: float = -100.0) -> Column:
    return 20 * F.log10(F.greatest(F.lit(10 ** (floor_db / 20)), x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def large_enough(b: Box, width: float, height: float, share: float) -> Column:
    """Does the box cover ``share`` of the frame?  No share asked for: always."""
    return F.lit(True) if share <= 0 else area(b) >= share * width * height


def iou_of_corners(a: Box, b: Box) -> Column:
    """Overlap of boxes that are never missing; a box with swapped corners counts by the size of its sides' product."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    sides = [F.abs((c[2] - c[0]) * (c[3] - c[1])) for c in (a, b)]
    return F.when((w < 0) | (h < 0), 0.0).otherwise(w * h / (sides[0] + sides[1] - w * h))


def detection_scale(width: Column, height: Column, short_side: int = 720) -> list[Column]:
    """Width and height for detection, and the two factors back to the source; frames with a small short side stay as they are."""
    short = F.least(width, height)
    keep = F.lit(short_side <= 0) | (short <= short_side)
    small = [F.when(keep, x).otherwise(F.greatest(F.lit(1), F.bround(x * (F.lit(float(short_side)) / short)).cast("int"))) for x in (width, height)]
    return [*small, width / small[0], height / small[1]]


def lowered_edge(b: Box, margin: Column, height: float) -> list[Column]:
    """The box with its lower edge moved down by whole pixels, within the frame."""
    return [b[0], b[1], b[2], F.least(b[3] + margin.cast("int"), F.lit(float(height)))]


def margin(draw: Column, mean: float, spread: float, method: str = "uniform") -> Column:
    """A margin of 0 or more from a draw: uniform (the draw is 0 to 1) or normal (a standard normal draw, cut at one spread)."""
    if method not in ("uniform", "normal"):
        raise ValueError(f"unknown margin method: {method}")
    around = (draw * 2 - 1) if method == "uniform" else F.least(F.greatest(draw, F.lit(-1.0)), F.lit(1.0))
    return F.greatest(F.lit(0.0), around * spread + mean)


def cross_fade(over: Column, under: Column, alpha: Column) -> Column:
    """alpha of ``over`` and the rest of ``under``; within a thousandth of 0 or 1 just one of them."""
    return F.when(alpha >= 0.999, over).when(alpha <= 0.001, under).otherwise(over * alpha + under * (1 - alpha))


def amplitude(db: Column) -> Column:
    """The inverse of `decibel`."""
    return F.pow(F.lit(10.0), db / 20)


def normalised_level(db: Column, least_db: float = -100.0, most: float = 4.0, symmetric: bool = True) -> Column:
    """Decibels from ``least_db`` to 0 on a scale of 0 (or -``most``) to ``most``, cut at both ends."""
    share = (db - least_db) / -least_db
    low = -most if symmetric else 0.0
    return F.least(F.greatest(share * (most - low) + low, F.lit(low)), F.lit(most))


def level_of(value: Column, least_db: float = -100.0, most: float = 4.0, symmetric: bool = True) -> Column:
    """The inverse of `normalised_level`; values beyond the scale are cut first."""
    low = -most if symmetric else 0.0
    cut = F.least(F.greatest(value, F.lit(low)), F.lit(most))
    return (cut - low) / (most - low) * -least_db + least_db


def window_count(length: Column, size: int, shift: int) -> Column:
    """Analysis windows over ``length`` samples padded by ``size - shift`` on both sides."""
    steps = F.floor((length + 2 * (size - shift) - size) / shift)
    return (steps + F.when(length % shift == 0, 1).otherwise(2)).cast("long")


def window_padding(length: Column, size: int, shift: int) -> list[Column]:
    """Samples to add left and right, so that the last window is full."""
    pad = size - shift
    return [F.lit(pad), (pad + (window_count(length, size, shift) - 1) * shift + size - (length + 2 * pad)).cast("long")]


def tail_padding(length: Column, shift: int) -> Column:
    """Samples to add on the right alone."""
    return ((F.floor(length / shift) + 1) * shift - length).cast("long")


def agreement_loss(cosine_: Column, same: Column) -> Column:
    """Binary cross-entropy of a cosine, cut to 0..1, with the mark ``same`` (0 or 1); logarithms are cut at -100."""
    d = F.least(F.greatest(cosine_, F.lit(0.0)), F.lit(1.0))
    log = lambda x: F.when(x > 0, F.greatest(F.log(x), F.lit(-100.0))).otherwise(-100.0)
    return -(same * log(d) + (1 - same) * log(1 - d))


def exact_div(x: Column, y: Column) -> Column:
    """x / y as a whole number; an error if y does not divide x."""
    return F.when(x % y == 0, F.floor(x / y)).otherwise(F.raise_error(F.concat(x.cast("string"), F.lit(" is not a multiple of "), y.cast("string"))).cast("long"))
