"""Expressions over arrays of face landmarks: structs (x, y) in the 68-point order.

Places are counted from 0, as landmark tables are; slices leave their end out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

#: Where each of the 68 points goes when a face is mirrored.
MIRRORED = [
    16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
    26, 25, 24, 23, 22, 21, 20, 19, 18, 17, 27, 28, 29, 30, 35,
    34, 33, 32, 31, 45, 44, 43, 42, 47, 46, 39, 38, 37, 36, 41,
    40, 54, 53, 52, 51, 50, 49, 48, 59, 58, 57, 56, 55, 64, 63,
    62, 61, 60, 67, 66, 65,
]
#: Slices of the 68-point order; each leaves out its last point.
CONTOUR, LIPS, INNER_MOUTH = (0, 16), (48, 67), (60, 67)


def point(points: Column, place: int) -> Column:
    return F.try_element_at(points, F.lit(place + 1))


def part(points: Column, of: tuple[int, int]) -> Column:
    return F.slice(points, of[0] + 1, of[1] - of[0])


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def apart(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def half_face(points: Column, shift: float = 0.0) -> list[Column]:
    """Crop box whose upper edge lies as far above the nose bridge (point 29, moved down by ``shift``) as the chin lies below; the gaps to points 30 and 28.

    The box is null with fewer than 31 points or without extent.
    """
    enough = F.size(points) >= 31
    bridge, chin = point(points, 29)["y"] + shift, F.array_max(ys(points))
    box = [F.array_min(xs(points)), F.greatest(F.lit(0.0), 2 * bridge - chin), F.array_max(xs(points)), chin]
    fine = enough & (box[3] - box[1] > 1) & (box[2] - box[0] > 1)
    gaps = [point(points, 30)["y"] - point(points, 29)["y"], point(points, 29)["y"] - point(points, 28)["y"]]
    return [*[F.when(fine, c) for c in box], *[F.when(enough, g) for g in gaps]]


def mouth(points: Column, pad: float = 0.35) -> list[Column]:
    """Mouth box around the lips, of at least 0.55 x 0.35 of the face's extent, and the mouth's openness: inner height over outer width.

    Null with fewer than 68 points or lips that are not there (all 0, or not finite).
    """
    lips = F.slice(points, 49, 20)
    there = (F.size(points) >= 68) & F.forall(lips, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    there = there & F.exists(lips, lambda p: (F.abs(p["x"]) > 1e-8) | (F.abs(p["y"]) > 1e-8))
    ends = {axis: (F.array_min(of(lips)), F.array_max(of(lips)), F.array_max(of(points)) - F.array_min(of(points))) for axis, of in (("x", xs), ("y", ys))}
    size = {axis: F.greatest(F.greatest(F.lit(1.0), hi - lo) * (1 + 2 * pad), share * F.greatest(face, F.lit(1.0))) for (axis, (lo, hi, face)), share in zip(ends.items(), (0.55, 0.35))}
    middle = {axis: (lo + hi) / 2 for axis, (lo, hi, _) in ends.items()}
    middle["y"] = middle["y"] + 0.08 * size["y"]  # a little lower, so that the lower lip stays inside
    box = [middle["x"] - size["x"] / 2, middle["y"] - size["y"] / 2, middle["x"] + size["x"] / 2, middle["y"] + size["y"] / 2]
    openness = apart(point(points, 66), point(points, 62)) / F.greatest(apart(point(points, 54), point(points, 48)), F.lit(1e-6))
    return [F.when(there, c) for c in (*box, openness)]


def union_box(face: G.Box, points: Column) -> list[Column]:
    """Whole-pixel box around the face box and all landmarks; its upper left is not below 0."""
    whole = [c.cast("int") for c in face]
    px, py = F.transform(xs(points), lambda v: v.cast("int")), F.transform(ys(points), lambda v: v.cast("int"))
    zero = F.lit(0)
    return [F.greatest(zero, F.least(whole[0], F.array_min(px))), F.greatest(zero, F.least(whole[1], F.array_min(py))), F.greatest(whole[2], F.array_max(px)), F.greatest(whole[3], F.array_max(py))]


def mouth_rectangle(points: Column, width: Column, height: Column, size: int = 256, pad: float = 0.0, lift: float = 0.0) -> list[Column]:
    """Rows and columns of the mouth's mask in a face image of ``size`` pixels: the lips' width, half as high, moved up by ``lift``, cut to the face, rounded half to even."""
    lips = part(points, LIPS)
    x = F.transform(xs(lips), lambda v: v / width * size)
    y = F.transform(ys(lips), lambda v: v / height * size)
    left, right = F.array_min(x) - pad, F.array_max(x) + pad
    middle, quarter = (F.array_min(y) + F.array_max(y)) / 2, (right - left) / 4
    zero = F.lit(0.0)
    return [F.bround(c).cast("int") for c in (F.greatest(left, zero), F.greatest(middle - quarter - lift, zero), F.least(right, width), F.least(middle + quarter - lift, height))]


def mirrored(points: Column, order: list[int] | None = None) -> Column:
    """The points in the order of a mirrored face."""
    return F.transform(F.array(*[F.lit(k) for k in order or MIRRORED]), lambda k: F.try_element_at(points, k + 1))


def to_map(p: Column, centre: Column, scale: Column, resolution: int) -> list[Column]:
    """Whole places of an image point in a map of ``resolution`` pixels around ``centre``; a scale of 1 is 200 pixels."""
    factor = F.lit(float(resolution)) / (scale * 200)
    return [((p[c] - centre[c]) * factor + resolution / 2).cast("int") for c in ("x", "y")]


def from_map(p: Column, centre: Column, scale: Column, resolution: int) -> list[Column]:
    """The inverse of `to_map`, cut to whole pixels."""
    factor = scale * 200 / float(resolution)
    return [((p[c] - resolution / 2) * factor + centre[c]).cast("int") for c in ("x", "y")]


def peak(heat: Column, width: int) -> list[Column]:
    """x and y of the largest value of a map (rows one after the other; the first of equals), a quarter pixel towards the larger neighbour, and half a pixel back to the middle; peaks on the edge are not moved."""
    at = F.array_position(heat, F.array_max(heat)) - 1
    x, y = at % width, F.floor(at / width)
    value = lambda i, j: F.try_element_at(heat, (j * width + i + 1).cast("int"))
    inside = (x > 0) & (x < width - 1) & (y > 0) & (y < F.size(heat) / width - 1)
    move = [F.when(inside, 0.25 * F.signum(d)).otherwise(0.0) for d in (value(x + 1, y) - value(x - 1, y), value(x, y + 1) - value(x, y - 1))]
    return [x + 1 + move[0] - 0.5, y + 1 + move[1] - 0.5]


def mean_apart(a: Column, b: Column, of: tuple[int, int]) -> Column:
    """Mean distance of the points at the same places of two faces, over one part of them."""
    d = F.zip_with(part(a, of), part(b, of), apart)
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / (of[1] - of[0])


def in_unit_face(points: Column, width: Column, height: Column) -> Column:
    """The points as shares of the face's width and height."""
    return F.transform(points, lambda p: F.struct((p["x"] / width).alias("x"), (p["y"] / height).alias("y")))
