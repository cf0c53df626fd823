"""Arithmetic on score arrays, candidates and landmarks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.once import once


def log_softmax(logits: Column) -> Column:
    total = lambda z, top: F.log(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    less = lambda z, top: once(total(z, top), lambda t: F.transform(z, lambda v: v - top - t))
    return once(logits, lambda z: once(F.array_max(z), lambda top: less(z, top)))


def suppressed(logits: Column, places: list[int]) -> Column:
    """Minus infinity at the given places (from 0)."""
    return F.transform(logits, lambda v, i: F.when(i.isin(places), F.lit(float("-inf"))).otherwise(v))


def best_place(values: Column) -> Column:
    """Place (from 0) of the largest value; the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def average_log_prob(total: Column, length: Column) -> Column:
    return total / (length + 1)


def gaussian(size: int, sigma: float | Column) -> Column:
    """Normalised weights around the middle of ``size`` places."""
    middle = (size - 1) / 2
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.exp(-((i - middle) * (i - middle)) / (2 * sigma * sigma)))
    return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda s, x: s + x))


def sinusoid(at: Column, width: int, longest: float = 10000.0) -> Column:
    """Position encoding: sines, then cosines, of falling frequency."""
    half = width // 2
    angle = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: at * F.exp(i * (-F.log(F.lit(longest)) / (half - 1))))
    return F.concat(F.transform(angle, lambda a: F.sin(a)), F.transform(angle, lambda a: F.cos(a)))


def decode_box(prior: list[Column], delta: list[Column], variance: tuple[float, float] = (0.1, 0.2)) -> list[Column]:
    """Corner box from a prior (centre, size) and its regressed offsets."""
    cx, cy = prior[0] + delta[0] * variance[0] * prior[2], prior[1] + delta[1] * variance[0] * prior[3]
    w, h = prior[2] * F.exp(delta[2] * variance[1]), prior[3] * F.exp(delta[3] * variance[1])
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def encode_box(prior: list[Column], box: list[Column], variance: tuple[float, float] = (0.1, 0.2)) -> list[Column]:
    """The offsets that `decode_box` turns back into the box."""
    cx, cy, w, h = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1]
    return [(cx - prior[0]) / (variance[0] * prior[2]), (cy - prior[1]) / (variance[0] * prior[3]), F.log(w / prior[2]) / variance[1], F.log(h / prior[3]) / variance[1]]


def distance_box(x: Column, y: Column, d: list[Column]) -> list[Column]:
    """Box from an anchor and its distances to the four sides."""
    return [x - d[0], y - d[1], x + d[2], y + d[3]]


def bounds(points: Column) -> list[Column]:
    """x1, y1, x2, y2 of an array of points (x, y); null for no points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def shifted(points: Column, x: Column, y: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y")))


def rescaled(points: Column, sx: Column, sy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def mean_distance(a: Column, b: Column) -> Column:
    """Mean distance of points at the same place of two arrays."""
    d = F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(a)
