"""Spectrograms: windows of samples as rows, spectra in Arrow batches, levels as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mel_filters(rate: int, size: int, bands: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters[band, frequency] between points that lie evenly on the mel scale (linear to 1 kHz, then logarithmic), each of area 1."""
    high = rate / 2 if high is None else high
    step, knee = 200 / 3, 15.0  # mels are 66.7 Hz wide up to 1 kHz, which is mel 15
    growth = np.log(6.4) / 27
    to_mel = lambda f: f / step if f < 1000 else knee + np.log(f / 1000) / growth
    m = np.linspace(to_mel(low), to_mel(high), bands + 2)
    edge = np.where(m < knee, m * step, 1000 * np.exp(growth * (m - knee)))
    f = np.linspace(0, rate / 2, size // 2 + 1)
    rise = (f[None, :] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - f[None, :]) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def windows_of(df: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    """One row a window: the rows of ``df`` without ``samples``, with at and window.

    Windows are centred: half a window of mirrored samples is added at both ends, and the
    last window is left out.  Rows with no more than half a window of samples have none.
    """
    half, n = size // 2, F.size(samples)
    mirrored = F.concat(F.reverse(F.slice(samples, 2, half)), F.col(samples), F.slice(F.reverse(F.col(samples)), 2, half))
    rows = df.where(n > half).withColumns({"__s": mirrored, "__n": F.floor(n / hop).cast("int")}).drop(samples).where("__n > 0")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.withColumn("window", F.slice("__s", F.col("at") * hop + 1, size)).drop("__s", "__n")


def band_power(window: Column | str, filters: np.ndarray, square: bool = True) -> Column:
    """Power (or magnitude) of a window's spectrum, weighted by a raised cosine, in the bands of ``filters``."""
    size = (filters.shape[1] - 1) * 2
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    @F.pandas_udf("array<double>")
    def power(w: pd.Series) -> pd.Series:
        if not len(w):
            return pd.Series([], dtype=object)
        spectrum = np.abs(np.fft.rfft(np.stack(w.to_list()) * taper, axis=1))
        return pd.Series(list((spectrum**2 if square else spectrum) @ filters.T))

    return power(window)


def log_bands(df: DataFrame, bands: str, keys: list[str], out: str = "level") -> DataFrame:
    """log10 of the bands, no lower than 8 under the greatest of the key, moved to about -1..1.  The greatest is one number a key."""
    logs = df.withColumn(out, F.transform(bands, lambda v: F.log10(F.greatest(v, F.lit(1e-10)))))
    most = logs.groupBy(*keys).agg(F.max(F.array_max(out)).alias("__most"))
    floor = F.col("__most") - 8
    return logs.join(most, keys).withColumn(out, F.transform(out, lambda v: (F.greatest(v, floor) + 4) / 4)).drop("__most")


def log_mel(df: DataFrame, samples: str, keys: list[str], rate: int = 16_000, size: int = 400, hop: int = 160, bands: int = 80, filters: np.ndarray | None = None) -> DataFrame:
    """(keys, at, level): the log-mel spectrogram of each row's samples."""
    filters = mel_filters(rate, size, bands) if filters is None else filters
    rows = windows_of(df.select(*keys, samples), samples, size, hop).withColumn("bands", band_power("window", filters)).drop("window")
    return log_bands(rows, "bands", keys).drop("bands")


def peak_scaled(df: DataFrame, value: str, keys: list[str], out: str = "sample") -> DataFrame:
    """16-bit samples whose largest is full scale (quiet recordings are raised at most a hundredfold); fractions are cut off."""
    most = F.max(F.abs(value)).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.col(value) * 32767, F.greatest(F.lit(0.01), most)).cast("smallint"))


def mel_crop(values: Column, frame: Column, fps: float, length: int = 52, per_second: float = 80.0) -> Column:
    """``length`` spectrogram rows from the frame's time on; null where the spectrogram ends before."""
    start = (frame / fps * per_second).cast("int")
    cut = F.slice(values, start + 1, length)
    return F.when(F.size(cut) == length, cut)


def context_places(frame: Column, n: Column, fps: float, before: int = 2, after: int = 2) -> Column:
    """Places of the half-frame features around a video frame, at 50 a second; places outside take the edge's."""
    centre = (frame * (50.0 / fps)).cast("int")
    return F.transform(F.sequence(centre - 2 * before, centre + 2 * after + 1), lambda i: F.least(F.greatest(i, F.lit(0)), n - 1))


def sparse_context_places(frame: Column, n: Column, fps: float, before: int = 2, after: int = 2) -> Column:
    """Pairs of places, one before and one at each neighbouring frame's time; at the edges one place twice."""

    def pair(dt: Column) -> Column:
        at = ((frame + dt) * (50.0 / fps)).cast("int")
        edge = F.least(F.greatest(at, F.lit(0)), n - 1)
        return F.when((at < 1) | (at > n - 1), F.array(edge, edge)).otherwise(F.array(at - 1, at))

    return F.flatten(F.transform(F.sequence(F.lit(-before), F.lit(after)), pair))


def chunk_frames(n: Column, fps: float) -> Column:
    """Video frames that get a chunk of features: all until the first whose start lies beyond the features, that one too."""
    return F.sequence(F.lit(0), F.ceil((n + 1) * (fps / 50.0)).cast("int"))


def padded_context(features: DataFrame, frames: DataFrame, keys: list[str], start: str, step: str, value: str, before: int = 2, after: int = 2) -> DataFrame:
    """(keys, f, j, value): for the f-th training frame of a row the features from 2 x (start + f x step) on, in a table with zeros added on the left and right; places beyond both have no row."""
    width, pad = 2 * (before + after + 1), 2 * before
    n = features.groupBy(*keys).agg(F.count("*").alias("__n"))
    asked = frames.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("__at", (F.col(start) + F.col("f") * F.col(step)) * 2 + F.col("j") - pad)
    asked = asked.join(n, keys).where((F.col("__at") + pad >= 0) & (F.col("__at") < F.col("__n") + 2 * after))
    values = features.select(*keys, F.col("at").alias("__at"), F.col(value).alias("__v"))
    return asked.join(values, [*keys, "__at"], "left").select(*keys, "f", "j", F.coalesce("__v", F.lit(0.0)).alias(value))


def seek_windows(n: Column, length: int = 3000) -> Column:
    """Structs (start, stop) of consecutive windows; the last one may be shorter."""
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(length))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + length, n).alias("stop")))
