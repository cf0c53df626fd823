"""Interval joins and cuts.  Segments: clip_id, pos, seg_start, seg_end; visual intervals: clip_id, speaker_id, t0, t1, in seconds, half-open.

Ranges meet in an equi-join on the clip and a bin of time, longer ranges in coarser bins,
so that a clip costs what overlaps in it and not segments x intervals or seconds; a
nearest interval is found by running extremes over the clip's times.  Segments are given
to speakers by one such join and a sweep over each segment's own times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import interval_gap, interval_overlap
from .stages import stage

NOBODY = -1
#: Seconds of the finest bins, and how much coarser each next level of bins is.
BIN, COARSER = 4.0, 8.0
#: Times beyond this, in seconds, are no times; ranges with such an end, or one that is not a number, meet nothing.
LAST_TIME = 1e15


def _timed(*times: str) -> Column:
    sound = F.lit(True)
    for t in times:
        c = F.col(t).cast("double")
        sound = sound & F.coalesce(~F.isnan(c) & (F.abs(c) <= LAST_TIME), F.lit(False))
    return sound


def _level(lo: str, hi: str) -> Column:
    """The finest level whose bins are as long as the range, so that it stands in two bins at most."""
    long = (F.col(hi) - F.col(lo)) / BIN
    return F.when(long < 1 - 1e-9, 0).otherwise(F.ceil(F.log(COARSER, F.greatest(long, F.lit(1.0))) + 1e-9)).cast("int")


def _bin(level: Column, time: Column) -> Column:
    return F.floor(time / (BIN * F.pow(F.lit(COARSER), level)))


def meeting(left: DataFrame, right: DataFrame, a: Column | str, b: Column | str, t0: str, t1: str, touch: bool = False) -> DataFrame:
    """Left rows with the right rows of their clip whose [t0, t1) overlaps [a, b); with ``touch``, also those that only meet.

    Two ranges meet if one begins inside the other.  A range of any length stands in two
    bins of its own level at most, and a beginning in one bin of every level that the other
    side has, so what is joined grows with the rows and their pairs, and not with lengths.
    Each pair comes up once: by the left one's beginning, if that is not the earlier one,
    else by the right one's.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    rows = left.withColumns({"__a": a, "__b": b}).where(_timed("__a", "__b"))
    other = right.where(_timed(t0, t1))

    def dealt(df: DataFrame, levels: DataFrame, lo: str, hi: str, range_side: int, point_side: int) -> DataFrame:
        df = df.withColumns({"__levels": levels.scalar(), "__own": _level(lo, hi)})
        where = lambda side, level, time: F.struct(F.lit(side).alias("side"), level.cast("int").alias("level"), _bin(level, time).alias("bin"))
        stands = F.array_distinct(F.array(where(range_side, F.col("__own"), F.col(lo)), where(range_side, F.col("__own"), F.greatest(lo, hi))))
        begins = F.transform("__levels", lambda v: where(point_side, v, F.col(lo)))
        return df.withColumn("__at", F.explode(F.concat(stands, begins))).drop("__levels", "__own")

    def levels(df: DataFrame, lo: str, hi: str) -> DataFrame:
        """One row with a few numbers."""
        return df.agg(F.collect_set(_level(lo, hi)))

    # side 0: the left one begins inside the right one; side 1: the right one begins later, inside the left one
    met = dealt(rows, levels(other, t0, t1), "__a", "__b", 1, 0).join(dealt(other, levels(rows, "__a", "__b"), t0, t1, 0, 1), ["clip_id", "__at"])
    near = (F.col(t0) <= F.col("__b")) & (F.col(t1) >= F.col("__a")) if touch else (F.col(t0) < F.col("__b")) & (F.col(t1) > F.col("__a"))
    return met.where(near & (F.col("__at.side") == F.when(F.col(t0) <= F.col("__a"), 0).otherwise(1))).drop("__a", "__b", "__at")


def best_overlap(runs: DataFrame, segments: DataFrame, fps: float, share: float = 0.5) -> DataFrame:
    """Each run with the segment it overlaps most (the earlier of equals), if that covers ``share`` of the run."""
    t0, t1 = F.col("start_frame") / fps, (F.col("end_frame") + 1) / fps
    met = meeting(runs, segments.where("seg_end > seg_start"), t0, t1, "seg_start", "seg_end")
    met = met.withColumn("overlap", interval_overlap(t0, t1, F.col("seg_start"), F.col("seg_end"))).where("overlap > 0")
    w = Window.partitionBy("clip_id", "start_frame").orderBy(F.desc("overlap"), "seg_start", "pos")
    best = met.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return best.where(F.col("overlap") / F.greatest(t1 - t0, F.lit(1e-6)) >= share)


def expand_within_segments(frames: DataFrame, runs: DataFrame, segments: DataFrame, flag: Column, fps: float, most: float, valid: Column) -> DataFrame:
    """clip_id, frame_idx of the true frames after each run has grown by up to ``most`` seconds, within its segment and shot."""
    pad = round(most * fps)
    n = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    shots = frames.groupBy("clip_id", "shot_id").agg(F.min("frame_idx").alias("s0"), (F.max("frame_idx") + 1).alias("s1"))
    best = best_overlap(runs, segments, fps).join(n, "clip_id").join(shots, ["clip_id", "shot_id"])
    v0 = F.greatest(F.lit(0), F.bround(F.col("seg_start") * fps).cast("int"))
    v1 = F.least(F.col("n"), F.bround(F.col("seg_end") * fps).cast("int"))
    best = best.where(v1 > v0).select(
        "clip_id",
        F.greatest(F.lit(0), F.col("start_frame") - pad, v0, F.col("s0")).cast("int").alias("lo"),
        F.least(F.col("n") - 1, F.col("end_frame") + pad, v1 - 1, F.col("s1") - 1).cast("int").alias("hi"),
    )
    grown = best.where("hi >= lo").select("clip_id", F.explode(F.sequence("lo", "hi")).alias("frame_idx")).distinct()
    kept = frames.where(valid).select("clip_id", "frame_idx").join(grown, ["clip_id", "frame_idx"], "left_semi")
    return kept.unionByName(frames.where(flag).select("clip_id", "frame_idx")).distinct()


def positioned(intervals: DataFrame) -> DataFrame:
    """Adds ``ipos``, the order (t0, t1, speaker) that decides ties; equal intervals count once."""
    w = Window.partitionBy("clip_id").orderBy("t0", "t1", "speaker_id")
    return intervals.select("clip_id", "speaker_id", "t0", "t1").distinct().withColumn("ipos", F.row_number().over(w))


def nearest(pieces: DataFrame, intervals: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, speaker_id, gap) of the interval with the smallest gap, then the closest middle, then the first.

    Candidates of a piece are the intervals that meet it, the last one to end before it
    and the first one to start after it.
    """
    own = pieces.select("clip_id", *key, F.col(a).alias("__pa"), F.col(b).alias("__pb"))
    spans = positioned(intervals)
    given = ["clip_id", "speaker_id", "t0", "t1", "ipos"]
    met = meeting(own, spans, "__pa", "__pb", "t0", "t1", touch=True)
    piece = F.struct(*key, "__pa", "__pb")
    pieces_at = lambda c: own.select("clip_id", F.col(c).alias("__at"), F.lit(1).alias("__kind"), piece.alias("__p"))
    spans_at = lambda c, order: spans.select("clip_id", F.col(c).alias("__at"), F.lit(0).alias("__kind"), F.struct(*order, "speaker_id", "t0", "t1", "ipos").alias("__s"))
    sides = []
    # of equal ends the shorter interval has the closer middle, so the later start; of equal starts the earlier end
    for at, order, of, piece_end, first in (("t1", [F.col("t1").alias("o1"), F.col("t0").alias("o2"), (-F.col("ipos")).alias("o3")], F.max, "__pa", [F.asc("__at"), F.asc("__kind")]), ("t0", [F.col("t0").alias("o1"), F.col("t1").alias("o2"), F.col("ipos").alias("o3")], F.min, "__pb", [F.desc("__at"), F.asc("__kind")])):
        w = Window.partitionBy("clip_id").orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
        rows = spans_at(at, order).unionByName(pieces_at(piece_end), allowMissingColumns=True)
        best = rows.withColumn("__best", of("__s").over(w)).where("__kind = 1 and __best is not null")
        sides.append(best.select("clip_id", "__p.*", *[F.col(f"__best.{c}").alias(c) for c in given[1:]]))
    met = met.select("clip_id", *key, "__pa", "__pb", *given[1:]).unionByName(sides[0]).unionByName(sides[1])
    met = met.withColumn("gap", interval_gap(F.col("__pa"), F.col("__pb"), F.col("t0"), F.col("t1")))
    off = F.abs((F.col("t0") + F.col("t1")) * 0.5 - (F.col("__pa") + F.col("__pb")) * 0.5)
    w = Window.partitionBy("clip_id", *key).orderBy("gap", off, "ipos")
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("clip_id", *key, "speaker_id", "gap")


def overlapping(pieces: DataFrame, intervals: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, n_speakers, only) of the distinct speakers that overlap a piece; ``only`` is the smallest of them."""
    met = meeting(pieces.select("clip_id", *key, a, b), intervals, a, b, "t0", "t1").where(F.least("t1", b) > F.greatest("t0", a))
    return met.groupBy("clip_id", *key).agg(F.count_distinct("speaker_id").alias("n_speakers"), F.min("speaker_id").alias("only"))


def speakers_of(pieces: DataFrame, intervals: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, speakers): the distinct speakers that overlap a piece, in the order in which the intervals first show them."""
    met = meeting(pieces.select("clip_id", *key, a, b), positioned(intervals), a, b, "t0", "t1").where(F.least("t1", b) > F.greatest("t0", a))
    first = met.groupBy("clip_id", *key, "speaker_id").agg(F.min("ipos").alias("ipos"))
    return first.groupBy("clip_id", *key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ipos", "speaker_id"))), lambda s: s["speaker_id"]).alias("speakers"))


def _counted(pairs: DataFrame, marks: DataFrame, key: list[str], lo: Column, hi: Column, hi_too: bool) -> DataFrame:
    """Each pair with the numbers ``i`` of the marks that shut at ``lo`` or later and open before ``hi``, or at ``hi`` with ``hi_too``.

    ``marks``: ``key``, opens, shuts, both rising with the number, which counts from 0.  A
    sweep: all these times stand in one order, and running counts of what has shut and
    opened give each pair its first and last number.  ``pairs``: ``key`` and a struct ``p``
    with a number ``ipos``.
    """
    begin, shuts, opens, end = 0, 2, 3, 4 if hi_too else 1
    event = lambda at, order: F.struct(at.alias("at"), F.lit(order).alias("order"))
    both = lambda df, p, one, two: df.select(*key, p.alias("p"), F.explode(F.array(one, two)).alias("e")).select(*key, "p", "e.*")
    none = F.lit(None).cast(pairs.schema["p"].dataType)
    swept = both(pairs, F.col("p"), event(lo, begin), event(hi, end)).unionByName(both(marks, none, event(F.col("opens"), opens), event(F.col("shuts"), shuts)))
    w = Window.partitionBy(*key).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda order: F.count_if(F.col("order") == order).over(w)
    swept = swept.withColumns({"shut": of(shuts), "opened": of(opens)}).where(F.col("order").isin(begin, end))
    ends = swept.groupBy(*key, "p.ipos").agg(F.any_value("p").alias("p"), F.max(F.when(F.col("order") == begin, F.col("shut"))).alias("from"), F.max(F.when(F.col("order") == end, F.col("opened"))).alias("to"))
    return ends.where("to > from").select(*key, "p", F.explode(F.sequence("from", F.col("to") - 1)).alias("i"))


def _numbered(df: DataFrame, key: list[str], at: str) -> DataFrame:
    return df.withColumn("i", (F.row_number().over(Window.partitionBy(*key).orderBy(at)) - 1).cast("long"))


def _pairs(segments: DataFrame, intervals: DataFrame, grown: float) -> DataFrame:
    """(clip_id, pos, seg_start, seg_end, p) of the intervals that overlap a segment, touch it or lie within ``grown`` seconds of it."""
    own = segments.select("clip_id", "pos", "seg_start", "seg_end")
    met = meeting(own, positioned(intervals), F.col("seg_start") - grown, F.col("seg_end") + grown, "t0", "t1", touch=True)
    return met.select("clip_id", "pos", "seg_start", "seg_end", F.struct("speaker_id", "t0", "t1", "ipos").alias("p"))


def _switches(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """(clip_id, pos, at): of ``segments``, by their ``pairs``."""
    key = ["clip_id", "pos"]
    ends = pairs.select(*key, "seg_start", "seg_end", F.explode(F.array("p.t0", "p.t1")).alias("at"))
    inside = ends.where("at > seg_start and at < seg_end").select(*key, "at")
    times = _numbered(inside.unionByName(segments.select(*key, F.col("seg_start").alias("at"))).distinct(), key, "at")
    probe = F.col("at") + 1e-6
    marks = times.select(*key, probe.alias("opens"), probe.alias("shuts"))
    shown = _counted(pairs, marks, key, F.col("p.t0"), F.col("p.t1"), False)
    longest = F.struct((F.col("p.t1") - F.col("p.t0")).alias("long"), (-F.col("p.ipos")).alias("first"))
    shown = shown.groupBy(*key, "i").agg(F.max_by("p.speaker_id", longest).alias("speaker_id"))
    seen = times.join(shown, [*key, "i"], "left").withColumn("now", F.coalesce("speaker_id", F.lit(-2)))
    seen = seen.withColumn("before", F.lag("now").over(Window.partitionBy(*key).orderBy("at")))
    return seen.where("before is not null and before <> now").select(*key, "at")


def switch_points(segments: DataFrame, intervals: DataFrame) -> DataFrame:
    """(clip_id, pos, at): times inside a segment at which the speaker shown changes; silence is a speaker of its own."""
    return _switches(segments, stage(_pairs(segments, intervals, 1e-6), "switch-pairs"))


def assign_split(segments: DataFrame, intervals: DataFrame, most_gap: float = 0.5) -> DataFrame:
    """(clip_id, pos, t_start, t_end, speaker_id): segments given to speakers; one that several overlap is cut where the speaker changes.

    A piece goes to the only speaker that overlaps it, else to the nearest within ``most_gap``
    seconds, else to nobody.  One range join brings the intervals to the segments; what each
    piece meets is counted off along its segment.
    """
    key, grown = ["clip_id", "pos"], most_gap + 1e-5
    own = segments.select(*key, "seg_start", "seg_end")
    pairs = stage(_pairs(own, intervals, grown), "assign-pairs")  # read several times below
    over = F.least("p.t1", "seg_end") > F.greatest("p.t0", "seg_start")
    many = pairs.where(over).groupBy(*key).agg((F.min("p.speaker_id") < F.max("p.speaker_id")).alias("split")).where("split")
    told = own.join(many, key, "left")
    split = told.where("split").drop("split")
    cut = pairs.join(many.select(*key), key, "left_semi")
    ends = split.select(*key, F.explode(F.array("seg_start", "seg_end")).alias("at"))
    cuts = ends.unionByName(_switches(split, cut)).select(*key, F.round("at", 6).alias("at")).distinct()
    whole = told.where("split is null").select(*key, F.col("seg_start").alias("at"), F.col("seg_end").alias("end"))
    cuts = cuts.withColumn("end", F.lead("at").over(Window.partitionBy(*key).orderBy("at"))).where("end is not null")
    pieces = stage(_numbered(whole.unionByName(cuts), key, "at").select(*key, "i", F.col("at").alias("a"), F.col("end").alias("b")), "assign-pieces")
    near = _counted(pairs, pieces.select(*key, F.col("a").alias("opens"), F.col("b").alias("shuts")), key, F.col("p.t0") - grown, F.col("p.t1") + grown, True)
    met = near.join(pieces, [*key, "i"])
    gap = interval_gap(F.col("a"), F.col("b"), F.col("p.t0"), F.col("p.t1"))
    off = F.abs((F.col("p.t0") + F.col("p.t1")) * 0.5 - (F.col("a") + F.col("b")) * 0.5)
    over = F.when(F.least("p.t1", "b") > F.greatest("p.t0", "a"), F.col("p.speaker_id"))
    near = met.groupBy(*key, "i").agg(F.min(over).alias("least"), F.max(over).alias("most"), F.min(F.struct(gap.alias("gap"), off.alias("off"), "p.ipos", "p.speaker_id")).alias("near"))
    speaker = F.when(F.col("least") == F.col("most"), F.col("least")).when(F.col("near.gap") <= most_gap, F.col("near.speaker_id")).otherwise(NOBODY)
    done = pieces.join(near, [*key, "i"], "left")
    return done.where((F.col("b") - F.col("a") >= 1e-4)).select(*key, F.col("a").alias("t_start"), F.col("b").alias("t_end"), speaker.alias("speaker_id"))


def segment_frames(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """clip_id, frame_idx inside any segment: the start is cut off, the end rounded half to even."""
    lo = F.greatest(F.lit(0), (F.col("seg_start") * F.col("fps")).cast("int"))
    hi = F.least(F.col("n_frames"), F.bround(F.col("seg_end") * F.col("fps")).cast("int"))
    bounds = segments.join(clips, "clip_id").select("clip_id", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    return bounds.select("clip_id", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("frame_idx")).distinct()


def clip_to_windows(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments cut to the windows (clip_id, chunk_id, w0, w1) and counted from each window's start."""
    met = meeting(segments, windows, "seg_start", "seg_end", "w0", "w1")
    a, b = F.greatest("seg_start", "w0") - F.col("w0"), F.least("seg_end", "w1") - F.col("w0")
    return met.select("clip_id", "chunk_id", "pos", a.alias("seg_start"), b.alias("seg_end"), "gender").where("seg_end > seg_start")


def chunk_plan(clips: DataFrame, seconds: float) -> DataFrame:
    """clip_id, chunk_id, start_frame, frame_count, start_sec, duration_sec: equal chunks, the last one shorter."""
    step = F.greatest(F.lit(1), F.bround(F.col("fps") * seconds).cast("int"))
    rows = clips.where("n_frames > 0").withColumn("step", step).withColumn("start_frame", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1, F.col("step"))))
    count = F.least(F.col("step"), F.col("n_frames") - F.col("start_frame"))
    return rows.select("clip_id", (F.col("start_frame") / F.col("step")).cast("int").alias("chunk_id"), "start_frame", count.alias("frame_count"), (F.col("start_frame") / F.col("fps")).alias("start_sec"), (count / F.col("fps")).alias("duration_sec"))


def effective_frames(video_frames: Column, audio_seconds: Column, fps: Column) -> Column:
    return F.greatest(F.lit(1), F.least(video_frames, F.floor(audio_seconds * fps + 1e-9))).cast("int")


def even_sample(start: Column, end: Column, most: int = 8) -> Column:
    """At most ``most`` frames spread evenly over a run, half to even, without repetition."""
    n = end - start + 1
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(start + (end - start) * i / float(most - 1)).cast("int")))
    return F.when(n <= most, F.sequence(start.cast("int"), end.cast("int"))).otherwise(spread)


def gender_vote(genders: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gender): the majority of male and female; null on a tie or without votes."""
    m, f = F.count_if(F.col("gender") == "male"), F.count_if(F.col("gender") == "female")
    return genders.groupBy(*keys).agg(F.when(m > f, "male").when(f > m, "female").alias("gender"))
