"""Streams give what the same rows give at once."""

from pyspark.sql import functions as F

from frameline.operators import boxes, scans, tracking
from frameline.sources import timeline as T
from frameline.streaming import faces as C
from frameline.streaming import sinks
from frameline.streaming import timeline as S

SF = "/root/testdata/sf0.001"


def drained(df, name, tmp_path, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(240)
    return df.sparkSession.table(name)


def test_window_totals(spark, tmp_path):
    events = T.table(spark, SF, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = drained(S.window_totals(S.read_events(spark, str(tmp_path / "in")), late="3650 days"), "totals", tmp_path, "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert got.agg(F.sum("n_open")).first()[0] == events.where("value >= 15").count()


def test_shot_numbers_over_batches(spark, tmp_path):
    rows = T.base(spark, SF).select("clip_id", "frame_idx", "event_type")
    for k, part in enumerate(("frame_idx < 20", "frame_idx between 20 and 39", "frame_idx >= 40")):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = S.read_events(spark, str(tmp_path / "frames"), files_a_batch=1)
    got = drained(S.number_shots(stream, F.col("event_type") == "purchase", 5), "shots", tmp_path, "append")
    want = scans.number_shots(rows, F.col("event_type") == "purchase", 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_left_out(spark, tmp_path):
    """Rows that come later than the watermark allows do not count; those that come in time do."""
    kind = "user_id bigint, ts timestamp, value double"
    at = lambda m: f"2026-01-01 {m // 60:02d}:{m % 60:02d}:00"
    folder = tmp_path / "in"
    for k, minutes in enumerate(([0, 5], [200], [201], [1, 190])):  # the mark that batch 2 sets holds for rows from batch 4 on
        part = spark.createDataFrame([(1, at(m), 20.0) for m in minutes], "user_id bigint, ts string, value double")
        part.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = drained(S.window_totals(stream, length="10 minutes", late="30 minutes"), "late", tmp_path, "append").collect()
    counts = {r.start.strftime("%H:%M"): r.n for r in got}
    assert counts.get("00:00") == 2  # the late row is not in it


def given_faces(spark):
    """Frames with their boxes, in three parts that cut shots in the middle."""
    rows = T.frames(spark, SF)
    tracks = T.tracks(spark, SF).where("track_id < 2")
    box = F.struct(*[F.col(c) for c in boxes.BOX])
    seen = tracks.groupBy("clip_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_id", box.alias("b")))), lambda s: s["b"]).alias("boxes"))
    given = rows.select("clip_id", "frame_idx", "shot_id").join(seen, ["clip_id", "frame_idx"], "left").withColumn("at", F.timestamp_seconds(F.col("frame_idx") + 10**6)).cache()
    return given, tracks.withColumnRenamed("track_id", "det_id"), rows


def one_pass(dets, rows, got):
    """Rows of the stream and of one pass, without the look at a clip's last frame."""
    last = {r.clip_id: r.m for r in rows.groupBy("clip_id").agg(F.max("frame_idx").alias("m")).collect()}
    clean = lambda df: sorted(tuple(r) for r in df.collect() if r.frame_idx < last[r.clip_id])
    return clean(got), clean(tracking.track_many(dets, rows))


def test_faces_over_a_restart(spark, tmp_path):
    """A stream that stops in the middle of shots and starts again from its checkpoint gives the rows of one pass."""
    C.use_rocksdb(spark)
    given, dets, rows = given_faces(spark)
    for part in ("frame_idx < 20", "frame_idx between 20 and 39", "frame_idx >= 40"):
        given.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        followed = C.follow_faces(S.read_events(spark, str(tmp_path / "in"), files_a_batch=1), at="at", late="0 seconds", idle_ms=10**9)
        query = followed.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(sinks.once(str(tmp_path / "out"))).start()
        query.awaitTermination(240)
        assert query.exception() is None and not query.isActive
    got, want = one_pass(dets, rows, sinks.written(spark, str(tmp_path / "out")).drop("batch"))
    assert got == want and len(got) > 100


def test_idle_clips_are_forgotten(spark, tmp_path):
    C.use_rocksdb(spark)
    kind = "clip_id bigint, frame_idx int, shot_id int, boxes array<struct<x1: double, y1: double, x2: double, y2: double>>, at timestamp"
    at = lambda s: F.timestamp_seconds(F.lit(10**6 + s))
    one = lambda clip, frame, s: spark.range(1).select(F.lit(clip).cast("long").alias("clip_id"), F.lit(frame).alias("frame_idx"), F.lit(0).alias("shot_id"), F.array(F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(boxes.BOX, (0, 0, 9, 9))])).alias("boxes"), at(s).alias("at"))
    # clip 1 pauses while clip 2 moves the watermark on; its track goes on with number 0 if it is remembered, as a new clip's if not
    for rows in (one(1, 0, 0).unionAll(one(2, 0, 0)), one(2, 1, 1000), one(2, 2, 1001), one(1, 1, 1002), one(2, 3, 1003)):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, idle in (("kept", 10**9), ("gone", 5000)):
        got = drained(C.follow_faces(stream(), stride=2, at="at", late="1 second", idle_ms=idle), name, tmp_path, "append").collect()
        rows = sorted((r.clip_id, r.frame_idx, r.track_id) for r in got)
        assert rows == [(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)]
    # remembered, the frame after the pause is the second one and holds; forgotten, it is a first one
    state = spark.read.format("statestore").option("stateVarName", "clip").load(str(tmp_path / "kept")).select("key.clip_id", "value.seen").collect()
    assert {(r[0], r[1]) for r in state} == {(1, 2), (2, 4)}
    state = spark.read.format("statestore").option("stateVarName", "clip").load(str(tmp_path / "gone")).select("key.clip_id", "value.seen").collect()
    assert (1, 2) not in {(r[0], r[1]) for r in state}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    put = sinks.once(str(tmp_path / "out"))
    first, other = spark.range(5), spark.range(100, 107)
    put(first, 0)
    put(other, 0)  # the same batch again, with other rows: what is written stays
    (tmp_path / "out" / "batch=1").mkdir()
    (tmp_path / "out" / "batch=1" / "part-half.parquet").write_bytes(b"half")  # what a failed attempt left
    assert sinks.written(spark, str(tmp_path / "out")).count() == 5
    put(other, 1)
    got = {(r.batch, r.id) for r in sinks.written(spark, str(tmp_path / "out")).collect()}
    assert got == {(0, i) for i in range(5)} | {(1, i) for i in range(100, 107)}


def test_the_last_frame_is_written(spark, tmp_path):
    rows = T.base(spark, SF).select("clip_id", "frame_idx")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = S.read_events(spark, str(tmp_path / "in"), files_a_batch=1)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(sinks.once(str(tmp_path / "out"))).start().awaitTermination(240)
    got = sinks.written(spark, str(tmp_path / "out"))
    assert sorted((r.clip_id, r.frame_idx) for r in got.collect()) == sorted(map(tuple, rows.collect())) and got.select("batch").distinct().count() == 4
