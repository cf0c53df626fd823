"""Timeline tables built from the ``events`` table, and the text and JSON sources of real ones.

The stand-ins play a clip with each user and a frame with each of their events, so that
every operator runs on data that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("clip_id"),
        (F.row_number().over(order) - 1).alias("frame_idx"),
        "event_type",
        (F.floor(F.least("value", F.lit(100.0))) / 100.0).alias("open_prob"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_idx, shot_id, valid_face, open_prob, mar, x1, y1, x2, y2; boxes and scores are null without a face."""
    face = F.col("event_type") != "error"
    step = F.floor(F.col("frame_idx") / 8)

    def seen(x: Column) -> Column:
        return F.when(face, x)

    k = F.col("k")
    return base(spark, sf_dir).select(
        "clip_id",
        "frame_idx",
        F.floor(F.col("frame_idx") / 16).cast("int").alias("shot_id"),
        face.alias("valid_face"),
        seen(F.col("open_prob")).alias("open_prob"),
        seen(k / 100.0).alias("mar"),
        seen((30 * step + k % 5).cast("double")).alias("x1"),
        seen((20 + k % 7).cast("double")).alias("y1"),
        seen((30 * step + k % 5 + 40).cast("double")).alias("x2"),
        seen((20 + k % 7 + 40).cast("double")).alias("y2"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech segments: clip_id, pos, seg_start, seg_end, gender."""
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    gender = F.when(F.col("k") % 3 == 0, "male").when(F.col("k") % 3 == 1, "female")
    return base(spark, sf_dir).where("event_type = 'view'").select(
        "clip_id",
        (F.row_number().over(order) - 1).alias("pos"),
        (F.col("frame_idx") / 25.0).alias("seg_start"),
        ((F.col("frame_idx") + 2 + F.col("k") % 9) / 25.0).alias("seg_end"),
        gender.alias("gender"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual intervals: clip_id, speaker_id, t0, t1."""
    return base(spark, sf_dir).where("event_type = 'click'").select(
        "clip_id",
        (F.col("k") % 3).alias("speaker_id"),
        (F.col("frame_idx") / 25.0).alias("t0"),
        ((F.col("frame_idx") + 1 + F.col("k") % 6) / 25.0).alias("t1"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip_id")).agg(F.lit(25.0).alias("fps"), F.count("*").cast("int").alias("n_frames"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes for each frame with a face."""
    offsets = F.array(*[F.struct(F.lit(i).alias("track_id"), F.lit(dx).alias("dx")) for i, dx in enumerate((0.0, 12.0, 60.0))])
    rows = frames(spark, sf_dir).where("valid_face").withColumn("t", F.explode(offsets))
    return rows.select("clip_id", "frame_idx", "shot_id", F.col("t.track_id").alias("track_id"), "open_prob", *[(F.col(c) + F.col("t.dx")).alias(c) if c[0] == "x" else F.col(c) for c in ("x1", "y1", "x2", "y2")])


def read_manifest(spark: SparkSession, path: str, root: str, repeat: int = 1, header: bool = False) -> DataFrame:
    """First word of each line, joined to ``root``, given ``repeat`` times; blank lines are left out, and with ``header`` the first line of every file."""
    # one column of whole lines: neither separator nor quote occurs in a text line
    lines = spark.read.schema("value string").csv(path, sep="\u0001", quote="", escape="", header=header, maxCharsPerColumn=-1)
    lines = lines.withColumn("value", F.trim("value")).where("value <> ''")
    name = F.split("value", r"\s+")[0]
    return lines.select(F.concat_ws("/", F.lit(root.rstrip("/")), name).alias("path"), F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("copy"))


def packed_files(spark: SparkSession, folder: str, glob: str | None = None, task_bytes: int = 64 << 20, task_files: int = 1000, bare: bool = False) -> DataFrame:
    """(path, length, content) of all files below a folder, whole, many small ones to a task.

    ``glob`` is held against the files' names where they are listed, so no other file is
    opened; ``bare`` leaves the content out, and then none is.  Tasks get ``task_files`` files or
    ``task_bytes`` bytes at most, about; a larger file is a task of its own.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    if bare:
        return files.select("path", "length")
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()  # lengths are in the listing
    parts = max(1, -(-size["n"] // task_files), -(-size["bytes"] // task_bytes))
    return files.select("path", "length", "content").coalesce(parts)


#: The metadata that a clip's JSON file holds.
CLIP_METADATA = "mp4_path string, wav_path string, video_size array<int>, face_size array<int>, frames int, face_list array<array<int>>, landmark_list array<array<array<int>>>, isvalid boolean"


def read_json_files(spark: SparkSession, folder: str, kind: str, glob: str = "*.json", **packing) -> DataFrame:
    """One row a file, a JSON object each: ``path``, the columns of the DDL text ``kind``, and ``error``, why a file is not one.

    Files that are no JSON object, or hold a value of another kind, are rows with their error and
    with what could be read; none of them ends the job.  A file without a single byte has no row,
    as Spark leaves it out where it lists.
    """
    text = F.col("content").cast("string")
    got = F.from_json(text, f"{kind}, `__bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    read = packed_files(spark, folder, glob, **packing).select("path", text.alias("__text"), got.alias("__r"))
    bad = F.col("__r").isNull() | F.col("__r.__bad").isNotNull()
    why = F.when(F.trim("__text", F.lit(" \t\r\n")) == "", "the file is blank").when(bad, F.concat(F.lit("not the expected JSON: "), F.substring("__text", 1, 80)))
    return read.withColumn("error", why).select("path", "__r.*", "error").drop("__bad")


def read_clip_metadata(spark: SparkSession, folder: str, **packing) -> DataFrame:
    """The clips' metadata, one JSON file a clip, with ``path`` and ``error``."""
    return read_json_files(spark, folder, CLIP_METADATA, **packing)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentence lists in milliseconds to segments in seconds."""
    got = spark.read.schema("sentence_list array<struct<start:double,end:double>>").json(path, multiLine=True)
    return got.select(F.explode("sentence_list").alias("s")).select((F.col("s.start") / 1000).alias("seg_start"), (F.col("s.end") / 1000).alias("seg_end"))


def list_files(spark: SparkSession, folder: str, endings: list[str]) -> DataFrame:
    """Paths below a folder with one of the endings, in any case, sorted; no file is opened."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings) + "}"
    return packed_files(spark, folder, glob, bare=True).orderBy("path")


def write_resumable(df: DataFrame, done: DataFrame | None, key: str, path: str) -> None:
    """Appends the rows whose key is not in ``done``, as JSON lines; for one file a key, see `named.write`."""
    todo = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    todo.write.mode("append").json(path)


def write_lists(names: DataFrame, key: str, column: str, path: str) -> None:
    """One file a key, named ``key``.txt: a name a line, in order, each once.  A key's list fits a row; files that are there stay."""
    lists = names.groupBy(F.col(key).cast("string").alias("k")).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), "\n").alias("l"))
    named.write(lists, F.concat("k", F.lit(".txt")), F.concat("l", F.lit("\n")), path)
