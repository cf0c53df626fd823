"""Small files in, named files out."""

import json

import pytest
from pyspark.sql import functions as F

from frameline.sources import named
from frameline.sources import timeline as T


def test_many_small_files_in_few_tasks(spark, tmp_path):
    for d in range(5):
        (tmp_path / f"d{d}").mkdir()
        for i in range(1000):
            (tmp_path / f"d{d}" / f"{i}.json").write_text(json.dumps({"frames": i, "mp4_path": f"{d}-{i}.mp4"}))
    (tmp_path / "d0" / "blank.json").write_text("\n")
    (tmp_path / "d0" / "cut.json").write_text('{"frames": 7, "mp4')
    (tmp_path / "d0" / "kind.json").write_text('{"frames": "many", "isvalid": true}')
    (tmp_path / "d0" / "notes.txt").write_text("not read")
    got = T.read_clip_metadata(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 20
    rows = got.select("path", "frames", "isvalid", "error").collect()
    assert len(rows) == 5003 and sum(r.frames for r in rows if r.error is None) == 5 * 999 * 500
    bad = {r.path.rsplit("/")[-1]: r for r in rows if r.error}
    assert set(bad) == {"blank.json", "cut.json", "kind.json"} and bad["blank.json"].error == "the file is blank"
    assert bad["kind.json"].isvalid is True and bad["kind.json"].frames is None and '"many"' in bad["kind.json"].error
    big = T.packed_files(spark, str(tmp_path), "*.json", task_files=100)
    assert 30 <= big.rdd.getNumPartitions() <= 60 and T.packed_files(spark, str(tmp_path), "*.txt").count() == 1
    assert [r.path.rsplit("/")[-1] for r in T.list_files(spark, str(tmp_path), ["TXT"]).collect()] == ["notes.txt"]


def test_manifests_with_a_header_each(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text(f"name size\n{k}.mp4 \"1\n\n  x{k}.mp4\t2\n")
    got = T.read_manifest(spark, str(tmp_path), "/data", header=True).collect()
    assert sorted(r.path for r in got) == sorted(f"/data/{x}{k}.mp4" for k in range(3) for x in ("", "x"))
    assert T.read_manifest(spark, str(tmp_path), "/data").count() == 9


def contents(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([(f"clip-{i}.json", f"text {i}") for i in range(20)], "n string, c string")
    out = tmp_path / "out"
    named.write(df.where("n < 'clip-13'"), F.col("n"), F.col("c"), str(out))
    first = contents(out)
    assert len(first) == df.where("n < 'clip-13'").count() and not any(n.startswith("_") for n in first)
    named.write(df.withColumn("c", F.lit("new")), F.col("n"), F.col("c"), str(out))  # what is there stays
    assert contents(out) == {f"clip-{i}.json": "new" for i in range(20)} | first
    named.write(spark.createDataFrame([("clip-20.json", "a"), ("clip-20.json", "a"), ("other.json", "b"), ("step-3.pt", "c")], "n string, c string").repartition(3), F.col("n"), F.col("c").cast("binary"), str(out), keep=4)
    assert contents(out) == {"clip-20.json": "a", "clip-19.json": "new", "clip-18.json": "new", "clip-17.json": "new", "other.json": "b", "step-3.pt": "c"}
    with pytest.raises(Exception, match="never writes over"):
        df.write.format("named_files").mode("overwrite").save(str(out))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    named.write(spark.createDataFrame([("a-1", "x"), ("a-2", "x")], "n string, c string"), F.col("n"), F.col("c"), str(out))
    rows = spark.createDataFrame([(f"a-{i}", "y") for i in range(3, 40)] + [("bad/name", "y")], "n string, c string").repartition(4)
    with pytest.raises(Exception, match="not a name"):
        named.write(rows, F.col("n"), F.col("c"), str(out), keep=1)
    assert contents(out) == {"a-1": "x", "a-2": "x"}  # no new file, no folder of the job, and nothing was removed
    assert named.to_go(["m-9.pt", "m-10.pt", "m-2.pt", "best.pt", "n-1.pt"], 2) == ["m-2.pt"]


def test_lists(spark, tmp_path):
    rows = spark.createDataFrame([("train", "b"), ("train", "a"), ("train", "b"), ("test", "c")], "part string, name string")
    T.write_lists(rows, "part", "name", str(tmp_path / "lists"))
    assert contents(tmp_path / "lists") == {"train.txt": "a\nb\n", "test.txt": "c\n"}
