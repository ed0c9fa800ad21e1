"""Prediction documents as a data source, and sinks whose batches come twice."""

import json

import pytest
from pyspark.sql import functions as F

from roadgrain.sources import documents, sinks
from roadgrain.sources.prediction_source import read_predictions


def test_documents_by_name_with_pushed_filters(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    good = {"team": "t", "videos": {"a.mp4": {"events": [[1, 2.5, "congestion"], [3, 4, "wrong_way"]], "risk": []}, "b.mp4": {"events": [[0, 9, "jaywalking"], [1, "x", "jaywalking"], [1, 2], [1, 2, 3], [True, 2, "jaywalking"]]}, "c.mp4": {"risk": []}, "d.mp4": None}}
    (folder / "good.json").write_text(json.dumps(good))
    (folder / "twice.json").write_text('{"videos": {"a.mp4": {"events": []}, "a.mp4": {"events": []}}}')
    (folder / "nan.json").write_text('{"videos": {"a.mp4": {"events": [[NaN, 1, "congestion"]]}}}')
    (folder / "half.json").write_text('{"videos": {"a')
    (folder / "bytes.json").write_bytes(b"\xff\xfe\x00{")
    (folder / "list.json").write_text("[1, 2]")
    (folder / "empty.json").write_text('{"videos": {}}')
    (folder / "_note.json").write_text("not read")
    rows = read_predictions(spark, str(folder))
    got = rows.collect()
    events = {(r["video_id"], r["pos"], r["start"], r["end"], r["label"]) for r in got if r["problem"] is None}
    assert events == {("a.mp4", 0, 1.0, 2.5, "congestion"), ("a.mp4", 1, 3.0, 4.0, "wrong_way"), ("b.mp4", 0, 0.0, 9.0, "jaywalking")}
    bad = {(r["file"].split("/")[-1], r["video_id"], r["pos"]) for r in got if r["problem"]}
    assert bad == {("good.json", "b.mp4", k) for k in (1, 2, 3, 4)} | {("good.json", v, None) for v in ("c.mp4", "d.mp4")} | {(f, None, None) for f in ("twice.json", "nan.json", "half.json", "bytes.json", "list.json")} and len(got) == 14
    only = rows.where("video_id = 'a.mp4' and start > 2").where(F.col("video_id").isin("a.mp4", "z"))
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "start" in plan.split("Filter ")[1].split("\n")[0] and "a.mp4" not in plan.split("Filter ")[1].split("\n")[0]
    assert [(r["video_id"], r["pos"]) for r in only.collect()] == [("a.mp4", 1)]
    assert rows.where("video_id = 'nobody'").count() == 0 and rows.where("video_id is null").count() == 5
    with pytest.raises(Exception, match="gone"):
        read_predictions(spark, str(tmp_path / "gone")).collect()


def test_written_documents_are_read_back(spark, tmp_path):
    seg = spark.range(500).selectExpr("concat('v', id % 20) as video_id", "'wrong_way' as label", "cast(id as double) as start", "id + 1.5 as `end`")
    docs = documents.prediction_documents(seg, seg.selectExpr("video_id", "start as t_sec", "0.5d as score").where("false"), seg.select("video_id").distinct(), "team")
    documents.write_documents(docs, str(tmp_path / "out"))
    back = read_predictions(spark, str(tmp_path / "out")).where("problem is null").select("video_id", "label", "start", "end")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seg.collect()))


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "video_id string, frame_idx long"
    rows = lambda *f: spark.createDataFrame([("v", x) for x in f], schema)
    seen = lambda: sorted(r["frame_idx"] for r in sinks.read_table(spark, path, schema).collect())
    assert seen() == []
    put = sinks.once(path, "q")
    put(rows(1, 2), 0)
    put(rows(1, 2), 0)
    assert seen() == [1, 2]
    # a batch that fails after its rows are written, before its line is
    broken = sinks.once(path, "q", lambda df, folder: (df.write.parquet(folder), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        broken(rows(3, 4), 1)
    assert seen() == [1, 2]
    put(rows(3, 4), 1)
    put(rows(5), 2)
    sinks.once(path, "other")(rows(6), 0)  # another query's ids are its own
    assert seen() == [1, 2, 3, 4, 5, 6] and put(rows(5), 2) is None and seen() == [1, 2, 3, 4, 5, 6]
    for k in range(3, 12):
        put(rows(10 + k), k)
    assert len(seen()) == 15 and len(list((tmp_path / "table" / sinks.LEDGER).iterdir())) == sinks.KEPT + 1


def test_a_stream_restarted_from_an_old_checkpoint(spark, tmp_path):
    import shutil

    src, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "video_id string, frame_idx long"
    def run(check):
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(sinks.once(path, "tracks")).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
    for k in range(2):
        spark.createDataFrame([("v", k)], schema).coalesce(1).write.mode("append").parquet(src)
    run(str(tmp_path / "check"))
    shutil.copytree(tmp_path / "check", tmp_path / "old")
    spark.createDataFrame([("v", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    run(str(tmp_path / "check"))
    for name in ("2", ".2.crc"):  # as if the last commit had been lost: that batch is run again
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    run(str(tmp_path / "check"))
    assert sorted(r["frame_idx"] for r in sinks.read_table(spark, path, schema).collect()) == [0, 1, 2]
