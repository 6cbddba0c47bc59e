"""Streams in several batches: errors beside tracks, bounded state, a log that is merged."""

import pandas as pd
from pyspark.sql import functions as F

from cuesheet.streaming import streams


def payload(i, text):
    return f'{{"commentEntityPayload":{{"properties":{{"content":{{"content":"{text}"}}}}}}}}' if text else "{broken"


def test_broken_payloads_are_rows_of_their_batch(spark, tmp_path):
    good = "0:01:00 a / b\\n0:02:00 c / d"
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for batch in range(3):
        rows = [(f"v{batch}", "comments", 0, payload(0, good)), (f"w{batch}", "replies", batch, payload(0, "")),
                (f"x{batch}", "initial", 0, "nothing"), (f"y{batch}", "comments", 1, None)]
        spark.createDataFrame(rows, streams.PAYLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # a second run finds nothing new
        tracks, errors = streams.stream_tracks(spark, src, out, ckpt, files_per_batch=1)
        assert sorted((r.yt_id, r.song) for r in tracks.collect()) == [(f"v{i}", s) for i in range(3) for s in "ac"]
        told = sorted((r.yt_id, r.part, r.part_pos, r.error) for r in errors.collect())
        assert told == sorted(
            [(f"w{i}", "replies", i, "not valid JSON") for i in range(3)]
            + [(f"x{i}", "initial", 0, "not valid JSON") for i in range(3)]
        )
        assert errors.select("batch_id").distinct().count() == 3


def test_one_file_of_payloads_is_walked_by_all_cores(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = [(f"v{i}", "comments", i, "no json") for i in range(60)]
    spark.createDataFrame(rows, streams.PAYLOAD_SCHEMA).coalesce(1).write.parquet(src)
    _, errors = streams.stream_tracks(spark, src, out, ckpt)
    assert sorted(r.part_pos for r in errors.collect()) == list(range(60))
    walked = list((tmp_path / "out/found/batch_id=0").glob("part-*.parquet"))
    assert len(walked) == spark.sparkContext.defaultParallelism > 1


def test_copies_between_the_ends_go_before_the_state():
    frame = pd.DataFrame(
        [("v", "s", 3, "c"), ("v", "s", 1, "a"), ("v", "s", 2, "b"), ("v", "t", 9, "d"), ("w", "s", 5, "e"),
         ("v", None, 1, "f"), ("v", None, 1, "g")],
        columns=["video_id", "sig", "ts", "id"],
    )
    assert sorted(streams._ends_of_copies(frame, "ts")["id"]) == list("acdefg")


def test_keys_leave_the_state_behind_the_bound(spark, tmp_path):
    """The same list: again in its batch, within the bound, behind it, and late."""
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    batches = [
        [("v", "01. a", day(1)), ("v", "02. a", day(1)), ("z", "m", day(2))],
        [("v", "01. A", day(2)), ("z", "n", day(10))],  # the bound has not passed
        [("z", "o", day(11))],
        [("v", "01. a", day(12)), ("v", "01. late", day(3)), ("z", "p", day(13))],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "video_id string, message string, ts string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("video_id string, message string, ts timestamp").parquet(src)
        once = streams.stream_dedupe(stream, delay="2 days")
        streams.run_available(once.writeStream.format("parquet").option("path", out), ckpt)
    kept = spark.read.schema(once.schema).parquet(out).where("video_id = 'v'").select("message", "ts").collect()
    assert sorted((r.message, str(r.ts)[:10]) for r in kept) == [("01. a", "2024-01-01"), ("01. a", "2024-01-12")]


def test_log_of_batches_is_merged_and_survives_a_rerun(spark, tmp_path):
    out = str(tmp_path / "out")
    shape = spark.createDataFrame([], "k string, n bigint").schema
    latest = lambda **more: sorted(
        tuple(r) for r in streams.latest_values(spark, shape, ["k"], "n", out, merge_every=2, **more).collect()
    )
    log = [[("a", 1), ("b", 1)], [("a", 2)], [("c", 5)], [("b", 7)], [("a", 9)]]

    def put(batch):
        folder = f"{out}/log/batch_id={batch}"
        spark.createDataFrame(log[batch], shape).write.mode("overwrite").parquet(folder)
        if batch % 2:
            merged = streams.latest_values(spark, shape, ["k"], "n", out, upto=batch, merge_every=2)
            merged.write.mode("overwrite").parquet(f"{out}/version/upto={batch}")

    assert latest() == []
    for batch in (0, 1, 2, 3, 3, 4):  # one batch and its merge run again
        put(batch)
    assert latest() == [("a", 9), ("b", 7), ("c", 5)]
    assert latest(upto=1) == [("a", 2), ("b", 1)]
    spark.createDataFrame(log[0], shape).write.mode("overwrite").parquet(f"{out}/log/batch_id=0")
    assert latest() == [("a", 9), ("b", 7), ("c", 5)]
    read = streams.latest_values(spark, shape, ["k"], "n", out, merge_every=2).inputFiles()
    assert all("batch_id=4" in f or "upto=3" in f for f in read)  # no batch that is merged already


def test_upgrades_of_many_videos_need_no_call_per_video(spark, tmp_path):
    """Three deliveries: published counts carry over, late versions come behind what is out."""
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = streams.upgrade_schema()
    batches = [
        [(1, 10, 0), (1, 11, 1), (1, 12, 3), (2, 20, 2), (3, 30, 5), (4, 40, 1), (4, 41, 4), (6, 60, 0), (7, 70, 1)],
        [(1, 13, 4), (1, 14, 9), (2, 21, 4), (3, 31, 9), (4, 42, 9), (5, 50, 2), (5, 51, 5), (6, 61, None)],
        [(2, 22, 5), (2, 19, 6), (6, 62, 2), (None, 1, 1), (7, 69, 4), (7, 71, 5)],
    ]
    for rows in [*batches, []]:  # the last run finds nothing new
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        found = streams.stream_upgrades(spark.readStream.schema(schema).parquet(src), out, ckpt)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([
        (1, 11, 1), (1, 13, 4), (2, 20, 2), (2, 19, 6), (3, 30, 5), (4, 40, 1), (4, 41, 4), (5, 50, 2),
        (5, 51, 5), (6, 62, 2), (None, 1, 1), (7, 70, 1), (7, 69, 4),
    ], key=str)
    plan = streams.upgrades_of(found, found)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
