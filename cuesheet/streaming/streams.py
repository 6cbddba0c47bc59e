"""Structured Streaming forms: ingest, upgrade detection, duplicate messages, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sets import normalize_display, with_signature
from ..operators.text import classify_songlist_comments
from ..operators.tracks import explode_tracks, parse_setlists
from ..sources.bronze import PAYLOAD_SCHEMA, bad_payloads, walk_payloads

STREAMED_TRACK = (
    "yt_id STRING, part STRING, part_pos INT, comment_id BIGINT, item_pos INT, num INT, secs INT, "
    "label STRING, song STRING, artist STRING"
)
STREAMED_ERROR = "yt_id STRING, part STRING, part_pos INT, error STRING"


def run_available(writer, checkpoint: str):
    """Process everything that is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# --- R1 ingest -----------------------------------------------------------------------------


def tracks_of_findings(found: DataFrame) -> DataFrame:
    """Walked payloads to track rows; one payload at a time, no shuffle."""
    comments = found.where((F.col("kind") == "comment") & (F.col("part") != "initial"))
    listed = classify_songlist_comments(comments).where("is_songlist")
    texts = listed.select(
        "yt_id", "part", "part_pos", F.col("ordinal").cast("bigint").alias("comment_id"), "text"
    )
    return explode_tracks(normalize_display(parse_setlists(texts)))


def tracks_of_payloads(payloads: DataFrame) -> DataFrame:
    """Raw payloads to track rows; broken payloads are rows of ``bronze.bad_payloads``."""
    return tracks_of_findings(walk_payloads(payloads, ("comment",)))


def _spread(batch: DataFrame) -> DataFrame:
    """The payloads of few files over all cores: to walk and parse one costs far more than to move it."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(cores) if batch.rdd.getNumPartitions() < cores else batch


def stream_tracks(
    spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Read each new payload file once; returns the tables of tracks and of broken payloads.

    A batch has two sinks. Its payloads are walked once, and what was found is written to the
    batch's folder; tracks and errors (``yt_id, part, part_pos, error``) are taken from there.
    A batch that runs again after a failure overwrites its own folders.
    """
    payloads = (
        spark.readStream.schema(PAYLOAD_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(table: DataFrame, kind: str) -> DataFrame:
            folder = f"{out}/{kind}/batch_id={batch_id}"
            table.write.mode("overwrite").parquet(folder)
            return batch.sparkSession.read.schema(table.schema).parquet(folder)

        found = put(walk_payloads(_spread(batch), ("comment", "error")), "found")
        put(tracks_of_findings(found), "tracks")
        put(bad_payloads(found), "errors")

    run_available(payloads.writeStream.foreachBatch(write), checkpoint)
    read = lambda kind, shape: spark.read.schema(f"{shape}, batch_id BIGINT").parquet(f"{out}/{kind}")
    return read("tracks", STREAMED_TRACK), read("errors", STREAMED_ERROR)


# --- R2 upgrades ----------------------------------------------------------------------------

STEP = 3  # fixed value: an own list this long is final, an upgrade must add this many


def upgrade_schema(key: str = "BIGINT") -> str:
    """Columns of :func:`stream_upgrades` for a key of the given type."""
    return f"video_id {key}, version BIGINT, song_count INT"


def upgrades_of(rows: DataFrame, published: DataFrame, step: int = STEP) -> DataFrame:
    """Versions among ``rows`` worth publishing behind the ``published`` ones.

    Per video only the first version at each threshold can matter: the published count is 0
    to ``step`` - 1 whenever a row matters, so only 1 and ``step`` + 1 .. 2 ``step`` - 1 are
    thresholds. Combined before the shuffle, they make a video with very many versions a few
    numbers per task.
    """
    found = F.struct(F.col("version").isNull().alias("late"), "version", "song_count")
    first = lambda least: F.min(F.when(F.col("song_count") >= least, found))
    firsts = rows.groupBy("video_id").agg(
        first(1).alias("_new"), *[first(n + step).alias(f"_from{n}") for n in range(1, step)]
    )
    counts = published.groupBy(F.col("video_id").alias("_id")).agg(F.max("song_count").alias("_count"))
    known = firsts.join(counts, F.col("video_id").eqNullSafe(F.col("_id")), "left")
    new = F.when(F.col("_count").isNull(), F.col("_new"))
    longer = F.lit(None)
    for n in range(1, step):
        longer = F.when(F.coalesce(F.col("_count"), new["song_count"]) == n, F.col(f"_from{n}")).otherwise(longer)
    chosen = known.select("video_id", F.explode(F.array(new, longer)).alias("_v")).where(F.col("_v").isNotNull())
    return chosen.select("video_id", "_v.version", "_v.song_count")


def _published(spark: SparkSession, schema: str, out: str, before: int | None = None) -> DataFrame:
    """Published versions of the batches before ``before`` (all, if not given)."""
    batches = [int(f.name.split("=")[1]) for f in _folders(spark, out)]
    paths = [f"{out}/batch_id={b}" for b in batches if before is None or b < before]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_upgrades(setlists: DataFrame, out: str, checkpoint: str, step: int = STEP) -> DataFrame:
    """Versions of a video worth publishing: the first list, then one clearly longer.

    State per video is the published count, and the published versions themselves hold it:
    a batch joins its videos with them and writes its own to ``out/batch_id=N``, all videos
    at once. A batch that runs again after a failure looks at the batches before it only and
    overwrites its own folder.
    """
    schema = upgrade_schema(setlists.schema["video_id"].dataType.simpleString())

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("video_id", "version", F.col("song_count").cast("int"))
        earlier = _published(batch.sparkSession, schema, out, before=batch_id)
        upgrades_of(rows, earlier, step).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available(setlists.writeStream.foreachBatch(write), checkpoint)
    return _published(setlists.sparkSession, schema, out)


def _detached(fn):
    """Copy of a module function that travels by value, without this package on workers."""
    import types

    copy = types.FunctionType(fn.__code__, {"__builtins__": __builtins__}, fn.__name__, fn.__defaults__)
    copy.__module__ = "__main__"
    return copy


# --- R3 duplicates --------------------------------------------------------------------------


def _ends_of_copies(frame, ts):
    """The earliest and the latest of the copies of a message in a frame, and rows without signature."""
    import pandas as pd

    marked = frame["sig"].notna()
    ordered = frame[marked].sort_values(ts, kind="stable")
    key = ["video_id", "sig"]
    ends = ~ordered.duplicated(key) | ~ordered.duplicated(key, keep="last")
    return pd.concat([ordered[ends], frame[~marked]])


def thinned(signed: DataFrame, ts: str = "ts") -> DataFrame:
    """Messages without the copies between the first and the last of a task's batch.

    A map-side step in front of the state: a message that is copied very often is a few rows
    per task in the shuffle. The first is what is kept, and the last stays because the first
    may be late when it is not; it also carries the watermark.
    """
    ends = _detached(_ends_of_copies)

    def thin(frames):
        for frame in frames:
            yield ends(frame, ts)

    return signed.mapInPandas(thin, signed.schema)


def stream_dedupe(messages: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First message per video and signature, with bounded state.

    A key stays in the state until the watermark (the latest event time met by earlier
    batches less ``delay``) passes the event time of the message that was kept plus ``delay``;
    a copy that comes after that is kept again. Messages older than the watermark are late and
    dropped. Messages without a signature are no copies of each other: all of them stay.
    """
    signed = thinned(with_signature(messages), ts).withWatermark(ts, delay)
    once = signed.where("sig is not null").dropDuplicatesWithinWatermark(["video_id", "sig"])
    return once.unionByName(signed.where("sig is null"))


# --- R4 counts -------------------------------------------------------------------------------


def stream_status(
    results: DataFrame, width: str = "1 day", ts: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Results per window, collection and status; counts combine before the shuffle."""
    return (
        results.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), "collection", "status")
        .agg(F.count("*").alias("videos"))
        .select(F.col("w.start").alias("window_start"), "collection", "status", "videos")
    )


def upsert_log(
    updates: DataFrame, keys: list[str], value: str, out: str, checkpoint: str, merge_every: int = 10
) -> DataFrame:
    """Run an update-mode aggregate into a compacted log and read the latest values.

    Each batch is a folder ``log/batch_id=N``. After every ``merge_every`` batches those up to
    the last one are merged with the version before into ``version/upto=N``, one row per key.
    A reader takes the newest version and the few batches behind it. A batch or merge that
    runs again overwrites its own folder with the same rows, so a rerun changes nothing.
    """
    spark = updates.sparkSession
    shape = updates.select(*keys, value).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*keys, value).write.mode("overwrite").parquet(f"{out}/log/batch_id={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            latest = latest_values(spark, shape, keys, value, out, upto=batch_id, merge_every=merge_every)
            latest.write.mode("overwrite").parquet(f"{out}/version/upto={batch_id}")

    run_available(updates.writeStream.outputMode("update").foreachBatch(write), checkpoint)
    return latest_values(spark, shape, keys, value, out, merge_every=merge_every)


def latest_values(
    spark: SparkSession, shape: T.StructType, keys: list[str], value: str, out: str,
    upto: int | None = None, merge_every: int = 10,
) -> DataFrame:
    """Latest value per key of a log of batches up to ``upto`` (all, if not given)."""
    names = [f.name for f in _folders(spark, f"{out}/log")]
    batches = sorted(int(n.split("=")[1]) for n in names)
    batches = [b for b in batches if upto is None or b <= upto]
    merged = [
        int(f.name.split("=")[1]) for f in _folders(spark, f"{out}/version") if f.complete
    ]
    # the merge of a batch begins from the version before it
    base = max((m for m in merged if m < (upto if upto is not None else max(batches, default=-1) + 1)), default=None)
    rest = [b for b in batches if base is None or b > base]
    read = lambda folder, at: spark.read.schema(shape).parquet(f"{out}/{folder}").withColumn("_at", F.lit(at))
    parts = [read(f"version/upto={base}", -1)] if base is not None else []
    parts += [read(f"log/batch_id={b}", b) for b in rest]
    if not parts:
        return spark.createDataFrame([], shape)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys).agg(F.max_by(value, "_at").alias(value))


class _Folder:
    def __init__(self, name: str, complete: bool) -> None:
        self.name, self.complete = name, complete


def _folders(spark: SparkSession, path: str) -> list[_Folder]:
    """Folders below ``path`` with the mark of a finished write, through Spark's file system."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    found = [f.getPath() for f in fs.listStatus(root) if f.isDirectory()]
    return [_Folder(p.getName(), fs.exists(jvm.Path(p, "_SUCCESS"))) for p in found]
