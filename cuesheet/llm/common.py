"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written

__all__ = [
    "bit_maps", "blobs", "kept_rows", "marked", "numbered", "only_rows", "placed", "shared_dir", "table",
    "text_key", "tune", "written",
]

#: Rows of one Arrow batch: long texts stay within tens of megabytes.
BATCH_ROWS = 500
#: Bits of one map (those of ``bitmap_construct_agg``).
MAP = 1 << 15


def tune(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns ``k1, k2`` that name a row by its id and its text.

    Rows with the same id and the same text are one key; what an operator finds out about
    a text may be carried back by it, whatever the ids are (null, repeated).
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2"),
    ]


def blobs(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    column = batch.column(name)
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b or b"" for b in column.to_pylist()]


def _free(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, columns: list[Column | str] | None = None) -> tuple[DataFrame, str]:
    """The rows (or some columns of them) written with a number each, and the number's column.

    The number is the name of a row, whatever its id and text are: nulls, repeated ids and
    equal rows stay apart. Its column has a name that no column of the rows has.
    """
    chosen = docs.select(*(columns or ["*"]))
    name = _free(chosen.columns, "_row")
    return written(chosen.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """As :func:`numbered`, without a copy: rows are known by their places in the files.

    ``docs`` must be a stored Parquet table as it was read.
    """
    name, file, at = (_free(docs.columns, c) for c in ("_row", "_file", "_at"))
    place = docs.metadataColumn("_metadata")
    rows = docs.select("*", place["file_path"].alias(file), place["row_index"].alias(at))
    number = (F.row_number().over(Window.orderBy(file)) - 1).cast("long")
    files = written(rows.select(file).distinct().withColumn(name, number), "files")
    number = F.shiftleft(name, 36) + F.col(at)
    return rows.join(F.broadcast(files), file).withColumn(name, number).select(*docs.columns, name), name


def bit_maps(numbers: DataFrame) -> DataFrame:
    """``map, bits`` for the numbers (one column): a bit each, in maps of ``MAP`` bits."""
    at = F.col(numbers.columns[0])
    return numbers.groupBy(F.shiftright(at, 15).alias("map")).agg(
        F.bitmap_construct_agg(at % MAP).alias("bits")
    )


def marked(rows: DataFrame, at: Column, maps: DataFrame) -> DataFrame:
    """Rows whose number ``at`` has its bit in ``maps``, where they stand."""
    place, key, bits = (_free(rows.columns, c) for c in ("_at", "_map", "_bits"))
    byte = F.expr(f"conv(hex(substring({bits}, cast(({place} % {MAP}) div 8 as int) + 1, 1)), 16, 10)")
    bit = byte.cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast({place} % 8 as int))")) != 0
    maps = F.broadcast(maps.select(F.col("map").alias(key), F.col("bits").alias(bits)))
    found = rows.withColumn(place, at).withColumn(key, F.shiftright(place, 15)).join(maps, key)
    return found.where(bit).select(rows.columns)


def only_rows(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """Rows of a numbered table whose numbers are in ``kept`` (``row``), without the number.

    A bit a row goes to every task (2 MB for 15 million rows); the rows stay where they are.
    """
    maps = written(bit_maps(kept.select("row")), "kept")
    return marked(rows, F.col(row), maps).drop(row)


def kept_rows(docs: DataFrame, keep: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``keep`` says yes to.

    ``keep`` comes from a zero-argument maker, called once a task; nothing is shuffled.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keep()
        for batch in source:
            yield batch.filter(pa.array(decide(blobs(batch)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
