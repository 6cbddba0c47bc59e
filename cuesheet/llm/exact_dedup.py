"""Operator 4: exact copies by deterministic naming of blocks and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, only_rows, placed, table, written

#: Bytes of a block.
BLOCK = 4096

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text with every run of white space as one blank, as UTF-8 bytes."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").cast("binary")


def _blocks(data: Column, size: int, value) -> Column:
    """``value(block)`` of each block; an empty text is one empty block."""
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: value(F.substring(data, i * size + 1, F.lit(size))),
    )


def _first_names(texts: DataFrame, size: int, route) -> DataFrame:
    """``h, block_name``: a number for every distinct block.

    Blocks are grouped by content (``route`` only decides where they meet), and a group is
    named by the number of its first occurrence, so equal names mean equal blocks.
    """
    blocks = texts.select(F.explode(_blocks(F.col("data"), size, lambda b: b)).alias("block"))
    numbered = blocks.select("block", F.monotonically_increasing_id().alias("at"))
    return numbered.groupBy(route(F.col("block")).alias("h"), "block").agg(
        F.min("at").alias("block_name")
    )


def block_names(
    texts: DataFrame, size: int = BLOCK, route=F.xxhash64
) -> tuple[DataFrame, DataFrame]:
    """Rows with their digests, and the collision-free identity of every row's text.

    ``texts`` is a written table ``row, doc_id, data`` of numbered rows. The first result has
    ``doc_id, row, text_sha256``, the second ``row, tier, name``: two rows get the same
    ``tier, name`` if and only if their texts are the same bytes.

    1. Texts are cut into blocks of ``size`` bytes. Distinct blocks are found by content in
       one shuffle with map-side combining, so a block that a third of all rows share
       arrives once per task. Each gets an integer name.
    2. Occurrences fetch their names by the 64-bit ``route`` value of the block, a narrow
       join. Where two different blocks share that value, their occurrences are joined by
       content instead (looked for every time; nothing rests on the value being unique).
    3. Adjacent names are paired and the pairs named in the same way, by their two numbers,
       until a text has one name: log2(blocks of the longest text) rounds over ever fewer
       narrow rows. A last name without a neighbour is paired with none.

    Every round is written to the shared folder. A text of one block has tier 0, others 1.
    """
    hashes = written(
        texts.select(
            "doc_id", "row", F.unhex(F.sha2("data", 256)).alias("sha"),
            _blocks(F.col("data"), size, route).alias("hs"),
        ),
        "blocks",
    )
    names = written(_first_names(texts, size, route).drop("block"), "names")
    shared = names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    apart = hashes.select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    if shared.isEmpty():
        level = apart.join(names, "h").select("row", "n", "pos", F.col("block_name").alias("name"))
    else:
        level = _named_by_content(texts, apart, names, shared, size, route)
    longest = hashes.select(F.max(F.size("hs"))).first()[0] or 0
    level = written(level, "level")
    one = level.where("n = 1").select("row", F.lit(0).alias("tier"), "name")
    many = level.where("n > 1")
    width = longest
    while width > 1:
        at = (F.col("pos") / 2).cast("int")
        side = [
            F.max(F.when(F.col("pos") % 2 == s, F.col("name"))).alias(c)
            for s, c in ((0, "a"), (1, "b"))
        ]
        pairs = written(
            many.groupBy("row", "n", at.alias("pos")).agg(*side)
            .withColumn("b", F.coalesce("b", F.lit(-1))),
            "pairs",
        )
        # written, as Spark can split a frequent pair only where both sides of a join come
        # straight from a shuffle
        named = written(
            pairs.withColumn("at", F.monotonically_increasing_id()).groupBy("a", "b").agg(
                F.min("at").alias("name")
            ),
            "pair-names",
        )
        many = pairs.join(named, ["a", "b"]).select("row", "n", "pos", "name")
        width = (width + 1) // 2
    named = one.unionByName(many.select("row", F.lit(1).alias("tier"), "name"))
    return hashes.select("doc_id", "row", F.lower(F.hex("sha")).alias("text_sha256")), named


def _named_by_content(texts, apart, names, shared, size, route) -> DataFrame:
    """Names of all occurrences, by content where a ``route`` value is shared."""
    plain = apart.join(shared, "h", "left_anti").join(names, "h")
    numbers = _first_names(texts, size, route).join(shared, "h", "left_semi")
    texts = texts.select("row", _blocks(F.col("data"), size, lambda b: b).alias("bs"))
    exact = (
        texts.select("row", F.size("bs").alias("n"), F.posexplode("bs").alias("pos", "block"))
        .withColumn("h", route(F.col("block"))).join(shared, "h", "left_semi")
        .join(numbers, ["h", "block"])
    )
    columns = ["row", "n", "pos"]
    # these numbers were counted anew: below all others
    return plain.select(*columns, F.col("block_name").alias("name")).unionByName(
        exact.select(*columns, (-F.col("block_name") - 2).alias("name"))
    )


def find_copies(docs: DataFrame, size: int = BLOCK, route=F.xxhash64) -> DataFrame:
    """``doc_id, row, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when identical after each run of white space became one blank; null
    counts as empty. Of equal texts the row with the smallest ``doc_id`` stays (ids that are
    null come last); of rows that share this id too, one stays. An empty table gives no
    rows; other columns are not read.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("data")]
    texts, row = numbered(docs, columns)
    return _found(texts.withColumnRenamed(row, "row"), size, route)


def _found(texts: DataFrame, size: int, route) -> DataFrame:
    rows, names = block_names(texts, size, route)
    rows = written(rows.join(names, "row"), "texts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = written(
        rows.groupBy("tier", "name").agg(
            F.min(order).alias("_keep"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    return rows.join(groups, ["tier", "name"]).select(
        "doc_id", "row", F.col("_keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("_keep.row")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of equal texts (see :func:`find_copies`).

    ``stored``: ``docs`` is a stored Parquet table as it was read, so no copy of it is written.
    """
    rows, row = placed(docs) if stored else numbered(docs)
    # written, as the cut of a text would otherwise be computed from it for each block
    texts = written(
        rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("data")),
        "normalised",
    )
    return only_rows(rows, row, _found(texts, BLOCK, F.xxhash64).where("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy that stays, for every document."""
    return find_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, row) = 1 AS kept,
       sha256(s) AS text_sha256
FROM t WINDOW g AS (PARTITION BY s)
"""
