"""Grouped work that stays balanced when one group holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

HOT_GROUPS = 1000
SPREAD = 1024


def attach_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    spread: list[str],
    hot_groups: int = HOT_GROUPS,
) -> DataFrame:
    """Left-join one-row-per-key ``groups`` to ``rows`` without a hot task.

    The ``hot_groups`` largest groups (by ``size``) are broadcast: their number is
    fixed, so the broadcast is too.  Every other group is at most 1/``hot_groups`` of
    the rows, and goes through an ordinary shuffle join; rows already served by the
    broadcast are spread over salt values that no group has.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = (
        groups.orderBy(F.desc(size), *keys)
        .limit(hot_groups)
        .select(*keys, F.struct(*values).alias("_hot"))
    )
    cold = groups.select(*keys, F.struct(*values).alias("_cold"), F.lit(0).alias("_salt"))
    # rows without a key match nothing and are spread out as well
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNull() & keyed, F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.lit(SPREAD)).cast("int") + 1
        ),
    )
    joined = salted.join(cold, keys + ["_salt"], "left")
    pick = [F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values]
    return joined.select(*rows.columns, *pick)


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``, balanced for any key and any kind of order."""
    return running_total(rows, keys, order, F.lit(1), out)


def running_total(
    rows: DataFrame, keys: list[str], order: list[str | Column], weight: Column, out: str
) -> DataFrame:
    """Sum of ``weight`` up to and with each row over ``keys`` by ``order``, balanced for any key.

    Rows are dealt into ranges of (``keys``, ``order``) by sampled bounds, so a key with a
    third of all rows spans many ranges, and sparse or textual orders make no more ranges
    than dense ones.  The dealt rows are written once, as the bounds may differ from run to
    run.  Each (key, range) is summed, a window over these sums (one row per range that a
    key spans) gives the offsets, and rows are added up inside one range only.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_o{i}" for i in range(len(order))]
    dealt = rows.select(
        "*", *[c.alias(n) for c, n in zip(order, names, strict=True)], weight.cast("bigint").alias("_w")
    )
    dealt = written(
        dealt.repartitionByRange(*keys, *names).withColumn("_range", F.spark_partition_id()), out
    )
    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    cond = F.lit(True)
    for k in [*keys, "_range"]:
        cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    numbered = dealt.withColumn("_in", F.sum("_w").over(inside))
    joined = numbered.alias("r").join(offsets.alias("o"), cond)
    return joined.select(
        *[F.col(f"r.{c}") for c in rows.columns],
        (F.col("o._off") + F.col("r._in")).cast("bigint").alias(out),
    )
