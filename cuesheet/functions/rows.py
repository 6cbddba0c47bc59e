"""Explode computed arrays without computing them twice.

The optimiser guards an inner explode, and any filter on a computed column, with a copy
of the whole expression below it.  For parsed text that doubles the work.  An outer
explode followed by a filter on the generated column has no such copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column, keep: list[str], value: str, pos: str | None = None):
    """One row per array element, with its position from 1 when ``pos`` is given."""
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", value)).where(
        F.col("_pos").isNotNull()
    )
    if pos is None:
        return rows.drop("_pos")
    return rows.select(*keep, (F.col("_pos") + 1).alias(pos), value)


def keep_found(df: DataFrame, found: Column, keep: list[str], value: str) -> DataFrame:
    """Rows for which ``found`` is not null, with it as column ``value``."""
    return explode_rows(df, F.filter(F.array(found), lambda x: x.isNotNull()), keep, value)
