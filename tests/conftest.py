import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cuesheet.session import configure

    session = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def one(spark):
    """Apply a column function to a list of strings."""

    def run(fn, values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), "i int, v string").coalesce(1)
        return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]

    return run


@pytest.fixture(scope="session")
def lists(spark):
    """Setlist rows from ``{video: [(secs, song, artist, num), ...]}``."""

    def make(data):
        from cuesheet.functions.titles import TRACK_TYPE

        rows = [
            (
                v, "comment", v, v,
                [(i + 1, (t + (None,) * 4)[3], t[0], "", t[1], t[2]) for i, t in enumerate(ts)],
            )
            for v, ts in data.items()
        ]
        schema = f"video_id bigint, source string, source_pos bigint, comment_id bigint, tracks array<{TRACK_TYPE}>"
        return spark.createDataFrame(rows, schema)

    return make
