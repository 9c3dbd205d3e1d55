"""Copies of test tables with rows added that must not change a result, and empty ones."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

SMALL = Path("/root/testdata/sf0.001")
CLASH = ["id", "k", "side", "value", "series", "snapshot", "pos", "n", "m", "label", "u", "v", "tokens", "h", "kind", "found", "ids", "_pid", "pair", "previous", "component"]


def copies(spark, tmp_path, tables, repeat=True):
    """Folders: the tables as they are, with an all-null row, repeated rows and clashing columns, and empty."""
    if not SMALL.exists():
        pytest.skip("no test tables here")
    for t in tables:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        nulls = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
        more = df.unionByName(nulls)
        if repeat:
            more = more.unionByName(df.limit(7))
        more.select("*", *[F.lit(1).alias(c) for c in CLASH if c not in df.columns]).coalesce(1).write.parquet(f"{tmp_path}/more/{t}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    return str(SMALL), f"{tmp_path}/more", f"{tmp_path}/none"


def rows(df):
    return sorted(map(repr, df.collect()))
