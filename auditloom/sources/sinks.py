"""Sinks: tables by extension, projected text, standard JSON, idempotent and verified writes, graphs and reports."""

from __future__ import annotations

import posixpath
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame) -> DataFrame:
    """Non-finite numbers as null, as standard JSON has none."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV, TSV, JSON lines or Parquet by extension; an existing target is refused unless another mode is given."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    w = df.write.mode(mode)
    if kind == ".csv":
        w.csv(path, header=True)
    elif kind == ".tsv":
        w.csv(path, header=True, sep="\t")
    elif kind in (".jsonl", ".json"):
        finite(df).write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == ".parquet":
        w.parquet(path)
    else:
        raise ValueError(f"no sink for {kind or 'paths without extension'}")


def inside(root: str, path: str) -> str:
    """The path below the root; one that leads out of it is refused."""
    base = posixpath.normpath(root)
    full = posixpath.normpath(path if path.startswith(("/", "file:", base)) else posixpath.join(base, path))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} lies outside {root}")
    return full


def project_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """A fixed list of text columns: extra ones left out, missing ones blank."""
    return df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def new_rows(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key isn't there yet, one a key."""
    return df.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def append_once(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends only rows with new keys to a Parquet table and returns how many; a repeated call adds nothing."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    fresh = new_rows(df, spark.read.parquet(path), key) if there else df.dropDuplicates(key)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def write_verified(df: DataFrame, path: str) -> None:
    """Writes, reads again and compares as multisets; on drift the target is deleted and the call fails."""
    write_table(df, path)
    spark = df.sparkSession
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    read = {".csv": lambda: spark.read.schema(df.schema).csv(path, header=True), ".tsv": lambda: spark.read.schema(df.schema).csv(path, header=True, sep="\t"), ".parquet": lambda: spark.read.parquet(path)}.get(kind, lambda: spark.read.schema(df.schema).json(path))()
    tagged = df.select("*", F.lit(1).alias("_w")).unionByName(read.select("*", F.lit(-1).alias("_w")))
    if tagged.groupBy(*df.columns).agg(F.sum("_w").alias("_w")).where("_w <> 0").limit(1).count():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        raise ValueError(f"{path} doesn't read back as written")


def dot_lines(edges: DataFrame, source: str, target: str, label: str) -> DataFrame:
    """One line an edge for a graph drawing program."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), q(F.col(source)), F.lit(" -> "), q(F.col(target)), F.lit(" [label="), q(F.col(label)), F.lit("];")).alias("line"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One table line a row for a report."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("NA")), r"\|", r"\\|")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def canonical(c: Column) -> Column:
    """A struct as JSON with nulls kept, for hashes; keys follow the struct's order, so sort the fields first."""
    return F.to_json(c, {"ignoreNullFields": "false"})
