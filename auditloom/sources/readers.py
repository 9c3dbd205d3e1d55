"""Readers: typed tables, all-text ledgers, JSON lines strict and lenient, archives, workbooks and markup."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.ordering import with_running_sum
from auditloom.scratch import Scratch

MAX_MEMBERS = 100_000


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its extension; an unknown one is an error. Give a schema where inference (a pass over the text) is too dear."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    r = spark.read.schema(schema) if schema else spark.read
    if kind == ".csv":
        return r.csv(path, header=True, inferSchema=schema is None)
    if kind in (".tsv", ".txt"):
        return r.csv(path, header=True, sep="\t", inferSchema=schema is None)
    if kind == ".parquet":
        return r.parquet(path)
    if kind in (".jsonl", ".ndjson"):
        return r.json(path) if schema else read_typed_jsonl(spark, path)
    if kind in (".xlsx", ".xlsm"):
        return read_workbook(spark, path)
    raise ValueError(f"no reader for {kind or 'files without extension'}")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose cells are all text, blanks as '' and a byte-order mark dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    names = [c.lstrip("﻿") for c in df.columns]
    return df.toDF(*names).na.fill("")


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """A result CSV: numbers are inferred, but columns named *_json stay text."""
    typed = spark.read.csv(path, header=True, inferSchema=True)
    text = spark.read.csv(path, header=True, inferSchema=False)
    schema = [text.schema[f.name] if f.name.endswith("_json") else f for f in typed.schema.fields]
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType(schema)).csv(path, header=True)


def read_typed_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as file, line text and a variant, so that true, 1 and "1" stay what they are."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value", F.parse_json("value").alias("v"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a line that doesn't parse stops the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad lines with their file."""
    df = spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    bad = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where((F.trim("value") != "") & (F.try_parse_json("value").isNull() | ~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))))
    return df.where("_bad is null").drop("_bad"), bad


def numbered_lines(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """file, line (from 1), value of every line. Files are split as usual: a line's number is a running count over its file's blocks."""
    scratch = scratch or Scratch(spark, "lines")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value", F.lit(1).cast("long").alias("_one"))
    return with_running_sum(lines, ["file"], ["_block", "_at"], "_one", scratch, "numbered", "line").select("file", "line", "value")


def bad_lines(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """file, line, value of the lines that hold no JSON object; blank ones are none."""
    v = F.try_parse_json("value")
    return numbered_lines(spark, path, scratch).where((F.trim("value") != "") & ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV, JSON lines, a JSON list, or an object that holds them under records, items, results or data; one JSON text a record."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        df = read_text_table(spark, path)
        return df.select(F.to_json(F.struct(*df.columns)).alias("record"))
    if kind == ".jsonl":
        return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("record"))
    whole = spark.read.text(path, wholetext=True)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["value"]:
                v = json.loads(t)
                if isinstance(v, dict):
                    v = next((v[k] for k in ("records", "items", "results", "data") if isinstance(v.get(k), list)), [v])
                out += [json.dumps(x, ensure_ascii=False) for x in v]
            yield pd.DataFrame({"record": out})

    return whole.mapInPandas(each, "record string")


def union_files(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


_SKIP = r"(^|/)(\.git|__pycache__|\.pytest_cache|node_modules|\.ipynb_checkpoints)(/|$)"


def list_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """path, name, length, modified (and sha256) of all files below a folder, caches left out; the listing reads no content unless asked."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(~F.col("path").rlike(_SKIP))
    cols = ["path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")]
    return f.select(*cols, *([F.sha2("content", 256).alias("sha256")] if with_content else []))


def classify_files(files: DataFrame, patterns: dict[str, str], max_depth: int | None = None, root: str = "") -> DataFrame:
    """kind and path of files by the first matching name pattern."""
    rel = F.regexp_replace("path", "^" + re.escape(root) + "/?", "")
    kind = F.lit(None).cast("string")
    for k, rx in reversed(patterns.items()):
        kind = F.when(F.col("name").rlike(rx), k).otherwise(kind)
    out = files.withColumn("kind", kind).where("kind is not null")
    return out.where(F.size(F.split(rel, "/")) <= max_depth) if max_depth else out


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, size, sha256 of ZIP files' members; members that point outside are marked unsafe and not read. A member is hashed in blocks, however large."""
    import hashlib

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    infos = z.infolist()
                    if len(infos) > MAX_MEMBERS:
                        raise ValueError(f"{p} has too many members")
                    for i in infos:
                        if i.is_dir():
                            continue
                        unsafe = i.filename.startswith("/") or ".." in PurePosixPath(i.filename).parts
                        digest = None
                        if not unsafe:
                            h = hashlib.sha256()
                            with z.open(i) as f:
                                for block in iter(lambda: f.read(1 << 20), b""):
                                    h.update(block)
                            digest = h.hexdigest()
                        rows.append((p, i.filename, i.file_size, digest, unsafe))
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "sha256", "unsafe"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "archive string, member string, size long, sha256 string, unsafe boolean")


def markup_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, parent, tag, attributes, text of every element of XML or SVG files."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                if b"<!ENTITY" in c:
                    raise ValueError(f"{p} declares entities")
                todo = [(ElementTree.fromstring(c), -1)]
                n = 0
                while todo:
                    e, parent = todo.pop(0)
                    rows.append((p, n, parent, re.sub(r"\{.*?\}", "", str(e.tag)), {re.sub(r"\{.*?\}", "", k): v for k, v in e.attrib.items()}, (e.text or "").strip()))
                    todo += [(x, n) for x in e]
                    n += 1
            yield pd.DataFrame(rows, columns=["file", "ordinal", "parent", "tag", "attributes", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "file string, ordinal int, parent int, tag string, attributes map<string,string>, text string")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def workbook_rows(content: bytes) -> list[list[object]]:
    """Cells of the first sheet with their types (number, text, true/false); trailing blank rows are dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    rows: list[list[object]] = []
    for r in sheet.iter(f"{{{_NS['m']}}}row"):
        at: dict[int, object] = {}
        for n, c in enumerate(r.findall("m:c", _NS)):
            ref = re.match(r"[A-Z]+", c.get("r", ""))
            col = n
            if ref:
                col = 0
                for ch in ref[0]:
                    col = col * 26 + ord(ch) - 64
                col -= 1
            v, kind = c.find("m:v", _NS), c.get("t")
            if kind == "inlineStr":
                at[col] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is not None and v.text is not None:
                at[col] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text)
        rows.append([at.get(i) for i in range(max(at, default=-1) + 1)])
    while rows and not any(x not in (None, "") for x in rows[-1]):
        rows.pop()
    return rows


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet's rows as (file, row, variant of column -> value), types kept; blank or repeated headers are errors."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                rows = workbook_rows(c)
                head = [str(h).strip() if h is not None else "" for h in (rows[0] if rows else [])]
                if "" in head or len(set(head)) != len(head):
                    raise ValueError(f"{p} has a blank or repeated header")
                for n, r in enumerate(rows[1:], 1):
                    out.append((p, n, json.dumps({h: (r[i] if i < len(r) else None) for i, h in enumerate(head)}, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["file", "row", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "file string, row int, json string").select("file", "row", F.parse_json("json").alias("v"))
