"""Documents with claim markers: spans, sections, paragraphs, coverage and section differences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.ordering import with_previous, with_running
from auditloom.scratch import Scratch

_START, _END = re.compile(r"<!--\s*CLAIM:(\S+?)\s*-->"), re.compile(r"<!--\s*END-CLAIM:(\S+?)\s*-->")
_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$")
_SCHEMA = "kind string, name string, start bigint, end bigint"


def parse_spans(text: str) -> list[tuple[str, str, int, int]]:
    """claim spans (between their markers), unclosed and unopened markers, sections and paragraphs, by character offsets."""
    out: list[tuple[str, str, int, int]] = []
    marks = sorted([(m.start(), m.end(), m[1], True) for m in _START.finditer(text)] + [(m.start(), m.end(), m[1], False) for m in _END.finditer(text)])
    open_at: dict[str, int] = {}
    for s, e, name, starts in marks:
        if starts:
            if name in open_at:
                out.append(("unclosed", name, open_at[name], open_at[name]))
            open_at[name] = e
        elif name in open_at:
            out.append(("claim", name, open_at.pop(name), s))
        else:
            out.append(("unopened", name, s, s))
    out += [("unclosed", n, p, p) for n, p in open_at.items()]
    heads = [(m.start(), m[2]) for m in _HEADING.finditer(text)]
    for i, (s, name) in enumerate(heads):
        out.append(("section", name, s, heads[i + 1][0] if i + 1 < len(heads) else len(text)))
    for m in re.finditer(r"[^\n](?:.*?)(?=\n\s*\n|\Z)", text, re.S):
        if m[0].strip():
            out.append(("paragraph", "", m.start(), m.end()))
    return out


def document_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, name, start, end. Null and empty texts have none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[key], b[text]) if t for r in parse_spans(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "start", "end"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInPandas(each, f"`{key}` {docs.schema[key].dataType.simpleString()}, {_SCHEMA}")


def overlaps(spans: DataFrame, group: list[str], start: str, end: str, ident: str, scratch: Scratch) -> DataFrame:
    """Spans that begin before an earlier span of their group has ended, with the latest such end (a sorted sweep over range partitions, no pairs)."""
    swept = with_running(spans, group, [start, end, ident], {"covered_until": (end, "max", False)}, scratch, "sweep")
    return swept.where(F.col(start) < F.col("covered_until"))


def coverage(spans: DataFrame, key: str, scratch: Scratch | None = None) -> DataFrame:
    """key, paragraph_start, length, covered: characters of each paragraph inside claim spans (overlaps count once).

    One sweep over both: where a position lies, a running sum tells how many claim spans are open, another one how much of the
    document they had covered so far; a paragraph's share is the difference between its end and its start. The running values
    come from range partitions, so a document of any length is no single task and no pair of spans is formed.
    """
    scratch = scratch or Scratch(spans.sparkSession, "coverage")
    claims = spans.where("kind = 'claim' and end > start")
    paras = spans.where("kind = 'paragraph'").select(key, "start", "end").distinct()
    mark = lambda df, at, step, para: df.select(key, F.col(at).alias("at"), F.lit(step).cast("long").alias("step"), F.lit(para).alias("para"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    marks = mark(claims, "start", 1, 0).unionByName(mark(claims, "end", -1, 0)).unionByName(mark(paras, "start", 0, 1)).unionByName(mark(paras, "end", 0, 2))
    # one row a position of a document: how many spans open or close there
    at = marks.groupBy(key, "at").agg(F.sum("step").alias("step"))
    before = with_previous(at, [key], ["at"], "at", scratch, "points", "last_at")
    opened = with_running(scratch.write(before, "steps"), [key], ["at"], {"open": ("step", "sum", False)}, scratch, "open")
    grown = scratch.write(opened.withColumn("grown", F.when((F.col("open") > 0) & F.col("last_at").isNotNull(), F.col("at") - F.col("last_at")).otherwise(F.lit(0)).cast("long")), "grown")
    sums = with_running(grown, [key], ["at"], {"covered": ("grown", "sum", True)}, scratch, "covered").select(key, "at", "covered")
    ends = marks.where("para > 0").join(sums, [key, "at"])
    side = lambda n: F.max(F.when(F.col("para") == n, F.col("covered")))
    return ends.groupBy(key, F.col("ps").alias("paragraph_start"), (F.col("pe") - F.col("ps")).alias("length")).agg((side(2) - side(1)).alias("covered"))


def sections_of(points: DataFrame, spans: DataFrame, key: str, pos: str) -> DataFrame:
    """Adds ``section``: the last heading at or before a position (as of), by one sort of headings and points together."""
    h = spans.where("kind = 'section'").select(key, F.col("start").alias("_at"), F.lit(0).alias("_o"), F.col("name").alias("_h"), F.lit(None).cast("struct<" + ",".join(f"`{n}`:{t}" for n, t in points.dtypes) + ">").alias("_p"))
    p = points.select(key, F.col(pos).alias("_at"), F.lit(1).alias("_o"), F.lit(None).cast("string").alias("_h"), F.struct(*points.columns).alias("_p"))
    w = Window.partitionBy(key).orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return h.unionByName(p).withColumn("section", F.last("_h", ignorenulls=True).over(w)).where("_p is not null").select("_p.*", "section")
