"""Scalar functions on ledger records, documents and audit values, as column expressions where Spark has the parts."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.text import norm

# fixed values: words that are no terms
STOP_WORDS = "a an and are as at be been by can could for from has have in into is it its may method methods model models of on or our paper result results study studies system systems that the their this to using via was we were with".split()


def norm_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(T.StringType())
def norm_title(s: pd.Series) -> pd.Series:
    """Decomposed, case-folded, without punctuation, single-spaced."""
    def one(x: str | None) -> str:
        t = unicodedata.normalize("NFKD", x or "").casefold()
        return " ".join(re.sub(r"[^\w\s]", " ", t).split())

    return s.map(one)


def norm_title_ascii(c: Column) -> Column:
    """The same for plain letters, without leaving the JVM."""
    return norm_space(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s]", " "))


def norm_doi(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, r"^https?://(dx\.)?doi\.org/", "")
    t = F.trim(F.regexp_replace(t, r"^doi:\s*", ""))
    return F.regexp_replace(t, r"[.,;)]+$", "")


def norm_id(c: Column) -> Column:
    return F.lower(norm(c))


def stable_id(prefix: str, basis: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(basis.cast("binary")), 1, 12))


def record_basis(doi: Column, pmid: Column, arxiv: Column, title: Column, year: Column, authors: Column) -> Column:
    """The strongest identifier: doi, pmid, arxiv id, else title, year and first authors."""
    some = lambda p, c: F.when(c != "", F.concat(F.lit(p), c))
    return F.coalesce(some("doi:", norm_doi(doi)), some("pmid:", norm_id(pmid)), some("arxiv:", norm_id(arxiv)), F.concat_ws("|", norm_title_ascii(title), norm(year), F.substring(F.lower(norm(authors)), 1, 80)))


def first_filled(*cols: Column) -> Column:
    """The first alias with text."""
    return F.coalesce(*[F.when(norm(c) != "", norm(c)) for c in cols], F.lit(""))


def extra_json(cols: list[str]) -> Column:
    """Residual columns as JSON by sorted name, blanks left out."""
    return F.to_json(F.struct(*[F.when(norm(c) != "", F.col(c)).alias(c) for c in sorted(cols)]))


def terms(c: Column) -> Column:
    """Lower-case words of three or more characters without stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z0-9_-]{2,})"), 1), lambda t: ~t.isin(*STOP_WORDS))


def clean_prose(c: Column) -> Column:
    """Text without comments, code, links' targets, headings' marks and emphasis."""
    t = F.coalesce(c, F.lit(""))
    for rx, to in ((r"(?s)<!--.*?-->", " "), (r"(?s)```.*?```", " "), (r"`[^`]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"[*_]{1,3}", "")):
        t = F.regexp_replace(t, rx, to)
    return t


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(clean_prose(c), F.lit(r"([A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*)"), 1))


def numeric_tokens(c: Column) -> Column:
    """Numbers in text without thousands separators and plus signs."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?)"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"[,+]", ""))


def citation_keys(c: Column) -> Column:
    """Keys of bracketed citations like [@key; @other]."""
    blocks = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\[\]]*@[^\[\]]*)\]"), 1)
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"@([A-Za-z0-9_:.-]*[A-Za-z0-9_])"), 1)))


def object_key(c: Column) -> Column:
    """(kind, number, letter) of a figure or table label; null where there is none."""
    rx = r"(?i)\b(fig(?:ure)?|tab(?:le)?)\.?\s*(S?\d+)\s*([a-z])?\b"
    kind = F.lower(F.regexp_extract(c, rx, 1))
    return F.when(kind != "", F.struct(F.when(kind.startswith("f"), "figure").otherwise("table").alias("kind"), F.upper(F.regexp_extract(c, rx, 2)).alias("number"), F.lower(F.regexp_extract(c, rx, 3)).alias("letter")))


def canonical_section(c: Column, aliases: dict[str, str]) -> Column:
    low = F.lower(norm(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[low], low)


def top_level_clauses(text: str) -> list[str]:
    """Splits at ; and coordinating conjunctions outside brackets."""
    out, depth, at, i = [], 0, 0, 0
    joints = (" and ", " but ", " whereas ", " while ")
    while i < len(text):
        c = text[i]
        depth += (c in "([{") - (c in ")]}")
        joint = next((j for j in joints if depth <= 0 and text.startswith(j, i)), None)
        if depth <= 0 and c == ";":
            out.append(text[at:i])
            at = i + 1
        elif joint:
            out.append(text[at:i])
            at = i + len(joint)
            i = at - 1
        i += 1
    return [p for p in (x.strip(" ,.") for x in [*out, text[at:]]) if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def clauses(s: pd.Series) -> pd.Series:
    return s.map(lambda x: top_level_clauses(x or ""))


def short(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def split_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def iso_time(c: Column) -> Column:
    """A timestamp from ISO text that names its zone; null otherwise."""
    return F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


def half_resolution(c: Column) -> Column:
    """Half of the last displayed digit of a time, in seconds."""
    digits = F.length(F.regexp_extract(c, r"\.(\d+)", 1))
    return F.lit(0.5) * F.pow(F.lit(10.0), -F.least(digits, F.lit(6)))


def version_tuple(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))


def null_relation(low: Column, high: Column, null: float = 0.0) -> Column:
    return F.when(low.isNull() | high.isNull(), "unknown").when(low > null, "above").when(high < null, "below").otherwise("includes")


def verification_coverage(total: Column, verified: Column, partial: Column) -> Column:
    return F.when(total == 0, "none").when(verified == total, "verified").when(verified + partial > 0, "partial").otherwise("unverified")


def inflated(n: Column, attrition: Column) -> Column:
    return F.ceil(n / (1 - attrition))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(norm(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def point_to_box(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Distance of a point from a rectangle (0 inside)."""
    dx = F.greatest(x - px, F.lit(0.0), px - (x + w))
    dy = F.greatest(y - py, F.lit(0.0), py - (y + h))
    return F.hypot(dx, dy)


def overlap_ratio(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Shared area as a part of the smaller rectangle's."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return w * h / F.least(aw * ah, bw * bh)


def final_point_size(font: Column, view_width: Column, width_in: Column) -> Column:
    return font / view_width * width_in * 72


def fmt(x: float | None, digits: int = 3) -> str:
    """A number for a report."""
    return "NA" if x is None or math.isnan(x) else "inf" if math.isinf(x) else f"{x:.{digits}g}"
