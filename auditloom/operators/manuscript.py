"""Manuscript ledgers: spans against claims, coverage both ways, contracts, obligations, revisions and conflicts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import ledger as L
from auditloom.functions.text import norm
from auditloom.operators.findings import finding, union


def foreign_keys(rows: DataFrame, ident: str, column: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """References (a text or a list of them) to keys that aren't there."""
    each = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    refs = rows.select(F.col(ident).alias("_id"), each.alias("_k")).select("_id", F.trim("_k").alias("_k")).where("_k <> ''")
    known = parents.select(F.trim(parent_key).alias("_k")).distinct()
    return finding(refs.join(known, "_k", "left_anti"), "error", rule, F.col("_id"), F.col("_k"))


def span_audit(spans: DataFrame, claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markers without partner, spans of unknown claims, active claims without a span, one claim in several spans of a document."""
    active = claims.where(F.lower(norm("lifecycle_state")).isin("", "active")).select(F.trim("claim_id").alias("name")).distinct()
    held = spans.where("kind = 'claim'")
    return union([
        finding(spans.where("kind in ('unclosed', 'unopened')"), "error", "marker", F.col(key), F.concat_ws(" ", "kind", "name")),
        finding(held.join(active, "name", "left_anti"), "error", "unknown_claim", F.col(key), F.col("name")),
        finding(active.join(held.select("name").distinct(), "name", "left_anti"), "error", "no_span", F.col("name"), F.lit("an active claim has no span")),
        finding(held.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "warning", "several_spans", F.col(key), F.col("name")),
    ])


def value_closure(claims: DataFrame) -> DataFrame:
    """claims(claim_id, text, required_value_tokens): required numbers that the text lacks, and numbers that nothing requires."""
    said = L.numeric_tokens(F.col("text"))
    need = F.transform(F.filter(F.coalesce("required_value_tokens", F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), "[,+]", ""))
    c = claims.select("claim_id", F.array_except(need, said).alias("lost"), F.array_except(said, need).alias("extra"))
    return union([
        finding(c.select("claim_id", F.explode("lost").alias("t")), "error", "value_not_in_text", F.col("claim_id"), F.col("t")),
        finding(c.select("claim_id", F.explode("extra").alias("t")), "warning", "value_not_required", F.col("claim_id"), F.col("t")),
    ])


def coverage(contracts: DataFrame, spans: DataFrame) -> DataFrame:
    """contracts(paragraph_id, claim_ids) against spans(paragraph_id, claim_id), both ways."""
    want = contracts.select("paragraph_id", F.explode("claim_ids").alias("claim_id")).distinct()
    got = spans.select("paragraph_id", "claim_id").distinct()
    return union([
        finding(want.join(got, ["paragraph_id", "claim_id"], "left_anti"), "error", "claim_not_in_paragraph", F.col("paragraph_id"), F.col("claim_id")),
        finding(got.join(want, ["paragraph_id", "claim_id"], "left_anti"), "error", "claim_not_in_contract", F.col("paragraph_id"), F.col("claim_id")),
    ])


def companions(claims: DataFrame, places: DataFrame) -> DataFrame:
    """claims(claim_id, required_companions), places(claim_id, paragraph_id, section): companions missing from the claim's paragraph, section or document, by their scope."""
    need = claims.select(F.trim("claim_id").alias("claim_id"), F.explode("required_companions").alias("c")).select("claim_id", F.trim("c.claim_id").alias("other"), F.lower(norm("c.scope")).alias("scope")).where("other <> ''")
    at = need.join(places, "claim_id")
    p = places.select(F.col("claim_id").alias("other"), F.col("paragraph_id").alias("op"), F.col("section").alias("os"))
    near = lambda on: at.join(p, on, "left_anti")
    same = F.col("claim_id")
    return union([
        finding(near((at["other"] == p["other"]) & (at["paragraph_id"] == p["op"])).where("scope = 'paragraph'"), "error", "companion_not_in_paragraph", same, F.col("other")),
        finding(near((at["other"] == p["other"]) & (at["section"] == p["os"])).where("scope = 'section'"), "error", "companion_not_in_section", same, F.col("other")),
        finding(need.join(p.select("other").distinct(), "other", "left_anti").where("scope not in ('paragraph', 'section')"), "error", "companion_missing", same, F.col("other")),
    ])


def atomicity(claims: DataFrame) -> DataFrame:
    """Claims whose text makes more than one material statement."""
    material = F.filter(L.clauses(F.col("text")), lambda c: c.rlike(r"(?i)\b(is|are|was|were|did|has|have|had|show|shows|showed|differ\w*|increase\w*|decrease\w*|exceed\w*|contradict\w*)\b"))
    return finding(claims.where(F.size(material) > 1), "warning", "not_atomic", F.col("claim_id"), F.size(material).cast("string"))


def obligations(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows(obligation_id, status, required_actions, change_ids), changes(change_id, actions): closed obligations without changes, unknown changes, required actions that no change carries out."""
    linked = rows.select("obligation_id", "required_actions", F.explode_outer("change_ids").alias("change_id"))
    done = linked.join(changes, "change_id", "left").groupBy("obligation_id").agg(F.flatten(F.collect_list(F.coalesce("actions", F.array().cast("array<string>")))).alias("acts"), F.first("required_actions").alias("need"))
    return union([
        finding(rows.where("lower(status) = 'closed' and (change_ids is null or size(change_ids) = 0)"), "error", "closed_without_change", F.col("obligation_id"), F.lit("no change is named")),
        finding(linked.where("change_id is not null").join(changes.select("change_id"), "change_id", "left_anti"), "error", "no_such_change", F.col("obligation_id"), F.col("change_id")),
        finding(done.select("obligation_id", F.explode(F.array_except("need", "acts")).alias("a")), "error", "action_not_done", F.col("obligation_id"), F.col("a")),
    ])


def writing_profile(sections: DataFrame, order: list[str], most_words: dict[str, int]) -> DataFrame:
    """sections(doc_id, name, start, text): sections out of order, missing, repeated or too long."""
    rank = {n: i for i, n in enumerate(order)}
    place = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.lower(norm("name"))]
    s = sections.withColumn("_n", F.lower(norm("name"))).withColumn("_r", place)
    known = s.where("_r is not null")
    # a document has few sections: they are sorted within it
    seq = known.withColumn("_prev", F.max("_r").over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)))
    names = s.groupBy("doc_id").agg(F.collect_set("_n").alias("have"))
    limit = F.create_map(*[F.lit(x) for kv in (most_words or {"": 0}).items() for x in kv])[F.col("_n")]
    words = L.word_count(F.col("text"))
    return union([
        finding(seq.where("_r < _prev"), "error", "order", F.col("doc_id"), F.col("name")),
        finding(names.select("doc_id", F.explode(F.array_except(F.array(*[F.lit(o) for o in order]), F.col("have"))).alias("m")), "error", "section_missing", F.col("doc_id"), F.col("m")),
        finding(known.groupBy("doc_id", "_n").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "error", "section_repeated", F.col("doc_id"), F.col("_n")),
        finding(s.where(words > limit), "error", "too_long", F.col("doc_id"), F.concat_ws(" ", "name", words.cast("string"))),
    ])


def conflicts(sides: DataFrame, evidence: DataFrame) -> DataFrame:
    """sides(conflict_id, disposition, side, evidence_ids, text): unresolved conflicts, sides without known evidence, numbers no side's evidence has. evidence(evidence_id, value_tokens)."""
    each = sides.select("conflict_id", "side", "text", F.explode_outer("evidence_ids").alias("x")).select("conflict_id", "side", "text", F.trim("x").alias("evidence_id"))
    known = evidence.select(F.trim("evidence_id").alias("evidence_id"), "value_tokens")
    j = each.join(known, "evidence_id", "left")
    per = j.groupBy("conflict_id", "side").agg(F.first("text").alias("text"), F.count("value_tokens").alias("found"), F.flatten(F.collect_list(F.coalesce("value_tokens", F.array().cast("array<string>")))).alias("tokens"))
    return union([
        finding(sides.where(norm("disposition").isin("", "open")), "error", "unresolved", F.col("conflict_id"), F.lit("no disposition")),
        finding(per.where("found = 0"), "error", "side_without_evidence", F.col("conflict_id"), F.col("side")),
        finding(per.select("conflict_id", F.explode(F.array_except(L.numeric_tokens(F.col("text")), F.col("tokens"))).alias("t")), "warning", "number_not_in_evidence", F.col("conflict_id"), F.col("t")),
    ])


_WORD = re.compile(r"\w+|[^\w\s]")


def token_similarity(a: str, b: str) -> float:
    """Similarity of two texts as word sequences."""
    return difflib.SequenceMatcher(None, _WORD.findall(a or ""), _WORD.findall(b or ""), autojunk=False).ratio()


def section_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, name, change, similarity, preserved: sections of two versions (doc_id, name, text) joined by name.

    ``preserved`` is the share of the old paragraphs, each counted, that the new text still has.
    """
    j = old.withColumnRenamed("text", "o").join(new.withColumnRenamed("text", "n"), ["doc_id", "name"], "full_outer")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, name, o, n in zip(b["doc_id"], b["name"], b["o"], b["n"]):
                if o is None or n is None:
                    rows.append((k, name, "added" if o is None else "removed", None, None))
                    continue
                was = [p.strip() for p in re.split(r"\n\s*\n", o) if p.strip()]
                now = {p.strip() for p in re.split(r"\n\s*\n", n)}
                kept = sum(p in now for p in was) / len(was) if was else 1.0
                rows.append((k, name, "unchanged" if o == n else "changed", 1.0 if o == n else token_similarity(o, n), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "change", "similarity", "preserved"])

    return j.select("doc_id", "name", "o", "n").mapInPandas(each, f"doc_id {old.schema['doc_id'].dataType.simpleString()}, name string, change string, similarity double, preserved double")


def locality(diff: DataFrame, similarity: float = 0.55, preserved: float = 0.35) -> DataFrame:
    """Changed sections that a local revision wouldn't rewrite so far."""
    return finding(diff.where((F.col("change") == "changed") & ((F.col("similarity") < similarity) | (F.col("preserved") < preserved))), "error", "not_local", F.col("doc_id"), F.col("name"))


def numbered_names(sections: DataFrame) -> DataFrame:
    """Repeated section names of a document get their number: name (2)."""
    k = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("start"))
    return sections.withColumn("_k", k).withColumn("name", F.when(F.col("_k") > 1, F.concat(F.col("name"), F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))).otherwise(F.col("name"))).drop("_k")


def anchor_consistency(anchors: DataFrame, paragraphs: DataFrame, claims: DataFrame) -> DataFrame:
    """anchors(anchor, claim_id, label), paragraphs(anchor, text), claims(claim_id, required_value_tokens).

    Anchors without a paragraph, labels the paragraph doesn't show, one label under several anchors, and
    required numbers that the anchored paragraph lacks.
    """
    j = anchors.join(paragraphs.withColumnRenamed("text", "_t"), "anchor", "left")
    labels = anchors.where(norm("label") != "").groupBy(F.lower(norm("label")).alias("l")).agg(F.countDistinct("anchor").alias("k")).where("k > 1")
    need = j.where("_t is not null").join(claims, "claim_id").select("claim_id", F.explode(F.array_except(F.transform("required_value_tokens", lambda x: F.trim(x)), L.numeric_tokens(F.col("_t")))).alias("v")).where("v <> ''")
    return union([
        finding(j.where("_t is null"), "error", "no_such_anchor", F.col("claim_id"), F.coalesce("anchor", F.lit(""))),
        finding(j.where(F.col("_t").isNotNull() & (norm("label") != "") & ~F.lower("_t").contains(F.lower(norm("label")))), "error", "label_not_in_paragraph", F.col("claim_id"), norm("label")),
        finding(labels, "warning", "label_at_several_anchors", F.col("l"), F.col("k").cast("string")),
        finding(need, "error", "value_not_at_anchor", F.col("claim_id"), F.col("v")),
    ])


def reporting_contracts(contracts: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """contracts(contract_id, evidence_ids, required_sections, abstract_eligible), claims(claim_id, section, evidence_ids), evidence(evidence_id).

    Unknown evidence, required sections where no claim uses the contract's evidence, and ineligible evidence in the abstract.
    """
    need = contracts.select("contract_id", "abstract_eligible", F.explode("evidence_ids").alias("e")).select("contract_id", "abstract_eligible", F.trim("e").alias("e")).where("e <> ''")
    used = claims.select("claim_id", F.lower(norm("section")).alias("section"), F.explode("evidence_ids").alias("e")).select("claim_id", "section", F.trim("e").alias("e"))
    told = need.join(used, "e").select("contract_id", "section").distinct()
    want = contracts.select("contract_id", F.explode("required_sections").alias("s")).select("contract_id", F.lower(F.trim("s")).alias("section"))
    early = need.where("not abstract_eligible").join(used.where("section = 'abstract'"), "e")
    return union([
        finding(need.join(evidence.select(F.trim("evidence_id").alias("e")), "e", "left_anti"), "error", "no_such_evidence", F.col("contract_id"), F.col("e")),
        finding(want.join(told, ["contract_id", "section"], "left_anti"), "error", "not_reported", F.col("contract_id"), F.col("section")),
        finding(early, "error", "not_for_the_abstract", F.col("contract_id"), F.col("claim_id")),
    ])
