"""Literature ledgers: declarative screening rules, search coverage, study maps, synthesis states and flows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import filled, norm
from auditloom.operators.findings import finding, union

# ---- declarative screening rules


def field_text(fields: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[norm(f) for f in fields]))


def rule_condition(rule: dict) -> Column:
    """A rule {op, fields or field, values or pattern} as a condition; matching ignores case."""
    fields = rule.get("fields") or [rule["field"]]
    text, op = field_text(fields), rule["op"]
    values = [str(v).strip().lower() for v in rule.get("values") or []]
    any_of = lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0]
    all_of = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
    if op == "equals":
        return F.lower(norm(fields[0])).isin(*values)
    if op == "contains_any":
        return any_of([text.contains(v) for v in values])
    if op == "contains_all":
        return all_of([text.contains(v) for v in values])
    if op == "list_contains_any":
        parts = F.transform(F.split(F.lower(norm(fields[0])), r"[;,|\n]"), lambda x: F.trim(x))
        return F.arrays_overlap(parts, F.array(*[F.lit(v) for v in values]))
    if op == "regex":
        re.compile(rule["pattern"])
        return F.concat_ws(" ", *[norm(f) for f in fields]).rlike("(?i)" + rule["pattern"])
    if op == "exists":
        return text != ""
    if op == "missing":
        return F.trim(text) == ""
    raise ValueError(f"no such rule operator: {op}")


def matching_rules(records: DataFrame, rules: list[dict], key: str = "record_id") -> DataFrame:
    """key, rule_id for every enabled rule a record matches; all rules are one array, so records are read once."""
    live = [r for r in rules if r.get("enabled", True)]
    if not live:
        return records.select(key, F.lit("").alias("rule_id")).limit(0)
    hits = F.filter(F.array(*[F.when(F.coalesce(rule_condition(r), F.lit(False)), F.lit(r["id"])) for r in live]), lambda x: x.isNotNull())
    return records.select(key, F.explode(F.array_distinct(hits)).alias("rule_id")).distinct()


def merge_rules(declared: list[dict], derived: list[dict]) -> list[dict]:
    """Declared rules win over derived ones of the same id."""
    return [*declared, *[r for r in derived if r["id"] not in {d["id"] for d in declared}]]


# fixed values: publication types that an exclusion sentence may name
_TYPES = ("editorial", "letter", "comment", "erratum", "retraction", "conference abstract", "protocol", "dataset", "news")


def derive_type_rules(protocol: str) -> list[dict]:
    """Rules for publication types that a protocol's text says are excluded; other wording derives nothing."""
    out = []
    for sentence in re.split(r"(?<=[.;\n])", protocol or ""):
        if re.search(r"(?i)\bexclud", sentence) and not re.search(r"(?i)\bnot\s+exclud|\bno\b.*\bexclud", sentence):
            out += [{"id": f"type_{t.replace(' ', '_')}", "op": "equals", "field": "publication_type", "values": [t]} for t in _TYPES if re.search(rf"(?i)\b{t}s?\b", sentence)]
    return merge_rules([], list({r["id"]: r for r in out}.values()))


def new_decisions(matches: DataFrame, log: DataFrame) -> DataFrame:
    """Rule decisions that the append-only log hasn't yet, one a record."""
    return matches.groupBy("record_id").agg(F.min("rule_id").alias("reason_code")).join(log.select("record_id").distinct(), "record_id", "left_anti").select("record_id", F.lit("exclude").alias("decision"), "reason_code")


# ---- search ledger


def effective_status() -> Column:
    """The declared status, else one inferred from the notes; success with fewer imports than results is partial."""
    declared, notes = F.lower(norm("search_status")), F.lower(norm("notes"))
    s = F.when(declared != "", declared).when(notes.rlike("fail|error|timeout"), "failed").when(notes.rlike("partial|truncat"), "partial").when(norm("result_count") != "", "succeeded").otherwise("unknown")
    n = lambda c: norm(c).try_cast("bigint")
    return F.when((s == "succeeded") & (n("result_count") > n("imported_count")), "partial").otherwise(s)


def source_status(log: DataFrame, targets: list[str]) -> DataFrame:
    """source, queries, status of every target source."""
    want = log.sparkSession.createDataFrame([(t,) for t in targets], "source string")
    s = log.select(norm("source").alias("source"), effective_status().alias("s")).groupBy("source").agg(F.count(F.lit(1)).alias("queries"), F.min(F.col("s") == "succeeded").alias("all_ok"), F.min(F.col("s") == "failed").alias("all_bad"), F.min(F.col("s") == "unknown").alias("none_known"))
    status = F.when(F.col("queries").isNull(), "not_attempted").when(F.col("all_ok"), "succeeded").when(F.col("all_bad"), "failed").when(F.col("none_known"), "unknown").otherwise("partial")
    return want.join(s, "source", "left").select("source", F.coalesce("queries", F.lit(0)).alias("queries"), status.alias("status"))


def search_audit(log: DataFrame, targets: list[str], stages: list[str]) -> DataFrame:
    """Sources that weren't searched or failed, repeated and blank query ids, missing dates, counts that don't add up, stages without a query, unknown sources."""
    st = source_status(log, targets)
    n = lambda c: norm(c).try_cast("bigint")
    q = F.coalesce("query_id", F.lit(""))
    want = log.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return union([
        finding(st.where("status in ('not_attempted', 'failed', 'unknown')"), "error", "source_coverage", F.col("source"), F.col("status")),
        finding(st.where("status = 'partial'"), "warning", "source_coverage", F.col("source"), F.col("status")),
        finding(log.where(norm("query_id") == ""), "error", "no_query_id", norm("source"), F.lit("a query has no id")),
        finding(log.where(norm("query_id") != "").groupBy(norm("query_id").alias("q")).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "error", "repeated_query_id", F.col("q"), F.col("k").cast("string")),
        finding(log.where(norm("searched_at") == ""), "error", "no_date", q, F.lit("searched_at is blank")),
        finding(log.where(n("imported_count") > n("result_count")), "error", "counts", q, F.lit("more imported than found")),
        finding(log.where(n("new_unique_count") > n("imported_count")), "error", "counts", q, F.lit("more unique than imported")),
        finding(want.join(log.select(norm("search_stage").alias("stage")).distinct(), "stage", "left_anti"), "error", "stage_missing", F.col("stage"), F.lit("no query of this stage")),
        finding(log.where((norm("source") != "") & ~norm("source").isin(*targets)), "warning", "unknown_source", q, norm("source")),
    ])


def marginal_yield(log: DataFrame) -> DataFrame:
    """search_stage, queries, known (with all of screened and included counts), screened, included, stopping (supported, unsupported, incomplete)."""
    n = lambda c: norm(c).try_cast("bigint")
    known = n("new_screened_count").isNotNull() & n("new_included_count").isNotNull()
    g = log.groupBy(norm("search_stage").alias("search_stage")).agg(F.count(F.lit(1)).alias("queries"), F.count(F.when(known, 1)).alias("known"), F.sum(n("new_screened_count")).alias("screened"), F.sum(n("new_included_count")).alias("included"), F.max(F.when(norm("stopping_evidence") != "", 1)).alias("_e"))
    return g.withColumn("stopping", F.when(F.col("known") < F.col("queries"), "incomplete").when(F.col("_e").isNotNull() & (F.coalesce("included", F.lit(0)) == 0), "supported").otherwise("unsupported")).drop("_e")


def sum_known(df: DataFrame, field: str) -> DataFrame:
    """total, known, missing of a text count column."""
    x = norm(field).try_cast("bigint")
    return df.agg(F.sum(x).alias("total"), F.count(x).alias("known"), F.count(F.when(x.isNull(), 1)).alias("missing"))


# ---- screening


def duplicate_fulltext(events: DataFrame) -> DataFrame:
    """Full-text decisions of a record that repeat one evidence basis: (record_id, stage, evidence_basis, decision) more than once."""
    g = events.where(norm("stage").startswith("full_text") & (norm("evidence_basis") != "")).groupBy("record_id", norm("evidence_basis").alias("basis"), norm("decision").alias("decision")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return finding(g, "warning", "repeated_full_text", F.col("record_id"), F.concat_ws(" ", "decision", F.col("k").cast("string")))


def uncertain_with_rule(screening: DataFrame, records: DataFrame, rules: list[dict]) -> DataFrame:
    """Records left uncertain although a rule decides them."""
    left = screening.where(F.lower(norm("decision")) == "uncertain").select("record_id").distinct()
    return finding(matching_rules(records, rules).join(left, "record_id", "left_semi"), "warning", "uncertain_but_ruled", F.col("record_id"), F.col("rule_id"))


def flow(stages: DataFrame) -> DataFrame:
    """stages(stage, position, entered, removed): steps whose entered minus removed isn't what the next one enters."""
    nxt = stages.select((F.col("position") - 1).alias("position"), F.col("entered").alias("next_in"), F.col("stage").alias("next_stage"))
    j = stages.join(nxt, "position")
    return finding(j.where(F.col("entered") - F.col("removed") != F.col("next_in")), "error", "flow", F.col("stage"), F.concat(F.lit("leaves "), (F.col("entered") - F.col("removed")).cast("string"), F.lit(", "), F.col("next_stage"), F.lit(" enters "), F.col("next_in").cast("string")))


# ---- studies and synthesis


def study_audit(studies: DataFrame, screening: DataFrame) -> DataFrame:
    """studies(record_id, study_id, report_role, linkage_basis): included records without a study, mapped records that aren't included, several studies of a record, studies without or with several primary reports, links without basis."""
    inc = screening.where(F.lower(norm("decision")) == "include").select("record_id").distinct()
    m = studies.select("record_id", norm("study_id").alias("study_id"), F.lower(norm("report_role")).alias("role"), norm("linkage_basis").alias("basis"))
    primary = m.where("study_id <> ''").groupBy("study_id").agg(F.count(F.when(F.col("role") == "primary", 1)).alias("p"), F.count(F.lit(1)).alias("n"))
    return union([
        finding(inc.join(m.where("study_id <> ''").select("record_id"), "record_id", "left_anti"), "error", "included_without_study", F.col("record_id"), F.lit("no study is mapped")),
        finding(m.select("record_id").distinct().join(inc, "record_id", "left_anti"), "warning", "mapped_not_included", F.col("record_id"), F.lit("the record isn't included")),
        finding(m.where("study_id <> ''").groupBy("record_id").agg(F.countDistinct("study_id").alias("k")).where("k > 1"), "error", "several_studies", F.col("record_id"), F.col("k").cast("string")),
        finding(primary.where("p <> 1"), "error", "primary_reports", F.col("study_id"), F.col("p").cast("string")),
        finding(m.where("study_id <> '' and role <> 'primary' and basis = ''"), "warning", "no_linkage_basis", F.col("record_id"), F.col("study_id")),
    ])


def study_summary(studies: DataFrame) -> DataFrame:
    m = studies.where(filled("study_id").isNotNull())
    return m.groupBy(norm("study_id").alias("study_id")).agg(F.countDistinct("record_id").alias("reports"), F.array_join(F.array_sort(F.collect_set(F.lower(norm("report_role")))), ";").alias("roles"))


def synthesis_states(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """synthesis_id, sources, studies, support, contradict, state.

    links(synthesis_id, claim_id, relation), evidence(claim_id, source_id, study_id, support_level, verification_status): only direct or
    derived, verified or partial evidence counts, by study, else source.
    """
    ok = F.lower(norm("support_level")).isin("direct", "derived") & F.lower(norm("verification_status")).isin("verified", "partial")
    e = evidence.where(ok).select("claim_id", norm("source_id").alias("source"), F.coalesce(filled("study_id"), norm("source_id")).alias("unit"))
    j = links.select("synthesis_id", "claim_id", F.lower(norm("relation")).alias("r")).join(e, "claim_id", "left")
    d = lambda c, on=None: F.countDistinct(F.when(on, F.col(c)) if on is not None else F.col(c))
    a = j.groupBy("synthesis_id").agg(d("source").alias("sources"), d("unit").alias("studies"), d("unit", F.col("r") == "supports").alias("support"), d("unit", F.col("r") == "contradicts").alias("contradict"))
    s, c = F.col("support"), F.col("contradict")
    state = F.when((s > 0) & (c > 0), "mixed").when((s >= 2) & (c == 0), "consistent").when((s == 1) & (F.col("sources") == 1), "single_source").when(s == 1, "single_study").when(c > 0, "contradicted").otherwise("gap")
    return a.withColumn("state", state)


def synthesis_audit(claims: DataFrame, states: DataFrame) -> DataFrame:
    """Declared states that the evidence doesn't give, and strong wording over a thin base: claims(synthesis_id, statement, evidence_state)."""
    j = claims.join(states, "synthesis_id", "left")
    causal = F.lower(norm("statement")).rlike(r"\b(causes?|caused|leads? to|results? in|proves?|demonstrates that)\b")
    return union([
        finding(j.where(F.lower(norm("evidence_state")) != F.coalesce("state", F.lit("gap"))), "error", "evidence_state", F.col("synthesis_id"), F.concat(norm("evidence_state"), F.lit(" but "), F.coalesce("state", F.lit("gap")))),
        finding(j.where(causal & (F.coalesce("studies", F.lit(0)) < 2)), "warning", "causal_wording", F.col("synthesis_id"), F.lit("causal wording over fewer than two studies")),
        finding(claims.where(norm("statement") == ""), "error", "no_statement", F.col("synthesis_id"), F.lit("the statement is blank")),
    ])


# ---- results against a current run


def result_sanity(results: DataFrame) -> DataFrame:
    """p missing or outside 0 to 1, values that are not finite, intervals out of order or without the estimate, adjusted p below p, levels outside 0 to 1, negative n; blank and repeated keys."""
    e = F.concat_ws("/", norm("analysis_id"), norm("analysis_item_id"))
    c = F.col
    bad = [
        ("p_range", ~c("p_value").between(0, 1)), ("p_adjusted", (c("p_adjusted") < c("p_value") - 1e-12) | ~c("p_adjusted").between(0, 1)), ("ci_order", c("ci_low") > c("ci_high")),
        ("estimate_outside", (c("estimate") < c("ci_low")) | (c("estimate") > c("ci_high"))), ("level", (c("ci_level") <= 0) | (c("ci_level") >= 1)), ("n", c("n") < 0),
        ("not_finite", F.isnan("effect_size") | (F.abs("effect_size") == float("inf")) | (F.abs("statistic") == float("inf"))), ("p_missing", c("p_value").isNull()),
    ]
    ok = results.select("*", F.filter(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(r)) for r, b in bad]), lambda x: x.isNotNull()).alias("_bad"))
    flagged = ok.select(e.alias("_e"), F.explode("_bad").alias("_r"))
    return union([
        flagged.select(F.lit("error").alias("severity"), F.col("_r").alias("rule"), F.col("_e").alias("entity_id"), F.lit("the values don't fit together").alias("message")),
        finding(results.where((norm("analysis_id") == "") | (norm("analysis_item_id") == "")), "error", "blank_key", e, F.lit("a key part is blank")),
    ])
