"""Linkage, ledger audits, spans and reconciliations over the ledger and star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import ledger as L
from auditloom.functions.text import norm
from auditloom.operators import figures, findings, graph, hashing, linkage, literature, manuscript, power, runs, spans
from auditloom.operators.ordering import with_running_sum
from auditloom.plans.tables import table
from auditloom.scratch import Scratch
from auditloom.streaming import ledgers as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}
RELATIONS = ["backward_reference", "forward_citation", "discovery_from", "companion", "same_study_version", "version_of"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---- linkage

_DOI = r"regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(coalesce(doi, ''))), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', '')), '[.,;)]+$', '')"
_TITLE = r"trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_KEY = f"""CASE WHEN {_DOI} <> '' THEN 'doi:' || {_DOI} WHEN trim(coalesce(pmid, '')) <> '' THEN 'pmid:' || lower(trim(pmid)) WHEN trim(coalesce(pmcid, '')) <> '' THEN 'pmcid:' || lower(trim(pmcid))
  WHEN trim(coalesce(arxiv_id, '')) <> '' THEN 'arxiv:' || lower(trim(arxiv_id)) WHEN {_TITLE} <> '' THEN 'title:' || {_TITLE} END"""


@query("normalize_records", f"""SELECT DISTINCT record_id, {_DOI} AS doi, {_TITLE} AS title, 'R' || substr(sha1(CASE WHEN {_DOI} <> '' THEN 'doi:' || {_DOI} WHEN trim(coalesce(pmid, '')) <> '' THEN 'pmid:' || lower(trim(pmid))
  WHEN trim(coalesce(arxiv_id, '')) <> '' THEN 'arxiv:' || lower(trim(arxiv_id)) ELSE {_TITLE} || '|' || trim(coalesce(year, '')) || '|' || substr(lower(trim(coalesce(authors, ''))), 1, 80) END), 1, 12) AS stable_id FROM records""")
def normalize_records(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    basis = L.record_basis(c("doi"), c("pmid"), c("arxiv_id"), c("title"), c("year"), c("authors"))
    return table(s, d, "records").select("record_id", L.norm_doi(c("doi")).alias("doi"), L.norm_title_ascii(c("title")).alias("title"), L.stable_id("R", basis).alias("stable_id")).distinct()


@query("dedup_exact", f"""WITH k AS (SELECT DISTINCT record_id, {_KEY} AS match_key FROM records) SELECT record_id, match_key, min(record_id) OVER (PARTITION BY match_key) AS group_id FROM k WHERE match_key IS NOT NULL""")
def dedup_exact(s: SparkSession, d: str) -> DataFrame:
    return linkage.exact_groups(table(s, d, "records"))


@query("merged_records")
def merged_records(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "records")
    return linkage.merge_records(r, linkage.duplicate_groups(r), ["title", "authors", "year", "venue", "doi", "pmid", "source"])


_STOPS = ", ".join(f"'{w}'" for w in "a an and are as at be been by can could for from has have in into is it its may method methods model models of on or our paper result results study studies system systems that the their this to using via was we were with".split())


def _topic_texts(s: SparkSession, d: str) -> DataFrame:
    """record_id, text: title and abstract of every record."""
    return table(s, d, "records").groupBy("record_id").agg(F.max(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))).alias("text"))


@query("tfidf_weights", f"""WITH r AS (SELECT record_id, max(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS title FROM records GROUP BY 1), t AS (SELECT record_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9_-]{{2,}}')) AS term FROM r),
  f AS (SELECT record_id, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOPS}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term), n AS (SELECT count(*) AS n FROM r),
  w AS (SELECT record_id, term, tf, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS raw FROM f JOIN df USING (term), n)
  SELECT record_id, term, tf, df, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY record_id)), 6) AS weight FROM w""")
def tfidf_weights(s: SparkSession, d: str) -> DataFrame:
    return linkage.tfidf(_topic_texts(s, d), "record_id", F.col("text")).withColumn("weight", F.round("weight", 6))


@query("screening_rules", """WITH r AS (SELECT DISTINCT record_id, lower(coalesce(title, '')) AS t, lower(trim(coalesce(publication_type, ''))) AS p, trim(coalesce(year, '')) AS y FROM records)
  SELECT record_id, rule_id FROM (SELECT record_id, unnest([CASE WHEN contains(t, 'sensitivity') OR contains(t, 'robust') THEN 'any_term' END, CASE WHEN contains(t, 'primary') AND contains(t, 'outcome') THEN 'all_terms' END,
    CASE WHEN p = 'dataset' THEN 'type' END, CASE WHEN y = '' THEN 'no_year' END, CASE WHEN regexp_matches(y, '^20(1[0-4]|0[0-9])') THEN 'old' END]) AS rule_id FROM r) WHERE rule_id IS NOT NULL""")
def screening_rules(s: SparkSession, d: str) -> DataFrame:
    rules = [{"id": "any_term", "op": "contains_any", "field": "title", "values": ["sensitivity", "robust"]}, {"id": "all_terms", "op": "contains_all", "field": "title", "values": ["primary", "outcome"]}, {"id": "type", "op": "equals", "field": "publication_type", "values": ["dataset"]}, {"id": "no_year", "op": "missing", "field": "year"}, {"id": "old", "op": "regex", "field": "year", "pattern": "^20(1[0-4]|0[0-9])"}]
    return literature.matching_rules(table(s, d, "records"), rules)


@query("source_coverage", """WITH t AS (SELECT unnest(['index_a', 'index_b', 'manual', 'registry']) AS source), r AS (SELECT trim(coalesce(source, '')) AS source, count(*) AS queries, count(*) FILTER (trim(coalesce(abstract, '')) <> '') AS good FROM records GROUP BY 1)
  SELECT t.source, coalesce(queries, 0) AS queries, CASE WHEN queries IS NULL THEN 'not_attempted' WHEN good = queries THEN 'succeeded' WHEN good = 0 THEN 'failed' ELSE 'partial' END AS status FROM t LEFT JOIN r USING (source)""")
def source_coverage(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    log = table(s, d, "records").select("source", F.when(norm("abstract") != "", "succeeded").otherwise("failed").alias("search_status"), none.alias("notes"), none.alias("result_count"), none.alias("imported_count"))
    return literature.source_status(log, ["index_a", "index_b", "manual", "registry"])


@query("flow_counts", """SELECT coalesce(nullif(lower(trim(publication_type)), ''), 'blank') AS publication_type, count(*) AS rows, count(DISTINCT record_id) AS records, count(*) FILTER (deleted_at IS NOT NULL) AS deleted FROM records GROUP BY 1""")
def flow_counts(s: SparkSession, d: str) -> DataFrame:
    p = F.lower(norm("publication_type"))
    return table(s, d, "records").groupBy(F.when(p == "", "blank").otherwise(p).alias("publication_type")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_id").alias("records"), F.count("deleted_at").alias("deleted"))


_NODES = "nd AS (SELECT 'record' AS type, trim(record_id) AS id FROM records UNION SELECT 'claim', trim(claim_id) FROM claims UNION SELECT 'evidence', trim(evidence_id) FROM evidence UNION SELECT 'source', trim(source_id) FROM sources)"
_EDGES = """ed AS (SELECT lower(trim(coalesce(relation, ''))) AS type, trim(coalesce(source_id, '')) AS source, trim(coalesce(target_id, '')) AS target FROM citation_trail UNION SELECT 'claim_evidence', trim(claim_id), trim(x) FROM (SELECT claim_id, unnest(evidence_ids) AS x FROM claims)
  UNION SELECT 'evidence_source', trim(evidence_id), trim(source_id) FROM evidence), ek AS (SELECT * FROM ed WHERE source <> '' AND target <> '')"""


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(s, d, n)
    return graph.nodes(t("records"), t("claims"), t("evidence"), t("sources")), graph.edges(t("citation_trail"), t("claims"), t("evidence"))


@query("graph_nodes", f"WITH {_NODES} SELECT type, id FROM nd WHERE id <> ''")
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d)[0]


@query("graph_edges", f"WITH {_EDGES} SELECT type, source, target FROM ek")
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d)[1]


@query("graph_counts", f"WITH {_NODES}, {_EDGES} SELECT 'node' AS part, type, count(*) AS n FROM nd WHERE id <> '' GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM ek GROUP BY type")
def graph_counts(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(s, d)
    return nodes.select(F.lit("node").alias("part"), "type").unionByName(edges.select(F.lit("edge").alias("part"), "type")).groupBy("part", "type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_dangling", f"""WITH {_NODES}, {_EDGES} SELECT type, source, target, 'source' AS missing FROM ek WHERE type = 'claim_evidence' AND source NOT IN (SELECT id FROM nd WHERE type = 'claim' AND id IS NOT NULL) UNION ALL SELECT type, source, target, 'target' FROM ek WHERE type = 'claim_evidence' AND target NOT IN (SELECT id FROM nd WHERE type = 'evidence' AND id IS NOT NULL)
  UNION ALL SELECT type, source, target, 'source' FROM ek WHERE type = 'evidence_source' AND source NOT IN (SELECT id FROM nd WHERE type = 'evidence' AND id IS NOT NULL) UNION ALL SELECT type, source, target, 'target' FROM ek WHERE type = 'evidence_source' AND target NOT IN (SELECT id FROM nd WHERE type = 'source' AND id IS NOT NULL)""")
def graph_dangling(s: SparkSession, d: str) -> DataFrame:
    return graph.dangling(*_graph(s, d), {"claim_evidence": ("claim", "evidence"), "evidence_source": ("evidence", "source")})


# ---- audits

@query("citation_audit", f"""WITH e AS (SELECT trim(coalesce(source_id, '')) AS s, trim(coalesce(target_id, '')) AS t, lower(trim(coalesce(relation, ''))) AS r FROM citation_trail),
  f AS (SELECT 'error' AS severity, 'self_edge' AS rule, s || '->' || t AS entity_id, 'an edge from a record to itself' AS message FROM e WHERE s = t AND s <> ''
    UNION ALL SELECT 'error', 'unknown_relation', s || '->' || t, 'relation ' || r FROM e WHERE r NOT IN ({", ".join(f"'{r}'" for r in RELATIONS)})
    UNION ALL SELECT 'warning', 'repeated_edge', s || '->' || t, 'times ' || count(*) FROM e GROUP BY s, t, r HAVING count(*) > 1
    UNION ALL SELECT 'error', 'unknown_end', id, 'no such record' FROM (SELECT s AS id FROM e UNION SELECT t FROM e) WHERE id <> '' AND id NOT IN (SELECT record_id FROM records WHERE record_id IS NOT NULL)
    UNION ALL SELECT 'error', 'blank_end', s || '->' || t, 'an end is blank' FROM e WHERE s = '' OR t = '')
  SELECT DISTINCT * FROM f""")
def citation_audit(s: SparkSession, d: str) -> DataFrame:
    return findings.citation_trail(table(s, d, "citation_trail"), table(s, d, "records"), RELATIONS)


_LATEST_CLAIMS = "(SELECT * FROM claims WHERE claim_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(claim_id) ORDER BY loaded_at DESC) = 1)"


@query("claim_lifecycle", f"""WITH c AS {_LATEST_CLAIMS}, dn AS (SELECT DISTINCT trim(claim_id) AS parent, trim(x) AS child FROM (SELECT claim_id, unnest(supersedes_claim_ids) AS x FROM c) WHERE trim(x) <> ''),
  up AS (SELECT DISTINCT trim(x) AS parent, trim(claim_id) AS child FROM (SELECT claim_id, unnest(superseded_by_claim_ids) AS x FROM c) WHERE trim(x) <> ''), s AS (SELECT trim(claim_id) AS id, lower(trim(coalesce(lifecycle_state, ''))) AS st, trim(coalesce(retirement_reason, '')) AS why, coalesce(len(superseded_by_claim_ids), 0) AS k FROM c)
  SELECT DISTINCT * FROM (SELECT 'error' AS severity, 'not_reciprocal' AS rule, parent AS entity_id, 'supersedes ' || child || ', which doesn''t say so' AS message FROM dn ANTI JOIN up USING (parent, child)
    UNION ALL SELECT 'error', 'not_reciprocal', child, 'superseded by ' || parent || ', which doesn''t say so' FROM up ANTI JOIN dn USING (parent, child)
    UNION ALL SELECT 'error', 'active_but_superseded', id, 'an active claim is superseded' FROM s WHERE st IN ('', 'active') AND k > 0
    UNION ALL SELECT 'warning', 'no_reason', id, st || ' without a reason' FROM s WHERE st IN ('superseded', 'retired') AND why = ''
    UNION ALL SELECT 'error', 'self_link', parent, 'a claim supersedes itself' FROM dn WHERE parent = child)""")
def claim_lifecycle(s: SparkSession, d: str) -> DataFrame:
    return findings.claim_lifecycle(table(s, d, "claims"))


@query("claim_families", f"""WITH c AS (SELECT * FROM {_LATEST_CLAIMS} WHERE lower(trim(coalesce(lifecycle_state, ''))) IN ('', 'active') AND trim(coalesce(claim_family_id, '')) <> ''),
  b AS (SELECT trim(claim_family_id) AS family_id, count(*) AS members, array_to_string(list_sort(list(DISTINCT trim(coalesce(section, '')))), ';') AS sections, array_to_string(list_sort(list(DISTINCT trim(coalesce(strength, '')))), ';') AS strengths, array_to_string(list_sort(list(DISTINCT trim(coalesce(source_scope, '')))), ';') AS scopes FROM c GROUP BY 1),
  u AS (SELECT f, e, count(DISTINCT id) AS k FROM (SELECT trim(claim_family_id) AS f, trim(claim_id) AS id, unnest(list_transform(evidence_ids, lambda x: trim(x))) AS e FROM c) WHERE e <> '' GROUP BY f, e)
  SELECT b.*, (SELECT count(*) FROM u WHERE u.f = b.family_id AND u.k = b.members) AS shared_evidence FROM b""")
def claim_families(s: SparkSession, d: str) -> DataFrame:
    return findings.claim_families(table(s, d, "claims"))


@query("evidence_state", f"""WITH c AS {_LATEST_CLAIMS}, e AS (SELECT trim(evidence_id) AS e, lower(trim(coalesce(verification, ''))) AS v, trim(coalesce(source_id, '')) AS s FROM evidence WHERE evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(evidence_id) ORDER BY loaded_at DESC, verification DESC NULLS LAST, source_id DESC NULLS LAST) = 1),
  l AS (SELECT DISTINCT trim(claim_id) AS claim_id, trim(x) AS e FROM (SELECT claim_id, unnest(evidence_ids) AS x FROM c)), i AS (SELECT trim(claim_id) AS claim_id FROM c),
  a AS (SELECT i.claim_id, count(*) FILTER (v IN ('verified', 'partial')) AS evidence, count(*) FILTER (v = 'verified') AS verified, count(DISTINCT s) FILTER (v IN ('verified', 'partial') AND s <> '') AS sources FROM i LEFT JOIN l USING (claim_id) LEFT JOIN e USING (e) GROUP BY 1)
  SELECT *, CASE WHEN evidence = 0 THEN 'gap' WHEN sources <= 1 THEN 'single_source' ELSE 'consistent' END AS state FROM a""")
def evidence_state(s: SparkSession, d: str) -> DataFrame:
    return findings.evidence_state(table(s, d, "claims"), table(s, d, "evidence"))


@query("reconcile_events", """WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 16 WHEN 'signup' THEN 20 WHEN 'purchase' THEN 40 ELSE 0 END AS st, CASE WHEN value >= 10 THEN 'include' ELSE 'exclude' END AS dec FROM events),
  t AS (SELECT user_id, max(st) AS top, count(*) AS n FROM e GROUP BY 1)
  SELECT user_id, any_value(top) AS stage, arg_max(dec, event_id) AS decision, any_value(n) AS events, count(DISTINCT dec) AS decisions, count(DISTINCT dec) > 1 AS conflict FROM e JOIN t USING (user_id) WHERE st = top GROUP BY 1""")
def reconcile_events(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rank = F.when(kind == "view", 10).when(kind == "click", 16).when(kind == "signup", 20).when(kind == "purchase", 40).otherwise(0)
    e = table(s, d, "events").withColumn("decided", F.when(F.col("value") >= 10, "include").otherwise("exclude"))
    return findings.reconcile_events(e, "user_id", rank, "decided", ["event_id"])


@query("orphan_keys", "SELECT DISTINCT 'error' AS severity, 'no_such_customer' AS rule, CAST(o_orderkey AS VARCHAR) AS entity_id, CAST(o_custkey AS VARCHAR) AS message FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def orphan_keys(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    return manuscript.foreign_keys(orders, "o_orderkey", "o_custkey", table(s, d, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").cast("string").alias("c_custkey")), "c_custkey", "no_such_customer").distinct()


@query("missing_children", "SELECT DISTINCT 'error' AS severity, 'no_large_order' AS rule, CAST(c_custkey AS VARCHAR) AS entity_id, CAST(c_custkey AS VARCHAR) AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def missing_children(s: SparkSession, d: str) -> DataFrame:
    customers = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"))
    large = table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("o_custkey"))
    return manuscript.foreign_keys(customers, "c_custkey", "c_custkey", large, "o_custkey", "no_large_order").distinct()


_OLD = "(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)"
_NEW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 0.01 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 19 <> 0)"


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two derived states of the orders: the second misses some, adds some and changes some."""
    o, k = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    new = o.where(k % 19 != 0).withColumn("o_orderstatus", F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 17 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))
    return o.where(k % 11 != 0), new


@query("full_outer_reconcile", f"""WITH e AS {_OLD}, a AS {_NEW}
  SELECT e.o_orderkey, 'o_orderstatus' AS field, 'differs' AS kind FROM e JOIN a USING (o_orderkey) WHERE e.o_orderstatus IS DISTINCT FROM a.o_orderstatus
  UNION ALL SELECT e.o_orderkey, 'o_totalprice', 'differs' FROM e JOIN a USING (o_orderkey) WHERE abs(e.o_totalprice - a.o_totalprice) > greatest(1e-10 * greatest(abs(e.o_totalprice), abs(a.o_totalprice)), 1e-12)
  UNION ALL SELECT o_orderkey, '', 'missing' FROM e ANTI JOIN a USING (o_orderkey) UNION ALL SELECT o_orderkey, '', 'unexpected' FROM a ANTI JOIN e USING (o_orderkey)""")
def full_outer_reconcile(s: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(s, d)
    return findings.full_compare(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("state_diff", f"""WITH e AS (SELECT o_orderkey, coalesce(o_orderstatus, '') || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS h FROM {_OLD}), a AS (SELECT o_orderkey, coalesce(o_orderstatus, '') || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS h FROM {_NEW})
  SELECT CASE WHEN e.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM e FULL JOIN a USING (o_orderkey) WHERE e.h IS DISTINCT FROM a.h GROUP BY 1""")
def state_diff(s: SparkSession, d: str) -> DataFrame:
    state = lambda o: hashing.record_state(o.select(F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), "orders", "k", ["o_orderstatus", "cents"])
    old, new = _snapshots(s, d)
    return hashing.diff_states(state(old), state(new)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("interval_overlap", """WITH i AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(floor(value * 600) AS BIGINT) AS b FROM events),
  w AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_until FROM i) SELECT user_id, event_id, a, b, covered_until FROM w WHERE a < covered_until""")
def interval_overlap(s: SparkSession, d: str) -> DataFrame:
    a = F.unix_seconds(F.col("ts").cast("timestamp"))
    i = table(s, d, "events").select("user_id", "event_id", a.alias("a"), (a + F.floor(F.col("value") * 600)).alias("b"))
    return spans.overlaps(i, ["user_id"], "a", "b", "event_id", Scratch(s, "sweep")).select("user_id", "event_id", "a", "b", "covered_until")


@query("retry_sequence", """WITH a AS (SELECT user_id, event_id, ts, ts + INTERVAL 1 HOUR AS f, event_type = 'purchase' AS ok FROM events)
  SELECT user_id, event_id, coalesce(bool_or(ok) OVER w, false) AS after_success, coalesce(ts < max(f) OVER w, false) AS overlap FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def retry_sequence(s: SparkSession, d: str) -> DataFrame:
    return findings.retries(table(s, d, "events"), ["user_id"], "ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"), F.col("event_type") == "purchase", "event_id", Scratch(s, "retries"))


@query("impact_semi_chain", """SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#17' AND p_size > 40))""")
def impact_semi_chain(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").where("p_brand = 'Brand#17' and p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi").distinct()


@query("paired_benchmark", """WITH v AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1), p AS (SELECT a, b, b - a AS d FROM v WHERE a IS NOT NULL AND b IS NOT NULL)
  SELECT count(*) AS cases, round(avg(a), 5) AS mean_a, round(avg(b), 5) AS mean_b, round(avg(d), 5) AS mean_delta, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM p""")
def paired_benchmark(s: SparkSession, d: str) -> DataFrame:
    runs_ = table(s, d, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("variant")).agg(F.create_map(F.lit("value"), F.avg("value")).alias("scores"))
    r = figures.win_tie_loss(figures.paired_scores(runs_, "view", "purchase", "value").where("delta is not null"))
    return r.select("cases", *[F.round(c, 5).alias(c) for c in ("mean_a", "mean_b", "mean_delta")], "wins", "ties", "losses")


@query("failure_pivot", "SELECT l_returnflag AS severity, l_linestatus AS category, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def failure_pivot(s: SparkSession, d: str) -> DataFrame:
    return figures.failure_counts(table(s, d, "lineitem").select(F.array(F.struct(F.col("l_linestatus").alias("category"), F.col("l_returnflag").alias("severity"))).alias("failures")))


@query("numeric_tokens", r"SELECT evidence_id, list_transform(regexp_extract_all(coalesce(statement, ''), '[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?'), lambda x: regexp_replace(x, '[,+]', '', 'g')) AS tokens FROM (SELECT DISTINCT evidence_id, statement FROM evidence)")
def numeric_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "evidence").select("evidence_id", "statement").distinct().select("evidence_id", L.numeric_tokens(F.col("statement")).alias("tokens"))


@query("citation_keys", r"SELECT doc_id, list_transform(regexp_extract_all(text, '@([A-Za-z0-9_:.-]*[A-Za-z0-9_])', 1), lambda x: x) AS keys FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '\[([^\[\]]*@[^\[\]]*)\]', 1), ' ') AS text FROM documents WHERE text IS NOT NULL) WHERE len(regexp_extract_all(text, '@([A-Za-z0-9_:.-]*[A-Za-z0-9_])', 1)) > 0")
def citation_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", L.citation_keys(F.col("text")).alias("keys")).where("size(keys) > 0")


@query("multiset_equality", "SELECT CAST((SELECT count(*) FROM (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_discount < 0.05 EXCEPT ALL SELECT l_suppkey, l_quantity FROM lineitem WHERE l_tax < 0.04)) AS BIGINT) AS only_left, CAST((SELECT count(*) FROM (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_tax < 0.04 EXCEPT ALL SELECT l_suppkey, l_quantity FROM lineitem WHERE l_discount < 0.05)) AS BIGINT) AS only_right")
def multiset_equality(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    return findings.multiset_difference(t.where("l_discount < 0.05"), t.where("l_tax < 0.04"), ["l_suppkey", "l_quantity"])


@query("planned_cross", """WITH p AS (SELECT user_id, unnest(['view', 'click', 'purchase', 'signup', 'error', 'refund']) AS event_type FROM (SELECT DISTINCT user_id FROM events)) SELECT p.user_id, p.event_type FROM p ANTI JOIN events e ON p.user_id = e.user_id AND p.event_type = e.event_type""")
def planned_cross(s: SparkSession, d: str) -> DataFrame:
    return runs.missing_cells(table(s, d, "events"), "user_id", "event_type", ["view", "click", "purchase", "signup", "error", "refund"])


@query("tolerance_state", """WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS obs, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1), g AS (SELECT avg(l_extendedprice) AS rep FROM lineitem)
  SELECT CASE WHEN obs BETWEEN rep - 500 AND rep + 500 THEN 'reproduced' WHEN obs BETWEEN rep - 1000 AND rep + 1000 THEN 'partially_reproduced' ELSE 'not_reproduced' END AS state, count(*) AS n FROM m, g GROUP BY 1""")
def tolerance_state(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem")
    rep = t.agg(F.avg("l_extendedprice").alias("r")).scalar()
    m = t.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("obs")).withColumn("rep", rep)
    return m.groupBy(findings.tolerance_state(F.col("rep"), F.col("obs"), F.col("rep") - 500, F.col("rep") + 500).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("overlap_boxes", """WITH b AS (SELECT p_partkey, p_partkey * 10.0::DOUBLE AS x, CAST(p_size AS DOUBLE) AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / least(a.w, b.w), 6) AS ratio FROM b a JOIN b ON a.p_partkey < b.p_partkey AND a.x < b.x + b.w AND b.x < a.x + a.w""")
def overlap_boxes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 10.0).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("p_size").cast("double").alias("w"), F.lit(1.0).alias("h"))
    return figures.box_overlaps(p, p.select(F.col("id").alias("parent"), F.col("id").alias("child")), 0.0, 64.0).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def content_hashes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


# ---- documents with markers

@query("claim_spans")
def claim_spans(s: SparkSession, d: str) -> DataFrame:
    return spans.document_spans(table(s, d, "documents")).where("kind <> 'paragraph'")


@query("span_coverage")
def span_coverage(s: SparkSession, d: str) -> DataFrame:
    return spans.coverage(spans.document_spans(table(s, d, "documents")), "doc_id")


@query("asof_section")
def asof_section(s: SparkSession, d: str) -> DataFrame:
    sp = spans.document_spans(table(s, d, "documents"))
    return spans.sections_of(sp.where("kind = 'claim'").select("doc_id", "name", "start"), sp, "doc_id", "start")


@query("object_labels", r"""SELECT DISTINCT source_id, lower(regexp_extract(object_label, '(?i)\b(fig(?:ure)?|tab(?:le)?)\.?\s*(S?\d+)', 1)) LIKE 'f%' AS is_figure, upper(regexp_extract(object_label, '(?i)\b(fig(?:ure)?|tab(?:le)?)\.?\s*(S?\d+)', 2)) AS number FROM sources WHERE regexp_matches(object_label, '(?i)\b(fig(?:ure)?|tab(?:le)?)\.?\s*(S?\d+)')""")
def object_labels(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "sources").select("source_id", L.object_key(F.col("object_label")).alias("k")).where("k is not null")
    return k.select("source_id", (F.col("k.kind") == "figure").alias("is_figure"), F.col("k.number").alias("number")).distinct()


@query("section_names", """WITH n AS (SELECT DISTINCT trim(claim_id) AS claim_id, lower(trim(coalesce(section, ''))) AS s FROM claims) SELECT claim_id, CASE s WHEN 'method' THEN 'methods' WHEN 'materials and methods' THEN 'methods' WHEN 'result' THEN 'results' WHEN 'conclusion' THEN 'discussion' ELSE s END AS section FROM n""")
def section_names(s: SparkSession, d: str) -> DataFrame:
    aliases = {"method": "methods", "materials and methods": "methods", "result": "results", "conclusion": "discussion"}
    return table(s, d, "claims").select(F.trim("claim_id").alias("claim_id"), L.canonical_section(F.col("section"), aliases).alias("section")).distinct()


@query("numbered_paragraphs", """SELECT project_id, claim_id, section, CAST(row_number() OVER (PARTITION BY project_id, section ORDER BY claim_id) AS BIGINT) AS number FROM (SELECT DISTINCT trim(project_id) AS project_id, trim(claim_id) AS claim_id, lower(trim(coalesce(section, ''))) AS section FROM claims)""")
def numbered_paragraphs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "claims").select(F.trim("project_id").alias("project_id"), F.trim("claim_id").alias("claim_id"), F.lower(norm("section")).alias("section")).distinct()
    # a project may hold a third of the rows: the count runs over range partitions
    keyed = c.withColumn("_g", F.concat_ws("\u0001", F.coalesce("project_id", F.lit("\u0002")), "section")).withColumn("_one", F.lit(1).cast("long"))
    return with_running_sum(keyed, ["_g"], ["claim_id"], "_one", Scratch(s, "numbers"), "n", "number").select("project_id", "claim_id", "section", "number")


@query("power_plan")
def power_plan(s: SparkSession, d: str) -> DataFrame:
    return power.plan_power(table(s, d, "power_plan"))


@query("record_states", "SELECT 'evidence' AS ledger, count(*) AS records FROM (SELECT DISTINCT trim(evidence_id), statement, estimate, p_value FROM evidence WHERE evidence_id IS NOT NULL)")
def record_states(s: SparkSession, d: str) -> DataFrame:
    st = hashing.record_state(table(s, d, "evidence"), "evidence", "evidence_id", ["statement", "estimate", "p_value"])
    return hashing.state_id(st).select("ledger", "records")


@query("affected_claims", """WITH ch AS (SELECT DISTINCT trim(source_id) AS source_id FROM sources WHERE deleted_at IS NOT NULL), ev AS (SELECT DISTINCT trim(evidence_id) AS e FROM evidence WHERE trim(source_id) IN (SELECT source_id FROM ch WHERE source_id IS NOT NULL)),
  di AS (SELECT DISTINCT claim_id FROM (SELECT trim(claim_id) AS claim_id, trim(x) AS e FROM (SELECT claim_id, unnest(evidence_ids) AS x FROM claims)) WHERE e IN (SELECT e FROM ev WHERE e IS NOT NULL)),
  fam AS (SELECT DISTINCT trim(claim_id) AS claim_id, trim(claim_family_id) AS f FROM claims WHERE trim(claim_family_id) <> '')
  SELECT claim_id, 'direct' AS how FROM di UNION ALL SELECT DISTINCT claim_id, 'family' FROM fam WHERE f IN (SELECT f FROM fam WHERE claim_id IN (SELECT claim_id FROM di)) AND claim_id NOT IN (SELECT claim_id FROM di)""")
def affected_claims(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "sources").where("deleted_at is not null").select(F.trim("source_id").alias("source_id"))
    return hashing.affected_claims(gone, table(s, d, "evidence"), table(s, d, "claims"))


@query("stream_windows", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "events").schema
    scratch = Scratch(s, "stream")
    # the file is one table's; a stream reads folders, so the path is a pattern that matches it alone
    events = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    # a window is told once it can't change any more, and its state is dropped then
    out = streaming.windowed_counts(events, "ts", ["event_type"], "value", late="10 minutes")
    return streaming.drain(out, scratch, "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("result_sanity", """WITH r AS (SELECT *, trim(coalesce(analysis_id, '')) || '/' || trim(coalesce(analysis_item_id, '')) AS e FROM results),
  b AS (SELECT e, unnest([CASE WHEN NOT (p_value BETWEEN 0 AND 1) THEN 'p_range' END, CASE WHEN p_adjusted < p_value - 1e-12 OR NOT (p_adjusted BETWEEN 0 AND 1) THEN 'p_adjusted' END, CASE WHEN ci_low > ci_high THEN 'ci_order' END,
    CASE WHEN estimate < ci_low OR estimate > ci_high THEN 'estimate_outside' END, CASE WHEN ci_level <= 0 OR ci_level >= 1 THEN 'level' END, CASE WHEN n < 0 THEN 'n' END, CASE WHEN isnan(effect_size) OR isinf(effect_size) OR isinf(statistic) THEN 'not_finite' END, CASE WHEN p_value IS NULL THEN 'p_missing' END]) AS rule FROM r)
  SELECT DISTINCT 'error' AS severity, rule, e AS entity_id, 'the values don''t fit together' AS message FROM b WHERE rule IS NOT NULL
  UNION SELECT DISTINCT 'error', 'blank_key', e, 'a key part is blank' FROM r WHERE trim(coalesce(analysis_id, '')) = '' OR trim(coalesce(analysis_item_id, '')) = ''""")
def result_sanity(s: SparkSession, d: str) -> DataFrame:
    return literature.result_sanity(table(s, d, "results"))


@query("value_closure", r"""WITH c AS (SELECT DISTINCT claim_id, text, required_value_tokens AS req FROM claims), t AS (SELECT claim_id, list_transform(regexp_extract_all(coalesce(text, ''), '[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?'), lambda x: regexp_replace(x, '[,+]', '', 'g')) AS said,
    list_transform(list_filter(coalesce(req, []), lambda x: trim(x) <> ''), lambda x: regexp_replace(trim(x), '[,+]', '', 'g')) AS need FROM c)
  SELECT DISTINCT 'error' AS severity, 'value_not_in_text' AS rule, coalesce(claim_id, '') AS entity_id, x AS message FROM (SELECT claim_id, unnest(need) AS x, said FROM t) WHERE NOT list_contains(said, x)
  UNION SELECT DISTINCT 'warning', 'value_not_required', coalesce(claim_id, ''), x FROM (SELECT claim_id, unnest(said) AS x, need FROM t) WHERE NOT list_contains(need, x)""")
def value_closure(s: SparkSession, d: str) -> DataFrame:
    return manuscript.value_closure(table(s, d, "claims").select("claim_id", "text", "required_value_tokens").distinct())


@query("claim_foreign_keys", """SELECT DISTINCT 'error' AS severity, 'no_such_evidence' AS rule, id AS entity_id, k AS message FROM (SELECT claim_id AS id, trim(x) AS k FROM (SELECT claim_id, unnest(evidence_ids) AS x FROM claims)) WHERE k <> '' AND k NOT IN (SELECT trim(evidence_id) FROM evidence WHERE evidence_id IS NOT NULL)
  UNION SELECT DISTINCT 'error', 'no_such_source', id, k FROM (SELECT evidence_id AS id, trim(source_id) AS k FROM evidence) WHERE k <> '' AND k NOT IN (SELECT trim(source_id) FROM sources WHERE source_id IS NOT NULL)""")
def claim_foreign_keys(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "evidence")
    return findings.union([manuscript.foreign_keys(table(s, d, "claims"), "claim_id", "evidence_ids", ev, "evidence_id", "no_such_evidence"), manuscript.foreign_keys(ev, "evidence_id", "source_id", table(s, d, "sources"), "source_id", "no_such_source")])


@query("rule_matches", """WITH r AS (SELECT record_id, lower(trim(coalesce(title, '')) || ' ' || trim(coalesce(abstract, ''))) AS t, lower(trim(coalesce(source, ''))) AS s, trim(coalesce(doi, '')) AS doi FROM records)
  SELECT DISTINCT record_id, rule_id FROM (SELECT record_id, unnest([CASE WHEN contains(t, 'dropout') OR contains(t, 'survival') THEN 'terms' END, CASE WHEN s IN ('manual') THEN 'manual' END, CASE WHEN regexp_matches(t, '\\bseed [0-9]+\\b') THEN 'seeded' END, CASE WHEN doi = '' THEN 'no_doi' END]) AS rule_id FROM r) WHERE rule_id IS NOT NULL""")
def rule_matches(s: SparkSession, d: str) -> DataFrame:
    rules = [{"id": "terms", "op": "contains_any", "fields": ["title", "abstract"], "values": ["dropout", "survival"]}, {"id": "manual", "op": "equals", "field": "source", "values": ["Manual"]}, {"id": "seeded", "op": "regex", "fields": ["title", "abstract"], "pattern": r"\bseed [0-9]+\b"}, {"id": "no_doi", "op": "missing", "field": "doi"}, {"id": "off", "op": "exists", "field": "title", "enabled": False}]
    return literature.matching_rules(table(s, d, "records"), rules)
