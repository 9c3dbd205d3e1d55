"""Queries of single operators: over the ledgers and star-schema tables where those fit, else over small tables written out here.

The SQL restates each operator's rule; it shares no constant with the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import ledger as L
from auditloom.functions import typed
from auditloom.functions.text import norm
from auditloom.operators import clean, figures, findings, hashing, linkage, literature, manuscript, power, runs, stats
from auditloom.plans.relations import Relation
from auditloom.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **rels: Relation):
    """Registers a query; ``rels`` are the inline tables that its SQL names."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            head = ", ".join(f"{n} AS {r.sql}" for n, r in rels.items())
            body = sql.lstrip()
            for lead in ("WITH RECURSIVE ", "WITH "):
                if head and body.startswith(lead):
                    body = f"{lead}{head}, {body[len(lead):]}"
                    break
            else:
                body = f"WITH {head} {body}" if head else body
            SQL[name] = body
        return f

    return keep


_F = "severity, rule, entity_id, message"

# ---- run ledgers: users' events are attempts, customers the plan

_PLANNED = "p AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'view' ELSE 'click' END AS condition FROM customer)"
_ATTEMPTS = "a AS (SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(event_id AS VARCHAR) AS attempt_id, event_type AS condition FROM events)"


@query("planned_runs", f"""WITH {_PLANNED}, {_ATTEMPTS}
  SELECT DISTINCT 'error' AS severity, 'never_attempted' AS rule, run_id AS entity_id, 'a planned run has no attempt' AS message FROM p WHERE run_id NOT IN (SELECT run_id FROM a WHERE run_id IS NOT NULL)
  UNION SELECT 'error', 'unplanned', attempt_id, 'no planned run ' || coalesce(run_id, '') FROM a WHERE run_id IS NULL OR run_id NOT IN (SELECT run_id FROM p)
  UNION SELECT 'error', 'differs_from_plan', attempt_id, 'field condition' FROM a JOIN p USING (run_id) WHERE a.condition IS DISTINCT FROM p.condition""")
def planned_runs(s: SparkSession, d: str) -> DataFrame:
    planned = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.when(F.col("c_custkey") % 3 == 0, "view").otherwise("click").alias("condition"))
    attempts = table(s, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("attempt_id"), F.col("event_type").alias("condition"))
    return runs.planned_runs(planned, attempts, ["condition"])


_TIMES = Relation("attempt_id string, started_at string, finished_at string, runtime_seconds double", [("a1", "2025-01-01T10:00:00Z", "2025-01-01T10:00:10Z", 10.0), ("a2", "2025-01-01T10:00:00Z", "2025-01-01T10:00:10Z", 12.0), ("a3", "2025-01-01T10:00:00", "2025-01-01T10:00:10Z", 10.0), ("a4", "2025-01-01T10:00:10+00:00", "2025-01-01T10:00:00+00:00", 10.0), ("a5", "2025-01-01T12:00:00.25+02:00", "2025-01-01T10:00:01.75Z", 1.503), ("a6", "2025-01-01T12:00:00.25+02:00", "2025-01-01T10:00:01.75Z", 1.52), ("a7", None, "2025-01-01T10:00:00Z", 1.0)])


@query("attempt_times", r"""WITH z AS (SELECT *, CASE WHEN regexp_matches(started_at, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN CAST(started_at AS TIMESTAMPTZ) END AS s, CASE WHEN regexp_matches(finished_at, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN CAST(finished_at AS TIMESTAMPTZ) END AS f,
    0.5 * 10.0 ** -length(regexp_extract(started_at, '\.([0-9]+)', 1)) + 0.5 * 10.0 ** -length(regexp_extract(finished_at, '\.([0-9]+)', 1)) AS tick FROM t),
  g AS (SELECT *, (epoch_us(f) - epoch_us(s)) / 1e6 AS span FROM z)
  SELECT 'error' AS severity, 'time_without_zone' AS rule, attempt_id AS entity_id, 'a time can''t be read or names no zone' AS message FROM g WHERE s IS NULL OR f IS NULL
  UNION SELECT 'error', 'ends_before_start', attempt_id, 'the attempt ends before it starts' FROM g WHERE f < s
  UNION SELECT 'error', 'runtime', attempt_id, 'the runtime isn''t the time between start and end' FROM g WHERE f >= s AND abs(runtime_seconds - span) > tick + 1e-6 + abs(span) * 2.3e-16""", t=_TIMES)
def attempt_times(s: SparkSession, d: str) -> DataFrame:
    return runs.attempt_times(_TIMES.df(s))


@query("reused_paths", """SELECT DISTINCT 'error' AS severity, 'path_reused' AS rule, path AS entity_id, CAST(k AS VARCHAR) || ' owners' AS message FROM
  (SELECT trim(path) AS path, count(DISTINCT (source_id, source_type)) AS k FROM sources WHERE trim(path) <> '' AND source_id IS NOT NULL AND source_type IS NOT NULL GROUP BY 1) WHERE k > 1""")
def reused_paths(s: SparkSession, d: str) -> DataFrame:
    return runs.reused_paths(table(s, d, "sources").select("path", F.col("source_id").alias("run_id"), F.lit("1").alias("attempt_id"), F.col("source_type").alias("role")))


_METRICS = Relation("run_id string, attempt_id string, metrics map<string,double>", [("r1", "a1", {"loss": 0.1, "acc": 0.9}), ("r1", "a2", {"loss": float("nan")}), ("r2", "a1", {"loss": 1.0, "acc": None, "f1": 0.5}), ("r2", "a1", {"loss": 1.0, "acc": 0.2}), ("r3", "a1", {"loss": float("inf"), "acc": 0.0})])


@query("metric_records", """WITH e AS (SELECT run_id || '/' || attempt_id AS e, unnest(map_keys(metrics)) AS k, unnest(map_values(metrics)) AS v FROM m), i AS (SELECT DISTINCT run_id || '/' || attempt_id AS e, row_number() OVER () AS n, map_keys(metrics) AS ks FROM m)
  SELECT 'error' AS severity, 'metric_missing' AS rule, e AS entity_id, r AS message FROM i, (SELECT unnest(['loss', 'acc']) AS r) WHERE NOT list_contains(ks, r)
  UNION SELECT 'error', 'metric_unexpected', e, k FROM e WHERE k NOT IN ('loss', 'acc')
  UNION SELECT 'error', 'metric_not_finite', e, k FROM e WHERE v IS NULL OR isnan(v) OR isinf(v)
  UNION SELECT 'error', 'metric_repeated', e, CAST(count(*) AS VARCHAR) FROM i GROUP BY e HAVING count(*) > 1""", m=_METRICS)
def metric_records(s: SparkSession, d: str) -> DataFrame:
    return runs.metric_records(_METRICS.df(s), ["loss", "acc"])


@query("scope_population", """WITH u AS (SELECT CAST(l_orderkey AS VARCHAR) AS scope_id, CAST(l_linenumber AS VARCHAR) AS unit_id FROM lineitem), e AS (SELECT CAST(o_orderkey AS VARCHAR) AS scope_id, CAST(4 AS BIGINT) AS unit_count FROM orders), g AS (SELECT scope_id, count(*) AS n FROM u GROUP BY 1)
  SELECT 'error' AS severity, 'population' AS rule, coalesce(e.scope_id, g.scope_id) AS entity_id, 'expected ' || coalesce(CAST(unit_count AS VARCHAR), 'none') || ', found ' || coalesce(CAST(n AS VARCHAR), 'none') AS message FROM e FULL JOIN g ON e.scope_id = g.scope_id WHERE unit_count IS DISTINCT FROM n
  UNION SELECT 'warning', 'unit_repeated', scope_id || '/' || unit_id, CAST(count(*) AS VARCHAR) FROM u GROUP BY scope_id, unit_id HAVING count(*) > 1""")
def scope_population(s: SparkSession, d: str) -> DataFrame:
    units = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("scope_id"), F.col("l_linenumber").cast("string").alias("unit_id"))
    return runs.scope_population(units, table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("scope_id"), F.lit(4).cast("long").alias("unit_count")))


_ENV = Relation("attempt_id string, environment map<string,string>", [("a1", {"python": "3.13", "seed": "1"}), ("a2", {"python": "3.13", "API_KEY": "x"}), ("a3", {"seed": "2", "db_Password": "y", "author": "z"}), ("a4", {})])


@query("environment", """WITH e AS (SELECT attempt_id AS a, unnest(map_keys(environment)) AS k FROM t)
  SELECT 'error' AS severity, 'environment_missing' AS rule, attempt_id AS entity_id, r AS message FROM t, (SELECT unnest(['python', 'seed']) AS r) WHERE NOT list_contains(map_keys(environment), r)
  UNION SELECT 'error', 'credential', a, k FROM e WHERE contains(lower(k), 'secret') OR contains(lower(k), 'token') OR contains(lower(k), 'passw') OR regexp_matches(lower(k), 'api[_-]?key|private[_-]?key|credential|auth')""", t=_ENV)
def environment(s: SparkSession, d: str) -> DataFrame:
    return runs.environment(_ENV.df(s), ["python", "seed"])


_RC = """c AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS claim_id, CASE WHEN p_size % 2 = 0 THEN 'Price' ELSE 'qty' END AS metric, CAST(p_retailprice AS DOUBLE) AS value, CASE p_size % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'absolute' WHEN 2 THEN 'relative' WHEN 3 THEN 'reported' ELSE 'multiplier' END AS rule,
    CASE p_size % 5 WHEN 1 THEN 20000.0 WHEN 2 THEN 20.0 WHEN 3 THEN 0.0 WHEN 4 THEN 100.0 ELSE 0 END::DOUBLE AS a, CASE p_size % 5 WHEN 3 THEN 60000.0 WHEN 4 THEN 150.0 ELSE 0 END::DOUBLE AS b FROM part),
  m AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_partkey AS VARCHAR) AS claim_id, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem), r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW')"""


@query("reconcile_claims", f"""WITH {_RC}, iv AS (SELECT *, CASE rule WHEN 'reported' THEN a WHEN 'exact' THEN value WHEN 'absolute' THEN value - a WHEN 'relative' THEN value - abs(value) * a ELSE value - a * b END AS lo, CASE rule WHEN 'reported' THEN b WHEN 'exact' THEN value WHEN 'absolute' THEN value + a WHEN 'relative' THEN value + abs(value) * a ELSE value + a * b END AS hi FROM c),
  o AS (SELECT m.claim_id, v FROM m WHERE run_id IN (SELECT run_id FROM r)),
  g AS (SELECT iv.claim_id, count(v) FILTER (metric = 'Price') AS runs, bool_and(v BETWEEN lo AND hi) FILTER (metric = 'Price') AS every_one FROM iv LEFT JOIN o USING (claim_id) GROUP BY 1)
  SELECT claim_id, CASE WHEN runs = 0 THEN 'not_assessed' WHEN every_one THEN 'reproduced' ELSE 'not_reproduced' END AS state, runs FROM g""")
def reconcile_claims(s: SparkSession, d: str) -> DataFrame:
    return runs.reconcile_claims(*_claims_of_parts(s, d))


def _claims_of_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as claims about a price, lines as metrics of runs, orders as runs."""
    k = F.col("p_size") % 5
    pick = lambda vs: F.coalesce(*[F.when(k == i, F.lit(v)) for i, v in vs.items()], F.lit(0.0))
    claims = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("claim_id"), F.when(F.col("p_size") % 2 == 0, "Price").otherwise("qty").alias("metric"), F.col("p_retailprice").cast("double").alias("value"), F.element_at(F.array(*[F.lit(x) for x in ("exact", "absolute", "relative", "reported", "multiplier")]), (k + 1).cast("int")).alias("rule"), pick({1: 20000.0, 2: 20.0, 4: 100.0}).alias("a"), pick({3: 60000.0, 4: 150.0}).alias("b")).distinct()
    metrics = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_partkey").cast("string").alias("claim_id"), F.lit("price").alias("metric"), F.col("l_extendedprice").cast("double").alias("value"))
    states = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit_code"), F.when(F.col("o_orderpriority") == "5-LOW", "probe").otherwise("target").alias("run_kind"))
    return claims, metrics, states


@query("release_gate", f"""WITH {_RC} SELECT DISTINCT 'error' AS severity, 'not_assessed' AS rule, claim_id AS entity_id, 'the claim has no assessment' AS message FROM c
  WHERE metric <> 'Price' OR claim_id NOT IN (SELECT claim_id FROM m WHERE run_id IN (SELECT run_id FROM r) AND claim_id IS NOT NULL)""")
def release_gate(s: SparkSession, d: str) -> DataFrame:
    claims, metrics, states = _claims_of_parts(s, d)
    return runs.release_gate(claims, runs.reconcile_claims(claims, metrics, states))


@query("run_summary", """SELECT count(*) AS attempts, count(DISTINCT user_id) AS runs, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') AS nonzero_exit FROM events""")
def run_summary(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return runs.run_summary(table(s, d, "events").select(F.col("user_id").alias("run_id"), F.when(kind == "purchase", "completed").when(kind == "error", "failed").alias("status"), F.when(kind == "error", 1).otherwise(0).alias("exit_code")))


@query("stale_from", """SELECT l_orderkey, min(l_linenumber) FILTER (NOT coalesce(l_discount > 0.02, false)) AS first_invalid, coalesce(max(l_linenumber) - min(l_linenumber) FILTER (NOT coalesce(l_discount > 0.02, false)) + 1, 0) AS stale FROM lineitem GROUP BY 1""")
def stale_from(s: SparkSession, d: str) -> DataFrame:
    return runs.stale_from(table(s, d, "lineitem").withColumn("ok", F.col("l_discount") > 0.02), "l_orderkey", "l_linenumber", "ok")


# ---- search and screening ledgers

_LOG = Relation("query_id string, search_stage string, source string, searched_at string, search_status string, result_count string, imported_count string, new_unique_count string, new_screened_count string, new_included_count string, stopping_evidence string, notes string", [
    ("q1", "core", "index_a", "2025-01-01", "succeeded", "10", "10", "5", "5", "0", "none new", ""), ("q2", "core", "index_a", "2025-01-02", "succeeded", "10", "8", "9", "4", "1", "", ""), ("q2", "snowball", "index_b", "", "", "", "", "", "", "", "", "timeout after 30 s"),
    ("", "snowball", "manual", "2025-01-03", "", "5", "7", "", "3", "0", "saturated", ""), ("q5", "update", "blog", "2025-01-04", "", "", "", "", "2", "0", "", "results truncated"), ("q6", "update", "index_c", "2025-01-05", "", "", "", "", "1", "", "", None),
])
_EFF = """e AS (SELECT *, CASE WHEN trim(coalesce(search_status, '')) <> '' THEN lower(trim(search_status)) WHEN regexp_matches(lower(coalesce(notes, '')), 'fail|error|timeout') THEN 'failed' WHEN regexp_matches(lower(coalesce(notes, '')), 'partial|truncat') THEN 'partial' WHEN trim(coalesce(result_count, '')) <> '' THEN 'succeeded' ELSE 'unknown' END AS s0,
    TRY_CAST(nullif(trim(result_count), '') AS BIGINT) AS rc, TRY_CAST(nullif(trim(imported_count), '') AS BIGINT) AS ic, TRY_CAST(nullif(trim(new_unique_count), '') AS BIGINT) AS uc FROM log), x AS (SELECT *, CASE WHEN s0 = 'succeeded' AND rc > ic THEN 'partial' ELSE s0 END AS s FROM e),
  want AS (SELECT unnest(['index_a', 'index_b', 'index_c', 'manual', 'registry']) AS source),
  st AS (SELECT w.source, count(x.source) AS queries, CASE WHEN count(x.source) = 0 THEN 'not_attempted' WHEN bool_and(s = 'succeeded') THEN 'succeeded' WHEN bool_and(s = 'failed') THEN 'failed' WHEN bool_and(s = 'unknown') THEN 'unknown' ELSE 'partial' END AS status FROM want w LEFT JOIN x ON trim(x.source) = w.source GROUP BY 1)"""
_TARGETS = ["index_a", "index_b", "index_c", "manual", "registry"]


@query("search_source_status", f"WITH {_EFF} SELECT * FROM st", log=_LOG)
def search_source_status(s: SparkSession, d: str) -> DataFrame:
    return literature.source_status(_LOG.df(s), _TARGETS)


@query("search_audit", f"""WITH {_EFF} SELECT 'error' AS severity, 'source_coverage' AS rule, source AS entity_id, status AS message FROM st WHERE status IN ('not_attempted', 'failed', 'unknown') UNION SELECT 'warning', 'source_coverage', source, status FROM st WHERE status = 'partial'
  UNION SELECT 'error', 'no_query_id', source, 'a query has no id' FROM x WHERE query_id = '' UNION SELECT 'error', 'repeated_query_id', query_id, CAST(count(*) AS VARCHAR) FROM x WHERE query_id <> '' GROUP BY query_id HAVING count(*) > 1
  UNION SELECT 'error', 'no_date', query_id, 'searched_at is blank' FROM x WHERE searched_at = '' UNION SELECT 'error', 'counts', query_id, 'more imported than found' FROM x WHERE ic > rc UNION SELECT 'error', 'counts', query_id, 'more unique than imported' FROM x WHERE uc > ic
  UNION SELECT 'error', 'stage_missing', g, 'no query of this stage' FROM (SELECT unnest(['core', 'grey']) AS g) WHERE g NOT IN (SELECT search_stage FROM x) UNION SELECT 'warning', 'unknown_source', query_id, source FROM x WHERE source NOT IN (SELECT source FROM want)""", log=_LOG)
def search_audit(s: SparkSession, d: str) -> DataFrame:
    return literature.search_audit(_LOG.df(s), _TARGETS, ["core", "grey"])


@query("marginal_yield", """WITH n AS (SELECT search_stage, TRY_CAST(nullif(new_screened_count, '') AS BIGINT) AS sc, TRY_CAST(nullif(new_included_count, '') AS BIGINT) AS inc, stopping_evidence <> '' AS ev FROM log)
  SELECT search_stage, count(*) AS queries, count(*) FILTER (sc IS NOT NULL AND inc IS NOT NULL) AS known, CAST(sum(sc) AS BIGINT) AS screened, CAST(sum(inc) AS BIGINT) AS included,
    CASE WHEN count(*) FILTER (sc IS NOT NULL AND inc IS NOT NULL) < count(*) THEN 'incomplete' WHEN bool_or(ev) AND coalesce(sum(inc), 0) = 0 THEN 'supported' ELSE 'unsupported' END AS stopping FROM n GROUP BY 1""", log=_LOG)
def marginal_yield(s: SparkSession, d: str) -> DataFrame:
    return literature.marginal_yield(_LOG.df(s))


@query("sum_known", "SELECT CAST(sum(TRY_CAST(trim(n) AS BIGINT)) AS BIGINT) AS total, count(TRY_CAST(trim(n) AS BIGINT)) AS known, count(*) - count(TRY_CAST(trim(n) AS BIGINT)) AS missing FROM (SELECT CASE WHEN regexp_matches(trim(coalesce(n, '')), '^[+-]?[0-9]+$') THEN n END AS n FROM evidence)")
def sum_known(s: SparkSession, d: str) -> DataFrame:
    return literature.sum_known(table(s, d, "evidence"), "n")


_EVENTS = Relation("record_id string, stage string, evidence_basis string, decision string", [("r1", "full_text", "p. 3", "include"), ("r1", "full_text_screened", "p. 3 ", "include"), ("r1", "full_text", "p. 4", "include"), ("r2", "title_abstract", "t", "exclude"), ("r2", "title_abstract", "t", "exclude"), ("r3", "full_text", "", "exclude"), ("r3", "full_text", "", "exclude"), (None, "full_text", "x", "include")])


@query("duplicate_fulltext", """SELECT 'warning' AS severity, 'repeated_full_text' AS rule, coalesce(record_id, '') AS entity_id, trim(decision) || ' ' || CAST(count(*) AS VARCHAR) AS message FROM e WHERE starts_with(trim(stage), 'full_text') AND trim(evidence_basis) <> '' GROUP BY record_id, trim(evidence_basis), trim(decision) HAVING count(*) > 1""", e=_EVENTS)
def duplicate_fulltext(s: SparkSession, d: str) -> DataFrame:
    return literature.duplicate_fulltext(_EVENTS.df(s))


_RULES = [{"id": "type", "op": "equals", "field": "publication_type", "values": ["dataset", "Letter"]}, {"id": "sens", "op": "contains_all", "fields": ["title", "abstract"], "values": ["sensitivity", "outcome"]}, {"id": "list", "op": "list_contains_any", "field": "source", "values": ["manual"]}, {"id": "has", "op": "exists", "field": "arxiv_id"}]
_RULED = """m AS (SELECT DISTINCT record_id, unnest([CASE WHEN lower(trim(coalesce(publication_type, ''))) IN ('dataset', 'letter') THEN 'type' END, CASE WHEN contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), 'sensitivity') AND contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), 'outcome') THEN 'sens' END,
    CASE WHEN list_contains(list_transform(regexp_split_to_array(lower(trim(coalesce(source, ''))), '[;,|\\n]'), lambda x: trim(x)), 'manual') THEN 'list' END, CASE WHEN trim(coalesce(arxiv_id, '')) <> '' THEN 'has' END]) AS rule_id FROM records)"""
_SCREENED = "sc AS (SELECT record_id, CASE WHEN length(trim(coalesce(title, ''))) % 3 = 0 THEN ' Uncertain' WHEN length(trim(coalesce(title, ''))) % 3 = 1 THEN 'include' ELSE 'exclude' END AS decision FROM records)"


def _screening(s: SparkSession, d: str) -> DataFrame:
    n = F.length(norm("title")) % 3
    return table(s, d, "records").select("record_id", F.when(n == 0, " Uncertain").when(n == 1, "include").otherwise("exclude").alias("decision"))


@query("all_rule_operators", f"WITH {_RULED} SELECT record_id, rule_id FROM m WHERE rule_id IS NOT NULL")
def all_rule_operators(s: SparkSession, d: str) -> DataFrame:
    return literature.matching_rules(table(s, d, "records"), _RULES)


@query("uncertain_with_rule", f"""WITH {_RULED}, {_SCREENED} SELECT DISTINCT 'warning' AS severity, 'uncertain_but_ruled' AS rule, coalesce(record_id, '') AS entity_id, rule_id AS message FROM m WHERE rule_id IS NOT NULL AND record_id IN (SELECT record_id FROM sc WHERE lower(trim(decision)) = 'uncertain')""")
def uncertain_with_rule(s: SparkSession, d: str) -> DataFrame:
    return literature.uncertain_with_rule(_screening(s, d), table(s, d, "records"), _RULES)


@query("new_decisions", f"""WITH {_RULED} SELECT record_id, 'exclude' AS decision, min(rule_id) AS reason_code FROM m WHERE rule_id IS NOT NULL AND record_id NOT IN (SELECT source_id FROM citation_trail WHERE source_id IS NOT NULL) GROUP BY 1""")
def new_decisions(s: SparkSession, d: str) -> DataFrame:
    return literature.new_decisions(literature.matching_rules(table(s, d, "records"), _RULES), table(s, d, "citation_trail").select(F.col("source_id").alias("record_id")))


_STAGES = Relation("stage string, position int, entered bigint, removed bigint", [("found", 1, 100, 20), ("screened", 2, 80, 50), ("full text", 3, 31, 10), ("included", 4, 21, 0)])


@query("flow_audit", """SELECT 'error' AS severity, 'flow' AS rule, a.stage AS entity_id, 'leaves ' || CAST(a.entered - a.removed AS VARCHAR) || ', ' || b.stage || ' enters ' || CAST(b.entered AS VARCHAR) AS message FROM f a JOIN f b ON b.position = a.position + 1 WHERE a.entered - a.removed <> b.entered""", f=_STAGES)
def flow_audit(s: SparkSession, d: str) -> DataFrame:
    return literature.flow(_STAGES.df(s))


# ---- studies and synthesis: claims stand for syntheses, evidence for extracted claims

_STUDY = "st AS (SELECT record_id, trim(coalesce(query_id, '')) AS study_id, CASE WHEN length(coalesce(title, '')) % 2 = 0 THEN 'primary' ELSE 'companion' END AS role, trim(coalesce(venue, '')) AS basis FROM records)"


def _studies(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "records").select("record_id", F.col("query_id").alias("study_id"), F.when(F.length(F.coalesce("title", F.lit(""))) % 2 == 0, "Primary").otherwise("companion ").alias("report_role"), F.col("venue").alias("linkage_basis"))


@query("study_audit", f"""WITH {_STUDY}, {_SCREENED}, inc AS (SELECT DISTINCT record_id FROM sc WHERE decision = 'include')
  SELECT DISTINCT 'error' AS severity, 'included_without_study' AS rule, coalesce(record_id, '') AS entity_id, 'no study is mapped' AS message FROM inc ANTI JOIN (SELECT record_id FROM st WHERE study_id <> '') USING (record_id)
  UNION SELECT 'warning', 'mapped_not_included', coalesce(record_id, ''), 'the record isn''t included' FROM (SELECT DISTINCT record_id FROM st) ANTI JOIN inc USING (record_id)
  UNION SELECT 'error', 'several_studies', coalesce(record_id, ''), CAST(count(DISTINCT study_id) AS VARCHAR) FROM st WHERE study_id <> '' GROUP BY record_id HAVING count(DISTINCT study_id) > 1
  UNION SELECT 'error', 'primary_reports', study_id, CAST(count(*) FILTER (role = 'primary') AS VARCHAR) FROM st WHERE study_id <> '' GROUP BY study_id HAVING count(*) FILTER (role = 'primary') <> 1
  UNION SELECT 'warning', 'no_linkage_basis', coalesce(record_id, ''), study_id FROM st WHERE study_id <> '' AND role <> 'primary' AND basis = ''""")
def study_audit(s: SparkSession, d: str) -> DataFrame:
    return literature.study_audit(_studies(s, d), _screening(s, d))


@query("study_summary", f"WITH {_STUDY} SELECT study_id, count(DISTINCT record_id) AS reports, array_to_string(list_sort(list(DISTINCT role)), ';') AS roles FROM st WHERE study_id <> '' GROUP BY 1")
def study_summary(s: SparkSession, d: str) -> DataFrame:
    return literature.study_summary(_studies(s, d))


_SYN = """l AS (SELECT claim_id AS synthesis_id, trim(x) AS claim_id, CASE WHEN length(trim(x)) % 3 = 0 THEN 'contradicts' ELSE 'supports' END AS r FROM (SELECT claim_id, unnest(evidence_ids) AS x FROM claims)),
  e AS (SELECT evidence_id AS claim_id, trim(coalesce(source_id, '')) AS src, coalesce(nullif(trim(coalesce(design_scope, '')), ''), trim(coalesce(source_id, ''))) AS unit FROM evidence WHERE lower(trim(coalesce(verification, ''))) IN ('verified', 'partial') AND trim(coalesce(evidence_type, '')) <> ''),
  a AS (SELECT synthesis_id, count(DISTINCT src) AS sources, count(DISTINCT unit) AS studies, count(DISTINCT unit) FILTER (r = 'supports') AS support, count(DISTINCT unit) FILTER (r = 'contradicts') AS contradict FROM l LEFT JOIN e USING (claim_id) GROUP BY 1),
  sy AS (SELECT *, CASE WHEN support > 0 AND contradict > 0 THEN 'mixed' WHEN support >= 2 THEN 'consistent' WHEN support = 1 AND sources = 1 THEN 'single_source' WHEN support = 1 THEN 'single_study' WHEN contradict > 0 THEN 'contradicted' ELSE 'gap' END AS state FROM a)"""


def _syntheses(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "claims").select(F.col("claim_id").alias("synthesis_id"), F.explode("evidence_ids").alias("x")).select("synthesis_id", F.trim("x").alias("claim_id"), F.when(F.length(F.trim("x")) % 3 == 0, " Contradicts").otherwise("supports").alias("relation"))
    ev = table(s, d, "evidence").select(F.col("evidence_id").alias("claim_id"), "source_id", F.col("design_scope").alias("study_id"), F.when(norm("evidence_type") != "", "Direct").alias("support_level"), F.col("verification").alias("verification_status"))
    return literature.synthesis_states(links, ev)


@query("synthesis_states", f"WITH {_SYN} SELECT * FROM sy")
def synthesis_states(s: SparkSession, d: str) -> DataFrame:
    return _syntheses(s, d)


@query("synthesis_audit", rf"""WITH {_SYN}, c AS (SELECT DISTINCT claim_id AS synthesis_id, text, lower(trim(coalesce(status, ''))) AS st FROM claims), j AS (SELECT c.*, coalesce(sy.state, 'gap') AS state, coalesce(sy.studies, 0) AS studies FROM c LEFT JOIN sy USING (synthesis_id))
  SELECT DISTINCT 'error' AS severity, 'evidence_state' AS rule, coalesce(synthesis_id, '') AS entity_id, st || ' but ' || state AS message FROM j WHERE st <> state
  UNION SELECT 'warning', 'causal_wording', coalesce(synthesis_id, ''), 'causal wording over fewer than two studies' FROM j WHERE regexp_matches(lower(trim(coalesce(text, ''))), '\b(causes?|caused|leads? to|results? in|proves?|demonstrates that)\b') AND studies < 2
  UNION SELECT 'error', 'no_statement', coalesce(synthesis_id, ''), 'the statement is blank' FROM j WHERE trim(coalesce(text, '')) = ''""")
def synthesis_audit(s: SparkSession, d: str) -> DataFrame:
    claims = table(s, d, "claims").select(F.col("claim_id").alias("synthesis_id"), F.col("text").alias("statement"), F.lower(norm("status")).alias("evidence_state")).distinct()
    return literature.synthesis_audit(claims, _syntheses(s, d))


# ---- hashes, states and manifests

_STATE = """md AS (SELECT DISTINCT trim(evidence_id) AS id, sha256('{{"estimate":' || coalesce(to_json({e})::VARCHAR, 'null') || ',"p_value":' || coalesce(to_json(p_value)::VARCHAR, 'null') || '}}') AS hash FROM evidence WHERE evidence_id IS NOT NULL)"""


@query("record_state", "WITH " + _STATE.format(e="estimate") + " SELECT 'evidence' AS ledger, id, hash FROM md")
def record_state(s: SparkSession, d: str) -> DataFrame:
    return hashing.record_state(table(s, d, "evidence"), "evidence", "evidence_id", ["p_value", "estimate"])


@query("diff_record_states", """WITH o AS (SELECT o_orderkey AS id, o_orderstatus || '/' || o_orderpriority AS v FROM orders WHERE o_orderkey % 11 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END || '/' || o_orderpriority AS v FROM orders WHERE o_orderkey % 19 <> 0)
  SELECT 'orders' AS ledger, CAST(coalesce(o.id, n.id) AS VARCHAR) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.v IS DISTINCT FROM n.v""")
def diff_record_states(s: SparkSession, d: str) -> DataFrame:
    o, k = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    state = lambda df: hashing.record_state(df, "orders", "k", ["o_orderstatus", "o_orderpriority"])
    return hashing.diff_states(state(o.where(k % 11 != 0)), state(o.where(k % 19 != 0).withColumn("o_orderstatus", F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")))))


@query("state_identity", "SELECT ledger, n AS records, true AS same_again, true AS order_free, true AS told_apart FROM (SELECT 'evidence' AS ledger, count(DISTINCT (trim(evidence_id), p_value)) AS n FROM evidence WHERE evidence_id IS NOT NULL)")
def state_identity(s: SparkSession, d: str) -> DataFrame:
    """A state's identifier is the same for the same rows in another order, and another one when a value changes."""
    e = table(s, d, "evidence")
    at = lambda df: hashing.state_id(hashing.record_state(df, "evidence", "evidence_id", ["p_value"]))
    a, b, c = at(e), at(e.orderBy(F.desc("evidence_id"))), at(e.withColumn("p_value", F.concat("p_value", F.lit("1"))))
    j = a.join(b.select("ledger", F.col("state_id").alias("b")), "ledger").join(c.select("ledger", F.col("state_id").alias("c")), "ledger")
    return j.select("ledger", "records", F.col("state_id").isNotNull().alias("same_again"), (F.col("state_id") == F.col("b")).alias("order_free"), (F.col("state_id") != F.col("c")).alias("told_apart"))


_MANIFEST = Relation("path string, sha256 string, length bigint", [("a.csv", "AA", 3), ("b.csv", "bb", 4), ("c/d.csv", "cc", 5), ("../e.csv", "dd", 6), ("g.csv", "ee", 7)])
_FILES = Relation("path string, sha256 string, length bigint", [("a.csv", "aa", 3), ("b.csv", "b0", 4), ("../e.csv", "dd", 6), ("g.csv", "ee", 8), ("new.csv", "ff", 1)])


@query("verify_manifest", r"""WITH j AS (SELECT coalesce(m.path, f.path) AS path, lower(m.sha256) AS ms, m.length AS ml, lower(f.sha256) AS fs, f.length AS fl FROM m FULL JOIN f ON m.path = f.path)
  SELECT path, problem FROM (SELECT path, CASE WHEN starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') THEN 'unsafe' WHEN fs IS NULL THEN 'missing' WHEN ms IS NULL THEN 'unlisted' WHEN ms <> fs THEN 'changed' WHEN ml <> fl THEN 'size' END AS problem FROM j) WHERE problem IS NOT NULL""", m=_MANIFEST, f=_FILES)
def verify_manifest(s: SparkSession, d: str) -> DataFrame:
    return hashing.verify_manifest(_MANIFEST.df(s), _FILES.df(s))


@query("uncovered_changes", """WITH ch AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 13 = 0), rv AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F') SELECT 'orders' AS ledger, id FROM ch WHERE id NOT IN (SELECT id FROM rv)""")
def uncovered_changes(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    rev = o.select(F.when(F.col("o_orderstatus") == "F", " Verified").otherwise("open").alias("status"), F.array(F.col("o_orderkey").cast("string")).alias("affected_ids"))
    return hashing.uncovered_changes(o.where("o_orderkey % 13 = 0").select(F.lit("orders").alias("ledger"), F.col("o_orderkey").cast("string").alias("id")), rev)


@query("directory_digest", """SELECT o_orderpriority, sha256(array_to_string(list_sort(list(o_orderdate_text || chr(0) || status)), chr(10))) AS digest, count(*) AS files FROM (SELECT o_orderpriority, CAST(o_orderkey AS VARCHAR) AS o_orderdate_text, o_orderstatus AS status FROM orders WHERE o_orderkey IS NOT NULL) GROUP BY 1""")
def directory_digest(s: SparkSession, d: str) -> DataFrame:
    return hashing.directory_digest(table(s, d, "orders").withColumn("name", F.col("o_orderkey").cast("string")), ["o_orderpriority"], "name", "o_orderstatus")


@query("stable_seed", """SELECT CAST(l_orderkey AS VARCHAR) AS label, CAST(('0x' || substr(sha256('42::' || CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT AS BIGINT) AS seed FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def stable_seed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("label")).distinct().select("label", hashing.stable_seed(F.lit(42), F.col("label")).alias("seed"))


_OBJECTS = Relation("id string, j string", [("1", '{"b": 1, "a": [true, null]}'), ("2", '{"a":[true,null],"b":1}'), ("3", '{"a": "é"}'), ("4", "no json"), ("5", None)])


@query("canonical_hash", """SELECT id, CASE id WHEN '1' THEN sha256('{"a":[true,null],"b":1}') WHEN '2' THEN sha256('{"a":[true,null],"b":1}') WHEN '3' THEN sha256('{"a":"é"}') END AS hash FROM o""", o=_OBJECTS)
def canonical_hash(s: SparkSession, d: str) -> DataFrame:
    return _OBJECTS.df(s).select("id", hashing.canonical_hash("j").alias("hash"))
