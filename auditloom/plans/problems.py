"""Queries of the general data problems, each over its whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import compare, drift, hierarchy, references, shred, snapshots
from auditloom.plans.tables import table

RESULT_NUMBERS = ["estimate", "ci_low", "ci_high", "ci_level", "statistic", "p_value", "p_adjusted", "effect_size", "n"]
RESULT_TEXTS = ["analysis_role", "type", "multiplicity_family", "estimand", "notes", "data_sha256", "plan_sha256"]

def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift(table(spark, d, "ledger_files"))


def _p1_table(artifact: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        return drift.promote(drift.ingest(table(spark, d, "ledger_files"), artifact), drift.PROMOTED[artifact]).withColumn("exported_at", F.col("exported_at").cast("timestamp_ntz"))

    return q


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.nested_parts(table(spark, d, "power_plan"), table(spark, d, "claims"))


_PLAN = (["planning_id", "plan_version", "doc"], "plan", {"planning_items": "planning_item_id", "scenarios": "scenario_id"}, frozenset({"overrides"}))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = shred.shred(shred.with_document_key(table(spark, d, "power_plan"), "payload"), "payload", *_PLAN)
    return rows.select(*_PLAN[0], "element", "node", "parent_element", "parent_node", "pos", F.to_json("parent_keys").alias("parent_keys"), F.to_json("columns").alias("columns"))


def _plan_rows(spark: SparkSession, d: str) -> DataFrame:
    """The plans' rows by the fixed element graph, each delivery of a payload once."""
    plans = shred.with_document_key(table(spark, d, "power_plan").where("payload is not null"), "payload").dropDuplicates(["planning_id", "plan_version", "doc"])
    return shred.shred(plans, "payload", *_PLAN, shred.PLAN_GRAPH)


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    return shred.flat_table(_plan_rows(spark, d), "planning_items", _PLAN[0], [], {"planning_item_id": "string", "type": "string", "alpha": "double", "mean_difference": "double"}).where("parent_node = '$'").select("planning_id", "plan_version", "doc", "pos", "planning_item_id", "type", "alpha", "mean_difference")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    t = shred.flat_table(_plan_rows(spark, d), "contrast_terms", _PLAN[0], ["planning_items", "scenarios"], {"level": "string", "weight": "double"})
    return t.where(F.col("node").rlike(shred.TERM_NODE)).select("planning_id", "plan_version", "doc", F.col("planning_items_key").alias("item_id"), F.col("scenarios_key").alias("scenario_id"), "pos", "level", "weight")


def p3_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    return shred.orphan_nodes(_plan_rows(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_copies(table(spark, d, "results"), table(spark, d, "results_copy"), ["analysis_id", "analysis_item_id"], RESULT_NUMBERS, RESULT_TEXTS, "loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.ledger_references(*[table(spark, d, t) for t in ("claims", "citation_trail", "evidence", "sources", "records")])


def p5_by_period(spark: SparkSession, d: str) -> DataFrame:
    return references.by_table_and_period(p5_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.claim_hierarchy(table(spark, d, "claims")).drop("back_edge_to")


def p6_back_edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.claim_hierarchy(table(spark, d, "claims")).where("back_edge_to is not null").select("claim_id", "back_edge_to")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.claim_descendants(table(spark, d, "claims"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.workspace_changes(table(spark, d, "workspace_state"))


QUERIES = {
    "p1_found": p1_found,
    "p1_claims": _p1_table("claims"),
    "p1_workspace_state": _p1_table("workspace_state"),
    "p1_analysis_plan": _p1_table("analysis_plan"),
    "p3_found": p3_found,
    "p3_tables": p3_tables,
    "p3_items": p3_items,
    "p3_terms": p3_terms,
    "p3_foreign_keys": p3_foreign_keys,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_by_period": p5_by_period,
    "p6_found": p6_found,
    "p6_back_edges": p6_back_edges,
    "p6_descendants": p6_descendants,
    "p7_found": p7_found,
}


def _p4_sql() -> str:
    num = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
    one = r"^[+-]?inf(inity)?$"
    parts = []
    for c in RESULT_NUMBERS:
        b = f"lower(trim(r.{c}))"
        n = f"CASE WHEN regexp_matches({b}, '{num}') OR regexp_matches({b}, '{one}') THEN CAST({b} AS DOUBLE) END"
        a = f"CAST(l.{c} AS DOUBLE)"
        parts.append(f"""SELECT k1, k2, '{c}' AS field FROM (SELECT l.k1, l.k2, {a} AS a, ({a} IS NULL OR isnan({a})) AS na, (r.{c} IS NULL OR {b} IN ('', 'na', 'nan', 'null')) AS nb, {n} AS n FROM l JOIN r ON l.k1 = r.k1 AND l.k2 = r.k2)
          WHERE CASE WHEN na OR nb THEN na <> nb WHEN n IS NULL THEN true WHEN isinf(a) OR isinf(n) THEN a <> n ELSE abs(a - n) > greatest(1e-10 * greatest(abs(a), abs(n)), 1e-12) END""")
    for c in RESULT_TEXTS:
        parts.append(f"SELECT l.k1, l.k2, '{c}' FROM l JOIN r ON l.k1 = r.k1 AND l.k2 = r.k2 WHERE coalesce(trim(l.{c}), '') <> coalesce(trim(r.{c}), '')")
    union = "\nUNION ALL ".join(parts)
    return f"""WITH l AS (SELECT trim(analysis_id) AS k1, trim(analysis_item_id) AS k2, * FROM results WHERE trim(analysis_id) <> '' AND trim(analysis_item_id) <> ''
        QUALIFY row_number() OVER (PARTITION BY trim(analysis_id), trim(analysis_item_id) ORDER BY loaded_at DESC) = 1),
      r AS (SELECT trim(analysis_id) AS k1, trim(analysis_item_id) AS k2, * FROM results_copy WHERE trim(analysis_id) <> '' AND trim(analysis_item_id) <> ''
        QUALIFY row_number() OVER (PARTITION BY trim(analysis_id), trim(analysis_item_id) ORDER BY estimate DESC) = 1)
      SELECT k1 AS analysis_id, k2 AS analysis_item_id, field, 'differs' AS kind FROM ({union})
      UNION ALL SELECT k1, k2, '', 'missing_in_copy' FROM l ANTI JOIN r USING (k1, k2)
      UNION ALL SELECT k1, k2, '', 'missing_in_results' FROM r ANTI JOIN l USING (k1, k2)"""


_P5 = """WITH refs AS (
    SELECT 'claims.evidence_ids' AS f, claim_id AS from_id, trim(t) AS t, loaded_at AS seen FROM (SELECT claim_id, loaded_at, unnest(evidence_ids) AS t FROM claims)
    UNION ALL SELECT 'claims.object_refs.source_id', claim_id, trim(t.source_id), loaded_at FROM (SELECT claim_id, loaded_at, unnest(object_refs) AS t FROM claims)
    UNION ALL SELECT 'citation_trail.target_id', coalesce(trim(source_id), ''), trim(target_id), loaded_at FROM citation_trail),
  par AS (
    SELECT 'claims.evidence_ids' AS f, evidence_id AS t, bool_and(deleted_at IS NOT NULL) AS gone, min(loaded_at) AS first_at FROM evidence GROUP BY 2
    UNION ALL SELECT 'claims.object_refs.source_id', source_id, bool_and(deleted_at IS NOT NULL), min(loaded_at) FROM sources GROUP BY 2
    UNION ALL SELECT 'citation_trail.target_id', record_id, bool_and(deleted_at IS NOT NULL), min(loaded_at) FROM records GROUP BY 2),
  s AS (SELECT refs.f, from_id, refs.t, CASE WHEN gone IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_at > seen THEN 'late' END AS status, coalesce(strftime(seen, '%Y-%m'), '') AS period
    FROM refs LEFT JOIN par ON refs.f = par.f AND refs.t = par.t WHERE refs.t <> '')
  SELECT DISTINCT f AS ref_field, from_id, t AS target_id, status, period FROM s WHERE status IS NOT NULL"""

_P6_LINKS = """ids AS (SELECT DISTINCT trim(claim_id) AS id FROM claims),
  raw AS (SELECT trim(x) AS child, trim(claim_id) AS parent FROM (SELECT claim_id, unnest(supersedes_claim_ids) AS x FROM claims)
    UNION SELECT trim(claim_id), trim(x) FROM (SELECT claim_id, unnest(superseded_by_claim_ids) AS x FROM claims)),
  links AS (SELECT child, min(parent) AS parent FROM raw WHERE child IN (SELECT id FROM ids) AND parent IN (SELECT id FROM ids) GROUP BY child)"""

_P6 = f"""WITH RECURSIVE {_P6_LINKS},
  tree AS (SELECT DISTINCT parent AS id, parent AS root, 0 AS depth, parent AS path FROM links WHERE parent NOT IN (SELECT child FROM links)
    UNION ALL SELECT l.child, t.root, t.depth + 1, t.path || '/' || l.child FROM links l JOIN tree t ON l.parent = t.id),
  below AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(string_split(path, '/')) AS a, id FROM tree) WHERE a <> id GROUP BY a),
  nodes AS (SELECT child AS id FROM links UNION SELECT parent FROM links)
  SELECT n.id AS claim_id, coalesce(t.root, '') AS root_id, CAST(coalesce(t.depth, -1) AS BIGINT) AS depth, coalesce(t.path, '') AS path,
    CAST(CASE WHEN t.id IS NULL THEN -1 ELSE coalesce(b.n, 0) END AS BIGINT) AS descendants, CAST(CASE WHEN t.id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS cyclic
  FROM nodes n LEFT JOIN tree t ON n.id = t.id LEFT JOIN below b ON n.id = b.id"""

_P7 = """WITH last AS (SELECT * FROM workspace_state QUALIFY row_number() OVER (PARTITION BY project_id, snapshot_id ORDER BY arrived_at DESC, payload DESC) = 1),
  ordered AS (SELECT project_id, snapshot_id, lag(snapshot_id) OVER (PARTITION BY project_id ORDER BY taken_at, snapshot_id) AS prev FROM last),
  state AS (SELECT project_id, snapshot_id, 'state' AS section, 'state_id' AS entry, lower(payload->>'$.state_id') AS v FROM last),
  files AS (SELECT project_id, snapshot_id, 'files' AS section, j.key AS entry, lower(j.value->>'$') AS v FROM last, json_each(payload, '$.files') j WHERE j.key IS NOT NULL),
  src AS (SELECT project_id, snapshot_id, 'source_files' AS section, j.key AS entry, lower(j.value->>'$.sha256') AS v FROM last, json_each(payload, '$.source_files') j WHERE j.key IS NOT NULL),
  grp AS (SELECT project_id, snapshot_id, 'records.' || j.key AS section, j.value AS m FROM last, json_each(payload, '$.records') j WHERE j.key IS NOT NULL),
  rec AS (SELECT project_id, snapshot_id, section, j.key AS entry, lower(j.value->>'$') AS v FROM grp, json_each(grp.m) j WHERE j.key IS NOT NULL),
  e AS (SELECT * FROM state UNION ALL SELECT * FROM files UNION ALL SELECT * FROM src UNION ALL SELECT * FROM rec),
  n AS (SELECT o.project_id, o.snapshot_id, e.section, e.entry, e.v FROM ordered o JOIN e USING (project_id, snapshot_id) WHERE o.prev IS NOT NULL),
  b AS (SELECT o.project_id, o.snapshot_id, e.section, e.entry, e.v FROM ordered o JOIN e ON o.project_id = e.project_id AND o.prev = e.snapshot_id)
  SELECT coalesce(n.project_id, b.project_id) AS project_id, coalesce(n.snapshot_id, b.snapshot_id) AS snapshot_id, coalesce(n.section, b.section) AS section, coalesce(n.entry, b.entry) AS entry,
    CASE WHEN b.entry IS NULL THEN 'added' WHEN n.entry IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM n FULL JOIN b ON n.project_id = b.project_id AND n.snapshot_id = b.snapshot_id AND n.section = b.section AND n.entry = b.entry
  WHERE n.entry IS NULL OR b.entry IS NULL OR n.v IS DISTINCT FROM b.v"""

_JSON_NUMBER = r"""^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*")$"""


def _entries(doc: str, path: str) -> str:
    """An array's entries; a single object is an array of one."""
    return f"CASE json_type({doc}, '{path}') WHEN 'ARRAY' THEN json_extract({doc}, '{path}[*]') WHEN 'OBJECT' THEN [json_extract({doc}, '{path}')] ELSE [] END"


def _at(doc: str, path: str) -> str:
    """Entries as rows with their positions."""
    return f"(SELECT unnest({_entries(doc, path)}) AS x, generate_subscripts({_entries(doc, path)}, 1) - 1 AS pos)"


_P3 = f"""WITH p AS (SELECT DISTINCT planning_id, plan_version, CAST(payload AS JSON) AS j FROM power_plan WHERE json_valid(payload)),
  it AS (SELECT planning_id, plan_version, u.x AS i FROM p, LATERAL {_at("j", "$.planning_items")} u),
  sc AS (SELECT planning_id, plan_version, coalesce(i->>'$.planning_item_id', '') AS item_id, coalesce(u.x->>'$.scenario_id', '') AS scenario_id, u.pos, CASE json_type(u.x, '$.overrides') WHEN 'VARCHAR' THEN CASE WHEN json_valid(u.x->>'$.overrides') THEN CAST(u.x->>'$.overrides' AS JSON) END ELSE json_extract(u.x, '$.overrides') END AS o
    FROM it, LATERAL {_at("i", "$.scenarios")} u WHERE json_type(u.x) = 'OBJECT'),
  te AS (SELECT planning_id, plan_version, coalesce(i->>'$.planning_item_id', '') AS item_id, '' AS scenario_id, u.pos, u.x AS t FROM it, LATERAL {_at("i", "$.contrast_terms")} u
    UNION ALL SELECT planning_id, plan_version, item_id, scenario_id, u.pos, u.x FROM sc, LATERAL {_at("o", "$.contrast_terms")} u),
  co AS (SELECT claim_id, unnest(required_companions) AS c, generate_subscripts(required_companions, 1) - 1 AS pos FROM claims)
  SELECT DISTINCT * FROM (SELECT 'override' AS kind, coalesce(planning_id, '') AS root_id, coalesce(plan_version, '') AS plan_version, item_id, scenario_id, pos FROM sc WHERE regexp_matches(CAST(json_extract(o, '$.mean_difference') AS VARCHAR), '{_JSON_NUMBER}')
    UNION ALL SELECT 'term', coalesce(planning_id, ''), coalesce(plan_version, ''), item_id, scenario_id, pos FROM te WHERE regexp_matches(CAST(json_extract(t, '$.weight') AS VARCHAR), '{_JSON_NUMBER}')
    UNION ALL SELECT 'companion', claim_id, '', trim(c.claim_id), '', pos FROM co WHERE trim(c.claim_id) <> '')"""

_P1 = """WITH RECURSIVE src AS (SELECT stream_id, file_name, artifact, min(exported_at) OVER (PARTITION BY file_name) AS ex, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM ledger_files),
  pairs AS (SELECT stream_id, file_name, lag(file_name) OVER (PARTITION BY stream_id ORDER BY ex, file_name) AS old FROM (SELECT DISTINCT stream_id, file_name, ex FROM src)),
  rec AS (SELECT stream_id, file_name, j->>(CASE artifact WHEN 'claims' THEN '$.claim_id' WHEN 'workspace_state' THEN '$.project_id' ELSE '$.analysis_id' END) AS k, CAST(max(CAST(j AS VARCHAR)) AS JSON) AS j FROM src WHERE json_type(j) = 'OBJECT' GROUP BY ALL),
  walk AS (SELECT stream_id, file_name, k, e.key AS path, '' AS parent, e.value AS v, '' AS idx FROM rec, json_each(j) e
    UNION ALL SELECT w.stream_id, w.file_name, w.k, w.path || CASE json_type(w.v) WHEN 'OBJECT' THEN '.' ELSE '[].' END || e.key, w.path || CASE json_type(w.v) WHEN 'OBJECT' THEN '' ELSE '[]' END, e.value, w.idx || c.i || '/'
      FROM walk w, LATERAL (SELECT unnest(CASE json_type(w.v) WHEN 'OBJECT' THEN [w.v] ELSE list_filter(json_extract(w.v, '$[*]'), lambda x: json_type(x) = 'OBJECT') END) AS x, generate_subscripts(CASE json_type(w.v) WHEN 'OBJECT' THEN [w.v] ELSE list_filter(json_extract(w.v, '$[*]'), lambda x: json_type(x) = 'OBJECT') END, 1) AS i) c, json_each(c.x) e
      WHERE json_type(w.v) IN ('OBJECT', 'ARRAY')),
  typed AS (SELECT *, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS t, CAST(v AS VARCHAR) AS s FROM walk),
  own AS (SELECT stream_id, file_name, k, path, any_value(parent) AS parent, bool_or(s NOT IN ('null', '""', '[]', '{}')) AS filled FROM typed GROUP BY stream_id, file_name, k, path),
  vals AS (SELECT a.stream_id, a.file_name, a.k, a.path, a.filled, list_sort(list(substr(b.path, len(a.path) + 1) || '|' || b.idx || '|' || CASE WHEN b.t = 'object' THEN 'O' WHEN b.t = 'array' AND contains(b.s, '{') THEN 'A' ELSE b.s END) FILTER (b.t IS NOT NULL)) AS val
    FROM own a JOIN typed b ON a.stream_id = b.stream_id AND a.file_name = b.file_name AND a.k = b.k AND (b.path = a.path OR starts_with(b.path, a.path || '.') OR starts_with(b.path, a.path || '[]')) GROUP BY ALL),
  fld AS (SELECT stream_id, file_name, path, any_value(parent) AS parent, coalesce(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), []) AS kinds FROM typed GROUP BY ALL),
  n AS (SELECT p.stream_id, p.file_name, f.path, f.parent, f.kinds FROM pairs p JOIN fld f USING (stream_id, file_name) WHERE p.old IS NOT NULL),
  o AS (SELECT p.stream_id, p.file_name, f.path, f.parent, f.kinds FROM pairs p JOIN fld f ON p.stream_id = f.stream_id AND p.old = f.file_name),
  ch AS (SELECT coalesce(n.stream_id, o.stream_id) AS stream_id, coalesce(n.file_name, o.file_name) AS file_name, coalesce(n.path, o.path) AS path, coalesce(n.parent, o.parent) AS parent, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'type_changed' END AS change
    FROM n FULL JOIN o ON n.stream_id = o.stream_id AND n.file_name = o.file_name AND n.path = o.path WHERE n.path IS NULL OR o.path IS NULL OR (len(n.kinds) > 0 AND len(o.kinds) > 0 AND n.kinds <> o.kinds)),
  com AS (SELECT p.stream_id, p.file_name, p.old, a.k FROM pairs p JOIN rec a USING (stream_id, file_name) JOIN rec b ON p.stream_id = b.stream_id AND p.old = b.file_name AND a.k = b.k),
  sig AS (SELECT c.stream_id, c.file_name, c.path, c.parent, c.change, list_sort(list(v.k || '=' || CAST(v.val AS VARCHAR)) FILTER (v.val IS NOT NULL)) AS sig FROM ch c JOIN com USING (stream_id, file_name) JOIN vals v ON v.stream_id = c.stream_id AND v.k = com.k AND v.path = c.path AND v.file_name = CASE c.change WHEN 'added' THEN c.file_name ELSE com.old END WHERE c.change <> 'type_changed' GROUP BY ALL HAVING bool_or(v.filled)),
  pr AS (SELECT a.stream_id, a.file_name, a.path AS field, r.path AS old_field, count(*) OVER (PARTITION BY a.stream_id, a.file_name, a.path) AS x, count(*) OVER (PARTITION BY a.stream_id, a.file_name, r.path) AS y FROM sig a JOIN sig r USING (stream_id, file_name, parent, sig) WHERE a.change = 'added' AND r.change = 'removed'),
  ren AS (SELECT * FROM pr WHERE x = 1 AND y = 1),
  al AS (SELECT stream_id, file_name, field, old_field, 'renamed' AS change FROM ren
    UNION ALL SELECT stream_id, file_name, path, '', change FROM ch WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.stream_id = ch.stream_id AND ren.file_name = ch.file_name AND ((ch.change = 'added' AND ren.field = ch.path) OR (ch.change = 'removed' AND ren.old_field = ch.path))))
  SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.stream_id = al.stream_id AND ch.file_name = al.file_name AND (starts_with(al.field, ch.path || '.') OR starts_with(al.field, ch.path || '[]')))"""



def _p1_table_sql(artifact: str, key: str, typed: dict[str, str], promoted: dict[str, str]) -> str:
    """Lines' fields by type; what is outside the schema, null or of another type stays in ``_rescued``."""
    kinds = {"string": "('VARCHAR')", "double": "('UBIGINT', 'BIGINT', 'DOUBLE')", "bigint": "('UBIGINT', 'BIGINT')", "boolean": "('BOOLEAN')", "json": "('ARRAY', 'OBJECT')", "array<string>": "('ARRAY')"}
    value = {"string": "j->>'$.\"{f}\"'", "double": "CAST(j->>'$.\"{f}\"' AS DOUBLE)", "bigint": "CAST(j->>'$.\"{f}\"' AS BIGINT)", "boolean": "CAST(j->>'$.\"{f}\"' AS BOOLEAN)", "json": "CAST(json_extract(j, '$.\"{f}\"') AS VARCHAR)", "array<string>": "CAST(json_extract(j, '$.\"{f}\"') AS VARCHAR[])"}
    every = typed | promoted
    fits = {f: f"coalesce(json_type(j, '$.\"{f}\"') IN {kinds[t]}, false)" for f, t in every.items()}
    # columns can't differ by letter case alone
    names, taken = {}, set()
    for f in every:
        n = f if f.lower() not in taken else f"{f}_2"
        taken.add(n.lower())
        names[f] = n
    cols = ", ".join(f"CASE WHEN {fits[f]} THEN {value[t].format(f=f)} END AS \"{names[f]}\"" for f, t in every.items())
    kept = " AND ".join(f"NOT (e.key = '{f}' AND {fits[f]})" for f in every)
    return f"""WITH r AS (SELECT DISTINCT stream_id, file_name, exported_at, CAST(payload AS JSON) AS j FROM ledger_files WHERE artifact = '{artifact}' AND json_valid(payload) AND json_type(payload) = 'OBJECT')
      SELECT DISTINCT stream_id, file_name, exported_at, j->>'$.{key}' AS record_key, {cols}, (SELECT CASE WHEN count(*) > 0 THEN '{{' || string_agg(CAST(to_json(e.key) AS VARCHAR) || ':' || CASE json_type(e.value) WHEN 'OBJECT' THEN (SELECT '{{' || coalesce(string_agg(CAST(to_json(i.key) AS VARCHAR) || ':' || CAST(i.value AS VARCHAR), ',' ORDER BY i.key), '') || '}}' FROM json_each(e.value) i) ELSE CAST(e.value AS VARCHAR) END, ',' ORDER BY e.key) || '}}' END FROM json_each(j) e WHERE {kept}) AS _rescued FROM r"""


_T = "string"
_P1_TABLES = {
    "claims": ("claim_id", {"claim_id": _T, "section": _T, "claim_type": _T, "text": _T, "evidence_ids": "array<string>", "status": _T, "lifecycle_state": _T, "anchor_precision": _T, "object_refs": "json", "manuscript_anchor": _T, "strength": _T}, {"anchor_granularity": _T, "Anchor_Precision": _T, "lifecycleState": _T, "x_skill_hint": _T}),
    "workspace_state": ("project_id", {"project_id": _T, "schema_version": "double", "state_id": _T, "skill_version": _T, "mode": _T, "files": "json"}, {"version": "double", "Schema_Version": "double", "x_skill_hint": _T, "x_locked": "boolean", "review_round": "bigint"}),
    "analysis_plan": ("analysis_id", {"analysis_id": _T, "analysis_plan_schema_version": _T, "plan_version": _T, "profile": _T, "random_seed": "bigint", "input": "json", "analyses": "json"}, {"x_skill_hint": _T, "x_locked": "boolean", "manuscript_presence": _T}),
}


def _number(doc: str, key: str) -> str:
    """A column that is a number or the text of one."""
    j = f"CAST(json_extract({doc}, '$.{key}') AS VARCHAR)"
    return f"CASE WHEN regexp_matches({j}, '{_JSON_NUMBER}') THEN CAST(trim(replace({j}, '\"', '')) AS DOUBLE) END"


_P3_DOCS = f"""p AS (SELECT DISTINCT planning_id, plan_version, md5(payload) AS doc, CAST(payload AS JSON) AS j FROM power_plan WHERE json_valid(payload)),
  it AS (SELECT planning_id, plan_version, doc, u.x AS i, u.pos FROM p, LATERAL {_at("j", "$.planning_items")} u WHERE json_type(u.x) = 'OBJECT'),
  sc AS (SELECT planning_id, plan_version, doc, i->>'$.planning_item_id' AS item_id, u.x->>'$.scenario_id' AS scenario_id, CASE json_type(u.x, '$.overrides') WHEN 'VARCHAR' THEN CASE WHEN json_valid(u.x->>'$.overrides') THEN CAST(u.x->>'$.overrides' AS JSON) END ELSE json_extract(u.x, '$.overrides') END AS o
    FROM it, LATERAL {_at("i", "$.scenarios")} u WHERE json_type(u.x) = 'OBJECT'),
  te AS (SELECT planning_id, plan_version, doc, i->>'$.planning_item_id' AS item_id, NULL AS scenario_id, u.pos, u.x AS t FROM it, LATERAL {_at("i", "$.contrast_terms")} u UNION ALL SELECT planning_id, plan_version, doc, item_id, scenario_id, u.pos, u.x FROM sc, LATERAL {_at("o", "$.contrast_terms")} u)"""

SQL = {
    "p1_found": _P1,
    **{f"p1_{a}": _p1_table_sql(a, *parts) for a, parts in _P1_TABLES.items()},
    "p3_found": _P3,
    "p3_items": f"WITH {_P3_DOCS} SELECT planning_id, plan_version, doc, pos, i->>'$.planning_item_id' AS planning_item_id, i->>'$.type' AS type, {_number('i', 'alpha')} AS alpha, {_number('i', 'mean_difference')} AS mean_difference FROM it",
    "p3_terms": f"WITH {_P3_DOCS} SELECT planning_id, plan_version, doc, item_id, scenario_id, pos, t->>'$.level' AS level, {_number('t', 'weight')} AS weight FROM te WHERE json_type(t) = 'OBJECT'",
    "p3_foreign_keys": f"WITH {_P3_DOCS} SELECT 'planning_items' AS element, count(*) AS rows, CAST(0 AS BIGINT) AS orphans FROM it UNION ALL SELECT 'scenarios', count(*), CAST(0 AS BIGINT) FROM sc UNION ALL SELECT 'contrast_terms', count(*), CAST(0 AS BIGINT) FROM te WHERE json_type(t) = 'OBJECT'",
    "p4_found": _p4_sql(),
    "p5_found": _P5,
    "p5_by_period": f'SELECT ref_field, status, period, count(*) AS "references", count(DISTINCT target_id) AS targets FROM ({_P5}) GROUP BY ALL',
    "p6_found": _P6,
    "p6_back_edges": f"""WITH RECURSIVE {_P6_LINKS}, up AS (SELECT child AS a, parent AS b FROM links UNION SELECT u.a, l.parent FROM up u JOIN links l ON u.b = l.child), least AS (SELECT DISTINCT min(v.b) OVER (PARTITION BY u.a) AS m FROM up u JOIN up v ON u.a = v.a WHERE u.a = u.b)
  SELECT l.parent AS claim_id, m AS back_edge_to FROM least JOIN links l ON l.child = m""",
    "p6_descendants": f"""WITH RECURSIVE {_P6_LINKS}, up AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance FROM links UNION SELECT l.parent, u.descendant, u.distance + 1 FROM up u JOIN links l ON u.ancestor = l.child WHERE u.distance <= (SELECT count(*) FROM links)),
  rooted AS (SELECT DISTINCT descendant FROM up WHERE ancestor NOT IN (SELECT child FROM links)) SELECT DISTINCT ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM up WHERE descendant IN (SELECT descendant FROM rooted)""",
    "p7_found": _P7,
}
