"""Queries of single operators, continued: figures, manuscripts, scalar functions, tables, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import ledger as L
from auditloom.functions import typed
from auditloom.functions.text import norm
from auditloom.operators import clean, figures, findings, linkage, manuscript, power, spans, stats
from auditloom.operators.quantiles import quantiles
from auditloom.plans.inventory import QUERIES, SQL, query
from auditloom.plans.relations import Relation
from auditloom.plans.tables import table
from auditloom.scratch import Scratch
from auditloom.sources import readers, sinks

__all__ = ["QUERIES", "SQL"]

# ---- figures

_ENT = Relation("id string, label string, x double, y double, w double, h double", [("e1", "Cell", 0.0, 0.0, 100.0, 50.0), ("e2", " ", 90.0, 10.0, 100.0, 50.0), ("e3", "Gene", 400.0, 0.0, 50.0, 50.0), ("e4", "Box", 380.0, -20.0, 200.0, 200.0), ("e3", "Again", 700.0, 0.0, 10.0, 10.0), ("e5", None, 0.0, 300.0, 10.0, 10.0)])
_REL = Relation("id string, source string, target string, type string, x1 double, y1 double, x2 double, y2 double", [("r1", "e1", "e3", "activates", 100.0, 25.0, 400.0, 25.0), ("r2", "e2", "e9", "inhibits", 0.0, 0.0, 1.0, 1.0), ("r3", None, "e1", "unknown", 0.0, 0.0, 130.0, 90.0), ("e5", "e5", "e1", None, 13.0, 304.0, 50.0, 25.0)])


@query("figure_specification", """SELECT 'error' AS severity, 'repeated_id' AS rule, id AS entity_id, CAST(count(*) AS VARCHAR) AS message FROM (SELECT id FROM e UNION ALL SELECT id FROM r) GROUP BY id HAVING count(*) > 1
  UNION SELECT 'error', 'no_such_source', id, coalesce(source, '') FROM r WHERE source IS NULL OR source NOT IN (SELECT id FROM e) UNION SELECT 'error', 'no_such_target', id, coalesce(target, '') FROM r WHERE target IS NULL OR target NOT IN (SELECT id FROM e)
  UNION SELECT 'error', 'unknown_relation', id, coalesce(type, '') FROM r WHERE coalesce(type, '') NOT IN ('activates', 'inhibits') UNION SELECT 'warning', 'no_label', id, 'the entity has no label' FROM e WHERE trim(coalesce(label, '')) = ''""", e=_ENT, r=_REL)
def figure_specification(s: SparkSession, d: str) -> DataFrame:
    return figures.specification(_ENT.df(s), _REL.df(s), ["activates", "inhibits"])


@query("claim_grounding", """WITH c AS (SELECT DISTINCT trim(claim_id) AS id, evidence_ids AS a FROM claims), u AS (SELECT id, unnest(a) AS k FROM c), e AS (SELECT DISTINCT trim(evidence_id) AS id FROM evidence WHERE evidence_id IS NOT NULL)
  SELECT 'error' AS severity, 'ungrounded' AS rule, coalesce(id, '') AS entity_id, 'the claim has no anchor' AS message FROM c WHERE a IS NULL OR len(a) = 0
  UNION SELECT 'error', 'no_such_anchor', coalesce(id, ''), coalesce(k, '') FROM u WHERE k IS NULL OR k NOT IN (SELECT id FROM e)
  UNION SELECT 'warning', 'unused_anchor', id, 'no claim uses it' FROM e WHERE id NOT IN (SELECT k FROM u WHERE k IS NOT NULL)""")
def claim_grounding(s: SparkSession, d: str) -> DataFrame:
    return figures.grounding(table(s, d, "claims").select(F.trim("claim_id").alias("id"), F.col("evidence_ids").alias("anchor_ids")).distinct(), table(s, d, "evidence").where("evidence_id is not null").select(F.trim("evidence_id").alias("id")).distinct())


_SHOWN = Relation("id string, text string", [("e1", "The Cell"), ("e1", "membrane"), ("e2", "x"), ("e4", None)])


@query("labels_shown", """WITH s AS (SELECT id, coalesce(string_agg(text, ' '), '') AS t FROM shown GROUP BY id) SELECT DISTINCT 'error' AS severity, 'not_drawn' AS rule, e.id AS entity_id, 'no element has this id' AS message FROM e LEFT JOIN s USING (id) WHERE t IS NULL
  UNION SELECT 'error', 'label_not_shown', e.id, label FROM e JOIN s USING (id) WHERE NOT contains(lower(t), lower(label))""", e=_ENT, shown=_SHOWN)
def labels_shown(s: SparkSession, d: str) -> DataFrame:
    return figures.labels_shown(_ENT.df(s), _SHOWN.df(s))


@query("route_gaps", """WITH g AS (SELECT r.id, 'source_gap' AS rule, sqrt(greatest(x - x1, 0, x1 - x - w) ** 2 + greatest(y - y1, 0, y1 - y - h) ** 2) AS dist FROM r JOIN e ON r.source = e.id UNION ALL SELECT r.id, 'target_gap', sqrt(greatest(x - x2, 0, x2 - x - w) ** 2 + greatest(y - y2, 0, y2 - y - h) ** 2) FROM r JOIN e ON r.target = e.id)
  SELECT DISTINCT 'error' AS severity, rule, id AS entity_id, CAST(round(dist, 3) AS VARCHAR) AS message FROM g WHERE dist > 2""", e=_ENT, r=_REL)
def route_gaps(s: SparkSession, d: str) -> DataFrame:
    return figures.route_gaps(_ENT.df(s), _REL.df(s), 2.0)


@query("box_overlaps", """WITH b AS (SELECT p_partkey AS id, (p_partkey % 100) * 30.0 AS x, (p_partkey // 100) * 20.0 AS y, p_size::DOUBLE AS w, p_size / 2.0 AS h FROM part),
  o AS (SELECT a.id AS a, b.id AS b, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) AS ratio FROM b a JOIN b ON a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h)
  SELECT a, b, round(ratio, 6) AS ratio FROM o WHERE ratio >= 0.05 AND b <> a + 1""")
def box_overlaps(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100 * 30.0).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 100) * 20.0).cast("double").alias("y"), F.col("p_size").cast("double").alias("w"), (F.col("p_size") / 2.0).cast("double").alias("h"))
    inside = p.select((F.col("id") + 1).alias("parent"), F.col("id").alias("child"))
    return figures.box_overlaps(p, inside, 0.05, 64.0).select("a", "b", F.round("ratio", 6).alias("ratio"))


_FONTS = Relation("id string, font_size double, view_width double", [("t1", 12.0, 800.0), ("t2", 30.0, 800.0), ("t3", 10.0, 200.0), ("t4", None, 100.0)])


@query("legibility", "SELECT 'error' AS severity, 'too_small' AS rule, id AS entity_id, CAST(round(font_size / view_width * 3.5 * 72, 2) AS VARCHAR) || ' pt' AS message FROM t WHERE font_size / view_width * 3.5 * 72 < 7", t=_FONTS)
def legibility(s: SparkSession, d: str) -> DataFrame:
    return figures.legibility(_FONTS.df(s), 3.5, 7.0)


_SPECS = Relation("id string, entities bigint, relations bigint, panels bigint, core_claims bigint, feedback bigint", [("low", 3, 2, 1, 1, 0), ("edge of medium", 5, 4, 1, 2, 0), ("medium", 6, 4, 2, 3, 1), ("edge of high", 8, 8, 1, 2, 0), ("high", 10, 12, 3, 6, 2), ("nothing", 0, None, None, None, None)])


@query("figure_complexity", """WITH s AS (SELECT id, entities + 0.75 * coalesce(relations, 0) + 2 * greatest(coalesce(panels, 0) - 1, 0) + 0.75 * greatest(coalesce(core_claims, 0) - 2, 0) + 0.75 * coalesce(feedback, 0) AS score FROM t)
  SELECT id, score::DOUBLE AS score, CASE WHEN score >= 14 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS level FROM s""", t=_SPECS)
def figure_complexity(s: SparkSession, d: str) -> DataFrame:
    return figures.complexity(_SPECS.df(s))


@query("score_gate", """SELECT 'error' AS severity, 'below_threshold' AS rule, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS entity_id, m AS message FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN coalesce(l_quantity < 3, true) THEN 'l_quantity' END, CASE WHEN coalesce(l_discount < 0.01, true) THEN 'l_discount' END]) AS m FROM lineitem) WHERE m IS NOT NULL GROUP BY ALL""")
def score_gate(s: SparkSession, d: str) -> DataFrame:
    return figures.gate(table(s, d, "lineitem").withColumn("id", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))), {"l_quantity": 3.0, "l_discount": 0.01}).distinct()


_EVALS = Relation("case_id string, run_id string, variant string, scores map<string,double>, failures array<struct<category:string,severity:string>>", [
    ("c1", "1", "base", {"coverage": 5.0, "clarity": 6.0}, [("text", "minor"), ("route", "critical")]), ("c1", "2", "new", {"coverage": 7.0, "clarity": 6.0}, [("text", "minor")]),
    ("c2", "1", "base", {"coverage": 5.0}, [("text", "huge")]), ("c2", "2", "new", {"coverage": 5.0, "clarity": 11.0}, []), ("c3", "1", "base", {"coverage": 9.0, "clarity": 2.0}, [(None, None)]), ("c3", "1", "base", {"coverage": 9.0, "clarity": 2.0}, None), ("c3", "2", "new", {"coverage": 4.0, "clarity": None}, [("route", "critical")]),
    ("c4", "1", "base", {"coverage": 6.0, "clarity": 5.0}, []), ("c4", "2", "new", {"coverage": 2.0, "clarity": 5.0}, [("text", "major")]),
])


@query("evaluation_records", """WITH k AS (SELECT case_id || '/' || run_id AS e, unnest(map_keys(scores)) AS n, unnest(map_values(scores)) AS v FROM ev), f AS (SELECT case_id || '/' || run_id AS e, unnest(failures).severity AS s FROM ev)
  SELECT 'error' AS severity, 'score_missing' AS rule, case_id || '/' || run_id AS entity_id, r AS message FROM ev, (SELECT unnest(['coverage', 'clarity']) AS r) WHERE NOT list_contains(map_keys(scores), r) UNION SELECT 'error', 'score_range', e, n FROM k WHERE v IS NULL OR v < 0 OR v > 10
  UNION SELECT 'error', 'severity', e, coalesce(s, '') FROM f WHERE coalesce(s, '') NOT IN ('critical', 'major', 'minor') UNION SELECT 'error', 'repeated_run', case_id || '/' || run_id, CAST(count(*) AS VARCHAR) FROM ev GROUP BY case_id, run_id HAVING count(*) > 1""", ev=_EVALS)
def evaluation_records(s: SparkSession, d: str) -> DataFrame:
    return figures.evaluation_records(_EVALS.df(s), ("coverage", "clarity"))


_PAIRED = """p AS (SELECT case_id, max(scores['coverage']) FILTER (variant = 'base') AS a, max(scores['coverage']) FILTER (variant = 'new') AS b FROM ev GROUP BY 1 HAVING count(*) FILTER (variant = 'base') = 1 AND count(*) FILTER (variant = 'new') = 1)"""


@query("paired_scores", f"WITH {_PAIRED} SELECT case_id, a, b, b - a AS delta FROM p", ev=_EVALS)
def paired_scores(s: SparkSession, d: str) -> DataFrame:
    return figures.paired_scores(_EVALS.df(s), "base", "new", "coverage")


@query("win_tie_loss", f"WITH {_PAIRED} SELECT count(*) AS cases, avg(a) AS mean_a, avg(b) AS mean_b, avg(b - a) AS mean_delta, count(*) FILTER (b > a) AS wins, count(*) FILTER (b = a) AS ties, count(*) FILTER (b < a) AS losses FROM p", ev=_EVALS)
def win_tie_loss(s: SparkSession, d: str) -> DataFrame:
    return figures.win_tie_loss(figures.paired_scores(_EVALS.df(s), "base", "new", "coverage"))


@query("failure_counts", """WITH f AS (SELECT unnest(failures) AS f FROM ev), g AS (SELECT coalesce(f.severity, '') AS severity, coalesce(f.category, '') AS category FROM f) SELECT severity, category, count(*) AS n FROM g GROUP BY CUBE (severity, category)""", ev=_EVALS)
def failure_counts(s: SparkSession, d: str) -> DataFrame:
    return figures.failure_counts(_EVALS.df(s))


_SUITE = Relation("variant_id string, parent_id string, path string, sha256 string", [("v1", None, "a.svg", "AA"), ("v2", "v1", "b.svg", "bb"), ("v3", "v9", "c.svg", "cc"), ("v4", "v1", "gone.svg", "dd")])
_SVGS = Relation("path string, sha256 string", [("a.svg", "aa"), ("b.svg", "b0"), ("c.svg", "cc")])


@query("suite_integrity", """SELECT 'error' AS severity, 'file_missing' AS rule, variant_id AS entity_id, path AS message FROM su WHERE path NOT IN (SELECT path FROM fi) UNION SELECT 'error', 'file_changed', variant_id, su.path FROM su JOIN fi ON su.path = fi.path WHERE lower(su.sha256) <> lower(fi.sha256)
  UNION SELECT 'error', 'no_such_parent', variant_id, parent_id FROM su WHERE parent_id NOT IN (SELECT variant_id FROM su)""", su=_SUITE, fi=_SVGS)
def suite_integrity(s: SparkSession, d: str) -> DataFrame:
    return figures.suite_integrity(_SUITE.df(s), _SVGS.df(s))


@query("enum_check", """SELECT DISTINCT 'error' AS severity, 'not_allowed' AS rule, coalesce(CAST(claim_id AS VARCHAR), '') AS entity_id, c AS message FROM (SELECT claim_id, unnest([CASE WHEN NOT coalesce(claim_type IN ('result', 'method'), false) THEN 'claim_type' END, CASE WHEN NOT coalesce(strength IN ('causal', 'associative'), false) THEN 'strength' END]) AS c FROM claims) WHERE c IS NOT NULL""")
def enum_check(s: SparkSession, d: str) -> DataFrame:
    return figures.enum_check(table(s, d, "claims"), "claim_id", {"claim_type": ["result", "method"], "strength": ["causal", "associative"]}).distinct()


@query("readiness", """SELECT o_orderpriority AS dimension, CASE WHEN bool_or(coalesce(o_totalprice > 499000, false)) THEN 'blocked' WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 'not_checked' WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'ready' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'partial' ELSE 'missing' END AS status FROM orders GROUP BY 1""")
def readiness(s: SparkSession, d: str) -> DataFrame:
    st = F.col("o_orderstatus")
    return figures.readiness(table(s, d, "orders").select(F.col("o_orderpriority").alias("dimension"), F.when(st != "P", st == "F").alias("ok"), (F.col("o_totalprice") > 499000).alias("blocked")))


_PATHS = Relation("id string, p string, x1 double, y1 double, x2 double, y2 double", [("lines", "M 1 2 L 3 4 H 10 V -1", 1.0, 2.0, 10.0, -1.0), ("relative", "m1,2 l3,4 h1 v1", 1.0, 2.0, 5.0, 7.0), ("curve", "M0 0 C 1 1 2 2 3 3 S 4 4 5 5", 0.0, 0.0, 5.0, 5.0), ("closed", "M2 2 L5 5 Z", 2.0, 2.0, 2.0, 2.0), ("arc", "M0 0 a 1 1 0 0 1 4 5", 0.0, 0.0, 4.0, 5.0), ("broken", "M 1", None, None, None, None), ("none", None, None, None, None, None)])


@query("svg_path_ends", "SELECT id, x1, y1, x2, y2 FROM t", t=_PATHS)
def svg_path_ends(s: SparkSession, d: str) -> DataFrame:
    return _PATHS.df(s).select("id", figures.svg_path_ends("p").alias("e")).select("id", "e.*")


# ---- manuscripts

_PARA = Relation("paragraph_id string, claim_ids array<string>", [("p1", ["c1", "c2"]), ("p2", ["c3"]), ("p3", None)])
_HELD = Relation("paragraph_id string, claim_id string, section string", [("p1", "c1", "results"), ("p2", "c3", "results"), ("p2", "c4", "results"), ("p4", "c2", "methods"), ("p4", "c2", "methods")])


@query("paragraph_coverage", """WITH w AS (SELECT paragraph_id AS p, unnest(claim_ids) AS c FROM k), g AS (SELECT DISTINCT paragraph_id AS p, claim_id AS c FROM h) SELECT 'error' AS severity, 'claim_not_in_paragraph' AS rule, p AS entity_id, c AS message FROM w ANTI JOIN g USING (p, c) UNION SELECT 'error', 'claim_not_in_contract', p, c FROM g ANTI JOIN w USING (p, c)""", k=_PARA, h=_HELD)
def paragraph_coverage(s: SparkSession, d: str) -> DataFrame:
    return manuscript.coverage(_PARA.df(s), _HELD.df(s))


_NEEDS = Relation("claim_id string, required_companions array<struct<claim_id:string,scope:string>>", [("c1", [("c2", "paragraph"), ("c3", "Section"), (" ", "section"), None]), ("c3", [("c4 ", "paragraph"), ("c9", "document")]), ("c2", None)])


@query("companions", """WITH n AS (SELECT claim_id AS c, trim(x.claim_id) AS o, lower(trim(coalesce(x.scope, ''))) AS sc FROM (SELECT claim_id, unnest(required_companions) AS x FROM k) WHERE trim(x.claim_id) <> ''), pl AS (SELECT c, o, sc, paragraph_id AS p, section AS s FROM n JOIN h ON h.claim_id = n.c)
  SELECT DISTINCT 'error' AS severity, 'companion_not_in_paragraph' AS rule, c AS entity_id, o AS message FROM pl WHERE sc = 'paragraph' AND NOT EXISTS (SELECT 1 FROM h WHERE h.claim_id = o AND h.paragraph_id = p)
  UNION SELECT 'error', 'companion_not_in_section', c, o FROM pl WHERE sc = 'section' AND NOT EXISTS (SELECT 1 FROM h WHERE h.claim_id = o AND h.section = s) UNION SELECT 'error', 'companion_missing', c, o FROM n WHERE sc NOT IN ('paragraph', 'section') AND o NOT IN (SELECT claim_id FROM h)""", k=_NEEDS, h=_HELD)
def companions(s: SparkSession, d: str) -> DataFrame:
    return manuscript.companions(_NEEDS.df(s), _HELD.df(s))


_OBL = Relation("obligation_id string, status string, required_actions array<string>, change_ids array<string>", [("o1", "closed", ["edit", "check"], ["h1"]), ("o2", "Closed", ["edit"], None), ("o3", "open", ["edit"], ["h9"]), ("o4", "closed", ["edit"], ["h1", "h2"])])
_CHG = Relation("change_id string, actions array<string>", [("h1", ["edit"]), ("h2", ["check", "edit"])])


@query("obligations", """WITH l AS (SELECT obligation_id AS o, unnest(change_ids) AS c FROM ob), a AS (SELECT o, unnest(actions) AS x FROM l JOIN ch ON ch.change_id = l.c), q AS (SELECT obligation_id AS o, unnest(required_actions) AS x FROM ob)
  SELECT 'error' AS severity, 'closed_without_change' AS rule, obligation_id AS entity_id, 'no change is named' AS message FROM ob WHERE lower(status) = 'closed' AND coalesce(len(change_ids), 0) = 0 UNION SELECT 'error', 'no_such_change', o, c FROM l WHERE c NOT IN (SELECT change_id FROM ch) UNION SELECT 'error', 'action_not_done', o, x FROM q ANTI JOIN a USING (o, x)""", ob=_OBL, ch=_CHG)
def obligations(s: SparkSession, d: str) -> DataFrame:
    return manuscript.obligations(_OBL.df(s), _CHG.df(s))


_SEC = Relation("doc_id string, name string, start bigint, text string", [("d1", "Methods", 0, "a b c"), ("d1", "Results", 10, "one two three four five"), ("d1", "Abstract", 30, "x"), ("d1", "Results", 40, "y"), ("d2", "abstract", 0, "one"), ("d2", "Aside", 5, "z")])


@query("writing_profile", """WITH o AS (SELECT unnest(['abstract', 'methods', 'results']) AS n, unnest([0, 1, 2]) AS r), s AS (SELECT t.*, lower(trim(name)) AS n, r FROM t LEFT JOIN o ON o.n = lower(trim(t.name))), p AS (SELECT *, max(r) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM s WHERE r IS NOT NULL)
  SELECT 'error' AS severity, 'order' AS rule, doc_id AS entity_id, name AS message FROM p WHERE r < pr UNION SELECT 'error', 'section_missing', d, o.n FROM (SELECT DISTINCT doc_id AS d FROM t), o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d AND s.n = o.n)
  UNION SELECT 'error', 'section_repeated', doc_id, n FROM p GROUP BY doc_id, n HAVING count(*) > 1 UNION SELECT 'error', 'too_long', doc_id, name || ' ' || CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS VARCHAR) FROM s WHERE n = 'results' AND len(regexp_extract_all(text, '[A-Za-z0-9]+')) > 4""", t=_SEC)
def writing_profile(s: SparkSession, d: str) -> DataFrame:
    return manuscript.writing_profile(_SEC.df(s), ["abstract", "methods", "results"], {"results": 4})


@query("numbered_names", """SELECT doc_id, start, text, name || CASE WHEN k > 1 THEN ' (' || CAST(k AS VARCHAR) || ')' ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY start) AS k FROM t)""", t=_SEC)
def numbered_names(s: SparkSession, d: str) -> DataFrame:
    return manuscript.numbered_names(_SEC.df(s))


_SIDES = Relation("conflict_id string, disposition string, side string, evidence_ids array<string>, text string", [("k1", "open", "a", ["e1"], "It was 5."), ("k1", "open", "b", ["e9"], "It was 6."), ("k2", "kept", "a", ["e1", "e2 "], "From 5 to 7."), ("k3", None, "a", None, "none")])
_EVT = Relation("evidence_id string, value_tokens array<string>", [("e1", ["5"]), ("e2", ["7", "8"])])


@query("conflicts", """WITH x AS (SELECT conflict_id AS k, side, trim(e) AS e FROM (SELECT conflict_id, side, unnest(evidence_ids) AS e FROM si)), f AS (SELECT x.k, x.side, unnest(value_tokens) AS v FROM x JOIN ev ON ev.evidence_id = x.e), n AS (SELECT conflict_id AS k, side, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM si)
  SELECT DISTINCT 'error' AS severity, 'unresolved' AS rule, conflict_id AS entity_id, 'no disposition' AS message FROM si WHERE trim(coalesce(disposition, '')) IN ('', 'open') UNION SELECT 'error', 'side_without_evidence', conflict_id, side FROM si WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.k = conflict_id AND f.side = si.side)
  UNION SELECT 'warning', 'number_not_in_evidence', k, v FROM n ANTI JOIN f USING (k, side, v)""", si=_SIDES, ev=_EVT)
def conflicts(s: SparkSession, d: str) -> DataFrame:
    return manuscript.conflicts(_SIDES.df(s), _EVT.df(s))


_V1 = Relation("doc_id string, name string, text string", [("d1", "Intro", "one two three"), ("d1", "Results", "a b c d\n\nkept line"), ("d1", "Gone", "x"), ("d2", "Intro", "p q r s")])
_V2 = Relation("doc_id string, name string, text string", [("d1", "Intro", "one two three"), ("d1", "Results", "a b x y\n\nkept line"), ("d1", "New", "y"), ("d2", "Intro", "1 2 3 4")])


@query("section_diff", """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.name, n.name) AS name, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS change,
  CASE WHEN o.text = n.text THEN 1.0 WHEN o.text IS NOT NULL AND n.text IS NOT NULL THEN round(2.0 * len(list_intersect(string_split_regex(o.text, '\\s+'), string_split_regex(n.text, '\\s+'))) / (len(string_split_regex(o.text, '\\s+')) + len(string_split_regex(n.text, '\\s+'))), 6) END::DOUBLE AS similarity,
  CASE WHEN o.text IS NOT NULL AND n.text IS NOT NULL THEN len(list_filter(string_split(o.text, chr(10) || chr(10)), lambda x: list_contains(string_split(n.text, chr(10) || chr(10)), x))) / len(string_split(o.text, chr(10) || chr(10)))::DOUBLE END AS preserved FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.name = n.name""".replace("\\\\", "\\"), o=_V1, n=_V2)
def section_diff(s: SparkSession, d: str) -> DataFrame:
    return manuscript.section_diff(_V1.df(s), _V2.df(s)).withColumn("similarity", F.round("similarity", 6))


@query("locality", "SELECT 'error' AS severity, 'not_local' AS rule, n.doc_id AS entity_id, n.name AS message FROM o JOIN n ON o.doc_id = n.doc_id AND o.name = n.name WHERE o.text <> n.text AND len(list_filter(string_split(o.text, chr(10)), lambda x: list_contains(string_split(n.text, chr(10)), x))) = 0", o=_V1, n=_V2)
def locality(s: SparkSession, d: str) -> DataFrame:
    return manuscript.locality(manuscript.section_diff(_V1.df(s), _V2.df(s)))


_ANC = Relation("anchor string, claim_id string, label string", [("a1", "c1", "Figure 1"), ("a2", "c2", "figure 1"), ("a3", "c3", ""), ("a9", "c4", "Table 2")])
_PAR = Relation("anchor string, text string", [("a1", "See Figure 1: 5 of 7."), ("a2", "No label, 9."), ("a3", "plain")])
_REQ = Relation("claim_id string, required_value_tokens array<string>", [("c1", ["5", "8"]), ("c2", [" 9 "]), ("c3", None)])


@query("anchor_consistency", """WITH j AS (SELECT an.*, pa.text FROM an LEFT JOIN pa USING (anchor)) SELECT 'error' AS severity, 'no_such_anchor' AS rule, claim_id AS entity_id, anchor AS message FROM j WHERE text IS NULL UNION SELECT 'error', 'label_not_in_paragraph', claim_id, label FROM j WHERE label <> '' AND NOT contains(lower(text), lower(label))
  UNION SELECT 'warning', 'label_at_several_anchors', lower(label), CAST(count(DISTINCT anchor) AS VARCHAR) FROM an WHERE label <> '' GROUP BY lower(label) HAVING count(DISTINCT anchor) > 1
  UNION SELECT 'error', 'value_not_at_anchor', claim_id, v FROM (SELECT j.claim_id, text, trim(unnest(required_value_tokens)) AS v FROM j JOIN rq USING (claim_id) WHERE text IS NOT NULL) WHERE NOT list_contains(regexp_extract_all(text, '[0-9]+'), v)""", an=_ANC, pa=_PAR, rq=_REQ)
def anchor_consistency(s: SparkSession, d: str) -> DataFrame:
    return manuscript.anchor_consistency(_ANC.df(s), _PAR.df(s), _REQ.df(s))


_CON = Relation("contract_id string, evidence_ids array<string>, required_sections array<string>, abstract_eligible boolean", [("k1", ["E1", " E2"], ["Results", "Abstract"], False), ("k2", ["E9", " "], ["results"], True)])
_CLM = Relation("claim_id string, section string, evidence_ids array<string>", [("c1", "Results", ["E1"]), ("c2", "abstract ", ["E2"]), ("c3", "Methods", None)])
_EVI = Relation("evidence_id string", [("E1",), ("E2 ",)])


@query("reporting_contracts", """WITH n AS (SELECT contract_id AS k, abstract_eligible AS ok, trim(e) AS e FROM (SELECT contract_id, abstract_eligible, unnest(evidence_ids) AS e FROM co) WHERE trim(e) <> ''), u AS (SELECT claim_id, lower(trim(section)) AS s, trim(e) AS e FROM (SELECT claim_id, section, unnest(evidence_ids) AS e FROM cl))
  SELECT 'error' AS severity, 'no_such_evidence' AS rule, k AS entity_id, e AS message FROM n WHERE e NOT IN (SELECT trim(evidence_id) FROM ev) UNION SELECT 'error', 'not_reported', contract_id, lower(r) FROM (SELECT contract_id, unnest(required_sections) AS r FROM co) WHERE NOT EXISTS (SELECT 1 FROM n JOIN u USING (e) WHERE n.k = contract_id AND u.s = lower(r))
  UNION SELECT 'error', 'not_for_the_abstract', k, claim_id FROM n JOIN u USING (e) WHERE NOT ok AND s = 'abstract'""", co=_CON, cl=_CLM, ev=_EVI)
def reporting_contracts(s: SparkSession, d: str) -> DataFrame:
    return manuscript.reporting_contracts(_CON.df(s), _CLM.df(s), _EVI.df(s))


_TXT = Relation("claim_id string, text string", [("c1", "A was higher; B was lower"), ("c2", "A was higher (and B was not shown)"), ("c3", "A rose and B has 3 arms and C is open"), ("c4", None)])


@query("atomicity", "SELECT 'warning' AS severity, 'not_atomic' AS rule, claim_id AS entity_id, '2' AS message FROM t WHERE claim_id IN ('c1', 'c3')", t=_TXT)
def atomicity(s: SparkSession, d: str) -> DataFrame:
    return manuscript.atomicity(_TXT.df(s))


_MARKS = Relation("doc_id string, kind string, name string", [("d1", "claim", "C1"), ("d1", "claim", "C1"), ("d1", "unclosed", "C2"), ("d2", "claim", "C7"), ("d2", "unopened", "C3"), ("d2", "section", "x")])
_ACTIVE = Relation("claim_id string, lifecycle_state string", [("C1", "active"), (" C2", None), ("C3", "retired"), ("C4", " Active ")])


@query("span_audit", """WITH a AS (SELECT DISTINCT trim(claim_id) AS n FROM c WHERE lower(trim(coalesce(lifecycle_state, ''))) IN ('', 'active')), h AS (SELECT doc_id, name FROM m WHERE kind = 'claim')
  SELECT DISTINCT 'error' AS severity, 'marker' AS rule, doc_id AS entity_id, kind || ' ' || name AS message FROM m WHERE kind IN ('unclosed', 'unopened') UNION SELECT 'error', 'unknown_claim', doc_id, name FROM h WHERE name NOT IN (SELECT n FROM a) UNION SELECT 'error', 'no_span', n, 'an active claim has no span' FROM a WHERE n NOT IN (SELECT name FROM h)
  UNION SELECT 'warning', 'several_spans', doc_id, name FROM h GROUP BY ALL HAVING count(*) > 1""", m=_MARKS, c=_ACTIVE)
def span_audit(s: SparkSession, d: str) -> DataFrame:
    return manuscript.span_audit(_MARKS.df(s), _ACTIVE.df(s))


# ---- scalar functions over whole ledgers

@query("record_functions", r"""SELECT DISTINCT record_id, coalesce(nullif(trim(coalesce(pmcid, '')), ''), nullif(trim(coalesce(arxiv_id, '')), ''), nullif(trim(coalesce(url, '')), ''), '') AS first_filled, 'S' || substr(sha1(lower(trim(coalesce(title, ''))) || '|' || trim(coalesce(year, ''))), 1, 12) AS study_id,
  trim(regexp_replace(regexp_replace(lower(trim(coalesce(venue, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug, CASE WHEN length(title) > 20 THEN rtrim(substr(title, 1, 19)) || '…' ELSE title END AS short, list_filter(list_transform(regexp_split_to_array(coalesce(authors, ''), '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS authors,
  list_transform(regexp_extract_all(coalesce(retrieved_at, ''), '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS numbers FROM records""")
def record_functions(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "records").select("record_id", L.first_filled(c("pmcid"), c("arxiv_id"), c("url")).alias("first_filled"), L.stable_id("S", F.concat_ws("|", F.lower(norm("title")), norm("year"))).alias("study_id"), L.slug(c("venue")).alias("slug"), L.short(c("title"), 20).alias("short"), L.split_tokens(c("authors")).alias("authors"), L.version_tuple(c("retrieved_at")).alias("numbers")).distinct()


@query("residual_json", """SELECT DISTINCT record_id, '{' || array_to_string(list_filter([CASE WHEN trim(coalesce(pmcid, '')) <> '' THEN '"pmcid":' || to_json(pmcid)::VARCHAR END, CASE WHEN trim(coalesce(pmid, '')) <> '' THEN '"pmid":' || to_json(pmid)::VARCHAR END, CASE WHEN trim(coalesce(year, '')) <> '' THEN '"year":' || to_json(year)::VARCHAR END], lambda x: x IS NOT NULL), ',') || '}' AS extra_json FROM records""")
def residual_json(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "records").select("record_id", L.extra_json(["year", "pmid", "pmcid"]).alias("extra_json")).distinct()


@query("prose_words", r"""WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^#{1,6}[\t\n\f\r ]+', '', 'g'), '[*_]{1,3}', '', 'g') AS p FROM t)
  SELECT doc_id, CAST(len(regexp_extract_all(p, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS INTEGER) AS words FROM a""")
def prose_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", L.word_count(F.col("text")).alias("words"))


@query("interval_relations", """SELECT DISTINCT analysis_id, analysis_item_id, CASE WHEN ci_low IS NULL OR ci_high IS NULL THEN 'unknown' WHEN ci_low > 0 THEN 'above' WHEN ci_high < 0 THEN 'below' ELSE 'includes' END AS relation FROM results WHERE NOT coalesce(isnan(ci_low) OR isnan(ci_high), false)""")
def interval_relations(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "results").where(~F.coalesce(F.isnan("ci_low") | F.isnan("ci_high"), F.lit(False)))
    return r.select("analysis_id", "analysis_item_id", L.null_relation(F.col("ci_low"), F.col("ci_high")).alias("relation")).distinct()


@query("verification_coverage", """WITH v AS (SELECT trim(coalesce(source_id, '')) AS source, count(*) AS t, count(*) FILTER (lower(trim(verification)) = 'verified') AS a, count(*) FILTER (lower(trim(verification)) = 'partial') AS b FROM evidence GROUP BY 1) SELECT source, CASE WHEN t = 0 THEN 'none' WHEN a = t THEN 'verified' WHEN a + b > 0 THEN 'partial' ELSE 'unverified' END AS coverage FROM v""")
def verification_coverage(s: SparkSession, d: str) -> DataFrame:
    v = F.lower(norm("verification"))
    g = table(s, d, "evidence").groupBy(norm("source_id").alias("source")).agg(F.count(F.lit(1)).alias("t"), F.count(F.when(v == "verified", 1)).alias("a"), F.count(F.when(v == "partial", 1)).alias("b"))
    return g.select("source", L.verification_coverage(F.col("t"), F.col("a"), F.col("b")).alias("coverage"))


_NUMS = Relation("t string", [("1",), (" 2.50 ",), ("-3e2",), ("1,000",), ("inf",), ("-Infinity",), ("",), (None,), ("12kg",), (".5",), ("7.",)])


@query("number_casts", r"""WITH x AS (SELECT t, CASE WHEN regexp_matches(trim(t), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') OR regexp_matches(lower(trim(t)), '^[+-]?inf(inity)?$') THEN CAST(lower(trim(t)) AS DOUBLE) END AS n FROM v) SELECT t, n AS number, CASE WHEN isfinite(n) AND n = floor(n) THEN CAST(n AS BIGINT) END AS integer FROM x""", v=_NUMS)
def number_casts(s: SparkSession, d: str) -> DataFrame:
    return _NUMS.df(s).select("t", typed.number(F.col("t")).alias("number"), typed.integer(F.col("t")).alias("integer"))


_MIXED = Relation("id bigint, j string", [(1, "true"), (2, "1"), (3, '"1"'), (4, "1.0"), (5, '"true"'), (6, "null"), (7, "false"), (8, "2.5"), (9, '"x"'), (10, None)])


@query("typed_keys", """WITH k AS (SELECT id, CASE WHEN j IS NULL OR j = 'null' THEN 'missing|' WHEN j IN ('true', 'false') THEN 'bool|' || j WHEN starts_with(j, '"') THEN 'str|' || trim(j, '"') ELSE 'num|' || CASE WHEN CAST(j AS DOUBLE) = floor(CAST(j AS DOUBLE)) THEN CAST(CAST(CAST(j AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE j END END AS key FROM t),
  s AS (SELECT *, split_part(key, '|', 2) AS shown FROM k) SELECT id, key, key = 'num|1' AS equals_one, CASE WHEN count(*) OVER (PARTITION BY shown) > 1 THEN shown || ' [' || split_part(key, '|', 1) || ']' ELSE shown END AS label FROM s""", t=_MIXED)
def typed_keys(s: SparkSession, d: str) -> DataFrame:
    k = _MIXED.df(s).select("id", typed.variant_key(F.try_parse_json("j")).alias("key"))
    return k.select("id", "key", typed.key_equals(F.col("key"), "num|1").alias("equals_one"), typed.display_label(F.col("key")).alias("label"))


@query("norm_titles", r"SELECT DISTINCT record_id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM records WHERE coalesce(regexp_full_match(title, '[\x00-\x7f]*'), true)")
def norm_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "records").where(F.coalesce(F.col("title").rlike(r"^[\x00-\x7f]*$"), F.lit(True))).select("record_id", L.norm_title(F.col("title")).alias("title")).distinct()


# ---- tables: contracts, filters, groups

@query("columns_contract", "SELECT * FROM (VALUES ('p_missing', 'missing'), ('p_name', 'extra'), ('p_brand', 'extra'), ('p_type', 'extra'), ('p_size', 'extra'), ('p_retailprice', 'extra')) t(\"column\", state)")
def columns_contract(s: SparkSession, d: str) -> DataFrame:
    return findings.columns_contract(table(s, d, "part"), ["p_partkey", "p_missing"])


@query("migrate_columns", "SELECT n_nationkey, n_name, n_regionkey, '' AS code, '' AS note FROM nation")
def migrate_columns(s: SparkSession, d: str) -> DataFrame:
    return findings.migrate_columns(table(s, d, "nation"), ["n_name", "code", "note"])


_FILTERS = [("ne", "l_returnflag", "N"), ("not_in", "l_linestatus", ["F"]), ("lt", "l_quantity", 5.0), ("le", "l_quantity", 5.0), ("ge", "l_discount", 0.08), ("isna", "l_shipdate", None), ("notna", "l_shipdate", None), ("eq", "l_returnflag", "R"), ("gt", "l_tax", 0.05), ("in", "l_returnflag", ["A", "R"])]


@query("filter_operators", " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) FILTER ({c}) AS n FROM lineitem" for op, c in (("ne", "l_returnflag IS DISTINCT FROM 'N'"), ("not_in", "NOT coalesce(l_linestatus IN ('F'), false)"), ("lt", "l_quantity < 5"), ("le", "l_quantity <= 5"), ("ge", "l_discount >= 0.08"), ("isna", "l_shipdate IS NULL"), ("notna", "l_shipdate IS NOT NULL"), ("eq", "l_returnflag = 'R'"), ("gt", "l_tax > 0.05"), ("in", "l_returnflag IN ('A', 'R')"))))
def filter_operators(s: SparkSession, d: str) -> DataFrame:
    one = table(s, d, "lineitem").agg(*[F.count(F.when(clean.sensitivity_mask(c, op, v), 1)).alias(op) for op, c, v in _FILTERS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"`{op}`").alias("n")) for op, _, _ in _FILTERS])).alias("r")).select("r.*")


@query("model_cohort", "SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND user_id IS NOT NULL GROUP BY 1")
def model_cohort(s: SparkSession, d: str) -> DataFrame:
    return stats.model_cohort(table(s, d, "events"), ["value", "user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("median_deltas", """WITH q AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS m FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT a.user_id, round(b.m - a.m, 6) AS delta FROM q a JOIN q b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def median_deltas(s: SparkSession, d: str) -> DataFrame:
    q = quantiles(table(s, d, "events").where("value is not null"), ["user_id", "event_type"], "value", {"m": 0.5}, Scratch(s, "deltas"))
    side = lambda t, n: q.where(F.col("event_type") == t).select("user_id", F.col("m").alias(n))
    return side("view", "a").join(side("click", "b"), "user_id").select("user_id", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


# must-fail inputs: the item's problem, and results that are null
_ARMS = Relation("g string, y double, r string, c string", [("a", 1.0, "x", "p"), ("a", 2.0, "x", "q"), ("b", 3.0, "x", "p"), ("b", 5.0, "x", "p"), ("c", 4.0, "x", "q"), ("c", 4.0, "x", "q"), ("e", 9.0, None, "p")])


@query("refused_items", """SELECT * FROM (VALUES ('anova without a level', 'level d has fewer than two values'), ('anova without variance', 'level c has no variance'), ('contrast without a level', 'level d has fewer than two values'), ('chi square of one row', 'fewer than two levels'), ('fisher of an absent level', 'level z is absent'), ('fisher of one row', 'not a 2 x 2 table')) t(item, problem)""")
def refused_items(s: SparkSession, d: str) -> DataFrame:
    t = _ARMS.df(s)
    items = {"anova without a level": stats.welch_anova(t, "g", "y", ["a", "b", "d"]), "anova without variance": stats.welch_anova(t, "g", "y", ["a", "b", "c"]), "contrast without a level": stats.welch_contrast(t, "g", "y", {"a": 1.0, "d": -1.0}), "chi square of one row": stats.chi_square(t, "r", "c"), "fisher of an absent level": stats.fisher(t, "g", "c", ["a", "z"], ["p", "q"]), "fisher of one row": stats.fisher(t, "r", "c")}
    out = [df.select(F.lit(n).alias("item"), "problem") for n, df in items.items()]
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), out)


# ---- exact distributions of rank tests: all orders counted

_RANKS = Relation("g string, y double", [("a", 1.0), ("a", 4.0), ("a", 7.5), ("b", 2.0), ("b", 8.0), ("b", 9.0), ("b", 10.0)])


@query("exact_mann_whitney", """WITH RECURSIVE n AS (SELECT y, row_number() OVER (ORDER BY y) AS k, g FROM t), pick AS (SELECT 0 AS k, 0 AS taken, 0 AS s UNION ALL SELECT p.k + 1, p.taken + i, p.s + i * (p.k + 1) FROM pick p, (SELECT unnest([0, 1]) AS i) WHERE p.k < (SELECT count(*) FROM n)),
  u AS (SELECT s - 10 AS u FROM pick WHERE k = (SELECT count(*) FROM n) AND taken = 4), o AS (SELECT sum(k) - 10 AS u FROM n WHERE g = 'b')
  SELECT CAST((SELECT u FROM o) AS DOUBLE) AS u, round(least(1.0, 2.0 * (SELECT count(*) FROM u WHERE u.u >= greatest((SELECT u FROM o), 12 - (SELECT u FROM o))) / (SELECT count(*) FROM u)), 10)::DOUBLE AS p_value""", t=_RANKS)
def exact_mann_whitney(s: SparkSession, d: str) -> DataFrame:
    from auditloom.plans import analysis

    r = analysis.run(_RANKS.df(s), {"analyses": [{"id": "m", "type": "mann_whitney", "group": "g", "outcome": "y", "level_a": "a", "level_b": "b"}]})
    return r.where("method = 'exact'").select(F.col("estimate").alias("u"), F.round("p_value", 10).alias("p_value"))


# ---- power: known sample sizes of textbook cases, one-sided plans in either spelling

_PLANS = Relation("planning_id string, plan_version string, payload string", [
    ("two-sided", "1", '{"alpha": 0.05, "target_power": 0.8, "planning_items": [{"planning_item_id": "i", "type": "welch_two_group_mean", "solve_for": "sample_size", "mean_difference": 5, "sd_a": 10, "sd_b": 10}]}'),
    ("larger", "1", '{"planning_items": [{"planning_item_id": "i", "type": "welch_two_group_mean", "solve_for": "sample_size", "alternative": "larger", "mean_difference": 5, "sd_a": 10, "sd_b": 10}]}'),
    ("smaller", "1", '{"planning_items": [{"planning_item_id": "i", "type": "welch_two_group_mean", "solve_for": "sample_size", "alternative": "smaller", "mean_difference": -5, "sd_a": 10, "sd_b": 10}]}'),
    ("no alpha", "1", '{"alpha": 0, "planning_items": [{"planning_item_id": "i", "type": "paired_mean", "solve_for": "sample_size", "mean_difference": 5, "sd_difference": 10}]}'),
    ("paired", "1", '{"planning_items": [{"planning_item_id": "i", "type": "paired_mean", "solve_for": "sample_size", "mean_difference": 5, "sd_difference": 10, "attrition_rate": 0.1}]}'),
    ("unread", "1", "{"),
])


@query("power_cases", """SELECT planning_id, CAST(n AS BIGINT) AS n, CAST(inflated AS BIGINT) AS inflated, refused FROM (VALUES ('two-sided', 64, 64, false), ('larger', 51, 51, false), ('smaller', 51, 51, false), ('no alpha', NULL, NULL, true), ('paired', 34, 38, false)) t(planning_id, n, inflated, refused)""")
def power_cases(s: SparkSession, d: str) -> DataFrame:
    return power.plan_power(_PLANS.df(s)).select("planning_id", "n", "inflated", F.col("problem").isNotNull().alias("refused"))


# ---- sources and sinks: written, read again

def _round(s: SparkSession, d: str, suffix: str) -> tuple[DataFrame, str]:
    """The nations with what a format may lose, and a path."""
    t = table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).when(F.col("n_nationkey") % 5 == 1, F.concat("n_name", F.lit(', "x"'))).otherwise(F.col("n_name")).alias("n_name"), F.when(F.col("n_nationkey") % 3 == 0, float("nan")).otherwise(F.col("n_regionkey") + 0.5).alias("v"))
    return t, f"{Scratch(s, 'sink').base}/out{suffix}"


_NAMES = "n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN n_name || ', \"x\"' ELSE n_name END AS n_name"


@query("parquet_round_trip", f"SELECT {_NAMES}, CASE WHEN n_nationkey % 3 = 0 THEN 'nan'::DOUBLE ELSE n_regionkey + 0.5 END::DOUBLE AS v FROM nation")
def parquet_round_trip(s: SparkSession, d: str) -> DataFrame:
    t, path = _round(s, d, ".parquet")
    sinks.write_verified(t, path)
    return readers.read_table(s, path)


@query("text_table_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN n_name || ', \"x\"' ELSE n_name END AS n_name, '' AS missing FROM nation")
def text_table_round_trip(s: SparkSession, d: str) -> DataFrame:
    t, path = _round(s, d, ".csv")
    sinks.project_text(t, ["n_nationkey", "n_name", "missing"]).write.option("escape", '"').csv(path, header=True)
    return readers.read_text_table(s, path)


@query("jsonl_round_trip", f"SELECT {_NAMES}, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey + 0.5 END::DOUBLE AS v FROM nation")
def jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    t, path = _round(s, d, ".jsonl")
    sinks.write_table(t, path)
    return readers.read_jsonl(s, path, "n_nationkey int, n_name string, v double").select("n_nationkey", "n_name", "v")


@query("typed_jsonl", f"SELECT {_NAMES} FROM nation")
def typed_jsonl(s: SparkSession, d: str) -> DataFrame:
    t, path = _round(s, d, ".jsonl")
    sinks.write_table(t.select("n_nationkey", "n_name"), path)
    v = readers.read_table(s, path)
    return v.select(F.variant_get("v", "$.n_nationkey", "int").alias("n_nationkey"), F.variant_get("v", "$.n_name", "string").alias("n_name"))


@query("bad_lines", "SELECT 2 * n_nationkey + 2 AS line, '{\"k\": ' || n_name AS value FROM nation")
def bad_lines(s: SparkSession, d: str) -> DataFrame:
    """Every second line is broken; numbers are those of the file."""
    path = f"{Scratch(s, 'lines').base}/in.jsonl"
    n = table(s, d, "nation").orderBy("n_nationkey").select(F.explode(F.array(F.concat(F.lit('{"k": '), F.col("n_nationkey").cast("string"), F.lit("}")), F.concat(F.lit('{"k": '), F.col("n_name")))).alias("value"))
    n.coalesce(1).write.text(path)
    return readers.bad_lines(s, path).select("line", "value")


@query("lenient_lines", "SELECT n_nationkey AS k FROM nation")
def lenient_lines(s: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(s, 'lines').base}/in.jsonl"
    table(s, d, "nation").select(F.explode(F.array(F.concat(F.lit('{"k": '), F.col("n_nationkey").cast("string"), F.lit("}")), F.lit("[1"), F.lit(" "))).alias("value")).write.text(path)
    return readers.read_jsonl_lenient(s, path, "k int")[0]


@query("append_once", "SELECT n_nationkey, n_regionkey FROM nation")
def append_once(s: SparkSession, d: str) -> DataFrame:
    """Three appends, of half of the rows, of all and of all again, leave each key once."""
    n, path = table(s, d, "nation").select("n_nationkey", "n_regionkey"), f"{Scratch(s, 'append').base}/ledger.parquet"
    for part in (n.where("n_nationkey % 2 = 0"), n.unionByName(n), n):
        sinks.append_once(part, path, ["n_nationkey"])
    return s.read.parquet(path)


@query("json_records", "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation")
def json_records(s: SparkSession, d: str) -> DataFrame:
    """Records that an object holds under its key, from one JSON file."""
    path = f"{Scratch(s, 'records').base}/in.json"
    body = table(s, d, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("k"))).alias("records"))).alias("value"))
    body.coalesce(1).write.text(path)
    return readers.read_records(s, path).select(F.get_json_object("record", "$.k").alias("k"))


@query("file_inventory", "SELECT kind, n FROM (VALUES ('parts', CAST(3 AS BIGINT))) t(kind, n)")
def file_inventory(s: SparkSession, d: str) -> DataFrame:
    """Files below a folder, by kind."""
    root = f"{Scratch(s, 'files').base}/data"
    table(s, d, "nation").repartition(3).write.parquet(root)
    files = readers.list_files(s, root, with_content=True).where("length > 0 and length(sha256) = 64")
    return readers.classify_files(files, {"parts": r"\.parquet$", "tables": r"\.csv$"}).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("graph_lines", """SELECT DISTINCT '  "' || replace(replace(coalesce(trim(source_id), ''), '\\', '\\\\'), '"', '\\"') || '" -> "' || replace(replace(coalesce(trim(target_id), ''), '\\', '\\\\'), '"', '\\"') || '" [label="' || replace(replace(coalesce(relation, ''), '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM citation_trail""".replace("\\\\", "\\"))
def graph_lines(s: SparkSession, d: str) -> DataFrame:
    return sinks.dot_lines(table(s, d, "citation_trail").withColumns({"a": F.trim("source_id"), "b": F.trim("target_id")}), "a", "b", "relation").distinct()


@query("report_lines", "SELECT '| ' || replace(n_name, '|', '\\|') || ' | ' || CAST(n_regionkey AS VARCHAR) || ' | NA |' AS line FROM nation")
def report_lines(s: SparkSession, d: str) -> DataFrame:
    return sinks.markdown_rows(table(s, d, "nation").withColumn("none", F.lit(None).cast("string")), ["n_name", "n_regionkey", "none"])


# ---- spans, pairs of records, unions of files

_SPANS = Relation("doc_id bigint, kind string, name string, start bigint, end bigint", [(1, "paragraph", "", 0, 20), (1, "paragraph", "", 22, 40), (1, "claim", "a", 5, 12), (1, "claim", "b", 10, 30), (1, "claim", "c", 11, 12), (1, "claim", "none", 35, 35), (2, "paragraph", "", 0, 9), (3, "claim", "x", 0, 4), (4, "paragraph", "", 0, 5), (4, "claim", "y", 5, 9), (4, "claim", "z", 0, 2), (4, "claim", "z", 0, 2)])


@query("coverage_of_spans", """WITH c AS (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS i FROM sp WHERE kind = 'claim' AND "end" > "start"), p AS (SELECT DISTINCT doc_id, "start" AS s, "end" AS e FROM sp WHERE kind = 'paragraph')
  SELECT p.doc_id, s AS paragraph_start, e - s AS length, count(c.i) AS covered FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i >= s AND c.i < e GROUP BY ALL""", sp=_SPANS)
def coverage_of_spans(s: SparkSession, d: str) -> DataFrame:
    return spans.coverage(_SPANS.df(s), "doc_id")


_SECTIONS = Relation("doc_id bigint, kind string, name string, start bigint, end bigint", [(1, "section", "Intro", 0, 50), (1, "section", "Methods", 50, 90), (2, "section", "Late", 30, 60)])
_POINTS = Relation("doc_id bigint, name string, start bigint", [(1, "a", 0), (1, "b", 49), (1, "c", 50), (1, "d", 400), (2, "e", 10), (2, "f", 31), (3, "g", 5)])


@query("sections_of_points", """SELECT p.doc_id, p.name, p.start, (SELECT arg_max(s.name, s.start) FROM se s WHERE s.doc_id = p.doc_id AND s.start <= p.start) AS section FROM po p""", se=_SECTIONS, po=_POINTS)
def sections_of_points(s: SparkSession, d: str) -> DataFrame:
    return spans.sections_of(_POINTS.df(s), _SECTIONS.df(s), "doc_id", "start")


@query("linkable_pairs", """WITH r AS (SELECT record_id, lower(trim(coalesce(title, ''))) AS t, trim(coalesce(year, '')) AS y, nullif(trim(doi), '') AS doi, nullif(trim(pmid), '') AS pmid, nullif(trim(pmcid), '') AS pmcid, nullif(trim(arxiv_id), '') AS ax FROM (SELECT DISTINCT record_id, title, year, doi, pmid, pmcid, arxiv_id FROM records)), o AS (SELECT * FROM r WHERE t <> '')
  SELECT DISTINCT a.record_id AS a, b.record_id AS b, coalesce(lower(a.doi) <> lower(b.doi), false) OR coalesce(lower(a.pmid) <> lower(b.pmid), false) OR coalesce(lower(a.pmcid) <> lower(b.pmcid), false) OR coalesce(lower(a.ax) <> lower(b.ax), false) AS conflict,
    a.y = '' OR b.y = '' OR coalesce(abs(TRY_CAST(substr(a.y, 1, 4) AS INTEGER) - TRY_CAST(substr(b.y, 1, 4) AS INTEGER)) <= 1, a.y = b.y) AS fits FROM o a JOIN o b ON a.t = b.t AND a.record_id < b.record_id""")
def linkable_pairs(s: SparkSession, d: str) -> DataFrame:
    """Records of one title: whether identifiers conflict and years fit."""
    r = table(s, d, "records").select("record_id", F.lower(norm("title")).alias("t"), "year", "doi", "pmid", "pmcid", "arxiv_id").distinct().where("t <> ''")
    j = r.alias("x").join(r.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.record_id") < F.col("y.record_id")))
    return j.select(F.col("x.record_id").alias("a"), F.col("y.record_id").alias("b"), linkage.identifiers_conflict("x", "y").alias("conflict"), linkage.years_fit(F.col("x.year"), F.col("y.year")).alias("fits")).distinct()


@query("union_files", "SELECT n_nationkey, n_name, n_regionkey, NULL::INTEGER AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def union_files(s: SparkSession, d: str) -> DataFrame:
    return readers.union_files([table(s, d, "nation"), table(s, d, "region")])


# ---- topics: clusters at a cosine threshold, over whole texts that aren't templates

_TOPICS = Relation("id string, text string", [("a", "neural tumour growth"), ("b", "tumour growth neural imaging"), ("c", "growth imaging tumour"), ("d", "bayesian sampling chains"), ("e", "chains of bayesian sampling"), ("f", "unrelated words here"), ("g", "")])
_TFIDF = """tk AS (SELECT id, unnest(regexp_extract_all(text, '[a-z][a-z0-9_-]{2,}')) AS term FROM tx), f AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term), w0 AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM tx)) / (1 + df)::DOUBLE) + 1) AS r FROM f JOIN df USING (term)),
  w AS (SELECT id, term, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM w0), cp AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS c FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.23)"""


@query("cosine_pairs", f"WITH {_TFIDF} SELECT a, b, round(c, 6) AS cosine FROM cp", tx=_TOPICS)
def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    w = linkage.tfidf(_TOPICS.df(s), "id", F.col("text"))
    return linkage.cosine_pairs(w, "id", 0.23).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("topic_clusters", f"""WITH RECURSIVE {_TFIDF}, l AS (SELECT a AS x, b AS y FROM cp UNION SELECT b, a FROM cp), r AS (SELECT id AS x, id AS y FROM tx WHERE id IN (SELECT id FROM w) UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), g AS (SELECT x AS id, min(y) AS root FROM r GROUP BY x), z AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS k FROM g GROUP BY root)
  SELECT g.id, 'C' || lpad(CAST(k AS VARCHAR), 3, '0') AS cluster_id, (SELECT count(*) FROM cp WHERE cp.a = g.id OR cp.b = g.id) AS links FROM g JOIN z USING (root)""", tx=_TOPICS)
def topic_clusters(s: SparkSession, d: str) -> DataFrame:
    return linkage.threshold_clusters(linkage.tfidf(_TOPICS.df(s), "id", F.col("text")), "id")


@query("cluster_terms", f"""WITH RECURSIVE {_TFIDF}, l AS (SELECT a AS x, b AS y FROM cp UNION SELECT b, a FROM cp), r AS (SELECT id AS x, id AS y FROM tx WHERE id IN (SELECT id FROM w) UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), g AS (SELECT x AS id, min(y) AS root FROM r GROUP BY x), z AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS k FROM g GROUP BY root),
  t AS (SELECT k, term, sum(w) AS s FROM w JOIN g USING (id) JOIN z USING (root) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(s, 9) DESC, term) AS rank FROM t) SELECT 'C' || lpad(CAST(k AS VARCHAR), 3, '0') AS cluster_id, CAST(rank AS INTEGER) AS rank, term, round(s, 6) AS weight FROM o WHERE rank <= 2""", tx=_TOPICS)
def cluster_terms(s: SparkSession, d: str) -> DataFrame:
    w = linkage.tfidf(_TOPICS.df(s), "id", F.col("text"))
    return linkage.cluster_terms(w.withColumn("weight", F.round("weight", 12)), linkage.threshold_clusters(w, "id"), "id", 2).withColumn("weight", F.round("weight", 6))


# ---- similar titles: every pair compared in SQL by its longest common blocks is out of reach, so the cases are told

_TITLES = Relation("record_id string, title string, authors string, year string, venue string, doi string, pmid string, pmcid string, arxiv_id string, source string", [
    ("r1", "Sensitivity of the primary outcome to dropout", None, "2020", None, "10.1/a", None, None, None, "x"), ("r2", "Sensitivity of the primary outcome to drop-out", None, "2021", None, None, "77", None, None, "x"), ("r3", "Sensitivity of the primary outcome to dropout", None, "2024", None, None, None, None, None, "y"),
    ("r4", "Sensitivity of the primary outcome to dropouts", None, "2020", None, "10.1/b", None, None, None, "y"), ("r5", "Another title of more than twenty letters", None, "2020", None, "10.1/A", None, None, None, "z"), ("r6", "Short title", None, "2020", None, None, None, None, None, "z"), ("r7", "short  title!", None, "1999", None, None, None, None, None, "z"),
])


@query("duplicate_groups", "SELECT * FROM (VALUES ('r1', 'r1'), ('r2', 'r1'), ('r3', 'r3'), ('r4', 'r1'), ('r5', 'r1'), ('r6', 'r6'), ('r7', 'r6')) t(record_id, group_id)")
def duplicate_groups(s: SparkSession, d: str) -> DataFrame:
    """r1 and r5 share a DOI; r2 is like r1 and r4, a year apart; r3 is three years off; r4's DOI conflicts with r1's but not with r2; r6 and r7 share the title as their key."""
    return linkage.duplicate_groups(_TITLES.df(s))

