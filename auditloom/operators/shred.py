"""Deeply nested records as related flat tables, by shared inlining.

An element is a key that holds an object or an array of objects. The element graph is read off the
data (or a Spark schema). An element gets its own table when it is the root, is repeated, has more
than one parent element (shared) or can contain itself (recursive); every other element is inlined
into its nearest ancestor's table under a dotted column name. Each row has its own node, its parent's
table and node (the foreign key), the keys of all its ancestors and its position.

Defined results: an unreadable, null or non-object payload gives no rows; positions count from 0 in the
array as delivered, nulls and scalars included; a single object in place of an array is an array of
one; null entries give no row; a text under one of the ``embedded`` keys that holds a JSON object counts as
that object; equal deliveries give equal rows, which the callers' ``distinct`` drops.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.text import JSON_NUMBER_TEXT
from auditloom.operators.drift import parse_object

#: Element names are schema, not data; more than this many edges means that keys hold ids.
MAX_EDGES = 10_000


def _objects(v: object, key: str, embedded: frozenset[str]) -> tuple[bool, list[tuple[int, dict]]]:
    """Whether ``v`` is repeated, and its objects with their positions."""
    if isinstance(v, str) and key in embedded:
        v = parse_object(v)
    if isinstance(v, dict):
        return False, [(0, v)]
    if isinstance(v, list):
        return True, [(i, x) for i, x in enumerate(v) if isinstance(x, dict)]
    return False, []


def element_graph(docs: DataFrame, payload: str, root: str, embedded: frozenset[str] = frozenset()) -> list[tuple[str, str, bool]]:
    """Edges (parent element, child element, repeated) over all documents."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], bool] = {}
        for b in batches:
            for text in b["p"]:
                doc = parse_object(text)
                todo = [(root, doc)] if doc is not None else []
                while todo:
                    parent, obj = todo.pop()
                    for k, v in obj.items():
                        many, inner = _objects(v, k, embedded)
                        if inner:
                            seen[parent, k] = seen.get((parent, k), False) or many
                            todo += [(k, x) for _, x in inner]
        yield pd.DataFrame([(p, c, r) for (p, c), r in seen.items()], columns=["parent", "child", "repeated"])

    edges = docs.select(F.col(payload).alias("p")).mapInPandas(each, "parent string, child string, repeated boolean").groupBy("parent", "child").agg(F.max("repeated").alias("repeated"))
    rows = edges.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError("the documents' keys hold data: they have too many element names for a schema")
    return sorted((r.parent, r.child, r.repeated) for r in rows)


def tables_of(graph: list[tuple[str, str, bool]], root: str) -> set[str]:
    """The elements that get a table; the rest is inlined."""
    parents: dict[str, set[str]] = defaultdict(set)
    children: dict[str, set[str]] = defaultdict(set)
    for p, c, _ in graph:
        parents[c].add(p)
        children[p].add(c)

    def below(name: str) -> set[str]:
        seen: set[str] = set()
        todo = list(children[name])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += children[x]
        return seen

    return {root} | {c for _, c, many in graph if many} | {c for c, ps in parents.items() if len(ps) > 1} | {c for c in parents if c in below(c)}


def shred(docs: DataFrame, payload: str, carry: list[str], root: str, keys: dict[str, str], embedded: frozenset[str] = frozenset(), graph: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """Rows of all tables: ``carry``, element, node, parent_element, parent_node, pos, parent_keys, columns.

    ``columns`` has the JSON text of each scalar (and of arrays of scalars) by its dotted name below the
    element; ``keys`` names the key column of an element, which its descendants get in ``parent_keys``.
    """
    graph = element_graph(docs, payload, root, embedded) if graph is None else graph
    own = tables_of(graph, root)
    known = {(p, c) for p, c, _ in graph}
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema.fields) + "element string, node string, parent_element string, parent_node string, pos bigint, parent_keys map<string,string>, columns map<string,string>"

    def rows_of(doc: dict) -> Iterator[tuple]:
        todo = [(root, "$", None, None, 0, {}, doc)]
        while todo:
            element, node, up, up_node, pos, above, obj = todo.pop()
            cols: dict[str, str] = {}
            inner: list[tuple] = []

            def inline(name: str, o: dict, prefix: str, path: str) -> None:
                for k, v in o.items():
                    many, found = _objects(v, k, embedded)
                    if found and (name, k) in known and k in own:
                        inner.extend((k, f"{path}.{k}[{i}]", i, x) for i, x in found)
                    elif found and not many:
                        inline(k, found[0][1], f"{prefix}{k}.", f"{path}.{k}")
                    elif v is not None:
                        cols[prefix + k] = json.dumps(v, ensure_ascii=False)

            inline(element, obj, "", node)
            yield element, node, up, up_node, pos, above, cols
            key = cols.get(keys.get(element, ""))
            mine = above if key is None else above | {element: json.loads(key) if key.startswith('"') else key}
            todo += [(k, n, element, node, i, mine, x) for k, n, i, x in inner]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*carry, "element", "node", "parent_element", "parent_node", "pos", "parent_keys", "columns"]
        for b in batches:
            out = []
            for *left, text in b.itertuples(index=False, name=None):
                doc = parse_object(text)
                if doc is not None:
                    out += [(*left, *r) for r in rows_of(doc)]
            yield pd.DataFrame(out, columns=names)

    return docs.where(F.col(payload).isNotNull()).select(*carry, payload).mapInPandas(each, schema)


def shred_typed(df: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The same for typed columns: structs are inlined, each array becomes a table named by its path.

    Runs in the JVM. A table has ``keys``, the positions of the enclosing arrays (``<array>_pos``), its own
    ``pos`` and its fields; an array of scalars has ``value``. Null entries give no row.
    """
    out: dict[str, DataFrame] = {}

    def scalars(kind: T.StructType, at: str, prefix: str) -> tuple[list[Column], list[tuple[str, str, T.DataType]]]:
        cols, arrays = [], []
        for f in kind.fields:
            ref = f"{at}.`{f.name}`" if at else f"`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                c, a = scalars(f.dataType, ref, f"{prefix}{f.name}.")
                cols += c
                arrays += a
            elif isinstance(f.dataType, T.ArrayType):
                arrays.append((f"{prefix}{f.name}", ref, f.dataType.elementType))
            else:
                cols.append(F.col(ref).alias(f"{prefix}{f.name}"))
        return cols, arrays

    def expand(rows: DataFrame, held: list[str], name: str, ref: str, kind: T.DataType) -> None:
        each = rows.select(*[F.col(f"`{h}`") for h in held], F.posexplode(F.col(ref)).alias("pos", "_e")).where("_e is not null").withColumn("pos", F.col("pos").cast("long"))
        if not isinstance(kind, T.StructType):
            out[name] = each.withColumnRenamed("_e", "value")
            return
        cols, arrays = scalars(kind, "_e", "")
        out[name] = each.select(*[F.col(f"`{h}`") for h in held], "pos", *cols)
        for n, r, k in arrays:
            at = f"{name}_pos"
            expand(each.withColumnRenamed("pos", at), [*held, at], f"{name}.{n}", r, k)

    for n, r, k in scalars(df.schema, "", "")[1]:
        expand(df, keys, n, r, k)
    return out


def is_number(json_text: Column) -> Column:
    """Whether a column's JSON text is a number or the text of one."""
    return F.coalesce(json_text.rlike(JSON_NUMBER_TEXT), F.lit(False))


def with_document_key(docs: DataFrame, payload: str) -> DataFrame:
    """Adds ``doc``, the payload's digest: with it, ``node`` tells rows of all documents apart, also of those that share or lack their ids."""
    return docs.withColumn("doc", F.md5(payload))


def flat_table(rows: DataFrame, element: str, carry: list[str], keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One element's flat table from rows of ``shred``: ``carry``, node, parent_element, parent_node (the foreign key), pos, its ancestors' ``keys`` and typed columns.

    Types: string (an object or array as its JSON), double (also from the text of a number); what doesn't fit is null.
    """
    def typed(c: str, kind: str) -> Column:
        text = F.col("columns")[c]
        if kind == "double":
            return F.when(is_number(text), F.trim(F.regexp_replace(text, '"', "")).try_cast("double")).alias(c)
        return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v").alias(c)

    return rows.where(F.col("element") == element).select(*carry, "node", "parent_element", "parent_node", "pos", *[F.col("parent_keys")[k].alias(f"{k}_key") for k in keys], *[typed(c, k) for c, k in columns.items()])


def orphan_nodes(rows: DataFrame) -> DataFrame:
    """element, rows, orphans: rows of each table below the root, and how many name a parent row (doc, parent_node) that isn't there."""
    below = rows.where("parent_node is not null").select("doc", "element", "parent_element", F.col("parent_node").alias("node"))
    up = rows.select("doc", F.col("element").alias("parent_element"), "node", F.lit(1).alias("_there")).distinct()
    j = below.join(up, ["doc", "parent_element", "node"], "left")
    return j.groupBy("element").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_there").isNull(), 1)).alias("orphans"))


#: The elements that ``nested_parts`` reads, fixed so that no document can change another one's tables.
PLAN_GRAPH = [("plan", "planning_items", True), ("planning_items", "scenarios", True), ("planning_items", "contrast_terms", True), ("scenarios", "overrides", False), ("overrides", "contrast_terms", True)]
_SCENARIO = r"^\$\.planning_items\[\d+\]\.scenarios\[\d+\]$"
TERM_NODE = r"^\$\.planning_items\[\d+\]\.(scenarios\[\d+\]\.overrides\.)?contrast_terms\[\d+\]$"


def nested_parts(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Scenario overrides, contrast terms and companion claims with their parents' keys and positions."""
    rows = shred(plans, "payload", ["planning_id", "plan_version"], "plan", {"planning_items": "planning_item_id", "scenarios": "scenario_id"}, frozenset({"overrides"}), PLAN_GRAPH)
    text = lambda c: F.coalesce(c, F.lit(""))
    key = lambda e: text(F.col("parent_keys")[e])
    scenario = F.get_json_object(F.concat(F.lit('{"v":'), F.col("columns")["scenario_id"], F.lit("}")), "$.v")
    of = lambda kind, sid: rows.select(F.lit(kind).alias("kind"), text(F.col("planning_id")).alias("root_id"), text(F.col("plan_version")).alias("plan_version"), key("planning_items").alias("item_id"), text(sid).alias("scenario_id"), "pos", "element", "columns", "parent_element", "node")
    override = of("override", scenario).where((F.col("element") == "scenarios") & (F.col("parent_element") == "planning_items") & F.col("node").rlike(_SCENARIO) & is_number(F.col("columns")["overrides.mean_difference"]))
    term = of("term", F.col("parent_keys")["scenarios"]).where((F.col("element") == "contrast_terms") & F.col("parent_element").isin("planning_items", "scenarios") & F.col("node").rlike(TERM_NODE) & is_number(F.col("columns")["weight"]))
    names = ["kind", "root_id", "plan_version", "item_id", "scenario_id", "pos"]
    companions = shred_typed(claims.select("claim_id", "required_companions").withColumn("required_companions", F.transform("required_companions", lambda x: F.struct(F.trim(x["claim_id"]).alias("companion_id"), x["scope"].alias("scope")))), ["claim_id"])["required_companions"]
    companion = companions.where("companion_id <> ''").select(F.lit("companion").alias("kind"), text(F.col("claim_id")).alias("root_id"), F.lit("").alias("plan_version"), F.col("companion_id").alias("item_id"), F.lit("").alias("scenario_id"), "pos")
    return override.select(*names).unionByName(term.select(*names)).unionByName(companion).distinct()
