"""Schemas that drift between files: rescue-column ingestion and the list of changes.

``enforce`` reads the lines of all artifacts in one scan into one table with typed columns. A field outside
the target schema, whose value doesn't fit its type, or that is given as null, is kept as JSON in ``_rescued``;
nothing is lost. ``promote`` turns approved fields into typed columns and replays the rescued values into
them. The change list is read off that table: a field is in a record when its column has a value or
``_rescued`` names it. Fields and types are combined per file before anything is compared; records are
compared only in files where a field went and another came under one parent.

Defined results: an unreadable line (null, blank, broken JSON, no object) gives no row; a repeated
delivery of a file, or a repeated record in a file, gives its rows once; a record without key takes part
in field presence and types but in no comparison of values; lines of one file with the same key and other
content all count: a field is there when any line has it, its types are those of all lines, and a rename needs
the same set of values for each key on either side; an empty table gives empty results;
columns of the input other than the ones named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ordering import with_previous
from auditloom.operators.skew import skew_join
from auditloom.scratch import Scratch

# fixed values: what identifies a record of each artifact
RECORD_KEYS = {"claims": "claim_id", "workspace_state": "project_id", "analysis_plan": "analysis_id"}

TARGETS = {
    "claims": {"claim_id": "string", "section": "string", "claim_type": "string", "text": "string", "evidence_ids": "array<string>", "status": "string", "lifecycle_state": "string", "anchor_precision": "string", "object_refs": "json", "manuscript_anchor": "string", "strength": "string"},
    "workspace_state": {"project_id": "string", "schema_version": "double", "state_id": "string", "skill_version": "string", "mode": "string", "files": "json"},
    "analysis_plan": {"analysis_id": "string", "analysis_plan_schema_version": "string", "plan_version": "string", "profile": "string", "random_seed": "bigint", "input": "json", "analyses": "json"},
}

_KINDS = {str: 1, int: 2, float: 2, bool: 4, list: 8, dict: 16}
#: The JSON type of a column's values; a column of JSON text holds arrays and objects.
_COLUMN_KINDS = {"string": 1, "double": 2, "bigint": 2, "boolean": 4, "array<string>": 8}
_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "json": pa.string()}

#: Fields approved for promotion into the consistent tables.
PROMOTED = {
    "claims": {"anchor_granularity": "string", "Anchor_Precision": "string", "lifecycleState": "string", "x_skill_hint": "string"},
    "workspace_state": {"version": "double", "Schema_Version": "double", "x_skill_hint": "string", "x_locked": "boolean", "review_round": "bigint"},
    "analysis_plan": {"x_skill_hint": "string", "x_locked": "boolean", "manuscript_presence": "string"},
}


def _no_constant(_: str) -> None:
    raise ValueError("not a JSON number")


def parse_object(text: object) -> dict | None:
    """The JSON object in ``text``; None when it can't be read as one."""
    if not isinstance(text, str):
        return None
    try:
        v = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _even(v: object) -> object:
    """Equal numbers get one form: 1.0 is 1."""
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, list):
        return [_even(x) for x in v]
    if isinstance(v, dict):
        return {k: _even(x) for k, x in v.items()}
    return v


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def digests(text: str) -> tuple[int, int]:
    b = text.encode("utf-8", "surrogatepass")
    return _signed(xxhash.xxh64_intdigest(b, 1)), _signed(xxhash.xxh64_intdigest(b, 2))


def _empty(v: object) -> bool:
    return v is None or v in ("", [], {}) or (isinstance(v, list) and all(_empty(x) for x in v))


def _writable(text: str) -> bool:
    """Whether the text has an encoding: half of a surrogate pair has none."""
    try:
        return text.isascii() or bool(text.encode())
    except UnicodeEncodeError:
        return False


def _json(v: object, by_name: bool = False) -> str:
    text = json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=by_name)
    return text if _writable(text) else json.dumps(v, separators=(",", ":"), sort_keys=by_name)


def _name(path: str) -> str:
    return path if _writable(path) else path.encode("utf-8", "backslashreplace").decode()


def field_inventory(record: dict) -> dict[str, list]:
    """path -> [parent, kinds, value]; a path below arrays of objects has the list of its elements' values."""
    out: dict[str, list] = {}

    def enter(obj: dict, parent: str, many: bool) -> None:
        for k, v in obj.items():
            path = f"{parent}.{k}" if parent else k
            at = out.setdefault(path, [parent, 0, [] if many else None])
            at[1] |= _KINDS.get(type(v), 0)
            if many:
                at[2].append(v)
            else:
                at[2] = v
            if isinstance(v, dict):
                enter(v, path, many)
            elif isinstance(v, list):
                for x in v:
                    if isinstance(x, dict):
                        enter(x, f"{path}[]", True)

    enter(record, "", False)
    return out


def _note(obj: dict, parent: str, seen: dict[tuple[str, str], int]) -> None:
    """Adds the JSON types of all fields of ``obj``: seen[parent, path]."""
    for k, v in obj.items():
        path = f"{parent}.{k}" if parent else k
        seen[parent, path] = seen.get((parent, path), 0) | _KINDS.get(type(v), 0)
        if isinstance(v, dict):
            _note(v, path, seen)
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, dict):
                    _note(x, f"{path}[]", seen)


def _cast(v: object, kind: str) -> tuple[bool, object]:
    """Whether ``v`` fits the type, and its column value; what doesn't fit is rescued."""
    if kind == "string":
        return isinstance(v, str) and _writable(v), v
    if kind == "double":
        ok = isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1e308 and float(v) == v
        return ok, float(v) if ok else None
    if kind == "bigint":
        return isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63, v
    if kind == "boolean":
        return isinstance(v, bool), v
    if kind == "array<string>":
        return isinstance(v, list) and all(x is None or isinstance(x, str) and _writable(x) for x in v), v
    if kind == "json":
        ok = isinstance(v, (list, dict))
        return ok, _json(v) if ok else None
    raise ValueError(f"no such type: {kind}")


def _column(artifact: str, field: str) -> str:
    return f"{artifact}__{field}"


def _free(name: str, taken: list[str]) -> str:
    """The name, numbered if another one differs from it by case alone, which columns can't."""
    lower, n = {t.lower() for t in taken if t != name}, name
    k = 1
    while n.lower() in lower:
        k += 1
        n = f"{name}_{k}"
    return n


def enforce(lines: DataFrame, targets: dict[str, dict[str, str]] | None = None, keys: dict[str, str] | None = None, digest: bool = False) -> DataFrame:
    """One scan: stream_id, file_name, exported_at, artifact, record_key, a column ``artifact__field`` for each of the targets' fields, ``_rescued``; with ``digest`` also ``_digest`` of the whole record."""
    targets, keys = targets or TARGETS, keys or RECORD_KEYS
    columns = [(a, f, t) for a, fields in targets.items() for f, t in fields.items()]
    place = {a: {f: (i, t) for i, (b, f, t) in enumerate(columns) if a == b} for a in targets}
    schema = "stream_id string, file_name string, exported_at timestamp, artifact string, record_key string, " + "".join(f"`{_column(a, f)}` {'string' if t == 'json' else t}, " for a, f, t in columns) + "_rescued string, _digest string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, record_keys, rescued, marks = [], [], [], []
            typed: list[list] = [[] for _ in columns]
            artifacts = b.column("artifact").to_pylist()
            for n, text in enumerate(b.column("payload").to_pylist()):
                record = parse_object(text)
                if record is None:
                    continue
                mine, rest, row = place[artifacts[n]], {}, [None] * len(columns)
                for f, v in record.items():
                    at = mine.get(f)
                    ok = False
                    if at is not None and v is not None:
                        ok, value = _cast(v, at[1])
                        if ok:
                            row[at[0]] = value
                    if not ok:
                        rest[f] = v
                k = record.get(keys[artifacts[n]])
                k = None if k is None or isinstance(k, (list, dict)) else k if isinstance(k, str) and _writable(k) else json.dumps(k)
                kept.append(n)
                record_keys.append(k)
                rescued.append(_json(rest, by_name=True) if rest else None)
                if digest:
                    marks.append("/".join(map(str, digests(json.dumps(record, sort_keys=True)))))
                for c, v in zip(typed, row):
                    c.append(v)
            left = b.select(["stream_id", "file_name", "exported_at", "artifact"]).take(pa.array(kept, pa.int64()))
            arrays = [*left.columns, pa.array(record_keys, pa.string()), *[pa.array(c, _ARROW[t]) for c, (_, _, t) in zip(typed, columns)], pa.array(rescued, pa.string()), pa.array(marks if digest else [None] * len(kept), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["stream_id", "file_name", "exported_at", "artifact", "record_key", *[_column(a, f) for a, f, _ in columns], "_rescued", "_digest"])

    mine = lines.where(F.col("artifact").isin(*targets) & F.col("payload").isNotNull()).select("stream_id", "file_name", "exported_at", "artifact", "payload")
    out = mine.mapInArrow(each, schema)
    return out if digest else out.drop("_digest")


def ingest(lines: DataFrame, artifact: str, target: dict[str, str] | None = None, key: str | None = None) -> DataFrame:
    """One artifact's table: stream_id, file_name, exported_at, record_key, the target's columns and ``_rescued``, each record of a file once."""
    target = TARGETS[artifact] if target is None else target
    t = enforce(lines, {artifact: target}, {artifact: key or RECORD_KEYS[artifact]}, digest=True)
    # a delivery that comes again holds the same records in another order: they collapse here
    return t.dropDuplicates(["stream_id", "file_name", "_digest"]).select("stream_id", "file_name", "exported_at", "record_key", *[F.col(_column(artifact, f)).alias(f) for f in target], "_rescued")


_FITS = {"string": ("STRING",), "double": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "bigint": ("BIGINT",), "boolean": ("BOOLEAN",)}


def _replay(table: DataFrame, approved: list[tuple[str | None, str, str, str]]) -> DataFrame:
    """approved: artifact (or None), field, column, type."""
    names = sorted({f for _, f, _, _ in approved})
    if not names:
        return table
    plain = all(f.replace("_", "").isalnum() and f.isascii() for f in names)
    # only a rescued text that names an approved field is parsed
    named = F.col("_rescued").rlike('"(' + "|".join(names) + ')":') if plain else F.col("_rescued").isNotNull()
    v = F.try_parse_json(F.when(named, F.col("_rescued")))
    out = table.withColumn("_m", F.try_variant_get(v, "$", "map<string,variant>"))
    got, done = {}, []
    for a, f, c, kind in approved:
        value = F.element_at("_m", F.lit(f))
        ok = F.coalesce(F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0).isin(*_FITS[kind]), F.lit(False))
        if a is not None:
            ok = (F.col("artifact") == a) & ok
        one = F.when(F.col("_m").isNotNull(), F.when(ok, F.try_variant_get(value, "$", kind)))
        got[c] = F.coalesce(F.col(f"`{c}`"), one) if c in table.columns else one
        done.append(F.when(ok, F.lit(f)))
    out = out.withColumns(got | {"_done": F.when(F.col("_m").isNotNull(), F.array_compact(F.array(*done)))})
    left = F.map_filter("_m", lambda k, v: ~F.array_contains("_done", k))
    return out.withColumn("_rescued", F.when(F.coalesce(F.size("_done"), F.lit(0)) <= 0, F.col("_rescued")).otherwise(F.when(F.size(left) > 0, F.to_json(left)))).drop("_m", "_done")


def promote(table: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Approved fields become columns: rescued values that fit are replayed and leave ``_rescued``.

    Types: string, double, bigint, boolean. Values of another JSON type stay rescued. A column that
    is there already keeps its values and takes what was rescued beside them; one that differs from it by letter case
    alone is another field and gets a number.
    """
    columns: dict[str, str] = {}
    for f in fields:
        columns[f] = _free(f, [*table.columns, *columns.values()])
    return _replay(table, [(None, f, columns[f], kind) for f, kind in fields.items()])


def consistent(lines: DataFrame, targets: dict[str, dict[str, str]] | None = None, promoted: dict[str, dict[str, str]] | None = None) -> tuple[DataFrame, dict[str, tuple[str, str, str]]]:
    """All artifacts' lines enforced, approved fields promoted and replayed; and each column's artifact, field and type."""
    targets, promoted = targets or TARGETS, PROMOTED if promoted is None else promoted
    columns = {_column(a, f): (a, f, kind) for a, fields in targets.items() for f, kind in fields.items()}
    approved = []
    for a, fields in promoted.items():
        for f, kind in fields.items():
            c = _free(_column(a, f), [*columns])
            columns.setdefault(c, (a, f, kind))
            approved.append((a, f, c, kind))
    return _replay(enforce(lines, targets), approved), columns


def _files(lines: DataFrame, scratch: Scratch) -> DataFrame:
    files = lines.where(F.col("file_name").isNotNull()).groupBy("stream_id", "file_name").agg(F.min("exported_at").alias("exported_at"))
    return with_previous(files, ["stream_id"], ["exported_at", "file_name"], "file_name", scratch, "files", "old_file").select("stream_id", "file_name", "old_file")


def _ancestors(path: Column) -> Column:
    """Every text before a dot or bracket of the path."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.when(F.substring(path, i + 1, F.lit(1)).isin(".", "["), F.substring(path, F.lit(1), i))), lambda x: x.isNotNull())


#: A task gives away what it noted about its files when that many fields have come together.
_NOTED = 200_000


def file_fields(table: DataFrame, columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """stream_id, file_name, path, plen (length of the parent path at its head), kinds (bits of the JSON types): the fields of each file.

    A typed scalar column is a bit of one number a record; only columns of JSON text and ``_rescued`` are parsed.
    Each task combines its records' notes per file.
    """
    scalar = [(c, f, _COLUMN_KINDS[t]) for c, (_, f, t) in columns.items() if t != "json"]
    deep = [(c, f) for c, (_, f, t) in columns.items() if t == "json"]
    words = [scalar[i : i + 60] for i in range(0, len(scalar), 60)]
    mask = [sum((F.when(F.col(f"`{c}`").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (c, _, _) in enumerate(w)), F.lit(0).cast("bigint")).alias(f"_w{n}") for n, w in enumerate(words)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noted: dict[tuple, dict] = {}
        typed: dict[tuple, list[int]] = {}

        def told() -> pa.RecordBatch:
            for key, bits in typed.items():
                seen = noted.setdefault(key, {})
                for w, have in zip(words, bits):
                    for i, (_, f, kind) in enumerate(w):
                        if have >> i & 1:
                            seen["", f] = seen.get(("", f), 0) | kind
            out = [(s, n, _name(path), len(_name(parent)), kinds) for (s, n), seen in noted.items() for (parent, path), kinds in seen.items()]
            noted.clear()
            typed.clear()
            cols = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["stream_id", "file_name", "path", "plen", "kinds"])

        for b in batches:
            names = list(zip(b.column("stream_id").to_pylist(), b.column("file_name").to_pylist()))
            for n in range(len(words)):
                for key, bits in zip(names, b.column(f"_w{n}").to_pylist()):
                    typed.setdefault(key, [0] * len(words))[n] |= bits
            for c, f in deep:
                texts = b.column(c)
                if texts.null_count < len(texts):
                    for key, text in zip(names, texts.to_pylist()):
                        if text is not None:
                            _note({f: json.loads(text)}, "", noted.setdefault(key, {}))
            for key, text in zip(names, b.column("_rescued").to_pylist()):
                if text is not None:
                    _note(json.loads(text), "", noted.setdefault(key, {}))
            if sum(map(len, noted.values())) > _NOTED:
                yield told()
        yield told()

    slim = table.select("stream_id", "file_name", *mask, *[F.col(f"`{c}`") for c, _ in deep], "_rescued")
    notes = slim.mapInArrow(each, "stream_id string, file_name string, path string, plen int, kinds int")
    return notes.groupBy("stream_id", "file_name", "path", "plen").agg(F.bit_or("kinds").alias("kinds"))


def wanted_values(table: DataFrame, columns: dict[str, tuple[str, str, str]], wanted: DataFrame) -> DataFrame:
    """stream_id, pair, side, k, path, h, filled: digests of the wanted fields' values, and for every record of a wanted file a row with path ''.

    wanted(stream_id, file_name, wanted: array of pair, side, paths): one row a file, as long as a file has fields.
    """
    typed = [(c, f, t) for c, (_, f, t) in columns.items()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple] = set()
            cols = [(f, t, b.column(c).to_pylist()) for c, f, t in typed if b.column(c).null_count < b.num_rows]
            for n, (stream, k, rescued, asked) in enumerate(zip(*[b.column(c).to_pylist() for c in ("stream_id", "record_key", "_rescued", "wanted")])):
                record = {f: json.loads(v[n]) if t == "json" else v[n] for f, t, v in cols if v[n] is not None}
                if rescued is not None:
                    record |= json.loads(rescued)
                fields = {_name(p): x for p, x in field_inventory(record).items()}
                for w in asked:
                    out.add((stream, w["pair"], w["side"], k, "", None, False))
                    for path in w["paths"]:
                        if path in fields:
                            v = fields[path][2]
                            blank = v is None or (isinstance(v, list) and all(x is None for x in v) and "[]" in path)
                            if not blank:
                                out.add((stream, w["pair"], w["side"], k, path, digests(json.dumps(_even(v), sort_keys=True))[0], not _empty(v)))
            cols = list(zip(*out)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["stream_id", "pair", "side", "k", "path", "h", "filled"])

    # a file may hold a third of all rows: its rows meet its one row of wanted fields without a shuffle
    held = skew_join(table.where("record_key is not null"), wanted, ["stream_id", "file_name"])
    return held.select("stream_id", "record_key", *[F.col(f"`{c}`") for c, _, _ in typed], "_rescued", "wanted").mapInArrow(each, "stream_id string, pair string, side int, k string, path string, h bigint, filled boolean")


def changes(table: DataFrame, columns: dict[str, tuple[str, str, str]], lines: DataFrame, scratch: Scratch) -> DataFrame:
    """stream_id, file_name, field, old_field, change: each file of a stream against the one before it."""
    files = scratch.write(_files(lines, scratch), "pairs").where(F.col("old_file").isNotNull())
    fields = scratch.write(file_fields(table, columns), "fields")
    # each file's fields serve twice: in the file as the later one, and as the earlier one of the next file
    new = fields.join(files.select("stream_id", "file_name"), ["stream_id", "file_name"], "left_semi").select("stream_id", "file_name", "path", "plen", F.lit(1).alias("side"), "kinds")
    old = fields.join(files.select("stream_id", F.col("old_file"), F.col("file_name").alias("pair")), (fields.stream_id == files.stream_id) & (F.col("file_name") == F.col("old_file"))).select(fields.stream_id, F.col("pair").alias("file_name"), "path", "plen", F.lit(0).alias("side"), "kinds")
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("kinds")))
    state = new.unionByName(old).groupBy("stream_id", "file_name", "path", "plen").agg(of(1).alias("new"), of(0).alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when((F.col("new") != 0) & (F.col("old") != 0) & (F.col("new") != F.col("old")), "type_changed")
    changed = scratch.write(state.select("stream_id", "file_name", "path", F.substring("path", F.lit(1), F.col("plen")).alias("parent"), change.alias("change")).where(F.col("change").isNotNull()), "changed")

    # a rename is possible where a field went and one came under the same parent
    is_a = lambda what: F.col("change") == what
    moved = changed.where(is_a("added") | is_a("removed"))
    both = moved.groupBy("stream_id", "file_name", "parent").agg(F.max(is_a("added")).alias("a"), F.max(is_a("removed")).alias("r")).where("a and r").select("stream_id", "file_name", "parent")
    asked = moved.join(both, ["stream_id", "file_name", "parent"], "left_semi").groupBy("stream_id", "file_name").agg(F.collect_list(F.when(is_a("added"), F.col("path"))).alias("came"), F.collect_list(F.when(is_a("removed"), F.col("path"))).alias("went")).join(files, ["stream_id", "file_name"])
    entry = lambda side, paths: F.struct(F.col("file_name").alias("pair"), F.lit(side).alias("side"), F.col(paths).alias("paths"))
    per = asked.select("stream_id", F.explode(F.array(F.struct(F.col("file_name").alias("at"), entry(1, "came").alias("w")), F.struct(F.col("old_file").alias("at"), entry(0, "went").alias("w")))).alias("e"))
    # a file is the later one of one pair and the earlier one of another, so its list has two entries at most
    wanted = scratch.write(per.groupBy("stream_id", F.col("e.at").alias("file_name")).agg(F.collect_list("e.w").alias("wanted")), "wanted")
    values = scratch.write(wanted_values(table, columns, wanted).groupBy("stream_id", "pair", "side", "k", "path", "h").agg(F.max("filled").alias("filled")), "values")
    common = values.where("path = ''").groupBy("stream_id", "pair", "k").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")
    told = values.where("path <> ''").join(common, ["stream_id", "pair", "k"], "left_semi")
    folded = told.groupBy("stream_id", "pair", "side", "path").agg(F.bit_xor(F.xxhash64("h", "k")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), "h", "k")).alias("x2"), F.count(F.lit(1)).alias("n"), F.max("filled").alias("filled")).where("filled")

    on = ["stream_id", "file_name", "parent", "x1", "x2", "n"]
    sig = folded.select("stream_id", F.col("pair").alias("file_name"), "side", "path", "x1", "x2", "n").join(moved, ["stream_id", "file_name", "path"])
    # equal digests over the same records: fields that are each other's only partner
    side = lambda n: F.col("side") == n
    partners = sig.groupBy(*on).agg(F.count(F.when(side(1), 1)).alias("m1"), F.count(F.when(side(0), 1)).alias("m0"), F.min(F.when(side(1), F.col("path"))).alias("field"), F.min(F.when(side(0), F.col("path"))).alias("old_field")).where("m1 = 1 and m0 = 1")
    renamed = scratch.write(partners.select("stream_id", "file_name", "field", "old_field"), "renamed")

    gone = renamed.select("stream_id", "file_name", F.explode(F.array("field", "old_field")).alias("path"))
    single = changed.join(gone, ["stream_id", "file_name", "path"], "left_anti").select("stream_id", "file_name", F.col("path").alias("field"), F.lit("").alias("old_field"), "change")
    cases = single.unionByName(renamed.withColumn("change", F.lit("renamed")))
    # what lies below a changed path isn't told
    above = changed.select("stream_id", "file_name", F.col("path").alias("above"))
    ups = cases.select("*", F.explode_outer(_ancestors(F.col("field"))).alias("above"))
    hidden = ups.join(above, ["stream_id", "file_name", "above"], "left_semi").select("stream_id", "file_name", "field").distinct()
    return cases.join(hidden, ["stream_id", "file_name", "field"], "left_anti").select("stream_id", "file_name", "field", "old_field", "change")


def drift(lines: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The changes of every artifact's files, read off the consistent table."""
    scratch = scratch or Scratch(lines.sparkSession, "drift")
    table, columns = consistent(lines)
    return changes(scratch.write(table, "records"), columns, lines, scratch)
