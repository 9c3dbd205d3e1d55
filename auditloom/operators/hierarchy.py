"""Parent-child links to full hierarchies.

Components are found first: each child has one parent, so pointers jump to the root, twice as far each round, and what
never arrives is on or below a circle and goes through general components. Each component's links are then brought together
and traversed depth first, with colours that tell finished nodes from those on the current path, so that circles show as back
edges. Rows leave the walk as it goes, so a task holds a component's links but never its paths. A component of more than
``MAX_NODES`` nodes, whose links no task should hold, is solved by pointer doubling over all its nodes instead, with the same result.

Defined results: of several parents the smallest counts; a self link is a circle; a node on or below a circle
has root '', depth -1, path '', descendants -1 and cyclic 1; nodes without links give no row; null ends are
no links; repeated links count once; a node on or below a circle is nobody's descendant.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.components import connected_components
from auditloom.operators.skew import skew_join
from auditloom.scratch import Scratch

#: Nodes of a component that one task walks: about 60 MB of links.
MAX_NODES = 100_000
#: Rows and characters of paths that leave a walk together.
BATCH_ROWS, BATCH_CHARS = 20_000, 4_000_000
_OUT = "id string, root_id string, depth bigint, path string, descendants bigint, cyclic bigint, back_edge_to string"
_PAIRS = "ancestor string, descendant string, distance bigint"


def _children(parent_of: dict[str, str]) -> dict[str, list[str]]:
    children: dict[str, list[str]] = defaultdict(list)
    for c, p in parent_of.items():
        children[p].append(c)
    return children


def traverse(parent_of: dict[str, str]) -> Iterator[tuple]:
    """Rows of one component, from each child's parent; ``back_edge_to`` closes a circle."""
    children = _children(parent_of)
    nodes = {*parent_of, *children}
    done: set[str] = set()
    for root in sorted(n for n in nodes if n not in parent_of):
        path: list[str] = []
        size: list[int] = []
        stack: list[tuple[str, bool]] = [(root, False)]
        while stack:
            n, leaving = stack.pop()
            if leaving:
                below = size.pop()
                yield n, root, len(path) - 1, "/".join(path), below, 0, None
                path.pop()
                if size:
                    size[-1] += below + 1
                continue
            done.add(n)
            path.append(n)
            size.append(0)
            stack.append((n, True))
            stack += [(c, False) for c in sorted(children.get(n, ()), reverse=True)]
    # what no root reaches is on or below a circle: grey nodes are on the current path
    grey, black = set(), set()
    for start in sorted(nodes - done):
        stack = [(start, False)]
        while stack:
            n, leaving = stack.pop()
            if leaving:
                grey.discard(n)
                black.add(n)
                continue
            if n in black or n in grey:
                continue
            grey.add(n)
            back = next((c for c in sorted(children.get(n, ())) if c in grey), None)
            yield n, "", -1, "", -1, 1, back
            stack.append((n, True))
            stack += [(c, False) for c in sorted(children.get(n, ()), reverse=True) if c not in grey]


def pairs_of(parent_of: dict[str, str]) -> Iterator[tuple]:
    """(ancestor, descendant, distance) of one component's trees."""
    children = _children(parent_of)
    for root in sorted(n for n in children if n not in parent_of):
        path: list[str] = []
        stack: list[tuple[str, bool]] = [(root, False)]
        while stack:
            n, leaving = stack.pop()
            if leaving:
                path.pop()
                continue
            for i, up in enumerate(path):
                yield up, n, len(path) - i
            path.append(n)
            stack.append((n, True))
            stack += [(c, False) for c in children.get(n, ())]


def _walk(rows_of, schema: str, path_at: int | None):
    """The function of an Arrow map over links sorted by component; one component's links are held at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "bigint" else pa.string() for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0

        def told(links: dict[str, str]) -> Iterator[pa.RecordBatch]:
            nonlocal chars
            for r in rows_of(links):
                out.append(r)
                chars += len(r[path_at]) if path_at is not None else 0
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch(out)
                    out.clear()
                    chars = 0

        now, links = None, {}
        for b in batches:
            for comp, child, parent in zip(*[b.column(c).to_pylist() for c in ("component", "child", "parent")]):
                if comp != now:
                    yield from told(links)
                    now, links = comp, {}
                links[child] = parent
        yield from told(links)
        yield batch(out)

    return each


def _closing(ring: DataFrame, n: int, links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, back: the parent of each circle's smallest node, and that node, which the traversal enters first.

    ring(id, anc) has the n nodes on or below circles and a same number of steps up for all. The steps are doubled until no fewer
    nodes are reached: those are on circles. A component has one circle at most, as each node has one parent.
    """
    k, reached = 0, ring.select("anc").distinct().count()
    while reached != n:
        n, k = reached, k + 1
        ring = scratch.write(skew_join(ring, ring.select(F.col("id").alias("anc"), F.col("anc").alias("up")), ["anc"]).select("id", F.col("up").alias("anc")), f"ring{k}")
        reached = ring.select("anc").distinct().count()
        scratch.drop(f"ring{k - 1}")
    on = ring.select(F.col("anc").alias("child")).distinct()
    return links.join(on, "child").groupBy("component").agg(F.min(F.struct("child", "parent")).alias("l")).select(F.col("l.parent").alias("id"), F.col("l.child").alias("back"))


def _doubling(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The same rows for components of any size: after k rounds each node knows its 2^k nearest ancestors."""
    nodes = links.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    s = nodes.join(links.select(F.col("child").alias("id"), F.col("parent").alias("anc")), "id", "left")
    s = scratch.write(s.select("id", "anc", F.when(F.col("anc").isNull(), F.col("id")).alias("root"), F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("id").alias("path"), F.lit(1).cast("long").alias("size")), "d0")
    left, k = None, 0
    while (now := s.where("anc is not null").count()) and now != left:
        left, k = now, k + 1
        up = s.select(F.col("id").alias("anc"), F.col("anc").alias("up"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
        more = s.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))
        nxt = skew_join(s, up, ["anc"], "left").join(more, "id", "left")
        go = F.col("anc").isNotNull()
        nxt = nxt.select("id", F.when(go, F.col("up")).alias("anc"), F.when(go, F.col("up_root")).otherwise(F.col("root")).alias("root"), F.when(go, F.col("depth") + F.col("up_depth")).otherwise(F.col("depth")).alias("depth"), F.when(go, F.concat_ws("/", "up_path", "path")).otherwise(F.col("path")).alias("path"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        s = scratch.write(nxt, f"d{k}")
        scratch.drop(f"d{k - 1}")
    s = s.join(_closing(s.where("anc is not null").select("id", "anc"), now, links, scratch), "id", "left") if now else s.withColumn("back", F.lit(None).cast("string"))
    ok = F.col("anc").isNull()
    pick = lambda a, b: F.when(ok, a).otherwise(F.lit(b))
    return s.select("id", pick(F.col("root"), "").alias("root_id"), pick(F.col("depth"), -1).alias("depth"), pick(F.col("path"), "").alias("path"), pick(F.col("size") - 1, -1).alias("descendants"), pick(F.lit(0), 1).cast("long").alias("cyclic"), F.col("back").alias("back_edge_to"))


def _rooted(one: DataFrame, scratch: Scratch) -> DataFrame:
    """child, parent, component of links with one parent a child: the root's id, or for circles the component's smallest id."""
    up = one.select("child", F.col("parent").alias("anc"), F.lit(False).alias("done"))
    left, k = None, 0
    while True:
        # a pointer that ends at no child has reached the root; skewed pointers are split by the engine at run time
        far = up.select(F.col("child").alias("anc"), F.col("anc").alias("far"), F.col("done").alias("far_done"))
        nxt = up.join(far, "anc", "left").select("child", F.when(~F.col("done") & F.col("far").isNotNull(), F.col("far")).otherwise(F.col("anc")).alias("anc"), (F.col("done") | F.col("far").isNull() | F.col("far_done")).alias("done"))
        nxt, now = scratch.counted(nxt, f"up{k}", ~F.col("done"))
        scratch.drop(f"up{k - 1}")
        up = nxt
        # depths have no gaps: when a round roots nobody, nobody else has a root
        if now == 0 or now == left:
            break
        left, k = now, k + 1
    placed = one.join(up.where("done").select("child", F.col("anc").alias("component")), "child")
    if not now:
        return placed.select("child", "parent", "component")
    ring = scratch.write(one.join(up.where("not done").select("child"), "child", "left_semi"), "ring")
    comp = connected_components(ring, "child", "parent", scratch)
    # a node whose only link is to itself is a component of its own
    return placed.select("child", "parent", "component").unionByName(ring.join(comp.withColumnRenamed("id", "child"), "child", "left").select("child", "parent", F.coalesce("component", "child").alias("component")))


def _placed(links: DataFrame, scratch: Scratch, max_nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """Links with their components, sorted together for a walk; and those of components too large for one, if any."""
    one = scratch.write(links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent")), "links")
    placed = scratch.write(_rooted(one, scratch), "placed")
    large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_nodes).select("component")
    if large.isEmpty():
        return placed.repartition("component").sortWithinPartitions("component", "child"), None
    large = scratch.write(large, "large")
    # one row a component of more than max_nodes links: few rows beside the links
    return placed.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "child"), placed.join(large, "component", "left_semi").select("component", "child", "parent")


def hierarchy(links: DataFrame, scratch: Scratch | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """links(child, parent) -> id, root_id, depth, path, descendants, cyclic, back_edge_to."""
    scratch = scratch or Scratch(links.sparkSession, "hierarchy")
    small, large = _placed(links, scratch, max_nodes)
    out = small.select("component", "child", "parent").mapInArrow(_walk(traverse, _OUT, 3), _OUT)
    return out if large is None else out.unionByName(_doubling(large, scratch))


def descendants(links: DataFrame, scratch: Scratch | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """links(child, parent) -> ancestor, descendant, distance: a row for every node and each of the nodes above it in its tree."""
    scratch = scratch or Scratch(links.sparkSession, "descendants")
    small, large = _placed(links, scratch, max_nodes)
    out = small.select("component", "child", "parent").mapInArrow(_walk(pairs_of, _PAIRS, None), _PAIRS)
    if large is None:
        return out
    # circles have no root: only nodes below a root have pairs
    ok = _doubling(large, scratch).where("cyclic = 0").select(F.col("id").alias("child"))
    tree = scratch.write(large.join(ok, "child", "left_semi").select("child", "parent"), "tree")
    front, k = tree.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).cast("long").alias("distance")), 1
    out, more = out.unionByName(front), 1
    while more:
        k += 1
        step = front.select(F.col("ancestor").alias("child"), "descendant").join(tree, "child").select(F.col("parent").alias("ancestor"), "descendant", F.lit(k).cast("long").alias("distance"))
        front, more = scratch.counted(step, f"front{k}", F.lit(True))
        out = out.unionByName(front)
    return out


def claim_links(claims: DataFrame) -> DataFrame:
    """child, parent: claims under the claims that supersede them, from either side's list; unknown ids are left out."""
    down = claims.select(F.trim("claim_id").alias("parent"), F.explode("supersedes_claim_ids").alias("x")).select(F.trim("x").alias("child"), "parent")
    up = claims.select(F.trim("claim_id").alias("child"), F.explode("superseded_by_claim_ids").alias("x")).select("child", F.trim("x").alias("parent"))
    links = down.unionByName(up).where("child <> '' and parent <> ''").distinct()
    known = claims.select(F.trim("claim_id").alias("id")).distinct()
    # one end of each link is a claim by itself; the other is looked up
    return links.join(known.withColumnRenamed("id", "child"), "child", "left_semi").join(known.withColumnRenamed("id", "parent"), "parent", "left_semi").select("child", "parent")


def claim_hierarchy(claims: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    return hierarchy(claim_links(claims), scratch).withColumnRenamed("id", "claim_id")


def claim_descendants(claims: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    return descendants(claim_links(claims), scratch)
