"""Problem 4: parent-child links to full hierarchies, with cycles.

Links that hang below or above all cycles are peeled off first, while a round takes off an eighth or more: from a table
of terms by hashes of their names, which may keep too much but never take off a link of a cycle, so that names are
joined for the rest alone. Then every term takes one of its parents, which makes a forest, or trees that end in a ring.
Each task keeps the weighted disjoint sets of its part of these links: a term knows the top it reaches and its offset
from it. The parts are merged level by level, FAN tasks into one, while a merged part has at most MERGE_ROWS rows, and
whatever then still ends in another part is followed by joins that double their reach. The result gives each term its
root and offset, and every ring is a cycle of terms, which is contracted to one node. Where no ring is left, a link
whose parent isn't above its child by the offsets makes the child take that parent instead, and the forest is built
again. Offsets only grow, so this ends: when each link agrees with the offsets no cycle is left, for the offsets would
have to grow all the way round it. Paths are then followed through an index of finished path ends, doubling their length
each round, so a depth d takes log2(d) joins; descendants double their distance in the same way.

Defined results: the current row of a go_id has its highest tid (ties by the greater parents); a null go_id is no
term; null or empty parents make a root; entries that are null, blank or name no term don't count; repeats count once;
a link to itself is a cycle of one; paths, depths and descendants go through cycles (a cycle is one node of a path);
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import strip
from ..runtime import if_small, materialize, release

#: Rows of a forest that one task may hold when parts are merged (40 bytes each).
MERGE_ROWS = 4_000_000
#: Parts merged into one at each level.
FAN = 8
#: The part of the links that may be left for another round of peeling to follow.
PEEL = 7 / 8
STATE = "node bigint, first bigint, better int, top bigint, off bigint, bound int, part int"


def current_terms(terms: DataFrame) -> DataFrame:
    """(go_id, name, namespace, parents) of the row with the highest tid."""
    rows = terms.where(F.col("go_id").isNotNull())
    top = rows.groupBy("go_id").agg(F.max(F.struct("tid", "parents", "name", "namespace")).alias("t"))
    return top.select("go_id", "t.name", "t.namespace", "t.parents")


def current_parents(terms: DataFrame) -> DataFrame:
    """(go_id, parents) as in current_terms, without the names on the way."""
    top = terms.where(F.col("go_id").isNotNull()).groupBy("go_id").agg(F.max(F.struct("tid", "parents")).alias("t"))
    return top.select("go_id", "t.parents")


def _named(current: DataFrame, child: Column) -> DataFrame:
    """(child, key) of each parent entry that isn't blank; key is what it names, in lower case."""
    entries = current.select(child.alias("child"), F.explode("parents").alias("entry"))
    return entries.select("child", F.lower(strip(F.substring_index("entry", "!", 1))).alias("key")).where("key <> ''")


def parent_links(current: DataFrame) -> DataFrame:
    """(child, parent) once per link, both by their go_id."""
    named = _named(current, F.col("go_id")).distinct()
    ids = current.select(F.lower("go_id").alias("key"), F.col("go_id").alias("parent"))
    return named.join(ids, "key").select("child", "parent").distinct()


def peel(child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links whose child has children and whose parent has parents, again and again while PEEL of them or fewer are left."""
    names, at = np.unique(np.concatenate([child, parent]), return_inverse=True)
    down, up, rows = at[: len(child)], at[len(child) :], 2 * len(child)
    while len(down) and len(down) <= PEEL * rows:
        below, above = np.zeros(len(names), bool), np.zeros(len(names), bool)
        below[up] = above[down] = True
        on, rows = below[down] & above[up], len(down)
        down, up = down[on], up[on]
    return names[down], names[up]


def _peel_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        yield from pa.table(list(peel(table["child"].to_numpy(), table["parent"].to_numpy())), names=["child", "parent"]).to_batches(10_000)


def peeled(links: DataFrame, merge_rows: int) -> DataFrame:
    """links (child, parent: bigint) with all those of cycles, and most others taken off: by joins until one task can hold the rest."""
    left = materialize(links, "links")
    rows, now = 0, left.count()
    while now > merge_rows and (not rows or now <= PEEL * rows):
        release(links.sparkSession)
        below, above = left.select(F.col("parent").alias("child")).distinct(), left.select(F.col("child").alias("parent")).distinct()
        left = materialize(left.join(below, "child", "left_semi").join(above, "parent", "left_semi"), "links")
        rows, now = now, left.count()
    if now > merge_rows:
        return left
    return materialize(left.repartition(1).mapInArrow(_peel_part, "child bigint, parent bigint"), "links")


def settle(node: np.ndarray, top: np.ndarray, off: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(top, off, bound) of each node, followed as far as the rows here go. off is the offset from the top; bound marks what leads into a ring, and ends there."""
    order = np.argsort(node, kind="stable")
    at = order[np.minimum(np.searchsorted(node, top, sorter=order), max(len(node) - 1, 0))] if len(node) else order
    leads = node[at] == top if len(node) else np.zeros(0, bool)
    up = np.where(leads & (bound == 0) & (bound[at] == 0), at, -1)
    for _ in range(len(node).bit_length() + 1):
        m = np.flatnonzero(up >= 0)
        if not len(m):
            break
        to = up[m]
        off[m], top[m], up[m] = off[m] + off[to], top[to], up[to]
    bound[up >= 0] = 1  # after so many steps only a ring goes on
    at = order[np.minimum(np.searchsorted(node, top, sorter=order), max(len(node) - 1, 0))] if len(node) else order
    bound[(node[at] == top) & (bound[at] == 1)] = 1
    return top, off, bound


def ring_labels(node: np.ndarray, top: np.ndarray) -> np.ndarray:
    """For each node of whole links the least node of the ring that it lies on, -1 if it lies on none."""
    order = np.argsort(node, kind="stable")
    at = order[np.minimum(np.searchsorted(node, top, sorter=order), max(len(node) - 1, 0))] if len(node) else order
    up, low = np.where(node[at] == top, at, -1), node.copy()
    for _ in range(len(node).bit_length() + 1):
        m = np.flatnonzero(up >= 0)
        to = up[m]
        low[m], up[m] = np.minimum(low[m], low[to]), up[to]
    on, out = np.unique(up[up >= 0]), np.full(len(node), -1, np.int64)
    out[on] = low[on]
    return out


def _settle_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    node, first, better, top, off, bound = [table[c].to_numpy().copy() for c in ("node", "first", "better", "top", "off", "bound")]
    cols = [node, first, better, *settle(node, top, off, bound), np.full(len(node), TaskContext.get().partitionId(), np.int32)]
    yield from pa.table(cols, names=["node", "first", "better", "top", "off", "bound", "part"]).to_batches(10_000)


def _ring_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        node, first = [pa.Table.from_batches(held)[c].to_numpy() for c in ("node", "first")]
        label = ring_labels(node, first)
        yield pa.RecordBatch.from_arrays([pa.array(node[label >= 0]), pa.array(label[label >= 0])], names=["node", "cycle"])


def forest(chosen: DataFrame, rows: int, merge_rows: int) -> DataFrame:
    """The forest (STATE) of links (node, first, better), one per node; rows is about how many there are."""
    tasks, last = chosen.sparkSession.sparkContext.defaultParallelism, max(1, -(-rows // merge_rows))
    one = F.lit(1).cast("bigint")
    parts = chosen.select("node", "first", "better", F.col("first").alias("top"), one.alias("off"), F.lit(0).alias("bound"), F.lit(0).alias("part")).mapInArrow(_settle_part, STATE)
    while True:
        tasks = max(last, -(-tasks // FAN))
        parts = parts.repartition(tasks, "part").mapInArrow(_settle_part, STATE)
        if tasks == last:
            break
    parts = materialize(parts, "forest")
    return parts if last == 1 else _joined(parts, rows)


def _joined(parts: DataFrame, rows: int) -> DataFrame:
    """The forest of parts that don't fit one task: each round joins every open top with its own row and so doubles its reach."""
    for _ in range(rows.bit_length() + 2):
        up = parts.select(F.col("node").alias("top"), F.col("top").alias("t"), F.col("off").alias("o"), F.col("bound").alias("b"))
        met, goes = parts.join(up, "top", "left"), F.col("t").isNotNull() & (F.col("bound") == 0) & (F.col("b") == 0)
        move = lambda to, stay: F.when(goes, to).otherwise(F.col(stay)).alias(stay)
        parts = met.select("node", "first", "better", move(F.col("t"), "top"), move(F.col("off") + F.col("o"), "off"), F.greatest("bound", F.coalesce("b", F.lit(0))).alias("bound"), "part", goes.alias("moved"))
        parts = materialize(parts, "forest")
        moving, parts = parts.where("moved"), parts.drop("moved")
        if not moving.limit(1).count():
            return parts
    return materialize(parts.join(moving.select("node", F.lit(1).alias("on")), "node", "left").withColumn("bound", F.greatest("bound", F.coalesce("on", F.lit(0)))).drop("on"), "forest")


def _rings(bound: DataFrame, rows: int, merge_rows: int) -> DataFrame:
    """(node, cycle) of the rings that the links (node, first) of bound lead into; cycle is the least node of each."""
    if rows <= merge_rows:
        return bound.repartition(1).mapInArrow(_ring_part, "node bigint, cycle bigint")
    # every node that something still reaches after as many steps as there are links is on a ring
    hop = bound.select("node", F.col("first").alias("top"), F.col("node").alias("low"))
    for _ in range(rows.bit_length() + 1):
        up = hop.select(F.col("node").alias("top"), F.col("top").alias("t"), F.col("low").alias("l"))
        hop = materialize(hop.join(up, "top").select("node", F.col("t").alias("top"), F.least("low", "l").alias("low")), "rings")
    return hop.join(hop.select(F.col("top").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("cycle"))


def _contracted(left: DataFrame, state: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links and the choices with each ring as one node."""
    to = lambda c: rings.select(F.col("node").alias(c), F.col("cycle").alias(f"{c}_cycle"))
    shrunk = left.join(to("child"), "child", "left").join(to("parent"), "parent", "left")
    shrunk = shrunk.select(F.coalesce("child_cycle", "child").alias("child"), F.coalesce("parent_cycle", "parent").alias("parent"))
    left = materialize(shrunk.where("child <> parent").distinct(), "links")
    now = state.select("node", "first").join(rings, "node", "left_anti").join(to("first"), "first", "left").select("node", F.coalesce("first_cycle", "first").alias("first"))
    again = left.join(rings.select(F.col("cycle").alias("child")).distinct(), "child", "left_semi").groupBy(F.col("child").alias("node")).agg(F.max("parent").alias("first"))
    return left, now.unionByName(again).withColumn("better", F.lit(1))


def cyclic_nodes(links: DataFrame, merge_rows: int | None = None) -> DataFrame:
    """(cycle, node) of each node of links (child, parent: bigint) that can be reached from itself; cycle is one number for all of a cycle."""
    merge_rows = merge_rows or MERGE_ROWS
    own = links.where("child = parent").select(F.col("child").alias("node")).distinct()
    left = peeled(links.where("child <> parent"), merge_rows)
    contracted: list[DataFrame] = []
    chosen = left.groupBy(F.col("child").alias("node")).agg(F.max("parent").alias("first")).withColumn("better", F.lit(1))
    rows = left.count()
    while rows:
        state = forest(chosen, rows, merge_rows)
        bound, better, rows = state.agg(F.coalesce(F.sum("bound"), F.lit(0)), F.coalesce(F.sum("better"), F.lit(0)), F.count("*")).first()
        if bound:
            rings = materialize(_rings(state.where("bound = 1").select("node", "first"), bound, merge_rows), "rings")
            left, chosen = _contracted(left, state, rings)
            contracted.append(rings)
        elif better:
            # a link whose parent is no lower than its child makes the child take it
            height = state.select(F.col("node").alias("parent"), F.col("off").alias("above"))
            best = left.join(height, "parent", "left").groupBy(F.col("child").alias("node")).agg(F.max(F.struct(F.coalesce("above", F.lit(0)).alias("above"), "parent")).alias("b"))
            higher = F.col("b.above") + 1 > F.col("off")
            chosen = state.join(best, "node").select("node", F.when(higher, F.col("b.parent")).otherwise(F.col("first")).alias("first"), higher.cast("int").alias("better"))
        else:
            break
    alone = own.select(F.col("node").alias("cycle"), "node")
    if not contracted:
        return alone
    member = contracted[-1]
    for rings in reversed(contracted[:-1]):
        # a ring may lie on a later one as one node, which is one of its own
        inner = rings.select("node", F.col("cycle").alias("at")).join(member.select(F.col("node").alias("at"), "cycle"), "at", "left")
        member = materialize(inner.select("node", F.coalesce("cycle", "at").alias("cycle")).unionByName(member.join(rings.select("node"), "node", "left_anti")), "members")
    return member.select("cycle", "node").unionByName(alone.join(member.select("node"), "node", "left_anti"))


def cyclic_terms(links: DataFrame, merge_rows: int | None = None) -> DataFrame:
    """(cycle_id, go_id) of each term that can be reached from itself, from links (child, parent) by go_id. Terms are numbered first, so that forests hold numbers."""
    names = links.select(F.col("child").alias("go_id")).union(links.select("parent")).distinct()
    names = materialize(names.withColumn("id", F.monotonically_increasing_id()), "ids")
    to = lambda c: names.select(F.col("go_id").alias(c), F.col("id").alias(f"{c}_id"))
    numbered = links.join(to("child"), "child").join(to("parent"), "parent").select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"))
    found = cyclic_nodes(materialize(numbered, "links"), merge_rows).join(names.withColumnRenamed("id", "node"), "node").select("cycle", "go_id")
    found = materialize(found, "cyclic")
    return found.join(found.groupBy("cycle").agg(F.min("go_id").alias("cycle_id")), "cycle").select("cycle_id", "go_id")


def _hash(name: Column) -> Column:
    return F.xxhash64(name)


def term_cycles(terms: DataFrame, merge_rows: int | None = None) -> DataFrame:
    """cyclic_terms of a table of terms. Equal hashes make two terms one, which keeps every cycle, so what is peeled off by them is on none."""
    rows, own = terms.select("go_id", "tid", "parents"), _hash(F.lower("go_id"))
    hashed = _named(current_parents(rows), own).select("child", _hash(F.col("key")).alias("parent"))
    near = materialize(peeled(hashed, merge_rows or MERGE_ROWS).select(F.col("child").alias("at")).distinct(), "near")
    kept = materialize(current_parents(rows.join(if_small(near), own == F.col("at"), "left_semi")), "terms")
    return cyclic_terms(materialize(parent_links(kept), "links"), merge_rows)


def _followed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(go_id, top, path, done): every path from a node without parents down to each node (go_id), along links that hold no cycle."""
    ends = (
        nodes
        .join(links.select(F.col("child").alias("go_id")).distinct(), "go_id", "left_anti")
        .select("go_id", F.col("go_id").alias("top"), F.array("go_id").alias("path"), F.lit(True).alias("done"))
    )
    first = links.join(ends.select(F.col("go_id").alias("parent"), "done"), "parent", "left").select(
        F.col("child").alias("go_id"), F.col("parent").alias("top"), F.array("parent", "child").alias("path"), F.coalesce("done", F.lit(False)).alias("done")
    )
    seg = materialize(ends.unionByName(first), "paths")
    while seg.where("not done").limit(1).count():
        upper = seg.select(F.col("go_id").alias("via"), F.col("top").alias("above"), F.col("path").alias("head"), F.col("done").alias("ended"))
        longer = (
            seg.where("not done")
            .join(upper, F.col("top") == F.col("via"))
            .select("go_id", F.col("above").alias("top"), F.concat("head", F.slice("path", F.lit(2), F.size("path"))).alias("path"), F.col("ended").alias("done"))
        )
        seg = materialize(seg.where("done").unionByName(longer), "paths")
    return seg


def _above(links: DataFrame, of: DataFrame) -> DataFrame:
    """The links at and above some nodes (node)."""
    front = met = materialize(of.select("node").distinct(), "above")
    while front.limit(1).count():
        up = links.join(front.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
        front = materialize(up.join(met, "node", "left_anti"), "above")
        met = materialize(met.unionByName(front), "above")
    return links.join(met.withColumnRenamed("node", "child"), "child", "left_semi")


def all_paths(terms: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(go_id, root, depth, from_cycle, path): every path from a root down to each term, through the cycles on its way.

    A cycle is one node, written as its cycle_id; its terms have the paths of that node. depth counts the links between
    nodes. A cycle without parents outside itself is the root of what hangs below it (from_cycle). Terms of many
    parents can have more paths than can be listed: of (go_id) lists those of some terms only.
    """
    cur = materialize(current_terms(terms), "terms")
    links = materialize(parent_links(cur), "links")
    cyclic = materialize(cyclic_terms(links), "cyclic")
    node = cur.select("go_id").join(cyclic, "go_id", "left").select("go_id", F.coalesce("cycle_id", "go_id").alias("node"))
    node = materialize(node, "nodes")
    child, parent = node.select(F.col("go_id").alias("child"), F.col("node").alias("c")), node.select(F.col("go_id").alias("parent"), F.col("node").alias("p"))
    between = links.join(child, "child").join(parent, "parent").where("c <> p").select(F.col("c").alias("child"), F.col("p").alias("parent")).distinct()
    between, listed = materialize(between, "links"), node
    if of is not None:
        listed = node.join(of.select("go_id").distinct(), "go_id", "left_semi")
        between = materialize(_above(between, listed), "links")
    seg = _followed(node.select(F.col("node").alias("go_id")).distinct(), between).withColumnRenamed("go_id", "node")
    cycles = cyclic.select(F.col("cycle_id").alias("root")).distinct().withColumn("from_cycle", F.lit(True))
    found = seg.select("node", F.col("top").alias("root"), (F.size("path") - 1).alias("depth"), "path").join(cycles, "root", "left")
    return listed.join(found, "node").select("go_id", "root", "depth", F.coalesce("from_cycle", F.lit(False)).alias("from_cycle"), "path")


def _descendants(links: DataFrame) -> DataFrame:
    met = materialize(links.where("child <> parent").select(F.col("parent").alias("ancestor"), F.col("child").alias("go_id"), F.lit(1).alias("distance")), "pairs")
    reach = 1
    while met.where(F.col("distance") == reach).limit(1).count():
        far = met.where(F.col("distance") == reach).select("ancestor", F.col("go_id").alias("via"))
        near = met.select(F.col("ancestor").alias("via"), "go_id", (F.col("distance") + reach).alias("distance"))
        longer = far.join(near, "via").where("ancestor <> go_id").select("ancestor", "go_id", "distance")
        met = materialize(met.unionByName(longer).groupBy("ancestor", "go_id").agg(F.min("distance").alias("distance")), "pairs")
        reach *= 2
    return met


def descendants(terms: DataFrame) -> DataFrame:
    """(ancestor, go_id, distance): each term above another, through cycles too, with the least number of links between them.

    Once all pairs up to a distance are known, those up to twice as far join a pair of just that distance with a known
    one. No path is listed, so the work follows the number of pairs.
    """
    return _descendants(materialize(parent_links(materialize(current_terms(terms), "terms")), "links"))


def node_summary(terms: DataFrame) -> DataFrame:
    """(go_id, depth, roots, ancestors, descendants): for each term the least depth below a root (a term without parents; null if none is above), and how many of each it has."""
    cur = materialize(current_terms(terms), "terms")
    links = materialize(parent_links(cur), "links")
    pairs = _descendants(links)
    tops = cur.select("go_id").join(links.select(F.col("child").alias("go_id")).distinct(), "go_id", "left_anti")
    mark = tops.select(F.col("go_id").alias("ancestor"), F.lit(True).alias("is_root"))
    up = pairs.join(mark, "ancestor", "left").groupBy("go_id").agg(
        F.min(F.when(F.col("is_root"), F.col("distance"))).alias("depth"), F.count_if("is_root").alias("roots"), F.count("*").alias("ancestors")
    )
    down = pairs.groupBy(F.col("ancestor").alias("go_id")).agg(F.count("*").alias("descendants"))
    own = tops.withColumn("own", F.lit(0))
    rows = cur.select("go_id").join(up, "go_id", "left").join(down, "go_id", "left").join(own, "go_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("go_id", F.coalesce("own", "depth").alias("depth"), F.coalesce(F.col("own") + 1, F.col("roots"), F.lit(0)).cast("bigint").alias("roots"), none("ancestors"), none("descendants"))
