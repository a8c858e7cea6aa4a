"""Parent-child links to full hierarchies: path, depth, root, descendants and loops of every node.

Each node has at most one parent, so a connected component is a tree, or a
loop with trees hanging on it. Components are found by pointer doubling
(log2(depth) joins), each component is then co-located and walked by an
iterative depth-first traversal with node colouring. Components above
``max_component`` nodes are never collected into a task: their paths come from
doubling joins instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import drop, materialize

SCHEMA = (
    "node bigint, parent bigint, root bigint, depth int, path array<bigint>, descendants array<bigint>, "
    "n_descendants bigint, in_loop boolean, loop_reached boolean, dangling boolean, back_edge_to bigint"
)

WHITE, GREY, BLACK = 0, 1, 2
#: Path nodes that a task holds before it passes its rows on, beside one component.
HELD_NODES = 500_000


def _nodes(links: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(node, parent, dangling): one row a node; parent only where it exists."""
    nodes = (
        links.select(F.col(id_col).cast("bigint").alias("node"), F.col(parent_col).cast("bigint").alias("p"))
        .where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("p").alias("p"))
    )
    nodes = materialize(nodes, "nodes")
    known = nodes.select(F.col("node").alias("p"), F.lit(True).alias("known"))
    return nodes.join(known, "p", "left").select(
        "node", F.when(F.col("known"), F.col("p")).alias("parent"), (F.col("p").isNotNull() & F.col("known").isNull()).alias("dangling")
    )


def component_labels(nodes: DataFrame) -> DataFrame:
    """(node, comp) for (node, parent): comp is the tree's root, or the smallest id of the loop reached.

    Doubling f <- f.f: after k rounds every node of depth <= 2^k points at its
    root. Depths along a path are contiguous, so a round in which no further
    node arrives proves that the rest leads into loops.
    """
    jumps = materialize(nodes.select("node", F.coalesce("parent", "node").alias("f"), F.col("parent").isNull().alias("done")), "jump0")
    waiting = jumps.where(~F.col("done")).count()
    rounds = 0
    while waiting:
        target = jumps.select(F.col("node").alias("f"), F.col("f").alias("ff"), F.col("done").alias("arrived"))
        open_ = jumps.where(~F.col("done")).join(target, "f").select("node", F.col("ff").alias("f"), F.col("arrived").alias("done"))
        old, jumps = jumps, materialize(jumps.where("done").unionByName(open_), f"jump{rounds + 1}")
        drop(old)
        now = jumps.where(~F.col("done")).count()
        rounds += 1
        if now == waiting:
            break
        waiting = now
    if not waiting:
        return jumps.select("node", F.col("f").alias("comp"))
    # The rest leads into loops. f^(2^k) lies on the loop once 2^k reaches their number; min over as many steps is the loop's smallest id.
    rest = nodes.join(jumps.where(~F.col("done")).select("node"), "node", "left_semi")
    walk = materialize(rest.select("node", F.col("parent").alias("f"), F.least("node", "parent").alias("low"), F.col("parent").alias("at")), "loop0")
    steps = 1
    while steps < waiting:
        t = walk.select(F.col("node").alias("f"), F.col("f").alias("ff"), F.col("low").alias("flow"))
        old, walk = walk, materialize(walk.join(t, "f").select("node", F.col("ff").alias("f"), F.least("low", "flow").alias("low")), f"loop{steps}")
        drop(old)
        steps *= 2
    lows = walk.select(F.col("node").alias("f"), F.col("low").alias("comp"))
    looped = walk.select("node", "f").join(lows, "f").select("node", "comp")
    return jumps.where("done").select("node", F.col("f").alias("comp")).unionByName(looped)


def _walk(node: np.ndarray, parent: list, dangling: np.ndarray) -> dict[str, list]:
    """Depth-first traversal of one component with node colouring.

    Walking up from a white node: reaching a grey one closes a loop (the back
    edge), reaching a black one joins a known path.
    """
    index = {int(n): i for i, n in enumerate(node)}
    n = len(node)
    up = [index.get(p, -1) if p is not None else -1 for p in parent]
    colour, root, depth, in_loop, reached, back = [WHITE] * n, [0] * n, [0] * n, [False] * n, [False] * n, [None] * n
    path: list[list[int] | None] = [None] * n
    for start in range(n):
        if colour[start] != WHITE:
            continue
        stack, at = [], start
        while at >= 0 and colour[at] == WHITE:
            colour[at] = GREY
            stack.append(at)
            at = up[at]
        if at >= 0 and colour[at] == GREY:  # a loop: the nodes on the stack from `at` on
            first = stack.index(at)
            loop = stack[first:]
            low = min(loop, key=lambda i: node[i])
            back[low] = int(node[up[low]])
            turn = loop.index(low)
            order = loop[turn:] + loop[:turn]  # from the smallest id on, along the parents
            for k, i in enumerate(order):
                colour[i], root[i], in_loop[i], reached[i] = BLACK, int(node[low]), True, True
                steps = (len(order) - k) % len(order)
                depth[i] = steps
                path[i] = [int(node[low])] + [int(node[order[j]]) for j in range(len(order) - 1, k - 1, -1)] if steps else [int(node[low])]
            stack = stack[:first]
        while stack:
            i = stack.pop()
            colour[i], u = BLACK, up[i]
            if u < 0:
                root[i], depth[i], path[i] = int(node[i]), 0, [int(node[i])]
            else:
                root[i], depth[i], reached[i] = root[u], depth[u] + 1, reached[u]
                path[i] = path[u] + [int(node[i])]
    below: list[list[int]] = [[] for _ in range(n)]
    loops: dict[int, list[int]] = {}
    for i in range(n):
        if in_loop[i]:
            loops.setdefault(root[i], []).append(int(node[i]))
    for i in range(n):
        ancestors = path[i][:-1]
        if reached[i]:  # every node of the loop is above whatever leads into it
            ring = loops[root[i]]
            ring_set = set(ring)
            ancestors = [a for a in ring if a != node[i]] + [a for a in ancestors if a not in ring_set]
        for a in ancestors:
            below[index[a]].append(int(node[i]))
    return {
        "node": [int(x) for x in node], "parent": [p if u >= 0 else None for p, u in zip(parent, up)], "root": root, "depth": depth,
        "path": path, "descendants": [sorted(b) for b in below], "n_descendants": [len(b) for b in below], "in_loop": in_loop,
        "loop_reached": reached, "dangling": list(dangling), "back_edge_to": back,
    }


def _traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by comp; a component that a batch cuts is carried into the next."""

    def run(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        comp = part["comp"].to_numpy()
        cuts = np.flatnonzero(np.diff(comp)) + 1
        bounds = [0, *cuts.tolist(), len(part)]
        node = part["node"].to_numpy("int64")
        parents = [None if top else p for p, top in zip(part["parent"].tolist(), part["top"].tolist())]
        dangling = part["dangling"].to_numpy(bool)
        out: dict[str, list] = {}
        held = 0
        for a, b in zip(bounds, bounds[1:]):
            for k, v in _walk(node[a:b], parents[a:b], dangling[a:b]).items():
                out.setdefault(k, []).extend(v)
            held += b - a + sum(out["depth"][-(b - a) :])
            if held > HELD_NODES or b == bounds[-1]:  # paths take the most room, so few components go out together
                frame = pd.DataFrame(out)
                for c in ("parent", "back_edge_to"):
                    frame[c] = frame[c].astype("Int64")
                yield frame
                out, held = {}, 0

    kept: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        comp = batch["comp"].to_numpy()
        head = int(np.searchsorted(comp != comp[-1], False)) if comp[0] == comp[-1] else int(np.flatnonzero(comp != comp[-1])[-1] + 1)
        if head:
            yield from run(pd.concat([*kept, batch.iloc[:head]], ignore_index=True))
            kept = []
        elif kept and kept[-1]["comp"].iloc[-1] != comp[0]:
            yield from run(pd.concat(kept, ignore_index=True))
            kept = []
        kept.append(batch.iloc[head:])
    if kept:
        yield from run(pd.concat(kept, ignore_index=True))


def _large(rows: DataFrame) -> DataFrame:
    """The same result for components of any size, by doubling joins over (node, parent, dangling, comp)."""
    # A loop is opened at its smallest id (= comp), which thereby becomes the top of every path.
    rows = materialize(rows, "large")
    opened = rows.withColumn("up", F.when(F.col("node") != F.col("comp"), F.col("parent")))
    state = materialize(opened.select("node", F.col("up").alias("at"), F.array("node").alias("path")), "large0")
    k = 1
    while state.where(F.col("at").isNotNull()).limit(1).count():
        t = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("path").alias("above"))
        open_ = state.where(F.col("at").isNotNull()).join(t, "at").select("node", F.col("next").alias("at"), F.concat("above", "path").alias("path"))
        old, state = state, materialize(state.where(F.col("at").isNull()).unionByName(open_), f"large{k}")
        drop(old)
        k += 1
    # The ring: follow the parent of comp, whose path runs down from comp around the loop.
    tops = rows.where((F.col("node") == F.col("comp")) & F.col("parent").isNotNull()).select("comp", F.col("parent").alias("node"))
    rings = tops.join(state, "node").select("comp", F.col("path").alias("ring"))
    ring_nodes = rings.select("comp", F.explode("ring").alias("node"), F.lit(True).alias("in_loop"))
    has_loop = tops.select("comp", F.lit(True).alias("loop_reached"), F.col("node").alias("closing"))
    base = (
        rows.join(state.select("node", "path"), "node")
        .join(ring_nodes.drop("comp"), "node", "left")
        .join(has_loop, "comp", "left")
    )
    out = base.select(
        "node", "parent", F.col("comp").alias("root"), (F.size("path") - 1).cast("int").alias("depth"), "path",
        F.lit(None).cast("array<bigint>").alias("descendants"), F.coalesce("in_loop", F.lit(False)).alias("in_loop"), F.coalesce("loop_reached", F.lit(False)).alias("loop_reached"), "dangling",
        F.when(F.col("node") == F.col("comp"), F.when(F.col("loop_reached"), F.col("parent"))).alias("back_edge_to"),
    )
    out = materialize(out, "large_paths")
    counts = descendant_pairs(out).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    return out.join(counts, "node", "left").select(*[c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] != "n_descendants"], F.coalesce("n_descendants", F.lit(0)).alias("n_descendants")).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, node), distinct: all descendants of every node as rows, for components of any size. In a loop all are above each other."""
    pairs = tree.select(F.explode("path").alias("ancestor"), "node").where("ancestor <> node")
    ring = tree.where("in_loop").select("root", F.col("node").alias("ancestor"))
    around = tree.where("loop_reached").select("root", "node").join(ring, "root").where("ancestor <> node").select("ancestor", "node")
    return pairs.unionByName(around).distinct()


def hierarchy(links: DataFrame, id_col: str = "id", parent_col: str = "parent", max_component: int = 1_000) -> DataFrame:
    """One row a node: its parent, root, depth, path from the root, descendants, and where a loop closes.

    Repeated rows count once (of differing parents the smallest); null ids are
    left out. A parent that doesn't exist leaves the node as a root marked
    ``dangling``. In a loop, and below one, ``root`` is the smallest id on the
    loop and paths start there; ``in_loop`` marks its nodes, ``loop_reached``
    all that lead into it, and exactly one node of each loop has
    ``back_edge_to``, the target of the edge that closes it. The array ``descendants`` is
    null in components above ``max_component`` nodes, where one row might not hold it;
    ``n_descendants`` is exact everywhere, descendant_pairs gives them as rows and hierarchy_blocks in arrays of bounded size.
    Other columns of ``links`` are ignored; an empty frame gives an empty one.
    """
    walked, large = _parts(links, id_col, parent_col, max_component)
    return walked.unionByName(large) if large is not None else walked


def hierarchy_blocks(links: DataFrame, id_col: str = "id", parent_col: str = "parent", max_component: int = 1_000) -> DataFrame:
    """hierarchy with all descendants of every node, at every size: one row a node and ``block``, ``descendants`` never null.

    A node of at most ``max_component`` descendants has one row, block 0. One of more has them spread by hash over
    ceil(n_descendants / max_component) blocks of about that size; each descendant stands in exactly one. Arrays are sorted.
    """
    walked, large = _parts(links, id_col, parent_col, max_component)
    walked = walked.withColumn("block", F.lit(0))
    if large is None:
        return walked
    large = materialize(large, "large_tree")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_descendants") / max(1, max_component)))
    pairs = descendant_pairs(large).join(large.select(F.col("node").alias("ancestor"), blocks.alias("blocks")), "ancestor")
    held = (
        pairs.groupBy(F.col("ancestor").alias("node"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        .agg(F.sort_array(F.collect_list(F.col("node"))).alias("descendants"))
    )
    none = F.array().cast("array<bigint>")
    rows = large.drop("descendants").join(held, "node", "left").withColumns({"block": F.coalesce("block", F.lit(0)), "descendants": F.coalesce("descendants", none)})
    return walked.unionByName(rows)


def _parts(links: DataFrame, id_col: str, parent_col: str, max_component: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the components up to max_component nodes, and those of the larger ones if there are any."""
    nodes = materialize(_nodes(links, id_col, parent_col), "links")
    labels = component_labels(nodes)
    rows = nodes.join(labels, "node")
    sizes = labels.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > max_component)
    large = materialize(sizes.select("comp"), "sizes")
    any_large = large.limit(1).count() > 0
    if any_large:
        small = rows.join(large, "comp", "left_anti")
    else:
        small = rows
    walked = (
        small.select("node", F.coalesce("parent", "node").alias("parent"), F.col("parent").isNull().alias("top"), "dangling", "comp").repartition("comp").sortWithinPartitions("comp", "node").mapInPandas(_traverse, SCHEMA)
    )
    return walked, _large(rows.join(large, "comp", "left_semi")) if any_large else None


def loops(tree: DataFrame) -> DataFrame:
    """(root, members): one row a loop."""
    return tree.where("in_loop").groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("length"))
