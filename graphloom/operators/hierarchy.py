"""Parent links of unknown depth to full hierarchies, with cycles.

Ids become integer codes in the order of the ids. Upward, leaves are taken off layer by layer and hand their subtree sizes to their
parents; once few nodes are left, one task does the rest of the layers at once: what is never taken off lies on a cycle. Siblings get
preorder offsets by prefix sums of the sizes. Downward, that rest is given its nested-set ranges in one task, then each layer, the last
first, from its parents. A node's descendants are then the rows whose `lo` lies in its range.

Layers that leave many nodes open move only those, and each is a written table, so a lost executor costs one layer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import discard, materialize, materialize_with

#: So many open nodes fit one task.
FEW = 100_000
BLOCK_BITS = 16


@dataclass
class Forest:
    """names: code, id, pcode, name. placed: code, lo, hi, depth, root_code, cycle (smallest code on the cycle it hangs from, or null), path."""

    names: DataFrame
    placed: DataFrame


def coded_links(nodes: DataFrame, id: Column, parent: Column, name: Column | None = None) -> DataFrame:
    """(code, id, pcode, name): codes ascend with the ids by code point. Null ids are left out; of repeated ids one row stays, the one
    with the smallest (parent, name). A parent that is null or names no node is null here."""
    rows = nodes.select(id.alias("id"), F.struct(F.coalesce(parent, F.lit("")).alias("parent"), F.coalesce(name if name is not None else id, F.lit("")).alias("name")).alias("v"))
    rows = rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v")).select("id", "v.parent", "v.name")
    coded = materialize(rows.sort("id").withColumn("code", F.monotonically_increasing_id()))
    parents = coded.select(F.col("id").alias("parent"), F.col("code").alias("pcode"))
    return materialize(coded.join(parents, "parent", "left").select("code", "id", "pcode", "name"))


def subtree_sizes(links: DataFrame, few: int = FEW) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(layers of (code, pcode, name, size), leaves first; the same of the nodes done in one task; (code, cycle) of the nodes on cycles)."""
    counts = links.where("pcode is not null").groupBy("pcode").agg(F.count(F.lit(1)).alias("open"))
    rest = links.join(counts.withColumnRenamed("pcode", "code"), "code", "left").select("code", "pcode", "name", F.coalesce("open", F.lit(0)).alias("open"), F.lit(1).cast("long").alias("size"))
    layers: list[DataFrame] = []
    while True:
        state, seen = materialize_with(rest, n=F.count(F.lit(1)), ready=F.count(F.when(F.col("open") == 0, 1)))
        if seen["n"] <= few:
            solved = materialize(state.select("code", "pcode", "name", "size").coalesce(1).mapInPandas(_take_off, "code long, pcode long, name string, size long, cycle long"))
            return layers, solved.where("cycle is null").drop("cycle"), solved.where("cycle is not null").select("code", "cycle")
        if not seen["ready"]:
            return layers, state.limit(0).select("code", "pcode", "name", "size"), cycle_labels(state.select("code", "pcode"))
        leaves = state.where("open = 0").select("code", "pcode", "name", "size")
        layers.append(leaves)
        up = leaves.where("pcode is not null").groupBy("pcode").agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("less")).withColumnRenamed("pcode", "code")
        rest = state.where("open > 0").join(up, "code", "left")
        rest = rest.select("code", "pcode", "name", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))


def _take_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sizes of the whole subtrees; cycle is the smallest code of the node's cycle, null off cycles."""
    parts = list(batches)
    if not parts:
        return
    t = pd.concat(parts, ignore_index=True)
    codes, size = t["code"].tolist(), dict(zip(t["code"].tolist(), t["size"].tolist()))
    parent = {c: int(p) for c, p in zip(codes, t["pcode"]) if not pd.isna(p)}
    opened = dict.fromkeys(codes, 0)
    for p in parent.values():
        opened[p] += 1
    todo, on_cycle = [c for c in codes if not opened[c]], set(codes)
    while todo:
        c = todo.pop()
        on_cycle.discard(c)
        p = parent.get(c)
        if p is not None:
            size[p] += size[c]
            opened[p] -= 1
            if not opened[p]:
                todo.append(p)
    label: dict[int, int] = {}
    for c in on_cycle:
        if c not in label:
            ring, x = [c], parent[c]
            while x != c:
                ring.append(x)
                x = parent[x]
            label.update(dict.fromkeys(ring, min(ring)))
    t["size"] = [size[c] for c in codes]
    t["cycle"] = pd.array([label.get(c) for c in codes], dtype="Int64")
    yield t


def sibling_offsets(sized: DataFrame) -> DataFrame:
    """sized (code, pcode, size, ...) with off, the sizes of the earlier siblings. Siblings are cut into blocks of 65 536 neighbouring codes, so
    that no task sorts all children of one parent: a sum within the block and the sums of the blocks before it."""
    cut = sized.withColumn("block", F.shiftright("code", BLOCK_BITS))
    own = Window.partitionBy("pcode", "block").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    blocks = cut.groupBy("pcode", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("pcode").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("pcode").alias("bp"), F.col("block").alias("bb"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    both = inner.join(blocks, F.col("pcode").eqNullSafe(F.col("bp")) & (F.col("block") == F.col("bb")))
    return both.select(*sized.columns, (F.col("inner") + F.col("base")).alias("off"))


def cycle_labels(ring: DataFrame) -> DataFrame:
    """(code, cycle): the smallest code on each node's cycle; ring holds exactly the nodes on cycles. By doubling: after k rounds a node
    knows the smallest of its next 2^k, and once no node learns anything new all know the smallest of the whole cycle."""
    state = ring.select("code", F.col("pcode").alias("ptr"), F.least("code", "pcode").alias("m"))
    state = materialize(state)
    while True:
        ahead = state.select(F.col("code").alias("ptr"), F.col("ptr").alias("far"), F.col("m").alias("fm"))
        step = state.join(ahead, "ptr").select("code", F.col("far").alias("ptr"), F.least("m", "fm").alias("m"), (F.col("fm") < F.col("m")).alias("news"))
        old, (state, seen) = state, materialize_with(step, news=F.count(F.when(F.col("news"), 1)))
        discard(old)
        state = state.select("code", "ptr", "m")
        if not seen["news"]:
            return state.select("code", F.col("m").alias("cycle"))


def build_forest(nodes: DataFrame, id: Column, parent: Column, name: Column | None = None, paths: bool = False, few: int = FEW) -> Forest:
    """Ranges, depths, roots and cycles of all nodes, and with paths their names from the root down, joined with `/`.

    A node whose parent is null, blank or unknown is a root (depth 0). The nodes on a cycle have depth 0 and no range of their own; the
    nodes below a cycle count their depth from it and carry its label; neither have a path. An empty table gives an empty forest."""
    names = coded_links(nodes, id, parent, name)
    layers, top, ring = subtree_sizes(names if paths else names.withColumn("name", F.lit(None).cast("string")), few)
    last = len(layers)
    sized = top.withColumn("layer", F.lit(last))
    for k, x in enumerate(layers):
        sized = sized.unionByName(x.withColumn("layer", F.lit(k)))
    offs = materialize(sibling_offsets(sized), by=["layer"])
    null = F.lit(None)
    rings = ring.select("code", null.cast("long").alias("pcode"), null.cast("string").alias("name"), null.cast("long").alias("size"), null.cast("long").alias("off"), "cycle")
    at_top = offs.where(F.col("layer") == last).select("code", "pcode", "name", "size", "off", null.cast("long").alias("cycle"))
    columns = "code long, lo long, hi long, depth int, root_code long, cycle long, path string"
    if top.isEmpty():  # the rest are cycles alone, however many
        placed = [rings.select("code", null.cast("long").alias("lo"), null.cast("long").alias("hi"), F.lit(0).alias("depth"), null.cast("long").alias("root_code"), "cycle", null.cast("string").alias("path"))]
    else:
        placed = [materialize(at_top.unionByName(rings).coalesce(1).mapInPandas(_place, columns))]
    for k in reversed(range(last)):
        up = placed[0]
        for x in placed[1:]:
            up = up.unionByName(x)
        up = up.select(F.col("code").alias("pcode"), F.col("lo").alias("plo"), F.col("depth").alias("pdepth"), F.col("root_code").alias("proot"), "cycle", F.col("path").alias("ppath"))
        here = offs.where(F.col("layer") == k).join(up, "pcode", "left")
        root = F.col("pcode").isNull()
        lo = F.when(root, F.col("off")).otherwise(F.col("plo") + 1 + F.col("off"))
        path = F.when(root, F.col("name")).otherwise(F.concat("ppath", F.lit("/"), "name"))
        here = here.select("code", lo.alias("lo"), (lo + F.col("size") - 1).alias("hi"), F.when(root, F.lit(0)).otherwise(F.col("pdepth") + 1).alias("depth"), F.when(root, F.col("code")).otherwise(F.col("proot")).alias("root_code"), "cycle", path.alias("path"))
        placed.append(materialize(here))
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return Forest(names, out)


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes and cycles from the top down; rows come out in pieces, parents first."""
    parts = list(batches)
    if not parts:
        return
    t = pd.concat(parts, ignore_index=True)
    below: dict[int, list[int]] = {}
    front = []
    whole = lambda v: None if pd.isna(v) else int(v)
    rows = {c: (whole(p), None if pd.isna(n) else n, whole(z), whole(o), whole(y)) for c, p, n, z, o, y in zip(*(t[x].tolist() for x in ("code", "pcode", "name", "size", "off", "cycle")))}
    for c, (p, *_) in rows.items():
        if p is None:
            front.append(c)
        else:
            below.setdefault(p, []).append(c)
    done: dict[int, tuple] = {}
    out = []
    while front:
        following = []
        for c in front:
            p, name, size, off, cycle = rows[c]
            if p is None:
                got = (None, 0, None, cycle, None) if cycle is not None else (off, 0, c, None, name)
            else:
                plo, depth, root, cycle, path = done[p]
                got = (None if plo is None else plo + 1 + off, depth + 1, root, cycle, None if path is None or name is None else f"{path}/{name}")
            lo = got[0]
            out.append((c, lo, None if lo is None else lo + size - 1, got[1], got[2], got[3], got[4]))
            if c in below:
                done[c] = got
                following += below[c]
        front = following
        if len(out) > 10_000 or not front:
            f = pd.DataFrame(out, columns=["code", "lo", "hi", "depth", "root_code", "cycle", "path"])
            yield f.astype({x: "Int64" for x in ("lo", "hi", "root_code", "cycle")})
            out = []


def cyclic_nodes(forest: Forest) -> DataFrame:
    """(id, cycle_id): the nodes on a cycle and all below one, with the smallest id on that cycle."""
    ids = forest.names.select("code", "id")
    hung = forest.placed.where("cycle is not null").select("code", "cycle")
    labels = ids.select(F.col("code").alias("cycle"), F.col("id").alias("cycle_id"))
    return hung.join(ids, "code").join(labels, "cycle").select("id", "cycle_id")


def hierarchy_table(forest: Forest) -> DataFrame:
    """(id, depth, root_id, path, lo, hi, n_descendants) of the nodes that reach a root; path is null where the forest has none."""
    ids = forest.names.select("code", "id")
    roots = ids.select(F.col("code").alias("root_code"), F.col("id").alias("root_id"))
    reach = forest.placed.where("cycle is null").join(ids, "code").join(roots, "root_code")
    return reach.select("id", "depth", "root_id", "path", "lo", "hi", (F.col("hi") - F.col("lo")).alias("n_descendants"))


def descendants(forest: Forest, of: DataFrame | None = None) -> DataFrame:
    """(ancestor, id, distance): all nodes below the given ones (column id), or below each node, by nested-set ranges. Preorder numbers are
    dense, so a range is the list of its nodes' numbers, spelled out a block at a time, and the join an equality on numbers."""
    bits = 12
    ids = forest.names.select("code", "id")
    at = materialize(forest.placed.where("lo is not null").join(ids, "code").select("id", "lo", "hi", "depth"))
    tops = (at if of is None else at.join(of.select("id").distinct(), "id")).select(F.col("id").alias("ancestor"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("depth").alias("adepth"))
    tops = tops.where("ahi > alo").withColumn("block", F.explode(F.sequence(F.shiftright(F.col("alo") + 1, bits), F.shiftright("ahi", bits))))
    first, last = F.greatest(F.col("alo") + 1, F.shiftleft("block", bits)), F.least("ahi", F.shiftleft(F.col("block") + 1, bits) - 1)
    below = tops.select("ancestor", "adepth", F.explode(F.sequence(first, last)).alias("lo"))
    return below.join(at.select("id", "lo", "depth"), "lo").select("ancestor", "id", (F.col("depth") - F.col("adepth")).alias("distance"))
