"""Embedding near-dedup by NN-descent.

Equal vectors are collapsed into weighted nodes. A forest of random-projection
leaves starts a neighbour graph, which rounds of neighbours-of-neighbours
joins refine; a node whose whole list lies over the threshold is saturated and
gets a longer list. An audit compares sampled nodes with all vectors, and a
recall under the target adds trees and rounds. Threshold edges, recomputed in
double precision, give the components. A node whose list ends before the
threshold may have links beyond it: such open nodes are covered by cells, and
the cells of different components that the triangle inequality leaves within
reach are compared whole, which joins what the lists hold apart. Inside each
component every pair is compared in blocks, so that lists of any final length
count all links. A last audit takes all true links of the sampled nodes; a
share under the target that lies inside the components is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .components import connected_components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    neighbours: int = 8
    longest: int = 32  # lists double up to this; what lies beyond is found between cells and counted inside components
    trees: int = 10
    leaf: int = 160
    rounds: int = 2
    least_change: float = 0.01  # share of list entries replaced, below which the descent ends
    audited: int = 500  # nodes compared with all vectors
    recall: float = 0.98
    repeats: int = 3
    repairs: int = 3  # further graphs, while components miss audited links
    block: int = 512
    radius: float = 0.15  # angle that a cell of open nodes covers
    cells: int = 4096  # cells compared with each other in a task
    seed: int = 5


SLACK = 0.01  # half-precision cosines are taken this far below the threshold and then recomputed


def _unit16(blob) -> np.ndarray:
    """Rows of half-precision unit vectors as single precision."""
    return np.frombuffer(b"".join(blob), np.float16).reshape(len(blob), -1).astype(np.float32)


def _unit64(blob) -> np.ndarray:
    x = np.frombuffer(b"".join(blob), np.float64).reshape(len(blob), -1)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _nodes(classes: DataFrame) -> DataFrame:
    """(node, dim, v16, v64): the vectors as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v64 = [np.asarray(v, np.float64).tobytes() for v in batch["v"]]
            v16 = [_unit64([b])[0].astype(np.float16).tobytes() for b in v64]
            yield pd.DataFrame({"node": batch["node"], "v16": v16, "v64": v64})

    return classes.select("node", "v").mapInPandas(run, "node long, v16 binary, v64 binary")


def _groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups and where each group starts, for rows sorted by ``keys``: small groups cost no call each."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(rows):
            values = rows[list(keys)].to_numpy()
            starts = np.r_[0, np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1]
            if len(starts) > 1:
                yield rows.iloc[: starts[-1]], starts
            rest = rows.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _neighbour_rows(found: list[tuple]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"node": np.zeros(0, np.int64), "nbr": np.zeros(0, np.int64), "cos": np.zeros(0, np.float32)})
    return pd.DataFrame({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("node", "nbr", "cos"))})


def _leaves(vectors: DataFrame, dim: int, n: int, s: Settings, repeat: int) -> DataFrame:
    """(tree, la, lb, node, v16): random-projection leaves of about ``s.leaf`` nodes.

    Leaves that stay large after all bits hold vectors of nearly one direction;
    those are dealt into parts by hash, and the descent joins the parts again.
    """
    bits = max(1, int(np.ceil(np.log2(max(2.0, n / s.leaf)))))
    more = bits + 6
    trees = s.trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(s.seed + 1000 * repeat).normal(size=(dim, trees * more)).astype(np.float32)
        weights = 1 << np.arange(more, dtype=np.int64)
        for batch in batches:
            if len(batch):
                sign = (_unit16(batch["v16"]) @ planes > 0).reshape(len(batch), trees, more)
                yield pd.DataFrame({"node": batch["node"], "codes": list(sign.astype(np.int64) @ weights)})

    codes = stored(vectors.mapInPandas(run, "node long, codes array<long>").select("node", F.posexplode("codes").alias("tree", "code")))
    short = F.col("code").bitwiseAND((1 << bits) - 1)
    coarse = codes.groupBy("tree", short.alias("short")).agg(F.count("*").alias("n1"))
    fine = codes.groupBy("tree", "code").agg(F.count("*").alias("n2"))
    sizes = fine.withColumn("short", short).join(coarse, ["tree", "short"])
    parts = F.ceil(F.col("n2") / (2 * s.leaf))
    leaf = F.when(F.col("n1") <= 4 * s.leaf, F.struct(F.col("short").alias("a"), F.lit(-1).cast("long").alias("b"))).otherwise(
        F.struct((F.col("code") + (1 << more)).alias("a"), F.pmod(F.xxhash64("node", "tree"), parts).alias("b"))
    )
    placed = codes.join(sizes, ["tree", "code"]).select("node", "tree", leaf.alias("leaf")).select("node", "tree", F.col("leaf.a").alias("la"), F.col("leaf.b").alias("lb"))
    return placed.join(vectors.select("node", "v16"), "node")


def _in_leaves(leaves: DataFrame, s: Settings) -> DataFrame:
    """(node, nbr, cos): the nearest nodes inside each leaf."""

    def nearest(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        k = min(s.neighbours, len(ids) - 1)
        for start in range(0, len(ids) if k > 0 else 0, 1024):
            c = x[start : start + 1024] @ x.T
            rows = np.arange(len(c))
            c[rows, start + rows] = -2
            best = np.argpartition(-c, k - 1, axis=1)[:, :k]
            yield np.repeat(ids[start : start + 1024], k), ids[best].ravel(), c[rows[:, None], best].ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _groups(batches, "tree", "la", "lb"):
            ids, x = rows["node"].to_numpy(), _unit16(rows["v16"])
            yield _neighbour_rows([f for a, b in zip(starts, starts[1:]) for f in nearest(ids[a:b], x[a:b])])

    dealt = leaves.repartition("tree", "la", "lb").sortWithinPartitions("tree", "la", "lb", "node")
    return dealt.mapInPandas(run, "node long, nbr long, cos float")


def _lists(found: DataFrame, s: Settings) -> DataFrame:
    """(node, nbr, cos, worst): each node's nearest neighbours; saturated lists are longer.

    ``worst`` is the cosine from which a new neighbour improves the list.
    """
    once = found.groupBy("node", "nbr").agg(F.max("cos").alias("cos"))
    order = Window.partitionBy("node").orderBy(F.desc("cos"), "nbr")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.longest)
    # rank r beyond the plain length stays while the list up to r / 2 is saturated: lists double
    over = F.col("cos") >= s.threshold - SLACK
    saturated = F.max(F.when(over, F.col("rank")).otherwise(0)).over(Window.partitionBy("node"))
    kept = ranked.withColumn("n", F.least(F.lit(s.longest), F.greatest(F.lit(s.neighbours), 2 * saturated))).filter(F.col("rank") <= F.col("n"))
    inside = Window.partitionBy("node")
    full = F.max("rank").over(inside) >= F.col("n")
    return kept.withColumn("worst", F.when(full, F.min("cos").over(inside)).otherwise(-2.0).cast("float")).select("node", "nbr", "cos", "worst")


def _descend(lists: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """(node, nbr, cos): neighbours of neighbours that improve a list.

    The nodes whose lists name a node are dealt into parts of about a plain
    list's length; a group holds the node, its list and one part. All pairs of
    a group of bounded size are compared.
    """
    named = lists.groupBy(F.col("nbr").alias("at")).agg(F.ceil(F.count("*") / s.neighbours).cast("int").alias("parts"))
    own = lists.select(F.col("node").alias("at"), F.explode(F.array("node", "nbr")).alias("node"))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    ahead = own.join(named, "at", "left").select("at", each.alias("part"), "node")
    behind = lists.select(F.col("nbr").alias("at"), "node").join(named, "at").select("at", F.pmod(F.xxhash64("node", "at"), F.col("parts")).cast("int").alias("part"), "node")
    worst = lists.groupBy("node").agg(F.max("worst").alias("worst"))
    known = vectors.select("node", "v16").join(worst, "node", "left")
    groups = ahead.unionByName(behind).distinct().join(known, "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _groups(batches, "at", "part"):
            ids, x, worst = rows["node"].to_numpy(), _unit16(rows["v16"]), rows["worst"].fillna(-2.0).to_numpy()
            found = []
            for i, j in zip(starts, starts[1:]):
                c = x[i:j] @ x[i:j].T
                np.fill_diagonal(c, -2)
                a, b = np.nonzero(c > worst[i:j, None] + 1e-6)
                found.append((ids[i:j][a], ids[i:j][b], c[a, b]))
            yield _neighbour_rows(found)

    dealt = groups.repartition("at", "part").sortWithinPartitions("at", "part", "node")
    return dealt.mapInPandas(run, "node long, nbr long, cos float")


def _audit(vectors: DataFrame, lists: DataFrame, s: Settings) -> float:
    """Share of the true links of sampled nodes, up to the length of a list, that the lists hold."""
    sample = vectors.select("node", "v16").orderBy(F.xxhash64("node", F.lit(s.seed)), "node").limit(s.audited).toPandas()
    if not len(sample):
        return 1.0
    ids, q = sample["node"].to_numpy(), _unit16(sample["v16"])
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))  # s.audited vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for batch in batches:
            if len(batch):
                c = q @ _unit16(batch["v16"]).T
                a, b = np.nonzero(c >= s.threshold)
                other = batch["node"].to_numpy()[b]
                yield pd.DataFrame({"node": ids[a][other != ids[a]], "nbr": other[other != ids[a]]})

    true = vectors.select("node", "v16").mapInPandas(run, "node long, nbr long")
    held = lists.select("node", "nbr", F.lit(1).alias("held"))
    each = true.join(held, ["node", "nbr"], "left").groupBy("node").agg(F.count("*").alias("n"), F.count("held").alias("h"))
    row = each.agg(F.sum(F.least("n", F.lit(s.longest))).alias("n"), F.sum("h").alias("h")).first()
    return 1.0 if not row["n"] else row["h"] / row["n"]


def neighbour_graph(vectors: DataFrame, dim: int, s: Settings) -> tuple[DataFrame, float]:
    """The refined lists (node, nbr, cos, worst) and their audited recall."""
    n = vectors.count()
    lists = None
    for repeat in range(s.repeats):
        found = _in_leaves(_leaves(vectors, dim, n, s, repeat), s)
        if lists is not None:
            found = found.unionByName(lists.select("node", "nbr", "cos"))
        lists = stored(_lists(found, s))
        for _ in range(s.rounds):
            better = _descend(lists, vectors, s)
            new = stored(_lists(lists.select("node", "nbr", "cos").unionByName(better), s))
            changed = new.join(lists.select("node", "nbr"), ["node", "nbr"], "left_anti").count()
            drop_stored(lists)
            lists = new
            if changed <= s.least_change * s.neighbours * n:
                break
        recall = _audit(vectors, lists, s)
        if recall >= s.recall:
            break
    return lists, recall


def _confirmed(lists: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """Edges (u, v) whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cos = (_unit64(batch["v64_u"]) * _unit64(batch["v64_v"])).sum(1)
                yield batch.loc[cos >= s.threshold, ["u", "v"]]

    near = lists.filter(F.col("cos") >= s.threshold - SLACK).select(F.greatest("node", "nbr").alias("u"), F.least("node", "nbr").alias("v")).distinct()
    side = lambda c: vectors.select(F.col("node").alias(c), F.col("v64").alias(f"v64_{c}"))
    return near.join(side("u"), "u").join(side("v"), "v").mapInPandas(run, "u long, v long")


def _cells(members: DataFrame, s: Settings) -> DataFrame:
    """(cell, part, radius, node, v64): nodes of a component dealt to leaders, ``s.radius`` from them at most; a cell is named by its leader."""

    def cover(ids: np.ndarray, x: np.ndarray, blob: np.ndarray, part: int) -> pd.DataFrame:
        cell, radius = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        left = np.arange(len(ids))
        while len(left):
            angle = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
            near = angle <= s.radius
            near[0] = True
            cell[left[near]], radius[left[near]] = ids[left[0]], angle[near].max()
            left = left[~near]
        return pd.DataFrame({"cell": cell, "part": part, "radius": radius, "node": ids, "v64": blob})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _groups(batches, "part", "own"):
            ids, x, blob, part = rows["node"].to_numpy(), _unit64(rows["v64"]), rows["v64"].to_numpy(), rows["part"].to_numpy()
            yield pd.concat([cover(ids[a:b], x[a:b], blob[a:b], part[a]) for a, b in zip(starts, starts[1:])], ignore_index=True)

    blocks = F.ceil(F.col("m") / s.block)
    dealt = members.join(members.groupBy("part").agg(F.count("*").alias("m")), "part").select("node", "part", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), "v64")
    return dealt.repartition("part", "own").sortWithinPartitions("part", "own", "node").mapInPandas(run, "cell long, part long, radius double, node long, v64 binary")


REACH = 1e-5  # angle added to what cells may be apart, over the rounding of angles


def _bridges(lists: DataFrame, parts: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """Edges (u, v) that join components through open nodes, one at least for each two cells that hold a link.

    parts: (node, part). A node is open if its list holds nothing under the
    threshold, so that links may follow after the list's end. Angles obey the
    triangle inequality: cells whose leaders lie further apart than both radii
    and the threshold's angle hold no link between them.
    """
    opened = lists.groupBy("node").agg(F.min("cos").alias("least")).filter(F.col("least") >= s.threshold - SLACK).select("node")
    members = parts.select("node", "part").join(opened, "node").join(vectors.select("node", "v64"), "node")
    held = stored(_cells(members, s))
    leaders = held.filter("cell = node").select("cell", "part", "radius", "v64")
    n_blocks = max(1, -(-leaders.count() // s.cells))
    own = F.pmod(F.xxhash64("cell"), F.lit(n_blocks)).cast("int")
    dealt = leaders.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    angle = float(np.arccos(np.clip(s.threshold, -1, 1)))

    def reach(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        x, radius, part, cell, block = _unit64(g["v64"]), g["radius"].to_numpy(), g["part"].to_numpy(), g["cell"].to_numpy(), g["own"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = [(cell[:0], cell[:0])]
        for start in range(0, len(left), 512):
            own = left[start : start + 512]
            apart = np.arccos(np.clip(x[own] @ x[right].T, -1, 1))
            a, b = np.nonzero((apart <= radius[own, None] + radius[right] + angle + REACH) & (part[own, None] != part[right]))
            out.append((cell[own][a], cell[right][b]))
        a, b = (np.concatenate(o) for o in zip(*out))
        keep = a < b if i == j else slice(None)
        return pd.DataFrame({"a": a[keep], "b": b[keep]})

    near = stored(dealt.groupBy("i", "j").applyInPandas(reach, "a long, b long"))
    sides = [near.join(held.select(F.col("cell").alias(c), "node", "v64"), c).select("a", "b", F.lit(c == "a").alias("first"), "node", "v64") for c in ("a", "b")]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _groups(batches, "a", "b"):
            x, first, ids = _unit64(rows["v64"]), rows["first"].to_numpy(), rows["node"].to_numpy()
            found = []
            for i, j in zip(starts, starts[1:]):
                left, right = i + np.flatnonzero(first[i:j]), i + np.flatnonzero(~first[i:j])
                cos = x[left] @ x[right].T
                best = np.unravel_index(cos.argmax(), cos.shape)
                if cos[best] >= s.threshold:
                    found.append((ids[left[best[0]]], ids[right[best[1]]]))
            yield pd.DataFrame(found, columns=["u", "v"], dtype=np.int64)

    both = sides[0].unionByName(sides[1]).repartition("a", "b").sortWithinPartitions("a", "b")
    return both.mapInPandas(linked, "u long, v long")


def _audit_parts(vectors: DataFrame, parts: DataFrame, s: Settings) -> float:
    """Share of all true links of sampled nodes whose ends lie in one component of (node, part): those are counted."""
    sample = vectors.select("node", "v64").orderBy(F.xxhash64("node", F.lit(s.seed)), "node").limit(s.audited).toPandas()
    if not len(sample):
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast((sample["node"].to_numpy(), _unit64(sample["v64"])))  # s.audited vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for batch in batches:
            if len(batch):
                a, b = np.nonzero(q @ _unit64(batch["v64"]).T >= s.threshold)
                yield pd.DataFrame({"node": ids[a], "other": batch["node"].to_numpy()[b]})

    true = vectors.select("node", "v64").mapInPandas(run, "node long, other long").filter("node <> other")
    ends = true.join(parts.select("node", "part"), "node").join(parts.select(F.col("node").alias("other"), F.col("part").alias("part_o")), "other")
    row = ends.agg(F.count("*").alias("n"), F.count_if(F.col("part") == F.col("part_o")).alias("h")).first()
    return 1.0 if not row["n"] else row["h"] / row["n"]


def _labels(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``nodes`` with the smallest node of each one's component as ``part``."""
    return nodes.join(components.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))


def _counted(parts: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """(node, n_links): links to rows of other nodes, counted over all pairs of each component in blocks.

    parts: (node, part, size), size being the rows of the node's class. A
    component is cut into blocks by hash, and each pair of blocks is a group;
    tasks hold one Arrow batch and the group that runs over its end.
    """
    blocks = F.ceil(F.col("m") / s.block).cast("int")
    rows = parts.join(parts.groupBy("part").agg(F.count("*").alias("m")), "part").withColumn("nb", blocks).join(vectors.select("node", "v64"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "v64")

    def counts(own, ids, size, x, i: int, j: int) -> Iterator[tuple]:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        close = x[left] @ x[right].T >= s.threshold
        if i == j:
            np.fill_diagonal(close, False)
            yield ids[left], close @ size[right]
        else:
            yield ids[left], close @ size[right]
            yield ids[right], close.T @ size[left]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, starts in _groups(batches, "part", "i", "j"):
            x, size, own, ids, i, j = _unit64(g["v64"]), *(g[c].to_numpy(np.int64) for c in ("size", "own", "node", "i", "j"))
            found = [f for a, b in zip(starts, starts[1:]) for f in counts(own[a:b], ids[a:b], size[a:b], x[a:b], i[a], j[a])]
            yield pd.DataFrame({"node": np.concatenate([f[0] for f in found]), "n": np.concatenate([f[1] for f in found])})

    dealt = rows.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node")
    return dealt.mapInPandas(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per vector.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths do not link. Rows with
    equal vectors are linked with each other. A repeated id is a vector of its
    own each time; ``kept`` then marks all rows with the component's smallest
    id. A null id takes part under no id: it is kept only if all ids of its
    component are null. Ties between neighbours change no result. Columns of
    other names are ignored; an empty table gives an empty table. While the
    components hold less than ``settings.recall`` of the sampled nodes' true
    links, graphs from other trees add theirs; if ``settings.repairs`` of them
    do not mend it, a RuntimeError says so.
    """
    s = settings
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).withColumn("v", F.when(_valid(F.col("v")), F.col("v")))
    classes = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "v", "first_id", "size"))
    done = None
    for dim in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        own = classes.filter(F.size("v") == dim)
        vectors = stored(_nodes(own))
        nodes = own.select("node", "first_id", "size")
        edges, labelled = None, None
        for attempt in range(s.repairs + 1):
            lists, _ = neighbour_graph(vectors, dim, s if not attempt else replace(s, seed=s.seed + attempt))
            found = _confirmed(lists, vectors, s)
            known = stored(found if edges is None else found.unionByName(edges))
            components = connected_components(known)
            rough = stored(_labels(nodes, components))
            bridges = stored(_bridges(lists, rough, vectors, s))
            joined = connected_components(components.unionByName(bridges))
            if edges is not None:
                drop_stored(edges, labelled)
            edges, labelled = stored(known.unionByName(bridges)), stored(_labels(nodes, joined))
            drop_stored(lists, known, components, rough, bridges, joined)
            held = _audit_parts(vectors, labelled, s)
            if held >= s.recall:
                break  # else other trees add their links to those that are known
        drop_stored(edges)
        if held < s.recall:
            raise RuntimeError(f"components hold {held:.4f} of the audited links of vectors of length {dim}, under {s.recall}")
        smallest = labelled.groupBy("part").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m"))
        linked = labelled.join(smallest.filter("m > 1").select("part"), "part", "left_semi").select("node", "part", "size")
        counts = _counted(linked, vectors, s)
        result = labelled.join(smallest, "part").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
        done = result if done is None else done.unionByName(result)
    if done is None:
        joined = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        of_class = stored(classes.select("node", "v").join(done, "node").drop("node"))
        joined = rows.join(of_class, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
