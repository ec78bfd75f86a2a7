"""Near-duplicate vectors: all pairs above a cosine, by a cover tree and its dual traversal.

On unit vectors a cosine is a distance, so covering radii bound it.  Equal vectors
are first drawn together.  Then Spark builds the upper levels of the tree: a cell
with more than LEAF vectors takes a few of them as centres, spread farther than
half its radius while there are such, and its vectors go to the nearest; each cell
knows its covering radius.  Cells that are small enough, or tighter than could be
told apart, become leaves of at most LEAF vectors, with a cover tree of their
own whose radii halve from level to level.

Pairs of nodes are followed from the roots.  A pair goes as soon as its centres
are farther apart than both radii and the threshold; it is counted whole if they
are as much nearer.  What is left in the end are pairs of vectors, whose cosine is
taken in double precision.  A task holds two groups of leaves and follows the pairs between them; it returns each vector's
number of links and a forest that connects what is linked, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, neither do rows with a null id; vectors of
different lengths never link; rows with equal vectors link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventtally.llm.components import Forest, components
from eventtally.llm.tables import stage

COSINE = 0.9
#: Vectors of a leaf, at most.
LEAF = 4_096
#: Centres of a cell, and the vectors they are chosen from (by a hash of the id).
CENTRES, CANDIDATES = 4, 64
#: Far beyond rounding: what bounds decide must be this clear.
CLEAR = 1e-6
#: What the vectors of a group of leaves take as doubles; a task holds two groups.
SIDE_BYTES = 16 << 20
#: Up to this size, by count, a table of cells is broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of a matrix of cosines that are made at once.
ROWS = 512


def usable(vector) -> F.Column:
    """Whether the vector (array of double) can link."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def _spread(units: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows, each the farthest from those before, while farther than half the radius."""
    chosen = [0]
    nearest = _distance(units @ units[0])
    radius = nearest.max()
    while len(chosen) < most and nearest.max() > max(radius / 2, CLEAR):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distance(units @ units[chosen[-1]]))
    return np.array(chosen)


class Tree:
    """A cover tree of the rows of `units`.  Node 0 is the root; the members of a node are order[begin:end]."""

    def __init__(self, units: np.ndarray):
        self.units = units
        self.order = np.arange(len(units))
        self.center, self.radius, self.begin, self.end = [0], [], [0], [len(units)]
        self.children: list[tuple[int, int]] = []
        self.radius.append(float(_distance(units @ units[0]).max()) + CLEAR if len(units) > 1 else 0.0)
        node = 0
        while node < len(self.center):
            self._grow(node)
            node += 1

    def _grow(self, node: int) -> None:
        begin, end, radius = self.begin[node], self.end[node], self.radius[node]
        if end - begin == 1 or radius <= 4 * CLEAR:
            self.children.append((0, 0))
            return
        members = self.order[begin:end]
        first = int(np.flatnonzero(members == self.center[node])[0])
        members[0], members[first] = members[first], members[0]
        own = self.units[members]
        covered = np.zeros(len(members), bool)
        centers = []
        for at in range(0, len(members), ROWS):
            apart = _distance(own[at : at + ROWS] @ own.T)
            for i in range(len(apart)):
                if not covered[at + i]:
                    centers.append(at + i)
                    covered |= apart[i] <= radius / 2
        near = np.empty(len(members), np.int64)
        for at in range(0, len(members), ROWS):
            near[at : at + ROWS] = (own[at : at + ROWS] @ own[centers].T).argmax(axis=1)
        # Copies up to rounding may be nearer to each other than to themselves.
        near[centers] = np.arange(len(centers))
        gap = _distance(np.einsum("ij,ij->i", own, own[centers][near])) + CLEAR
        by_child = np.argsort(near, kind="stable")
        cuts = np.searchsorted(near[by_child], np.arange(len(centers) + 1))
        self.children.append((len(self.center), len(self.center) + len(centers)))
        self.center += members[centers].tolist()
        self.radius += [0.0 if cuts[i + 1] - cuts[i] == 1 else float(gap[by_child[cuts[i] : cuts[i + 1]]].max()) for i in range(len(centers))]
        self.begin += (begin + cuts[:-1]).tolist()
        self.end += (begin + cuts[1:]).tolist()
        self.order[begin:end] = members[by_child]

    def packed(self) -> bytes:
        low, high = np.array(self.children).T
        numbers = [[len(self.center)], self.order, self.center, self.begin, self.end, low, high]
        return np.concatenate(numbers).astype("<i8").tobytes() + np.array(self.radius, "<f8").tobytes()

    @classmethod
    def unpacked(cls, units: np.ndarray, raw: bytes) -> Tree:
        tree = cls.__new__(cls)
        numbers = np.frombuffer(raw, "<i8")
        nodes, points = int(numbers[0]), len(units)
        tree.units, tree.order = units, numbers[1 : 1 + points]
        tree.center, tree.begin, tree.end, low, high = numbers[1 + points : 1 + points + 5 * nodes].reshape(5, nodes)
        tree.children = np.stack([low, high], axis=1)
        tree.radius = np.frombuffer(raw, "<f8")[1 + points + 5 * nodes :]
        return tree

    def opened(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and nodes of a node's children; of its members, without nodes, if it has none."""
        low, high = self.children[node]
        if low == high:
            members = self.order[self.begin[node] : self.end[node]]
            return members, np.zeros(len(members)), np.full(len(members), -1)
        single = np.asarray(self.end[low:high]) - np.asarray(self.begin[low:high]) == 1
        return np.array(self.center[low:high]), np.array(self.radius[low:high]), np.where(single, -1, np.arange(low, high))

    def members(self, point: int, node: int) -> np.ndarray:
        return np.array([point]) if node < 0 else self.order[self.begin[node] : self.end[node]]


class Traversal:
    """Links within a leaf, or between two: counts by vector and a forest."""

    def __init__(self, raw: list[np.ndarray], trees: list[Tree], copies: list[np.ndarray], cosine: float):
        self.raw, self.trees, self.copies, self.cosine = raw, trees, copies, cosine
        self.reach = float(_distance(np.array(cosine)))
        self.same = len(trees) == 1
        self.second = 0 if self.same else 1
        self.base = 0 if self.same else len(raw[0])
        self.counts = [np.zeros(len(r), np.int64) for r in raw]
        self.forest = Forest(sum(len(r) for r in raw))
        self.links: list[tuple[int, int]] = []

    def run(self) -> None:
        a, b = self.trees[0].opened(0), self.trees[self.second].opened(0)
        self.stack = [(a, b, self.same)]
        while self.stack:
            a, b, own = self.stack.pop()
            for at in range(0, len(a[0]), ROWS):
                self._compare(tuple(x[at : at + ROWS] for x in a), b, at if own else None)

    def _compare(self, a, b, own: int | None) -> None:
        """All pairs of two lists of nodes; `own` is where the first list begins in the second, if they are one."""
        first, second = self.trees[0], self.trees[self.second]
        one, other = a[2] < 0, b[2] < 0
        for rows, columns, points in (
            (np.flatnonzero(one), np.flatnonzero(other), True),
            (np.flatnonzero(one), np.flatnonzero(~other), False),
            (np.flatnonzero(~one), np.arange(len(b[0])), False),
        ):
            if not len(rows) or not len(columns):
                continue
            cosines = first.units[a[0][rows]] @ second.units[b[0][columns]].T
            if points:
                i, j = np.nonzero(cosines >= self.cosine - 1e-9)
                i, j, found = rows[i], columns[j], cosines[i, j]
                wanted = np.ones(len(i), bool) if own is None else j > own + i
                self._count(a[0][i[wanted]], b[0][j[wanted]], found[wanted])
                continue
            gap = _distance(cosines)
            reach = a[1][rows][:, None] + b[1][columns]
            near = gap <= self.reach + reach + CLEAR
            if own is not None:
                near &= columns > own + rows[:, None]
            for i, j in zip(*np.nonzero(near), strict=True):
                clear = gap[i, j] + reach[i, j] < self.reach - CLEAR
                self._meet(tuple(x[rows[i]] for x in a), tuple(x[columns[j]] for x in b), clear)
        if own is not None:
            for i in np.flatnonzero(~one).tolist():
                if 2 * a[1][i] < self.reach - CLEAR:
                    self._count_within(first.members(a[0][i], a[2][i]))
                else:
                    inside = first.opened(a[2][i])
                    self.stack.append((inside, inside, True))

    def _meet(self, x, y, clear: bool) -> None:
        """Two entries (point, radius, node) that are near: count all their pairs, or open the wider one."""
        first, second = self.trees[0], self.trees[self.second]
        if clear:
            self._count_whole(first.members(x[0], x[2]), second.members(y[0], y[2]))
            return
        left, right = (tuple(np.array([v]) for v in entry) for entry in (x, y))
        if x[2] >= 0 and x[1] >= y[1]:
            left = first.opened(x[2])
        else:
            right = second.opened(y[2])
        self.stack.append((left, right, False))

    def _linked(self, a: np.ndarray, b: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        linked = cosines >= self.cosine
        for k in np.flatnonzero(np.abs(cosines - self.cosine) < 1e-9).tolist():
            x, y = self.raw[0][a[k]], self.raw[self.second][b[k]]
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            linked[k] = np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= self.cosine
        return linked

    def _join(self, i: int, j: int) -> None:
        if self.forest.join(i, j):
            self.links.append((i, j))

    def _count(self, a: np.ndarray, b: np.ndarray, cosines: np.ndarray) -> None:
        """Pairs of vectors, one by one."""
        linked = self._linked(a, b, cosines)
        a, b = a[linked], b[linked]
        np.add.at(self.counts[0], a, self.copies[self.second][b])
        np.add.at(self.counts[self.second], b, self.copies[0][a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            self._join(i, self.base + j)

    def _count_whole(self, a: np.ndarray, b: np.ndarray) -> None:
        self.counts[0][a] += self.copies[self.second][b].sum()
        self.counts[self.second][b] += self.copies[0][a].sum()
        for j in b.tolist():
            self._join(int(a[0]), self.base + j)
        for i in a.tolist():
            self._join(i, self.base + int(b[0]))

    def _count_within(self, members: np.ndarray) -> None:
        copies = self.copies[0][members]
        self.counts[0][members] += copies.sum() - copies
        for j in members[1:].tolist():
            self._join(int(members[0]), j)


def _sizes(units: DataFrame) -> DataFrame:
    """(of, n, width): the vectors of each cell, written as several jobs use it."""
    counted = units.groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"))
    return stage(counted, "sizes")


def _sent(cells: DataFrame, size: int) -> DataFrame:
    """A table with a row a cell, broadcast if it is counted to be small, so that the vectors are not shuffled to meet it."""
    return F.broadcast(cells) if size <= BROADCAST_BYTES else cells


def _upper_levels(points: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """The points with their leaf, and the cells: node, parent, center, radius."""
    units = points.withColumn("node", F.concat(F.lit("d"), F.size("vector").cast("string")))
    cells = None
    reach = float(_distance(np.array(cosine)))
    level_radius = 2.0
    while level_radius > reach / 8:
        sizes = _sizes(units).where(F.col("n") > LEAF)
        many, width = sizes.agg(F.count(F.lit(1)), F.max("width")).first()
        if not many:
            break
        # A cell's row in what its vectors meet: its name, and its centres.
        cell_bytes = many * (200 + 8 * CENTRES * width)
        ranked = units.join(_sent(sizes, cell_bytes), F.col("node") == F.col("of"), "left_semi").withColumn(
            "rank", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id"), "id"))
        )
        seeds = ranked.where(F.col("rank") <= CANDIDATES).groupBy("node").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "vector"))), lambda x: x["vector"]).alias("seeds")
        ).select(F.col("node").alias("of"), "seeds")

        def centred(batches):
            for batch in batches:
                out = []
                for seeds in batch.column("seeds"):
                    unit = _unit(_matrix(seeds.values))
                    out.append(unit[_spread(unit, CENTRES)].tolist())
                yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["of", "centres"])

        centres = seeds.mapInArrow(centred, "of string, centres array<array<double>>")

        def nearest(vectors: pa.Array, centres: pa.Array) -> pa.Array:
            child, gap = np.full(len(vectors), -1), np.zeros(len(vectors))
            known: dict[bytes, list[int]] = {}
            for i, c in enumerate(centres):
                if c.is_valid:
                    known.setdefault(_matrix(c.values).tobytes(), []).append(i)
            for raw, rows in known.items():
                vectors_ = _unit(_matrix(vectors.take(pa.array(rows))))
                cosines = vectors_ @ np.frombuffer(raw, np.float64).reshape(-1, vectors_.shape[1]).T
                child[rows] = cosines.argmax(axis=1)
                gap[rows] = _distance(cosines.max(axis=1)) + CLEAR
            return pa.StructArray.from_arrays([pa.array(child.astype(np.int32)), pa.array(gap)], ["child", "gap"])

        assign = F.arrow_udf(nearest, "struct<child:int,gap:double>", F.ArrowUDFType.SCALAR)
        placed = units.join(_sent(centres, cell_bytes), F.col("node") == F.col("of"), "left").withColumn(
            "to", assign(F.col("vector").cast("array<double>"), F.col("centres"))
        )
        moved = F.col("to.child") >= 0
        placed = stage(placed.select(
            "id", "vector", "copies", F.when(moved, F.concat("node", F.lit("/"), F.col("to.child").cast("string"))).otherwise(F.col("node")).alias("node"),
            F.when(moved, F.col("node")).alias("parent"), F.when(moved, F.col("centres")[F.col("to.child")]).alias("center"), F.col("to.gap").alias("gap"),
        ), "cells")
        made = placed.where(F.col("parent").isNotNull()).groupBy("node", "parent").agg(
            F.first("center").alias("center"), F.max("gap").alias("radius")
        )
        cells = made if cells is None else cells.unionByName(made)
        units = placed.select("id", "vector", "copies", "node")
        level_radius /= 2
    return units, cells


def _leaves(units: DataFrame, kind: str) -> DataFrame:
    """One row a leaf: node, parent, center, radius, and its vectors with ids and copies."""
    sizes = _sizes(units).select("of", F.ceil(F.col("n") / LEAF).cast("long").alias("blocks"))
    blocks = units.join(_sent(sizes, 200 * sizes.count()), F.col("node") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def leaf(group: pa.Table) -> pa.Table:
        unit = _unit(_matrix(group.column("vector")))
        node = group.column("node")[0].as_py()
        return pa.table({
            "node": [f"{node}#{group.column('block')[0].as_py()}"], "parent": [node], "center": [unit[0].tolist()],
            "radius": [float(_distance(unit @ unit[0]).max()) + CLEAR],
            "ids": [group.column("id").to_numpy().astype("<i8").tobytes()],
            "copies": [group.column("copies").to_numpy().astype("<i8").tobytes()],
            "vectors": [_matrix(group.column("vector")).astype(kind).tobytes()], "tree": [Tree(unit).packed()],
        })

    return blocks.select("node", "block", "id", "copies", "vector").groupBy("node", "block").applyInArrow(
        leaf, "node string, parent string, center array<double>, radius double, ids binary, copies binary, vectors binary, tree binary"
    )


def _node_pairs(cells: DataFrame | None, leaves: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) of leaves, a <= b, that may hold links, by traversal of the upper levels."""
    nodes = leaves.select("node", "parent", "center", "radius")
    depth = 1
    if cells is not None:
        nodes = nodes.unionByName(cells)
    nodes = stage(nodes, "nodes")
    if cells is not None:
        depth = nodes.agg(F.max(F.size(F.split("parent", "/")))).first()[0] or 1
    # A leaf is its own child, so that it waits for the other side to come down.
    children = nodes.unionByName(nodes.where(F.col("node").contains("#")).withColumn("parent", F.col("node")))
    roots = nodes.where(~F.col("parent").contains("/")).select("parent").distinct()
    pairs = roots.select(F.col("parent").alias("a"), F.col("parent").alias("b"))
    reach = float(_distance(np.array(cosine)))
    for _ in range(depth):
        sides = []
        for side in "ab":
            sides.append(children.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "parent", "center", "radius")]))
        joined = pairs.join(sides[0], F.col("a") == F.col("a_parent")).join(sides[1], F.col("b") == F.col("b_parent"))
        gap = F.sqrt(F.aggregate(
            F.zip_with("a_center", "b_center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x
        ))
        near = gap <= F.col("a_radius") + F.col("b_radius") + F.lit(reach + CLEAR)
        once = (F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node"))
        pairs = stage(joined.where(near & once).select(
            F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")
        ).distinct(), "node-pairs")
    return pairs


def links(points: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, n) from the distinct `points` (id, vector, copies): n links of a if b is null, else a link of the forest."""
    kind = "<f4" if dict(points.dtypes)["vector"] == "array<float>" else "<f8"
    units, cells = _upper_levels(points, cosine)
    leaves = stage(_leaves(units, kind), "leaves")
    pairs = _node_pairs(cells, leaves, cosine)
    # Leaves are dealt to groups and pairs of leaves to pairs of groups, so a leaf travels once a group, not once a partner.
    size = leaves.agg(F.count(F.lit(1)).alias("leaves"), F.max(F.size("center")).alias("width")).first()
    held = max(1, SIDE_BYTES // (8 * LEAF * (size["width"] or 1)))
    parallel = leaves.sparkSession.sparkContext.defaultParallelism
    groups = max(math.ceil(size["leaves"] / held), math.ceil(math.sqrt(2 * parallel)))
    one, other = (F.pmod(F.xxhash64(side), F.lit(groups)) for side in "ab")
    dealt = pairs.select(F.least(one, other).alias("row"), F.greatest(one, other).alias("column"), "a", "b")
    wanted = dealt.select(
        F.col("row").alias("to_row"), F.col("column").alias("to_column"), F.explode(F.array("a", "b")).alias("leaf")
    ).distinct()
    blobs = leaves.select(F.col("node").alias("of"), "ids", "copies", "vectors", "tree")
    sent = wanted.join(blobs, F.col("leaf") == F.col("of")).drop("of")

    def traverse(held: pa.Table, pairs: pa.Table) -> pa.Table:
        place = {name: i for i, name in enumerate(held.column("leaf").to_pylist())}
        ids = [np.frombuffer(x, "<i8") for x in held.column("ids").to_pylist()]
        copies = [np.frombuffer(x, "<i8") for x in held.column("copies").to_pylist()]
        raw = [np.frombuffer(x, kind).astype(np.float64).reshape(len(i), -1) for x, i in zip(held.column("vectors").to_pylist(), ids, strict=True)]
        trees = [Tree.unpacked(_unit(r), x) for r, x in zip(raw, held.column("tree").to_pylist(), strict=True)]
        spots = np.split(np.arange(sum(map(len, ids))), np.cumsum([len(i) for i in ids])[:-1])
        every = np.concatenate(ids)
        counts, forest, kept = np.zeros(len(every), np.int64), Forest(len(every)), []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            own = [place[a]] if a == b else [place[a], place[b]]
            found = Traversal([raw[i] for i in own], [trees[i] for i in own], [copies[i] for i in own], cosine)
            found.run()
            for i, linked in zip(own, found.counts, strict=True):
                counts[spots[i]] += linked
            both = np.concatenate([spots[i] for i in own])
            links = both[np.array(found.links, np.int64).reshape(-1, 2)].tolist()
            kept += [(i, j) for i, j in links if forest.join(i, j)]
        some = np.flatnonzero(counts)
        joined = np.array(kept, np.int64).reshape(-1, 2)
        return pa.table({
            "a": pa.array(np.concatenate([every[some], every[joined[:, 0]]])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(every[joined[:, 1]])]),
            "n": pa.array(np.concatenate([counts[some], np.zeros(len(joined), np.int64)])),
        })

    return sent.groupBy("to_row", "to_column").cogroup(dealt.groupBy("row", "column")).applyInArrow(traverse, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    good = usable(F.col("vector").cast("array<double>")) & F.col("id").isNotNull()
    rows = rows.withColumn("vector", F.when(good, F.col("vector")))
    points = stage(
        rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")),
        "distinct-vectors",
    )
    found = stage(links(points, cosine), "links")
    counts = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    told = points.join(counts, F.col("id") == F.col("a"), "left").join(groups, F.col("id") == F.col("node"), "left").select(
        F.col("vector").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "id").alias("component"),
    )
    own = rows.join(told, F.col("vector") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return own.select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
