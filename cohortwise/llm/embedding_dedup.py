"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are compared within a label by cosine. On unit vectors a cosine of at
least t is a Euclidean distance of at most sqrt(2 - 2 t), so the triangle
inequality holds: two tree nodes whose centres are farther apart than their
covering radii and that distance hold no pair, and two nodes that lie within it
altogether hold only pairs. What remains is decided by the cosine in double
precision.

Equal vectors form one class first; copies are counted, not compared. The upper
levels are made by Spark: a cell with more than ``cell_rows`` classes is divided
among a few of its own vectors, again and again, and pairs of cells are followed
down with the same bounds: a pair that lies within reach altogether is accepted
there, by the numbers and one name of each cell, and none of its vectors is sent
on. The lower levels are cover trees with halving radii inside tasks that hold one
pair of the other cells each. So no task depends on the size of a
label. A task returns the number of links of each class and only as many links as
join its classes.

Defined results: null labels, null vectors, zero vectors, and vectors with null or
non-finite components link with nothing (no links, their own component); vectors
of different lengths are never compared; repeated ids are vectors of their own
that share a name; an empty table gives an empty result. Columns besides id,
label and vector are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.spread import hot_join
from cohortwise.llm.common import cut_lineage
from cohortwise.llm.components import connected_components

#: Bounds allow for rounding; decisions use the cosine itself.
_SLACK = 1e-6
_LEAF, _TILE = 24, 1024


@dataclass
class Node:
    centre: int
    radius: float
    first: int
    last: int
    children: list[Node]


def cover_tree(units: np.ndarray) -> tuple[Node, np.ndarray]:
    """The tree over all rows and the order in which every node holds a run of rows."""
    order: list[int] = []

    def distances(centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units[rows] @ units[centre])))

    def build(centre: int, rows: np.ndarray, away: np.ndarray) -> Node:
        radius, first = float(away.max(initial=0.0)), len(order)
        if len(rows) <= _LEAF or radius <= _SLACK:
            order.extend(rows.tolist())
            return Node(centre, radius, first, len(order), [])
        children, left, next_centre = [], rows, centre
        while len(left):
            away = distances(next_centre, left)
            near = away <= radius / 2
            near[left == next_centre] = True
            children.append(build(next_centre, left[near], away[near]))
            left = left[~near]
            next_centre = int(left[0]) if len(left) else -1
        return Node(centre, radius, first, len(order), children)

    rows = np.arange(len(units))
    root = build(0, rows, distances(0, rows))
    return root, np.array(order)


class _Side:
    """A cell's vectors in tree order with their weights and link counts."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        norms = np.linalg.norm(vectors, axis=1)
        self.root, order = cover_tree(vectors / norms[:, None])
        self.ids, self.weights, self.vectors, self.norms = ids[order], weights[order], vectors[order], norms[order]
        self.units = vectors / norms[:, None]  # centres are numbered as given
        self.until = np.concatenate([[0], np.cumsum(self.weights)])
        self.links = np.zeros(len(ids), np.int64)

    def weight(self, node: Node) -> int:
        return int(self.until[node.last] - self.until[node.first])


class _Joined:
    """Union of ids; keeps the links that joined something."""

    def __init__(self):
        self._root: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        while (up := self._root.setdefault(x, x)) != x:
            self._root[x] = self._root[up]
            x = up
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self._find(a), self._find(b)
        if x != y:
            self._root[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def dual_traversal(one: _Side, other: _Side, threshold: float, joined: _Joined) -> None:
    """Count and join all links between two sides (or within one, when both are the same)."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    same = one is other
    stack = [(one.root, other.root)]

    def all_pairs(p: Node, q: Node) -> None:
        one.links[p.first : p.last] += other.weight(q)
        if p is q:
            one.links[p.first : p.last] -= one.weights[p.first : p.last]
        else:
            other.links[q.first : q.last] += one.weight(p)
        a, b = one.ids[p.first : p.last].tolist(), other.ids[q.first : q.last].tolist()
        for x in b:
            joined.link(a[0], x)
        for x in a[1:]:
            joined.link(x, b[0])

    def leaves(p: Node, q: Node) -> None:
        x, y = slice(p.first, p.last), slice(q.first, q.last)
        cosine = (one.vectors[x] @ other.vectors[y].T) / (one.norms[x][:, None] * other.norms[y][None, :])
        hit = cosine >= threshold
        if p is q:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        one.links[x] += hit @ other.weights[y]
        if p is not q:
            other.links[y] += one.weights[x] @ hit
        a, b = one.ids[x], other.ids[y]
        for i, j in zip(*hit.nonzero()):
            joined.link(int(a[i]), int(b[j]))

    while stack:
        p, q = stack.pop()
        if not p.children and not q.children:
            leaves(p, q)
            continue
        below_p, below_q = p.children or [p], q.children or [q]
        for i in range(0, len(below_p), _TILE):
            rows = below_p[i : i + _TILE]
            at, wide = one.units[[n.centre for n in rows]], np.array([n.radius for n in rows])
            for j in range(i if p is q else 0, len(below_q), _TILE):
                columns = below_q[j : j + _TILE]
                away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (at @ other.units[[n.centre for n in columns]].T)))
                radii = wide[:, None] + np.array([n.radius for n in columns])[None, :]
                near = away <= radii + (reach + _SLACK)
                inside = away + radii <= reach - _SLACK
                if p is q and i == j:
                    near = np.triu(near)
                for a, b in zip(*near.nonzero()):
                    x, y = rows[a], columns[b]
                    if same and x is y:
                        if x.last - x.first == 1:
                            continue
                        if 2 * x.radius <= reach - _SLACK:
                            all_pairs(x, x)
                            continue
                    elif inside[a, b]:
                        all_pairs(x, y)
                        continue
                    stack.append((x, y))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if rows else np.zeros(0)
    return flat.astype(np.float64).reshape(rows, -1)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(vector, lambda x: x / norm)


def _divide(members: DataFrame, sizes: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members of too large cells in new cells, and ``(parent, cell, centre, radius)`` of these."""
    large = sizes.where(F.col("n") > cell_rows).select("cell", "n", F.least(F.lit(64), F.ceil(2 * F.col("n") / cell_rows)).cast("int").alias("parts"), F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    drawn = members.join(large, "cell").where(F.pmod(F.xxhash64("id", F.length("cell")), F.col("n")) < 8 * F.col("parts"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.length("cell")), "id"))
    pivots = cut_lineage(drawn.withColumn("k", rank).where("k <= parts").select(F.col("cell").alias("parent_cell"), F.col("chunks").alias("copies"), "k", F.col("vector").alias("pivot")))
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")
    chunked = members.join(large.select("cell", "chunks"), "cell").withColumn("chunk", chunk)
    copied = pivots.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def nearest(rows: pa.Table, centres: pa.Table) -> pa.Table:
        centres = centres.sort_by("k")
        x, c = _matrix(rows["vector"], len(rows)), _matrix(centres["pivot"], len(centres))
        x, c = x / np.linalg.norm(x, axis=1)[:, None], c / np.linalg.norm(c, axis=1)[:, None]
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ c.T)))
        # equal distances are dealt out by a hash, so that one direction cannot stay together for ever
        jitter = np.array([[xxhash.xxh32_intdigest(f"{i}/{k}") for k in range(len(c))] for i in rows["id"].to_pylist()]) * (1e-9 / 2**32)
        k = (away + jitter).argmin(1)
        return pa.table({"id": rows["id"], "weight": rows["weight"], "vector": rows["vector"], "parent": rows["cell"], "k": pa.array(k + 1, pa.int32()), "away": pa.array(away[np.arange(len(k)), k])})

    schema = f"id long, weight long, vector {members.schema['vector'].dataType.simpleString()}, parent string, k int, away double"
    dealt = chunked.groupBy("cell", "chunk").cogroup(copied.groupBy("parent_cell", "copy")).applyInArrow(nearest, schema)
    dealt = cut_lineage(dealt.withColumn("cell", F.concat_ws("/", "parent", "k")))
    cells = dealt.groupBy("parent", "k", "cell").agg(F.max("away").alias("radius")).join(pivots.select(F.col("parent_cell").alias("parent"), "k", _unit(F.col("pivot")).alias("centre")), ["parent", "k"])
    return dealt.select("id", "weight", "vector", "cell"), cells.select("parent", "cell", "centre", "radius")


_FOUND = "a long, b long, n long"


def _accepted(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows ``(a, b, n)`` as of ``_links`` for pairs of cells all of whose members are linked.

    A member gains the weight of the cells its own is paired with; one link for each pair and one for each member join them.
    """
    totals = members.groupBy("cell").agg(F.sum("weight").alias("whole"), F.min("id").alias("name"))
    sides = pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    gains = sides.join(totals.withColumnRenamed("cell", "b"), "b").groupBy(F.col("a").alias("cell")).agg(F.sum("whole").alias("gained"), F.max(F.col("a") == F.col("b")).alias("own"))
    gaining = hot_join(members.select("id", "weight", "cell"), gains.join(totals.select("cell", "name"), "cell"), ["cell"], "inner", ["id"])
    counted = gaining.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("gained") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("n"))
    none = F.lit(None).cast("long").alias("n")
    one, other = (totals.select(F.col("cell").alias(side), F.col("name").alias(f"name_{side}")) for side in "ab")
    between = pairs.where("a <> b").join(one, "a").join(other, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), none)
    return counted.unionByName(gaining.where("id <> name").select(F.col("id").alias("a"), F.col("name").alias("b"), none)).unionByName(between)


def _cells(members: DataFrame, threshold: float, cell_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members in cells of bounded size, the pairs of cells that may hold links, and ``(a, b, n)`` of those that hold nothing else."""
    wide = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    reach, accepted = wide + _SLACK, members.sparkSession.createDataFrame([], _FOUND)
    pairs = None
    known = None  # centre and radius of the cells so far; undivided labels need none
    while True:
        sizes = cut_lineage(members.groupBy("cell").agg(F.count("*").alias("n")))
        if pairs is None:
            pairs = sizes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
            known = sizes.select("cell", F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("double").alias("radius"))
        open_cells = pairs.select(F.col("a").alias("cell")).union(pairs.select("b")).distinct()
        sizes = sizes.join(open_cells, "cell", "left_semi")
        if sizes.where(F.col("n") > cell_rows).isEmpty():
            return members, pairs, accepted
        inside, cells = _divide(members, sizes, cell_rows)
        divided = cells.select(F.col("parent").alias("cell")).distinct()
        members = cut_lineage(members.join(divided, "cell", "left_anti").select("id", "weight", "vector", "cell").unionByName(inside))
        whole = known.join(divided, "cell", "left_anti")
        below = cut_lineage(whole.select(F.col("cell").alias("parent"), "cell", "centre", "radius").unionByName(cells))
        one, other = (below.select(F.col("parent").alias(s), F.col("cell").alias(f"cell_{s}"), F.col("centre").alias(f"centre_{s}"), F.col("radius").alias(f"radius_{s}")) for s in "ab")
        away = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        near = F.coalesce(away <= F.col("radius_a") + F.col("radius_b") + reach, F.lit(True))
        inside = F.coalesce(away + F.col("radius_a") + F.col("radius_b") <= wide - _SLACK, F.lit(False))
        ordered = (F.col("a") != F.col("b")) | (F.col("cell_a") <= F.col("cell_b"))
        followed = cut_lineage(pairs.join(one, "a").join(other, "b").where(ordered & near).select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), inside.alias("inside")))
        accepted = accepted.unionByName(cut_lineage(_accepted(members, followed.where("inside").drop("inside"))))
        pairs = followed.where("not inside").drop("inside")
        known = below.drop("parent")


def _links(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(a, b, n)``: a link that joins (``n`` null), or the number of links of ``a`` found by a task (``b`` null)."""
    left = pairs.join(members.withColumnRenamed("cell", "a"), "a").withColumn("side", F.lit(0))
    right = pairs.where("a <> b").join(members.withColumnRenamed("cell", "b"), "b").withColumn("side", F.lit(1))
    dealt = left.unionByName(right)

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        side, ids, weights = (rows[c].to_numpy() for c in ("side", "id", "weight"))
        vectors = _matrix(rows["vector"], len(rows))
        sides = [_Side(ids[side == s], weights[side == s], vectors[side == s]) for s in np.unique(side)]
        joined = _Joined()
        dual_traversal(sides[0], sides[-1], threshold, joined)
        counted = [(int(i), int(n)) for s in sides for i, n in zip(s.ids[s.links > 0], s.links[s.links > 0])]
        return pa.table(
            {
                "a": pa.array([x[0] for x in joined.kept] + [x[0] for x in counted], pa.int64()),
                "b": pa.array([x[1] for x in joined.kept] + [None] * len(counted), pa.int64()),
                "n": pa.array([None] * len(joined.kept) + [x[1] for x in counted], pa.int64()),
            }
        )

    return dealt.select("a", "b", "side", "id", "weight", "vector").groupBy("a", "b").applyInArrow(compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every vector."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold lies above 0.5 and is at most 1")
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast(kind).alias("vector"))
    usable = F.col("label").isNotNull() & _usable(F.col("vector"))
    classes = cut_lineage(rows.where(usable).groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")))
    classes = classes.withColumn("id", F.monotonically_increasing_id())  # stable: the rows lie in files now
    members, pairs, accepted = _cells(classes.select("id", "weight", "vector", F.concat_ws("|", F.size("vector").cast("string"), "label").alias("cell")), threshold, cell_rows)
    found = cut_lineage(_links(members, pairs, threshold).unionByName(accepted))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    components = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    named = classes.join(components, "id", "left").join(counts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    judged = named.join(least, "component").select("label", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    keyed = rows.withColumn("vector", F.when(usable, F.col("vector")))
    return keyed.join(judged, ["label", "vector"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
