"""Merkle manifest of a dataset: a 16-ary hash tree per source, and one over the sources.

Leaves hash the fields of a row. Within a source they are ranked by key: rows are
dealt by key range, numbered inside each range, and the ranges' sizes summed up.
The digits of the rank in base 16 are the columns of the tree: grouping the last
digit away nests up to 16 leaves in the struct of their parent, grouping the next
one away nests the parents, and so on for ``digits`` levels. That makes blocks of
at most 16 ** ``digits`` leaves, all built after a single shuffle. The roots of
the blocks are the nodes of the next tier, rolled up in the same way, until every
source has one root; these are the leaves of a last tree over the sources.

Proofs come back down the tiers without joins: a block and the proof of its own
root are two rows of one group, and one transform and explode over the nested
structs gives each child its siblings. No group holds more than a block.

A proof is an array of steps from the leaf to the root; a step has the node's
position in its run and the digests of the run's other nodes. ``fold`` recomputes
the root from a leaf and its proof.

Defined results: null fields hash as "-"; null keys come first, and equal keys go
by their leaf; rows alike in both are copies with equal leaves, each with a place of its own; a null
source is a source of its own before all others; a source with one row has its
leaf as root; an empty table gives an empty result. Columns that are not hashed,
carried or used as key are not read; names inside are structs of the operator's
own, so extra columns clash with nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import stored

RUN = 16
_STEP = "array<struct<position:int,siblings:array<string>>>"


def field(value: Column) -> Column:
    """A value as text with its length in bytes before it; "-" for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def _height(total: Column) -> Column:
    """Levels above ``total`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(RUN**k) for k in range(16)]), lambda width: width < total))


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (from 0, by ``order``) and ``levels`` of each ``tree``.

    Ranges are numbered apart, so a tree with any share of the rows is spread over all of them.
    """
    held = stored(nodes, "merkle-nodes").withColumn("tie", F.monotonically_increasing_id())  # stable: the rows lie in files
    ranges = stored(held.repartitionByRange("tree", *order, "tie").withColumn("part", F.spark_partition_id()), "merkle-ranges")
    in_order = Window.partitionBy("tree").orderBy("part")  # one row a range
    sizes = ranges.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    sizes = sizes.select("tree", "part", (F.sum("rows").over(in_order) - F.col("rows")).alias("first"), _height(F.sum("rows").over(Window.partitionBy("tree"))).alias("levels"))
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "tie")) - 1
    return ranges.withColumn("within", within).join(sizes, ["tree", "part"]).withColumn("rank", F.col("first") + F.col("within")).drop("tie", "part", "first", "within")


def _parent(children: str, level: int) -> Column:
    """The digest over nested children; a level above the tree's own hands its only child on."""
    digests = F.transform(children, lambda x: x["digest"])
    return F.when(F.col("levels") >= level, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0])


def _roll_up(nodes: DataFrame, digits: int) -> DataFrame:
    """Blocks ``(tree, block, levels, digest, children)`` of nodes ``(tree, rank, levels, digest, load)``; children nest ``digits`` deep."""
    names = [f"digit_{k}" for k in range(digits)]
    split = nodes.select("tree", "levels", "digest", "load", F.expr(f"rank div {RUN**digits}").alias("block"), *[F.expr(f"cast(rank div {RUN**k} % {RUN} as int)").alias(d) for k, d in enumerate(names)])
    rows = split.repartition("tree", "block").withColumn("child", F.struct(F.col("digit_0").alias("place"), "digest", "load"))
    for level in range(1, digits + 1):
        rows = rows.groupBy("tree", "block", "levels", *names[level:]).agg(F.array_sort(F.collect_list("child")).alias("children"))
        rows = rows.withColumn("digest", _parent("children", level))
        if level < digits:
            rows = rows.withColumn("child", F.struct(F.col(names[level]).alias("place"), "digest", "children"))
    return rows


def _step(node: Column, run: Column) -> Column:
    others = F.transform(F.filter(run, lambda x: x["place"] != node["place"]), lambda x: x["digest"])
    return F.struct(node["place"].alias("position"), others.alias("siblings"))


def _open(blocks: DataFrame, digits: int) -> DataFrame:
    """``(tree, rank, digest, load, path, crown)`` of all nodes in blocks that hold ``path`` and ``crown`` of their own root."""
    rows = blocks.withColumn("place", F.col("block"))
    for level in range(digits, 0, -1):
        run, path, at = F.col("children"), F.col("path"), F.col("place")
        here = F.col("levels") >= level

        def opened(x: Column) -> Column:
            own = F.when(here, F.concat(F.array(_step(x, run)), path)).otherwise(path)
            rest = [x["children"].alias("children")] if level > 1 else [x["digest"].alias("digest"), x["load"].alias("load")]
            return F.struct((at * RUN + x["place"]).alias("place"), own.alias("path"), *rest)

        rows = rows.select("tree", "levels", "crown", F.explode(F.transform(run, opened)).alias("x")).select("tree", "levels", "crown", "x.*")
    return rows.withColumnRenamed("place", "rank").drop("levels")


def rise(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """The tiers of blocks, from the leaves to where every tree has one block."""
    tiers: list[DataFrame] = []
    while True:
        tiers.append(stored(_roll_up(nodes, digits), "merkle-blocks"))
        above = tiers[-1].where(F.col("levels") > digits)
        if above.isEmpty():
            return tiers
        nodes = above.select("tree", F.col("block").alias("rank"), (F.col("levels") - digits).alias("levels"), "digest", F.lit(None).cast("boolean").alias("load"))


def _finished(tiers: list[DataFrame], digits: int) -> DataFrame:
    """The root of each tree and the tier that it was reached in."""
    done = [t.where(F.col("levels") <= digits).select("tree", "digest", F.lit(k).alias("tier")) for k, t in enumerate(tiers)]
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result


def descend(tiers: list[DataFrame], crowns: DataFrame, digits: int) -> DataFrame:
    """All leaves with their paths; ``crowns`` has ``(tree, tier, path, crown)`` of every root."""
    opened = None
    for k in range(len(tiers) - 1, -1, -1):
        above = crowns.where(F.col("tier") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "crown")
        if opened is not None:
            above = above.unionByName(opened.select("tree", F.col("rank").alias("block"), "path", "crown"))
        both = tiers[k].select("tree", "block", "levels", "children").unionByName(above, allowMissingColumns=True)
        met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("levels", "children", "path", "crown")])
        opened = _open(met, digits)
    return opened


def manifest(
    documents: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    source: str = "source",
    carry: Mapping[str, Column] | None = None,
    digits: int = 2,
) -> DataFrame:
    """``(key, source, carried columns, leaf, subroot, root, proof)`` of every row."""
    carried = F.struct(F.col(key).alias("key"), F.col(source).alias("source"), F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in (carry or {}).items()]).alias("carried"))
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    leaves = documents.select(tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"), carried.alias("load"))
    tiers = rise(ranked(leaves, ["key", "digest"]).drop("key"), digits)

    subroots = _finished(tiers, digits).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.struct("tree", "tier").alias("load"))
    top = rise(ranked(subroots, ["name"]).drop("name"), digits)
    crown = _finished(top, digits).select("tree", "tier", F.array().cast(_STEP).alias("path"), F.struct(F.col("digest").alias("root")).alias("crown"))
    sources = descend(top, crown, digits)
    crowns = sources.select("load.tree", "load.tier", "path", F.struct(F.col("digest").alias("subroot"), "crown.root").alias("crown"))
    proven = descend(tiers, stored(crowns, "merkle-sources"), digits)
    names = [F.col(f"load.carried.{n}").alias(n) for n in (carry or {})]
    return proven.select(F.col("load.key").alias(key), F.col("load.source").alias(source), *names, F.col("digest").alias("leaf"), "crown.subroot", "crown.root", F.col("path").alias("proof"))


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def parent(below: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], F.lit(1), step["position"])
        after = F.slice(step["siblings"], step["position"] + 1, F.lit(RUN))
        return F.sha2(F.concat(F.array_join(before, ""), below, F.array_join(after, "")), 256)

    return F.aggregate(proof, digest, parent)


def proof_digest(proof: Column) -> Column:
    """One digest over all siblings, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), ""), 256)
