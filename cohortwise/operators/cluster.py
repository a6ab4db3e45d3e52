"""Engagement clusters on activity words and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.coding import level_position
from cohortwise.functions.nulls import null_safe_join
from cohortwise.functions.ordinal import with_positions
from cohortwise.operators import lloyd, patterns
from cohortwise.operators.grid import count_bits, word_names


def rule_label(engaged: Column, minimum: Sequence[int]) -> Column:
    """C1 from ``minimum[0]`` engaged bins on, C2 from ``minimum[1]``, ..., the rest last."""
    label = None
    for index, least in enumerate(minimum):
        test = engaged >= F.lit(least)
        label = F.when(test, F.lit(f"C{index + 1}")) if label is None else label.when(test, F.lit(f"C{index + 1}"))
    return label.otherwise(F.lit(f"C{len(minimum) + 1}"))


def rule_clusters(words: DataFrame, bins: int, minimum: Sequence[int]) -> DataFrame:
    """``(p_id, cluster, engaged)`` by the number of engaged bins."""
    engaged = count_bits(word_names(bins))
    return words.select("p_id", rule_label(engaged, minimum).alias("cluster"), engaged.alias("engaged"))


def ordered_membership(members: DataFrame, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``members`` in display order: by level as listed, then participant.

    Adds ``position`` (gapless over each group ``by``) and ``row_in_cluster``. Clusters outside the levels come first.
    """
    placed = with_positions(members, [level_position("cluster", levels), F.col("p_id")], by)
    first = members.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # over one row a cluster
    before = F.sum("rows").over(group.orderBy(level_position("cluster", levels))) - F.col("rows")
    starts = first.select(*by, "cluster", before.alias("__first"))
    return null_safe_join(placed, starts, [*by, "cluster"]).withColumn("row_in_cluster", F.col("position") - F.col("__first")).drop("__first")


def _single(words: DataFrame, bins: int) -> DataFrame:
    return patterns.stream_rows(words.withColumnsRenamed({w: f"one_{w}" for w in word_names(bins)}), {"one": bins})


def assign_kmeans(words: DataFrame, bins: int, k: int, seed: int, starts: int = 1) -> DataFrame:
    """``(p_id, raw_cluster, cluster)``: k-means membership and its stable label.

    Clusters are named C1..Ck by falling mean number of engaged bins, ties by
    centroid, so the label does not depend on the arbitrary cluster number.
    """
    rows = _single(words, bins)
    found = lloyd.best(lloyd.fit_all(patterns.weighted_patterns(rows), {"one": bins}, [k], starts, seed))
    return lloyd.assign(rows, {"one": found["one", k]} if found else {}, {"one": bins}).drop("stream")


def wss_curve(words: DataFrame, bins: int, k_max: int = 10, seed: int = 1, starts: int = 1) -> DataFrame:
    """``(k, wss)``: within-cluster sum of squares for k = 1..k_max, the best of ``starts``, all fitted together."""
    weighted = patterns.weighted_patterns(_single(words, bins))
    return lloyd.curve(weighted, lloyd.fit_all(weighted, {"one": bins}, range(1, k_max + 1), starts, seed)).select("k", "wss")


def bin_rate(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of a cluster's participants active in each bin: ``(keys, bin, n, active_rate)``.

    ``members`` has one row per participant with the list ``active`` of active
    bins and the number ``bins`` of all bins. A bin 0 stands for the participant
    as such, so that sizes and hits come out of one aggregate; bins nobody was
    active in are filled from the per-cluster map, which holds at most ``bins`` entries.
    """
    marks = F.explode(F.concat(F.array(F.lit(0)), F.col("active"))).alias("bin")
    hits = members.select(*keys, "bins", marks).groupBy(*keys, "bins", "bin").agg(F.count(F.lit(1)).alias("hits"))
    per_cluster = hits.groupBy(*keys, "bins").agg(
        F.max(F.when(F.col("bin") == 0, F.col("hits"))).alias("n"),
        F.map_from_entries(F.collect_list(F.struct("bin", "hits"))).alias("by_bin"),
    )
    dense = per_cluster.select(*keys, "n", "by_bin", F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin"))
    rate = F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)) / F.col("n")
    return dense.select(*keys, "bin", "n", rate.alias("active_rate"))


def tag_cluster(profile: DataFrame, cluster: str, suffix: str) -> DataFrame:
    """One cluster's rows with the data stream added to the cluster name."""
    return profile.filter(F.col("cluster") == cluster).withColumn("cluster", F.lit(f"{cluster}_{suffix}"))


def stack_streams(profiles: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Row union of per-stream profiles with the stream's label in ``cat``."""
    stacked = None
    for label, profile in profiles.items():
        part = profile.select(*columns).withColumn("cat", F.lit(label))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked
