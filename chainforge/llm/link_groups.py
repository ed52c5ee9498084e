"""One group identifier for records linked directly or over others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chainforge.operators.components import clean_edges, min_label_components
from chainforge.runtime import Stored, store


def _peel(edges: DataFrame, max_depth: int) -> tuple[DataFrame, int, bool] | None:
    """(nodes, their least, whether they are all of the component) around the highest-degree vertex; None without links.

    Ends max_depth links from it, or with a level of less than a hundredth of what is peeled.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    top = both.groupBy("a").count().agg(F.max(F.struct("count", -F.col("a")))).first()[0]
    if top is None:
        return None
    spark, root = edges.sparkSession, -top[1]
    before, now, least = spark.createDataFrame([], "node long"), spark.createDataFrame([(root,)], "node long"), root
    levels, taken = [now], 1
    for _ in range(max_depth):
        # neighbours of a level lie in the level before, in it, or in the next: only those two need be taken away
        near = both.join(now.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        seen = Observation()
        level = Stored(near.join(now.unionAll(before), "node", "left_anti").observe(seen, F.count("*").alias("n"), F.min("node").alias("least")))
        n = seen.get["n"]
        if not n:
            level.drop()
            return reduce(DataFrame.unionAll, levels), least, True
        levels.append(level.df)
        before, now, least, taken = now, level.df, min(least, seen.get["least"]), taken + n
        if n * 100 < taken:  # what is left of the component is a fringe
            break
    return reduce(DataFrame.unionAll, levels), least, False


def link_groups(matches: DataFrame, a: str, b: str, max_depth: int = 8) -> DataFrame:
    """group_id, seq_id: every record linked to at least one other, with the least record of its group.

    Null ends and self-links link nothing; repeated links and either order of the ends are one. The component of the highest-degree
    vertex is peeled off by frontier joins from it, and the edges left after an anti-join are labelled by minimum propagation. The frontier
    is followed for max_depth links, or until it is a fringe of under a hundredth of what is peeled: what is left of the component, such as
    the end of a long chain, hangs on the peeled part as on one vertex in the propagation, which needs about the logarithm of its depth in
    rounds. No links: no rows.
    """
    edges = store(clean_edges(matches, a, b))
    peeled = _peel(edges, max_depth)
    if peeled is None:
        return min_label_components(edges).select(F.col("component").alias("group_id"), F.col("node").alias("seq_id"))
    giant, least, whole = peeled
    if whole:
        rest = edges.join(giant.select(F.col("node").alias("a")), "a", "left_anti")
    else:
        ends = edges
        for end in ("a", "b"):
            marked = giant.select(F.col("node").alias(end), F.lit(least).cast("long").alias(f"{end}_in"))
            ends = ends.join(marked, end, "left").withColumn(end, F.coalesce(f"{end}_in", end)).select("a", "b")
        rest = clean_edges(ends, "a", "b")
    labels = min_label_components(rest)
    group = least
    if not whole:
        found = labels.where(F.col("node") == least).select("component").first()
        group = least if found is None else found[0]
        labels = labels.where(F.col("node") != least)
    giants = giant.select(F.lit(group).cast("long").alias("group_id"), F.col("node").alias("seq_id"))
    return giants.unionAll(labels.select(F.col("component").alias("group_id"), F.col("node").alias("seq_id")))
