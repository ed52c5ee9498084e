"""Connected components of an edge table by minimum propagation.

Alternates two steps on the edges (after Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). In the first every vertex sends
its larger neighbours to the least vertex it knows, by a join. In the second every task contracts the edges it holds, which are dealt out by their
larger ends, to stars around the least vertex of what they link: few edges are so done in one round. Both steps take a vertex of very many edges in
salted pieces. Edges never grow in number, and long chains collapse in about log2(length) rounds where plain label propagation would need their
whole length. The table of each round is written to the shared folder, so that a lost executor costs one round at most; nothing but a count and
a checksum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chainforge.runtime import Stored

#: Edges that a task contracts at once; the stars of more leave it in several pieces, but all edges of a larger end in one.
HELD = 2_000_000
#: A vertex with more edges than this, as larger or as smaller end, is taken in SALTS pieces. What is broadcast has one row for HOT edges at most.
HOT, SALTS = 100_000, 32


def clean_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs a < b: null ends and self-links are left out, either order of the ends is one edge."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex linked to it) for all but the least ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    i, j = at[: len(u)], at[len(u) :]
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        apart = low != high
        i, j = i[apart], j[apart]
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(jumped := label[label], label):
            label = jumped
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _stars(u, v)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) > HELD:
            u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            cut = int(np.searchsorted(u, u[-1])) or len(u)  # sorted by u; the last one may go on
            yield star(u[:cut], v[:cut])
            held = [(u[cut:], v[cut:])]
    if held:
        yield star(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))


def _salted(edges: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(edges with a salt that is not 0 only where ``key`` is hot, the hot keys as ``key``, hot)."""
    hot = F.broadcast(edges.groupBy(key).count().where(F.col("count") > HOT).select(key, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int")
    return edges.join(hot, key, "left").withColumn("salt", salt).drop("hot"), hot


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """Stars of what the edges (n at most) of each task link. All edges of a vertex that isn't hot are in one task, so that it keeps one of them."""
    dealt = _salted(edges, "u", "v")[0].repartition("u", "salt").select("u", "v") if n > HOT else edges.repartition("u")
    return dealt.sortWithinPartitions("u").mapInArrow(_contract, "u long, v long")


def _shortened(edges: DataFrame, n: int) -> DataFrame:
    """Every edge u > v (n at most) led on to the least neighbour of v."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    if n <= HOT:  # no vertex can be hot
        return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    left, hot = _salted(edges, "v", "u")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = least.join(hot, "v", "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v"))


def min_label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: every node of ``edges`` (a < b, see clean_edges) with the least node of its component.

    No edges give no rows. max_rounds is a guard against endless loops only: it raises, it never returns a partial result.
    """
    now: Stored | None = None
    n = edges.count()
    then, state = edges.select(F.col("b").alias("u"), F.col("a").alias("v")), None
    for _ in range(max_rounds):
        seen = Observation()  # the number and a fingerprint of the edges, taken while they are written
        done = Stored(_contracted(then, n).distinct().observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
        if now is not None:
            now.drop()
        now = done
        if seen.get == state or not seen.get["n"]:
            break
        state, n = seen.get, seen.get["n"]
        then = _shortened(now.df, n)
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))

