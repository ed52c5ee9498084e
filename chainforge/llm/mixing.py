"""Mixing sources to target shares of the total size by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainforge.llm.byte_bpe import encode_texts
from chainforge.runtime import store

#: Targets are a list kept by hand; they are broadcast and refused beyond this.
MAX_TARGETS = 10_000
#: Means that one pass over the sizes tries for each source.
GRID = 64
#: The search for a mean ends when the realised tokens are this near to the wanted ones, relatively, or one draw lies between two means.
NEAR = 1e-4


def _cdf(mean: float, n: int) -> tuple[int, list[float]]:
    """(how many of P(N <= 0), ..., P(N <= n - 1) are 0, those strictly between 0 and 1) of a Poisson distribution.

    They are taken in logarithms, as exp(-mean) alone is 0 from a mean of 745 on. A mean of 0 has neither, an infinite one has zeros only.
    """
    if math.isinf(mean):
        return n, []
    if not mean:
        return 0, []
    zeros = min(n, max(0, int(mean - 40 * math.sqrt(mean) - 40)))  # terms below exp(-800)
    out, total, log = [], 0.0, math.log(mean)
    for k in range(zeros, n):
        total += math.exp(k * log - mean - math.lgamma(k + 1))
        if not total:
            zeros += 1
        elif total >= 1.0 or (k > mean and out and total == out[-1]):
            break
        else:
            out.append(total)
    return zeros, out


def _expected(mean: float, cap: int) -> float:
    """The mean of min(N, cap)."""
    zeros, steps = _cdf(mean, cap)
    return zeros + sum(1 - x for x in steps)


def _first_guess(rate: float, cap: int) -> float:
    """The mean at which min(N, cap) is ``rate`` on average."""
    low, high = 0.0, max(1.0, 2 * rate)
    while _expected(high, cap) < rate * (1 - 1e-12) and high < 4 * cap + 1e4:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _expected(mid, cap) < rate else (low, mid)
    return high


def realised(u: np.ndarray, tokens: np.ndarray, means: list[float], cap: int) -> np.ndarray:
    """(tokens, copies) that documents of these uniforms have at each mean, as two rows."""
    order = np.argsort(u)
    above = np.concatenate([np.cumsum(tokens[order][::-1])[::-1], [0]])
    out = np.zeros((2, len(means)), np.int64)
    for j, mean in enumerate(means):
        zeros, steps = _cdf(mean, cap)
        at = np.searchsorted(u[order], steps)
        out[0, j] = zeros * above[0] + above[at].sum()
        out[1, j] = zeros * len(u) + (len(u) - at).sum()
    return out


def _pass(drawn: DataFrame, grids: dict[str, tuple[list[float], int]]) -> dict[str, np.ndarray]:
    """For each source (tokens, copies) at each mean of its grid: one narrow pass, of which every task sends a row for each of its sources."""
    shared = drawn.sparkSession.sparkContext.broadcast(grids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            source = batch.column(0).dictionary_encode()
            which, u, tokens = source.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            for k, name in enumerate(source.dictionary.to_pylist()):
                if name in shared.value:
                    mine = which == k
                    got[name] = got.get(name, 0) + realised(u[mine], tokens[mine], *shared.value[name])
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), *(pa.array([x[i].tolist() for x in got.values()], pa.list_(pa.int64())) for i in (0, 1))], names=["source", "tokens", "copies"])

    parts = drawn.where(F.col("source").isin(list(grids))).select("source", "u", "n_tokens").mapInArrow(run, "source string, tokens array<long>, copies array<long>")
    sums = parts.select("source", F.posexplode(F.arrays_zip("tokens", "copies")).alias("j", "x")).groupBy("source", "j").agg(F.sum("x.tokens").alias("t"), F.sum("x.copies").alias("c"))
    out = {s: np.zeros((2, len(g)), np.int64) for s, (g, _) in grids.items()}
    for s, j, t, c in sums.collect():  # a row for each mean that is tried
        out[s][:, j] = t, c
    return out


def fit_means(drawn: DataFrame, wanted: dict[str, tuple[float, int, int]]) -> dict[str, float]:
    """The mean of each source at which min(N, cap) copies come nearest to the wanted tokens. wanted: source -> (tokens, cap, all tokens).

    The uniforms are fixed, so the tokens grow with the mean, one draw at a time. Each pass tries GRID means between the best two so far,
    until one is near enough or no more than one draw lies between them.
    """
    means = {s: math.inf for s, (w, cap, every) in wanted.items() if w >= cap * every * (1 - 1e-9)}
    bounds: dict[str, tuple[float, float]] = {}
    for s, (w, cap, every) in wanted.items():
        if s not in means:
            guess = _first_guess(w / every, cap)
            bounds[s] = (guess / 8, guess * 8)
    for turn in range(40):
        grids = {}
        for s, (low, high) in bounds.items():
            if s in means:
                continue
            if turn:
                grid = np.linspace(low, high, GRID)
            else:  # closer steps around the guess
                middle = math.sqrt(low * high)
                grid = middle * np.exp(np.sinh(np.linspace(-4, 4, GRID)) / math.sinh(4) * math.log(8))
            grids[s] = (grid.tolist() if turn else [0.0, *grid.tolist()], wanted[s][1])
        if not grids:
            break
        for s, got in _pass(drawn, grids).items():
            grid, w = grids[s][0], wanted[s][0]
            best = int(np.abs(got[0] - w).argmin())
            over = int(np.searchsorted(got[0], w))
            if over == len(grid):  # still too few tokens at the last mean
                if abs(got[0, best] - w) <= NEAR * w:
                    means[s] = grid[best]
                else:
                    bounds[s] = (grid[-1], grid[-1] * 8)
            elif abs(got[0, best] - w) <= NEAR * w or over == 0 or got[1, over] - got[1, over - 1] <= 1 or grid[over] - grid[over - 1] <= 1e-14 * grid[over]:
                means[s] = grid[best]
            else:
                bounds[s] = (grid[over - 1], grid[over])
    for s, (low, high) in bounds.items():
        means.setdefault(s, high)
    return means


def sized(docs: DataFrame, targets: DataFrame, doc_id: Column, source: Column, text: Column, keep_text: bool = False, **tokenizer) -> DataFrame:
    """doc_id, source, n_tokens and, if asked for, text of the documents whose source has a target, stored in the shared folder."""
    named = [r[0] for r in targets.select("source").where("source IS NOT NULL").distinct().limit(MAX_TARGETS + 1).collect()]
    if len(named) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources have targets")
    slim = docs.select(doc_id.alias("d"), source.alias("source"), text.alias("t")).where(F.col("source").isin(named))
    return store(encode_texts(slim, F.col("d"), F.col("t"), counts_only=True, carry=F.col("source"), keep_text=keep_text, **tokenizer).withColumnRenamed("carry", "source"))


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 20240517) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). sizes: see ``sized``. targets: source, target_weight, max_repeats.

    selection: doc_id, copy_no (from 1), source, n_tokens and, if ``sizes`` has it, text, in a global random order that the seed
    fixes; the texts are moved once, by that shuffle. A document is taken as often as the inverse Poisson distribution says for its
    hashed uniform and its source's mean, at most max_repeats times. The mean is the one at which the source's copies hold its share
    (see ``fit_means``), within one draw or NEAR of it: of total_tokens, or if that is null or more than the caps allow, of the largest
    total that they do allow. A source at its cap has every document max_repeats times. A source whose share is under half of its
    first document drawn has none.

    shares: source, target_share, actual_share, n_documents, n_copies, most_repeats, n_tokens, one row per source of ``targets``.
    The shares refer to sources with documents of at least one token; any other source of ``targets`` has an actual share of 0 and
    a null target_share. Sources without a target, with a weight or max_repeats that is null or not above 0, and documents without
    tokens are not selected. Repeated document ids are documents of their own but draw the same number of copies. No documents: an
    empty selection.
    """
    spark = sizes.sparkSession
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) * F.lit(2.0**-53)
    drawn = sizes.where("n_tokens > 0").withColumn("u", uniform)
    rows = [r for r in targets.select("source", "target_weight", "max_repeats").limit(MAX_TARGETS + 1).collect() if r[0] is not None]
    asked = {s: (float(w), int(c)) for s, w, c in rows if w and w > 0 and c and c > 0}
    held = {r[0]: r[1] for r in drawn.where(F.col("source").isin(list(asked))).groupBy("source").agg(F.sum(F.col("n_tokens").cast("long"))).collect()}  # a row a target
    used = {s: x for s, x in asked.items() if s in held}
    weights = sum(w for w, _ in used.values())
    share = {s: w / weights for s, (w, _) in used.items()}
    total = min((c * held[s] / share[s] for s, (_, c) in used.items()), default=0.0)
    if total_tokens is not None:
        total = min(total, float(total_tokens))
    means = fit_means(drawn, {s: (total * share[s], c, held[s]) for s, (_, c) in used.items()})
    steps_df = spark.createDataFrame([(s, *_cdf(means[s], c)) for s, (_, c) in used.items()], "source string, zeros int, steps array<double>")
    copies = F.col("zeros") + F.size(F.filter("steps", lambda c: c <= F.col("u")))
    counted = drawn.join(F.broadcast(steps_df), "source").withColumn("n", copies).where("n > 0")
    text = [c for c in ("text",) if c in sizes.columns]
    selection = counted.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("copy_no"), "source", "n_tokens", *text)
    selection = selection.withColumn("o", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no")).repartitionByRange("o").sortWithinPartitions("o").drop("o")
    got = counted.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("n").alias("n_copies"), F.max("n").alias("most_repeats"), F.sum(F.col("n") * F.col("n_tokens").cast("long")).alias("n_tokens")
    )
    listed = spark.createDataFrame([(r[0], share.get(r[0])) for r in rows], "source string, target_share double")
    every = F.sum("n_tokens").over(Window.partitionBy())  # one row per target
    zero = {c: 0 for c in ("n_documents", "n_copies", "most_repeats", "n_tokens")}
    shares = listed.join(got, "source", "left").fillna(zero).withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(every, F.lit(0)), F.lit(0.0)))
    return selection, shares.select("source", "target_share", "actual_share", "n_documents", "n_copies", "most_repeats", "n_tokens")


__all__ = ["fit_means", "mix", "realised", "sized"]
