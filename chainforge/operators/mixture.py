"""Categorical mixture models over encoded, equally long gapped sequences.

A model is mu[K, L, 21] and weights[K]. For a batch of n sequences the log joint is one product of their one-hot matrix (n x L*21)
with log mu (L*21 x K). Masked positions have no one-hot column, so they drop out of every product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainforge.functions.alphabet import ALPHABET, encode, mask_gaps, mask_positions, mask_terminal_gaps
from chainforge.functions.positions import Template
from chainforge.runtime import store

LETTERS = len(ALPHABET)
CLIP = 1e-16


def logsumexp(x: np.ndarray) -> np.ndarray:
    """Over axis 0."""
    top = x.max(0)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(0)) + top


def _codes(column: pa.Array, length: int) -> np.ndarray:
    """n x length codes, -1 where masked."""
    flat = column.flatten().cast(pa.int32()).fill_null(-1).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), length)


def _one_hot(codes: np.ndarray) -> np.ndarray:
    n, length = codes.shape
    out = np.zeros((n, length, LETTERS))
    r, p = np.nonzero(codes >= 0)
    out[r, p, codes[r, p]] = 1
    return out.reshape(n, -1)


def masked(codes: Column, mask: Column | None = None, mask_terminal: bool = False, mask_all_gaps: bool = False) -> Column:
    """Codes under a user mask (true: keep), without terminal gaps or without any gaps (M1-M3)."""
    if mask_terminal:
        codes = mask_terminal_gaps(codes)
    if mask_all_gaps:
        codes = mask_gaps(codes)
    return codes if mask is None else mask_positions(codes, mask)


@dataclass
class Fit:
    """What an EM run ended with."""

    log_likelihood: float
    iterations: int
    converged: bool


class CategoricalMixture:
    """A model of n_components clusters over sequences of one length."""

    def __init__(self, n_components: int, sequence_length: int = 0, template: Template | None = None, region: str = "all"):
        """The length is given, or follows from a template and a region of it."""
        if n_components < 1:
            raise ValueError("a model has at least one component")
        if template is not None:
            sequence_length = template.region_size(region)
        if sequence_length < 1:
            raise ValueError("the sequence length is not positive")
        self.n_components, self.length, self.template, self.region = n_components, sequence_length, template, region
        self.mu: np.ndarray | None = None
        self.weights: np.ndarray | None = None

    # parameters

    def load(self, mu: np.ndarray, weights: np.ndarray) -> CategoricalMixture:
        mu, weights = np.asarray(mu, float), np.asarray(weights, float)
        if mu.shape != (self.n_components, self.length, LETTERS) or weights.shape != (self.n_components,):
            raise ValueError(f"expected shapes {(self.n_components, self.length, LETTERS)} and {(self.n_components,)}")
        self.mu, self.weights = mu, weights
        return self

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        if self.mu is None:
            raise RuntimeError("the model has not been fitted")
        return self.mu, self.weights

    def specs(self) -> dict:
        return {"n_components": self.n_components, "sequence_length": self.length, "alphabet": ALPHABET, "fitted": self.mu is not None}

    def initialise(self, seed: int) -> CategoricalMixture:
        """Random weights and profiles that sum to one."""
        rng = np.random.default_rng(seed)
        w = rng.uniform(0.5, 1.5, self.n_components)
        mu = rng.uniform(0.5, 1.5, (self.n_components, self.length, LETTERS))
        return self.load(mu / mu.sum(2, keepdims=True), w / w.sum())

    def prune(self, least: float = 1e-16) -> CategoricalMixture:
        """The model without clusters of no weight; the others keep their numbers' order and values."""
        mu, w = self.parameters()
        keep = w > least
        self.n_components = int(keep.sum())
        return self.load(mu[keep], w[keep])

    def to_tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(k, pos, aa, p) and (k, w)."""
        mu, w = self.parameters()
        rows = [(k, p, ALPHABET[a], float(mu[k, p, a])) for k in range(self.n_components) for p in range(self.length) for a in range(LETTERS)]
        return spark.createDataFrame(rows, "k int, pos int, aa string, p double"), spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k int, w double")

    @classmethod
    def from_tables(cls, mu: DataFrame, weights: DataFrame) -> CategoricalMixture:
        w = {r["k"]: r["w"] for r in weights.select("k", "w").collect()}
        rows = mu.select("k", "pos", "aa", "p").collect()
        order = {k: i for i, k in enumerate(sorted(w))}
        out = np.zeros((len(w), 1 + max(r["pos"] for r in rows), LETTERS))
        for r in rows:
            out[order[r["k"]], r["pos"], ALPHABET.index(r["aa"])] = r["p"]
        return cls(len(w), out.shape[1]).load(out, np.array([w[k] for k in order]))

    # encoding (E1)

    def encode(self, seq: Column) -> Column:
        return encode(seq, self.length)

    # scoring (M4-M6)

    def _log(self, use_weights: bool = True) -> tuple[np.ndarray, np.ndarray]:
        mu, w = self.parameters()
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(mu, CLIP)).reshape(self.n_components, -1).T.copy(), np.log(w) if use_weights else np.zeros(self.n_components)

    def _apply(self, df: DataFrame, codes: Column, make, name: str, kind: T.DataType, arrow: pa.DataType, use_weights: bool = True) -> DataFrame:
        """df with a column made from each batch's log joint (n x K) and codes; null codes give null."""
        shared = df.sparkSession.sparkContext.broadcast(self._log(use_weights))
        length = self.length
        rest = [c for c in df.columns if c != name]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_mu, log_w = shared.value
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                at = np.flatnonzero(np.asarray(column.is_valid()))
                out: list = [None] * batch.num_rows
                for s in range(0, len(at), 2000):
                    part = at[s : s + 2000]
                    x = _codes(column.take(pa.array(part)), length)
                    for i, v in zip(part, make(_one_hot(x) @ log_mu + log_w, x)):
                        out[i] = v
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, arrow)], names=[*rest, name])

        return df.select(*rest, codes.alias("__x")).mapInArrow(run, df.select(*rest).schema.add(name, kind))

    def score(self, df: DataFrame, codes: Column, normalise: bool = False, name: str = "score") -> DataFrame:
        """df with the log likelihood of each sequence, or that divided by its unmasked positions (null without any)."""

        def make(joint: np.ndarray, x: np.ndarray):
            s = logsumexp(joint.T)
            if normalise:
                n = (x >= 0).sum(1)
                return [float(v / k) if k else None for v, k in zip(s, n)]
            return s.tolist()

        return self._apply(df, codes, make, name, T.DoubleType(), pa.float64())

    def predict(self, df: DataFrame, codes: Column, use_weights: bool = True, name: str = "cluster") -> DataFrame:
        """df with the most likely cluster, the first of equal ones."""
        return self._apply(df, codes, lambda joint, x: joint.argmax(1).tolist(), name, T.IntegerType(), pa.int32(), use_weights)

    def log_joint(self, df: DataFrame, codes: Column, name: str = "log_joint") -> DataFrame:
        """df with array<double> of log weight + log likelihood by cluster."""
        return self._apply(df, codes, lambda joint, x: joint.tolist(), name, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))

    # fitting (M7, M10, M15)

    def em_step(self, encoded: DataFrame, codes: str = "codes") -> tuple[float, np.ndarray, np.ndarray]:
        """(lower bound, sums of responsibilities, expected counts[K, L, 21]) of one E-step.

        Partitions are read by as many tasks as the cluster has cores, and every task sends one row a cluster, its counts as bytes, however
        many partitions the table has; these are added by cluster before the model-sized result reaches the driver.
        """
        shared = encoded.sparkSession.sparkContext.broadcast(self._log())
        length, k_all = self.length, self.n_components

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_mu, log_w = shared.value
            bound, resp, counts = 0.0, np.zeros(k_all), np.zeros((k_all, length * LETTERS))
            for batch in batches:
                for s in range(0, batch.num_rows, 2000):
                    x = _one_hot(_codes(batch.column(0).slice(s, 2000), length))
                    joint = x @ log_mu + log_w
                    norm = logsumexp(joint.T)
                    r = np.exp(joint - norm[:, None])
                    bound += norm.sum()
                    resp += r.sum(0)
                    counts += r.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(range(k_all), pa.int32()), pa.array([bound if k == 0 else 0.0 for k in range(k_all)]), pa.array(resp), pa.array([c.tobytes() for c in counts], pa.binary())], names=["k", "bound", "resp", "counts"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, b, r, c in zip(*(col.to_pylist() for col in batch.columns)):
                    e = sums.setdefault(k, [0.0, 0.0, np.zeros(length * LETTERS)])
                    e[0] += b
                    e[1] += r
                    e[2] += np.frombuffer(c)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([e[i] for e in sums.values()]) for i in (0, 1)), pa.array([e[2].tobytes() for e in sums.values()], pa.binary())], names=["k", "bound", "resp", "counts"])

        ddl = "k int, bound double, resp double, counts binary"
        tasks = encoded.sparkSession.sparkContext.defaultParallelism
        rows = encoded.select(codes).where(F.col(codes).isNotNull()).coalesce(tasks).mapInArrow(partial, ddl).repartition("k").mapInArrow(total, ddl).collect()
        resp, counts = np.zeros(k_all), np.zeros((k_all, length, LETTERS))
        for r in rows:
            resp[r["k"]] = r["resp"]
            counts[r["k"]] = np.frombuffer(bytes(r["counts"])).reshape(length, LETTERS)
        return float(sum(r["bound"] for r in rows)), resp, counts

    def fit(self, df: DataFrame, codes: Column, max_iter: int = 150, tol: float = 1e-3, n_restarts: int = 3, seed: int = 123, prune: bool = True) -> Fit:
        """Expectation maximisation from several random starts; keeps the best by likelihood.

        The encoded data are written once to the shared folder and read in each iteration, so they may exceed memory. Stops when the mean
        log likelihood changes by less than tol.
        """
        encoded = store(df.select(codes.alias("codes")).where("codes IS NOT NULL"))
        n = encoded.count()
        if not n:
            raise ValueError("no sequences to fit")
        best: tuple[float, np.ndarray, np.ndarray, Fit] | None = None
        for restart in range(n_restarts):
            self.initialise(seed + restart)
            last, done = -np.inf, False
            for it in range(1, max_iter + 1):
                bound, resp, counts = self.em_step(encoded)
                mu = np.maximum(counts / np.maximum(resp, CLIP)[:, None, None], CLIP)
                self.load(mu / mu.sum(2, keepdims=True), resp / resp.sum())
                if done := abs(bound - last) / n < tol:
                    break
                last = bound
            if best is None or bound > best[0]:
                best = bound, self.mu, self.weights, Fit(bound, it, bool(done))
        self.load(best[1], best[2])
        if prune:
            self.prune()
        return best[3]

    def information(self, df: DataFrame, codes: Column) -> dict[str, float]:
        """bic = p ln n - 2 ln L, aic = 2 p - 2 ln L with p = (K - 1) + 20 K L; lower is better."""
        r = self.score(df.select(codes.alias("codes")), F.col("codes")).agg(F.sum("score").alias("s"), F.count("score").alias("n")).first()
        p = self.n_components - 1 + (LETTERS - 1) * self.n_components * self.length
        return {"bic": p * float(np.log(r["n"])) - 2 * r["s"], "aic": 2 * p - 2 * r["s"]}

    # profiles (M14)

    def profiles(self, df: DataFrame, seq: str) -> DataFrame:
        """k, pos, aa, count over the sequences' most likely clusters; blank sequences (null or empty) are left out."""
        rows = self.predict(df.where(F.length(seq) > 0).select(seq), self.encode(F.col(seq)))
        return rows.select(F.col("cluster").alias("k"), F.posexplode(F.split(seq, "")).alias("pos", "aa")).groupBy("k", "pos", "aa").agg(F.count("*").alias("count"))

    def assign(self, df: DataFrame, seq: str) -> DataFrame:
        """df with cluster, -1 for blank sequences."""
        blank = F.coalesce(F.length(seq), F.lit(0)) == 0
        out = self.predict(df, F.when(~blank, self.encode(F.when(~blank, F.col(seq)))))
        return out.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
