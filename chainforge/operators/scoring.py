"""Scores, cluster assignment and suggested mutations of annotated chains under mixture models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainforge.functions.alphabet import ALPHABET, GAP, encode
from chainforge.functions.positions import Template, label_of
from chainforge.operators.mixture import CLIP, LETTERS, CategoricalMixture, logsumexp, masked

#: What ``training_set_adjust`` takes from the scores of heavy and light chains.
ADJUSTMENTS = {"H": -59.5617, "L": -33.22445}
NORMALIZATIONS = ("none", "training_set_adjust", "normalize")


def chain_type(chain: Column) -> Column:
    """H or L (kappa counts as light); null for other chains."""
    return F.when(chain == "H", "H").when(chain.isin("K", "L"), "L")


class SequenceScorer:
    """Models by chain type (H, L) with the templates they were fitted on."""

    def __init__(self, models: dict[str, CategoricalMixture], templates: dict[str, Template], normalization: str = "none", adjustments: dict[str, float] | None = None):
        if normalization not in NORMALIZATIONS:
            raise ValueError(f"normalization is one of {NORMALIZATIONS}")
        for c, m in models.items():
            if c not in ("H", "L") or m.length != len(templates[c].codes):
                raise ValueError(f"model and template of {c!r} differ")
        self.models, self.templates, self.normalization = models, templates, normalization
        self.adjustments = ADJUSTMENTS if adjustments is None else adjustments

    def _known(self, chain: str) -> str:
        chain = "L" if chain == "K" else chain
        if chain not in self.models:
            raise ValueError(f"no model for chain {chain!r}")
        return chain

    def standard_positions(self, chain: str) -> tuple[str, ...]:
        """Template codes of a chain (H3)."""
        return self.templates[self._known(chain)].codes

    def standard_mask(self, chain: str, region: str = "fmwk1", cdr_scheme: str = "imgt") -> list[bool]:
        """True at the template positions of a region, by any CDR definition and by prefix (H4)."""
        t = self.templates[self._known(chain)]
        labels = [label_of(c, t.scheme, chain, cdr_scheme) for c in t.codes]
        out = [region == "all" or x.startswith(region) for x in labels]
        if not any(out):
            raise ValueError(f"no region {region!r}")
        return out

    def prepare(self, df: DataFrame, seq: Column, numbering: Column, chain: Column) -> DataFrame:
        """df with chain_type and aligned; null where the chain has no model or the numbering doesn't fit (H2)."""
        usable = F.size(numbering) == F.length(seq)
        aligned = None
        for c, t in self.templates.items():
            hit = usable & (chain_type(chain) == c) & seq.rlike(rf"^[{ALPHABET[:-1]}]+\z")
            value = t.align(seq, numbering)
            aligned = F.when(hit, value) if aligned is None else aligned.when(hit, value)
        return df.withColumn("aligned", aligned).withColumn("chain_type", F.when(F.col("aligned").isNotNull(), chain_type(chain)))

    def diagnostics(self, df: DataFrame, numbering: Column, chain: Column) -> DataFrame:
        """df with gapped (template codes without a letter), unusual (codes outside the template) and chain_type (H5)."""
        gapped = unusual = None
        for c, t in self.templates.items():
            hit = chain_type(chain) == c
            g, u = F.array_except(F.array(*(F.lit(x) for x in t.codes)), numbering), t.unusual(numbering)
            gapped = F.when(hit, g) if gapped is None else gapped.when(hit, g)
            unusual = F.when(hit, u) if unusual is None else unusual.when(hit, u)
        return df.withColumn("gapped", gapped).withColumn("unusual", unusual).withColumn("chain_type", chain_type(chain))

    def score(self, df: DataFrame, masks: dict[str, list[bool]] | None = None, mask_terminal: bool = False, mask_all_gaps: bool = False, mode: str = "score") -> DataFrame:
        """df (of ``prepare``) with ``value``: a score, or a cluster in mode ``assign`` or ``assign_no_weights`` (H6).

        Rows that can't be scored have null. The adjustment applies in mode ``score`` only; ``normalize`` divides by the unmasked positions.
        """
        if mode not in ("score", "assign", "assign_no_weights"):
            raise ValueError("mode is score, assign or assign_no_weights")
        out = None
        for c, m in self.models.items():
            part = df.where(F.col("chain_type") == c)
            keep = F.array(*(F.lit(bool(x)) for x in masks[c])) if masks and c in masks else None
            codes = masked(encode(F.col("aligned"), m.length), keep, mask_terminal, mask_all_gaps)
            if mode == "score":
                got = m.score(part, codes, self.normalization == "normalize", "value")
                if self.normalization == "training_set_adjust":
                    got = got.withColumn("value", F.col("value") - F.lit(self.adjustments[c]))
            else:
                got = m.predict(part, codes, mode == "assign", "value").withColumn("value", F.col("value").cast("double"))
            out = got if out is None else out.unionByName(got)
        rest = df.where(F.col("chain_type").isNull()).withColumn("value", F.lit(None).cast("double"))
        return rest if out is None else out.unionByName(rest)

    def closest_clusters(self, df: DataFrame, row_id: str, n: int = 1) -> DataFrame:
        """row_id, rank (1 the best), cluster, log_joint: the n most likely clusters of each sequence (H7)."""
        if n < 1:
            raise ValueError("n is at least 1")
        out = None
        for c, m in self.models.items():
            got = m.log_joint(df.where(F.col("chain_type") == c).select(row_id, "aligned"), encode(F.col("aligned"), m.length))
            pairs = F.transform("log_joint", lambda v, k: F.struct((-v).alias("v"), k.alias("k")))  # sorted by value, then cluster
            top = F.slice(F.array_sort(pairs), 1, n)
            part = got.select(row_id, F.posexplode(top).alias("rank", "t")).select(row_id, (F.col("rank") + 1).alias("rank"), F.col("t.k").alias("cluster"), (-F.col("t.v")).alias("log_joint"))
            out = part if out is None else out.unionAll(part)
        return out

    def retrieve_cluster(self, cluster: int, chain: str) -> tuple[np.ndarray, float, str]:
        """Profile (1, L, 21), weight and alphabet (H8)."""
        mu, w = self.models[self._known(chain)].parameters()
        return mu[cluster : cluster + 1], float(w[cluster]), ALPHABET

    def residue_probabilities(self, df: DataFrame, row_id: str, cluster: Column) -> DataFrame:
        """row_id, pos, code, aa, log_p, best_aa: every letter under a cluster and the cluster's likeliest letter there.

        The model's columns reach the rows by a broadcast join of clusters x positions rows.
        """
        out = None
        for c, m in self.models.items():
            mu, _ = m.parameters()
            rows = [(k, p, self.templates[c].codes[p], np.log(np.maximum(mu[k, p], CLIP)).tolist(), ALPHABET[int(mu[k, p].argmax())]) for k in range(m.n_components) for p in range(m.length)]
            table = df.sparkSession.createDataFrame(rows, "__k int, pos int, code string, logs array<double>, best_aa string")
            cells = df.where(F.col("chain_type") == c).select(row_id, cluster.alias("__k"), F.posexplode(F.split("aligned", "")).alias("pos", "aa")).where("aa <> '-'")
            part = cells.join(F.broadcast(table), ["__k", "pos"]).select(row_id, "pos", "code", "aa", F.element_at("logs", F.position("aa", F.lit(ALPHABET))).alias("log_p"), "best_aa")
            out = part if out is None else out.unionAll(part)
        return out

    def humanize(self, df: DataFrame, seq: str, numbering: str, s_thresh: float = 1.25, cdr_scheme: str = "kabat", excluded: tuple[str, ...] = ()) -> DataFrame:
        """df (of ``prepare``) with new_score, mutations (``A23_G`` style: letter, 1-based position, letter) and new_seq.

        All positions outside the CDRs (or outside ``excluded`` if given) take the nearest cluster's likeliest letter, which scores
        S0. Then changes are taken back one by one, that of the smallest gain first, while the score stays above s_thresh times S0.
        Sequences that can't be scored have nulls.
        """
        models = {c: (np.log(np.maximum(m.parameters()[0], CLIP)), np.log(m.parameters()[1])) for c, m in self.models.items()}
        movable = {}
        for c, t in self.templates.items():
            labels = [label_of(x, t.scheme, c, cdr_scheme) for x in t.codes]
            if excluded:
                movable[c] = np.array([x not in excluded for x in t.codes])
            else:
                movable[c] = np.array([not lab.startswith("cdr") and not (c == "H" and x in ("105", "106")) for x, lab in zip(t.codes, labels)])
        codes_of = {c: t.codes for c, t in self.templates.items()}
        adjust = self.adjustments if self.normalization == "training_set_adjust" else {}
        best_of = {c: log_mu.argmax(2) for c, (log_mu, _) in models.items()}
        shared = df.sparkSession.sparkContext.broadcast((models, movable, codes_of, best_of, adjust))
        rest = [c for c in df.columns if c not in ("new_score", "mutations", "new_seq")]
        at = [rest.index(c) for c in (seq, numbering, "aligned", "chain_type")]

        def one(s: str, num: list[str], aligned: str, c: str, value) -> tuple:
            models, movable, codes_of, best_of, adjust = value
            log_mu, log_w = models[c]
            pos = np.arange(len(aligned))
            x = np.array([ALPHABET.index(a) for a in aligned])

            k = int((log_mu[:, pos, x].sum(1) + log_w).argmax())
            y = np.where(movable[c], best_of[c][k], x)
            joint = log_mu[:, pos, y].sum(1) + log_w  # by cluster; a change of one letter changes it by one column
            score = float(logsumexp(joint[:, None])[0])
            limit = s_thresh * score
            changed = [int(i) for i in np.flatnonzero(y != x)]
            changed.sort(key=lambda i: (log_mu[k, i, y[i]] - log_mu[k, i, x[i]], i))
            for i in changed:
                trial = joint - log_mu[:, i, y[i]] + log_mu[:, i, x[i]]
                now = float(logsumexp(trial[:, None])[0])
                if now <= limit:
                    break
                y[i], joint, score = x[i], trial, now
            where = {code: i for i, code in enumerate(num)}
            mutations, spot = [], 0
            for i, code in enumerate(codes_of[c]):
                spot = where.get(code, spot)
                if y[i] != x[i]:
                    mutations.append(f"{ALPHABET[x[i]]}_{spot + 1}_{ALPHABET[y[i]]}")
            return score - adjust.get(c, 0.0), mutations, "".join(ALPHABET[a] for a in y if a != GAP)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [one(*row, shared.value) if row[2] is not None and row[3] in shared.value[0] else (None, None, None) for row in zip(*(batch.column(i).to_pylist() for i in at))]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string())], names=[*rest, "new_score", "mutations", "new_seq"])

        return df.select(*rest).mapInArrow(run, df.select(*rest).schema.add("new_score", T.DoubleType()).add("mutations", T.ArrayType(T.StringType())).add("new_seq", T.StringType()))

    def sample(self, spark, chain: str, cluster: int, n: int, seed: int = 0) -> DataFrame:
        """id, seq: n sequences drawn from a cluster, gaps stripped."""
        mu = self.models[self._known(chain)].parameters()[0][cluster]
        steps = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in np.cumsum(mu, 1)))

        def letter(row: Column, p: Column) -> Column:
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), p), 11) * F.lit(2.0**-53)
            return F.substring(F.lit(ALPHABET), F.least(F.size(F.filter(row, lambda x: x <= u)) + 1, F.lit(LETTERS)), F.lit(1))

        return spark.range(n).select("id", F.translate(F.array_join(F.transform(steps, letter), ""), "-", "").alias("seq"))

    def consensus(self, chain: str, cluster: int) -> str:
        """The likeliest letters of a cluster, gaps stripped."""
        mu = self.models[self._known(chain)].parameters()[0][cluster]
        return "".join(ALPHABET[int(i)] for i in mu.argmax(1)).replace("-", "")
