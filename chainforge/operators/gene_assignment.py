"""Assignment of V and J genes to numbered sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainforge.functions.alphabet import RESIDUES
from chainforge.functions.genes import SPECIES_CODES
from chainforge.functions.positions import SCHEMES, Template
from chainforge.functions.schemes import to_imgt
from chainforge.functions.substitution import score_matrix

POSITIONS = 128
MAX_GERMLINES = 100_000
#: IMGT numbers of the whole positions 1..128: what germlines are aligned to; insertions have no place in it.
IMGT_CODES = tuple(str(i) for i in range(1, POSITIONS + 1))
_SCHEMA = pa.schema([("v_gene", pa.string()), ("j_gene", pa.string()), ("v_identity", pa.float64()), ("j_identity", pa.float64()), ("gene_species", pa.string())])


def to_imgt_columns(seq: Column, numbering: Column) -> Column:
    """A sequence as 128 characters by IMGT number."""
    return Template(IMGT_CODES, "H", "imgt").align(seq, numbering)


def imgt_numbering(df: DataFrame, numbering: str, chain: str, scheme: str) -> DataFrame:
    """df with the numbering converted to IMGT, so that genes don't depend on the scheme (V9). Null chains keep their codes."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    if scheme == "imgt":
        return df
    at, ch = df.columns.index(numbering), df.columns.index(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [n if n is None or c is None else to_imgt(n, c, scheme) for n, c in zip(batch.column(at).to_pylist(), batch.column(ch).to_pylist())]
            columns = list(batch.columns)
            columns[at] = pa.array(rows, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _one_hot(texts: list[str]) -> np.ndarray:
    """n x (128 * 20) flags; gaps and foreign letters have none."""
    table = np.full(256, -1)
    for k, aa in enumerate(RESIDUES):
        table[ord(aa)] = k
    codes = table[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)].reshape(len(texts), POSITIONS)
    out = np.zeros((len(texts), POSITIONS, 20), np.float32)
    r, p = np.nonzero(codes >= 0)
    out[r, p, codes[r, p]] = 1
    return out


def assign_genes(df: DataFrame, aligned: Column, chain: Column, species: Column, germlines: DataFrame, mode: str = "identity", scores: dict | None = None, only_species: str | None = None) -> DataFrame:
    """df with v_gene, j_gene, v_identity, j_identity, gene_species.

    aligned: 128 characters by IMGT number (``to_imgt_columns``; other schemes are converted first). chain: H, K, L or another letter
    of the germlines. germlines: gene_name, species, chain, segment (V, J), aligned_seq; broadcast, and refused beyond MAX_GERMLINES.

    mode ``identity``: of the positions where the germline has a residue, the share at which the sequence has the same one (a gap
    in the sequence is a mismatch). mode ``evalue``: the sum, over positions where both have a residue, of 4 for equal ones and the
    substitution score else. Names of equally good genes are joined by ``_`` in order. A species that is null or ``unknown`` searches
    all; the J gene is then sought in the species of the best V gene. A null or wrongly long text, or a chain without germlines,
    gives empty names, 0 and ``unknown``. The scores of a batch are two matrix products.
    """
    if mode not in ("identity", "evalue"):
        raise ValueError("mode is identity or evalue")
    if only_species is not None and only_species not in (*SPECIES_CODES, "unknown"):
        raise ValueError(f"unknown species {only_species!r}")
    rows = germlines.select("gene_name", "species", "chain", "segment", "aligned_seq").where(F.length("aligned_seq") == POSITIONS).limit(MAX_GERMLINES + 1).collect()
    if len(rows) > MAX_GERMLINES:
        raise ValueError("too many germlines to broadcast")
    rows = sorted(rows, key=lambda r: r["gene_name"])
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    scores_m = score_matrix(scores)
    new = _SCHEMA.names
    rest = [c for c in df.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], list[tuple]] = {}
        for name, sp, ch, segment, text in shared.value:
            groups.setdefault((ch, segment), []).append((name, sp, text))
        made = {}
        for key, genes in groups.items():
            hot = _one_hot([g[2] for g in genes])
            weight = hot if mode == "identity" else hot @ scores_m.astype(np.float32)
            made[key] = np.array([g[0] for g in genes], object), np.array([g[1] for g in genes], object), weight.reshape(len(genes), -1), hot.sum((1, 2))

        def best(values: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(names of the best by row, their value, the first one's index)."""
            top = values.max(1)
            ties = values >= top[:, None] - 1e-9
            first = ties.argmax(1)
            out = names[first]
            for r in np.flatnonzero(ties.sum(1) > 1):
                out[r] = "_".join(names[ties[r]])
            return out, top, first

        for batch in batches:
            texts, chains, species_ = (c.to_pylist() for c in batch.columns[-3:])
            out: list[tuple] = [("", "", 0.0, 0.0, "unknown")] * len(texts)
            for ch in {c for c in chains if (c, "V") in made and (c, "J") in made}:
                at = [i for i, (t, c) in enumerate(zip(texts, chains)) if c == ch and t is not None and len(t) == POSITIONS]
                for s in range(0, len(at), 2000):
                    part = at[s : s + 2000]
                    x = _one_hot([texts[i] for i in part]).reshape(len(part), -1)
                    v_names, v_species, v_w, v_n = made[ch, "V"]
                    j_names, j_species, j_w, j_n = made[ch, "J"]
                    v, j = (x @ v_w.T).astype(float), (x @ j_w.T).astype(float)
                    if mode == "identity":
                        v, j = v / np.maximum(v_n, 1), j / np.maximum(j_n, 1)
                    wanted = np.array([species_[i] or "unknown" for i in part], object)
                    for asked in set(wanted):
                        may = np.flatnonzero(v_species == asked) if asked != "unknown" else np.arange(len(v_names))
                        rows = np.flatnonzero(wanted == asked)
                        if not may.size:
                            continue
                        v_name, v_top, first = best(v[np.ix_(rows, may)], v_names[may])
                        found = v_species[may[first]]
                        for sp in set(found):
                            mine, j_may = np.flatnonzero(found == sp), np.flatnonzero(j_species == sp)
                            j_name, j_top = np.full(len(mine), "", object), np.zeros(len(mine))
                            if j_may.size:
                                j_name, j_top, _ = best(j[np.ix_(rows[mine], j_may)], j_names[j_may])
                            for k, vn, vt, jn, jt in zip(rows[mine], v_name[mine], v_top[mine], j_name, j_top):
                                out[part[k]] = (vn, jn, float(vt), float(jt), str(sp))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *(pa.array(c, t.type) for c, t in zip(zip(*out), _SCHEMA))] if out else [*batch.columns[:-3], *(pa.array([], t.type) for t in _SCHEMA)], names=[*rest, *new])

    wanted = F.lit(only_species) if only_species else species
    base = df.select(*rest, aligned.alias("__a"), chain.alias("__c"), wanted.alias("__s"))
    ddl = df.select(*rest).schema
    for name in new:
        ddl = ddl.add(name, T.DoubleType() if name.endswith("identity") else T.StringType())
    return base.mapInArrow(run, ddl)


def gene_sequence(germlines: DataFrame, names: DataFrame) -> DataFrame:
    """gene_name, species, aligned_seq for the gene_name and species of ``names``; unknown ones have an empty text (V6)."""
    return names.select("gene_name", "species").join(germlines.select("gene_name", "species", "aligned_seq"), ["gene_name", "species"], "left").select("gene_name", "species", F.coalesce("aligned_seq", F.lit("")).alias("aligned_seq"))


def gene_lists(germlines: DataFrame) -> DataFrame:
    """species, receptor, names, sequences: the whole list by species and receptor, in name order (V7)."""
    pairs = F.array_sort(F.collect_list(F.struct("gene_name", "aligned_seq")))
    return germlines.groupBy("species", "receptor").agg(pairs.alias("p")).select("species", "receptor", F.col("p.gene_name").alias("names"), F.col("p.aligned_seq").alias("sequences"))


def retrieval_dates(germlines: DataFrame) -> DataFrame:
    """species, receptor, retrieved: the date texts of the list's files (V8)."""
    return germlines.select("species", "receptor", "retrieved").distinct()


def gene_comparison(df: DataFrame, row_id: str, aligned: str, germlines: DataFrame) -> DataFrame:
    """row_id, line, description, identity, error, aligned: the sequence (line 0) above each gene assigned to it.

    df: the result of ``assign_genes`` with its 128-character text. Each tied gene is a line.
    """
    sides = F.array(F.struct(F.col("v_gene").alias("g"), F.col("v_identity").alias("i")), F.struct(F.col("j_gene").alias("g"), F.col("j_identity").alias("i")))
    base = df.select(row_id, F.col(aligned).alias("aligned"), "gene_species", F.explode(sides).alias("x"))
    genes = base.select(row_id, "gene_species", F.col("x.i").alias("identity"), F.explode(F.split("x.g", "_")).alias("gene_name")).where("gene_name <> ''")
    named = germlines.select("gene_name", F.col("species").alias("gene_species"), F.col("aligned_seq").alias("aligned"))
    below = genes.join(F.broadcast(named), ["gene_name", "gene_species"], "left").select(row_id, F.lit(1).alias("line"), F.col("gene_name").alias("description"), "identity", F.when(F.col("aligned").isNull(), "unknown gene").alias("error"), "aligned")
    above = df.select(row_id, F.lit(0).alias("line"), F.lit("input").alias("description"), F.lit(None).cast("double").alias("identity"), F.when(F.col("v_gene") == "", "no gene assigned").alias("error"), F.col(aligned).alias("aligned"))
    return above.unionAll(below)


def paired_panel(heavy: DataFrame, light: DataFrame, row_id: str, heavy_width: int, light_width: int) -> DataFrame:
    """row_id, heavy_aligned, heavy_identity, light_aligned, light_identity: both alignments by row.

    Inputs: row_id, aligned, identity. A missing chain is all gaps with identity 0.
    """
    h = heavy.select(row_id, F.col("aligned").alias("heavy_aligned"), F.col("identity").alias("heavy_identity"))
    lt = light.select(row_id, F.col("aligned").alias("light_aligned"), F.col("identity").alias("light_identity"))
    fill = lambda c, w: F.coalesce(c, F.lit("-" * w)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return h.join(lt, row_id, "full").select(row_id, fill("heavy_aligned", heavy_width), zero("heavy_identity"), fill("light_aligned", light_width), zero("light_identity"))

