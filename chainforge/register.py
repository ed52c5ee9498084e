"""The library's functions for SQL users: expressions as SQL functions, Python functions by batches, and a FASTA data source."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from glob import glob

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chainforge.functions.alphabet import RESIDUES
from chainforge.operators.annotate import ANNOTATION, MAB_CHAINS, annotate_batch
from chainforge.operators.mixture import CategoricalMixture, _one_hot, logsumexp
from chainforge.runtime import ship

#: SQL functions: name and arguments, result, expression.
FUNCTIONS = {
    "clean_sequence(s STRING)": ("STRING", "upper(regexp_replace(s, '[^A-Za-z]', ''))"),
    "is_chain_sequence(s STRING)": ("BOOLEAN", f"coalesce(s RLIKE '^[{RESIDUES}X]+\\\\z', false)"),
    "gene_family(gene STRING)": ("STRING", "regexp_extract(gene, '^[A-Z]+([0-9]+)', 1)"),
    "align_cdr(cdr STRING, width INT)": ("STRING", "CASE WHEN length(cdr) <= width THEN concat(substring(cdr, 1, (length(cdr) + 1) DIV 2), repeat('-', width - length(cdr)), substring(cdr, (length(cdr) + 1) DIV 2 + 1)) END"),
    "differences(a STRING, b STRING)": ("INT", "CASE WHEN length(a) = length(b) THEN size(filter(sequence(1, length(a)), i -> substring(a, i, 1) <> substring(b, i, 1))) END"),
}


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _FastaReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for p in self.paths for f in (sorted(x for x in glob(os.path.join(p, "*")) if os.path.basename(x)[0] not in "._") if os.path.isdir(p) else sorted(glob(p)) or [p])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        opened = gzip.open if partition.value.endswith(".gz") else open
        name, parts = None, []
        with opened(partition.value, "rt", encoding="utf-8", newline="\n") as lines:
            for line in lines:
                line = line.rstrip("\n").replace("\t", " ").replace("\r", " ").strip(" ")
                if line.startswith(">"):
                    if name is not None:
                        yield name, "".join(parts)
                    name, parts = line[1:].strip(" "), []
                elif line and name is not None:
                    parts.append(line)
        if name is not None:
            yield name, "".join(parts)


class FastaSource(DataSource):
    """spark.read.format("fasta").load(path): seqinfo, sequence. A file is one task; ``files.read_fasta`` splits large ones."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "seqinfo string, sequence string"

    def reader(self, schema) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return _FastaReader([path.removeprefix("file://")])


def register(spark: SparkSession, profiles: dict[str, np.ndarray] | None = None, model: CategoricalMixture | None = None) -> list[str]:
    """Make the functions known to the session; returns their names.

    Always: FUNCTIONS and the source ``fasta``. With profiles (see ``chain_profiles``): ``annotate_chain(sequence)``, the struct of N1. With a
    model: ``mixture_score(aligned)``, its log likelihood, null for texts of another length or with other letters (M4).
    """
    ship(spark)
    spark.dataSource.register(FastaSource)
    for head, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    names = [head.split("(")[0] for head in FUNCTIONS]
    if profiles is not None:
        chains = [c for c in profiles if c in MAB_CHAINS]

        @F.pandas_udf(ANNOTATION)
        def annotate_chain(sequence: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(annotate_batch(sequence.tolist(), profiles, chains), columns=ANNOTATION.names)

        spark.udf.register("annotate_chain", annotate_chain)
        names.append("annotate_chain")
    if model is not None:
        log_mu, log_w = model._log()
        length, letters = model.length, {a: i for i, a in enumerate(RESIDUES + "-")}

        @F.pandas_udf("double")
        def mixture_score(aligned: pd.Series) -> pd.Series:
            out = np.full(len(aligned), np.nan)
            at = [i for i, t in enumerate(aligned) if isinstance(t, str) and len(t) == length and set(t) <= letters.keys()]
            if at:
                out[at] = logsumexp((_one_hot(np.array([[letters[a] for a in aligned.iloc[i]] for i in at])) @ log_mu + log_w).T)
            return pd.Series(out).astype(object).where(~np.isnan(out), None)

        spark.udf.register("mixture_score", mixture_score)
        names.append("mixture_score")
    return names
