"""A sequence database as a folder of Parquet tables: sequences, chains, rejects and info.

Each build is one lazy plan from scan to write; the only shuffles are those of numbering the rows and of the optional layout. Chains
are partitioned by chain group, so a search reads the files of its group only; genes and lengths prune by Parquet statistics.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainforge.functions.alphabet import is_valid_sequence
from chainforge.functions.genes import CHAIN_CODES, parse_gene, reassemble_gene
from chainforge.functions.positions import Template, canonical_numbering, imgt_cdr_text
from chainforge.operators.annotate import annotate, annotate_paired
from chainforge.operators.gene_assignment import assign_genes, to_imgt_columns
from chainforge.operators.search import CDR_WIDTHS, prepare
from chainforge.runtime import store

CHAINS = "seq_id long, chain string, cdr1 string, cdr2 string, cdr3 string, v_gene string, j_gene string, species string, n_noncanonical int"


@dataclass(frozen=True)
class Info:
    """What a database was built with."""

    numbering_scheme: str = "imgt"
    cdr_scheme: str = "imgt"
    receptor_type: str = "mab"
    sequence_type: str = "single"
    pid_threshold: float = 0.7
    memo: str = ""


def chain_rows(df: DataFrame, seq: Column, numbering: Column, chain: Column, v: Column, j: Column, species: Column) -> DataFrame:
    """Rows of CHAINS from numbered sequences: IMGT CDR letters and the number of codes outside the canonical numbering."""
    heavy, light = (Template(canonical_numbering("imgt", group), group, "imgt").unusual(numbering) for group in "HL")
    return df.where(chain.isin(*"HBDKLAG")).select(
        F.col("seq_id").cast("long").alias("seq_id"), chain.alias("chain"), *(_cdr(seq, numbering, k).alias(f"cdr{k}") for k in (1, 2, 3)),
        v.alias("v_gene"), j.alias("j_gene"), species.alias("species"), F.when(chain.isin(*"HBD"), F.size(heavy)).otherwise(F.size(light)).alias("n_noncanonical"),
    )


def _cdr(seq: Column, numbering: Column, cdr: int) -> Column:
    return imgt_cdr_text(seq, numbering, cdr)


def to_chains_table(rows: DataFrame) -> DataFrame:
    """The stored chains: CHAINS with fixed-width CDRs, lengths, chain group and parsed genes; CDRs that are too wide are cut from the table."""
    v, j = parse_gene(F.col("v_gene"), F.col("species")), parse_gene(F.col("j_gene"), F.col("species"))
    rows = store(rows)  # else the optimiser copies the extraction of the CDRs into each of their uses
    base = prepare(rows, F.col("seq_id"), F.col("chain"), {k: F.col(f"cdr{k}") for k in (1, 2, 3)}, F.struct("v_gene", "chain", "j_gene"), None, F.col("species"), F.col("n_noncanonical"))
    flat = base.select("seq_id", "chain_group", *(F.col(f"aln{k}").alias(f"cdr{k}") for k in (1, 2, 3)), "len1", "len2", "len3", "species", "n_noncanonical", F.col("v.chain").alias("chain"), F.col("v.v_gene").alias("v_gene"), F.col("v.j_gene").alias("j_gene"))
    codes = F.create_map(*(F.lit(x) for kv in CHAIN_CODES.items() for x in kv))
    return flat.withColumn("__v", v).withColumn("__j", j).select(
        "seq_id", "chain_group", "cdr1", "cdr2", "cdr3", "len1", "len2", "len3", F.element_at(codes, F.col("chain")).alias("chain_code"),
        F.col("__v.family").alias("v_family"), F.col("__v.gene").alias("v_gene"), F.col("__v.allele").alias("v_allele"), F.col("__j.family").alias("j_family"), F.col("__j.allele").alias("j_allele"), "species", "n_noncanonical",
    )


def write_database(path: str, sequences: DataFrame, chains: DataFrame, rejects: DataFrame, info: Info) -> None:
    """Write all tables; an existing database is never overwritten."""
    spark = sequences.sparkSession
    chains.write.mode("errorifexists").partitionBy("chain_group").parquet(f"{path}/chains")
    sequences.write.mode("errorifexists").parquet(f"{path}/sequences")
    rejects.write.mode("errorifexists").parquet(f"{path}/rejects")
    spark.createDataFrame([asdict(info)]).coalesce(1).write.mode("errorifexists").parquet(f"{path}/info")


class Database:
    """An existing database."""

    def __init__(self, spark: SparkSession, path: str):
        try:
            self.sequences, self.chains, self.rejects, self._info = (spark.read.parquet(f"{path}/{t}") for t in ("sequences", "chains", "rejects", "info"))
        except Exception as e:
            raise RuntimeError(f"no database at {path}") from e
        missing = {"seq_id", "chain_group", "cdr3", "len3", "v_family"} - set(self.chains.columns)
        if missing:
            raise RuntimeError(f"no database at {path}: chains lack {sorted(missing)}")

    def metadata(self) -> dict:
        """Scheme, receptor, sequence type, CDR scheme, threshold and memo."""
        return self._info.first().asDict()

    def searchable(self, gene: bool = False) -> DataFrame:
        """Rows as ``search`` takes them; v is the family, with the gene if asked for."""
        v = F.concat_ws("-", "v_family", "v_gene") if gene else F.col("v_family")
        plain = {k: F.translate(F.col(f"cdr{k}"), "-", "") for k in (1, 2, 3)}
        chain = F.substring("chain_group", 1, 1)
        return prepare(self.chains, F.col("seq_id"), chain, plain, v, F.col("j_family"), F.col("species"), F.col("n_noncanonical"))

    def genes(self, receptor: str = "IG") -> DataFrame:
        """seq_id, chain_group, v_gene, j_gene: names put together again (F8)."""
        r = F.lit(receptor)
        none = F.lit("")
        return self.chains.select("seq_id", "chain_group", reassemble_gene(r, F.col("chain_code"), F.lit("V"), F.col("v_family"), F.col("v_gene"), F.col("v_allele")).alias("v_gene"), reassemble_gene(r, F.col("chain_code"), F.lit("J"), F.col("j_family"), none, F.col("j_allele")).alias("j_gene"))


def accepted(pid: Column, threshold: float) -> Column:
    return F.coalesce(pid >= threshold, F.lit(False))


def from_sequences(df: DataFrame, seq: str, germlines: DataFrame, profiles: dict[str, np.ndarray], info: Info = Info()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, chains, rejects) of raw sequences with a seq_id.

    ``single`` and ``unknown`` sequences are rejected below the identity threshold; a ``paired`` one is kept if either chain passes. The
    annotations are stored once, since three tables read them.
    """
    rest = df.columns
    if info.sequence_type == "paired":
        both = store(annotate_paired(df, F.col(seq), profiles, info.receptor_type))
        passes = accepted(F.col("heavy.percent_identity"), info.pid_threshold) | accepted(F.col("light.percent_identity"), info.pid_threshold)
        sides = both.where(passes).select(*rest, F.explode(F.array("heavy", "light")).alias("annotation")).where(accepted(F.col("annotation.percent_identity"), info.pid_threshold))
        code = F.when(~is_valid_sequence(F.col(seq)), "invalid").when(~passes, "identity")
    elif info.sequence_type in ("single", "unknown"):
        both = store(annotate(df, F.col(seq), profiles, [c for c in profiles if c in "HKL"] if info.receptor_type == "mab" else [c for c in profiles if c in "ABDG"]))
        passes = accepted(F.col("annotation.percent_identity"), info.pid_threshold)
        sides = both.where(passes)
        code = F.when(~is_valid_sequence(F.col(seq)), "invalid").when(~passes, "identity")
    else:
        raise ValueError("sequence_type is single, paired or unknown")
    unknown = F.lit("unknown")
    aligned = to_imgt_columns(F.col(seq), F.col("annotation.numbering"))
    named = assign_genes(sides.withColumn("__chain", F.col("annotation.chain")), aligned, F.col("__chain"), unknown, germlines)
    chains = chain_rows(named, F.col(seq), F.col("annotation.numbering"), F.col("annotation.chain"), F.col("v_gene"), F.col("j_gene"), F.col("gene_species"))
    rejects = both.withColumn("code", code).where("code IS NOT NULL").select(*rest, "code")
    return both.where(code.isNull()).select(*rest), to_chains_table(chains), rejects


def from_full_chains(df: DataFrame, columns: dict[str, str], profiles: dict[str, np.ndarray], info: Info = Info(), default_species: str = "human") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, chains, rejects) of rows with chains and genes.

    columns names those of seq_id and of {heavy,light}_{chain,numbering,vgene,jgene}, species and metadata; what isn't named is missing. A
    chain needs its V and J gene. Rows with a numbering skip the annotation; the others are annotated apart, so no numbered row passes through Python.
    """
    for side in ("heavy", "light"):
        if f"{side}_chain" in columns and not {f"{side}_vgene", f"{side}_jgene"} <= set(columns):
            raise ValueError(f"{side} chains need {side}_vgene and {side}_jgene")
    if not {"heavy_chain", "light_chain"} & set(columns):
        raise ValueError("no chain column")
    get = lambda c: F.col(columns[c]) if c in columns else F.lit(None).cast("string")
    species = F.when(F.coalesce(F.trim(get("species")), F.lit("")) == "", default_species).otherwise(get("species"))
    base = df.select(F.col(columns.get("seq_id", "seq_id")).cast("long").alias("seq_id"), get("metadata").alias("metadata"), species.alias("species"), *(get(f"{s}_{c}").alias(f"{s}_{c}") for s in ("heavy", "light") for c in ("chain", "numbering", "vgene", "jgene")))
    kinds = {"heavy": [c for c in profiles if c in "HBD"], "light": [c for c in profiles if c in "KLAG"]}
    parts, errors = [], []
    for side in ("heavy", "light"):
        s = base.select("seq_id", "species", F.col(f"{side}_chain").alias("seq"), F.split(f"{side}_numbering", "_").alias("numbering"), F.col(f"{side}_vgene").alias("v_gene"), F.col(f"{side}_jgene").alias("j_gene")).where(F.length(F.trim("seq")) > 0)
        bad = F.when(~is_valid_sequence(F.col("seq")), "invalid").when((F.coalesce(F.trim("v_gene"), F.lit("")) == "") | (F.coalesce(F.trim("j_gene"), F.lit("")) == ""), "genes").when(F.col("numbering").isNotNull() & (F.size("numbering") != F.length("seq")), "numbering")
        s = s.withColumn("code", bad)
        good = s.where("code IS NULL")
        letter = F.substring("v_gene", 3, 1)
        given = good.where(F.col("numbering").isNotNull()).select("seq_id", "species", "seq", "numbering", "v_gene", "j_gene", letter.alias("chain"))
        found = store(annotate(good.where(F.col("numbering").isNull()).drop("numbering"), F.col("seq"), profiles, kinds[side]))
        passes = accepted(F.col("annotation.percent_identity"), info.pid_threshold)
        parts += [given, found.where(passes).select("seq_id", "species", "seq", F.col("annotation.numbering").alias("numbering"), "v_gene", "j_gene", F.col("annotation.chain").alias("chain"))]
        errors += [s.where("code IS NOT NULL").select("seq_id", F.lit(side).alias("side"), "code"), found.where(~passes).select("seq_id", F.lit(side).alias("side"), F.lit("identity").alias("code"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    rejects = errors[0]
    for e in errors[1:]:
        rejects = rejects.unionAll(e)
    chains = to_chains_table(chain_rows(rows, F.col("seq"), F.col("numbering"), F.col("chain"), F.col("v_gene"), F.col("j_gene"), F.col("species")))
    sequences = base.select("seq_id", F.col("heavy_chain").alias("heavy"), F.col("light_chain").alias("light"), "metadata")
    return sequences, chains, rejects


def from_cdrs(df: DataFrame, columns: dict[str, str], default_species: str = "human") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, chains, rejects) of rows of isolated IMGT CDRs (S7): a chain needs its cdr3 and V gene; the identity counts as 0.7."""
    if not {"heavy_cdr3", "light_cdr3"} & set(columns):
        raise ValueError("no cdr3 column")
    get = lambda c: F.col(columns[c]) if c in columns else F.lit(None).cast("string")
    species = F.when(F.coalesce(F.trim(get("species")), F.lit("")) == "", default_species).otherwise(get("species"))
    seq_id = F.col(columns.get("seq_id", "seq_id")).cast("long")
    text = lambda c: F.coalesce(F.trim(get(c)), F.lit(""))
    rows = rejects = None
    for side, fallback in (("heavy", "H"), ("light", "K")):
        letter = F.upper(F.substring(text(f"{side}_vgene"), 3, 1))
        chain = F.when(letter.isin(*"HKLABDG"), letter).otherwise(fallback)
        cdrs = [text(f"{side}_cdr{k}") for k in (1, 2, 3)]
        some = F.concat(*cdrs) != ""
        code = F.when(~some, None).when((cdrs[2] == "") | (text(f"{side}_vgene") == ""), "missing").when(~is_valid_sequence(F.concat(*cdrs)), "invalid").when(F.greatest(*(F.length(c) - CDR_WIDTHS[k + 1] for k, c in enumerate(cdrs))) > 0, "length")
        part = df.where(some).select(seq_id.alias("seq_id"), chain.alias("chain"), *(c.alias(f"cdr{k + 1}") for k, c in enumerate(cdrs)), text(f"{side}_vgene").alias("v_gene"), text(f"{side}_jgene").alias("j_gene"), species.alias("species"), F.lit(0).alias("n_noncanonical"), code.alias("code"))
        good, bad = part.where("code IS NULL").drop("code"), part.where("code IS NOT NULL").select("seq_id", F.lit(side).alias("side"), "code")
        rows = good if rows is None else rows.unionAll(good)
        rejects = bad if rejects is None else rejects.unionAll(bad)
    sequences = df.select(seq_id.alias("seq_id"), get("metadata").alias("metadata"))
    return sequences, to_chains_table(rows), rejects
