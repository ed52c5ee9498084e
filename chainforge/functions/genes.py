"""Parsing and reassembly of V and J gene names (V4, V5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of species and of the chain letter of a gene name.
SPECIES_CODES = {"human": 1, "mouse": 2, "alpaca": 3, "rabbit": 4}
CHAIN_CODES = {"A": 1, "G": 2, "H": 3, "L": 4, "K": 5, "B": 6, "D": 7}
#: Numeric parts are capped here.
MOST = 254


def _lookup(value: Column, table: dict[str, int], default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(default))


def _numeric(part: Column) -> Column:
    """The first run of digits, capped; 0 without one."""
    digits = F.regexp_extract(part, r"(\d+)", 1)
    return F.when(digits == "", 0).otherwise(F.least(F.coalesce(digits.try_cast("int"), F.lit(MOST)), F.lit(MOST)))


def parse_gene(name: Column, species: Column) -> Column:
    """struct<chain_code, family_number, gene_number, species_code, family, gene, allele> of the first of tied names.

    The family of an S gene ends with the S. Parts that the name lacks are empty; an unknown species or chain letter has code 0. A
    null name gives a null struct.
    """
    first = F.substring_index(name, "_", 1)
    rest = F.substring(first, 5, 10_000)
    stem = F.substring_index(rest, "*", 1)
    allele = F.when(F.contains(rest, F.lit("*")), F.regexp_extract(rest, r"\*(.*)$", 1)).otherwise("")
    with_s = F.contains(first, F.lit("S"))
    with_dash = F.contains(first, F.lit("-"))
    family = F.when(with_s, F.concat(F.substring_index(stem, "S", 1), F.lit("S"))).when(with_dash, F.substring_index(stem, "-", 1)).otherwise(stem)
    gene = F.when(with_s, F.regexp_extract(stem, r"S(.*)$", 1)).when(with_dash, F.regexp_extract(stem, r"-(.*)$", 1)).otherwise("")
    out = F.struct(
        _lookup(F.substring(first, 3, 1), CHAIN_CODES, 0).alias("chain_code"),
        _numeric(family).alias("family_number"),
        _numeric(gene).alias("gene_number"),
        _lookup(F.coalesce(species, F.lit("")), SPECIES_CODES, 0).alias("species_code"),
        family.alias("family"),
        gene.alias("gene"),
        allele.alias("allele"),
    )
    return F.when(name.isNotNull(), out)


def reassemble_gene(receptor: Column, chain_code: Column, segment: Column, family: Column, gene: Column, allele: Column) -> Column:
    """The name with these parts: receptor ``IG`` or ``TR``, segment ``V`` or ``J``. An unknown chain code gives null."""
    letters = F.create_map(*(F.lit(x) for k, v in CHAIN_CODES.items() for x in (v, k)))
    middle = F.when(gene == "", "").when(F.endswith(family, F.lit("S")), gene).otherwise(F.concat(F.lit("-"), gene))
    return F.concat(receptor, F.element_at(letters, chain_code), segment, family, middle, F.when(allele == "", "").otherwise(F.concat(F.lit("*"), allele)))
