"""The residue alphabet, validity, cleaning, integer encoding and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Codes 0-20: the residues, then the gap.
ALPHABET = RESIDUES + "-"
GAP = 20


def is_valid_sequence(seq: Column) -> Column:
    """One or more of the 20 residues or X; null is not valid."""
    return F.coalesce(seq.rlike(rf"^[{RESIDUES}X]+\z"), F.lit(False))


def validity_error(seq: Column) -> Column:
    """Null for a valid sequence, else an error text: data errors are values, never exceptions."""
    return F.when(~is_valid_sequence(seq), F.lit("Sequence contains invalid characters"))


def clean_sequence(seq: Column) -> Column:
    """Capitals without white space and gaps; null stays null."""
    return F.upper(F.regexp_replace(seq, r"[\s\-.]", ""))


def letters_of(text: Column) -> Column:
    """One string per letter; an empty text has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def encode(seq: Column, length: int | None = None) -> Column:
    """array<int> of codes 0-20. A foreign letter, and another length if one is given, raise an error; null stays null."""
    good = seq.rlike(rf"^[{ALPHABET}]*\z")
    if length is not None:
        good = good & (F.length(seq) == length)
    codes = F.transform(letters_of(seq), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return F.when(seq.isNull(), F.lit(None)).when(good, codes).otherwise(F.raise_error(F.concat(F.lit("cannot encode sequence: "), seq)))


def mask_positions(codes: Column, keep: Column) -> Column:
    """Codes with null where keep is false (true: keep)."""
    return F.zip_with(codes, keep, lambda v, k: F.when(k, v))


def mask_terminal_gaps(codes: Column) -> Column:
    """Codes with null at leading and trailing gaps; an all-gap sequence is masked throughout."""
    first = F.array_position(F.transform(codes, lambda v: v != GAP), True)
    last = F.size(codes) + 1 - F.array_position(F.transform(F.reverse(codes), lambda v: v != GAP), True)
    return F.transform(codes, lambda v, i: F.when((first > 0) & (i + 1 >= first) & (i + 1 <= last), v))


def mask_gaps(codes: Column) -> Column:
    """Codes with null at every gap."""
    return F.transform(codes, lambda v: F.when(v != GAP, v))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two texts of one length differ."""
    return F.aggregate(F.zip_with(letters_of(a), letters_of(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
