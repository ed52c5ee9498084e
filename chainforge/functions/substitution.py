"""Residue substitution scores and the mismatch distances made from them (K4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chainforge.functions.alphabet import ALPHABET, RESIDUES

#: BLOSUM62 below the diagonal, in the order of the first column.
_LOWER = """
A
R -1
N -2  0
D -2 -2  1
C  0 -3 -3 -3
Q -1  1  0  0 -3
E -1  0  0  2 -4  2
G  0 -2  0 -1 -3 -2 -2
H -2  0  1 -1 -3  0  0 -2
I -1 -3 -3 -3 -1 -3 -3 -4 -3
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1
"""
#: Score of equal residues.
MATCH = 4


def default_scores() -> dict[tuple[str, str], int]:
    """(a, b) -> score of different residues, both ways round."""
    rows = [line.split() for line in _LOWER.split("\n") if line]
    order = [r[0] for r in rows]
    out = {}
    for r in rows:
        for other, score in zip(order, r[1:]):
            out[r[0], other] = out[other, r[0]] = int(score)
    return out


def score_matrix(scores: dict[tuple[str, str], int] | None = None, match: float = MATCH) -> np.ndarray:
    """20 x 20 scores in the order of the residues."""
    scores = default_scores() if scores is None else scores
    return np.array([[match if a == b else scores.get((a, b), 0) for b in RESIDUES] for a in RESIDUES], float)


def mismatch_distances(scores: dict[tuple[str, str], int] | None = None, gap: float = 8.0) -> dict[tuple[str, str], float]:
    """(a, b) -> distance over the 21 symbols: 0 for equal ones, the match score less the substitution score else, ``gap`` against a gap."""
    m = score_matrix(scores)
    out = {}
    for i, a in enumerate(ALPHABET):
        for j, b in enumerate(ALPHABET):
            out[a, b] = 0.0 if a == b else gap if "-" in (a, b) else float(MATCH - m[i, j])
    return out


def mismatch_table(spark: SparkSession, scores: dict[tuple[str, str], int] | None = None, gap: float = 8.0) -> DataFrame:
    """a, b, distance: the distances as a table of 441 rows."""
    return spark.createDataFrame([(a, b, d) for (a, b), d in mismatch_distances(scores, gap).items()], "a string, b string, distance double")
