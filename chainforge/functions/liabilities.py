"""Sequence motifs that may be liabilities (L1-L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainforge.functions.positions import region_labels

#: Motif, its length, the regions it is looked for in (any label that begins so), name and severity.
#: Published motifs of Satlawa et al. (2024) without those of low risk for deamidation.
MOTIFS = [
    ("N[^P][ST]", 3, "", "N-glycosylation", "high"),
    ("N[GS]", 2, "cdr", "Deamidation", "high"),
    ("N[AHNT]", 2, "cdr", "Deamidation", "low"),
    ("D[GS]", 2, "cdr", "Isomerization", "high"),
    ("D[DHT]", 2, "cdr", "Isomerization", "medium"),
    ("DP", 2, "cdr", "pH-dependent hydrolysis", "medium"),
    ("TS", 2, "cdr", "pH-dependent hydrolysis", "low"),
    ("[MW]", 1, "cdr", "Methionine / Tryptophan oxidation", "medium"),
]
#: Positions of the two conserved cysteines by scheme; any other cysteine is unusual.
CYSTEINES = {"imgt": ("23", "104"), "aho": ("23", "106"), "kabat": ("22", "92", "23", "88"), "martin": ("22", "92", "23", "88")}


def find_liabilities(df: DataFrame, seq: str, numbering: str, chain: str, scheme: str = "imgt", cdr_scheme: str = "") -> DataFrame:
    """The columns of ``df`` and start, stop (0-based, half open), liability, severity, description: one row per hit.

    Overlapping hits all count. A motif hits where its first letter lies in one of its regions; unnumbered letters are outside the
    domain and ignored. A hit is found by looking at each position once, so the work is linear in the sequence.
    """
    labels = region_labels(F.col(numbering), scheme, chain, cdr_scheme)
    at = F.sequence(F.lit(0), F.length(seq) - 1)

    def hits(i: Column) -> Column:
        label = F.element_at("__labels", i + 1)
        code = F.element_at(F.col(numbering), i + 1)
        found = []
        for motif, size, region, name, severity in MOTIFS:
            inside = F.substring(F.col(seq), i + 1, F.lit(size)).rlike(f"^{motif}$") & (F.startswith(label, F.lit(region)) if region else F.lit(True))
            found.append(F.when((label != "-") & inside, _hit(i, size, name, severity)))
        odd = (F.substring(F.col(seq), i + 1, F.lit(1)) == "C") & ~code.isin(*CYSTEINES[scheme]) & (label != "-")
        found.append(F.when(odd, _hit(i, 1, "Unusual cysteine", "high")))
        return F.filter(F.array(*found), lambda h: h.isNotNull())

    usable = df.where(F.length(seq) > 0).where(F.size(F.col(numbering)) == F.length(seq)).withColumn("__labels", labels)
    flat = usable.select(*df.columns, F.explode(F.flatten(F.transform(at, hits))).alias("h"))
    return flat.select(*df.columns, "h.*").withColumn("description", F.concat("liability", F.lit(" (severity: "), "severity", F.lit(")")))


def _hit(i: Column, size: int, name: str, severity: str) -> Column:
    return F.struct(i.cast("int").alias("start"), (i + size).cast("int").alias("stop"), F.lit(name).alias("liability"), F.lit(severity).alias("severity"))
