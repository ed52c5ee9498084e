"""Queries of validation, numbering, alignment, liability and gene operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainforge.functions import alphabet, genes, liabilities, positions
from chainforge.functions.substitution import MATCH, default_scores
from chainforge.operators import annotate as ann
from chainforge.operators import gene_assignment as ga
from chainforge.plans.typed import typed
from chainforge.runtime import spread, table

TEMPLATE = positions.Template(positions.canonical_numbering("imgt", "H"), "H", "imgt")
CDR_WIDTH = 20


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """seq_id, seq, num, heavy_vgene, heavy_jgene, species: heavy chains that come with a code for each letter."""
    t = table(spark, sf, "full_chains").where(F.col("heavy_numbering").isNotNull() & F.col("heavy_chain").rlike(r"^[A-Z]+\z"))
    t = t.select("seq_id", F.col("heavy_chain").alias("seq"), F.split("heavy_numbering", "_").alias("num"), "heavy_vgene", "heavy_jgene", "species")
    return spread(t.where("size(num) = length(seq)"))


def germlines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "germlines")


def f1_valid_alphabet(spark, sf):
    t = table(spark, sf, "full_chains")
    return t.select("seq_id", alphabet.is_valid_sequence(F.col("heavy_chain")).alias("valid"), alphabet.validity_error(F.col("heavy_chain")).alias("error"))


def f2_clean_sequence(spark, sf):
    return table(spark, sf, "fasta_records").select("rec_id", alphabet.clean_sequence(F.col("sequence")).alias("cleaned"))


def e1_encode_position_counts(spark, sf):
    t = table(spark, sf, "cdr_rows").where(F.col("heavy_cdr3").rlike(rf"^[{alphabet.RESIDUES}]+\z"))
    codes = alphabet.encode(positions.align_cdr(F.col("heavy_cdr3"), CDR_WIDTH), CDR_WIDTH)
    return t.where(F.length("heavy_cdr3") <= CDR_WIDTH).select(F.posexplode(codes).alias("pos", "code")).groupBy("pos", "code").agg(F.count("*").alias("n"))


def a1_group_counts(spark, sf):
    t = table(spark, sf, "full_chains")
    has = lambda c: F.sum((F.length(F.trim(c)) > 0).cast("long"))
    return t.groupBy("species").agg(F.count("*").alias("n"), F.coalesce(has("heavy_chain"), F.lit(0)).alias("heavy"), F.coalesce(has("light_chain"), F.lit(0)).alias("light"))


def n4_trim(spark, sf):
    inside = F.transform("num", lambda c: F.when(positions.code_number(c).between(5, 120), c).otherwise("-"))
    t = numbered(spark, sf).select("seq_id", positions.trim_alignment(F.col("seq"), inside).alias("t"))
    return t.select("seq_id", F.col("t.seq").alias("seq"), F.array_join("t.numbering", "_").alias("numbering"), F.col("t.start").alias("start"), F.col("t.stop").alias("stop"))


def n5_sort_codes(spark, sf):
    return numbered(spark, sf).select("seq_id", F.array_join(positions.sort_codes(F.array_sort("num"), "imgt"), "_").alias("codes"))


def n6_region_labels(spark, sf):
    out = [F.array_join(positions.region_labels(F.col("num"), "imgt", "H", s), "_").alias(f"labels_{s}") for s in ("imgt", "kabat", "north")]
    return numbered(spark, sf).select("seq_id", *out)


def n7_cdr_numbering(spark, sf):
    t = table(spark, sf, "cdr_rows")
    return t.select("cdr_id", *(F.array_join(positions.number_imgt_cdr(F.col(f"heavy_cdr{k}"), k), "_").alias(f"codes{k}") for k in (1, 2, 3)))


def n8_msa(spark, sf):
    return positions.build_msa(numbered(spark, sf), "seq", "num", "H", "imgt")[1].select("seq_id", "aligned")


def n9_template_align(spark, sf):
    return numbered(spark, sf).select("seq_id", TEMPLATE.align(F.col("seq"), F.col("num")).alias("aligned"))


def n10_unusual_positions(spark, sf):
    small = positions.Template([str(i) for i in range(1, 129)], "H", "imgt")
    return numbered(spark, sf).select("seq_id", small.align(F.col("seq"), F.col("num")).alias("aligned"), F.array_join(small.unusual(F.col("num")), "_").alias("unusual"))


def n12_region_slice(spark, sf):
    aligned = TEMPLATE.align(F.col("seq"), F.col("num"))
    return numbered(spark, sf).withColumn("a", aligned).select("seq_id", *(TEMPLATE.slice(F.col("a"), r).alias(r) for r in ("cdr", "cdr3", "fmwk1")))


def n14_alignment_maps(spark, sf):
    return numbered(spark, sf).select("seq_id", F.array_join(TEMPLATE.forward(F.col("num")), ",").alias("forward"), F.array_join(TEMPLATE.back(F.col("num")), ",").alias("back"))


def n16_cdr_text(spark, sf):
    labels = positions.region_labels(F.col("num"), "imgt", "H")
    return numbered(spark, sf).withColumn("labels", labels).select("seq_id", *(positions.extract_region(F.col("seq"), F.col("labels"), f"cdr{k}").alias(f"cdr{k}") for k in (1, 2, 3)))


def _dictionaries(spark, sf):
    g = germlines(spark, sf)
    plain = g.where("segment = 'V'").select("chain", F.translate("aligned_seq", "-", "").alias("s"))
    kmers = plain.select("chain", F.explode(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.substring(F.col("s"), i, F.lit(9)))).alias("kmer")).distinct()
    ends = g.where("segment = 'J'").select("chain", F.translate("aligned_seq", "-", "").alias("s")).select("chain", F.posexplode(F.split(F.substring("s", 1, 10), "")).alias("offset", "residue"))
    return kmers, ends.groupBy("chain", "offset", "residue").agg(F.count("*").cast("double").alias("score"))


def n3_prefilter(spark, sf):
    t = table(spark, sf, "full_chains").where(F.col("heavy_chain").rlike(r"^[A-Z]+\z"))
    return ann.prefilter(spread(t.select("seq_id", "heavy_chain")), "seq_id", "heavy_chain", *_dictionaries(spark, sf))


def _annotated(spark, sf):
    profiles = ann.chain_profiles(germlines(spark, sf))
    t = spread(table(spark, sf, "full_chains").where(F.length("heavy_chain") > 0).select("seq_id", F.col("heavy_chain").alias("seq")))
    return ann.annotate(t, alphabet.clean_sequence(F.col("seq")), profiles)


def n1_annotate(spark, sf):
    return _annotated(spark, sf).select("seq_id", F.array_join("annotation.numbering", "_").alias("numbering"), F.round("annotation.percent_identity", 6).alias("percent_identity"), "annotation.chain", "annotation.error")


def n2_paired_annotate(spark, sf):
    profiles = ann.chain_profiles(germlines(spark, sf))
    t = table(spark, sf, "full_chains").where((F.length("heavy_chain") > 0) & (F.length("light_chain") > 0))
    both = F.concat(alphabet.clean_sequence(F.col("heavy_chain")), alphabet.clean_sequence(F.col("light_chain")))
    got = ann.annotate_paired(spread(t.select("seq_id", both.alias("seq"))), F.col("seq"), profiles)
    return got.select("seq_id", *(x for s in ("heavy", "light") for x in (F.col(f"{s}.chain").alias(f"{s}_chain"), F.round(f"{s}.percent_identity", 6).alias(f"{s}_identity"), F.size(F.filter(f"{s}.numbering", lambda c: c != "-")).alias(f"{s}_numbered"), F.col(f"{s}.error").alias(f"{s}_error"))))


def l1_liabilities(spark, sf):
    return liabilities.find_liabilities(numbered(spark, sf).select("seq_id", "seq", "num"), "seq", "num", "H").select("seq_id", "start", "stop", "description")


def l3_liability_by_severity(spark, sf):
    return l1_liabilities(spark, sf).groupBy("description").agg(F.count("*").alias("hits"), F.countDistinct("seq_id").alias("sequences"))


def _genes(spark, sf, mode, species):
    t = numbered(spark, sf).withColumn("aligned", ga.to_imgt_columns(F.col("seq"), F.col("num"))).select("seq_id", "species", "aligned")
    return ga.assign_genes(t, F.col("aligned"), F.lit("H"), species, germlines(spark, sf), mode)


def _gene_columns(df):
    return df.select("seq_id", "v_gene", "j_gene", F.round("v_identity", 6).alias("v_identity"), F.round("j_identity", 6).alias("j_identity"), "gene_species")


def v1_identity_argmax(spark, sf):
    return _gene_columns(_genes(spark, sf, "identity", F.col("species")))


def v2_evalue_argmax(spark, sf):
    return _gene_columns(_genes(spark, sf, "evalue", F.col("species")))


def v3_any_species(spark, sf):
    return _gene_columns(_genes(spark, sf, "identity", F.lit("unknown")))


def v4_gene_parse(spark, sf):
    t = table(spark, sf, "full_chains").where(F.length("heavy_vgene") > 0)
    return t.select("seq_id", genes.parse_gene(F.col("heavy_vgene"), F.col("species")).alias("g")).select("seq_id", "g.*")


def v5_gene_reassemble(spark, sf):
    g = genes.parse_gene(F.col("heavy_vgene"), F.col("species"))
    t = table(spark, sf, "full_chains").where(F.length("heavy_vgene") > 0).withColumn("g", g)
    return t.select("seq_id", genes.reassemble_gene(F.lit("IG"), F.col("g.chain_code"), F.lit("V"), F.col("g.family"), F.col("g.gene"), F.col("g.allele")).alias("name"))


def v6_gene_sequences(spark, sf):
    t = table(spark, sf, "full_chains").where(F.length("heavy_vgene") > 0)
    names = t.select(F.explode(F.split("heavy_vgene", "_")).alias("gene_name"), "species").where("species IS NOT NULL").distinct()
    return ga.gene_sequence(germlines(spark, sf), names)


def v7_gene_lists(spark, sf):
    got = ga.gene_lists(germlines(spark, sf))
    return got.select("species", "receptor", F.array_join("names", " ").alias("names"), F.array_join("sequences", " ").alias("sequences"))


def v10_gene_comparison(spark, sf):
    got = ga.gene_comparison(_genes(spark, sf, "identity", F.col("species")), "seq_id", "aligned", germlines(spark, sf))
    return got.withColumn("identity", F.round("identity", 6))


def v11_paired_panel(spark, sf):
    width = len(TEMPLATE.codes)
    light_template = positions.Template(positions.canonical_numbering("imgt", "L"), "L", "imgt")
    t = table(spark, sf, "full_chains")

    def side(name, template):
        s = t.where(F.col(f"{name}_numbering").isNotNull() & F.col(f"{name}_chain").rlike(r"^[A-Z]+\z")).select("seq_id", F.col(f"{name}_chain").alias("seq"), F.split(f"{name}_numbering", "_").alias("num")).where("size(num) = length(seq)")
        aligned = template.align(F.col("seq"), F.col("num"))
        return s.select("seq_id", aligned.alias("aligned"), F.round(F.length("seq") / F.lit(len(template.codes)), 6).alias("identity"))

    return ga.paired_panel(side("heavy", TEMPLATE), side("light", light_template), "seq_id", width, len(light_template.codes))



def v11_annotated_panel(spark, sf):
    """The panel with numberings and percent identities of the annotation of each chain."""
    profiles = ann.chain_profiles(germlines(spark, sf))
    light_template = positions.Template(positions.canonical_numbering("imgt", "L"), "L", "imgt")
    t = table(spark, sf, "full_chains")

    def side(name, template, chains):
        s = spread(t.where(F.col(f"{name}_chain").rlike(r"^[A-Z]+\z")).select("seq_id", F.col(f"{name}_chain").alias("seq")))
        got = ann.annotate(s, F.col("seq"), profiles, chains).where("annotation.chain IS NOT NULL")
        return got.select("seq_id", template.align(F.col("seq"), F.col("annotation.numbering")).alias("aligned"), F.round("annotation.percent_identity", 6).alias("identity"))

    return ga.paired_panel(side("heavy", TEMPLATE, ("H",)), side("light", light_template, ("K", "L")), "seq_id", len(TEMPLATE.codes), len(light_template.codes))


QUERIES = {
    f.__name__: f
    for f in (
        f1_valid_alphabet, f2_clean_sequence, e1_encode_position_counts, a1_group_counts, n1_annotate, n2_paired_annotate, n3_prefilter, n4_trim, n5_sort_codes, n6_region_labels,
        n7_cdr_numbering, n8_msa, n9_template_align, n10_unusual_positions, n12_region_slice, n14_alignment_maps, n16_cdr_text, l1_liabilities, l3_liability_by_severity,
        v1_identity_argmax, v2_evalue_argmax, v3_any_species, v4_gene_parse, v5_gene_reassemble, v6_gene_sequences, v7_gene_lists, v10_gene_comparison, v11_paired_panel, v11_annotated_panel,
    )
}

# SQL

NUM = """n AS (SELECT seq_id, heavy_chain AS seq, string_split(heavy_numbering, '_') AS num, heavy_vgene, heavy_jgene, species FROM full_chains
    WHERE regexp_full_match(heavy_chain, '[A-Z]+') AND len(string_split(heavy_numbering, '_')) = length(heavy_chain))"""


def _key(c: str) -> str:
    n = f"regexp_extract({c}, '\\d+')::int"
    letters = f"regexp_extract({c}, '[A-Z]*$')"
    rank = f"(CASE length({letters}) WHEN 0 THEN 0 ELSE ascii({letters}) - 64 END)"
    return f"CASE WHEN {n} IN (33, 61, 112) THEN {n} * 1000 + 999 - {rank} ELSE {n} * 1000 + {rank} END"


def _list(codes) -> str:
    return "[" + ", ".join(f"'{c}'" for c in codes) + "]"


def _aligned(codes: str, seq: str = "seq", num: str = "num") -> str:
    return f"array_to_string(list_transform({codes}, lambda c: CASE WHEN list_contains({num}, c) THEN substr({seq}, list_position({num}, c)::bigint, 1) ELSE '-' END), '')"


def _label(cdr: str, c: str = "c") -> str:
    starts = positions.bounds("imgt", "H", cdr)
    n = f"regexp_extract({c}, '\\d+')::int"
    whens = " ".join(f"WHEN {n} < {stop} THEN '{name}'" for name, stop in zip(positions.REGIONS, starts[1:]))
    return f"CASE {whens} ELSE 'fmwk4' END"


def _slice(region: str) -> str:
    return " || ".join(f"substr(a, {i + 1}, 1)" for i in TEMPLATE.kept(region))


def _cdr_codes(col: str, cdr: int) -> str:
    first, n, left_base, right_base = {1: (27, 12, 32, 33), 2: (56, 10, 60, 61), 3: (105, 13, 111, 112)}[cdr]
    size = f"least(length({col}), {n})"
    over = f"greatest(length({col}) - {n}, 0)"
    left, right = f"(({size} + 1) // 2)", f"({size} // 2)"
    return (
        f"array_to_string(list_transform(range(0, {left}), lambda i: ({first} + i)::varchar) || list_transform(range(0, {over} // 2), lambda i: '{left_base}' || chr((65 + i)::int))"
        f" || list_transform(list_reverse(range(0, ({over} + 1) // 2)), lambda i: '{right_base}' || chr((65 + i)::int)) || list_transform(range(0, {right}), lambda i: ({first + n} - {right} + i)::varchar), '_')"
    )


_HITS = "h AS (" + " UNION ALL ".join(
    f"SELECT seq_id, i - 1 AS start, i - 1 + {size} AS stop, '{name} (severity: {severity})' AS description FROM spots WHERE regexp_full_match(substr(seq, i, {size}), '{motif}')" + (f" AND label LIKE '{region}%'" if region else "")
    for motif, size, region, name, severity in liabilities.MOTIFS
) + " UNION ALL SELECT seq_id, i - 1, i, 'Unusual cysteine (severity: high)' FROM spots WHERE substr(seq, i, 1) = 'C' AND num[i] NOT IN ('23', '104'))"
_LIABILITIES = f"WITH {NUM}, p AS (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM n), spots AS (SELECT *, {_label('imgt', 'num[i]')} AS label FROM p), {_HITS} "
_IMGT = f"x AS (SELECT *, {_aligned(_list(ga.IMGT_CODES))} AS a FROM n)"


def _assign(score: str, any_species: bool = False) -> str:
    """Best genes by a score of x.a against g.aligned_seq."""
    same = "TRUE" if any_species else "(x.species IS NULL OR x.species = 'unknown' OR g.species = x.species)"
    best = "rank() OVER (PARTITION BY seq_id ORDER BY round(sc, 9) DESC)"
    return f"""WITH {NUM}, {_IMGT},
vs AS (SELECT x.seq_id, g.gene_name, g.species AS gs, {score} AS sc FROM x JOIN germlines g ON g.chain = 'H' AND g.segment = 'V' AND {same}),
v AS (SELECT seq_id, string_agg(gene_name, '_' ORDER BY gene_name) AS v_gene, arg_min(gs, gene_name) AS gs, max(sc) AS sc FROM (SELECT *, {best} AS r FROM vs) WHERE r = 1 GROUP BY seq_id),
js AS (SELECT x.seq_id, g.gene_name, {score} AS sc FROM x JOIN v ON v.seq_id = x.seq_id JOIN germlines g ON g.chain = 'H' AND g.segment = 'J' AND g.species = v.gs),
j AS (SELECT seq_id, string_agg(gene_name, '_' ORDER BY gene_name) AS j_gene, max(sc) AS sc FROM (SELECT *, {best} AS r FROM js) WHERE r = 1 GROUP BY seq_id),
o AS (SELECT x.seq_id, coalesce(v_gene, '') AS v_gene, coalesce(j_gene, '') AS j_gene, coalesce(round(v.sc::double, 6), 0) AS v_identity, coalesce(round(j.sc::double, 6), 0) AS j_identity, coalesce(v.gs, 'unknown') AS gene_species, x.a
    FROM x LEFT JOIN v ON v.seq_id = x.seq_id LEFT JOIN j ON j.seq_id = x.seq_id) """


_IDENTITY = "list_sum(list_transform(range(1, 129), lambda i: (substr(g.aligned_seq, i, 1) <> '-' AND substr(g.aligned_seq, i, 1) = substr(x.a, i, 1))::int))::double / (128 - length(regexp_replace(g.aligned_seq, '[^-]', '', 'g')))"
#: A map from two letters to their score.
_EVALUE = "list_sum(list_transform(range(1, 129), lambda i: CASE WHEN substr(g.aligned_seq, i, 1) = '-' OR substr(x.a, i, 1) = '-' THEN 0 WHEN substr(g.aligned_seq, i, 1) = substr(x.a, i, 1) THEN {m} ELSE coalesce(element_at({t}, substr(x.a, i, 1) || substr(g.aligned_seq, i, 1))[1], 0) END))".format(
    m=MATCH, t="MAP {" + ", ".join(f"'{a}{b}': {v}" for (a, b), v in default_scores().items()) + "}"
)
_OUT = "SELECT seq_id, v_gene, j_gene, v_identity, j_identity, gene_species FROM o"
_GENE = """g AS (SELECT seq_id, species, string_split(heavy_vgene, '_')[1] AS f FROM full_chains WHERE heavy_vgene <> ''),
q AS (SELECT *, regexp_replace(substr(f, 5), '\\*.*$', '') AS stem, contains(f, 'S') AS s, contains(f, '-') AS d FROM g),
w AS (SELECT *, CASE WHEN s THEN regexp_replace(stem, 'S.*$', '') || 'S' WHEN d THEN regexp_replace(stem, '-.*$', '') ELSE stem END AS family,
    CASE WHEN s THEN regexp_extract(stem, 'S(.*)$', 1) WHEN d THEN regexp_extract(stem, '-(.*)$', 1) ELSE '' END AS gene, regexp_extract(f, '\\*(.*)$', 1) AS allele FROM q),
u AS (SELECT seq_id, CASE substr(f, 3, 1) WHEN 'A' THEN 1 WHEN 'G' THEN 2 WHEN 'H' THEN 3 WHEN 'L' THEN 4 WHEN 'K' THEN 5 WHEN 'B' THEN 6 WHEN 'D' THEN 7 ELSE 0 END AS chain_code,
    least(coalesce(try_cast(regexp_extract(family, '\\d+') AS int), 0), 254) AS family_number, least(coalesce(try_cast(regexp_extract(gene, '\\d+') AS int), 0), 254) AS gene_number,
    CASE species WHEN 'human' THEN 1 WHEN 'mouse' THEN 2 WHEN 'alpaca' THEN 3 WHEN 'rabbit' THEN 4 ELSE 0 END AS species_code, family, gene, allele FROM w)"""
_LIGHT = positions.canonical_numbering("imgt", "L")
_CLEAN = "regexp_full_match({s}_chain, '[A-Z]+') AND len(string_split({s}_numbering, '_')) = length({s}_chain)"

SQL = {
    "f1_valid_alphabet": "SELECT seq_id, coalesce(regexp_full_match(heavy_chain, '[ACDEFGHIKLMNPQRSTVWYX]+'), false) AS valid, CASE WHEN NOT coalesce(regexp_full_match(heavy_chain, '[ACDEFGHIKLMNPQRSTVWYX]+'), false) THEN 'Sequence contains invalid characters' END AS error FROM full_chains",
    "f2_clean_sequence": "SELECT rec_id, upper(regexp_replace(sequence, '[\\s\\-.]', '', 'g')) AS cleaned FROM fasta_records",
    "e1_encode_position_counts": f"""
WITH a AS (SELECT substr(heavy_cdr3, 1, (length(heavy_cdr3) + 1) // 2) || repeat('-', {CDR_WIDTH} - length(heavy_cdr3)) || substr(heavy_cdr3, (length(heavy_cdr3) + 1) // 2 + 1) AS s FROM cdr_rows
    WHERE regexp_full_match(heavy_cdr3, '[ACDEFGHIKLMNPQRSTVWY]+') AND length(heavy_cdr3) <= {CDR_WIDTH}), p AS (SELECT s, unnest(range(0, {CDR_WIDTH})) AS pos FROM a)
SELECT pos, strpos('ACDEFGHIKLMNPQRSTVWY-', substr(s, pos + 1, 1)) - 1 AS code, count(*) AS n FROM p GROUP BY ALL""",
    "a1_group_counts": "SELECT species, count(*) AS n, count(*) FILTER (length(trim(heavy_chain)) > 0) AS heavy, count(*) FILTER (length(trim(light_chain)) > 0) AS light FROM full_chains GROUP BY species",
    "n3_prefilter": """
WITH c AS (SELECT seq_id, heavy_chain AS s FROM full_chains WHERE regexp_full_match(heavy_chain, '[A-Z]+')),
kg AS (SELECT chain, replace(aligned_seq, '-', '') AS s FROM germlines WHERE segment = 'V'),
k AS (SELECT DISTINCT chain, substr(s, i, 9) AS kmer FROM (SELECT *, unnest(range(1, 15)) AS i FROM kg)),
jg AS (SELECT chain, replace(aligned_seq, '-', '') AS s FROM germlines WHERE segment = 'J'),
sc AS (SELECT chain, i AS o, substr(s, i + 1, 1) AS a, count(*) AS score FROM (SELECT *, unnest(range(0, 10)) AS i FROM jg) WHERE i < length(s) GROUP BY ALL),
ch AS (SELECT DISTINCT chain FROM germlines),
pos AS (SELECT seq_id, s, unnest(range(0, length(s))) AS i FROM c),
hit AS (SELECT seq_id, chain, i FROM pos JOIN k ON k.kmer = substr(s, i + 1, 9) WHERE i < length(s) - 9),
win AS (SELECT seq_id, chain, count(*) OVER (PARTITION BY seq_id, chain ORDER BY i RANGE BETWEEN CURRENT ROW AND 13 FOLLOWING) AS n FROM hit),
nt AS (SELECT seq_id, chain, max(n) AS n_score FROM win GROUP BY ALL),
cs AS (SELECT seq_id, chain, i, sum(score) AS t FROM (SELECT *, unnest(range(0, 10)) AS o FROM pos WHERE i < length(s) - 5) p JOIN sc ON sc.o = p.o AND sc.a = substr(p.s, p.i + p.o + 1, 1) GROUP BY ALL),
ct AS (SELECT seq_id, chain, max(t) AS c_score FROM cs GROUP BY ALL)
SELECT c.seq_id, ch.chain, coalesce(n_score, 0) AS n_score, coalesce(c_score, 0)::double AS c_score FROM c CROSS JOIN ch LEFT JOIN nt ON nt.seq_id = c.seq_id AND nt.chain = ch.chain LEFT JOIN ct ON ct.seq_id = c.seq_id AND ct.chain = ch.chain""",
    "n4_trim": f"""
WITH {NUM}, i AS (SELECT *, list_transform(num, lambda c: regexp_extract(c, '\\d+')::int BETWEEN 5 AND 120) AS b FROM n),
s AS (SELECT *, list_position(b, true) AS f FROM i), e AS (SELECT *, coalesce(list_position(b[f:], false) - 1, len(b) - f + 1) AS m FROM s)
SELECT seq_id, substr(seq, f, m) AS seq, array_to_string(num[f:f + m - 1], '_') AS numbering, f - 1 AS start, f - 1 + m AS stop FROM e""",
    "n5_sort_codes": f"WITH {NUM} SELECT seq_id, array_to_string(list_transform(list_sort(list_transform(num, lambda c: {{'k': {_key('c')}, 'c': c}})), lambda s: s.c), '_') AS codes FROM n",
    "n6_region_labels": f"WITH {NUM} SELECT seq_id, " + ", ".join(f"array_to_string(list_transform(num, lambda c: {_label(s)}), '_') AS labels_{s}" for s in ("imgt", "kabat", "north")) + " FROM n",
    "n7_cdr_numbering": "SELECT cdr_id, " + ", ".join(f"CASE WHEN heavy_cdr{k} IS NOT NULL THEN {_cdr_codes(f'heavy_cdr{k}', k)} END AS codes{k}" for k in (1, 2, 3)) + " FROM cdr_rows",
    "n8_msa": f"WITH {NUM}, u AS (SELECT DISTINCT unnest(num) AS c FROM n), o AS (SELECT list(c ORDER BY {_key('c')}) AS codes FROM u) SELECT seq_id, {_aligned('codes')} AS aligned FROM n, o",
    "n9_template_align": f"WITH {NUM} SELECT seq_id, {_aligned(_list(TEMPLATE.codes))} AS aligned FROM n",
    "n10_unusual_positions": f"WITH {NUM} SELECT seq_id, {_aligned(_list(ga.IMGT_CODES))} AS aligned, array_to_string(list_filter(num, lambda c: NOT list_contains({_list(ga.IMGT_CODES)}, c)), '_') AS unusual FROM n",
    "n12_region_slice": f"WITH {NUM}, t AS (SELECT seq_id, {_aligned(_list(TEMPLATE.codes))} AS a FROM n) SELECT seq_id, {_slice('cdr')} AS cdr, {_slice('cdr3')} AS cdr3, {_slice('fmwk1')} AS fmwk1 FROM t",
    "n14_alignment_maps": f"WITH {NUM} SELECT seq_id, array_to_string(list_transform(num, lambda c: coalesce(list_position({_list(TEMPLATE.codes)}, c), 0) - 1), ',') AS forward, array_to_string(list_transform({_list(TEMPLATE.codes)}, lambda c: coalesce(list_position(num, c), 0) - 1), ',') AS back FROM n",
    "n16_cdr_text": f"WITH {NUM} SELECT seq_id, " + ", ".join(f"array_to_string(list_transform(list_filter(range(1, length(seq) + 1), lambda i: {_label('imgt', 'num[i]')} = 'cdr{k}'), lambda i: substr(seq, i, 1)), '') AS cdr{k}" for k in (1, 2, 3)) + " FROM n",
    "l1_liabilities": _LIABILITIES + "SELECT seq_id, start, stop, description FROM h",
    "l3_liability_by_severity": _LIABILITIES + "SELECT description, count(*) AS hits, count(DISTINCT seq_id) AS sequences FROM h GROUP BY description",
    "v1_identity_argmax": _assign(_IDENTITY) + _OUT,
    "v2_evalue_argmax": _assign(_EVALUE) + _OUT,
    "v3_any_species": _assign(_IDENTITY, True) + _OUT,
    "v4_gene_parse": f"WITH {_GENE} SELECT * FROM u",
    "v5_gene_reassemble": "SELECT seq_id, string_split(heavy_vgene, '_')[1] AS name FROM full_chains WHERE heavy_vgene <> ''",
    "v6_gene_sequences": "WITH n AS (SELECT DISTINCT unnest(string_split(heavy_vgene, '_')) AS gene_name, species FROM full_chains WHERE heavy_vgene <> '' AND species IS NOT NULL) SELECT n.gene_name, n.species, coalesce(g.aligned_seq, '') AS aligned_seq FROM n LEFT JOIN germlines g ON g.gene_name = n.gene_name AND g.species = n.species",
    "v7_gene_lists": "SELECT species, receptor, string_agg(gene_name, ' ' ORDER BY gene_name, aligned_seq) AS names, string_agg(aligned_seq, ' ' ORDER BY gene_name, aligned_seq) AS sequences FROM germlines GROUP BY ALL",
    "v10_gene_comparison": _assign(_IDENTITY) + """, m AS (SELECT seq_id, gene_species, unnest([{'g': v_gene, 'i': v_identity}, {'g': j_gene, 'i': j_identity}]) AS e FROM o), k AS (SELECT seq_id, gene_species, e.i AS identity, unnest(string_split(e.g, '_')) AS gene_name FROM m)
SELECT seq_id, 0 AS line, 'input' AS description, NULL::double AS identity, CASE WHEN v_gene = '' THEN 'no gene assigned' END AS error, a AS aligned FROM o
UNION ALL SELECT k.seq_id, 1, k.gene_name, k.identity, CASE WHEN g.aligned_seq IS NULL THEN 'unknown gene' END, g.aligned_seq FROM k LEFT JOIN germlines g ON g.gene_name = k.gene_name AND g.species = k.gene_species WHERE k.gene_name <> ''""",
    "v11_paired_panel": f"""
WITH h AS (SELECT seq_id, {_aligned(_list(TEMPLATE.codes), "heavy_chain", "string_split(heavy_numbering, '_')")} AS a, round(length(heavy_chain) / {len(TEMPLATE.codes)}::double, 6) AS i FROM full_chains WHERE {_CLEAN.format(s='heavy')}),
l AS (SELECT seq_id, {_aligned(_list(_LIGHT), "light_chain", "string_split(light_numbering, '_')")} AS a, round(length(light_chain) / {len(_LIGHT)}::double, 6) AS i FROM full_chains WHERE {_CLEAN.format(s='light')})
SELECT coalesce(h.seq_id, l.seq_id) AS seq_id, coalesce(h.a, repeat('-', {len(TEMPLATE.codes)})) AS heavy_aligned, coalesce(h.i, 0) AS heavy_identity, coalesce(l.a, repeat('-', {len(_LIGHT)})) AS light_aligned, coalesce(l.i, 0) AS light_identity FROM h FULL JOIN l ON h.seq_id = l.seq_id""",
}

#: Columns whose type in SQL isn"t that of the query.
_TYPES = {"e1_encode_position_counts": {"pos": "INTEGER", "code": "INTEGER"}, "n4_trim": {"stop": "INTEGER"}, "l1_liabilities": {"start": "INTEGER", "stop": "INTEGER"}}
SQL |= {name: typed(SQL[name], types) for name, types in _TYPES.items()}
