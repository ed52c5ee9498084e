"""Queries of smaller parts: counts before a build, order of files, rejects, encoded chunks, frames, model tables, SQL functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chainforge.functions import alphabet, positions
from chainforge.operators.annotate import reading_frames
from chainforge.operators.mixture import CategoricalMixture
from chainforge.plans.models import K, WIDTH, _scorer, aligned_cdrs, rule_model
from chainforge.plans.sequences import NUM, TEMPLATE, _aligned, _list, numbered
from chainforge.plans.typed import typed
from chainforge.register import register
from chainforge.runtime import folder, spread, store, table
from chainforge.sources import database as db
from chainforge.sources import files

REGIONS = {"fmwk1": (1, 26), "cdr1": (27, 38), "fmwk2": (39, 55), "cdr2": (56, 65), "fmwk3": (66, 104), "cdr3": (105, 117), "fmwk4": (118, 128)}
_CODONS = "GCT TGT GAT GAA TTT GGT CAT ATT AAA CTT ATG AAT CCT CAA CGT TCT ACT GTT TGG TAT".split()  # one codon each, in the order of RESIDUES


def s3_file_order(spark, sf):
    """Two folders with files of the same names, read in an order that is not theirs by name: ids follow the given order."""
    t = table(spark, sf, "fasta_records").select("rec_id", F.regexp_replace("sequence", "[^A-Za-z]", "").alias("s")).where(F.length("s") > 0)
    path = folder(spark)
    for part in (0, 1):
        files.write_fasta(t.where(F.col("rec_id") % 2 == part), F.col("rec_id").cast("string"), F.col("s"), f"{path}/{part}/same")
    got = files.with_ids(files.read_fasta(spark, [f"{path}/1/same", f"{path}/0/same"]))
    return got.groupBy((F.col("seqinfo").cast("long") % 2).alias("part")).agg(F.min("seq_id").alias("first"), F.max("seq_id").alias("last"), F.count("*").alias("n"))


def s4_cardinality(spark, sf):
    rows = [(n, files.count_records(table(spark, sf, n))) for n in ("cdr_rows", "fasta_records", "full_chains", "raw_records")]
    return spark.createDataFrame([(n, c, c > 0) for n, c in rows], "table_name string, n long, buildable boolean")


def s8_reject_sink(spark, sf):
    t = table(spark, sf, "full_chains").where(F.length("heavy_chain") > 0)
    bad = t.select(F.concat_ws(":", "seq_id", F.regexp_replace("heavy_chain", r"\s", "")).alias("text"), F.when(~alphabet.is_valid_sequence(F.col("heavy_chain")), "invalid").alias("code"))
    path = folder(spark)
    files.write_rejects(bad, F.col("text"), F.col("code"), path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("text"), parts[1].alias("code"))


def s10_open_database(spark, sf):
    columns = {c: c for c in ("heavy_cdr3", "heavy_cdr2", "heavy_cdr1", "light_cdr3", "light_cdr2", "light_cdr1", "heavy_vgene", "light_vgene", "heavy_jgene", "light_jgene", "species")} | {"seq_id": "cdr_id"}
    path = folder(spark)
    info = db.Info(memo="rows of CDRs")
    db.write_database(path, *db.from_cdrs(table(spark, sf, "cdr_rows"), columns), info)
    opened = db.Database(spark, path)
    return opened.sequences.agg(F.count("*").alias("n"), F.max("seq_id").alias("last")).withColumn("memo", F.lit(opened.metadata()["memo"]))


def s13_templates(spark, sf):
    """What the germlines of heavy V genes allow at each position, written as a template file and read back."""
    t = table(spark, sf, "germlines").where("chain = 'H' AND segment = 'V'").select(F.posexplode(F.split("aligned_seq", "")).alias("p", "a")).where("a <> '-'")
    lines = t.groupBy("p").agg(F.array_sort(F.collect_set("a")).alias("a")).select(F.concat_ws(",", (F.col("p") + 1).cast("string"), F.array_join("a", ",")).alias("value"))
    path = folder(spark)
    lines.unionAll(spark.createDataFrame([("# positions",), ("//",)], "value string")).write.text(path)
    return files.read_templates(spark, path).select("pos", F.array_join("allowed", "").alias("allowed"))


def s15_encoded_chunks(spark, sf):
    got = files.encode_to_parquet(aligned_cdrs(spark, sf), F.col("aligned"), WIDTH, folder(spark), 5_000)
    return got.select(F.posexplode("codes").alias("pos", "code")).groupBy("pos", "code").agg(F.count("*").alias("n"))


def s16_elements(spark, sf):
    line = F.concat_ws(",", F.col("cdr_id").cast("string"), F.coalesce("heavy_cdr3", F.lit("")), F.coalesce("light_cdr3", F.lit(" ")))
    t = table(spark, sf, "cdr_rows").select("cdr_id", line.alias("l"))
    return t.select("cdr_id", files.element(F.col("l"), 1).alias("heavy"), files.element(F.col("l"), 2).alias("light"), files.element(F.col("l"), 9).alias("none"))


def n11_align_region(spark, sf):
    return numbered(spark, sf).select("seq_id", TEMPLATE.align_region(F.col("seq"), F.col("num"), "cdr2").alias("cdr2"), TEMPLATE.align_region(F.col("seq"), F.col("num"), "fmwk4").alias("fmwk4"))


def n13_region_sizes(spark, sf):
    return spark.createDataFrame([(r, TEMPLATE.region_size(r)) for r in REGIONS], "region string, size int")


def n17_reading_frames(spark, sf):
    """Chains put into codons and onto the other strand, of whose six frames the first of that strand must give the chain again."""
    t = table(spark, sf, "full_chains").where(F.col("heavy_chain").rlike(rf"^[{alphabet.RESIDUES}]+\z")).select("seq_id", "heavy_chain")
    codon = F.create_map(*(F.lit(x) for kv in zip(alphabet.RESIDUES, _CODONS) for x in kv))
    dna = F.array_join(F.transform(alphabet.letters_of(F.col("heavy_chain")), lambda a: F.element_at(codon, a)), "")
    rows = store(spread(t).select("seq_id", F.reverse(F.translate(dna, "ACGT", "TGCA")).alias("dna")))
    return reading_frames(rows, "dna").where("frame = -1").select("seq_id", "frame", "protein")


def h3_positions(spark, sf):
    s = _scorer()
    mask = {r: s.standard_mask("H", r) for r in ("fmwk1", "cdr3")}
    return spark.createDataFrame([(i, c, mask["fmwk1"][i], mask["cdr3"][i]) for i, c in enumerate(s.standard_positions("H"))], "i int, code string, fmwk1 boolean, cdr3 boolean")


def h8_cluster(spark, sf):
    mu, weight, letters = _scorer().retrieve_cluster(1, "H")
    rows = [(p, letters[a], round(float(mu[0, p, a]), 8), round(weight, 8)) for p in range(mu.shape[1]) for a in range(len(letters))]
    return spark.createDataFrame(rows, "pos int, aa string, p double, weight double")


def h12_consensus(spark, sf):
    s = _scorer()
    return spark.createDataFrame([(k, s.consensus("H", k)) for k in range(K)], "cluster int, seq string")


def h12_samples(spark, sf):
    """Letters drawn for a cluster: how many sequences, and whether the commonest letters of the first position come as often as they should."""
    s = _scorer()
    n = 20_000
    mu = s.retrieve_cluster(2, "H")[0][0, 0]
    top = int(mu.argmax())
    first = F.sum(F.col("seq").startswith(alphabet.ALPHABET[top]).cast("long"))
    return s.sample(spark, "H", 2, n).agg(F.count("*").alias("n"), (F.abs(first / n - F.lit(float(mu[top]))) < 0.05).alias("often"))


def m8_initial_models(spark, sf):
    mu, w = CategoricalMixture(K, WIDTH).initialise(5).parameters()
    rows = [(k, p, round(float(mu[k, p].sum()), 9), round(float(w.sum()), 9)) for k in range(K) for p in range(WIDTH)]
    return spark.createDataFrame(rows, "k int, pos int, total double, weights double")


def m9_pruned(spark, sf):
    mu, w = rule_model(WIDTH).parameters()
    m = CategoricalMixture(K, WIDTH).load(mu, np.where(np.arange(K) == 1, 0.0, w)).prune()
    return spark.createDataFrame([(k, round(float(x), 9), round(float(m.mu[k, 0, 0]), 9)) for k, x in enumerate(m.weights)], "k int, w double, first double")


def m12_parameters(spark, sf):
    mu, w = CategoricalMixture.from_tables(*rule_model(WIDTH).to_tables(spark)).to_tables(spark)
    return mu.join(w, "k").select("k", "pos", "aa", F.round("p", 9).alias("p"), F.round("w", 9).alias("w"))


def m13_template_models(spark, sf):
    specs = {r: CategoricalMixture(2, template=TEMPLATE, region=r).specs() for r in REGIONS}
    return spark.createDataFrame([(r, s["sequence_length"], s["fitted"]) for r, s in specs.items()], "region string, sequence_length int, fitted boolean")


def u2_sql_functions(spark, sf):
    register(spark, model=rule_model(WIDTH))
    t = table(spark, sf, "cdr_rows").where(F.length("heavy_cdr3") > 0)
    sql = """SELECT cdr_id, clean_sequence(heavy_cdr3) AS cleaned, is_chain_sequence(heavy_cdr3) AS valid, gene_family(heavy_jgene) AS family,
        align_cdr(heavy_cdr3, 20) AS aligned, differences(heavy_cdr3, reverse(heavy_cdr3)) AS differ, mixture_score(align_cdr(heavy_cdr3, 20)) IS NOT NULL AS scored FROM {rows}"""
    return spark.sql(sql, rows=t)


def u2_fasta_source(spark, sf):
    path = folder(spark)
    files.write_fasta(table(spark, sf, "fasta_records"), F.col("seqinfo"), F.col("sequence"), path)
    register(spark)
    return spark.read.format("fasta").load(path).groupBy("seqinfo", "sequence").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        s3_file_order, s4_cardinality, s8_reject_sink, s10_open_database, s13_templates, s15_encoded_chunks, s16_elements, n11_align_region, n13_region_sizes,
        n17_reading_frames, h3_positions, h8_cluster, h12_consensus, h12_samples, m8_initial_models, m9_pruned, m12_parameters, m13_template_models, u2_sql_functions, u2_fasta_source,
    )
}

_LETTERS = "ACDEFGHIKLMNPQRSTVWY"
_CODES = f"c AS (SELECT unnest({_list(TEMPLATE.codes)}) AS code, unnest(range({len(TEMPLATE.codes)}))::int AS i), d AS (SELECT *, regexp_extract(code, '^\\d+')::int AS num FROM c)"
_REGION = "CASE " + " ".join(f"WHEN num <= {b} THEN '{r}'" for r, (_, b) in REGIONS.items()) + " END"


def _mu(length: int) -> str:
    """CTE mu of the rule model: k, pos, a, p."""
    weight = "(1.0::double + (7 * (k + 1) + 3 * (pos + 1) + 5 * (a + 1)) % 11)"
    return f"g AS (SELECT k::int AS k, pos::int AS pos, a::int AS a, {weight} AS x FROM range({K}) t(k), range({length}) u(pos), range(21) v(a)), mu AS (SELECT k, pos, a, substr('{alphabet.ALPHABET}', a + 1, 1) AS aa, x / sum(x) OVER (PARTITION BY k, pos) AS p, (k + 1) / {K * (K + 1) / 2} AS w FROM g)"


_VALID = f"regexp_full_match(heavy_cdr3, '[{_LETTERS}]+') AND length(heavy_cdr3) <= {WIDTH}"
_FIXED = f"substr(heavy_cdr3, 1, (length(heavy_cdr3) + 1) // 2) || repeat('-', {WIDTH} - length(heavy_cdr3)) || substr(heavy_cdr3, (length(heavy_cdr3) + 1) // 2 + 1)"
SQL = {
    "s3_file_order": """WITH t AS (SELECT rec_id % 2 AS part, count(*) AS n FROM fasta_records WHERE length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 0 GROUP BY 1)
SELECT part, CASE part WHEN 1 THEN 1 ELSE (SELECT n FROM t WHERE part = 1) + 1 END AS first, CASE part WHEN 1 THEN n ELSE (SELECT sum(n) FROM t)::bigint END AS last, n FROM t""",
    "s4_cardinality": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n, count(*) > 0 AS buildable FROM {n}" for n in ("cdr_rows", "fasta_records", "full_chains", "raw_records")),
    "s8_reject_sink": f"SELECT seq_id || ':' || regexp_replace(heavy_chain, '\\s', '', 'g') AS text, 'invalid' AS code FROM full_chains WHERE length(heavy_chain) > 0 AND NOT regexp_full_match(heavy_chain, '[{_LETTERS}X]+')",
    "s10_open_database": "SELECT count(*) AS n, max(cdr_id) AS last, 'rows of CDRs' AS memo FROM cdr_rows",
    "s13_templates": "WITH p AS (SELECT unnest(string_split(aligned_seq, '')) AS a, unnest(range(1, 129))::int AS pos FROM germlines WHERE chain = 'H' AND segment = 'V') SELECT pos, array_to_string(list_sort(list_distinct(list(a))), '') AS allowed FROM p WHERE a <> '-' GROUP BY pos",
    "s15_encoded_chunks": f"WITH a AS (SELECT {_FIXED} AS x FROM cdr_rows WHERE {_VALID}), e AS (SELECT x, unnest(range({WIDTH}))::int AS pos FROM a) SELECT pos, (strpos('{alphabet.ALPHABET}', substr(x, pos + 1, 1)) - 1)::int AS code, count(*) AS n FROM e GROUP BY ALL",
    "s16_elements": "SELECT cdr_id, nullif(trim(heavy_cdr3), '') AS heavy, nullif(trim(light_cdr3), '') AS light, NULL::varchar AS none FROM cdr_rows",
    "n11_align_region": f"WITH {NUM} SELECT seq_id, " + ", ".join(f"{_aligned(_list([TEMPLATE.codes[i] for i in TEMPLATE.kept(r)]))} AS {r}" for r in ("cdr2", "fmwk4")) + " FROM n",
    "n13_region_sizes": f"WITH {_CODES} SELECT {_REGION} AS region, count(*) AS size FROM d GROUP BY 1",
    "n17_reading_frames": f"SELECT seq_id, -1 AS frame, heavy_chain AS protein FROM full_chains WHERE regexp_full_match(heavy_chain, '[{_LETTERS}]+')",
    "h3_positions": f"WITH {_CODES} SELECT i, code, num <= 26 AS fmwk1, num BETWEEN 105 AND 117 AS cdr3 FROM d",
    "h8_cluster": f"WITH {_mu(len(TEMPLATE.codes))} SELECT pos, aa, round(p, 8) AS p, round(w, 8) AS weight FROM mu WHERE k = 1",
    "h12_consensus": f"WITH {_mu(len(TEMPLATE.codes))}, t AS (SELECT k, pos, aa, row_number() OVER (PARTITION BY k, pos ORDER BY p DESC, a) AS n FROM mu) SELECT k AS cluster, replace(string_agg(aa, '' ORDER BY pos), '-', '') AS seq FROM t WHERE n = 1 GROUP BY k",
    "h12_samples": "SELECT 20000::bigint AS n, TRUE AS often",
    "m8_initial_models": f"SELECT k::int AS k, pos::int AS pos, 1.0::double AS total, 1.0::double AS weights FROM range({K}) t(k), range({WIDTH}) u(pos)",
    "m9_pruned": f"WITH {_mu(WIDTH)} SELECT (row_number() OVER (ORDER BY k) - 1)::int AS k, round(w, 9) AS w, round(p, 9) AS first FROM mu WHERE k <> 1 AND pos = 0 AND a = 0",
    "m12_parameters": f"WITH {_mu(WIDTH)} SELECT k, pos, aa, round(p, 9) AS p, round(w, 9) AS w FROM mu",
    "m13_template_models": f"WITH {_CODES} SELECT {_REGION} AS region, count(*) AS sequence_length, FALSE AS fitted FROM d GROUP BY 1",
    "u2_sql_functions": f"""SELECT cdr_id, upper(regexp_replace(heavy_cdr3, '[^A-Za-z]', '', 'g')) AS cleaned, regexp_full_match(heavy_cdr3, '[{_LETTERS}X]+') AS valid, regexp_extract(heavy_jgene, '^[A-Z]+([0-9]+)', 1) AS family,
    CASE WHEN length(heavy_cdr3) <= {WIDTH} THEN {_FIXED} END AS aligned, hamming(heavy_cdr3, reverse(heavy_cdr3))::int AS differ, coalesce({_VALID}, FALSE) AS scored FROM cdr_rows WHERE length(heavy_cdr3) > 0""",
    "u2_fasta_source": "SELECT trim(regexp_replace(regexp_replace(seqinfo, '[\\r\\n]+', ' ', 'g'), '\\t', ' ', 'g')) AS seqinfo, regexp_replace(sequence, '\\s', '', 'g') AS sequence, count(*) AS n FROM fasta_records WHERE length(seqinfo) > 0 AND length(sequence) > 0 GROUP BY 1, 2",
}

#: Columns whose type in SQL isn't that of the query.
_TYPES = {"n13_region_sizes": {"size": "INTEGER"}, "m13_template_models": {"sequence_length": "INTEGER"}, "n17_reading_frames": {"frame": "INTEGER"}}
SQL |= {name: typed(SQL[name], types) for name, types in _TYPES.items()}
