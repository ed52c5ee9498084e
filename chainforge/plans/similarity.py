"""Queries of similarity search, distances and clustering, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainforge.functions import positions
from chainforge.functions.genes import parse_gene
from chainforge.functions.substitution import mismatch_distances
from chainforge.operators import search as se
from chainforge.operators.gene_assignment import IMGT_CODES
from chainforge.plans.sequences import numbered
from chainforge.plans.typed import typed
from chainforge.runtime import store, table

RESIDUES = r"^[ACDEFGHIKLMNPQRSTVWY]+\z"
W1, W2, W3 = (se.CDR_WIDTHS[k] for k in (1, 2, 3))
COLUMNS = [f"heavy_cdr{k}" for k in (1, 2, 3)]


#: What is done to the CDR3 of a query row, one planted query each: substitutions, and letters taken out or put in at the middle.
_EDITS = [("", 0), ("", 1), ("", 2), ("", 3), ("", 4), ("", 6), ("-", 0), ("+", 0), ("--", 0), ("-", 1), ("+", 2), ("---", 0)]
_NEW = "WYHKDE"


def edited(cdr3: Column, kind: Column) -> Column:
    middle = F.ceil(F.length(cdr3) / 2).cast("int")
    out = cdr3
    for k, (gap, n) in enumerate(_EDITS):
        x = cdr3
        if gap == "+":
            x = F.concat(F.substring(x, F.lit(1), middle), F.lit("G"), F.substring(x, middle + 1, F.lit(100)))
        elif gap:
            x = F.concat(F.substring(x, F.lit(1), middle - len(gap)), F.substring(x, middle + 1, F.lit(100)))
        if n:
            x = F.concat(F.substring(x, 1, 3), F.lit(_NEW[:n]), F.substring(x, 4 + n, 100))
        out = F.when((kind == k) & (F.length(cdr3) >= 10), x).otherwise(out)
    return out


def planted(rows: DataFrame) -> DataFrame:
    """seq_id (100 times the id and the number of the edit), cdr1, cdr3: the edited forms of rows id, cdr1, cdr3 with ids divisible by 100.

    Few rows are alike by nature, so that each row of the query set stands for one query with each edit, some of which are beyond the
    bounds. Every third has another CDR1, too. Stored, as the expressions are long.
    """
    t = rows.where(F.col("id") % 100 == 0).withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(len(_EDITS) - 1))))
    cdr1 = F.when((F.col("kind") % 3 == 0) & (F.length("cdr1") > 3), F.concat(F.substring("cdr1", 1, 2), F.lit("W"), F.substring("cdr1", 4, 100))).otherwise(F.col("cdr1"))
    return store(t.withColumn("cdr1", cdr1).withColumn("cdr3", edited(F.col("cdr3"), F.col("kind"))).withColumn("id", F.col("id") * 100 + F.col("kind")).drop("kind"))


def cdr_table(spark, sf, side: str = "heavy", edit: bool = False) -> DataFrame:
    """Prepared chains of cdr_rows; v is the J gene's family, as its V genes are typed by hand. edit: the planted queries.

    The query set is every row whose id is divisible by 100, against all rows.
    """
    t = table(spark, sf, "cdr_rows").where(F.col(f"{side}_cdr3").rlike(RESIDUES))
    t = t.select(F.col("cdr_id").alias("id"), *(F.col(f"{side}_cdr{k}").alias(f"cdr{k}") for k in (1, 2, 3)), F.col(f"{side}_jgene").alias("gene"), "species")
    t = planted(t) if edit else t
    j = parse_gene(F.when(F.col("gene").rlike("^IG.J"), F.col("gene")), F.col("species"))
    return se.prepare(t, F.col("id"), F.lit("H" if side == "heavy" else "K"), {k: F.col(f"cdr{k}") for k in (1, 2, 3)}, F.col("gene"), j["family"], F.col("species"))


def queries_of(df: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100, against all rows."""
    return df.where(F.col("seq_id") % 100 == 0)


def _search(spark, sf, settings: se.SearchSettings, same=(), distances=None, side: str = "heavy") -> DataFrame:
    return se.search(cdr_table(spark, sf, side, True), cdr_table(spark, sf, side), settings, same, distances)


def k1_search_cdr3(spark, sf):
    return _search(spark, sf, se.SearchSettings("3", 0.3))


def k1_search_cdr123(spark, sf):
    return _search(spark, sf, se.SearchSettings("123", 0.3))


def k1_length_shift(spark, sf):
    return _search(spark, sf, se.SearchSettings("3", 0.25, max_length_shift=0))


def k1_symmetric(spark, sf):
    return _search(spark, sf, se.SearchSettings("123", 0.3, symmetric=True))


def k1_gene_filter(spark, sf):
    return _search(spark, sf, se.SearchSettings("3", 0.3), ("j", "species"))


def k1_blosum(spark, sf):
    return _search(spark, sf, se.SearchSettings("3", 0.3, blosum_cutoff=7), (), mismatch_distances(gap=8.0))


def k1_light_cdr123(spark, sf):
    return _search(spark, sf, se.SearchSettings("123", 0.3), side="light")


def k1_light_symmetric(spark, sf):
    return _search(spark, sf, se.SearchSettings("123", 0.25, max_length_shift=1, symmetric=True), ("v", "species"), side="light")


def a10_ranked_hits(spark, sf):
    return se.ranked(_search(spark, sf, se.SearchSettings("3", 0.3), side="light"))


def chain_table(spark, sf) -> DataFrame:
    """Prepared heavy chains of full_chains, from their numbering."""
    t = numbered(spark, sf).where(F.col("seq").rlike(RESIDUES))
    cdr = {k: positions.imgt_cdr_text(F.col("seq"), F.col("num"), k) for k in (1, 2, 3)}
    v = F.substring_index("heavy_vgene", "*", 1)
    # stored, as every search reads them twice, and as the optimiser would else copy the extraction into each use and filter
    rows = store(t.select("seq_id", *(c.alias(f"c{k}") for k, c in cdr.items()), F.when(v != "", v).alias("v"), F.when(F.col("heavy_jgene") != "", F.col("heavy_jgene")).alias("j"), "species"))
    return se.prepare(rows, F.col("seq_id"), F.lit("H"), {k: F.col(f"c{k}") for k in cdr}, F.col("v"), F.col("j"), F.col("species"))


def k2_prepared_search(spark, sf):
    t = chain_table(spark, sf)
    return se.search(queries_of(t), t, se.SearchSettings("123", 0.25), ("v", "species"))


def k3_left_out(spark, sf):
    t = table(spark, sf, "cdr_rows")
    return se.left_out(t, F.col("cdr_id"), F.upper(F.substring("heavy_vgene", 3, 1)), {k: F.col(f"heavy_cdr{k}") for k in (1, 2, 3)})


def j5_cross_database_search(spark, sf):
    """Planted queries from full_chains, searched in a database of both tables' CDR3; ids of cdr_rows are negative there."""
    chains, cdrs = chain_table(spark, sf), cdr_table(spark, sf)
    database = chains.unionByName(cdrs.withColumn("seq_id", -F.col("seq_id")))
    rows = planted(chains.select(F.col("seq_id").alias("id"), "cdr1", "cdr3"))
    return se.search(se.prepare(rows, F.col("id"), F.lit("H"), {3: F.col("cdr3")}), database, se.SearchSettings("3", 0.2))


def j7_hit_lookup(spark, sf):
    hits = k1_search_cdr3(spark, sf)
    t = table(spark, sf, "cdr_rows").withColumnRenamed("cdr_id", "seq_id")
    return se.lookup(hits, t, ["heavy_cdr3", "lab"])


def k5_column_diversity(spark, sf):
    return se.kmer_counts(cdr_table(spark, sf))


def k6_tag_lower_bound(spark, sf):
    t = cdr_table(spark, sf).select("seq_id", "aln3").withColumn("tag", se.tag_planes(F.col("aln3")))
    hits = k1_search_cdr3(spark, sf).select("query_id", "seq_id", "distance")
    q = cdr_table(spark, sf, edit=True).select(F.col("seq_id").alias("query_id"), se.tag_planes(F.col("aln3")).alias("qt"))
    return hits.join(q, "query_id").join(t.select("seq_id", "tag"), "seq_id").select("query_id", "seq_id", F.col("distance"), se.tag_lower_bound(F.col("qt"), F.col("tag")).alias("bound"))


def k7_counts(spark, sf):
    t = table(spark, sf, "cdr_rows")
    light = se.prepare(t, F.col("cdr_id"), F.lit("K"), {3: F.col("light_cdr3")})
    return se.row_counts(cdr_table(spark, sf).unionAll(light), t)


def k8_max_id(spark, sf):
    return se.max_id(table(spark, sf, "cdr_rows"), "cdr_id")


def d1_distance_edges(spark, sf):
    t = positions.Template(IMGT_CODES, "H", "imgt")
    return se.distance_edges(table(spark, sf, "germlines"), "gene_id", "aligned_seq", t, "all", ("chain", "segment"))


def d1_region_distances(spark, sf):
    t = positions.Template(IMGT_CODES, "H", "imgt")
    return se.distance_edges(table(spark, sf, "germlines"), "gene_id", "aligned_seq", t, "cdr", ("chain", "segment"))


def c1_single_linkage(spark, sf):
    t = table(spark, sf, "full_chains")
    return se.single_linkage(chain_table(spark, sf), t, se.SearchSettings("123", 0.2))


def c1_single_linkage_cdr3(spark, sf):
    t = table(spark, sf, "cdr_rows").select(F.col("cdr_id").alias("seq_id"))
    return se.single_linkage(cdr_table(spark, sf), t, se.SearchSettings("3", 0.2), by_jgene=False)


QUERIES = {
    f.__name__: f
    for f in (
        k1_search_cdr3, k1_search_cdr123, k1_length_shift, k1_symmetric, k1_gene_filter, k1_blosum, k1_light_cdr123, k1_light_symmetric, a10_ranked_hits, k2_prepared_search, k3_left_out, j5_cross_database_search, j7_hit_lookup,
        k5_column_diversity, k6_tag_lower_bound, k7_counts, k8_max_id, d1_distance_edges, d1_region_distances, c1_single_linkage, c1_single_linkage_cdr3,
    )
}

# SQL: brute force over all pairs


def _fixed(c: str, w: int) -> str:
    return f"(substr({c}, 1, (length({c}) + 1) // 2) || repeat('-', {w} - length({c})) || substr({c}, (length({c}) + 1) // 2 + 1))"


def _prepared(name: str, source: str) -> str:
    """CTE of rows id, c1-c3, v, j, species with fixed widths and lengths."""
    return f"{name} AS (SELECT id, c1, c2, c3, length(c1) AS l1, length(c2) AS l2, length(c3) AS l3, {_fixed('c1', W1)} AS a1, {_fixed('c2', W2)} AS a2, {_fixed('c3', W3)} AS a3, v, j, species FROM {source} WHERE length(c1) <= {W1} AND length(c2) <= {W2} AND length(c3) BETWEEN 1 AND {W3})"


def _cdr_rows(side: str) -> str:
    return f"""SELECT cdr_id AS id, coalesce({side}_cdr1, '') AS c1, coalesce({side}_cdr2, '') AS c2, {side}_cdr3 AS c3, {side}_jgene AS v, CASE WHEN regexp_matches({side}_jgene, '^IG.J') THEN regexp_extract(substr(string_split({side}_jgene, '_')[1], 5), '^[^*]*') END AS j, species
    FROM cdr_rows WHERE regexp_full_match({side}_cdr3, '[ACDEFGHIKLMNPQRSTVWY]+')"""


def _planted(source: str) -> str:
    m, whens = "((length(c3) + 1) // 2)", []
    for k, (gap, n) in enumerate(_EDITS):
        x = f"(substr(c3, 1, {m}) || 'G' || substr(c3, {m} + 1))" if gap == "+" else f"(substr(c3, 1, {m} - {len(gap)}) || substr(c3, {m} + 1))"
        whens.append(f"WHEN {k} THEN substr({x}, 1, 3) || '{_NEW[:n]}' || substr({x}, {4 + n})")
    return f"""SELECT id * 100 + kind AS id, CASE WHEN kind % 3 = 0 AND length(c1) > 3 THEN substr(c1, 1, 2) || 'W' || substr(c1, 4) ELSE c1 END AS c1, c2,
    CASE WHEN length(c3) < 10 THEN c3 ELSE CASE kind {' '.join(whens)} END END AS c3, v, j, species FROM {source}, range({len(_EDITS)}) AS k(kind) WHERE id % 100 = 0"""


def _of(side: str) -> str:
    """CTEs p, all chains of a side, and pq, the planted queries."""
    return f"r AS ({_cdr_rows(side)}), rq AS ({_planted('r')}), {_prepared('p', 'r')}, {_prepared('pq', 'rq')}"


_CDRS, _LIGHT = _of("heavy"), _of("light")
_CHAINS = (
    "n AS (SELECT seq_id, heavy_chain AS seq, string_split(heavy_numbering, '_') AS num, heavy_vgene, heavy_jgene, species FROM full_chains WHERE regexp_full_match(heavy_chain, '[ACDEFGHIKLMNPQRSTVWY]+') AND len(string_split(heavy_numbering, '_')) = length(heavy_chain)), rc AS (SELECT seq_id AS id, "
    + ", ".join(f"array_to_string(list_transform(list_filter(range(1, length(seq) + 1), lambda i: regexp_extract(num[i], '\\d+')::int BETWEEN {a} AND {b}), lambda i: substr(seq, i, 1)), '') AS c{k}" for k, a, b in ((1, 27, 38), (2, 56, 65), (3, 105, 117)))
    + ", nullif(regexp_extract(heavy_vgene, '^[^*]*'), '') AS v, nullif(heavy_jgene, '') AS j, species FROM n), "
    + _prepared("pc", "rc")
)


def _hits(query: str, database: str, mode: str, cutoff: float, shift: int = 2, symmetric: bool = False, same: str = "TRUE", blosum: float | None = None, who: str = "TRUE") -> str:
    c = f"{cutoff}::double"
    budget3 = f"floor(q.l3 * {c})"
    budget12 = f"floor((q.l1 + q.l2) * {c})"
    if symmetric:
        budget3 = f"least({budget3}, floor(h.l3 * {c}))"
        budget12 = f"CASE WHEN h.l1 + h.l2 > 0 THEN least({budget12}, floor((h.l1 + h.l2) * {c})) ELSE {budget12} END"
    d12 = "hamming(q.a1, h.a1) + hamming(q.a2, h.a2)" if mode == "123" else "0"
    distance, more = "(d12 + d3)::double", "TRUE"
    if blosum is not None:
        text = "a1 || {s}.a2 || {s}.a3" if mode == "123" else "a3"
        q, h = "q." + text.format(s="q"), "h." + text.format(s="h")
        table_ = "MAP {" + ", ".join(f"'{a}{b}': {d}::double" for (a, b), d in mismatch_distances(gap=8.0).items()) + "}"
        cells = f"list_transform(range(1, length({h}) + 1), lambda i: element_at({table_}, substr({q}, i, 1) || substr({h}, i, 1))[1])"
        return f"SELECT query_id, seq_id, list_sum(cells)::double AS distance, 0 AS n_noncanonical FROM (SELECT q.id AS query_id, h.id AS seq_id, {cells} AS cells FROM {query} q JOIN {database} h ON {same} WHERE {who} AND abs(q.l3 - h.l3) <= {shift} AND hamming(q.a3, h.a3) <= {budget3} AND {d12} <= {budget12 if mode == '123' else 0}) WHERE list_max(cells) <= {blosum}"
    inner = f"SELECT q.id AS query_id, h.id AS seq_id, {d12} AS d12, hamming(q.a3, h.a3) AS d3, {budget12} AS b12, {budget3} AS b3 FROM {query} q JOIN {database} h ON {same} WHERE {who} AND abs(q.l3 - h.l3) <= {shift}"
    return f"SELECT query_id, seq_id, {distance} AS distance, 0 AS n_noncanonical FROM ({inner}) WHERE d3 <= b3 AND {more}" + (" AND d12 <= b12" if mode == "123" else "")


def _linkage(pre: str, rows: str, mode: str, cutoff: float, same: str, present: str, every: str) -> str:
    edges = _hits(rows, rows, mode, cutoff, 0, False, f"q.id <> h.id AND {same}", None, "TRUE")
    return f"""WITH RECURSIVE {pre}, e AS (SELECT query_id AS a, seq_id AS b FROM ({edges})), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS id, least(a, min(b)) AS c FROM reach GROUP BY a), k AS (SELECT id, dense_rank() OVER (ORDER BY c) + 1 AS n FROM g)
SELECT y.id AS seq_id, CASE WHEN z.id IS NULL THEN 0 ELSE coalesce(k.n, 1) END AS cluster FROM ({every}) y LEFT JOIN {present} z ON z.id = y.id LEFT JOIN k ON k.id = y.id"""


_SYMBOLS = "MAP {" + ", ".join(f"'{a}': {i}" for a, i in se._TAG_CODES.items()) + "}"


def _bits(side: str, p: int) -> str:
    ends = f"(substr({side}.a3, 1, 8) || substr({side}.a3, {W3 - 7}, 8))"
    return f"list_transform(range(1, 17), lambda i: (element_at({_SYMBOLS}, substr({ends}, i, 1))[1] // {2**p}) % 2)"


_DIFFER = " OR ".join(f"bq{p}[i] <> bh{p}[i]" for p in range(4))
_GERM = "SELECT a.gene_id AS i, b.gene_id AS j, {d}::double AS distance FROM germlines a JOIN germlines b ON a.gene_id < b.gene_id AND a.chain = b.chain AND a.segment = b.segment"
_CUT = lambda s: f"(substr({s}.aligned_seq, 27, 12) || substr({s}.aligned_seq, 56, 10) || substr({s}.aligned_seq, 105, 13))"

SQL = {
    "k1_search_cdr3": f"WITH {_CDRS} " + _hits("pq", "p", "3", 0.3),
    "k1_search_cdr123": f"WITH {_CDRS} " + _hits("pq", "p", "123", 0.3),
    "k1_length_shift": f"WITH {_CDRS} " + _hits("pq", "p", "3", 0.25, 0),
    "k1_symmetric": f"WITH {_CDRS} " + _hits("pq", "p", "123", 0.3, 2, True),
    "k1_gene_filter": f"WITH {_CDRS} " + _hits("pq", "p", "3", 0.3, same="q.j = h.j AND q.species = h.species"),
    "k1_blosum": f"WITH {_CDRS} " + _hits("pq", "p", "3", 0.3, blosum=7),
    "k1_light_cdr123": f"WITH {_LIGHT} " + _hits("pq", "p", "123", 0.3),
    "k1_light_symmetric": f"WITH {_LIGHT} " + _hits("pq", "p", "123", 0.25, 1, True, "q.v = h.v AND q.species = h.species"),
    "a10_ranked_hits": f"WITH {_LIGHT} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, seq_id, n_noncanonical)::int AS rank FROM (" + _hits("pq", "p", "3", 0.3) + ")",
    "k3_left_out": f"""SELECT cdr_id AS seq_id, CASE WHEN coalesce(upper(substr(heavy_vgene, 3, 1)), '?') NOT IN ('H', 'K', 'L', 'B', 'D', 'A', 'G') THEN 'chain' WHEN coalesce(length(heavy_cdr3), 0) = 0 THEN 'missing' ELSE 'wide' END AS reason FROM cdr_rows
    WHERE coalesce(upper(substr(heavy_vgene, 3, 1)), '?') NOT IN ('H', 'K', 'L', 'B', 'D', 'A', 'G') OR coalesce(length(heavy_cdr3), 0) = 0 OR length(heavy_cdr1) > {W1} OR length(heavy_cdr2) > {W2} OR length(heavy_cdr3) > {W3}""",
    "k2_prepared_search": f"WITH {_CHAINS} " + _hits("pc", "pc", "123", 0.25, same="q.v = h.v AND q.species = h.species", who="q.id % 100 = 0"),
    "j5_cross_database_search": f"WITH {_CDRS}, {_CHAINS}, e AS ({_planted('pc')}), {_prepared('pe', 'e')}, "
    + "every AS (SELECT * FROM pc UNION ALL SELECT * REPLACE (-id AS id) FROM p) " + _hits("pe", "every", "3", 0.2),
    "j7_hit_lookup": f"WITH {_CDRS}, x AS ({_hits('pq', 'p', '3', 0.3)}) SELECT x.*, coalesce(t.heavy_cdr3, '') AS heavy_cdr3, coalesce(t.lab, '') AS lab FROM x LEFT JOIN cdr_rows t ON t.cdr_id = x.seq_id",
    "k5_column_diversity": f"""WITH {_CDRS}, z AS (SELECT a3, l3, unnest([2, 3]) AS k FROM p), y AS (SELECT *, unnest(range(0, {W3} - k + 1)) AS position FROM z)
SELECT 'H' AS chain_group, position, substr(a3, position + 1, k) AS kmer, l3 AS length, count(*) AS count FROM y WHERE NOT regexp_full_match(substr(a3, position + 1, k), '-+') GROUP BY ALL""",
    "k6_tag_lower_bound": f"""WITH {_CDRS}, x AS ({_hits('pq', 'p', '3', 0.3)}), t AS (SELECT x.query_id, x.seq_id, x.distance, {", ".join(f"{_bits('q', p)} AS bq{p}, {_bits('h', p)} AS bh{p}" for p in range(4))} FROM x JOIN pq q ON q.id = x.query_id JOIN p h ON h.id = x.seq_id)
SELECT query_id, seq_id, distance, list_sum(list_transform(range(1, 17), lambda i: ({_DIFFER})::int)) AS bound FROM t""",
    "k7_counts": f"SELECT 'all' AS kind, count(*) AS n FROM cdr_rows UNION ALL SELECT 'heavy', count(*) FROM cdr_rows WHERE regexp_full_match(heavy_cdr3, '[ACDEFGHIKLMNPQRSTVWY]+') AND length(heavy_cdr3) <= {W3} AND length(coalesce(heavy_cdr1, '')) <= {W1} AND length(coalesce(heavy_cdr2, '')) <= {W2} UNION ALL SELECT 'light', count(*) FROM cdr_rows WHERE length(light_cdr3) BETWEEN 1 AND {W3}",
    "k8_max_id": "SELECT max(cdr_id) AS max_seq_id FROM cdr_rows",
    "d1_distance_edges": _GERM.format(d="hamming(a.aligned_seq, b.aligned_seq)"),
    "d1_region_distances": _GERM.format(d=f"hamming({_CUT('a')}, {_CUT('b')})"),
    "c1_single_linkage": _linkage(_CHAINS, "pc", "123", 0.2, "q.v = h.v AND q.species = h.species AND q.j = h.j", "pc", "SELECT seq_id AS id FROM full_chains"),
    "c1_single_linkage_cdr3": _linkage(_CDRS, "p", "3", 0.2, "q.v = h.v AND q.species = h.species", "p", "SELECT cdr_id AS id FROM cdr_rows"),
}

#: Columns whose type in SQL isn"t that of the query.
_TYPES = {"k5_column_diversity": {"position": "INTEGER", "length": "INTEGER"}, "k6_tag_lower_bound": {"bound": "INTEGER"}}
SQL |= {name: typed(SQL[name], types) for name, types in _TYPES.items()}
