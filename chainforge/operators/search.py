"""Exact similarity search and single-linkage clustering over CDRs, and their indices.

The differences of two CDR3 texts of m and n letters, each set from both ends into a fixed width, are |m - n| gaps and the mismatches
in the columns that both fill: the left columns of the shorter left half and the right ones of the shorter right half. If at
most ``most`` are allowed, those columns are cut into most - |m - n| + 1 blocks, of which a pair within the budget has at least one
equal. So candidates come from an equi-join on (lengths, block, its letters, and the genes if they must be equal), without loss;
they are verified exactly. The columns are dealt to the blocks in turn, as CDR3 begin and end alike: a block of neighbouring columns at an end
would be the same letters in most rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainforge.functions.alphabet import hamming, letters_of
from chainforge.functions.positions import Template, align_cdr
from chainforge.operators.components import clean_edges, min_label_components
from chainforge.operators.linkage import bucket_links
from chainforge.runtime import store

CDR_WIDTHS = {1: 17, 2: 20, 3: 36}
#: Chains that are searched together.
CHAIN_GROUPS = {"H": "H", "K": "KL", "L": "KL", "B": "BD", "D": "BD", "A": "AG", "G": "AG"}


@dataclass(frozen=True)
class SearchSettings:
    """Settings of a search; arguments out of range raise an error."""

    mode: str = "3"
    cdr_cutoff: float = 0.25
    blosum_cutoff: float = -1
    max_length_shift: int = 2
    symmetric: bool = False
    most_cutoff: float = 0.3

    def __post_init__(self):
        if self.mode not in ("3", "123"):
            raise ValueError("mode is '3' or '123'")
        if not 0 <= self.cdr_cutoff <= self.most_cutoff:
            raise ValueError(f"cdr_cutoff is between 0 and {self.most_cutoff}")
        if self.blosum_cutoff != -1 and self.blosum_cutoff < 0:
            raise ValueError("blosum_cutoff is -1 or not negative")
        if self.max_length_shift < 0:
            raise ValueError("max_length_shift isn't negative")


def prepare(df: DataFrame, seq_id: Column, chain: Column, cdrs: dict[int, Column], v: Column | None = None, j: Column | None = None, species: Column | None = None, noncanonical: Column | None = None) -> DataFrame:
    """seq_id, chain_group, cdr1-3 (letters), aln1-3 (fixed width), len1-3, v, j, species, n_noncanonical: rows as K1 needs them (K3).

    Missing cdr1 and cdr2 are empty. Rows without CDR3 letters, or with CDRs wider than the fixed widths, are left out; ``left_out``
    lists them. Filters that aren't given are null.
    """
    none = F.lit(None).cast("string")
    group = F.element_at(F.create_map(*(F.lit(x) for kv in CHAIN_GROUPS.items() for x in kv)), chain)
    text = {k: F.coalesce(cdrs[k], F.lit("")) if k in cdrs else F.lit("") for k in (1, 2, 3)}
    return df.select(
        seq_id.cast("long").alias("seq_id"), group.alias("chain_group"),
        *(text[k].alias(f"cdr{k}") for k in text), *(align_cdr(text[k], CDR_WIDTHS[k]).alias(f"aln{k}") for k in text), *(F.length(text[k]).alias(f"len{k}") for k in text),
        (none if v is None else v).alias("v"), (none if j is None else j).alias("j"), (none if species is None else species).alias("species"),
        (F.lit(0) if noncanonical is None else noncanonical).cast("int").alias("n_noncanonical"),
    ).where("len3 > 0 AND aln1 IS NOT NULL AND aln2 IS NOT NULL AND aln3 IS NOT NULL AND chain_group IS NOT NULL")


def left_out(df: DataFrame, seq_id: Column, chain: Column, cdrs: dict[int, Column]) -> DataFrame:
    """seq_id, reason: the rows that ``prepare`` leaves out, by the first that applies of ``chain`` (unknown), ``missing`` (no CDR3) and ``wide``."""
    group = F.element_at(F.create_map(*(F.lit(x) for kv in CHAIN_GROUPS.items() for x in kv)), chain)
    wide = F.greatest(*(F.length(F.coalesce(c, F.lit(""))) - CDR_WIDTHS[k] for k, c in {1: F.lit(""), 2: F.lit(""), **cdrs}.items())) > 0
    reason = F.when(group.isNull(), "chain").when(F.coalesce(F.length(cdrs[3]), F.lit(0)) == 0, "missing").when(wide, "wide")
    return df.select(seq_id.cast("long").alias("seq_id"), reason.alias("reason")).where("reason IS NOT NULL")


def _budget(length: Column, cutoff: float) -> Column:
    return F.floor(length * F.lit(float(cutoff))).cast("int")


def _blocks(df: DataFrame, s: SearchSettings, own_is_query: bool) -> DataFrame:
    """df with lq, lh, block, part: a row for each length of the other side and each block of the columns both fill."""
    own = F.col("len3")
    others = df.withColumn("other", F.explode(F.sequence(F.greatest(own - s.max_length_shift, F.lit(1)), own + s.max_length_shift)))
    lq, lh = (own, F.col("other")) if own_is_query else (F.col("other"), own)
    both = others.withColumn("lq", lq).withColumn("lh", lh)
    left = F.least(F.ceil(F.col("lq") / 2), F.ceil(F.col("lh") / 2)).cast("int")
    right = F.least(F.floor(F.col("lq") / 2), F.floor(F.col("lh") / 2)).cast("int")
    both = both.withColumn("room", _budget(F.col("lq"), s.cdr_cutoff) - F.abs(F.col("lq") - F.col("lh"))).where("room >= 0")
    shared = F.concat(F.substring(F.col("cdr3"), F.lit(1), left), F.substring(F.col("cdr3"), F.length("cdr3") - right + 1, right))
    both = both.withColumn("shared", shared).withColumn("n", F.least(F.col("room") + 1, F.greatest(left + right, F.lit(1)))).withColumn("w", left + right)
    cut = both.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # as many blocks as columns or fewer than the room allows: no block need be equal, so all such pairs are candidates
    free = F.col("room") >= F.col("w")
    part = F.when(free, F.lit("")).otherwise(_block(F.col("shared"), F.col("block"), F.col("n")))
    return cut.withColumn("part", part).where(~free | (F.col("block") == 0)).drop("other", "room", "w")


def _block(shared: Column, block: Column, n: Column) -> Column:
    """The letters of a block: every n-th column from ``block`` on."""
    return F.array_join(F.filter(letters_of(shared), lambda _, i: i % n == block), "")


def candidates(queries: DataFrame, database: DataFrame, s: SearchSettings, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of prepared rows, as q and h structs, that may be within the CDR3 budget; ``same`` columns must be equal.

    A pair comes out once for each block that it shares, with ``first`` true for the least of these.
    """
    keep = ["seq_id", "aln1", "aln2", "aln3", "len1", "len2", "len3", "v", "j", "species", "n_noncanonical", "shared"]
    key = ["chain_group", "lq", "lh", "block", "part", *same]
    q = _blocks(queries, s, True).select(*key, "n", F.struct(*keep).alias("q"))
    h = _blocks(database, s, False).select(*key, F.struct(*keep).alias("h"))
    before = F.filter(F.sequence(F.lit(0), F.col("block")), lambda b: b < F.col("block"))
    first = ~F.exists(before, lambda b: _block(F.col("q.shared"), b, F.col("n")) == _block(F.col("h.shared"), b, F.col("n")))
    return q.join(h, key).select("q", "h", first.alias("first"))


def _distances(pairs: DataFrame, s: SearchSettings) -> DataFrame:
    q, h = (lambda c: F.col(f"q.{c}")), (lambda c: F.col(f"h.{c}"))
    three = pairs.withColumn("d3", hamming(q("aln3"), h("aln3")))
    budget3 = _budget(q("len3"), s.cdr_cutoff)
    budget12 = _budget(q("len1") + q("len2"), s.cdr_cutoff)
    if s.symmetric:
        budget3 = F.least(budget3, _budget(h("len3"), s.cdr_cutoff))
        n12 = h("len1") + h("len2")
        # only the regions of the mode count, so in mode 3 the bucket of the others stays open
        budget12 = F.when(n12 > 0, F.least(budget12, _budget(n12, s.cdr_cutoff))).otherwise(budget12) if s.mode == "123" else budget12
    kept = three.where((F.col("d3") <= budget3) & (F.abs(q("len3") - h("len3")) <= s.max_length_shift))
    if s.mode == "123":
        kept = kept.withColumn("d12", hamming(q("aln1"), h("aln1")) + hamming(q("aln2"), h("aln2"))).where(F.col("d12") <= budget12)
    else:
        kept = kept.withColumn("d12", F.lit(0))
    return kept.withColumn("distance", (F.col("d12") + F.col("d3")).cast("double"))


def _blosum(pairs: DataFrame, s: SearchSettings, distances: dict[tuple[str, str], float]) -> DataFrame:
    """Keep pairs whose worst mismatch is within the cutoff; their distance is the sum of mismatch distances."""
    lookup = F.create_map(*(F.lit(x) for (a, b), d in distances.items() for x in (a + b, float(d))))
    regions = (1, 2, 3) if s.mode == "123" else (3,)
    text = lambda side: F.concat(*(F.col(f"{side}.aln{k}") for k in regions))
    cells = F.zip_with(letters_of(text("q")), letters_of(text("h")), lambda a, b: F.coalesce(F.element_at(lookup, F.concat(a, b)), F.lit(0.0)))
    scored = pairs.withColumn("cells", cells)
    return scored.where(F.array_max("cells") <= s.blosum_cutoff).withColumn("distance", F.aggregate("cells", F.lit(0.0), lambda x, y: x + y)).drop("cells")


def search(queries: DataFrame, database: DataFrame, settings: SearchSettings = SearchSettings(), same: tuple[str, ...] = (), distances: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """query_id, seq_id, distance, n_noncanonical: all rows of the database within the cutoffs of each query.

    Both sides come from ``prepare``. same: which of v, j and species must be equal (a null filter of a query matches nothing then;
    leave the column out to ignore it). distances: mismatch distances for a blosum_cutoff. Many queries are one join. A row given twice
    with one id is a row each.
    """
    pairs = candidates(queries, database, settings, same)
    kept = _distances(pairs, settings)
    if settings.blosum_cutoff >= 0:
        if distances is None:
            raise ValueError("blosum_cutoff needs distances")
        kept = _blosum(kept, settings, distances)
    kept = kept.where("first")  # a pair may share several blocks
    return kept.select(F.col("q.seq_id").alias("query_id"), F.col("h.seq_id").alias("seq_id"), "distance", F.col("h.n_noncanonical").alias("n_noncanonical"))


def ranked(hits: DataFrame) -> DataFrame:
    """hits with rank: 1, 2, ... within each query by distance, then id, then the number of noncanonical letters (A10)."""
    order = Window.partitionBy("query_id").orderBy("distance", "seq_id", "n_noncanonical")
    return hits.withColumn("rank", F.row_number().over(order))


def single_linkage(prepared: DataFrame, every: DataFrame, settings: SearchSettings, by_jgene: bool = True, distances: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """seq_id, cluster: 0 for rows without the chain, 1 for rows without neighbours, else 2, 3, ... by least member.

    prepared: rows of ``prepare`` with v, j and species set; every: a seq_id column of all rows. Two rows are neighbours if chain
    group, CDR3 length, V gene, species and, unless by_jgene is off, J gene are equal and the cutoffs hold; rows that lack
    one of them have no neighbours. As in one search for each row, the wider budget of the two counts unless the settings are
    symmetric. Equal rows are collapsed first; no pairs are emitted (see linkage).
    """
    same = ("v", "species", *(["j"] if by_jgene else []))
    s = SearchSettings(settings.mode, settings.cdr_cutoff, settings.blosum_cutoff, 0, settings.symmetric, 0.25)
    cdrs = ["cdr1", "cdr2", "cdr3"]
    rows = store(prepared.where(" AND ".join(f"{c} IS NOT NULL" for c in same)))
    reps = rows.groupBy("chain_group", *same, *cdrs).agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("copies"))
    reps = store(prepare_again(reps, by_jgene))
    twins = rows.join(reps.select("chain_group", *same, *cdrs, F.col("seq_id").alias("rep")), ["chain_group", *same, *cdrs]).select(F.col("rep").alias("a"), F.col("seq_id").alias("b"))
    if s.blosum_cutoff >= 0 and distances is None:
        raise ValueError("blosum_cutoff needs distances")
    budgets = _blocks(reps, s, True).withColumn("b12", _budget(F.col("len1") + F.col("len2"), s.cdr_cutoff)).withColumn("b3", _budget(F.col("len3"), s.cdr_cutoff))
    links = bucket_links(budgets, ["chain_group", "lq", "block", "part", *same], s.mode, s.blosum_cutoff, distances, s.symmetric).unionAll(twins)
    found = store(min_label_components(store(clean_edges(links, "a", "b"))))
    ranks = dense_numbers(found.select("component").distinct(), "component")
    present = prepared.select("seq_id", F.lit(1).alias("present"))
    out = every.select("seq_id").join(present, "seq_id", "left").join(found.join(ranks, "component").select(F.col("node").alias("seq_id"), (F.col("number") + 1).alias("c")), "seq_id", "left")
    return out.select("seq_id", F.when(F.col("present").isNull(), 0).otherwise(F.coalesce("c", F.lit(1))).cast("long").alias("cluster"))


def prepare_again(reps: DataFrame, by_jgene: bool) -> DataFrame:
    """Prepared columns of rows that have their CDRs and genes."""
    j = F.col("j") if by_jgene else F.lit(None).cast("string")
    return reps.select(
        "seq_id", "chain_group", "cdr1", "cdr2", "cdr3", *(align_cdr(F.col(f"cdr{k}"), CDR_WIDTHS[k]).alias(f"aln{k}") for k in (1, 2, 3)), *(F.length(f"cdr{k}").alias(f"len{k}") for k in (1, 2, 3)),
        "v", j.alias("j"), "species", F.lit(0).alias("n_noncanonical"),
    )


def dense_numbers(df: DataFrame, key: str) -> DataFrame:
    """key, number: 1, 2, ... by key, without gathering the keys in one task. Keys must be distinct.

    The keys are range-partitioned and stored; each partition numbers its own, and the partitions' sizes, one row each, give offsets.
    """
    ranged = store(df.select(key).repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").count()
    offsets = sizes.select("__p", (F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__o"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return ranged.withColumn("__n", within).join(F.broadcast(offsets), "__p").select(key, (F.col("__n") + F.col("__o")).cast("long").alias("number"))


def kmer_counts(prepared: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """chain_group, position, kmer, length, count: k-mers of the fixed-width CDR3 by column and CDR3 length, without all-gap ones (K5)."""
    def at_columns(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length("aln3") - k), lambda i: F.struct(i.alias("position"), F.substring(F.col("aln3"), i + 1, F.lit(k)).alias("kmer")))

    at = F.flatten(F.array(*(at_columns(k) for k in sizes)))
    cells = prepared.select("chain_group", F.col("len3").alias("length"), F.explode(at).alias("e")).select("chain_group", "length", "e.*")
    return cells.where(~F.col("kmer").rlike("^-+$")).groupBy("chain_group", "position", "kmer", "length").agg(F.count("*").alias("count"))


#: Letters that a tag doesn't tell apart share a code (K6).
_TAG_CODES = {a: i for i, group in enumerate(("CMPX", "DE", "KR", "NQ", "A", "F", "G", "H", "I", "L", "S", "T", "V", "W", "Y", "-")) for a in group}


def tag_planes(aln3: Column, columns: int = 16) -> Column:
    """array<long> of 4 bit planes over the first and last columns of a fixed-width CDR3 (K6)."""
    half = columns // 2
    ends = F.concat(F.substring(aln3, 1, half), F.substring(aln3, -half, half))
    codes = F.create_map(*(F.lit(x) for kv in _TAG_CODES.items() for x in kv))
    values = F.transform(letters_of(ends), lambda c: F.coalesce(F.element_at(codes, c), F.lit(0)))

    def plane(p: int) -> Column:
        bits = F.transform(values, lambda v, i: F.when(F.shiftright(v, p).bitwiseAND(F.lit(1)) == 1, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x + y)

    return F.array(*(plane(p) for p in range(4)))


def tag_lower_bound(a: Column, b: Column) -> Column:
    """A lower bound of the differences of two CDR3 over the tagged columns."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    return F.bit_count(differ)


def row_counts(prepared: DataFrame, sequences: DataFrame) -> DataFrame:
    """kind, n: rows of all, heavy and light chains (K7)."""
    kinds = prepared.groupBy(F.when(F.col("chain_group").isin("H", "BD"), "heavy").otherwise("light").alias("kind")).agg(F.count("*").alias("n"))
    return sequences.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), "n").unionAll(kinds)


def max_id(sequences: DataFrame, seq_id: str = "seq_id") -> DataFrame:
    """max_seq_id, null of an empty table (K8)."""
    return sequences.agg(F.max(seq_id).alias("max_seq_id"))


def lookup(hits: DataFrame, sequences: DataFrame, columns: list[str], seq_id: str = "seq_id") -> DataFrame:
    """hits with the named columns of their rows; ids that aren't there have empty texts."""
    return hits.join(sequences.select(seq_id, *columns), seq_id, "left").fillna("", columns)


def distance_edges(df: DataFrame, row_id: str, aligned: str, template: Template, region: str = "all", within: tuple[str, ...] = (), max_rows: int = 20_000) -> DataFrame:
    """i, j, distance for all pairs i < j of equally long aligned texts, over the columns of a region.

    The result is quadratic by definition, so it is refused beyond max_rows rows; similarity at scale is ``search``. within: only
    pairs with equal values of these columns.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"a distance matrix of more than {max_rows} rows; use search")
    if not df.where(F.length(aligned) != len(template.codes)).isEmpty():
        raise ValueError("a sequence isn't as long as the template")
    side = df.select(F.col(row_id).alias("id"), template.slice(F.col(aligned), region).alias("x"), *within)
    a, b = side.alias("a"), side.alias("b")
    on = F.col("a.id") < F.col("b.id")
    for c in within:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), hamming(F.col("a.x"), F.col("b.x")).cast("double").alias("distance"))
