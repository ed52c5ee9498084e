"""Clusters of mutually similar records among records of equal attributes.

A record is the set of its (position, letter) pairs. Two records of L letters that differ at d positions share L - d of 2 L pairs less
the shared ones, so their Jaccard similarity is (L - d) / (L + d): at most a tenth of the positions differ exactly if it is at
least 0.9 / 1.1. MinHash banding proposes pairs, the exact similarity verifies them, and connected components are the clusters.

Only records of equal attributes and length can be similar. The larger such a group is, the more rows a band has, so that about as many other
records share a band with a record in groups of any size; there are as many bands as make it less likely than ``MISS`` that a pair just at the limit
shares none (40 of 6 rows in small groups), and a closer pair is missed less.

The bands of a group are dealt to as many tasks as its size asks for: one for every ``piece_rows`` records, to which the group's records go, and which
works on its share of the bands. A small group is so one piece of a task that takes many. A group with more pieces than bands has its bands
cut by band key besides, as only equal keys must meet. No pairs leave a task, only links to the least record of what is linked in it, so the output
is linear in the records; the links of groups of several pieces are joined by the components operator.

Profiles need the degrees of a cluster, so every two of its records are compared. Clusters of up to ``block_rows`` different records are
split in one task. In larger ones chunks meet two by two and leave a bit for each pair; parts are then peeled off in rounds, of all
records at once that nothing within three steps outranks, until what is left of the cluster fits a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainforge.operators.components import min_label_components
from chainforge.runtime import Stored, store

#: Probability that no band of a pair just at the limit agrees.
MISS = 7e-7
#: Records that are worked on at once, and records of a group for each of its pieces.
BLOCK_ROWS, PIECE_ROWS = 20_000, 200_000
#: Pieces beyond which a group is cut by band key too.
MOST_PIECES = 40


def banding(size: int, differ: float) -> tuple[int, int]:
    """(rows of a band, bands) for groups of so many different records."""
    least = (1 - differ) / (1 + differ)
    if least == 1:
        return 6, 1
    rows = max(min(6, max(1, int(math.log(0.2) / math.log(least)))), math.ceil(math.log2(max(size, 1) / 400)))
    return rows, math.ceil(math.log(MISS) / math.log1p(-(least**rows)))


def band_keys(a: np.ndarray, groups: np.ndarray, rows: int, bands: range) -> Iterator[np.ndarray]:
    """For each of the bands the keys of the rows of a (letters as 0-26): equal keys, equal bands and groups."""
    n, length = a.shape
    if not length:
        yield groups.astype(np.uint64)
        return
    at = np.ascontiguousarray(a.T).astype(np.intp)
    together = max(1, 48 // rows)  # bands hashed at once: the values of all their hashes for a letter at a position lie side by side
    for first in range(0, len(bands), together):
        some = bands[first : first + together]
        table = np.concatenate([np.random.default_rng((b, rows, length, 20240517)).integers(0, 1 << 32, (length, 27, rows), dtype=np.uint32) for b in some], axis=2)
        least = np.empty((n, table.shape[2]), np.uint32)
        for s in range(0, n, 4096):
            best = least[s : s + 4096]
            np.take(table[0], at[0, s : s + 4096], axis=0, out=best, mode="clip")
            value = np.empty_like(best)
            for position in range(1, length):
                np.take(table[position], at[position, s : s + 4096], axis=0, out=value, mode="clip")
                np.minimum(best, value, out=best)
        for k, b in enumerate(some):
            key = groups.astype(np.uint64) ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            for row in range(k * rows, (k + 1) * rows):
                key = (key ^ least[:, row]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            yield key


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its component) after linking rows i and j."""
    while True:
        li, lj = label[i], label[j]
        apart = li != lj
        if not apart.any():
            return label
        i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
        low, high = np.minimum(li, lj), np.maximum(li, lj)
        np.minimum.at(label, high, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def bit_planes(a: np.ndarray) -> np.ndarray:
    """The letters of a (0-26) as words of 64 positions for each of their five bits: rows x 5 x words."""
    n, length = a.shape
    out = np.zeros((n, 5, 8 * max(1, -(-length // 64))), np.uint8)
    for bit in range(5):
        out[:, bit, : -(-length // 8)] = np.packbits((a >> bit) & 1, axis=1)
    return out.view(np.uint64)


def _alike(planes: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Whether rows i and j, pair by pair, differ at ``most`` positions or fewer."""
    out = np.empty(len(i), bool)
    for s in range(0, len(i), 20_000):
        x = planes[i[s : s + 20_000]] ^ planes[j[s : s + 20_000]]
        out[s : s + 20_000] = np.bitwise_count(np.bitwise_or.reduce(x, axis=1)).sum(1, dtype=np.int32) <= most
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many positions differ between each row of x and each of y (planes)."""
    d = np.zeros((len(x), len(y)), np.uint8 if x.shape[2] < 4 else np.int32)
    for word in range(x.shape[2]):
        columns = np.ascontiguousarray(y[:, :, word].T)
        differ = x[:, 0, word, None] ^ columns[0]
        more = np.empty_like(differ)
        for bit in range(1, 5):
            np.bitwise_xor(x[:, bit, word, None], columns[bit], out=more)
            np.bitwise_or(differ, more, out=differ)
        d += np.bitwise_count(differ)
    return d


def _link_run(planes: np.ndarray, run: np.ndarray, label: np.ndarray, most: int, short: int = 2048) -> np.ndarray:
    """Labels after linking all alike rows of a run.

    Of a long run not all pairs are compared: pivots are taken until every row is within ``most`` of one. Two alike rows x and y, y at pivot p,
    have x within 2 ``most`` of p, so only such x are compared with the rows of p.
    """
    rows = planes[run]
    if len(run) <= short:
        for s in range(0, len(run), 64):
            i, j = np.nonzero(_distances(rows[s : s + 64], rows[s:]) <= most)
            label = _merge(label, run[s + i], run[s + j])
        return label
    owner = np.full(len(run), -1)
    near: list[np.ndarray] = []
    while (free := np.flatnonzero(owner < 0)).size:
        d = _distances(rows[free[:1]], rows)[0]
        hit = np.flatnonzero(d <= most)
        owner[hit[owner[hit] < 0]] = len(near)
        label = _merge(label, run[np.full(len(hit), free[0])], run[hit])
        near.append(np.flatnonzero(d <= 2 * most))
    for p, x in enumerate(near):
        y = np.flatnonzero(owner == p)
        for s in range(0, len(y), 64):
            part = y[s : s + 64]
            one = np.unique(label[run[part]])
            xs = x[label[run[x]] != one[0]] if len(one) == 1 else x
            if len(xs):
                i, j = np.nonzero(_distances(rows[part], rows[xs]) <= most)
                label = _merge(label, run[part[i]], run[xs[j]])
    return label


def components_of(a: np.ndarray, groups: np.ndarray, differ: float, rows: int, bands: range) -> np.ndarray:
    """The least index of each row's component by these bands; only rows of equal groups can be linked. a: different rows of one length."""
    n, length = a.shape
    label = np.arange(n)
    most = int(differ * length + 1e-9)
    planes = bit_planes(a)
    for key in band_keys(a, groups, rows, bands):
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, n))
        pairs_i, pairs_j = [], []
        for step in range(1, min(int(size.max()), 32)):  # pairs of short runs, by their distance in the run
            longer = (size > step) & (size <= 32)
            if not longer.any():
                break
            s, m = start[longer], size[longer] - step
            at = np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            i, j = order[at], order[at + step]
            new = label[i] != label[j]
            pairs_i.append(i[new])
            pairs_j.append(j[new])
        if pairs_i:
            i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
            same = groups[i] == groups[j]
            i, j = i[same], j[same]
            hit = _alike(planes, i, j, most)
            label = _merge(label, i[hit], j[hit])
        for b in np.flatnonzero(size > 32):
            run = order[start[b] : start[b] + size[b]]
            for g in np.unique(groups[run]):  # one, but for equal hashes
                mine = run[groups[run] == g]
                if len(np.unique(label[mine])) > 1:
                    label = _link_run(planes, mine, label, most)
    return label


def _matrix(texts: pa.Array) -> np.ndarray:
    """Rows of equally long capital texts as 0-26 (26: no letter of A-Z)."""
    n = len(texts)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("ascii", "replace"), np.uint8)
    return np.minimum(flat - np.uint8(65), np.uint8(26)).reshape(n, -1) if n else np.empty((0, 0), np.uint8)


def _by_block(work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], block_rows: int, key: str = "g"):
    """mapInArrow function over rows sorted by (length, key): calls work with whole keys of one length, block_rows rows or a key at a time."""

    def cut(t: pa.Table, last: bool) -> Iterator[pa.Table]:
        length, g = t["length"].to_numpy(), t[key].to_numpy()
        new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (length[1:] != length[:-1])))
        ends = np.append(new[1:], len(g))
        at = 0
        for s, e in zip(new, ends):
            if s > at and (e - at > block_rows or length[s] != length[at]):
                yield t.slice(at, s - at)
                at = s
        if last:
            yield t.slice(at)
        else:
            keep = new[-1] if new[-1] > at else at
            if keep > at and at != keep:
                yield t.slice(at, keep - at)
            yield t.slice(keep)  # the last one may go on in the next batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < block_rows or held[0].column(key)[0] == batch.column(key)[-1]:
                continue
            *whole, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
            for t in whole:
                yield work(t, _matrix(t["letters"].combine_chunks()))
            held = rest.combine_chunks().to_batches()
            rows = rest.num_rows
        if held:
            for t in cut(pa.Table.from_batches(held).combine_chunks(), True):
                yield work(t, _matrix(t["letters"].combine_chunks()))

    return run


def distinct_records(df: DataFrame, record_id: Column, letters: Column, attributes: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, records). rows: seq_id, k1, k2; records: g, length, letters, k1, k2, rep_id, n, one per different record, in the shared folder.

    g stands for the attributes and the length, k1 and k2 for attributes and letters.
    """
    attrs = [F.coalesce(a.cast("string"), F.lit("\x00")) for a in attributes]
    base = df.select(record_id.cast("long").alias("seq_id"), letters.alias("letters"), *(a.alias(f"a{i}") for i, a in enumerate(attrs))).where("seq_id IS NOT NULL AND letters IS NOT NULL")
    names = [F.col(f"a{i}") for i in range(len(attrs))]
    length = F.length("letters")
    keyed = base.select("seq_id", "letters", length.alias("length"), F.xxhash64(*names, length).alias("g"), F.xxhash64(*names, "letters").alias("k1"), F.xxhash64("letters", F.lit(3), *names).alias("k2"))
    records = keyed.groupBy("g", "length", "letters", "k1", "k2").agg(F.min("seq_id").alias("rep_id"), F.count("*").alias("n"))
    return keyed.select("seq_id", "k1", "k2"), store(records)


_DEALT = "unit long, length int, g long, size long, piece int, pieces int, letters string, rep_id long, k1 long, k2 long, n long"
_OUT = "split boolean, rep_id long, k1 long, k2 long, n long, cluster_id long, total long"


def _unit(g: np.ndarray, piece: np.ndarray, part: np.ndarray) -> np.ndarray:
    x = (g.astype(np.uint64) ^ (piece.astype(np.uint64) << np.uint64(32)) ^ part.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(31)).view(np.int64)


def _deal(differ: float, piece_rows: int):
    """mapInArrow function: each record of a large group once for each piece of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, g, size = (batch.column(c).to_numpy() for c in ("length", "g", "size"))
            for value, sized in sorted(set(zip(length.tolist(), size.tolist()))):
                mine = batch.filter(pa.array((length == value) & (size == sized)))
                own = mine.column("g").to_numpy()
                pieces = min(MOST_PIECES, -(-sized // piece_rows))
                parts = -(-sized // (piece_rows * MOST_PIECES))
                rows, bands = banding(sized, differ)
                if parts > 1:
                    pieces = bands
                keys = band_keys(_matrix(mine.column("letters")), own, rows, range(bands)) if parts > 1 else None
                for piece in range(pieces):
                    part = (next(keys, own) % np.uint64(parts)).astype(np.int64) if parts > 1 else np.zeros(len(own), np.int64)
                    where = np.full(len(own), piece)
                    cols = [pa.array(_unit(own, where, part)), mine.column("length"), mine.column("g"), mine.column("size"), pa.array(where, pa.int32()), pa.array(np.full(len(own), pieces), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*cols, *(mine.column(c) for c in ("letters", "rep_id", "k1", "k2", "n"))], names=[c.split()[0] for c in _DEALT.split(", ")])

    return run


def _work(differ: float):
    def work(t: pa.Table, a: np.ndarray) -> pa.RecordBatch:
        reps, n, g, size, piece, pieces = (t[c].to_numpy() for c in ("rep_id", "n", "g", "size", "piece", "pieces"))
        out = []
        kinds, which = np.unique(np.stack([size, piece, pieces]), axis=1, return_inverse=True)
        for k, (sized, one, many) in enumerate(kinds.T.tolist()):
            mine = np.flatnonzero(which.ravel() == k)
            rows, bands = banding(sized, differ)
            label = components_of(a[mine], g[mine], differ, rows, range(one, bands, many))
            ids, copies = reps[mine], n[mine]
            least = np.full(len(mine), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids)
            total = np.zeros(len(mine), np.int64)
            np.add.at(total, label, copies)
            low, split = least[label], many > 1
            keep = np.flatnonzero(low != ids if split else total[label] > 1)
            out.append((np.full(len(keep), split), ids[keep], mine[keep], copies[keep], low[keep], total[label][keep]))
        split, ids, at, copies, low, total = (np.concatenate(x) for x in zip(*out))
        cols = [split, ids, t["k1"].to_numpy()[at], t["k2"].to_numpy()[at], copies, low, total]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in _OUT.split(", ")])

    return work


def record_clusters(records: DataFrame, differ: float, block_rows: int = BLOCK_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rep_id, k1, k2, n, cluster_id, total: the different records of clusters of more than one row, with the rows of each and of its cluster."""
    large = store(records.groupBy("g", "length").agg(F.count("*").alias("size")).where(F.col("size") > piece_rows))  # at most records / piece_rows
    keep = ["letters", "rep_id", "k1", "k2", "n"]
    whole = records if large.isEmpty() else records.join(F.broadcast(large), ["g", "length"], "left_anti")
    units = whole.select(F.col("g").alias("unit"), "length", "g", F.lit(1).cast("long").alias("size"), F.lit(0).alias("piece"), F.lit(1).alias("pieces"), *keep)
    if not large.isEmpty():
        big = records.join(F.broadcast(large), ["g", "length"])
        units = units.unionAll(big.select("length", "g", "size", *keep).mapInArrow(_deal(differ, piece_rows), _DEALT))
    found = units.repartition("unit", "length").sortWithinPartitions("length", "unit").mapInArrow(_by_block(_work(differ), block_rows, "unit"), _OUT)
    columns = ["rep_id", "k1", "k2", "n", "cluster_id", "total"]
    if large.isEmpty():
        return found.select(columns)
    found = store(found)
    linked = min_label_components(found.where("split").select(F.col("cluster_id").alias("a"), F.col("rep_id").alias("b")).distinct())
    labelled = big.select("rep_id", "k1", "k2", "n").join(linked.withColumnRenamed("node", "rep_id"), "rep_id", "left").withColumn("cluster_id", F.coalesce("component", "rep_id"))
    total = labelled.groupBy("cluster_id").agg(F.sum("n").alias("total")).where("total > 1")
    return found.where("NOT split").select(columns).unionAll(labelled.join(total, "cluster_id").select(columns))


def similarity_clusters(df: DataFrame, record_id: Column, letters: Column, attributes: list[Column], differ: float = 0.1, block_rows: int = BLOCK_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """cluster_id, seq_id: the rows of every cluster of more than one row, with its least seq_id.

    Two rows are alike if their attributes are equal, their letters are equally many and differ at no more than ``differ`` of the
    positions; a cluster holds what is linked by likeness directly or over others. Null attributes equal each other; rows with a null
    id or null letters are left out; rows without letters (an empty text) are alike. Exact copies are collapsed first and expanded
    at the end. An empty table gives no rows.
    """
    rows, records = distinct_records(df, record_id, letters, attributes)
    found = store(record_clusters(records, differ, block_rows, piece_rows))
    single = found.where("n = 1").select("cluster_id", F.col("rep_id").alias("seq_id"))
    copied = rows.join(found.where("n > 1").select("k1", "k2", "cluster_id"), ["k1", "k2"]).select("cluster_id", "seq_id")
    return single.unionAll(copied)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Whether each row of a differs from each of b (planes) at ``most`` positions or fewer, for 256 rows of a at a time."""
    for s in range(0, len(a), 256):
        yield _distances(a[s : s + 256], b) <= most


_BITS = "g long, c int, o int, rep_id long, bits binary"


def _pair_bits(members: DataFrame, differ: float) -> DataFrame:
    """g, c, o, rep_id, bits: for a record of chunk c a bit for each of chunk o, by ``at``, that tells whether the two are alike."""

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([("c", "ascending"), ("at", "ascending")])
        a, c, reps = _matrix(t["letters"].combine_chunks()), t["c"].to_numpy(), t["rep_id"].to_numpy()
        most = int(differ * a.shape[1] + 1e-9)
        a = bit_planes(a)
        out = []
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        for x, y in {(lo, hi), (hi, lo)}:
            mine, other = np.flatnonzero(c == x), a[c == y]
            bits = [row.tobytes() for near in _near(a[mine], other, most) for row in np.packbits(near, axis=1)]
            cols = [pa.array(np.full(len(mine), t["g"][0].as_py()), pa.int64()), pa.array(np.full(len(mine), x), pa.int32()), pa.array(np.full(len(mine), y), pa.int32()), pa.array(reps[mine], pa.int64()), pa.array(bits, pa.binary())]
            out.append(pa.table(cols, names=["g", "c", "o", "rep_id", "bits"]))
        return pa.concat_tables(out)

    met = members.select("g", "c", "at", "rep_id", "letters", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    met = met.select("g", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "c", "at", "rep_id", "letters")
    return met.groupBy("g", "lo", "hi").applyInArrow(meet, _BITS)


def _best_near(bits: DataFrame, free: DataFrame, asked: DataFrame) -> Stored:
    """``free`` with near (the number of ``asked`` records alike to each, itself included) and top, the greatest (d, m) of these.

    asked: g, c, at, chunks, d, m.
    """

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best, reps = np.zeros(left.num_rows, np.int64), np.full(left.num_rows, -1), left["rep_id"].to_numpy()
        d, m, at = (right[x].to_numpy() for x in ("d", "m", "at"))
        if left.num_rows and right.num_rows:
            order = np.lexsort((m, d))
            d, m, at = d[order], m[order], at[order]
            rows = left["bits"].to_pylist()
            rank = np.arange(len(at))
            for s in range(0, len(rows), 256):
                near = np.unpackbits(np.frombuffer(b"".join(rows[s : s + 256]), np.uint8).reshape(len(rows[s : s + 256]), -1), axis=1)[:, at].astype(bool)
                n[s : s + 256] = near.sum(1)
                best[s : s + 256] = np.where(near, rank, -1).max(1)
        hit = np.flatnonzero(best >= 0)
        return pa.table([pa.array(x, pa.int64()) for x in (reps[hit], n[hit], d[best[hit]], m[best[hit]])], names=["rep_id", "n_near", "d", "m"])

    chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")
    spread = asked.select("g", F.col("c").alias("o"), "at", "d", "m", "chunks").select("g", chunks, "o", "at", "d", "m")
    found = bits.groupBy("g", "c", "o").cogroup(spread.groupBy("g", "c", "o")).applyInArrow(look, "rep_id long, n_near long, d long, m long")
    found = found.groupBy("rep_id").agg(F.sum("n_near").alias("near"), F.max(F.struct("d", "m")).alias("top"))
    return Stored(free.join(found, "rep_id", "left"))


def _peel(records: DataFrame, differ: float, typical: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(parts, rest) of clusters above block_rows; rest has the records in no part yet, at most block_rows of a cluster.

    records: g (the cluster), length, letters, rep_id, n, count. Taking a part changes the degree of nothing farther than two steps from
    its medoid. A record that outranks all within three steps is therefore taken in the one-by-one order with the same part and
    degrees, whatever is taken before it, so that all such records are taken at once. Every round takes one of each cluster at least.
    """
    chunks = F.ceil(F.col("count") / max(1, block_rows // 2)).cast("int")
    dealt = records.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("rep_id"), F.col("chunks")).cast("int"))
    members = store(dealt.withColumn("at", F.row_number().over(Window.partitionBy("g", "c").orderBy("rep_id")) - 1).drop("count"))
    bits = store(_pair_bits(members, differ))
    state = ["g", "c", "at", "chunks", "rep_id", "n"]
    left = store(members.select(state))
    taken, rests = [], []
    while True:
        sizes = left.groupBy("g").count().where(F.col("count") > block_rows)
        rests.append(left.join(F.broadcast(sizes), "g", "left_anti").select("g", "rep_id"))
        free = store(left.join(F.broadcast(sizes), "g").select(state))
        if free.isEmpty():
            break
        own = free.select("g", "c", "at", "chunks", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("m"))
        steps = [_best_near(bits, free, own)]
        ranked = steps[0].df.select(*state, (F.col("near") - 1).alias("degree"), (F.col("near") - 1).alias("d"), (-F.col("rep_id")).alias("m"))
        for _ in range(3):
            steps.append(_best_near(bits, ranked.select(*state, "degree"), ranked))
            ranked = steps[-1].df.select(*state, "degree", F.col("top.d").alias("d"), F.col("top.m").alias("m"))
        medoids = ranked.where("m = -rep_id").select("g", "c", "at", "chunks", F.lit(0).cast("long").alias("d"), "m")
        found = _best_near(bits, ranked.select(*state, "degree"), medoids).df
        for step in steps:
            step.drop()
        taken.append(found.where("top IS NOT NULL").select("g", "rep_id", "n", "degree", (-F.col("top.m")).alias("medoid_id")))
        left = found.where("top IS NULL").select(state)

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            d = np.zeros(len(length), np.int64)
            for value in np.unique(length):
                same = pa.array(length == value)
                d[length == value] = (_matrix(batch.column("letters").filter(same)) != _matrix(batch.column("centre").filter(same))).sum(1)
            keep = batch.select(["g", "rep_id", "n", "degree", "medoid_id"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(d / np.maximum(length, 1))], names=[*keep.schema.names, "far"])

    every = taken[0]
    for more in taken[1:]:
        every = every.unionAll(more)
    centres = members.select(F.col("rep_id").alias("medoid_id"), F.col("letters").alias("centre"))
    rows = every.join(members.select("rep_id", "length", "letters"), "rep_id").join(centres, "medoid_id").select("g", "rep_id", "n", "degree", "medoid_id", "length", "letters", "centre")
    rows = rows.mapInArrow(differing, "g long, rep_id long, n long, degree long, medoid_id long, far double")
    place = F.row_number().over(Window.partitionBy("medoid_id").orderBy((F.col("rep_id") != F.col("medoid_id")), F.desc("degree"), "rep_id"))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= typical, F.struct("place", "rep_id"))))
    parts = rows.withColumn("place", place).groupBy(F.col("g").alias("cluster_id"), "medoid_id").agg(
        F.min("rep_id").alias("part_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_records"), F.transform(first, lambda x: x["rep_id"]).alias("typical_ids"), F.max("far").alias("radius")
    )
    rest = rests[0]
    for more in rests[1:]:
        rest = rest.unionAll(more)
    rest = rest.join(members.select("rep_id", "length", "letters", "n"), "rep_id").select("g", "length", "letters", "rep_id", "n")
    return parts.select("cluster_id", "part_id", "n_rows", "n_records", "medoid_id", "typical_ids", "radius"), rest


def cluster_profiles(df: DataFrame, record_id: Column, letters: Column, attributes: list[Column], differ: float = 0.1, typical: int = 3, block_rows: int = BLOCK_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """cluster_id, part_id, n_rows, n_records, medoid_id, typical_ids, radius: each cluster split into tight parts and described.

    A part forms around the record of the highest degree (alike records of the cluster that are in no part yet; ties go to the least
    id) and takes all that are alike to it, until every record is in one; a cluster whose records are all alike to its medoid is one
    part, and only loose ones are split. typical_ids are up to ``typical`` records of the part by degree, the medoid first; radius is
    the largest share of differing positions to the medoid. Parts are the same at every size: block_rows only decides whether a
    cluster is split in one task or in rounds over many. Clusters of one row don't come out.
    """
    _, records = distinct_records(df, record_id, letters, attributes)
    found = record_clusters(records, differ, block_rows, piece_rows)
    joined = store(found.join(records.select("rep_id", "length", "letters"), "rep_id").withColumnRenamed("cluster_id", "g"))

    def work(t: pa.Table, a: np.ndarray) -> pa.RecordBatch:
        reps, n, g = t["rep_id"].to_numpy(), t["n"].to_numpy(), t["g"].to_numpy()
        out: list[dict] = []
        edges = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        for s, e in zip(edges, np.append(edges[1:], len(g))):
            rows, ids, copies = bit_planes(a[s:e]), reps[s:e], n[s:e]
            length, m = a.shape[1], e - s
            most = int(differ * length + 1e-9)
            free = np.ones(m, bool)
            degree = np.concatenate([near.sum(1) for near in _near(rows, rows, most)]) - 1
            while free.any():
                left = np.flatnonzero(free)
                pivot = left[np.lexsort((ids[left], -degree[left]))[0]]
                d = _distances(rows[[pivot]], rows)[0]
                part = np.flatnonzero(free & (d <= most))
                free[part] = False
                rank = part[np.lexsort((ids[part], -degree[part], part != pivot))]
                out.append({"cluster_id": int(g[s]), "part_id": int(ids[part].min()), "n_rows": int(copies[part].sum()), "n_records": len(part), "medoid_id": int(ids[pivot]), "typical_ids": ids[rank[:typical]].tolist(), "radius": float(d[part].max() / max(length, 1))})
                for near in _near(rows[part], rows, most):  # degrees count the free ones only
                    degree -= near.sum(0)
        return pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("cluster_id", pa.int64()), ("part_id", pa.int64()), ("n_rows", pa.int64()), ("n_records", pa.int64()), ("medoid_id", pa.int64()), ("typical_ids", pa.list_(pa.int64())), ("radius", pa.float64())])
    slim = joined.select("g", "length", "letters", "rep_id", "n")
    out_type = "cluster_id long, part_id long, n_rows long, n_records long, medoid_id long, typical_ids array<long>, radius double"

    def split(rows: DataFrame) -> DataFrame:
        return rows.repartition("g").sortWithinPartitions("length", "g").mapInArrow(_by_block(work, block_rows), out_type)

    large = store(slim.groupBy("g").count().where(F.col("count") > block_rows))  # at most records / block_rows
    if large.isEmpty():
        return split(slim)
    parts, rest = _peel(slim.join(F.broadcast(large), "g"), differ, typical, block_rows)
    return split(slim.join(F.broadcast(large), "g", "left_anti").unionAll(rest)).unionAll(parts)
