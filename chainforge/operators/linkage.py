"""Links between similar CDR rows within candidate buckets, without emitting or comparing all pairs of a large bucket.

Rows that share a block of their CDR3 are a bucket. A small one is compared pair by pair. In a large one pivots are taken until every
row is linked to one or is one; of two linked rows x and y, y owned by pivot p, x is within twice the budgets of p, so only such x
are compared with the rows of p. A bucket gives links to the least row of each of its components, so the output is linear. Buckets above
``BUCKET_ROWS`` are cut into chunks of which every two meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainforge.functions.alphabet import letters_of
from chainforge.runtime import store

BUCKET_ROWS = 20_000
_SMALL = 48


def _letters(texts: list[str], width: int) -> np.ndarray:
    flat = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)
    return flat.reshape(len(texts), width)


class _Bucket:
    def __init__(self, a12: np.ndarray, a3: np.ndarray, b12: np.ndarray, b3: int, mode: str, blosum: float, table: np.ndarray | None, symmetric: bool):
        self.a12, self.a3, self.b12, self.b3, self.mode, self.blosum, self.table, self.symmetric = a12, a3, b12, b3, mode, blosum, table, symmetric

    def link(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(linked, CDR3 differences, CDR1 and 2 differences) of all rows x with all rows y."""
        d3 = (self.a3[x][:, None, :] != self.a3[y][None, :, :]).sum(2)
        hit = d3 <= self.b3
        d12 = np.zeros_like(d3)
        if self.mode == "123":
            d12 = (self.a12[x][:, None, :] != self.a12[y][None, :, :]).sum(2)
            pick = np.minimum if self.symmetric else np.maximum
            hit &= d12 <= pick(self.b12[x][:, None], self.b12[y][None, :])
        if self.table is not None:
            worst = self.table[self.a3[x][:, None, :], self.a3[y][None, :, :]].max(2)
            if self.mode == "123":
                worst = np.maximum(worst, self.table[self.a12[x][:, None, :], self.a12[y][None, :, :]].max(2))
            hit &= worst <= self.blosum
        return hit, d3, d12

    def components(self) -> np.ndarray:
        """The least index of each row's component."""
        n = len(self.a3)
        label = np.arange(n)
        every = np.arange(n)
        if n <= _SMALL:
            return _joined(label, *np.nonzero(self.link(every, every)[0]))
        owner = np.full(n, -1)
        near: list[np.ndarray] = []
        widest = int(self.b12.max())
        while (free := np.flatnonzero(owner < 0)).size:
            hit, d3, d12 = self.link(free[:1], every)
            mine = np.flatnonzero(hit[0])
            label = _joined(label, np.full(len(mine), free[0]), mine)
            owner[mine[owner[mine] < 0]] = len(near)
            owner[free[0]] = len(near)
            near.append(np.flatnonzero((d3[0] <= 2 * self.b3) & (d12[0] <= 2 * widest)))
        for p, x in enumerate(near):
            y = np.flatnonzero(owner == p)
            for s in range(0, len(y), 32):
                part = y[s : s + 32]
                one = np.unique(label[part])
                rest = x[label[x] != one[0]] if len(one) == 1 else x
                for k in range(0, len(rest), 512):
                    i, j = np.nonzero(self.link(rest[k : k + 512], part)[0])
                    label = _joined(label, rest[k : k + 512][i], part[j])
        return label


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        li, lj = label[i], label[j]
        apart = li != lj
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(li, lj)[apart], np.minimum(li, lj)[apart])
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def _parted(rows: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of buckets up to bucket_rows, rows of larger ones with the count of their bucket, or None)."""
    hot = store(rows.groupBy("h1", "h2").count().where(F.col("count") > bucket_rows))  # at most rows / bucket_rows buckets
    if hot.isEmpty():
        return rows, None
    return rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti"), rows.drop("count").join(F.broadcast(hot), ["h1", "h2"])


def bucket_links(blocks: DataFrame, key: list[str], mode: str, blosum: float, distances: dict[tuple[str, str], float] | None, symmetric: bool, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """a, b: links of rows to the least row of their component in each bucket. blocks: key, seq_id, aln1, aln2, aln3, b12, b3, shared, n."""
    table = None
    if blosum >= 0:
        table = np.zeros((128, 128))
        for (a, b), d in distances.items():
            table[ord(a), ord(b)] = d
    rows = blocks.select(F.xxhash64(*key).alias("h1"), F.xxhash64(F.lit(5), *key).alias("h2"), "seq_id", "aln1", "aln2", "aln3", "b12", "b3", "shared", "block", "n")
    columns = [c for c in rows.columns if c not in ("shared", "block", "n")]
    spread, hot = _parted(rows, bucket_rows)
    if hot is not None:
        outside = F.filter(letters_of("shared"), lambda _, i: i % F.col("n") != F.col("block"))
        again = hot.withColumn("outside", outside).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("b3"))))
        part = F.array_join(F.filter("outside", lambda _, i: i % (F.col("b3") + 1) == F.col("sub")), "")
        finer, hottest = _parted(again.withColumn("h2", F.xxhash64("h2", "sub", part)).select(*columns, "count"), bucket_rows)
        spread = spread.select(columns).unionAll(finer.select(columns))
        if hottest is not None:
            chunks = F.ceil(F.col("count") / max(1, bucket_rows // 2)).cast("int")
            met = hottest.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("seq_id"), F.col("chunks"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            spread = spread.unionAll(met.withColumn("h2", F.xxhash64("h2", F.least("c", "o"), F.greatest("c", "o"))).select(columns))
    spread = spread.select(columns)

    def work(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h1, h2, ids = (t[c].to_numpy() for c in ("h1", "h2", "seq_id"))
        start = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        text = {c: t[c].to_pylist() for c in ("aln1", "aln2", "aln3")}
        b12, b3 = t["b12"].to_numpy(), t["b3"].to_numpy()
        for s, e in zip(start, np.append(start[1:], len(h1))):
            if e - s < 2:
                continue
            a12 = _letters([x + y for x, y in zip(text["aln1"][s:e], text["aln2"][s:e])], len(text["aln1"][s]) + len(text["aln2"][s]))
            label = _Bucket(a12, _letters(text["aln3"][s:e], len(text["aln3"][s])), b12[s:e], int(b3[s]), mode, blosum, table, symmetric).components()
            own = ids[s:e]
            least = np.full(e - s, np.iinfo(np.int64).max)
            np.minimum.at(least, label, own)
            low = least[label]
            keep = low != own
            if keep.any():
                yield low[keep], own[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            got = list(work(t)) if t.num_rows else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[i] for g in got]), pa.int64()) for i in (0, 1)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < bucket_rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            h1, h2 = t["h1"].to_numpy(), t["h2"].to_numpy()
            last = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
            cut = int(last[-1]) + 1 if last.size else 0  # the last bucket may go on in the next batch
            yield from emit(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return spread.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(run, "a long, b long").distinct()


