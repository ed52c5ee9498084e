"""Per-key results over rows in key order, balanced by range partitioning.

The rows are range-partitioned on the composite of key and secondary order, with quantiles that Spark samples. A heavy key is thus
cut at its secondary order and takes as many partitions as its share of the rows needs; no task holds more than its range. Every
partition scans its sorted rows once and emits one partial state per run of equal keys. States of a key that crosses a boundary are
stitched afterwards; there are at most as many states as keys plus partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "n_rows long, n_distinct long, first_order long, last_order long, max_gap long"


def _scan(n_keys: int, n_sums: int, schema: pa.Schema):
    def states(batch: pa.RecordBatch) -> list[list]:
        """Columns of the batch's runs: keys, n_rows, n_distinct, first, last, max_gap, sums."""
        n = batch.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for i in range(n_keys):
            codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        start = np.flatnonzero(new)
        stop = np.append(start[1:], n)
        order = batch.column(n_keys)
        has = np.asarray(order.is_valid())
        o = order.fill_null(0).to_numpy(zero_copy_only=False)
        both = np.zeros(n, bool)
        both[1:] = has[1:] & has[:-1] & ~new[1:]
        step = np.zeros(n, np.int64)
        step[1:] = o[1:] - o[:-1]
        fresh = has & ~(both & (step == 0))
        low = np.where(has, o, np.iinfo(np.int64).max)
        high = np.where(has, o, np.iinfo(np.int64).min)
        some = np.logical_or.reduceat(has, start)
        out = [batch.column(i).take(pa.array(start)).to_pylist() for i in range(n_keys)]
        out += [(stop - start).tolist(), np.add.reduceat(fresh.astype(np.int64), start).tolist()]
        out += [[v if s else None for v, s in zip(np.minimum.reduceat(low, start).tolist(), some)]]
        out += [[v if s else None for v, s in zip(np.maximum.reduceat(high, start).tolist(), some)]]
        out += [np.maximum.reduceat(np.where(both, step, 0), start).tolist()]
        for i in range(n_sums):
            v = batch.column(n_keys + 1 + i).fill_null(0).to_numpy(zero_copy_only=False)
            out.append(np.add.reduceat(v, start).tolist())
        return out

    def joined(a: list, b: list) -> list:
        """The state of run a followed by run b of the same key."""
        k = n_keys
        n_rows, distinct, first, last, gap, *sums = a[k:]
        n2, distinct2, first2, last2, gap2, *sums2 = b[k:]
        if last is not None and first2 is not None:
            distinct2 -= first2 == last
            gap = max(gap, gap2, first2 - last)
        return [*a[:k], n_rows + n2, distinct + distinct2, first if first is not None else first2, last2 if last2 is not None else last, max(gap, gap2), *(x + y for x, y in zip(sums, sums2))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [list(r) for r in zip(*states(batch))]
            if carry is not None:
                if carry[:n_keys] == rows[0][:n_keys]:
                    rows[0] = joined(carry, rows[0])
                else:
                    rows.insert(0, carry)
            carry = rows.pop()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        if carry is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(carry, schema)], schema=schema)

    return scan


def run_states(df: DataFrame, keys: dict[str, Column], order: Column, sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per distinct key: ``keys``, n_rows, n_distinct (different order values), first_order, last_order, max_gap, ``sums``.

    keys: string expressions; a null key is a key of its own, apart from the empty string. order: a LONG; null order values count
    in n_rows only. sums: LONG expressions, null counting as 0. max_gap is the largest distance between neighbouring order values
    of the key, 0 if it has one. An empty table gives no rows. Columns of ``df`` that are not used are never read, so clashing
    names do no harm.
    """
    sums = sums or {}
    kn, sn = [f"k{i}" for i in range(len(keys))], [f"s{i}" for i in range(len(sums))]
    slim = df.select(*(c.cast("string").alias(n) for n, c in zip(kn, keys.values())), order.cast("long").alias("o"), *(c.cast("long").alias(n) for n, c in zip(sn, sums.values())))
    ranged = slim.repartitionByRange(partitions, *kn, "o") if partitions else slim.repartitionByRange(*kn, "o")
    ranged = ranged.sortWithinPartitions(*kn, "o")
    ddl = ", ".join([*(f"{n} string" for n in kn), _STATE, *(f"{n} long" for n in sn)])
    arrow = pa.schema([*((n, pa.string()) for n in kn), *((n, pa.int64()) for n in ("n_rows", "n_distinct", "first_order", "last_order", "max_gap", *sn))])
    partial = ranged.mapInArrow(_scan(len(kn), len(sn), arrow), ddl)
    beside = Window.partitionBy(*kn).orderBy(F.col("first_order").asc_nulls_first(), "last_order")
    stitched = partial.withColumn("seam", F.col("first_order") - F.lag("last_order").over(beside)).groupBy(*kn).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_distinct").alias("n_distinct"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.greatest(F.max("max_gap"), F.coalesce(F.max("seam"), F.lit(0))).alias("max_gap"),
        *(F.sum(n).alias(n) for n in sn),
    )
    return stitched.select(*(F.col(n).alias(name) for n, name in zip(kn, keys)), "n_rows", "n_distinct", "first_order", "last_order", "max_gap", *(F.col(n).alias(name) for n, name in zip(sn, sums)))
