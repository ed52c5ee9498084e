r"""Loading delimited record lines with the bad ones set apart.

Every block of lines (an Arrow batch) is parsed at once on the columnar CSV reader and checked by vectorised predicates. In a block that
does not pass as a whole, the predicates mark suspects: lines whose quotes or number of commas don't make the named fields, or whose values
are invalid. The block is cut at them, and what is left is parsed again; a piece that still fails is bisected down to single lines. Only
the suspects and such single lines are diagnosed by a strict scanner, which alone decides the reason.

Grammar: fields are separated by commas. A field that begins with a double quote ends at a double quote that stands directly before
a comma or the end of the line, holds commas and line breaks freely, and doubles every double quote inside. A double quote anywhere
else is an error. Nothing is trimmed. Reasons, the first that applies: ``quoting``, ``columns`` (not as many fields as named),
``value`` (seqinfo is blank or sequence is not one or more of the capitals ACDEFGHIKLMNPQRSTVWYX). A null or blank line is no
record: it is neither loaded nor rejected.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainforge.runtime import spread

FIELDS = ("seqinfo", "sequence", "vgene", "jgene", "species")
_LETTERS = r"\A[ACDEFGHIKLMNPQRSTVWYX]+\z"
#: What a line of the right shape looks like; RE2 runs it over a whole column. It is asked of lines with a quote only.
_SHAPE = r'(?s)\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*)){%d}\z'


def strict_fields(line: str) -> list[str] | None:
    """The fields of one line, or None if its quoting is broken."""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            parts, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                parts.append(line[at:close])
                if line[close + 1 : close + 2] == '"':
                    parts.append('"')
                    at = close + 2
                    continue
                at = close + 1
                break
            if at < n and line[at] != ",":
                return None
            fields.append("".join(parts))
        else:
            stop = line.find(",", at)
            stop = n if stop < 0 else stop
            if '"' in line[at:stop]:
                return None
            fields.append(line[at:stop])
            at = stop
        if at >= n:
            return fields
        at += 1


def diagnose(line: str, n_fields: int = len(FIELDS)) -> tuple[list[str] | None, str | None]:
    """(fields, None) of a valid line, (None, reason) of another."""
    fields = strict_fields(line)
    if fields is None:
        return None, "quoting"
    if len(fields) != n_fields:
        return None, "columns"
    if not fields[0].strip() or not fields[1] or fields[1].strip("ACDEFGHIKLMNPQRSTVWYX"):
        return None, "value"
    return fields, None


def _set_apart(lines: pa.Array, n_fields: int) -> np.ndarray:
    """Which lines the reader must not get: of a wrong shape, or with characters that it reads in its own way."""
    quoted = pc.match_substring(lines, '"')
    torn = pc.or_(pc.not_equal(pc.count_substring(lines, ","), n_fields - 1), pc.match_substring(lines, "\n"))  # of a line without quotes
    odd = pc.or_(pc.match_substring_regex(lines, r"[\r\x00]|\A\x{FEFF}"), pc.and_not(torn, quoted)).to_numpy(zero_copy_only=False).copy()
    shaped = pc.match_substring_regex(lines.filter(quoted), _SHAPE % (n_fields - 1)).to_numpy(zero_copy_only=False)
    odd[np.flatnonzero(quoted.to_numpy(zero_copy_only=False))] |= ~shaped
    return odd


def _read(lines: pa.Array, n_fields: int) -> pa.Table | None:
    """The columns of lines of the right shape on the columnar reader; None if it fails on them."""
    text = "\n".join(lines.to_pylist()).encode()
    names = [str(i) for i in range(n_fields)]
    try:
        got = pacsv.read_csv(
            io.BytesIO(text),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, 2 * len(text))),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return got.combine_chunks() if got.num_rows == len(lines) else None


def _invalid(t: pa.Table) -> np.ndarray:
    """Which rows have a blank first field or a second that is not letters of the alphabet."""
    blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(t.column(0))), 0)
    return pc.or_(blank, pc.invert(pc.match_substring_regex(t.column(1), _LETTERS))).to_numpy()


def _split(lines: pa.Array, n_fields: int) -> tuple[list[tuple[np.ndarray, pa.Table]], np.ndarray]:
    """(pieces of row numbers and their columns, all valid; the numbers of the lines for the strict scanner)."""
    odd = _set_apart(lines, n_fields)
    good: list[tuple[np.ndarray, pa.Table]] = []
    alone = [np.flatnonzero(odd)]
    todo = [np.flatnonzero(~odd)]
    while todo:
        at = todo.pop()
        if not len(at):
            continue
        t = _read(lines if len(at) == len(lines) else lines.take(pa.array(at)), n_fields)
        if t is not None:
            wrong = _invalid(t)
            alone.append(at[wrong])
            good.append((at[~wrong], t.filter(pa.array(~wrong)) if wrong.any() else t))
        elif len(at) == 1:
            alone.append(at)
        else:
            todo += [at[: len(at) // 2], at[len(at) // 2 :]]
    return good, np.sort(np.concatenate(alone))


def parse_records(df: DataFrame, record_id: Column, line: Column, fields: tuple[str, ...] = FIELDS, id_name: str = "raw_id") -> DataFrame:
    """id, ``fields``, reason: one row per record; reason is null and the fields are set where the line is valid, else the reverse.

    Null and blank lines give no row; an empty table gives none. The id may be null or repeated and is passed on. Other columns of
    ``df`` are not read. A narrow map without a shuffle: filter on ``reason`` to part the two outcomes.
    """
    n = len(fields)
    # blank as Python and Arrow have it: any Unicode white space
    slim = df.select(record_id.cast("long").alias("i"), line.alias("t")).where(F.col("t").isNotNull())
    schema = pa.schema([(id_name, pa.int64()), *((f, pa.string()) for f in fields), ("reason", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(1).cast(pa.string())
            batch = batch.filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0))
            if not batch.num_rows:
                continue
            lines, ids = batch.column(1).cast(pa.string()), batch.column(0)
            good, alone = _split(lines, n)
            for where, t in good:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(where)), *t.combine_chunks().to_batches()[0].columns, pa.nulls(len(where), pa.string())], schema=schema) if len(where) else pa.RecordBatch.from_pylist([], schema=schema)
            if len(alone):
                found = [diagnose(line, n) for line in lines.take(pa.array(alone)).to_pylist()]
                columns = list(zip(*(f or (None,) * n for f, _ in found)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(alone)), *(pa.array(c, pa.string()) for c in columns), pa.array([r for _, r in found], pa.string())], schema=schema)

    ddl = ", ".join([f"{id_name} long", *(f"`{f}` string" for f in fields), "reason string"])
    return spread(slim).mapInArrow(parse, ddl)
