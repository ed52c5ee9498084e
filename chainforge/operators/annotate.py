"""Numbering of raw sequences against chain profiles.

A profile is what germline sequences of one chain, aligned to the 128 IMGT positions, show at each position. A sequence is aligned to
every requested profile by dynamic programming over (letter, position), vectorised over the sequences of an Arrow batch and over
the positions, and keeps the best chain. The letters between the conserved positions around each CDR are then numbered by their
count alone, as IMGT does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainforge.functions.alphabet import RESIDUES, is_valid_sequence, validity_error
from chainforge.functions.positions import SCHEMES, imgt_cdr_codes, insertion_letters
from chainforge.functions.schemes import from_imgt

MAB_CHAINS, TCR_CHAINS = ("H", "K", "L"), ("A", "B", "D", "G")
POSITIONS = 128
#: Letters before and after each IMGT CDR that frame it: the last of the framework before, the first of the one after.
_CDRS = ((1, 26, 39), (2, 55, 66), (3, 104, 118))
#: Conserved residues (F3); they count where most germlines of the chain have them.
CONSERVED = {23: "C", 41: "W", 104: "C"}
_MATCH, _CONSERVED = 3.0, 4.0
_UNSEEN = -3.0  # a letter where the germlines of the chain have none
_SKIP_FRAMEWORK, _SKIP_CDR, _INSERT_FRAMEWORK, _INSERT_CDR = 2.5, 0.05, 6.0, 0.3

ANNOTATION = T.StructType(
    [
        T.StructField("numbering", T.ArrayType(T.StringType())),
        T.StructField("percent_identity", T.DoubleType()),
        T.StructField("chain", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
_ARROW = pa.struct([("numbering", pa.list_(pa.string())), ("percent_identity", pa.float64()), ("chain", pa.string()), ("error", pa.string())])


def chain_profiles(germlines: DataFrame) -> dict[str, np.ndarray]:
    """chain -> int[128, 20]: how often each residue is seen at each position of the aligned V and J genes of a chain.

    ``germlines``: chain, aligned_seq (128 characters). An aggregate to at most chains x 128 x 20 rows reaches the driver.
    """
    at = germlines.where(F.length("aligned_seq") == POSITIONS).select("chain", F.posexplode(F.split("aligned_seq", "")).alias("p", "a")).where(F.col("a").isin(*RESIDUES)).groupBy("chain", "p", "a").count()
    out: dict[str, np.ndarray] = {}
    for chain, p, a, n in at.collect():
        out.setdefault(chain, np.zeros((POSITIONS, 20), np.int64))[p, RESIDUES.index(a)] = n
    return out


def _check(chains, profiles) -> list[str]:
    chains = list(chains)
    if not chains or not (set(chains) <= set(MAB_CHAINS) or set(chains) <= set(TCR_CHAINS)):
        raise ValueError("chains are of H, K, L or of A, B, D, G and not of both")
    missing = [c for c in chains if c not in profiles]
    if missing:
        raise ValueError(f"no profile for chains {missing}")
    return chains


def _running_max(x: np.ndarray) -> np.ndarray:
    """Running maxima along the first axis by doubling, which numpy vectorises and its accumulate doesn't."""
    out = x.copy()
    step = 1
    while step < len(out):
        np.maximum(out[step:], out[:-step].copy(), out=out[step:])
        step *= 2
    return out


class _Aligner:
    def __init__(self, profile: np.ndarray):
        total = profile.sum(1, keepdims=True)
        self.allowed = np.concatenate([profile > 0, np.zeros((POSITIONS, 1), bool)], 1)  # letter 20: X
        seen = total[:, 0] > 0
        share = profile / np.maximum(total, 1)
        score = np.zeros((POSITIONS, 21), np.float32)
        score[:, :20] = np.clip(np.log2((share + 0.02) / 0.05), -1.3, _MATCH)
        score[~seen] = _UNSEEN
        cdr = np.zeros(POSITIONS, bool)
        for _, before, after in _CDRS:
            cdr[before : after - 1] = True
        score[cdr] = np.where(self.allowed[cdr], 0.2, 0.0)
        self.conserved = {p: aa for p, aa in CONSERVED.items() if share[p - 1, RESIDUES.index(aa)] > 0.5}
        for p, aa in self.conserved.items():
            score[p - 1] = -_CONSERVED
            score[p - 1, RESIDUES.index(aa)] = _CONSERVED
            score[p - 1, 20] = 0
        self.score, self.seen, self.cdr = score, seen & ~cdr, cdr
        skip = np.where(cdr, _SKIP_CDR, _SKIP_FRAMEWORK)
        skip[~seen & ~cdr] = 0.0
        self.skip = np.concatenate([[0.0], np.cumsum(skip)]).astype(np.float32)  # cost of leaving out positions 1..j
        inner = np.zeros(POSITIONS + 1, bool)
        for _, before, after in _CDRS:
            inner[before + 2 : after - 2] = True
        self.insert = np.where(inner, _INSERT_CDR, _INSERT_FRAMEWORK).astype(np.float32)
        self.insert[[0, POSITIONS]] = 0  # letters outside the domain

    def _rows(self, codes: np.ndarray, lengths: np.ndarray):
        """Best scores of each (position, sequence) after each letter, as (letter, after insert or match, before skips, after skips).

        Positions are the first axis, so every step is one vector operation over the sequences, running maxima included.
        """
        n = len(codes)
        skip, insert = self.skip[:, None], self.insert[:, None]
        h = np.repeat(-0.1 * skip, n, 1)  # leaving out either end of the domain costs little
        match = np.empty((POSITIONS, n), np.float32)
        for i in range(codes.shape[1]):
            np.take(self.score, codes[:, i], axis=1, out=match)
            match += h[:-1]
            now = h - insert
            better = match > now[1:]
            np.maximum(now[1:], match, out=now[1:])
            now += skip
            best = _running_max(now)
            h = best - skip
            yield i, better, now, best, h

    def _end(self, last: np.ndarray) -> np.ndarray:
        return last - (self.skip[-1] - self.skip)[:, None] * 0.1

    def scores(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        last = np.zeros((POSITIONS + 1, len(codes)), np.float32)
        for i, _, _, _, h in self._rows(codes, lengths):
            ended = np.flatnonzero(lengths == i + 1)
            if ended.size:
                last[:, ended] = h[:, ended]
        return self._end(last).max(0)

    def align(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The position of each letter from 1, 0 if it has none, for padded codes (n x longest)."""
        n, longest = codes.shape
        moves = np.zeros((longest, POSITIONS + 1, n), bool)  # whether the letter takes the position
        source = np.zeros((longest, POSITIONS + 1, n), np.int16)  # where a run of left-out positions that ends here came from
        last = np.zeros((POSITIONS + 1, n), np.float32)
        index = np.arange(POSITIONS + 1, dtype=np.int16)[:, None]
        for i, better, now, best, h in self._rows(codes, lengths):
            moves[i, 1:] = better
            source[i] = _running_max(np.where(now == best, index, np.int16(0)))
            ended = np.flatnonzero(lengths == i + 1)
            if ended.size:
                last[:, ended] = h[:, ended]
        j = self._end(last).argmax(0)
        where = np.zeros((n, longest), np.int16)
        rows = np.arange(n)
        for i in range(longest - 1, -1, -1):
            on = i < lengths
            j = np.where(on, source[i, j, rows], j)
            hit = on & moves[i, j, rows]
            where[hit, i] = j[hit]
            j = j - hit
        return where

    def identity(self, codes: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Share of the framework positions seen in the profile that hold an allowed residue."""
        on = where > 0
        p = np.maximum(where - 1, 0)
        good = on & self.allowed[p, codes] & self.seen[p]
        return good.sum(1) / max(1, int(self.seen.sum()))


def _codes(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), int(lengths.max())), 20, np.int8)
    table = np.full(128, 20, np.int8)
    for k, aa in enumerate(RESIDUES):
        table[ord(aa)] = k
    for r, s in enumerate(seqs):
        out[r, : len(s)] = table[np.frombuffer(s.encode(), np.uint8)]
    return out, lengths


def _number(length: int, where: np.ndarray) -> list[str]:
    """Codes of one sequence: aligned positions, CDRs by their letters, insertions of frameworks as 68A."""
    at = where[:length].astype(int)
    hit = np.flatnonzero(at)
    codes = ["-"] * length
    if not hit.size:
        return codes
    for i in hit:
        codes[i] = str(at[i])
    base, count = 0, 0
    for i in range(hit[0], hit[-1] + 1):  # letters without a position inside the domain
        if at[i]:
            base, count = at[i], 0
        else:
            codes[i] = f"{base}{insertion_letters(count)}"
            count += 1
    for cdr, before, after in _CDRS:
        left = np.flatnonzero((at > 0) & (at <= before))
        right = np.flatnonzero(at >= after)
        if left.size and right.size:
            s, e = left[-1] + 1, right[0]
            codes[s:e] = imgt_cdr_codes(cdr, e - s)
    return codes


def _error(seq: str, codes: list[str], conserved: dict[int, str]) -> str | None:
    at = dict(zip(codes, seq))
    wrong = [f"{p}" for p, aa in conserved.items() if at.get(str(p)) not in (aa, "X")]
    return f"Unexpected residue at conserved position {', '.join(wrong)}" if wrong else None


def annotate_batch(seqs: list[str | None], profiles: dict[str, np.ndarray], chains: list[str], block: int = 512) -> list[dict]:
    """Annotations of valid sequences; an invalid one has no numbering and an error."""
    aligners = {c: _Aligner(profiles[c]) for c in chains}
    out: list[dict | None] = [None] * len(seqs)
    usable = [i for i, s in enumerate(seqs) if s and not s.strip(RESIDUES + "X")]
    usable.sort(key=lambda i: len(seqs[i]))
    at = 0
    while at < len(usable):
        longest = len(seqs[usable[min(at + block, len(usable)) - 1]])
        take = max(1, min(block, 40_000_000 // (longest * (POSITIONS + 1) * 3)))  # bounds the memory of the trace
        part = usable[at : at + take]
        at += take
        codes, lengths = _codes([seqs[i] for i in part])
        scores = np.stack([aligners[c].scores(codes, lengths) for c in chains]) if len(chains) > 1 else np.zeros((1, len(part)))
        first = scores.argmax(0)
        chosen: list[tuple] = [()] * len(part)
        for k, c in enumerate(chains):  # only the best chain's alignment is traced back
            mine = np.flatnonzero(first == k)
            if mine.size:
                where = aligners[c].align(codes[mine], lengths[mine])
                for r, w, identity in zip(mine, where, aligners[c].identity(codes[mine], where)):
                    chosen[r] = (c, w, float(identity))
        for i, (c, where, identity) in zip(part, chosen):
            numbering = _number(len(seqs[i]), where)
            out[i] = {"numbering": numbering, "percent_identity": identity, "chain": c, "error": _error(seqs[i], numbering, aligners[c].conserved)}
    for i, s in enumerate(seqs):
        if out[i] is None:
            out[i] = {"numbering": ["-"] * len(s or ""), "percent_identity": 0.0, "chain": None, "error": "Sequence contains invalid characters"}
    return out


def _converted(got: dict, scheme: str) -> dict:
    return got if scheme == "imgt" or got["chain"] is None else {**got, "numbering": from_imgt(got["numbering"], got["chain"], scheme)}


def _check_scheme(chains: list[str], scheme: str) -> None:
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    if scheme != "imgt" and set(chains) & set(TCR_CHAINS):
        raise ValueError("T-cell receptors are numbered by IMGT only")


def annotate(df: DataFrame, seq: Column, profiles: dict[str, np.ndarray], chains=MAB_CHAINS, name: str = "annotation", scheme: str = "imgt") -> DataFrame:
    """df with a struct<numbering, percent_identity, chain, error> of the best of ``chains`` in a scheme.

    The numbering has a code per letter, ``-`` outside the domain. A null, empty or invalid sequence has an error that begins
    "Sequence contains invalid", identity 0 and no chain; a domain without its conserved residues has one that begins "Unexpected".
    """
    chains = _check(chains, profiles)
    _check_scheme(chains, scheme)
    shared = df.sparkSession.sparkContext.broadcast({c: profiles[c] for c in chains})  # 128 x 20 counts a chain
    rest = [c for c in df.columns if c != name]
    out_schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, ANNOTATION)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_converted(a, scheme) for a in annotate_batch(batch.column(batch.num_columns - 1).to_pylist(), shared.value, chains)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, _ARROW)], names=[*rest, name])

    return df.select(*rest, seq.alias("__seq")).mapInArrow(run, out_schema)


def annotate_paired(df: DataFrame, seq: Column, profiles: dict[str, np.ndarray], receptor: str = "mab", scheme: str = "imgt") -> DataFrame:
    """df with structs ``heavy`` and ``light``, whatever their order in the sequence.

    The better domain is found first; its letters are masked by cutting the sequence there, and the longer flank that fits best is
    annotated for the other. A sequence of one chain has a low identity and an error on the other. For T-cell receptors A and G
    count as heavy, B and D as light.
    """
    groups = {"mab": (("H",), ("K", "L")), "tcr": (("A", "G"), ("B", "D"))}
    if receptor not in groups:
        raise ValueError("receptor is mab or tcr")
    heavy, light = (_check([c for c in g if c in profiles], profiles) for g in groups[receptor])
    _check_scheme([*heavy, *light], scheme)
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    rest = [c for c in df.columns if c not in ("heavy", "light")]
    out_schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("heavy", ANNOTATION), T.StructField("light", ANNOTATION)])

    def spread(got: dict, start: int, n: int) -> dict:
        return {**got, "numbering": ["-"] * start + got["numbering"] + ["-"] * (n - start - len(got["numbering"]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(batch.num_columns - 1).to_pylist()
            whole = {g: annotate_batch(seqs, shared.value, g_chains) for g, g_chains in (("h", heavy), ("l", light))}
            out = {"h": list(whole["h"]), "l": list(whole["l"])}
            flanks: dict[str, list[tuple[int, int, str]]] = {"h": [], "l": []}
            for i, s in enumerate(seqs):
                if not s or whole["h"][i]["chain"] is None:
                    continue
                first = "h" if whole["h"][i]["percent_identity"] >= whole["l"][i]["percent_identity"] else "l"
                on = [k for k, c in enumerate(whole[first][i]["numbering"]) if c != "-"]
                if not on:
                    continue
                other = "l" if first == "h" else "h"
                for start, stop in ((0, on[0]), (on[-1] + 1, len(s))):
                    if stop > start:
                        flanks[other].append((i, start, s[start:stop]))
                out[other][i] = {"numbering": ["-"] * len(s), "percent_identity": 0.0, "chain": None, "error": "Unexpected: no second domain"}
            for g, chains in (("h", heavy), ("l", light)):
                for (i, start, part), got in zip(flanks[g], annotate_batch([f[2] for f in flanks[g]], shared.value, chains)):
                    if got["percent_identity"] > out[g][i]["percent_identity"]:
                        out[g][i] = spread(got, start, len(seqs[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([_converted(a, scheme) for a in out["h"]], _ARROW), pa.array([_converted(a, scheme) for a in out["l"]], _ARROW)], names=[*rest, "heavy", "light"])

    return df.select(*rest, seq.alias("__seq")).mapInArrow(run, out_schema)


def prefilter(df: DataFrame, seq_id: str, seq: str, kmers: DataFrame, scores: DataFrame, k: int = 9, window: int = 14, span: int = 10) -> DataFrame:
    """seq_id, chain, n_score, c_score: where a domain may begin and end.

    kmers: chain, kmer of N-terminal starts. n_score is the most hits of a chain among ``window`` successive starts of its k-mers.
    scores: chain, offset (from 0), residue, score. c_score is the highest sum of scores over ``span`` letters from any start, 0 at
    least; near the end the sum is cut off. Sequences shorter than what is looked for, and null ones, score 0. Both dictionaries are
    broadcast and refused beyond a million rows. One narrow pass: k-mers are whole numbers looked up by binary search, and the
    scores of a batch are sums of shifted look-ups.
    """
    most = 1_000_000
    words = kmers.select("chain", "kmer").distinct().limit(most + 1).collect()
    cells = scores.select("chain", "offset", "residue", "score").limit(most + 1).collect()
    if max(len(words), len(cells)) > most:
        raise ValueError("the dictionary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(([tuple(r) for r in words], [tuple(r) for r in cells]))
    kind = df.schema[seq_id].dataType
    base = 131

    def numbers(x: np.ndarray, size: int) -> np.ndarray:
        """The k-mers of rows of letters as numbers, exact for k up to 9."""
        out = np.zeros((len(x), max(0, x.shape[1] - size + 1)), np.uint64)
        for i in range(size):
            out = out * np.uint64(base) + x[:, i : i + out.shape[1]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cells = shared.value
        chains = sorted({w[0] for w in words} | {c[0] for c in cells})
        index = {c: np.unique([_kmer_number(w, base) for ch, w in words if ch == c and w and len(w) == k and w.isascii()]).astype(np.uint64) for c in chains}
        table = {c: np.zeros((span, 256)) for c in chains}
        for ch, offset, residue, score in cells:
            if offset < span and len(residue) == 1 and residue.isascii():
                table[ch][offset, ord(residue)] += score
        for batch in batches:
            seqs = batch.column(1).fill_null("").to_pylist()
            order = np.argsort([len(s) for s in seqs], kind="stable")
            n_out, c_out = np.zeros((len(seqs), len(chains)), np.int64), np.zeros((len(seqs), len(chains)))
            at = 0
            while at < len(order):
                part = order[at : at + max(1, min(1000, 4_000_000 // max(1, len(seqs[order[min(at + 999, len(order) - 1)]]))))]
                at += len(part)
                lengths = np.array([len(seqs[i]) for i in part])
                longest = int(lengths.max())
                x = np.zeros((len(part), longest), np.uint8)
                for r, i in enumerate(part):
                    x[r, : lengths[r]] = np.frombuffer(seqs[i].encode("latin-1", "replace"), np.uint8)
                if longest > k:
                    codes = numbers(x.astype(np.uint64), k)[:, : longest - k]
                    real = np.arange(codes.shape[1])[None, :] < (lengths - k)[:, None]
                if longest > 5:
                    starts = np.arange(longest - 5)[None, :] < (lengths - 5)[:, None]
                for j, ch in enumerate(chains):
                    if longest > k and len(index[ch]):
                        spot = np.minimum(np.searchsorted(index[ch], codes), len(index[ch]) - 1)
                        hits = ((index[ch][spot] == codes) & real).astype(np.int64)
                        sums = np.concatenate([np.zeros((len(part), 1), np.int64), hits.cumsum(1)], 1)
                        stop = np.minimum(np.arange(hits.shape[1]) + window, hits.shape[1])
                        n_out[part, j] = (sums[:, stop] - sums[:, :-1]).max(1)
                    if longest > 5:
                        total = np.zeros((len(part), longest - 5))
                        for o in range(span):
                            width = min(longest - 5, longest - o)
                            total[:, :width] += table[ch][o][x[:, o : o + width]]
                        c_out[part, j] = np.maximum(np.where(starts, total, 0).max(1), 0)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(seqs)), len(chains))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(chains * len(seqs), pa.string()), pa.array(n_out.ravel()), pa.array(c_out.ravel())], names=[seq_id, "chain", "n_score", "c_score"])

    schema = T.StructType([T.StructField(seq_id, kind), T.StructField("chain", T.StringType()), T.StructField("n_score", T.LongType()), T.StructField("c_score", T.DoubleType())])
    return df.select(seq_id, seq).mapInArrow(run, schema)


def _kmer_number(word: str, base: int) -> int:
    out = 0
    for ch in word:
        out = (out * base + ord(ch)) % (1 << 64)
    return out


_BASES = "TCAG"
#: The standard genetic code for codons in TCAG order.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reading_frames(df: DataFrame, dna: str) -> DataFrame:
    """df with frame (1-3, and -1 to -3 for the other strand) and protein, six rows per row (N17). Unknown codons become X."""
    codons = F.create_map(*(F.lit(x) for i, a in enumerate(_AMINO) for x in (_BASES[i // 16] + _BASES[i // 4 % 4] + _BASES[i % 4], a)))
    clean = F.translate(F.upper(F.regexp_replace(F.col(dna), r"\s", "")), "U", "T")
    strands = F.array(F.struct(F.lit(1).alias("sign"), clean.alias("s")), F.struct(F.lit(-1).alias("sign"), F.reverse(F.translate(clean, "ACGT", "TGCA")).alias("s")))
    strand, k = F.col("__s.s"), F.col("__k")
    n = F.floor((F.length(strand) - k) / 3).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    protein = F.array_join(F.transform(starts, lambda i: F.coalesce(F.element_at(codons, F.substring(strand, i * 3 + k + 1, F.lit(3))), F.lit("X"))), "")
    rows = df.where(F.col(dna).isNotNull()).select(*df.columns, F.explode(strands).alias("__s")).select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("__k"))
    return rows.select(*df.columns, (F.col("__s.sign") * (k + 1)).alias("frame"), protein.alias("protein"))


def best_frame(df: DataFrame, row_id: str, dna: str, profiles: dict[str, np.ndarray], chains=MAB_CHAINS) -> DataFrame:
    """row_id, frame, protein, annotation: the reading frame whose longest stretch without a stop is most like a chain."""
    stretch = F.sort_array(F.transform(F.split("protein", r"\*"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))), False)[0]["p"]
    frames = reading_frames(df.select(row_id, dna), dna).select(row_id, "frame", stretch.alias("protein"))
    scored = annotate(frames, F.col("protein"), profiles, chains)
    first = Window.partitionBy(row_id).orderBy(F.desc("annotation.percent_identity"), "frame")
    return scored.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


__all__ = ["annotate", "annotate_paired", "best_frame", "chain_profiles", "is_valid_sequence", "prefilter", "reading_frames", "validity_error"]
