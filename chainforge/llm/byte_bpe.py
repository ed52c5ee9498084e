"""Byte-level BPE of whole texts with a public vocabulary.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of theirs. So a piece is encoded
left to right without a merge loop: all tokens that occur in it are found in one Aho-Corasick pass over its bytes (mapped to
Latin-1 text), at each place the longest is tried first, a token that can't follow its neighbour gives way to the next shorter one,
and a place from which nothing fits is never tried again. Whether a pair fits is memoised. The time is linear in the piece.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainforge.runtime import spread

TOKENIZERS = "/opt/tokenizers"
#: How byte-level BPE vocabularies of this family part a text into pieces (fixed by the vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's memos; when full, a memo starts anew, which costs time and changes no result.
MEMO = 1_000_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [(int(i), base64.b64decode(t)) for t, i in map(bytes.split, f)]
    pairs.sort()
    return [t for _, t in pairs]


class Encoder(dict):
    """Piece -> ids, filled as pieces are met."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        super().__init__()
        self.tokens = [t.decode("latin-1") for t in tokens]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.length = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.halves = [self._halves(i) for i in range(len(self.tokens))]
        self.merged = {h: i for i, h in enumerate(self.halves) if h}
        self.fits: dict[int, bool] = {}

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge made token i: what merging its bytes by lower ids leaves."""
        t = self.tokens[i]
        if len(t) < 2:
            return None
        parts = list(t)
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = self.ids.get(parts[k] + parts[k + 1], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def _pair(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is a, b: no merge across their border comes before the merges inside them.

        Walks back through the merges that made both, latest first, and asks at each state whether the border's two tokens merge
        earlier than the merge just undone.
        """
        undone = 1 << 40
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < undone:
                return False
            ha, hb = self.halves[a], self.halves[b]
            if ha is None and hb is None:
                return True
            # of equal merges the left one is made first, so the right one is undone first and a border merge may tie with it
            if hb is None or (ha is not None and a > b):
                undone, a = a, ha[1]
            else:
                undone, b = b + 1, hb[0]

    def encode(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece, given as Latin-1 text of its bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        n, length, fits = len(piece), self.length, self.fits
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, i in self.automaton.iter(piece):
            starts[end + 1 - length[i]].append(i)  # a later end is a longer token
        dead = bytearray(n + 1)
        out: list[int] = []
        turn: list[int] = []
        at, k = 0, len(starts[0]) - 1
        while at < n:
            here, last = starts[at], out[-1] if out else -1
            while k >= 0:
                i = here[k]
                if not dead[at + length[i]]:
                    if last < 0:
                        break
                    pair = last << 20 | i
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= MEMO:
                            fits.clear()
                        ok = fits[pair] = self._pair(last, i)
                    if ok:
                        break
                k -= 1
            if k >= 0:
                out.append(i)
                turn.append(k)
                at += length[i]
                k = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                at -= length[out.pop()]
                k = turn.pop() - 1
        return tuple(out)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece.encode("utf-8", "replace").decode("latin-1"))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


_made: dict[int, tuple] = {}


def _ready(shared) -> tuple:
    """The worker's encoder and piece pattern, made once per worker process."""
    if shared.id not in _made:
        import regex

        _made.clear()
        _made[shared.id] = Encoder(shared.value), regex.compile(PIECES)
    return _made[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id(), broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"id": self.id, "broadcast": self.broadcast}


def encode_texts(df: DataFrame, doc_id: Column, text: Column, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", counts_only: bool = False, carry: Column | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, ids: the ids of each whole text without special tokens; with counts_only doc_id, carry, n_tokens.

    carry: a string that goes along with the counts; keep_text: the text does, too.

    An empty and a null text have an empty list (0 tokens). The strings of special tokens in a text are ordinary text. A null or
    repeated doc_id is passed on. A narrow map: no shuffle. The vocabulary (under 1 MB, read on the driver) is broadcast.
    """
    spark = df.sparkSession
    shared = _Shared(spark.sparkContext.broadcast(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = _ready(shared)
        find, get, flat_of = pieces.findall, encoder.__getitem__, chain.from_iterable
        for batch in batches:
            offsets, flat = np.zeros(batch.num_rows + 1, np.int32), array("i")
            for r, t in enumerate(batch.column(1)):
                t = t.as_py()
                if t:
                    flat.extend(flat_of(map(get, find(t))))
                offsets[r + 1] = len(flat)
            if counts_only:
                kept = [batch.column(1)] if keep_text else []
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(offsets)), *kept], names=["doc_id", "carry", "n_tokens", *["text"] * keep_text])
                continue
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "ids"])

    slim = [doc_id.cast("long").alias("doc_id"), text.alias("text")]
    if counts_only:
        return spread(df.select(*slim, (F.lit(None) if carry is None else carry).cast("string").alias("carry"))).mapInArrow(run, "doc_id long, carry string, n_tokens int" + ", text string" * keep_text)
    return spread(df.select(*slim)).mapInArrow(run, "doc_id long, ids array<int>")
