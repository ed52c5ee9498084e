"""The language of documents and of their text cells, by string-kernel classification.

The kernel of two texts is the share of n-grams that both hold: the blended spectrum of all n-grams of 1 to 5 letters inside word
borders, counted by presence and normalised by the sizes of both sets. One-versus-rest kernel ridge regression is fitted in the
Nystroem subspace of landmark texts. A text's scores are k(x, landmarks) A = (X L') A; since X (L' A) is the same product, L' A is
multiplied once after fitting, and the sparse presence matrix of a batch is multiplied with it: the rows of L' A that X names are gathered
and summed text by text.

Labels in the corpus are noisy, so the fit is repeated with the labels of the pass before where the two disagree.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainforge.runtime import spread

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
#: How labels name the languages, in lower case; region, script and encoding suffixes are cut off before.
NAMES = {
    "de": "de deu ger german deutsch allemand alemán tedesco duits",
    "en": "en eng english englisch anglais inglés inglese engels",
    "es": "es spa esp spanish español espanol castellano spanisch espagnol",
    "fr": "fr fra fre french français francais französisch francés",
    "it": "it ita italian italiano italienisch italien",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais vlaams flemish",
    "pt": "pt por portuguese português portugues portugiesisch portugais",
    "ru": "ru rus russian русский russisch russe ruso",
}
_BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()}
FEATURES = 1 << 18
_CELL = re.compile(r"^﻿?#%% (\d+) (text|code \[[^\]\n]*\]|output|error|image)\r?$", re.M)
_NOISE = re.compile(r"!?\[[^\]]*\]\([^)]*\)|https?://\S+|`[^`]*`|\$\$.*?\$\$|\$[^$\n]*\$", re.S)
_WORD = re.compile(r"[^\W\d_]+")


def label_language(c: Column) -> Column:
    """The two-letter code that a label names in any notation, else null."""
    names = F.create_map(*(F.lit(x) for kv in _BY_NAME.items() for x in kv))
    return F.element_at(names, F.regexp_extract(F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))), r"^(?U)([^-_.@;,()\s]*)", 1))


def text_cells(text: str) -> list[tuple[int, str]]:
    """(number, text) of the text cells of a notebook; a text before the first marker belongs to no cell."""
    marks = list(_CELL.finditer(text))
    return [(int(m[1]), text[m.end() : n.start() if n else len(text)]) for m, n in zip(marks, [*marks[1:], None]) if m[2] == "text"]


class _Words(dict):
    """Word -> ids of its n-grams of 1 to 5 letters, borders included."""

    def __missing__(self, word: str) -> list[int]:
        w = f" {word} "
        ids = list({zlib.crc32(w[i : i + n].encode()) % FEATURES for n in range(1, 6) for i in range(len(w) - n + 1)})
        if len(self) >= 200_000:
            self.clear()
        self[word] = ids
        return ids


def presence(text: str, words: _Words) -> list[int]:
    """The ids of the n-grams that a text holds, each once. Markup, formulas, links and code spans are no language."""
    clean = unicodedata.normalize("NFC", _NOISE.sub(" ", text)).lower()
    clean = "".join(ch for ch in clean if ch.isprintable() or ch.isspace()) if not clean.isprintable() else clean
    found: set[int] = set()
    for w in set(_WORD.findall(clean)):
        found.update(words[w])
    return list(found)


def _unit_rows(cells: list[list[int]], index: dict[int, int]) -> Iterator[np.ndarray]:
    for at in range(0, len(cells), 256):
        x = np.zeros((min(256, len(cells) - at), len(index)), np.float32)
        for r, ids in enumerate(cells[at : at + 256]):
            x[r, [index[i] for i in ids]] = 1
        yield x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(cells: list[list[int]], labels: list[str], landmarks_each: int = 48, ridge: float = 1e-3, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, their weights by language): the matrix L' A. Cells are presence lists; a language without cells is never chosen."""
    index = {f: k for k, f in enumerate(sorted({i for ids in cells for i in ids}))}
    y = np.array([LANGUAGES.index(x) for x in labels], int)
    if not len(y) or not index:
        return np.empty(0, np.int64), np.empty((0, len(LANGUAGES)), np.float32)
    weights = np.zeros((len(index), len(LANGUAGES)), np.float32)
    given = y
    for _ in range(passes):
        marks = np.concatenate([np.flatnonzero(y == k)[:landmarks_each] for k in range(len(LANGUAGES))])
        land = np.concatenate(list(_unit_rows([cells[i] for i in marks], index)))
        k_nm = np.concatenate([x @ land.T for x in _unit_rows(cells, index)]).astype(np.float64)
        k_mm = k_nm[marks]
        target = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, 0.0)
        a = np.linalg.solve(k_nm.T @ k_nm + ridge * len(y) * (k_mm + 1e-6 * np.eye(len(marks))), k_nm.T @ target)
        a[:, ~np.isin(np.arange(len(LANGUAGES)), given)] = -1
        weights = (land.T @ a).astype(np.float32)
        y = (k_nm @ a).argmax(1)
    return np.array(sorted(index), np.int64), weights


def _cells_of(batch: pa.RecordBatch):
    for doc, text, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
        text = text.as_py()
        yield doc, label, text_cells(text) if text else []


def _training(docs: DataFrame, per_language: int, cells_each: int, seed: int) -> tuple[list[list[int]], list[str]]:
    """Presence lists and label languages of the sampled documents' first text cells; at most languages x per_language x cells_each.

    Sampled are rows, not ids: a first pass without texts gives the hash up to which a label's documents are taken, and of the rows up
    to it, which are more only if ids are repeated, the first per_language are kept.
    """
    named = docs.where("label IS NOT NULL AND d IS NOT NULL").withColumn("h", F.xxhash64(F.lit(seed), "d"))
    first = Window.partitionBy("label").orderBy("h")
    last = named.select("label", "h").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).groupBy("label").agg(F.max("h").alias("last")).collect()  # a row a language
    if not last:
        return [], []
    upto = F.create_map(*(F.lit(x) for r in last for x in (r["label"], r["last"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = [(label, presence(t, words)) for _, label, cells in _cells_of(batch) for _, t in cells[:cells_each]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["label", "ids"])

    near = named.where(F.col("h") <= F.element_at(upto, F.col("label"))).select("d", "t", "label", "h", F.xxhash64("t").alias("x"))
    chosen = near.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "x"))).where(F.col("n") <= per_language)
    got = chosen.select("d", "t", "label").mapInArrow(run, "label string, ids array<int>").where("size(ids) > 0").toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()), key=lambda p: (p[0], zlib.crc32(repr(sorted(p[1])).encode())))
    return [p[1] for p in pairs], [p[0] for p in pairs]


def languages(df: DataFrame, doc_id: Column, text: Column, label: Column, per_language: int = 150, cells_each: int = 6, seed: int = 7) -> DataFrame:
    """doc_id, cell_no, lang, confidence, label, main, n_text_cells.

    One row per document (cell_no 0) and, if its text cells are in several languages, one per text cell. lang of a document is the
    language of most of its text cells; of equally many the one with the greater sum of confidences. confidence is between 0 and 1:
    the softmax of a cell's scores, and for a document the mean of it over the cells in its language times their share. label is
    the code that the given label names, or null. A document without text cells (null, empty or code only) and a cell without
    letters have a null lang and confidence 0; main repeats the document's lang. A null or repeated doc_id is passed on.

    The classifier is fitted on at most per_language documents of each label language, the first by hash, and the first cells_each
    text cells of each; every document and cell is then classified by its whole text. If no label names a language, lang is null
    throughout.
    """
    docs = df.select(doc_id.cast("long").alias("d"), text.alias("t"), label_language(label).alias("label"))
    ids, weights = fit(*_training(docs, per_language, cells_each, seed))
    shared = df.sparkSession.sparkContext.broadcast((ids, weights))  # the n-grams of the sample: bounded by FEATURES x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights = shared.value
        dense = np.zeros((FEATURES + 1, len(LANGUAGES)), np.float32)
        dense[ids] = weights
        words = _Words()
        for batch in batches:
            docs_, owner, numbers, sets = [], [], [], []
            for doc, label, cells in _cells_of(batch):
                for number, t in cells:
                    owner.append(len(docs_))
                    numbers.append(number)
                    sets.append(np.array(presence(t, words) or [FEATURES], np.int32))
                docs_.append((doc, label, len(cells)))
            sizes = np.array([len(s) for s in sets], np.int64)
            empty = np.array([s[0] == FEATURES for s in sets], bool)
            best, sure = np.full(len(sets), -1), np.zeros(len(sets))
            if sets and len(ids):
                scores = np.empty((len(sets), len(LANGUAGES)), np.float32)
                for at in range(0, len(sets), 1024):
                    some = slice(at, at + 1024)
                    start = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    scores[some] = np.add.reduceat(dense[np.concatenate(sets[some])], start) / np.sqrt(sizes[some])[:, None]
                e = np.exp(8 * (scores - scores.max(1, keepdims=True)))
                p = e / e.sum(1, keepdims=True)
                best = np.where(~empty & (np.abs(scores).sum(1) > 0), p.argmax(1), -1)
                sure = np.where(best >= 0, p.max(1), 0.0)
            owner_ = np.array(owner, int)
            votes, trust = np.zeros((len(docs_), len(LANGUAGES))), np.zeros((len(docs_), len(LANGUAGES)))
            known = best >= 0
            np.add.at(votes, (owner_[known], best[known]), 1)
            np.add.at(trust, (owner_[known], best[known]), sure[known])
            out: list[tuple] = []
            main = np.full(len(docs_), -1)
            for r, (doc, label, n) in enumerate(docs_):
                if votes[r].any():
                    main[r] = k = max(range(len(LANGUAGES)), key=lambda k: (votes[r, k], trust[r, k], -k))
                    out.append((doc, 0, LANGUAGES[k], float(trust[r, k] / votes[r].sum()), label, LANGUAGES[k], n))
                else:
                    out.append((doc, 0, None, 0.0, label, None, n))
            several = (votes > 0).sum(1) > 1
            for r, number, k, s in zip(owner, numbers, best, sure):
                if several[r]:
                    doc, label, n = docs_[r]
                    out.append((doc, number, LANGUAGES[k] if k >= 0 else None, float(s), label, LANGUAGES[main[r]], n))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in out], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("cell_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("label", pa.string()), ("main", pa.string()), ("n_text_cells", pa.int64())])
    return spread(docs).mapInArrow(run, "doc_id long, cell_no long, lang string, confidence double, label string, main string, n_text_cells long")
