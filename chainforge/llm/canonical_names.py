"""Hand-typed gene names mapped to the entries of a canonical list.

A name is letters (its locus) and numbers (the gene's and, mostly, the allele's). Every entry is kept as one normalised text, such as
ighv.1.2.1, also without its allele, and with the short forms of its locus. A symmetric-delete dictionary finds them: each text is stored
under all that is left of it after up to two deletions, and a value looks up the same deletions of its own texts. What is found is verified by a
weighted Damerau-Levenshtein distance, in which an edit of a digit costs more than the bound, as numbers name another gene; deletions are therefore
taken at letters only. The same dictionary holds the loci alone, those of other lists too: a value means the locus that is nearest to it, and no
entry if that locus is another list's or has no such numbers.

A typed value is cut into words and numbers. What is in brackets, percentages, words behind the numbers and words before the locus mean nothing;
which of the words are the locus is for the dictionary to say. Letters that look like digits are read both ways.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainforge.runtime import spread

#: The list is broadcast; a longer one is refused.
MAX_ENTRIES = 50_000
#: Letters typed for one another, on sight or on the keyboard, and letters that look like digits.
_ALIKE = {frozenset(p) for p in ("il", "vu", "vb", "jh")}
_DIGITS = {"o": "0", "i": "1", "l": "1"}
BOUND = 2.0
#: Cost of an edit of a digit, of reading a letter as the digit that it looks like, of a word before the locus, and of a misspelt locus of another list.
HEAVY, LOOKS, UNUSED, FOREIGN = 10.0, 0.25, 0.4, 0.3
_OPEN = re.compile(r"[(\[]")
_PERCENT = re.compile(r"(?<!\d)\d+(?:\.\d+)?\s*%")
_RUN = re.compile(r"[^\W_]+")
#: Within a run: digits with letters that look like digits, unless more letters follow them; else digits; else letters.
_PIECE = re.compile(r"^[oil]+\d[\doil]*(?![^\W\d_])|\d+(?:[oil][\doil]*(?![^\W\d_]))?|[^\W\d_]+")


def _without_notes(s: str) -> str:
    """s without what is in brackets and without percentages, in linear time also for brackets that are never closed."""
    out, begin, at, closers = [], 0, 0, {"(": ")", "[": "]"}
    while m := _OPEN.search(s, at):
        closer = closers.get(m[0])
        end = s.find(closer, m.end()) if closer else -1
        at = m.end()
        if end < 0:
            closers[m[0]] = None
            continue
        out.append(s[begin : m.start()])
        begin = at = end + 1
    return " ".join(_PERCENT.sub(" ", x) for x in (*out, s[begin:]))


def _number(s: str) -> str:
    return "".join(_DIGITS.get(ch, ch) for ch in s).lstrip("0") or "0"


def _is_number(piece: str) -> bool:
    return any(ch.isdigit() for ch in piece)


def pieces(value: str) -> list[tuple[str, bool]]:
    """(word or number, whether it follows the one before without a gap) of a value in order, in lower case, without what is in brackets and percentages."""
    s = unicodedata.normalize("NFKC", value).casefold()
    s = "".join(ch for ch in s if unicodedata.category(ch) != "Cf")
    return [(m[0], m.start() > 0) for run in _RUN.findall(_without_notes(s)) for m in _PIECE.finditer(run)]


def _split_word(word: str) -> list[tuple[float, list[str]]]:
    """(cost, parts): a word as it is, and with up to three letters that look like digits cut off at its end or before a last s."""
    out = [(0.0, [word])]
    for body, tail in ((word, []), (word[:-1], ["s"])):
        if tail and not word.endswith("s"):
            continue
        for n in range(1, min(len(body), 3) + 1):
            if body[-n] not in _DIGITS:
                break
            out.append((LOOKS * n, [body[:-n]] * (n < len(body)) + ["".join(_DIGITS[ch] for ch in body[-n:])] + tail))
    return out


def _read(cost: float, words: list[str], inner: list[str]) -> tuple[float, list[str], list[str], list[str]]:
    between = [p for p in inner if not _is_number(p)]
    missed = sum(len(p) for p in between if p != "s" and not p.strip("oils"))  # letters that may be digits
    return cost + 1.5 * LOOKS * missed, words, [_number(p) for p in inner if _is_number(p)], between


def readings(value: str) -> Iterator[tuple[float, list[str], list[str], list[str]]]:
    """What a value may say: (cost, words before the first number, numbers, words between numbers), the plainest first.

    Words behind the last number mean nothing. In all readings but the first, letters of words around the numbers are digits. A word
    between numbers that may be digits costs more than reading it as such.
    """
    found = pieces(value)
    at = [k for k, (p, _) in enumerate(found) if _is_number(p)]
    first, stop = (at[0], at[-1] + 1) if at else (len(found), len(found))
    words, inner = [p for p, _ in found[:first]], found[first:stop]
    yield _read(0.0, words, [p for p, _ in inner])
    near = found[max(0, first - 4) : stop + 1]  # with one word behind the last number
    if len(near) > 10 or not any(p[-1] in "oils" for p, _ in near):
        return
    before = [p for p, _ in found[: max(0, first - 4)]]
    ways = product(*([(0.0, [p])] if _is_number(p) else _split_word(p) for p, _ in near))
    for cost, parts in sorted(((sum(c for c, _ in way), [x for _, x in way]) for way in ways), key=lambda w: w[0]):
        if not cost:
            continue
        flat: list[str] = []
        for part, (_, joined) in zip(parts, near):
            if joined and flat and _is_number(flat[-1]) and _is_number(part[0]):
                flat[-1] += part[0]
                part = part[1:]
            flat += part
        at = [k for k, p in enumerate(flat) if _is_number(p)]
        yield _read(cost, before + flat[: at[0]], flat[at[0] : at[-1] + 1])


@lru_cache(1 << 17)
def distance(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein distance: 1 an edit or a swap of neighbours, 0.75 for letters that are alike, HEAVY for what isn't a letter."""

    def weight(*chars: str) -> float:
        return 1.0 if all(ch.isalpha() for ch in chars) else HEAVY

    rows = [[0.0]]
    for y in b:
        rows[0].append(rows[0][-1] + weight(y))
    for i, x in enumerate(a, 1):
        row = [rows[i - 1][0] + weight(x)]
        for j, y in enumerate(b, 1):
            sub = 0.0 if x == y else 0.75 if frozenset((x, y)) in _ALIKE else weight(x, y)
            best = min(rows[i - 1][j] + weight(x), row[j - 1] + weight(y), rows[i - 1][j - 1] + sub)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 2] + weight(x, y))
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def near_enough(d: float, locus: str) -> bool:
    """Within the bound, and enough of the locus is there: all of one of two letters, but for a letter like another."""
    return d <= min(BOUND, max(len(locus) - 2, 0.75))


@lru_cache(1 << 17)
def deletions(s: str, most: int = 2) -> frozenset[str]:
    """What is left of s after up to ``most`` deletions of letters."""
    out = {s}
    if most:
        for i in range(len(s)):
            if s[i].isalpha():
                out |= deletions(s[:i] + s[i + 1 :], most - 1)
    return frozenset(out)


def _named(name: str) -> tuple[str, list[str]] | None:
    """(locus, numbers) of a canonical name."""
    _, words, numbers, _ = next(readings(name or ""))
    return ("".join(words), numbers) if words and numbers else None


def _forms(locus: str) -> set[str]:
    """How a locus is written: in full, without the two letters of its receptor, and those that are left the other way round."""
    return {locus, locus[2:], locus[:1:-1]} if len(locus) == 4 else {locus}


class NameIndex:
    """Symmetric-delete dictionary of (gene_id, gene_name, uses) with the loci of other lists; gene names are canonical, such as IGHV1-2*03."""

    def __init__(self, entries: list[tuple[int, str, int]], others: tuple[str, ...] = ()):
        self.names: dict[str, set[tuple[str, int]]] = defaultdict(set)
        self.loci: dict[str, set[tuple[str, bool]]] = defaultdict(set)
        self.uses = {g: uses for g, _, uses in entries}
        read = [(g, *got) for g, name, _ in entries if (got := _named(name))]
        own = {form for _, locus, _ in read for form in _forms(locus)}
        foreign = {form for locus in others for form in _forms(locus.casefold())} - own
        for forms, mine in ((own, True), (foreign, False)):
            for form in forms:
                for rest in deletions(form):
                    self.loci[rest].add((form, mine))
        self.longest = max((len(form) for form in own | foreign), default=0) + int(BOUND)
        self.numbers = {len(numbers) for _, _, numbers in read}
        self.numbers |= {n - 1 for n in self.numbers}
        for gene_id, locus, numbers in read:
            for form in {*_forms(locus), ""}:
                for text in (".".join((form, *numbers)), ".".join((form, *numbers[:-1]))):
                    for rest in deletions(text):
                        self.names[rest].add((text, gene_id))

    @lru_cache(1 << 17)
    def nearest(self, word: str) -> tuple[float, bool] | None:
        """(distance, whether it is one of the list) of the locus that is nearest to a word; of equally near ones one of the list."""
        if len(word) > self.longest:
            return None
        found = {x for rest in deletions(word) for x in self.loci.get(rest, ())}
        near = [(d, mine) for form, mine in found if near_enough(d := distance(word, form), form)]
        return min(near, key=lambda x: (x[0], not x[1]), default=None)

    def meant(self, value: str) -> tuple[float, float, str, list[str]] | None:
        """(cost, distance of the locus, locus as typed, numbers) of the reading with the nearest locus; None if that isn't one of the list."""
        best, mine = None, False
        for cost, words, numbers, between in readings(value):
            if len(numbers) not in self.numbers or any(self.nearest(w) for w in between):
                continue
            if not words and (best is None or cost + BOUND < best[0]):
                best, mine = (cost + BOUND, 0.0, "", numbers), True
            for k in range(max(0, len(words) - 4), len(words)):
                word = "".join(words[k:])
                got = self.nearest(word)
                total = cost + UNUSED * k + got[0] + FOREIGN * (got[0] > 0 and not got[1]) if got else HEAVY
                if got and (best is None or total < best[0]):
                    best, mine = (total, got[0], word, numbers), got[1]
            if best and not best[0]:
                break
        return best if mine else None

    def candidates(self, value: str) -> list[tuple[float, int, int]]:
        """(distance, -uses, gene_id) of all entries with the value's numbers and allele within the bound, best first."""
        got = self.meant(value)
        if got is None:
            return []
        _, _, word, numbers = got
        text = ".".join((word, *numbers))
        ranked: dict[int, float] = {}
        for form, gene_id in {x for rest in deletions(text) for x in self.names.get(rest, ())}:
            if (bool(word) or form[0] == ".") and near_enough(e := distance(text, form), form.partition(".")[0] or "    "):
                ranked[gene_id] = min(e, ranked.get(gene_id, HEAVY))
        return sorted((e, -self.uses[g], g) for g, e in ranked.items())

    def find(self, value: str) -> tuple[int, float | None, str, list[int]]:
        """(gene_id or 0, distance, outcome, suggestions): outcome is matched, ambiguous (several entries are equally near) or unmatched.

        Only entries of the nearest locus count as meant: the same numbers of a locus farther off name another gene.
        """
        got, found = self.meant(value), self.candidates(value)
        best = [x for x in found if x[0] <= got[1] + 1e-9] if got else []
        out = (best[0][2], best[0][0], "matched") if len(best) == 1 else (0, best[0][0], "ambiguous") if best else (0, None, "unmatched")
        return (*out, [g for _, _, g in found[:3]])


def map_names(df: DataFrame, row_id: Column, fields: dict[str, tuple[Column, DataFrame]], others: dict[str, DataFrame] | None = None) -> DataFrame:
    """row_id, field, value, gene_id, distance, outcome, suggestions: one row per value that is neither blank nor an exact entry.

    fields: name -> (values, entries), entries with gene_id and gene_name. others: name -> entries of other lists, whose loci a value of
    the field may name instead. gene_id is 0 where no entry is named, be it that the
    value is no gene name, has other numbers or another allele, or names another locus, and where several entries are equally near
    (a value without a locus, or without an allele for a gene of several). suggestions lists up to three ids by distance and then by
    the number of rows that use the entry exactly. Null and blank values and exact names give no row. Repeated rows give rows each;
    a null row_id is passed on. An empty list leaves all unmatched. One narrow pass with the dictionary broadcast, after one count of
    the exact uses.
    """
    spark = df.sparkSession
    lists, foreign = {}, {}
    for name, (values, entries) in fields.items():
        short = entries.select("gene_id", "gene_name").where("gene_name IS NOT NULL").limit(MAX_ENTRIES + 1)
        rows = short.collect()
        if len(rows) > MAX_ENTRIES:
            raise ValueError(f"{name}: the canonical list has more than {MAX_ENTRIES} entries")
        uses = df.select(values.alias("gene_name")).join(F.broadcast(short.select("gene_name").distinct()), "gene_name").groupBy("gene_name").count()
        n = {r[0]: r[1] for r in uses.collect()}  # one row per entry at most
        lists[name] = [(int(r[0]), r[1], n.get(r[1], 0)) for r in rows]
        loci = (others or {}).get(name)
        foreign[name] = () if loci is None else tuple(r[0] for r in loci.select(F.regexp_extract("gene_name", "^[A-Za-z]+", 0)).distinct().limit(MAX_ENTRIES).collect())
    shared = spark.sparkContext.broadcast((lists, foreign))
    schema = pa.schema([("row_id", pa.int64()), ("field", pa.string()), ("value", pa.string()), ("gene_id", pa.int64()), ("distance", pa.float64()), ("outcome", pa.string()), ("suggestions", pa.list_(pa.int64()))])
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, loci = shared.value
        made = {n: (NameIndex(listed[n], loci[n]), {e[1] for e in listed[n]}, {}) for n in names}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for k, field in enumerate(names):
                index, exact, memo = made[field]
                if len(memo) > 500_000:
                    memo.clear()
                for i, v in zip(ids, batch.column(k + 1).to_pylist()):
                    if v is None or v in exact or not v.strip():
                        continue
                    got = memo.get(v)
                    if got is None:
                        got = memo[v] = index.find(v)
                    out.append((i, field, v, *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    slim = df.select(row_id.cast("long").alias("row_id"), *(v.alias(f"v{k}") for k, (v, _) in enumerate(fields.values())))
    return spread(slim).mapInArrow(run, "row_id long, field string, value string, gene_id long, distance double, outcome string, suggestions array<long>")
