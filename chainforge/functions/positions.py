"""Position codes, regions, trimming, alignment to templates and multiple alignments (N4-N16) as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainforge.functions.alphabet import letters_of

SCHEMES = ("imgt", "kabat", "martin", "aho")
#: Bases whose insertions run backwards and come before them (111, 111A, 111B, 112B, 112A, 112).
REVERSED = {"imgt": (33, 61, 112), "kabat": (), "martin": (), "aho": ()}
#: The number with which each region begins, by numbering scheme, chain and scheme of the CDR definition.
#: fmwk1 begins at 1; the columns are cdr1 fmwk2 cdr2 fmwk3 cdr3 fmwk4.
_BOUNDS = """
imgt   H imgt    27  39  56  66 105 118
imgt   L imgt    27  39  56  66 105 118
imgt   H kabat   32  41  55  75 107 118
imgt   L kabat   24  41  56  70 105 118
imgt   H north   24  41  55  67 105 118
imgt   L north   24  41  55  70 105 118
imgt   H aho     25  39  56  76 107 117
imgt   L aho     25  39  56  76 107 117
kabat  H kabat   31  36  50  66  95 103
kabat  L kabat   24  35  50  57  89  98
kabat  H imgt    26  36  51  58  93 103
kabat  L imgt    27  33  50  53  89  98
kabat  H north   23  36  50  59  93 103
kabat  L north   24  35  49  57  89  98
martin H martin  26  33  52  57  95 103
martin L martin  26  33  50  53  91  97
aho    H imgt    27  41  58  68 107 139
aho    L imgt    27  41  58  68 107 139
"""
REGIONS = ("fmwk1", "cdr1", "fmwk2", "cdr2", "fmwk3", "cdr3", "fmwk4")
#: The last number of each scheme.
_LAST = {"imgt": 128, "aho": 149, "kabat H": 113, "kabat L": 107, "martin H": 113, "martin L": 107}
#: Chains numbered with the heavy positions: H, and of T-cell receptors B and D. The light ones are K, L, A and G.
HEAVY, LIGHT = ("H", "B", "D"), ("K", "L", "A", "G")


def chain_group(chain: str) -> str:
    if chain in HEAVY:
        return "H"
    if chain in LIGHT:
        return "L"
    raise ValueError(f"unknown chain {chain!r}")


@lru_cache(None)
def bounds(scheme: str, chain: str, cdr_scheme: str = "") -> tuple[int, ...]:
    """First numbers of the seven regions."""
    cdr_scheme = cdr_scheme or scheme
    table = {tuple(r[:3]): tuple(map(int, r[3:])) for r in (line.split() for line in _BOUNDS.split("\n") if line)}
    group = chain_group(chain)
    # Martin and Kabat give the frameworks and most CDR positions the same numbers
    twin = {"kabat": "martin", "martin": "kabat"}.get(scheme, scheme)
    for key in ((scheme, group, cdr_scheme), (twin, group, cdr_scheme)):
        if key in table:
            return (1, *table[key])
    raise ValueError(f"no {cdr_scheme!r} regions for {scheme!r} numbering")


@lru_cache(None)
def canonical_numbering(scheme: str, chain: str = "H") -> tuple[str, ...]:
    """The ordered position codes of a scheme; chain matters for kabat and martin."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    group = chain_group(chain)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    after = {  # insertions that follow a base, in ascending order
        "imgt": {32: 3, 60: 5, 67: 1, 68: 1, 69: 2, 83: 2, 111: 11} if group == "H" else {32: 2, 42: 1, 103: 1, 111: 4},
        "kabat": {35: 2, 52: 3, 82: 3, 100: 11} if group == "H" else {27: 6, 95: 6, 106: 1},
        "martin": {31: 2, 52: 3, 82: 3, 100: 11} if group == "H" else {30: 6, 52: 5, 95: 6, 106: 1},
        "aho": {},
    }[scheme]
    before = ({33: 3, 61: 5, 112: 12} if group == "H" else {33: 2, 112: 4}) if scheme == "imgt" else {}
    last = _LAST.get(scheme) or _LAST[f"{scheme} {group}"]
    if scheme == "imgt" and group == "L":
        last = 127
    out: list[str] = []
    for n in range(1, last + 1):
        out += [f"{n}{letters[i]}" for i in reversed(range(before.get(n, 0)))]
        out.append(str(n))
        out += [f"{n}{letters[i]}" for i in range(after.get(n, 0))]
    return tuple(out)


def once(value: Column, use) -> Column:
    """use(value) with the value computed once per row, however often ``use`` and its lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def code_number(code: Column) -> Column:
    """The number of a position code; null for the gap and for malformed codes."""
    return _bare(code).try_cast("int")


def _bare(code: Column) -> Column:
    """A code without its insertion letters."""
    return F.rtrim(code, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def sort_key(code: Column, scheme: str) -> Column:
    """An integer that orders position codes as the scheme does; null for malformed codes."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    letters = F.substring(code, F.length(_bare(code)) + 1, F.length(code))
    rank = F.when(F.length(letters) == 0, F.lit(0)).when(F.length(letters) == 1, F.ascii(letters) - 64).otherwise(26 * (F.ascii(letters) - 64) + F.ascii(F.substring(letters, 2, 1)) - 64)
    number = code_number(code)
    backwards = number.isin(*REVERSED[scheme]) if REVERSED[scheme] else F.lit(False)
    return number * 1000 + F.when(backwards, 999 - rank).otherwise(rank)


def sort_codes(codes: Column, scheme: str) -> Column:
    """Position codes in scheme order without gaps; a malformed code raises an error."""
    real = F.filter(codes, lambda c: c != "-")
    keyed = F.transform(real, lambda c: F.struct(sort_key(c, scheme).alias("k"), c.alias("c")))
    bad = F.exists(keyed, lambda s: s["k"].isNull())
    return F.when(bad, F.raise_error(F.lit("malformed position code"))).otherwise(F.transform(F.array_sort(keyed), lambda s: s["c"]))


def trim_alignment(seq: Column, numbering: Column) -> Column:
    """struct<seq, numbering, start, stop>: from the first numbered letter to the next unnumbered one.

    start and stop are 0-based and half open. No numbered letter: empty. A numbering of another length raises an error.
    """
    start = F.array_position(F.transform(numbering, lambda c: c != "-"), True)
    tail = F.slice(numbering, F.greatest(start, F.lit(1)).cast("int"), F.greatest(F.size(numbering), F.lit(0)))
    gap = F.array_position(tail, "-")
    n = F.when(start == 0, F.lit(0)).when(gap == 0, F.size(tail)).otherwise(gap - 1).cast("int")
    first = F.when(start == 0, F.lit(0)).otherwise(start - 1).cast("int")
    out = F.struct(F.substring(seq, first + 1, n).alias("seq"), F.slice(numbering, first + 1, n).alias("numbering"), first.alias("start"), (first + n).alias("stop"))
    return F.when(seq.isNull() | numbering.isNull(), F.lit(None)).when(F.length(seq) != F.size(numbering), F.raise_error(F.lit("sequence and numbering differ in length"))).otherwise(out)


def region_labels(numbering: Column, scheme: str, chain: str, cdr_scheme: str = "") -> Column:
    """The region of every code, ``-`` for the gap and for malformed codes."""
    starts = bounds(scheme, chain, cdr_scheme)

    def label(n: Column) -> Column:
        out = F.when(n.isNull(), "-").when(n < starts[1], REGIONS[0])
        for name, stop in zip(REGIONS[1:-1], starts[2:]):
            out = out.when(n < stop, name)
        return out.otherwise(REGIONS[-1])

    return F.transform(F.transform(numbering, code_number), label)


def label_of(code: str, scheme: str, chain: str, cdr_scheme: str = "") -> str:
    """The region of one code."""
    if code == "-":
        return "-"
    n = int("".join(ch for ch in code if ch.isdigit()))
    return REGIONS[sum(n >= s for s in bounds(scheme, chain, cdr_scheme)) - 1]


#: First number, number of positions without insertions, and the bases left and right of the middle of each IMGT CDR.
_IMGT_CDRS = {1: (27, 12, 32, 33), 2: (56, 10, 60, 61), 3: (105, 13, 111, 112)}


@lru_cache(None)
def insertion_letters(i: int) -> str:
    """The letters of the insertion of this number: A for 0, Z for 25, then AA, AB and so on."""
    return (insertion_letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def imgt_cdr_codes(cdr: int, length: int) -> tuple[str, ...]:
    """The codes of an IMGT CDR of so many letters, which their number alone decides.

    Letters are placed from both ends, the left one first; what is over goes around the middle, first before the right base.
    """
    if cdr not in _IMGT_CDRS or length < 0:
        raise ValueError("cdr is 1, 2 or 3 and the length not negative")
    first, n, left_base, right_base = _IMGT_CDRS[cdr]
    base = min(length, n)
    left, right = (base + 1) // 2, base // 2
    over = length - base
    to_right, to_left = (over + 1) // 2, over // 2

    out = [str(first + i) for i in range(left)] + [f"{left_base}{insertion_letters(i)}" for i in range(to_left)]
    return (*out, *(f"{right_base}{insertion_letters(i)}" for i in reversed(range(to_right))), *(str(first + n - right + i) for i in range(right)))


def _imgt_cdr_codes(n: Column, cdr: int) -> Column:
    """The same for a column of lengths."""
    first, positions, left_base, right_base = _IMGT_CDRS[cdr]
    base = F.least(n, F.lit(positions))
    over = n - base

    def half(x: Column) -> Column:
        return F.shiftright(x, 1)

    def letter(i: Column) -> Column:
        out, skip = None, 0
        for size in range(1, 7):
            text = F.concat(*(F.char((F.floor((i - skip) / 26**k) % 26 + 65).cast("int")) for k in reversed(range(size))))
            out = F.when(i < skip + 26**size, text) if out is None else out.when(i < skip + 26**size, text)
            skip += 26**size
        return out

    def codes(count: Column, make) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array().cast("array<string>"))

    return F.concat(
        codes(half(base + 1), lambda i: (i + first).cast("string")),
        codes(half(over), lambda i: F.concat(F.lit(str(left_base)), letter(i))),
        F.reverse(codes(half(over + 1), lambda i: F.concat(F.lit(str(right_base)), letter(i)))),
        codes(half(base), lambda i: (i + first + positions - half(base)).cast("string")),
    )


def number_imgt_cdr(seq: Column, cdr: int, longest: int = 60) -> Column:
    """array<string> of codes for an isolated CDR of any length; up to ``longest`` letters they are looked up, beyond it made from the length."""
    table = F.array(*(F.array(*(F.lit(c) for c in imgt_cdr_codes(cdr, n))) if n else F.array().cast("array<string>") for n in range(longest + 1)))
    return F.when(seq.isNull(), F.lit(None)).when(F.length(seq) > longest, _imgt_cdr_codes(F.length(seq), cdr)).otherwise(F.element_at(table, F.length(seq) + 1))


def align_cdr(seq: Column, width: int) -> Column:
    """An IMGT CDR as fixed-width text: the left half, gaps, the right half. Longer ones than the width have a null result."""
    n = F.length(seq)
    left = F.ceil(n / 2).cast("int")
    return F.when(n <= width, F.concat(F.substring(seq, F.lit(1), left), F.repeat(F.lit("-"), (F.lit(width) - n).cast("int")), F.substring(seq, left + 1, n)))


class Template:
    """A fixed list of position codes with regions, to which numbered sequences are aligned."""

    def __init__(self, codes: list[str] | tuple[str, ...], chain: str, scheme: str, cdr_scheme: str = ""):
        if not codes or len(set(codes)) != len(codes):
            raise ValueError("a template needs different codes")
        self.codes, self.chain, self.scheme, self.cdr_scheme = tuple(codes), chain, scheme, cdr_scheme or scheme
        self.labels = tuple(label_of(c, scheme, chain, self.cdr_scheme) for c in self.codes)

    @property
    def _array(self) -> Column:
        return F.array(*(F.lit(c) for c in self.codes))

    def region_size(self, region: str = "all") -> int:
        return len(self.kept(region))

    def kept(self, region: str) -> list[int]:
        """Indices of a region: ``all``, a name, or the first letters of several (cdr, fmwk)."""
        out = [i for i, x in enumerate(self.labels) if region == "all" or x.startswith(region)]
        if not out:
            raise ValueError(f"no region {region!r}")
        return out

    def align(self, seq: Column, numbering: Column) -> Column:
        """Fixed-width text: letters at template positions, gaps elsewhere; codes outside the template are dropped."""
        letters = F.map_from_entries(F.filter(F.arrays_zip(numbering.alias("n"), letters_of(seq).alias("s")), lambda e: e["n"] != "-"))
        aligned = once(letters, lambda m: F.array_join(F.transform(self._array, lambda c: F.coalesce(F.element_at(m, c), F.lit("-"))), ""))
        return F.when(seq.isNull() | numbering.isNull(), F.lit(None)).otherwise(aligned)

    def align_region(self, seq: Column, numbering: Column, region: str) -> Column:
        return self.slice(self.align(seq, numbering), region)

    def slice(self, aligned: Column, region: str) -> Column:
        """The columns of a region, runs of neighbouring ones taken at once."""
        runs: list[list[int]] = []
        for i in self.kept(region):
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        return F.concat(*(F.substring(aligned, r[0] + 1, len(r)) for r in runs))

    def unusual(self, numbering: Column) -> Column:
        """Codes outside the template, in order."""
        return F.filter(numbering, lambda c: (c != "-") & ~F.array_contains(self._array, c))

    def forward(self, numbering: Column) -> Column:
        """For each letter its template index, -1 where it has none."""
        return F.transform(numbering, lambda c: (F.array_position(self._array, c) - 1).cast("int"))

    def back(self, numbering: Column) -> Column:
        """For each template position the index of its letter, -1 where there is none."""
        return F.transform(self._array, lambda c: (F.array_position(numbering, c) - 1).cast("int"))


def observed_codes(df: DataFrame, numbering: Column, scheme: str) -> list[str]:
    """The union of the codes of a table in scheme order: at most the scheme's few hundred positions reach the driver."""
    codes = df.select(F.explode(numbering).alias("c")).where("c <> '-'").distinct().select("c", sort_key(F.col("c"), scheme).alias("k")).orderBy("k", "c").collect()
    if any(r["k"] is None for r in codes):
        raise ValueError("malformed position code")
    return [r["c"] for r in codes]


def build_msa(df: DataFrame, seq: str, numbering: str, chain: str, scheme: str, add_unobserved: bool = False) -> tuple[list[str], DataFrame]:
    """(position codes, df with column ``aligned``): every sequence gapped to the union of observed codes.

    add_unobserved: the scheme's canonical codes are taken in as well. Two narrow passes: a distinct of codes and a projection.
    """
    codes = observed_codes(df, F.col(numbering), scheme)
    if add_unobserved:
        both = df.sparkSession.createDataFrame([(c,) for c in {*codes, *canonical_numbering(scheme, chain)}], "c string")
        codes = [r[0] for r in both.orderBy(sort_key(F.col("c"), scheme)).collect()]
    return codes, df.withColumn("aligned", Template(codes, chain, scheme).align(F.col(seq), F.col(numbering)))


def imgt_cdr_text(seq: Column, numbering: Column, cdr: int) -> Column:
    """The letters of an IMGT CDR, whose codes follow each other; cheaper than extract_region, as no labels are made."""
    first, n, _, _ = _IMGT_CDRS[cdr]

    def cut(inside: Column) -> Column:
        return F.substring(seq, F.array_position(inside, True).cast("int"), F.size(F.filter(inside, lambda x: x)))

    return F.coalesce(once(F.transform(numbering, lambda c: F.coalesce(code_number(c).between(first, first + n - 1), F.lit(False))), cut), F.lit(""))


def extract_region(seq: Column, labels: Column, region: str) -> Column:
    """The letters whose label begins with ``region``."""
    pairs = F.arrays_zip(labels.alias("l"), letters_of(seq).alias("s"))
    return F.array_join(F.transform(F.filter(pairs, lambda e: F.startswith(e["l"], F.lit(region))), lambda e: e["s"]), "")
