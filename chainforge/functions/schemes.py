"""Conversion of numberings between IMGT and the Kabat, Martin and AHo schemes.

A scheme of a chain is a layout: framework stretches whose numbers run beside IMGT's, and loops whose letters are placed by their count. So
a numbering is converted letter by letter in the frameworks and loop by loop between them, and back the same way. Martin's
framework insertions follow Chothia (82A-82C).
"""

from __future__ import annotations

from functools import lru_cache

from chainforge.functions.positions import chain_group, imgt_cdr_codes

#: Published correspondences. f: IMGT first, last, scheme first. x: single IMGT number and code.
#: l: IMGT first, last, scheme first, last and the number after which it inserts (0: from both ends).
_LAYOUTS = {
    ("kabat", "H"): "f 1 9 1;f 11 26 10;l 27 40 26 35 35;f 41 55 36;l 56 65 51 57 52;f 66 72 58;f 74 91 65;x 92 82A;x 93 82B;x 94 82C;f 95 106 83;l 107 117 95 102 100;f 118 128 103",
    ("martin", "H"): "f 1 9 1;f 11 26 10;l 27 40 26 35 31;f 41 55 36;l 56 65 51 57 52;f 66 72 58;f 74 91 65;x 92 82A;x 93 82B;x 94 82C;f 95 106 83;l 107 117 95 102 100;f 118 128 103",
    ("kabat", "L"): "f 1 26 1;l 27 40 27 34 27;f 41 55 35;l 56 65 50 52 52;f 66 72 53;f 74 80 60;f 83 104 67;l 105 117 89 97 95;f 118 127 98",
    ("martin", "L"): "f 1 26 1;l 27 40 27 34 30;f 41 55 35;l 56 65 50 52 52;f 66 72 53;f 74 80 60;f 83 104 67;l 105 117 89 97 95;f 118 127 98",
    ("aho", "H"): "f 1 7 1;x 8 9;x 9 10;f 11 26 11;l 27 38 27 40 0;f 39 55 41;l 56 65 58 67 0;f 66 104 68;l 105 117 107 138 0;f 118 128 139",
    ("aho", "L"): "f 1 26 1;l 27 38 27 40 0;f 39 55 41;l 56 65 58 67 0;f 66 104 68;l 105 117 107 138 0;f 118 128 139",
}


def _letters(n: int) -> list[str]:
    return [chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26) for i in range(n)]


@lru_cache(None)
def _layout(scheme: str, group: str) -> tuple[dict[str, str], tuple[tuple[int, ...], ...]]:
    """({IMGT code: code} of the frameworks, loops)."""
    if (scheme, group) not in _LAYOUTS:
        raise ValueError(f"unknown scheme {scheme!r}")
    fixed, loops = {}, []
    for part in _LAYOUTS[scheme, group].split(";"):
        kind, *v = part.split()
        if kind == "f":
            first, last, to = map(int, v)
            fixed |= {str(i): str(to + i - first) for i in range(first, last + 1)}
        elif kind == "x":
            fixed[v[0]] = v[1]
        else:
            loops.append(tuple(map(int, v)))
    return fixed, tuple(loops)


def loop_codes(n: int, first: int, last: int, insert: int) -> list[str]:
    """The codes of a loop of n letters."""
    if not insert:
        size = last - first + 1
        if n > size:
            half = (size + 1) // 2
            return [str(first + i) for i in range(half)] + [f"{first + half - 1}{x}" for x in _letters(n - size)] + [str(i) for i in range(first + half, last + 1)]
        return [str(first + i) for i in range((n + 1) // 2)] + [str(last - n // 2 + 1 + i) for i in range(n // 2)]
    right = [str(i) for i in range(insert + 1, last + 1)]
    if n <= len(right):
        return right[len(right) - n :]
    left = [str(i) for i in range(first, insert + 1)]
    take = n - len(right)
    return left[:take] + [f"{insert}{x}" for x in _letters(max(0, take - len(left)))] + right


def _number(code: str) -> int:
    return int(code.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def from_imgt(numbering: list[str], chain: str, scheme: str) -> list[str]:
    """An IMGT numbering in another scheme. A framework letter that the scheme has no number for follows the one before as an insertion."""
    if scheme == "imgt":
        return list(numbering)
    fixed, loops = _layout(scheme, chain_group(chain))
    out = list(numbering)
    for first, last, to, end, insert in loops:
        at = [i for i, c in enumerate(numbering) if c != "-" and first <= _number(c) <= last]
        for i, code in zip(at, loop_codes(len(at), to, end, insert)):
            out[i] = code
    before, count = "", 0
    for i, c in enumerate(numbering):
        if c == "-":
            continue
        if any(f <= _number(c) <= t for f, t, *_ in loops):
            before, count = out[i], 0
            continue
        if c in fixed:
            out[i] = before = fixed[c]
            count = 0
        else:
            count += 1
            base = before.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") or "0"
            out[i] = base + _letters(count + len(before) - len(base))[-1]
    return out


def to_imgt(numbering: list[str], chain: str, scheme: str) -> list[str]:
    """A numbering of another scheme as IMGT's. Insertions of frameworks that IMGT has no place for take the number before and a letter."""
    if scheme == "imgt":
        return list(numbering)
    fixed, loops = _layout(scheme, chain_group(chain))
    back = {v: k for k, v in fixed.items()}
    out = list(numbering)
    placed: set[int] = set()
    for first, last, to, end, _ in loops:
        at = [i for i, c in enumerate(numbering) if c != "-" and c not in back and to <= _number(c) <= end]
        cdr = {27: 1, 56: 2, 105: 3, 107: 3}[first]
        frame = {1: (27, 38), 2: (56, 65), 3: (105, 117)}[cdr]
        head = [str(i) for i in range(frame[0], first)]  # IMGT CDR positions that are framework there
        tail = [str(i) for i in range(frame[1] + 1, last + 1)]
        n = len(at) - len(tail)
        codes = list(imgt_cdr_codes(cdr, max(0, n) + len(head)))[len(head) :] + tail
        for i, code in zip(at, codes if n >= 0 else codes[-n:]):
            out[i] = code
            placed.add(i)
    before, count = "0", 0
    for i, c in enumerate(numbering):
        if c == "-":
            continue
        if i in placed or c in back:
            out[i] = out[i] if i in placed else back[c]
            before, count = out[i], 0
        else:
            count += 1
            out[i] = before.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + _letters(count)[-1]
    return out
