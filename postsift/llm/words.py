"""Words of many texts at once, as 64-bit hashes computed by array operations.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text after lower-casing A-Z, so a row boundary or white
space of ASCII ends a word. Empty texts have no words.
"""

from __future__ import annotations

import numpy as np

from postsift.llm.common import mix, seeded

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_tables: dict[str, np.ndarray] = {}
_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64; grown by doubling and kept."""
    have = _powers[base]
    while len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables[name] = seeded(name, 256)[_LOWER]
    return _tables[name]


#: Bytes that end a word when punctuation does not matter: all of ASCII but letters and digits.
PLAIN_SPACE = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of the rows data[offsets[i]:offsets[i + 1]]."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, name: str = "word") -> np.ndarray:
    """A hash of the bytes of each span, equal for equal lower-cased bytes at any place."""
    with np.errstate(over="ignore"):
        terms = _table(name)[data] * powers(_BASE, len(data))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(terms, dtype=_U)))
        raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]
        return mix(raw + (ends - starts).astype(_U))


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in text order."""
    starts, ends, rows = spans(data, offsets, space)
    return hashes(data, starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the distinct `size`-word shingles per row, sorted by row and hash.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        whole = np.zeros(n, _U)
        for j in range(size):
            whole = mix(whole + _U(j + 1)) + words[j : j + n]
        at = np.flatnonzero(rows[:n] == rows[size - 1 : size - 1 + n]) if n else np.empty(0, np.int64)
        out, owner = [mix(whole[at] + _U(size))], [rows[at]]
        for length in range(1, size):  # short texts
            short = np.flatnonzero(counts == length)
            if len(short):
                value = np.zeros(len(short), _U)
                for j in range(length):
                    value = mix(value + _U(j + 1)) + words[first[short] + j]
                out.append(mix(value + _U(length)))
                owner.append(short)
    out, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(out)  # equal hashes of a row are one shingle, so their order does not matter
    order = order[np.argsort(owner[order].astype(np.uint16) if n_rows <= 1 << 16 else owner[order], kind="stable")]
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], owner[new]
