"""Sets of hashed word shingles, computed for many texts at once on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
WINDOW = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
for _b in range(65, 91):  # A-Z like a-z
    _BYTES[_b] = _BYTES[_b + 32]
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, WINDOW + 4096)
        for i, base in enumerate((_P, _P_INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers


def _window_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of raw; the hash is a polynomial in the bytes, from sums of prefixes."""
    word = _WORD[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * power[: len(raw)], dtype=np.uint64)])
    h = (prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64)
    return _mix(h), start


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of all words [^\\x20\\x09-\\x0D]+ of raw, A-Z taken as a-z, in windows cut at white space."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + WINDOW, len(raw))
        while end < len(raw):
            blank = np.flatnonzero(~_WORD[raw[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
                break
            end = min(end + WINDOW, len(raw))
        h, s = _window_hashes(raw[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; of all its words as one, if there are fewer than n; none
    without words. Two different shingles have the same hash with a chance of about 2**-64."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in [*texts, None]:
        raw = (t or "").encode()
        if size + len(raw) > WINDOW or len(out) + len(group) == len(texts):
            out += _group_sets(group, n)
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    return out[: len(texts)]


def _group_sets(group: list[bytes], n: int) -> list[np.ndarray]:
    if not group:
        return []
    joined = np.frombuffer(b" ".join(group), np.uint8)
    h, start = word_hashes(joined)
    begin = np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])])
    at = np.searchsorted(start, begin)
    whole = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        whole = (whole + h[k : k + len(whole)]) * np.uint64(_P)
    whole = _mix(whole)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = (one + x) * np.uint64(_P)
            out.append(_mix(np.array([one], np.uint64) ^ np.uint64(0xA5A5A5A5)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit numbers that name each set (sums of two mixes of its members); zeros for the empty set."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = _mix(s).sum(dtype=np.uint64), _mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return out.view(np.int64)
