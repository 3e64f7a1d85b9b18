"""Vectorised hashing of byte and word sequences for the corpus operators.

All hashes are polynomials modulo the prime 2**61 - 1, computed from one prefix
sum per block, so the hash of any slice costs O(1).  Two different sequences of
n symbols agree for at most n of the 2**61 bases, whatever they are; modulo a
power of two there would be strings that agree for every base.  FIRST and SECOND
have bases of their own, so a sequence that is known by both is mistaken with a
chance below (n / 2**61)**2.  Nothing depends on the process or machine, so
every executor derives the same values and a lost task can be run again.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30, _LOW32, _LOW29 = _U(PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1), _U((1 << 32) - 1), _U((1 << 29) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser (splitmix64): spreads every input bit over the whole word."""
    x = np.array(x, dtype=_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues modulo PRIME of any 64-bit numbers."""
    out = x >> _U(61)
    out += x & _P
    return np.minimum(out, out - _P)  # below PRIME the difference wraps round and is greater


def _times(a: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """a (below 2**62) times high * 2**31 + low (below PRIME), congruent modulo PRIME and below 2**64."""
    a1, a0 = a >> _U(31), a & _LOW31
    middle = a1 * low
    middle += a0 * high
    out = a1 * high
    out += out
    out += middle >> _U(30)
    middle &= _LOW30
    middle <<= _U(31)
    out += middle
    out += a0 * low
    return out


#: Symbols at a time, so that what is in work stays in the processor's cache.
CHUNK = 1 << 14


class Poly:
    """Polynomial hash of slices; one instance is one function."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = np.sort(rng.choice((1 << 30) - 1, 256, replace=False).astype(_U)) + _U(1)
        rng.shuffle(self.table)
        self.base = int(rng.integers(1 << 32, PRIME, dtype=_U))
        self.salt = _U(rng.integers(0, _MASK, dtype=_U, endpoint=True))
        self._clear()

    def _clear(self) -> None:
        #: Powers of the base and of its inverse, each as its high 30 and low 31 bits.
        self._parts = {name: (np.zeros(1, np.uint32), np.ones(1, np.uint32)) for name in ("power", "inverse")}

    def __getstate__(self):
        return {"table": self.table, "base": self.base, "salt": self.salt}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def _powers(self, n: int) -> None:
        for name, b in (("power", self.base), ("inverse", pow(self.base, -1, PRIME))):
            high, low = self._parts[name]
            while len(low) < n:
                step = pow(b, len(low), PRIME)
                more = reduced(_times((high.astype(_U) << _U(31)) | low, _U(step >> 31), _U(step) & _LOW31))
                high, low = np.concatenate([high, (more >> _U(31)).astype(np.uint32)]), np.concatenate([low, (more & _LOW31).astype(np.uint32)])
            self._parts[name] = high, low

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums over bytes (uint8) or over word hashes (uint64)."""
        n = len(symbols)
        self._powers(n + 1)
        out = np.zeros(n + 1, _U)
        before = _U(0)
        for i in range(0, n, CHUNK):
            part = symbols[i : i + CHUNK]
            high, low = (x[i : i + len(part)].astype(_U) for x in self._parts["power"])
            if symbols.dtype == np.uint8:
                a = self.table[part]  # below 2**31, which saves half of the product
                high *= a
                low *= a
                low += high >> _U(30)
                high &= _LOW30
                high <<= _U(31)
                low += high
            else:
                low = _times(reduced(mix(part ^ self.salt)), high, low)
            low = (low & _P) + (low >> _U(61))
            few, many = np.cumsum(low & _LOW32), np.cumsum(low >> _U(32))
            few += many >> _U(29)
            many &= _LOW29
            many <<= _U(32)
            few += many
            few += before
            few = reduced(few)
            out[i + 1 : i + 1 + len(part)] = few
            before = few[-1]
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of symbols[start:end], elementwise; the length takes part."""
        out = np.empty(len(start), _U)
        up, down = self._parts["inverse"]
        for i in range(0, len(start), CHUNK):
            s, e = start[i : i + CHUNK], end[i : i + CHUNK]
            high, low = up.take(s).astype(_U), down.take(s).astype(_U)
            h = prefix.take(e)
            h += _P
            h -= prefix.take(s)
            h = reduced(_times(h, high, low))
            h += (e - s).view(_U) * self.salt
            out[i : i + CHUNK] = mix(h)
        return out


FIRST, SECOND = Poly(20240229), Poly(19770525)


def equal_slices(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a : a + size] equals buf[b : b + size], elementwise and byte by byte."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))
    same = np.ones(len(size), bool)
    rest = np.flatnonzero(size > 0)
    for at in range(0, 64, 8):
        if not len(rest):
            return same
        left = np.minimum(size[rest] - at, 8).astype(_U)
        shift = (_U(8) - left) * _U(8)
        same[rest] &= ((words[a[rest] + at] ^ words[b[rest] + at]) << shift) == 0
        rest = rest[(size[rest] > at + 8) & same[rest]]
    for i in rest.tolist():
        same[i] = np.array_equal(buf[a[i] + 64 : a[i] + size[i]], buf[b[i] + 64 : b[i] + size[i]])
    return same


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts.

    ``ends`` are the texts' end offsets.  Returns word starts, word ends and
    the text each word belongs to; a word never crosses a text's end.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = ends[(ends > 0) & (ends < n)]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(ends, start, side="right")


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, by: Poly | None = None) -> np.ndarray:
    by = by or FIRST
    if lower:
        buf = _LOWER[buf]
    return by.slices(by.prefix(buf), start, end)


#: Low bits of a hash that give way to its position.
PLACE_BITS = 24


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each window of w values.

    Longer inputs are read in slices that overlap by w - 1, as a position has PLACE_BITS bits.
    """
    n, most = len(h) - w + 1, 1 << PLACE_BITS
    if n <= 0:
        return np.zeros(0, np.int64)
    if w > most:
        raise ValueError(f"a window of {w} values has no room in {PLACE_BITS} bits")
    if len(h) > most:
        step = most - w + 1
        return np.concatenate([sliding_argmin(h[i : i + most], w) + i for i in range(0, n, step)])
    low = _U(most - 1)
    keyed = (h & ~low) | np.arange(len(h), dtype=_U)
    pad = -len(h) % w
    blocks = np.concatenate([keyed, np.full(pad, _MASK, _U)]).reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(left[:n], right[w - 1 : w - 1 + n]) & low).astype(np.int64)


def anchors(symbols: np.ndarray, ends: np.ndarray, length: int, k: int, other: np.ndarray | None = None):
    """Cover sample of all windows of ``length`` symbols in concatenated texts.

    The leftmost k-gram of least hash in a window is its anchor, so equal
    windows have their anchor at the same offset wherever they stand.  ``other`` has the same
    symbols under the second function, where they are hashes themselves.  Returns
    for each run of windows with one anchor: text, first window (offset in
    the block), number of windows, place of the anchor in the first window, key
    of the anchor, and the keys of the whole run by both functions.
    """
    n = len(symbols)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    z = np.zeros(0, np.int64)
    none = (z, z, z, z, z.astype(_U), z.astype(_U), z.astype(_U))
    if n < length:
        return none
    p1, p2 = FIRST.prefix(symbols), SECOND.prefix(symbols if other is None else other)
    i = np.arange(n - k + 1)
    grams = FIRST.slices(p1, i, i + k)
    chosen = sliding_argmin(mix(grams), length - k + 1)
    at = np.arange(len(chosen))
    text = np.searchsorted(ends, at, side="right")
    ok = at + length <= ends[text]
    at, text, chosen = at[ok], text[ok], chosen[ok]
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    f = np.flatnonzero(new)
    count = np.diff(np.append(f, len(at)))
    a, t, c = at[f], text[f], chosen[f]
    run = SECOND.slices(p2, a, a + count - 1 + length) ^ mix((c - a).astype(_U) * _U(1000003) + count.astype(_U))
    return t, a, count, c - a, grams[c], run, FIRST.slices(p1, a, a + count - 1 + length)
