"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes outside [\\x20\\x09-\\x0D], after A-Z are lower-cased; both are
plain byte operations, so UTF-8 needs no decoding. A word's hash is the value of the polynomial of its bytes in two prime fields: a
difference of prefix sums of (byte + 1) * base**position, brought back to position 0 by the inverse power. In a field two
words agree at no more bases than they have bytes, whatever their pattern (modulo 2**64 there are words that agree at every base).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240101))
#: Primes under 2**31, each with the base of its polynomials.
FIELDS = [(2147483647, 1_234_977_913), (2147483629, 987_654_329)]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text that are hashed at once; bounds the working arrays (a longer text is taken alone).
PIECE = 1 << 18


def _powers(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (or more) of the base, and of its inverse."""
    if prime not in _powers_of or len(_powers_of[prime][0]) < n:
        tables = []
        for x in (base, pow(base, -1, prime)):
            t = np.ones(1, np.uint64)
            while len(t) < max(n, PIECE + PIECE // 4):
                t = np.concatenate((t, t * _U(pow(x, len(t), prime)) % _U(prime)))
            tables.append(t)
        _powers_of[prime] = tuple(tables)
    return _powers_of[prime]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its end; starts ascend."""
    out, first = np.empty(len(start), np.uint64), 0
    while first < len(start):  # runs of about PIECE bytes
        low = int(start[first])
        last = max(int(np.searchsorted(start, low + PIECE)), first + 1)
        high = max(int(end[first:last].max()), low)
        a, z = start[first:last] - low, end[first:last] - low
        digits, parts = buf[low:high].astype(np.uint64) + _U(1), []
        for prime, base in FIELDS:
            power, inverse = _powers(high - low + 1, prime, base)
            sums = np.zeros(high - low + 1, np.uint64)
            terms = digits * power[: high - low]
            if high - low > 1 << 24:  # else sums stay under 2**64
                terms %= _U(prime)
            np.cumsum(terms, out=sums[1:])
            parts.append((sums[z] - sums[a]) % _U(prime) * inverse[a] % _U(prime))
        out[first:last] = mix(parts[0] | parts[1] << _U(31))
        first = last
    return out


class Words:
    """The words of some texts: hash, start and end of each in buf, and offsets of each text's words."""

    def __init__(self, texts: list[bytes]):
        self.buf = buf = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
        blank = _BLANK[buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes + 1))) + 1
        self.offset = np.searchsorted(self.start, begins)
        self.hash = hash_bytes(buf, self.start, self.end)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += words[i : i + n] * _STEP[i % 64] + _U(i)
        if k > 64:
            h = mix(h)
    return mix(h + _U(k) * _STEP[63])


_held: dict = {}


def held(key: str, make):
    """make(), kept by this worker as its one large object until it holds another or lets go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """A worker that goes on to other work frees what it held, down to the system."""
    if _held:
        _held.clear()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about PIECE bytes, each with the index of its first text; null counts as empty."""
    let_go()
    texts = column.cast(pa.large_binary()).to_pylist()
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > PIECE:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run
