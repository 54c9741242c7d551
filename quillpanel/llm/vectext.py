"""Vectorised tokenisation and hashing of whole Arrow text columns.

Every text operator of this subpackage sees a text the same way: a *word* is a
maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  The functions here turn an
Arrow string column into numpy arrays (word starts, word ends, 64-bit word
names) without a Python loop over words, so a Python worker spends its time in
numpy kernels and holds one bounded chunk of text at a time.

Names (hashes) are pure functions of the bytes, equal on every executor, so
they serve as global names without a dictionary on the driver.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are processed at once (a single longer text is one chunk).
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_M1 = U64(int("BF58476D1CE4E5B9", 16))
_M2 = U64(int("94D049BB133111EB", 16))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x ^= x >> U64(27)
    x = x * _M2
    x ^= x >> U64(31)
    return x


#: The two largest primes below 2**31.
PRIMES = (2147483647, 2147483629)
#: Runs of more bytes than this are named by a digest.
BLOCKWISE = 256
_STEP = U64(int("D1B54A32D192ED03", 16))


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p; the division by a scalar is vectorised, the remainder is not."""
    return x - x // U64(p) * U64(p)


class Powers:
    """Powers of a base and of its inverse modulo a prime, grown on demand."""

    def __init__(self, base: int, prime: int):
        self.prime, self.bases = prime, (base, pow(base, -1, prime))
        self.tables = [np.ones(1, U64), np.ones(1, U64)]

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, _mod(t * U64(pow(b, m, self.prime)), self.prime)]) for t, b in zip(self.tables, self.bases)]
        return self.tables[0], self.tables[1]


_POWERS = tuple(Powers(base, p) for base, p in zip((1103515245, 1220703125), PRIMES))


def prefix(values: np.ndarray) -> list[np.ndarray]:
    """Prefix sums, one for each prime, from which ``spans`` reads the name of any run of values."""
    out = []
    for powers in _POWERS:
        up, _ = powers.need(len(values) + 1)
        pre = np.zeros(len(values) + 1, U64)
        np.cumsum(_mod(_mod(values, powers.prime) * up[: len(values)], powers.prime), out=pre[1:])
        out.append(pre)
    return out


def spans(pre: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the runs [start, end), equal for equal runs wherever they stand.

    A name mixes two polynomials modulo primes near 2**31, so unlike one modulo
    2**64 it does not lose bits on self-similar runs (Thue-Morse words).
    """
    halves = []
    for p, powers in zip(pre, _POWERS):
        _, down = powers.need(len(p))
        halves.append(_mod(_mod(p[end] - p[start], powers.prime) * down[start], powers.prime))
    return mix((halves[0] | halves[1] << U64(32)) + (end - start).astype(U64) * _M2)


def byte_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of runs of bytes: a chain of mixed blocks of 8 bytes, a digest for long runs."""
    size = ends - starts
    out = size.astype(U64) * _M2
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= BLOCKWISE))
    done = 0
    while len(live):
        block, left = at_byte[starts[live] + done], size[live] - done
        short = left < 8
        block[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[live] = mix(out[live] * _STEP + block)
        done += 8
        live = live[left > 8]
    long = np.flatnonzero(size > BLOCKWISE)
    for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
        out[i] = int.from_bytes(blake2b(data[a:b], digest_size=8).digest(), "little")
    return out


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in bytes); a null text is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offs)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        if column.null_count and (lengths[a:b] != np.diff(offs[a : b + 1])).any():
            part = np.concatenate([body[offs[i] : offs[i] + lengths[i]] for i in range(a, b)] or [body[:0]])
            own = np.concatenate([[0], np.cumsum(lengths[a:b])])
        else:
            part, own = body[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        yield a, b, part, own
        a = b


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, word offsets of the texts); no word spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = gap[:-1]
    edge[offs[offs < len(data)]] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[:-1] = gap
    edge[offs] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives its worker's free memory back when it ends; workers outlive tasks."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def row_ids(offsets: np.ndarray) -> np.ndarray:
    """For offsets of rows in a flat array: the row of each flat element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start, start+1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
