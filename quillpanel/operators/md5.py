"""The first 28 bits of md5 of many short texts at once, as ``resample.draw`` has them for one.

The texts are tails behind a common head.  A text of up to 55 bytes is one block of
sixteen 32-bit words, so a round of md5 is a few operations over arrays; the words of
the tails are laid out once for all heads of a length.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONGEST = 55
#: Texts worked on at a time: their words and sums stay in a core's cache.
CHUNK = 16384
_K = [np.uint32(int(abs(np.sin(np.float64(i + 1))) * 2**32)) for i in range(64)]
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_LEFT = [np.uint32(_TURN[i // 16][i % 4]) for i in range(64)]
_RIGHT = [np.uint32(32 - _TURN[i // 16][i % 4]) for i in range(64)]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


class Tails:
    """Tails of texts (bytes, dtype S); ``draws(head)`` gives a number below 2**28 for each."""

    def __init__(self, tails: np.ndarray):
        self.tails, self.length, self.parts = tails, np.char.str_len(tails).astype(np.int64), {}

    def _laid_out(self, head: int) -> list[dict[int, np.ndarray]]:
        """Words that are not all zero, by chunk, of the tails behind ``head`` bytes."""
        if head not in self.parts:
            self.parts = {head: [self._words(head, a) for a in range(0, len(self.tails), CHUNK)]}
        return self.parts[head]

    def _words(self, head: int, first: int) -> dict[int, np.ndarray]:
        tails, width = self.tails[first : first + CHUNK], self.tails.dtype.itemsize
        n, ends = len(tails), np.minimum(head + self.length[first : first + CHUNK], LONGEST)
        block = np.zeros((n, max(64, head + width + 1)), np.uint8)
        block[:, head : head + width] = tails.view(np.uint8).reshape(n, width)
        block[np.arange(n), ends] = 0x80
        block[:, 56], block[:, 57] = (ends * 8) & 255, (ends * 8) >> 8
        words = np.ascontiguousarray(block[:, :64]).view("<u4")
        return {w: np.ascontiguousarray(words[:, w]) for w in range(16) if words[:, w].any()}

    def draws(self, head: bytes) -> np.ndarray:
        n = len(self.tails)
        out = np.empty(n, np.uint32)
        if len(head) <= LONGEST:
            heads = np.frombuffer(head.ljust(64, b"\0"), "<u4")
            for k, part in enumerate(self._laid_out(len(head))):
                words = {w: part[w] | heads[w] if w in part else heads[w] for w in range(16) if w in part or heads[w]}
                _digest(words, out[k * CHUNK : (k + 1) * CHUNK])
        for i in np.flatnonzero(self.length + len(head) > LONGEST):
            out[i] = int(hashlib.md5(head + self.tails[i]).hexdigest()[:7], 16)
        return out


def _digest(m: dict[int, np.ndarray], out: np.ndarray) -> None:
    size = len(out)
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    xor, both, add = np.bitwise_xor, np.bitwise_and, np.add
    for i in range(64):
        if i < 16:
            xor(c, d, f), both(f, b, f), xor(f, d, f)
        elif i < 32:
            xor(b, c, f), both(f, d, f), xor(f, c, f)
        elif i < 48:
            xor(b, c, f), xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), xor(f, c, f)
        add(a, _K[i], a), add(f, a, f)
        if _WORD[i] in m:
            add(f, m[_WORD[i]], f)
        np.left_shift(f, _LEFT[i], t), np.right_shift(f, _RIGHT[i], f), np.bitwise_or(f, t, f), add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    add(a, _START[0], a)
    np.right_shift(a.byteswap(), np.uint32(4), out)


def numbers(first: int, last: int) -> np.ndarray:
    """The integers first..last-1 as bytes."""
    return np.arange(first, last).astype(f"S{len(str(max(last - 1, 0)))}")
