"""Counts of whole texts: words, characters, symbols, repeated lines and windows."""

from __future__ import annotations

import numpy as np

from .vectext import U64, byte_names, mix, prefix, spans, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CLASS = np.zeros((6, 256), bool)  # upper, lower, digit, shout, stop, other letter lead
_CLASS[0, 65:91] = _CLASS[1, 97:123] = _CLASS[2, 48:58] = True
_CLASS[3, list(b"!?")] = True
_CLASS[4, list(b".,;:")] = True
_CLASS[5, 0xC0:] = True
_ROW = U64(0xD6E8FEB86659FD93)


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


def twice(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs at least twice."""
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True for each key that an earlier position also holds."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][k[1:] == k[:-1]]] = True
    return out


def _own(names: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Names made distinct between the texts of a chunk."""
    return mix(names + row.astype(U64) * _ROW)


def repeat_words(names: np.ndarray, w: np.ndarray, width: int = 5) -> np.ndarray:
    """Per text: words in ``width``-word windows that occur twice or more in it."""
    n = len(names)
    row = np.repeat(np.arange(len(w) - 1), np.diff(w))
    if n < width:
        return np.zeros(len(w) - 1, np.int64)
    pre = prefix(names)
    start = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    hit = start[twice(_own(spans(pre, start, start + width), row[start]))]
    step = np.zeros(n + 1, np.int64)
    step[hit] += 1
    step[hit + width] -= 1
    return _per_row(np.cumsum(step[:-1]) > 0, w)


def line_counts(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier line of the text."""
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offs, breaks, "right") - 1
    begin = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    row = np.sort(np.concatenate([np.arange(len(offs) - 1), row_of_break]), kind="stable")
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, row = begin[full], end[full], row[full]
    names = byte_names(data, begin, end)
    size = len(offs) - 1
    return np.bincount(row, minlength=size), np.bincount(row[later(_own(names, row))], minlength=size)


def counts(data: np.ndarray, offs: np.ndarray, more: bool = False) -> dict[str, np.ndarray]:
    """Arrays by name, one element per text; with ``more`` also those for the classifier."""
    s, e, w = words(data, offs)
    rows = len(offs) - 1
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    size = chars[e] - chars[s]
    in_words = np.concatenate([[0], np.cumsum(size)])[w]
    names = byte_names(data, s, e)
    lines, dup = line_counts(data, offs, s)
    out = {
        "n_words": np.diff(w), "word_chars": np.diff(in_words), "n_symbols": _per_row(SYMBOLS[data], offs), "n_lines": lines,
        "n_dup_lines": dup, "n_repeat_words": repeat_words(names, w), "n_upper": _per_row(_CLASS[0][data], offs), "n_lower": _per_row(_CLASS[1][data], offs),
    }
    if more:
        row = np.repeat(np.arange(rows), np.diff(w))
        first = data[s] if len(s) else np.zeros(0, np.uint8)
        last = data[e - 1] if len(s) else np.zeros(0, np.uint8)
        out |= {
            "n_chars": np.diff(chars[offs]), "n_digits": _per_row(_CLASS[2][data], offs), "n_shouts": _per_row(_CLASS[3][data], offs),
            "n_stops": _per_row(_CLASS[4][data], offs), "n_wide": _per_row(_CLASS[5][data], offs), "n_distinct": np.diff(w) - np.bincount(row[later(_own(names, row))], minlength=rows),
            "sum_squares": np.diff(np.concatenate([[0], np.cumsum(size * size)])[w]), "n_short": _per_row(size <= 2, w), "n_long": _per_row(size >= 14, w),
            "n_capital": _per_row(_CLASS[0][first], w), "n_ended": _per_row(last == 46, w),
        }
    return out
