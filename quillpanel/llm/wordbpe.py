"""Encoding whole text columns with a word-level BPE file, one word type at a time.

For a tokenizer that drops white space and never joins across it (split into
letter, digit and symbol runs, each encoded alone), the ids of a text are the
ids of its words in order.  ``WordCoder`` therefore encodes each distinct word
(in lower case, without an ending stop or comma) once and lays the ids out with
numpy.  The result equals
``Tokenizer.encode(text, add_special_tokens=False).ids``; the tests hold it
against that call on whole texts.
"""

from __future__ import annotations

import os

import numpy as np

from .vectext import LOWER, ragged, byte_names, words

#: Word types that one task remembers; beyond, it starts anew.
REMEMBER = 400_000
#: Bytes of text that are encoded at once: each chunk looks up its word types.
CHUNK = 1 << 23
_coders: dict[str, WordCoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept as 16 bits")
        self.closing = np.zeros(1 << 16, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.closing[i] = piece.endswith("</w>")
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        single = {b: self.tokenizer.encode(chr(b), add_special_tokens=False).ids for b in b".,"}
        self.marks = [(b, ids[0]) for b, ids in single.items() if len(ids) == 1]
        self.clear()

    def clear(self) -> None:
        #: sorted names of the known types and their numbers; by number where its ids start
        self.names, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _encode_words(self, fresh: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(an order of the words, in it the numbers of their ids, their ids).  Words of letters are one unit
        each, so many of them are encoded as one text and told apart by the ids that end a unit."""
        plain = [i for i, w in enumerate(fresh) if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        joined = self.tokenizer.encode_batch_fast([" ".join([fresh[i] for i in g]) for g in groups], add_special_tokens=False)
        order, counts, flat = [], [], []
        for g, e in zip(groups, joined):
            ids = np.array(e.ids, np.int64)
            stops = np.flatnonzero(self.closing[ids]) + 1
            if len(stops) == len(g) and (not len(ids) or stops[-1] == len(ids)):
                order += g
                counts.append(np.diff(stops, prepend=0))
                flat.append(ids)
        done = np.zeros(len(fresh), bool)
        done[order] = True
        rest = np.flatnonzero(~done).tolist()
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([fresh[i] for i in rest], add_special_tokens=False)]
        counts.append(np.array([len(x) for x in alone], np.int64))
        flat.append(np.array([i for x in alone for i in x], np.int64))
        return order + rest, np.concatenate(counts), np.concatenate(flat)

    def _types(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For each word the index of its type."""
        kinds, first, inverse = np.unique(byte_names(data, s, e), return_index=True, return_inverse=True)
        if len(self.names) + len(kinds) > REMEMBER:
            self.clear()
        at = np.searchsorted(self.names, kinds)
        new = self.names[np.minimum(at, len(self.names) - 1)] != kinds if len(self.names) else np.ones(len(kinds), bool)
        if new.any():
            raw, fresh = data.tobytes(), first[new]
            order, counts, flat = self._encode_words([raw[x:y].decode("utf-8", "replace") for x, y in zip(s[fresh].tolist(), e[fresh].tolist())])
            number = np.empty(len(fresh), np.int64)
            number[order] = len(self.names) + np.arange(len(fresh))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, flat.astype(np.uint16)])
            self.number, self.names = np.insert(self.number, at[new], number), np.insert(self.names, at[new], kinds[new])
            at = np.searchsorted(self.names, kinds)
        return self.number[at][inverse.ravel()]

    def _lowered(self, data: np.ndarray) -> np.ndarray:
        """The tokenizer lower-cases; doing so first leaves fewer types.  It looks for special
        tokens before that, so what only lower-casing would make one stays as it is."""
        low = LOWER[data]
        raw = low.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                low[at : at + len(token)] = data[at : at + len(token)]
                at = raw.find(token, at + 1)
        return low

    def _lay(self, data: np.ndarray, offs: np.ndarray):
        """(types of the words without an ending stop or comma, the id of that mark or -1, word offsets)."""
        data = self._lowered(data)
        s, e, w = words(data, offs)
        mark = np.full(len(s), -1)
        if len(s):
            last, before = data[e - 1], data[np.maximum(e - 2, 0)]
            cut = (e - s > 1) & (before >= 97) & (before <= 122)
            for byte, i in self.marks:
                mark[cut & (last == byte)] = i
        return (self._types(data, s, e - (mark >= 0)) if len(s) else s), mark, w

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets of the texts in them)."""
        kind, mark, w = self._lay(data, offs)
        core = self.start[kind + 1] - self.start[kind]
        ends = np.concatenate([[0], np.cumsum(core + (mark >= 0))])
        out = np.empty(int(ends[-1]), np.uint16)
        out[ragged(ends[:-1], core)] = self.ids[ragged(self.start[kind], core)]
        out[ends[1:][mark >= 0] - 1] = mark[mark >= 0]
        return out, ends[w]

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Encoded lengths of the texts."""
        kind, mark, w = self._lay(data, offs)
        ends = np.concatenate([[0], np.cumsum(self.start[kind + 1] - self.start[kind] + (mark >= 0))])
        return np.diff(ends[w])


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
