"""Operator 5: exact removal of repeated passages by recompression.

A *window* is ``width`` consecutive words of one document; a word goes if any
window over it occurs anywhere else in the corpus (same document included).

Method.  Every text is recompressed for ``LEVELS`` rounds.  A round names runs
of equal symbols, then names pairs (left-class symbol, right-class symbol); the
class is a bit of the symbol's name, so pairs never overlap.  Names are 64-bit
functions of the content and therefore global without a dictionary.  For each
window the symbols that its own words determine, whatever stands around it, are
its *interior* symbols: each round drops the run at either end and the end
symbol that a neighbour outside could take.  Equal windows thus have the same
interior symbols.  The longest interior symbol (of equally long ones that of the
least name) is the window's anchor: high-level symbols are rare outside repeats,
so texts that share no long passage seldom share an anchor.  Consecutive windows
with one anchor form a *territory* of at most ``width`` windows.  Windows without
an interior symbol (periodic text) are anchored by their own name, so nothing is
lost on any input.

Spark rounds over the territories:

1. count anchors over the corpus; an anchor seen once cannot lie in a repeat;
2. among the rest, count whole contexts (all words that a territory covers).
   A context that occurs twice is repeated throughout;
3. anchors that also have contexts occurring once (the rims of repeats, edited
   copies): one representative text per distinct context is re-read and its
   windows are counted by (anchor, window), weighted by the context's
   occurrences.

Copies of a passage meet only in partial counts, never as lists or pairs, at any
size of a group; what the last round counts is bounded by the words of rims.
Names are compared within an anchor's name, so a false match needs two
independent collisions.

Cases: null or empty texts have no words and come back empty; texts shorter
than ``width`` words are never changed; very long texts are one chunk of a task;
repeated rows (same text, other id) repeat each other; of several repeats that
cover a word (ties) each removes it; null or repeated ids are handled row by row;
an empty table stays empty; further columns, whatever their names, are ignored
(``strip_repeats`` passes them on unchanged).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from . import keys, scratch
from .vectext import U64, as_long, byte_names, chunks, mix, prefix, ragged, released, spans, words

#: Rounds of recompression before anchors are taken.
LEVELS = 3
#: Longer symbols than this count as equally long.
_MOST = 255
_RUN = U64(0xA0761D6478BD642F)
_PAIR = U64(0xE7037ED1A0B428DB)


def _classes(names: np.ndarray, level: int) -> np.ndarray:
    """True: right class (may be the second of a pair)."""
    return (mix(names + np.full(1, level + 1, U64) * _RUN) >> U64(63)).astype(bool)


def _recompress(names: np.ndarray, doc: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of the last level, their words, for each word boundary the first symbol that
    a window starting there determines, and the end of those for one ending there)."""
    n = len(names)
    size = np.ones(n, np.int64)
    first, last = np.arange(n + 1), np.arange(n + 1)
    sym, owner = names, doc
    for level in range(levels):
        m = len(sym)
        head = np.ones(m, bool)
        head[1:] = (sym[1:] != sym[:-1]) | (owner[1:] != owner[:-1])
        run = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, m)).astype(U64)
        sym, owner = sym[at], owner[at]
        sym = np.where(length > 1, mix(sym + length * _RUN), sym)
        size = np.add.reduceat(size, at) if m else size
        runs = len(sym)
        right = _classes(sym, level)
        joins = np.zeros(runs, bool)  # second of a pair
        joins[1:] = right[1:] & ~right[:-1] & (owner[1:] == owner[:-1])
        run_of = np.append(run, runs)
        x = np.minimum(run_of[first] + 1, runs)
        x = np.minimum(x + np.append(right, False)[x], runs)
        y = run_of[np.maximum(last - 1, 0)]
        y = np.maximum(y - np.where(y > 0, ~right[np.maximum(y - 1, 0)], False), 0)
        block = np.append(np.cumsum(~joins) - 1, runs - joins.sum())
        first, last = block[x], block[y]
        keep = np.flatnonzero(~joins)
        paired = np.zeros(runs, bool)
        paired[:-1] = joins[1:]
        merged = sym.copy()
        i = np.flatnonzero(paired)
        merged[i] = mix(sym[i] * _PAIR + mix(sym[i + 1]))
        size[i] += size[i + 1]
        sym, owner, size = merged[keep], owner[keep], size[keep]
    return sym, size, first, last


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the leftmost least value in each non-empty range [lo, hi)."""
    size = hi - lo
    level = np.zeros(len(size), np.int64)
    tables, step = [np.arange(len(values))], 1
    top = int(size.max(initial=1))
    while step * 2 <= top:
        t = tables[-1]
        a, b = t[:-step] if len(t) > step else t[:0], t[step:]
        tables.append(np.where(values[b] < values[a], b, a))
        step *= 2
        level += size >= step
    out = np.empty(len(size), np.int64)
    for k, t in enumerate(tables):
        i = np.flatnonzero(level == k)
        if len(i):
            a, b = t[lo[i]], t[hi[i] - (1 << k)]
            out[i] = np.where(values[b] < values[a], b, a)
    return out


def territories(names: np.ndarray, offsets: np.ndarray, width: int, levels: int = LEVELS):
    """(row, first window in its row, windows, anchor, context) of all texts of a chunk."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    start = ragged(offsets[:-1], counts)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64), np.zeros(0, U64)
    pre = prefix(names)
    sym, size, first, last = _recompress(names, doc, levels)
    lo, hi = first[start], last[start + width]
    rep = -1 - np.arange(len(start))
    inner = np.flatnonzero(lo < hi)
    if len(inner):
        # the longest symbol, of several the one of least name
        order = (U64(_MOST) - np.minimum(size, _MOST).astype(U64)) << U64(56) | mix(sym) >> U64(8)
        rep[inner] = _least(order, lo[inner], hi[inner])
    row = doc[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (rep[1:] != rep[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, len(start)))
    begin = start[at]
    context = spans(pre, begin, begin + count + width - 1)
    anchor = np.where(rep[at] >= 0, sym[np.maximum(rep[at], 0)], context)
    return row[at], begin - offsets[row[at]], count, anchor, context


def _emit_territories(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offs in chunks(batch.column(1)):
                s, e, w = words(data, offs)
                row, at, n, anchor, context = territories(byte_names(data, s, e), w, width)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(a, b - a).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(as_long(anchor)), pa.array(as_long(context))],
                        ["doc", "at", "n", "anchor", "context"],
                    )

    return run


def _emit_windows(width: int):
    """(anchor, context, copies, names): the names of the windows of representative
    contexts, 8 bytes each; columns doc, text, parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                s, e, w = words(data, offs)
                pre = prefix(byte_names(data, s, e))
                parts = batch.column(2).slice(a, b - a)
                flat = parts.flatten()
                at, n = (np.asarray(flat.field(k)).astype(np.int64) for k in ("at", "n"))
                begin = w[np.repeat(np.arange(b - a), np.asarray(parts.value_lengths().fill_null(0)))] + at
                window = ragged(begin, n)
                names = spans(pre, window, window + width)
                ends = np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int32)
                if len(n):
                    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(names)])
                    yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in ("anchor", "context", "copies")), packed], ["anchor", "context", "copies", "names"])

    return run


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(window names, windows of each row) of a packed column."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(U64) if len(column) else np.zeros(0, U64), np.diff(ends) // 8


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of packed contexts."""
    for batch in batches:
        names, n = _unpack(batch.column(3))
        row = np.repeat(np.arange(len(n)), n)
        bit = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        take = pa.array(row)
        if len(row):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(bit.astype(np.int32)), pa.array(as_long(names))], ["anchor", "context", "copies", "bit", "window"])


def _removed(w: np.ndarray, row: np.ndarray, at: np.ndarray, mask: np.ndarray, width: int) -> np.ndarray:
    """True for each word of a chunk that lies in a repeated window."""
    total = int(w[-1])
    step = np.zeros(total + 1, np.int64)
    begin = w[row] + at
    for bit in range(width):
        hit = begin[((mask >> U64(bit)) & U64(1)).astype(bool)] + bit
        np.add.at(step, hit, 1)
        np.add.at(step, hit + width, -1)
    return np.cumsum(step[:-1]) > 0


def _kept(data: np.ndarray, offs: np.ndarray, parts: pa.Array, width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(kept words joined by one space, words, removed words) of the texts of a chunk; parts: lists of (at, mask)."""
    s, e, w = words(data, offs)
    flat = parts.flatten()
    row = np.repeat(np.arange(len(offs) - 1), np.asarray(parts.value_lengths().fill_null(0)))
    gone = _removed(w, row, np.asarray(flat.field("at")).astype(np.int64), np.asarray(flat.field("mask")).view(U64), width)
    keep = np.flatnonzero(~gone)
    length = e[keep] - s[keep]
    # copy each kept word with the byte after it, then make that byte a space
    body = np.append(data, np.uint8(32))[ragged(s[keep], length + 1)]
    stops = np.cumsum(length + 1)
    body[stops - 1] = 32
    bound = np.concatenate([[0], stops])[np.searchsorted(keep, w)]
    raw = body.tobytes()
    texts = [raw[x : max(x, y - 1)] for x, y in zip(bound[:-1].tolist(), bound[1:].tolist())]
    return texts, np.diff(w), np.diff(np.concatenate([[0], np.cumsum(gone)])[w])


def _apply(width: int, digest: bool):
    """Columns doc, text, parts(at, mask) to the counts and the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                texts, n, lost = _kept(data, offs, batch.column(2).slice(a, b - a), width)
                out = pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digest else pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(lost.astype(np.int64)), out],
                    ["doc", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
                )

    return run


def _strip(width: int):
    """Columns doc, text, parts, rest to text and rest; texts without a repeat stay byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                texts, _, lost = _kept(data, offs, batch.column(2).slice(a, b - a), width)
                kept = pa.array(texts, pa.binary()).cast(pa.string())
                text = pc.if_else(pa.array(lost > 0), kept, batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([text, batch.column(3).slice(a, b - a)], ["text", "rest"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle by document.

    What reads them is another Python stage, so they are always shuffled: with a
    broadcast instead, each task would run two Python workers at a time.
    """
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False).compress
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(t.as_buffer()) if t.is_valid else None for t in part.column(1)], pa.binary()), *part.columns[2:]], part.schema.names)


def _unsqueeze(inner):
    """inner over batches whose second column is the text again, some documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    texts = pa.array([None if t is None else unpack(t) for t in part.column(1).to_pylist()], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), texts, *part.columns[2:]], part.schema.names)

        return inner(plain())

    return run


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc, parts), written: parts are (at, mask); bit k of mask says that the window starting at word at + k is repeated.

    docs has the columns doc (unique bigint) and text.
    """
    if not 2 <= width <= 63:
        raise ValueError("a window has 2 to 63 words")
    every = docs.mapInArrow(released(_emit_territories(width)), "doc bigint, at int, n int, anchor bigint, context bigint")
    every = scratch.table(every, "territories")
    # counts are written before they are joined: a join that reads two exchanges of its own can split a hot anchor
    shared = scratch.table(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "shared-anchors")
    found = scratch.table(every.join(shared, "anchor"), "shared-territories")
    scratch.drop(every, shared)
    contexts = found.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "at", "n")).alias("rep"))
    contexts = scratch.table(contexts, "contexts")
    kinds = scratch.table(contexts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").select("anchor"), "mixed-anchors")
    part = F.struct(F.col("rep.at").alias("at"), F.col("rep.n").alias("n"), "anchor", "context", "copies").alias("part")
    parts = contexts.join(kinds, "anchor").select("rep.doc", part).groupBy("doc").agg(F.collect_list("part").alias("parts"))
    rows = docs.mapInArrow(released(_squeeze), "doc bigint, text binary").join(parts.hint("merge"), "doc").select("doc", "text", "parts")
    packed = scratch.table(rows.mapInArrow(released(_unsqueeze(_emit_windows(width))), "anchor bigint, context bigint, copies bigint, names binary"), "packed-windows")
    window = packed.mapInArrow(released(_explode), "anchor bigint, context bigint, copies bigint, bit int, window bigint")
    often = scratch.table(window.groupBy("anchor", "window").agg(F.sum("copies").alias("c")).where("c > 1").select("anchor", "window"), "repeated-windows")
    rims = window.where("copies = 1").join(often, ["anchor", "window"]).groupBy("anchor", "context").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    whole = contexts.where("copies > 1").select("anchor", "context", F.expr("-1L").alias("mask"))
    masks = scratch.table(whole.unionByName(rims), "masks")
    scratch.drop(packed, contexts, kinds, often)
    out = found.join(masks, ["anchor", "context"]).select("doc", "at", F.expr("mask & (shiftleft(1L, n) - 1L)").alias("mask"))
    out = scratch.table(out.where("mask <> 0").groupBy("doc").agg(F.collect_list(F.struct("at", "mask")).alias("parts")), "repeats")
    scratch.drop(found, masks)
    return out


def remove_repeats(documents: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: its id, n_words, n_removed and kept_text (or, with digest, its SHA-256)."""
    runtime.ship(documents.sparkSession)
    rows, key, plain = keys.keyed(documents, id_col)
    docs = rows.select(F.col(key).alias("doc"), F.col(text_col).cast("string").alias("text"))
    joined = docs.mapInArrow(released(_squeeze), "doc bigint, text binary").join(repeated_windows(docs, width).hint("merge"), "doc", "left").select("doc", "text", "parts")
    last = "kept_sha256" if digest else "kept_text"
    out = joined.mapInArrow(released(_unsqueeze(_apply(width, digest))), f"doc bigint, n_words bigint, n_removed bigint, {last} string")
    return out.withColumnRenamed("doc", id_col) if plain else keys.named(out, rows, key, id_col)


def strip_repeats(documents: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with repeated passages cut from the texts."""
    runtime.ship(documents.sparkSession)
    rows, key, _ = keys.keyed(documents, id_col)
    others = [c for c in documents.columns if c != text_col]
    docs = rows.select(F.col(key).alias("doc"), F.col(text_col).cast("string").alias("text"))
    full = rows.select(F.col(key).alias("doc"), F.col(text_col).cast("string").alias("text"), F.struct(*others).alias("rest"))
    kind = full.schema["rest"].dataType
    small = full.mapInArrow(released(_squeeze), T.StructType([T.StructField("doc", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("rest", kind)]))
    joined = small.join(repeated_windows(docs, width).hint("merge"), "doc", "left").select("doc", "text", "parts", "rest")
    out = joined.mapInArrow(released(_unsqueeze(_strip(width))), T.StructType([T.StructField("text", T.StringType()), T.StructField("rest", kind)]))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in documents.columns))
