"""Operator 8: mixture-controlled packing by deficit round-robin.

Documents of one source form a queue; each document ends with the id
``end_id``.  Turns of ``length`` tokens are shared out by target weights: in
each turn a queue earns its quota, ``length * weight / sum of weights`` tokens, and
serves whole documents while its deficit (earned less served) is positive.  The
last document may overdraw; the debt is carried into the next turns, across
windows and partitions.  What the queues serve is one stream of tokens, cut into
windows of ``length``, so documents are cut only at window ends and only the
last window can be short.  At any point a queue has served its target within one
document; a queue that runs empty leaves its turns to the others in proportion.

A document that begins ``p`` tokens into its queue is served in turn
``floor(p / quota)``, the first in which the deficit before it is positive.  So
the round-robin needs no loop:

1. encode once (ids, and each document's place in its queue within its task);
2. sums per (source, task) and their prefix sums carry every queue's place, and
   with it the deficit, from task to task;
3. sort by (turn, source, place), range-partitioned, so that a hot source is
   spread over many tasks; places in the stream are prefix sums within a task
   plus the sums of the tasks before it (one number per task on the driver);
4. cut at the window ends.

Default weights are the queues' token counts to the power ``temperature``, which
lifts small sources (1: natural shares, 0: equal shares).

Cases: null or empty texts are the end id alone; a null source is a queue of
its own; null and repeated ids and repeated rows are rows of their own, packed
as often as they occur; ties (equal turns) are ordered by source, then place; an
empty table gives no pieces; a document longer than a window is cut at its ends;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from . import scratch, wordbpe
from .vectext import chunks, ragged, released

#: Rows that a task cuts at once.
ROWS = 512


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, places = wordbpe.coder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1), wordbpe.CHUNK):
                flat, at = coder.encode(data, offs)
                raw, at = memoryview(flat.tobytes()), at.tolist()
                ids, count, place = [], [], []
                tail = end_id.to_bytes(2, "little")
                for i, source in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    n = at[i + 1] - at[i] + 1
                    place.append(places.get(source, 0))
                    places[source] = place[-1] + n
                    ids.append(bytes(raw[2 * at[i] : 2 * at[i + 1]]) + tail)
                    count.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([part] * (b - a), pa.int32()), pa.array(count, pa.int64()), pa.array(place, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc", "source", "part", "n", "place", "ids"],
                )
        coder.clear()

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted columns doc, n, ids with the task's number and the tokens before each row in the task."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column(1))
        ends = total + np.cumsum(n)
        total = int(ends[-1]) if len(n) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], ["doc", "n", "ids", "part", "at"])


def _cut(before: dict[int, int], length: int, keep_ids: bool):
    """Columns doc, n, ids, part, at to pieces; before: tokens of the stream before each task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                n, part, at = (np.asarray(rows.column(k)).astype(np.int64) for k in (1, 3, 4))
                at += np.array([before[p] for p in part.tolist()], np.int64)
                first = at // length
                count = (at + n - 1) // length - first + 1
                owner = np.repeat(np.arange(len(n)), count)
                sequence = ragged(first, count)
                begin = np.maximum(sequence * length, at[owner])
                size = np.minimum((sequence + 1) * length, (at + n)[owner]) - begin
                start = begin - at[owner]
                wide = [memoryview(np.frombuffer(ids.as_buffer(), "<u2").astype("<u4").tobytes()) for ids in rows.column(2)]
                crc = [zlib.crc32(wide[r][4 * s : 4 * (s + k)]) for r, s, k in zip(owner.tolist(), start.tolist(), size.tolist())]
                columns = [rows.column(0).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, size, crc, n[owner], sequence, begin - sequence * length))]
                names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(wide[r][4 * s : 4 * (s + k)], "<i4") for r, s, k in zip(owner.tolist(), start.tolist(), size.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def quotas(totals: DataFrame, length: int, weights: dict[str | None, float] | None, temperature: float) -> DataFrame:
    """Adds each queue's quota of a turn to (source, tokens); sources that ``weights`` does not name weigh 1."""
    if weights is None:
        weighed = totals.withColumn("weight", F.pow("tokens", F.lit(float(temperature))))
    else:
        given = totals.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, w double")
        weighed = totals.join(given, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("weight", F.coalesce("w", F.lit(1.0))).drop("s", "w")
    whole = weighed.agg(F.sum("weight")).first()[0] or 1.0
    return weighed.withColumn("quota", F.col("weight") * F.lit(length / whole))


def pack(
    documents: DataFrame, length: int = 2048, end_id: int = 1, weights: dict[str | None, float] | None = None, temperature: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and with keep_ids the piece's ids)."""
    runtime.ship(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    coded = rows.mapInArrow(released(_encode(tokenizer or wordbpe.default_path(), end_id)), "doc bigint, source string, part int, n bigint, place bigint, ids binary")
    coded = scratch.table(coded, "encoded")
    sums = scratch.table(coded.groupBy("source", "part").agg(F.sum("n").alias("n")), "queue-parts")
    quota = quotas(sums.groupBy("source").agg(F.sum("n").alias("tokens")), length, weights, temperature).select(F.col("source").alias("s"), "quota")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quota, F.col("source").eqNullSafe(F.col("s")))
    # written, so that the plan knows its size before the ids are dealt out for a join
    bases = scratch.table(bases.select("s", F.col("part").alias("p"), "base", "quota"), "queue-bases")
    placed = coded.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("base") + F.col("place"))
    stream = placed.orderBy(F.floor(F.col("at") / F.col("quota")), "source", "at").select("doc", "n", "ids")
    stream = scratch.table(stream.mapInArrow(released(_streamed), "doc bigint, n bigint, ids binary, part int, at bigint"), "stream")
    scratch.drop(coded, sums, bases)
    total, starts = 0, {}
    for part, n in sorted(map(tuple, stream.groupBy("part").agg(F.sum("n")).collect())):
        starts[part] = total
        total += n
    out = stream.mapInArrow(
        released(_cut(starts, length, keep_ids)),
        "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * keep_ids,
    )
    return out.withColumnRenamed("doc", id_col)
