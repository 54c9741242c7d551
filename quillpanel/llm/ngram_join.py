"""Operator 1: exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the names of its distinct n-word shingles.  Two sets
link when ``100 * |x & y| >= percent * |x | y|``.  Linked sets share at least
``a(x) = ceil(percent * |x| / 100)`` tokens, so under one global token order
the prefixes of ``|x| - a(x) + l`` tokens share at least ``l``.

Global order: frequent (*hot*) tokens last, the more frequent the later, then
by token name.  Which tokens are hot comes from exact counts over the corpus,
first of plain prefixes, then of the prefixes under that first order; the table
has a fixed size (the limit doubles until at most ``HOT_LIST`` tokens exceed
it), and any table gives the same links, only at another cost.

Adaptive part: the estimated candidate cost of a document is the number of hot
tokens that its plain prefix would hold.  Each of them lengthens its prefix by
one token and raises by one the number of shared prefix tokens that a pair must
show: l(x) = 1 + hot tokens in the prefix, and a pair needs min(l(x), l(y)).
A pair's first shared token also bounds its overlap by what follows in both.
One pass keeps the first tokens of every set; sets whose first tokens are mostly
hot (members of mass families) are read again in whole.

Candidates are verified exactly on whole texts.  Families are never expanded
into pairs:

* identical sets collapse to one representative;
* stars: each set is compared with the one leader (of all leaders of its prefix
  tokens) that it meets most often.  Leaders are those with the smallest share
  of rare tokens, i.e. the source of an edited family;
* differences: a set near its leader L is described by what it adds to L and
  what it lacks.  If x does not link to L, then any y of that family which links
  to x shares a difference with it, at least
  ``(d(x) + d(y) - (|x| + |y|)(100 - percent) / (100 + percent)) / 2`` of them, and if
  it shares no added token then y lacks more than it adds.  So members meet by
  prefixes of their differences, own edits first, instead of by the tokens
  that the whole family shares.  A second round of stars within these (families
  within families) comes before any pair;
* only sets without a common leader and in different components meet by prefix.

Components need no more links than that.

Cases: null or empty texts have an empty set and no link; texts with fewer
words than n have one shingle (the whole sequence); ties and repeated rows are
identical sets; an empty table gives an empty result; other columns are ignored
(``keep_one`` passes them on); null or repeated ids are handled row by row, and
a component's id is then the least id of its rows.  Sets are named by 64 bits of
their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import graph, keys, scratch
from .vectext import LOWER, U64, as_long, byte_names, chunks, mix, ragged, released, words

#: A token in more prefixes than this is hot, while the list stays within HOT_LIST.
HOT_DF = 24
HOT_LIST = 1 << 20
_SLOTS = 1 << 23
#: Members that one verification group holds besides its leader.
GROUP = 64
#: Percent of similarity from which a set is described by its differences from its leader.
NEAR = 50
_STEP = U64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle names of each text of a chunk."""
    if lower:
        data = LOWER[data]
    s, e, w = words(data, offs)
    names = byte_names(data, s, e)
    whole = np.zeros(max(len(names) - n + 1, 0), U64)
    for k in range(n):
        whole = mix(whole * _STEP + names[k : k + len(whole)])
    for a, b in zip(w[:-1].tolist(), w[1:].tolist()):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            h = np.full(1, b - a, U64)
            for k in range(a, b):
                h = mix(h * _STEP + names[k])
            yield h
        else:
            yield names[:0]


def _name(tokens: np.ndarray) -> int:
    x = np.array([mix(tokens).sum(dtype=U64), np.bitwise_xor.reduce(tokens, initial=U64(0))])
    x = mix(x + U64(1) * np.array([len(tokens), 7], U64))
    return int(mix(x[:1] ^ (x[1:] << U64(1)))[0].view(np.int64))


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _reach(size: int, percent: int) -> int:
    """Tokens of a set that are kept at first: enough for a prefix in which up to half are hot."""
    return 2 * (size - _need(size, percent) + 1)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(t) for t in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(as_long(flat)))


def _emit_heads(n: int, percent: int, lower: bool):
    """(doc, sid, size, head) of each document; the head is empty where the task met the set before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                sids, sizes, heads = [], [], []
                for t in shingle_sets(data, offs, n, lower):
                    sids.append(_name(t))
                    sizes.append(len(t))
                    heads.append(t[:0] if sids[-1] in seen else t[: _reach(len(t), percent)])
                    seen.add(sids[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), _lists(heads)], ["doc", "sid", "size", "head"])

    return run


def _emit_full(n: int, lower: bool):
    """(sid, size, head) with all tokens, from columns sid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                sets = list(shingle_sets(data, offs, n, lower))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in sets], pa.int32()), _lists(sets)], ["sid", "size", "head"])

    return run


def _classes(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(tokens & U64(_SLOTS - 1)).astype(np.int64)]


def adaptive_prefix(t: np.ndarray, size: int, percent: int, table: np.ndarray) -> tuple[np.ndarray, int, float] | None:
    """(prefix in global order, required shared tokens, share of rare tokens); None if the
    head t of a set of the given size does not hold its first tokens."""
    alpha = _need(size, percent)
    plain = size - alpha + 1
    cls = _classes(t, table)
    rare = t[cls == 0]
    if len(rare) >= plain:
        heats = int((cls[:plain] > 0).sum())
        shared = 1 + min(heats, len(rare) - plain, alpha - 1)
        return rare[: plain + shared - 1], shared, len(rare) / len(t)
    if len(t) < size:
        return None
    shared = 1 + min(plain - len(rare), alpha - 1)
    return t[np.argsort(cls, kind="stable")][: plain + shared - 1], shared, len(rare) / len(t)


def _emit_prefixes(percent: int, hot):
    """(token, pos, sid, size, shared, rare) from columns sid, size, head; pos -1 marks a set that needs more than its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        for batch in batches:
            sids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends = np.asarray(batch.column(2).offsets) - batch.column(2).offsets[0].as_py()
            flat = np.asarray(batch.column(2).flatten()).view(U64)
            tokens, pos, rows = [], [], []
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if a == b:
                    continue
                got = adaptive_prefix(flat[a:b], sizes[i], percent, table)
                mine, shared, rare = got or (np.zeros(1, U64), 0, 0.0)
                tokens.append(mine)
                pos.append(np.arange(len(mine)) if got else np.full(1, -1))
                rows.append((sids[i], sizes[i], shared, rare, len(mine)))
            if rows:
                sid, size, shared, rare, count = (np.array(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(tokens))), pa.array(np.concatenate(pos).astype(np.int32)), *(pa.array(np.repeat(x.astype(k), count)) for x, k in ((sid, np.int64), (size, np.int32), (shared, np.int32), (rare, np.float32)))],
                    ["token", "pos", "sid", "size", "shared", "rare"],
                )

    return run


_PREFIX = "token bigint, pos int, sid bigint, size int, shared int, rare float"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of token lists to (token, n), added up within a batch."""
    for batch in batches:
        tokens, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], ["token", "n"])


def _hot_table(tokens: DataFrame, known: np.ndarray | None = None) -> np.ndarray:
    """Frequency classes by slot of the tokens that occur more than HOT_DF times, from rows (token, n); of fixed size."""
    counts = scratch.table(tokens.groupBy("token").agg(F.sum("n").alias("df")).where(f"df > {HOT_DF}"), "frequent-tokens")
    limit = HOT_DF
    while counts.where(f"df > {limit}").count() > HOT_LIST:
        limit *= 2
    slot, step = F.col("token").bitwiseAND(_SLOTS - 1).cast("int").alias("slot"), F.least(F.log2(F.col("df") / HOT_DF) + 1, F.lit(15.0)).cast("byte")
    found = counts.where(f"df > {limit}").groupBy(slot).agg(F.max(step).alias("class")).toArrow()
    table = np.zeros(_SLOTS, np.uint8) if known is None else known.copy()
    at = np.asarray(found.column("slot"))
    table[at] = np.maximum(table[at], np.asarray(found.column("class")).astype(np.uint8))
    scratch.drop(counts)
    return table


def adaptive_prefixes(docs: DataFrame, sets: DataFrame, reps: DataFrame, n: int, percent: int, lower: bool) -> tuple[DataFrame, object]:
    """(written prefix rows under one global order, the broadcast table of that order)."""
    spark = docs.sparkSession

    def full(sids: DataFrame) -> DataFrame:
        texts = sids.join(reps, "sid").join(docs, "doc").select("sid", "text")
        return scratch.table(texts.mapInArrow(released(_emit_full(n, lower)), "sid bigint, size int, head array<bigint>"), "full-sets")

    plain = f"slice(head, 1, cast(size - ({percent} * size + 99) div 100 + 1 as int))"
    one = F.lit(1).cast("bigint").alias("n")
    hot = _hot_table(sets.select(F.explode(F.expr(plain)).alias("token"), one))
    shared = spark.sparkContext.broadcast(hot)
    heads = sets.select("sid", "size", "head")
    first = scratch.table(heads.mapInArrow(released(_emit_prefixes(percent, shared)), _PREFIX).select("token", "pos", "sid"), "first-prefixes")
    whole = full(first.where("pos < 0").select("sid").distinct())
    seen = first.where("pos >= 0").select("token", one).unionAll(whole.select("head").mapInArrow(released(_tally), "token bigint, n bigint"))
    order = spark.sparkContext.broadcast(_hot_table(seen, hot))
    scratch.drop(first)
    rows = scratch.table(heads.mapInArrow(released(_emit_prefixes(percent, order)), _PREFIX), "head-prefixes")
    more = full(rows.where("pos < 0").select("sid").distinct().join(whole.select("sid"), "sid", "left_anti"))
    late = scratch.table(whole.unionByName(more).mapInArrow(released(_emit_prefixes(percent, order)), _PREFIX), "full-prefixes")
    scratch.drop(whole, more)
    shared.destroy()
    return rows.where("pos >= 0").unionByName(late), order


def _differences(percent: int, first: np.ndarray, t: np.ndarray, table: np.ndarray) -> tuple[bool, bool, int, bool, np.ndarray, np.ndarray]:
    """(linked, near, differences, fewer added than missing, first added tokens, first missing tokens) of a set and its leader."""
    inside = np.isin(t, first, assume_unique=True)
    both = int(inside.sum())
    union = len(first) + len(t) - both
    linked, near = 100 * both >= percent * union and both > 0, 100 * both >= NEAR * union and both > 0
    if not near:
        return linked, False, union - both, False, t[:0], t[:0]
    plus, minus = t[~inside], first[~np.isin(first, t, assume_unique=True)]
    d = len(plus) + len(minus)
    other = len(first) - len(t) if linked else -len(first) - len(t)
    least = max(1, -(-((100 + percent) * d + (100 - percent) * other) // (2 * (100 + percent))))
    k = max(0, d - least + 1)
    plus = plus[np.argsort(_classes(plus, table), kind="stable")]
    return linked, True, d, len(plus) < len(minus), plus[:k], minus[: max(0, k - len(plus))]


_FOUND = "a bigint, b bigint, linked boolean, near boolean, shrunk boolean, size_a int, size_b int, d int, pos int, minus boolean, token bigint"


def _verify_rows(n: int, percent: int, lower: bool, order, differences: bool):
    """Rows (a, part, sid, text), sorted so that each group's leader (sid = a) comes first, to
    one row for each pair (pos -1) and, with differences, one for each first difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, None
        table = order.value
        for batch in batches:
            for x, y, data, offs in chunks(batch.column(3)):
                rows = zip(*(batch.column(k).slice(x, y - x).to_pylist() for k in range(3)), shingle_sets(data, offs, n, lower))
                pairs, tokens = [], []
                for lead, part, sid, t in rows:
                    if (lead, part) != group:
                        group, first = (lead, part), t
                    elif sid != lead:
                        linked, near, d, shrunk, plus, minus = _differences(percent, first, t, table)
                        if not differences:
                            plus, minus = plus[:0], minus[:0]
                        pairs.append((lead, sid, linked, near, shrunk, len(first), len(t), d, len(plus), len(minus)))
                        tokens += [np.zeros(1, U64), plus, minus]
                if pairs:
                    *same, added, missing = (np.array(c) for c in zip(*pairs))
                    count = 1 + added + missing
                    pos = ragged(np.full(len(count), -1), count)
                    kinds = (np.int64, np.int64, bool, bool, bool, np.int32, np.int32, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.repeat(c.astype(k), count)) for c, k in zip(same, kinds)), pa.array(pos.astype(np.int32)), pa.array(pos >= np.repeat(added, count)), pa.array(as_long(np.concatenate(tokens)))],
                        ["a", "b", "linked", "near", "shrunk", "size_a", "size_b", "d", "pos", "minus", "token"],
                    )

    return run


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int, lower: bool, order, name: str, differences: bool = False) -> DataFrame:
    """The distinct pairs (a, b) compared by whole texts: columns of _FOUND, written."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    members = pairs.join(sizes, "a").select("a", F.expr("pmod(hash(b), parts)").alias("part"), F.col("b").alias("sid"), F.lit(False).alias("lead"))
    members = scratch.table(members, "members")
    used = members.select("a", "part").distinct()
    leads = used.select("a", "part", F.col("a").alias("sid"), F.lit(True).alias("lead"))
    roles = members.unionByName(leads).join(reps, "sid").select("doc", "a", "part", "sid", "lead")
    texts = roles.join(docs, "doc").repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead"))
    out = scratch.table(texts.select("a", "part", "sid", "text").mapInArrow(released(_verify_rows(n, percent, lower, order, differences)), _FOUND), name)
    scratch.drop(members)
    return out


def _fits(percent: int) -> str:
    return f"100 * least(size_x, size_y) >= {percent} * greatest(size_x, size_y)"


def _overlaps(percent: int) -> str:
    """Enough differences can be shared from two positions on for a link."""
    return f"{100 + percent} * (d_x + d_y) - {100 - percent} * (size_x + size_y) <= {2 * (100 + percent)} * least(d_x - pos_x, d_y - pos_y)"


def _sides(rows: DataFrame, keep: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*keep, *(F.col(c).alias(f"{c}_{k}") for c in columns)) for k in "xy")


def _by_met(pairs: DataFrame) -> DataFrame:
    """For each set the one leader that it meets most often."""
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("met"))
    return met.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a")).select("a", "b")


def _star_by_prefix(rows: DataFrame, percent: int) -> DataFrame:
    lead = rows.groupBy("token").agg(F.min(F.struct("rare", "sid", "size")).alias("l"))
    pairs = rows.join(lead, "token").select(F.col("l.sid").alias("a"), F.col("sid").alias("b"), F.col("l.size").alias("size_x"), F.col("size").alias("size_y"))
    return _by_met(pairs.where(f"a <> b and {_fits(percent)}"))


def _star_by_difference(found: DataFrame, percent: int) -> DataFrame:
    """Leaders of second families: among sets with one leader, the nearest one that shows an added token."""
    rows = found.where("pos >= 0 and not minus")
    lead = rows.groupBy("a", "token").agg(F.min(F.struct("d", "b", F.col("size_b").alias("size"), "pos", "linked")).alias("l"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = rows.withColumnRenamed("a", "top").join(lead.withColumnRenamed("a", "top"), ["top", "token"]).where("b <> l.b and not (linked and l.linked)")
    pairs = pairs.select(F.col("l.b").alias("a"), "b", F.col("l.size").alias("size_x"), F.col("size_b").alias("size_y"), F.col("l.d").alias("d_x"), F.col("d").alias("d_y"), F.col("l.pos").alias("pos_x"), F.col("pos").alias("pos_y"))
    return _by_met(pairs.where(f"{_fits(percent)} and {_overlaps(percent)}"))


def _pairs_by_difference(found: DataFrame, other: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of sets with one leader that can link, at least one of them not linked to the leader.

    Such a pair shares a difference; if it shares no added token, the member that
    is linked (or both) lacks more than it adds.  other: (b, again), a second
    leader; pairs that share it too are compared there.
    """
    rows = found.where("pos >= 0").withColumnRenamed("size_b", "size")
    rows = rows.withColumn("again", F.col("b")) if other is None else rows.join(other, "b", "left").withColumn("again", F.coalesce("again", "b"))
    x, y = _sides(rows, ["a", "minus", "token"], ["b", "linked", "shrunk", "size", "d", "pos", "again"])
    can = f"again_x <> again_y and again_x <> b_y and b_x <> again_y and {_fits(percent)} and {_overlaps(percent)}"
    added = x.where("not minus").join(y.where("not minus"), ["a", "minus", "token"]).where(f"b_x < b_y and not (linked_x and linked_y) and {can}")
    lacking = x.where("minus and shrunk_x").join(y.where("minus and not linked_y"), ["a", "minus", "token"]).where(f"b_x <> b_y and (linked_x or shrunk_y) and {can}")
    return added.select("b_x", "b_y").unionAll(lacking.select("b_x", "b_y"))


def _pairs_by_prefix(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components and without a common leader that share enough prefix tokens; rows have comp, fam and again."""
    mixed = rows.groupBy("token").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "fam") for f in (F.min, F.max))).where("min_comp <> max_comp and min_fam <> max_fam").select("token")
    rows = scratch.table(rows.join(mixed, "token"), "open-prefixes")
    x, y = _sides(rows, ["token"], ["sid", "size", "shared", "comp", "pos", "fam", "again"])
    # a pair that links shows its first l shared tokens early enough in both sets
    most = "(least(size_x - pos_x, size_y - pos_y) + least(shared_x, shared_y) - 1)"
    early = f"100 * {most} >= {percent} * (size_x + size_y - {most})"
    pairs = x.join(y, "token").where(f"sid_x < sid_y and comp_x <> comp_y and fam_x <> fam_y and again_x <> again_y and {_fits(percent)} and {early}")
    pairs = pairs.groupBy("sid_x", "sid_y").agg(
        F.count("*").alias("both"), F.min(F.least("shared_x", "shared_y")).alias("shared"),
        # what stands before the first shared token is not shared
        F.first("size_x").alias("size_x"), F.first("size_y").alias("size_y"), F.least(F.first("size_x") - F.min("pos_x"), F.first("size_y") - F.min("pos_y")).alias("most"),
    ).where(f"both >= shared and 100 * most >= {percent} * (size_x + size_y - most)")
    return pairs.select(F.col("sid_x").alias("b_x"), F.col("sid_y").alias("b_y"))


def set_links(docs: DataFrame, sets: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """Verified links (a, b) between different sets, enough for exact components, written.

    docs: doc, text; sets: doc, sid, size, head (written, and removed here).
    """
    reps = scratch.table(sets.where("size > 0").groupBy("sid").agg(F.min("doc").alias("doc")), "representatives")
    prefixes, order = adaptive_prefixes(docs, sets, reps, n, percent, lower)
    scratch.drop(sets)
    met = prefixes.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("token")
    rows = scratch.table(prefixes.join(met, "token").distinct(), "met-prefixes")
    scratch.drop(prefixes)
    check = lambda pairs, name, differences=False: _verify(pairs, docs, reps, n, percent, lower, order, name, differences)
    first = check(scratch.table(_star_by_prefix(rows, percent), "star-pairs"), "stars", True)
    second = check(scratch.table(_star_by_difference(first, percent), "star-pairs"), "second-stars", True)
    stars = first.unionByName(second)
    labels = scratch.table(graph.components(stars.where("pos < 0 and linked").select("a", "b")), "star-components").select(F.col("id").alias("sid"), F.col("component").alias("comp"))
    leads = [f.where("pos < 0 and near").select(F.col("b").alias("sid"), F.col("a").alias(c)) for f, c in ((first, "fam"), (second, "again"))]
    family = rows.join(labels, "sid", "left").join(leads[0], "sid", "left").join(leads[1], "sid", "left")
    family = scratch.table(family.withColumns({c: F.coalesce(c, "sid") for c in ("comp", "fam", "again")}), "family-prefixes")
    pairs = _pairs_by_prefix(family, percent)
    pairs = pairs.unionAll(_pairs_by_difference(first, leads[1].withColumnRenamed("sid", "b"), percent)).unionAll(_pairs_by_difference(second, None, percent))
    pairs = pairs.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(labels.select(F.col("sid").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left").withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side))
    known = stars.where("pos < 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.table(pairs.where("comp_a <> comp_b").select("a", "b").join(known, ["a", "b"], "left_anti"), "rest-pairs")
    rest = check(pairs, "rest-links")
    links = scratch.table(stars.unionByName(rest).where("pos < 0 and linked").select("a", "b"), "links")
    scratch.drop(rows, family, first, second, rest, labels, pairs, reps)
    order.destroy()
    return links


def _components(docs: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """docs: doc (unique), text.  Rows doc, size, component_id (a doc)."""
    heads = scratch.table(docs.mapInArrow(released(_emit_heads(n, percent, lower)), "doc bigint, sid bigint, size int, head array<bigint>"), "heads")
    sets = scratch.table(heads.select("doc", "sid", "size"), "sets")
    links = set_links(docs, heads, n, percent, lower)
    labels = graph.components(links).withColumnRenamed("id", "sid")
    full = sets.where("size > 0").join(labels, "sid", "left").select("doc", "size", F.coalesce("component", "sid").alias("key"))
    full = scratch.table(full, "keyed-sets")
    # written before it is joined, so that the join can split a component with a third of all rows
    least = scratch.table(full.groupBy("key").agg(F.min("doc").alias("component_id")), "least-ids")
    out = full.join(least, "key").select("doc", "size", "component_id")
    return out.unionByName(sets.where("size = 0").select("doc", "size", F.col("doc").alias("component_id")))


def jaccard_components(documents: DataFrame, n: int = 4, percent: int = 85, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links)."""
    runtime.ship(documents.sparkSession)
    rows, key, plain = keys.keyed(documents, id_col)
    out = _components(rows.select(F.col(key).alias("doc"), F.col(text_col).cast("string").alias("text")), n, percent, lower)
    if not plain:
        least = keys.named(out, rows, key, id_col).groupBy("component_id").agg(F.min(id_col).alias("least"))
        out = out.join(least, "component_id").select("doc", "size", F.col("least").alias("component_id"))
        out = keys.named(out, rows, key, id_col).withColumnRenamed(id_col, "doc")
    return out.select(F.col("doc").alias(id_col), F.col("size").cast("bigint").alias("n_shingles"), "component_id")


def keep_one(documents: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their component, with all their columns."""
    runtime.ship(documents.sparkSession)
    rows, key, _ = keys.keyed(documents, id_col)
    out = _components(rows.select(F.col(key).alias("doc"), F.col(text_col).cast("string").alias("text")), n, percent, lower)
    dropped = out.where("doc <> component_id").select(F.col("doc").alias(key))
    return rows.join(dropped, key, "left_anti").select(*documents.columns)
