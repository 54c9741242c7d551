"""Operator 7: personal data by bootstrapped contextual extraction (DataFrame operations only).

Base extraction finds e-mail addresses, IPv4 addresses, card numbers (Luhn) and
telephone numbers by fixed expressions.  These *seeds* induce lexical patterns,
and patterns find identifiers whose form alone proves nothing (numbers without
a country code, addresses written with "(at)", card numbers with a wrong digit):

* every seed and every *candidate* (a token of compatible shape that no base
  span covers) is an occurrence with two lexical patterns, the last word and the
  last two words between the match before it and itself;
* patterns and instances (kind, value) form a bipartite graph that Spark scores
  in rounds: a pattern's score for a kind is the smoothed share of its
  occurrences held by instances of that kind, weighted by their scores; an
  instance's score is the mean score of its patterns.  Seeds stay at 1;
* a pattern counts for a kind in rounds in which ``support`` distinct instances
  next to it are seeds or scored at least ``confidence`` in the round before;
  an instance's mean is taken over the patterns that count;
* a candidate whose best pattern scores at least ``confidence`` is reported under
  the pattern's kind.  A number that can be a card and a telephone number is a
  candidate of both kinds and one occurrence of its patterns.

Only occurrences are shuffled, never texts.  A text's matches leave it as rows
with their distance from the match before; window sums make positions of the
distances, so a text with many matches costs their number.  Counts are partial
before the shuffle, so a word before a third of all numbers costs one row per
task.

Expressions are written with possessive loops and look-behind, and ask for the
digits that a match needs, so that long runs cost linear time and no recursion
and ordinary numbers are no matches; they find the same passing matches as the
plain forms named in their comments.

Cases: null and empty texts have no spans; offsets are code points, end
exclusive; very long texts cost their length; repeated rows get equal results;
null or repeated ids are handled row by row; ties are ordered by start, then
kind; an empty table gives an empty result; other columns, whatever their names,
are ignored (``redact`` passes them on).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from . import keys, scratch

KINDS = ("email", "ip", "card", "phone")
#: Texts without any of these have no span.
MAY = r"[0-9@]|\(at\)|\[at\]"
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> expression.  Fixed values; plain forms: local@label(.label)+, n(.n)(.n)(.n), d([ -]?d)+, +d[ ().0-9-]+d
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Shapes that a context can turn into an identifier; a number that runs into a letter is none.
_NUMBER = r"(?<![A-Za-z0-9+.-])\(?[0-9](?:(?:[) .-]{1,2}\(?)?[0-9]){6,}+[A-Za-z]?+"
_ADDRESS = rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+"
#: Digits of numbers that can be cards and telephone numbers.
BOTH = (12, 15)
#: White space that separates words, and as many blanks.
_GAPS = "\t\n\x0b\f\r"


def _matches(text: Column, pattern: str) -> Column:
    """Matches as array<struct<gap, m, words>>: code points since the match before, the match, the last two words between."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(m))

    def one(piece: Column, x: Column) -> Column:
        tail = F.substring_index(F.rtrim(F.translate(piece, _GAPS, " " * len(_GAPS))), " ", -2)
        return F.struct(F.length(piece).alias("gap"), x.alias("m"), F.filter(F.split(F.lower(tail), " "), lambda w: w != "").alias("words"))

    return F.zip_with(pieces, m, one)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(d))

    def value(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_RAW = "array<struct<gap: int, m: string, words: array<string>>>"
#: The expressions in order: those of the kinds, then the candidates' shapes.
_ALL = (*BASE.values(), _ADDRESS, _NUMBER)


def _guarded(text: Column, i: int) -> Column:
    """Matches of expression i where the text can have one."""
    guards = {0: ("@",), 3: ("+",), 4: ("@", "(at)", "[at]")}
    can = reduce(or_, (F.contains(text, F.lit(g)) for g in guards[i])) if i in guards else text.rlike("[0-9]")
    return F.when(can, _matches(text, _ALL[i])).otherwise(F.expr(f"cast(array() as {_RAW})"))


def _ranks(expression: Column, m: Column) -> Column:
    """The kinds (as places in KINDS) that a match stands for, or can."""
    ranks = lambda *r: F.array(*map(F.lit, r)).cast("array<int>")
    size = F.length(_digits(m))
    number = F.when(m.rlike("[A-Za-z]$"), ranks()).when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), ranks(1))
    number = number.when(size.between(*BOTH), ranks(2, 3)).when(size.between(12, 19), ranks(2)).when(size.between(7, 15), ranks(3)).otherwise(ranks())
    out = F.when(expression == 4, ranks(0)).when(expression == 5, number)
    for i, kind in enumerate(KINDS):
        out = out.when((expression == i) & _passes(kind, m), ranks(i))
    return F.coalesce(out, ranks())


def occurrences(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, s, e, rank, value, words, seed): base spans (seed) and candidates that no base span touches, written."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text")).where(F.col("text").rlike(MAY))
    kinds = F.array(*(F.struct(F.lit(i).alias("x"), _guarded(F.col("text"), i).alias("found")) for i in range(len(_ALL))))
    rows = rows.select("doc", F.explode(F.filter(kinds, lambda k: F.size(k["found"]) > 0)).alias("k"))
    rows = rows.select("doc", "k.x", F.posexplode("k.found").alias("i", "y")).select("doc", "x", "i", "y.gap", "y.m", "y.words")
    before = Window.partitionBy("doc", "x").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.sum(F.col("gap") + F.length("m")).over(before).cast("int"))
    rows = rows.select("doc", (F.col("e") - F.length("m")).alias("s"), "e", "m", "words", (F.col("x") < len(KINDS)).alias("seed"), F.explode(_ranks(F.col("x"), F.col("m"))).alias("rank"))
    so_far = lambda order: Window.partitionBy("doc").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reach", F.max(F.when(F.col("seed"), F.col("e"))).over(so_far(F.col("s").asc())))
    rows = rows.withColumn("next", F.min(F.when(F.col("seed"), F.col("s"))).over(so_far(F.col("s").desc())))
    free = F.coalesce(F.col("reach") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("e"), F.lit(True))
    return scratch.table(rows.where(F.col("seed") | free).select("doc", "s", "e", "rank", F.col("m").alias("value"), "words", "seed"), "occurrences")


def _label(x: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    return F.concat_ws(":", kind, x["s"].cast("string"), x["e"].cast("string"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), _label), ",")


def discover(found: DataFrame, rounds: int, support: int, confidence: float) -> tuple[DataFrame, list[DataFrame]]:
    """((doc, s, e, rank) of candidates that high-confidence patterns report, the tables to remove once it is written)."""
    again = ~F.col("seed") & (F.col("rank") == 3) & F.length(_digits(F.col("value"))).between(*BOTH)
    pattern = F.explode(F.array_distinct(F.array(F.element_at("words", -1), F.concat(F.lit("2 "), F.array_join("words", " ")))))
    every = found.where("size(words) > 0").select("doc", "s", "e", "rank", "value", "seed", again.alias("again"), pattern.alias("pattern"))
    # one row per edge of the pattern-instance graph
    edges = every.groupBy("pattern", "rank", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"), F.count_if(~F.col("again")).alias("own"))
    # patterns with fewer values than the support can never be backed
    able = edges.groupBy("pattern", "rank").agg(F.count("*").alias("values")).where(F.col("values") >= support).select("pattern").distinct()
    edges = scratch.table(edges.join(able, "pattern"), "pattern-edges")
    totals = edges.groupBy("pattern").agg(F.sum("own").alias("total"))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    patterns, used = None, [edges]
    for _ in range(rounds):
        mass = scored.groupBy("pattern", "rank").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_if(F.col("score") >= confidence).alias("backing"))
        patterns = mass.where(F.col("backing") >= support).join(totals, "pattern").select("pattern", "rank", (F.col("mass") / (F.col("total") + 1.0)).alias("trust"))
        patterns = scratch.table(patterns, "pattern-scores")
        trusts = patterns.groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("rank", "trust"))).alias("trusts"))
        values = edges.join(trusts, "pattern").groupBy("rank", "value").agg(F.avg(F.coalesce(F.try_element_at("trusts", F.col("rank")), F.lit(0.0))).alias("mean"))
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("score")
        scored = scratch.table(edges.join(values, ["rank", "value"], "left").select("pattern", "rank", "value", "n", score), "instance-scores")
        used += [patterns, scored]
    sure = patterns.where(F.col("trust") >= confidence)
    best = F.max_by("rank", F.struct("trust", -F.col("rank"))).alias("rank")
    return every.where("not seed").join(sure, ["pattern", "rank"]).groupBy("doc", "s", "e").agg(best), used


def _spans(documents: DataFrame, rounds: int, support: int, confidence: float, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, s, rank, e, seed), base spans and discovered ones, written."""
    found = occurrences(documents, id_col, text_col)
    more, used = discover(found, rounds, support, confidence)
    more = more.select("doc", "s", "rank", "e", F.lit(False).alias("seed"))
    out = scratch.table(found.where("seed").select("doc", "s", "rank", "e", "seed").unionByName(more), "spans")
    scratch.drop(found, *used)
    return out


def extract(documents: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    runtime.ship(documents.sparkSession)
    documents, key, plain = keys.keyed(documents, id_col)
    spans = _spans(documents, rounds, support, confidence, key, text_col)
    none = F.expr("cast(array() as array<struct<s: int, rank: int, e: int>>)")
    listed = [F.coalesce(F.collect_list(F.when(c, F.struct("s", "rank", "e"))), none).alias(n) for n, c in (("base", F.col("seed")), ("every", F.lit(True)))]
    rows = documents.select(F.col(key).alias("doc")).join(spans.groupBy("doc").agg(*listed), "doc", "left").withColumns({c: F.coalesce(c, none) for c in ("base", "every")})
    if not plain:
        rows = keys.named(rows, documents, key, id_col).withColumnRenamed(id_col, "doc")
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return rows.select(F.col("doc").alias(id_col), *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))


def redact(documents: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in angle brackets.

    Texts in which nothing can be found pass without a shuffle.
    """
    runtime.ship(documents.sparkSession)
    documents, key, _ = keys.keyed(documents, id_col)
    columns = [c for c in documents.columns if c != key]
    spans = _spans(documents, rounds, support, confidence, key, text_col)
    order = Window.partitionBy("doc").orderBy("s", "rank", "e")
    # spans that overlap are one region, named by the first of them
    regions = spans.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    regions = regions.withColumn("region", F.sum(F.when(F.col("reach") > F.col("s"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    regions = regions.groupBy("doc", "region").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("rank", F.struct("s", "rank")).alias("rank"))
    last = F.coalesce(F.lag("e").over(Window.partitionBy("doc").orderBy("region")), F.lit(0))
    own, at = keys.fresh(columns, "_doc"), keys.fresh(columns, "_regions")
    listed = F.array_sort(F.collect_list(F.struct("s", "e", "rank", "last"))).alias(at)
    regions = regions.withColumn("last", last).groupBy(F.col("doc").alias(own)).agg(listed)
    may = F.coalesce(F.col(text_col).rlike(MAY), F.lit(False))
    changed = documents.where(may).join(regions, F.col(key) == F.col(own), "left")
    # a text with spans becomes its characters once, so that cutting costs its length
    letters = keys.fresh([*columns, own, at], "_letters")
    changed = changed.withColumn(letters, F.when(F.col(own).isNotNull(), F.split(text_col, "")))
    tag = lambda x: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1), F.lit(">"))
    parts = F.transform(at, lambda x: F.concat(F.array_join(F.slice(letters, x["last"] + 1, x["s"] - x["last"]), ""), tag(x)))
    end = F.element_at(at, -1)["e"]
    whole = F.concat(F.array_join(parts, ""), F.array_join(F.slice(letters, end + 1, F.size(letters)), ""))
    changed = changed.withColumn(text_col, F.when(F.col(own).isNull(), F.col(text_col)).otherwise(whole)).select(*columns)
    return documents.where(~may).select(*columns).unionByName(changed)
