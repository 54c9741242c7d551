"""Near duplicates, repeats and vectors against brute force, with odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import find, jaccard, repeats

from quillpanel.llm import embedding_dedup, graph, ngram_join, recompression

SCHEMA = "doc_id bigint, text string, lang string"


def corpus(seed=5):
    rng = random.Random(seed)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = []
    for i in range(80):
        x = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            x[rng.randrange(120)] = rng.choice(["q", f"z{i}"])
        rows.append((i, " ".join(x)))
    rows += [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 14])))) for i in range(80, 160)]
    passage = [str(rng.randrange(10**6)) for _ in range(60)]
    rows += [(i, " ".join([*(str(rng.randrange(10**6)) for _ in range(rng.choice([0, 3, 8, 20]))), *passage])) for i in range(160, 200)]
    return [*rows, (200, None), (201, ""), (202, " \n\t")]


@pytest.mark.parametrize("hot", [2, 24])
def test_components_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_DF", hot)
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in ngram_join.jaccard_components(frame).collect()}
    assert got == jaccard(rows, 4, 85)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    text = "one two three four five six seven"
    frame = spark.createDataFrame([(7, text, "a"), (7, text, "b"), (None, text, None), (3, "other words that stand alone here", None)], SCHEMA)
    got = sorted(map(tuple, ngram_join.jaccard_components(frame).collect()), key=str)
    assert got == [(3, 3, 3), (7, 4, 7), (7, 4, 7), (None, 4, 7)]
    assert ngram_join.keep_one(frame).count() == 2


def test_empty_tables_stay_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.jaccard_components(empty).count() == 0
    assert recompression.remove_repeats(empty).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def repeated_corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") if i % 3 else rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 34, 35, 36, 80, 300])))) for i in range(40)]
    base = [rng.choice("pqrstuvwxyz") for _ in range(400)]
    for i in range(40, 80):
        x = rng.randrange(300)
        rows.append((i, " ".join([f"z{rng.randrange(9)}" for _ in range(20)] + base[x : x + rng.randrange(30, 90)] + ["x"] * rng.choice([1, 40, 50]))))
    return [*rows, (80, None), (81, "a " * 200), (82, "ab cd " * 100), (83, "ab cd " * 20 + " cd ab" * 30), (84, "é " * 36)]


@pytest.mark.parametrize("width", [35, 5])
def test_repeats_equal_brute_force(spark, width):
    rows = repeated_corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in recompression.remove_repeats(frame, width=width, digest=True).collect()}
    assert got == repeats(rows, width)


def test_equal_windows_have_equal_anchors_on_any_text():
    rng = random.Random(1)
    import pyarrow as pa

    from quillpanel.llm.vectext import byte_names, chunks, words

    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 120))) for _ in range(30)]
    anchors: dict[tuple, set] = {}
    for _, _, data, offs in chunks(pa.array(texts)):
        s, e, w = words(data, offs)
        names = byte_names(data, s, e)
        for row, at, n, anchor, _ in zip(*recompression.territories(names, w, 9)):
            for k in range(n):
                i = w[row] + at + k
                anchors.setdefault(tuple(names[i : i + 9].tolist()), set()).add(int(anchor))
    assert anchors and all(len(a) == 1 for a in anchors.values())


def test_strip_keeps_clean_texts_columns_and_odd_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "own  words\nstay", "en", 1), (2, f"start {passage} end", "de", 2), (2, f"other {passage}", None, 3), (None, None, "x", 4)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, at string, mask int")
    got = {r.mask: r for r in recompression.strip_repeats(frame, width=50).collect()}
    assert got[1].text == "own  words\nstay" and got[2].text == "start end" and got[3].text == "other" and got[4].text is None
    assert got[2].at == "de" and frame.columns == list(got[1].asDict())


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6) + 8 * np.eye(6)[i % 3]], [0, 1, None][i % 3 if i % 7 else 0]) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [nan] * 6, 1), (203, [], 1), (204, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (205, [inf, *[0.0] * 5], 0), (206, [1.0, 2.0], 0), (207, [1.0, 2.0], 0)]
    return [*rows, *((208 + k, rows[3][1], rows[3][2]) for k in range(4))]


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_equal_brute_force(spark, block):
    rows = vectors()
    links, parent, good = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}, []
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v), label))
    for a, x, la in good:
        for b, y, lb in good:
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r[0]: tuple(r[1:]) for r in embedding_dedup.near_duplicates(frame, block=block).collect()}
    assert got == {i: (links[i], find(parent, i), find(parent, i) == i) for i, *_ in rows}


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 33))
    x /= np.sqrt((x * x).sum(1))[:, None]
    q, s, r = embedding_dedup.quantise(x)
    near = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(x @ x.T - near) <= r[:, None] + r[None] + np.outer(r, r)).all()


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
