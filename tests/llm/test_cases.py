"""Odd rows in every operator and stage: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from brute import PII, jaccard, luhn, repeats, text_counts, words
from pyspark.sql import functions as F

from quillpanel.llm import embedding_dedup, ngram_join, packing, pii_bootstrap, quality_qda, quality_rules, recompression, secret_scan, sp_gumbel, token_counts, wordbpe

CLASH = ["doc", "sid", "part", "at", "mask", "n", "_doc", "_KEY", "_regions", "_letters", "_cuts", "_stratum", "s", "e", "rank", "rest", "ids", "k0", "head", "size", "component_id", "spans"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = " ".join(f"w{i * 7919 % 60013}" for i in range(20_000))
TEXTS = ["plain words that stand here alone and nothing else at all ok", "call +1 (310) 555-1234 or mail me@x.org, password = hunter2hunter2 and more words", "", " \n\t", None, LONG]


def odd(spark, empty=False):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (None, TEXTS[1]), (None, None), (7, TEXTS[0])]
    full = [(i, t, "en" if i else None, None if i == 2 else "a", len(t or ""), *CLASH) for i, t in rows]
    return spark.createDataFrame([] if empty else full, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (7, 1)], "doc_id bigint, quality int")


PER_ROW = {
    "join": lambda d, s: ngram_join.jaccard_components(d),
    "quality": lambda d, s: quality_qda.classify(d, labels(s)),
    "repeats": lambda d, s: recompression.remove_repeats(d, width=10, digest=True),
    "pii": lambda d, s: pii_bootstrap.extract(d),
    "rules": lambda d, s: quality_rules.judge(d, labels(s)),
    "secrets": lambda d, s: secret_scan.scan(d),
}
PASSING = {
    "keep_one": lambda d, s: ngram_join.keep_one(d),
    "strip": lambda d, s: recompression.strip_repeats(d, width=10),
    "redact": lambda d, s: pii_bootstrap.redact(d),
    "keep_good": lambda d, s: quality_rules.keep_good(d, labels(s)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(spark, name):
    got = PER_ROW[name](odd(spark), spark).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd(spark).collect())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(tuple(r)[1:] if name != "quality" else (r.score, r.predicted))
    assert len(by_id[1]) == 1  # repeated rows
    assert PER_ROW[name](odd(spark, True), spark).count() == 0


@pytest.mark.parametrize("name", PASSING)
def test_passing_operators_keep_columns_and_rows(spark, name):
    frame = odd(spark)
    got = PASSING[name](frame, spark)
    assert got.columns == frame.columns
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in CLASH)
    texts = {r.doc_id: r.text for r in rows}
    if name == "keep_one":
        assert len(rows) == 7 and sum(r.doc_id is None for r in rows) <= 1 + 1 and texts[4] is None
    elif name == "strip":
        assert len(rows) == frame.count() and texts[5] == LONG and texts[0] == "" and texts[4] is None and texts[3] == " \n\t"
    elif name == "redact":
        assert len(rows) == frame.count() and texts[1].startswith("call <phone> or mail <email>, password") and texts[5] == LONG and texts[4] is None
    else:
        assert sorted(map(str, texts)) == ["0", "1", "5", "7", "None"]
    empty = PASSING[name](odd(spark, True), spark)
    assert empty.columns == frame.columns and empty.count() == 0


def test_packing_counting_and_sampling(spark):
    frame = odd(spark)
    packed = packing.pack(frame, length=256).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and sum(r.start == 0 for r in packed) == frame.count()
    assert packing.pack(odd(spark, True)).count() == 0
    counts = token_counts.report(frame, limits=(5,)).collect()
    assert sum(r.n_docs for r in counts) == frame.count() and {r.lang for r in counts} == {"en", None}
    assert all(r.cut_5 == sum(min(x.n_tokens, 5) * x.n_docs for x in counts if x.lang == r.lang) for r in counts)
    assert token_counts.report(odd(spark, True)).count() == 0
    sampled = sp_gumbel.sample(frame, ["doc_id"], k=2, with_ids=False).collect()
    assert all(r.round_trip for r in sampled) and sum(r["rank"] == 1 for r in sampled) == frame.count()
    assert sp_gumbel.sample(odd(spark, True), ["doc_id"]).count() == 0


def test_vectors_with_odd_rows(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1e200, 1e200], 1), (4, [2e200, 2e200], 1), (1, [0.0, 1.0], 2), (None, [0.0, 2.0], 2), (None, None, None)]
    frame = spark.createDataFrame([(*r, *CLASH) for r in rows], "vec_id bigint, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in CLASH))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (None, 0, None), (None, 1, 1)]


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return [(a, b)[x] for x in bits[:n]]


def test_self_similar_words_lines_and_windows_keep_their_names(spark):
    rows = []
    for n in (1024, 2048, 4096):
        x, y = "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))
        rows += [x, y, f"{x}\n{y}\n{x}", " ".join(thue_morse(n, "p", "q")), " ".join(thue_morse(n, "q", "p"))]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
    assert {r[0]: tuple(r[1:]) for r in ngram_join.jaccard_components(frame).collect()} == jaccard(rows, 4, 85)
    assert {r[0]: tuple(r[1:]) for r in recompression.remove_repeats(frame, width=35, digest=True).collect()} == repeats(rows, 35)
    for r in quality_rules.judge(frame, labels(spark).where("false")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == text_counts(dict(rows)[r.doc_id])


def test_families_within_families_equal_brute_force(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    banner = [f"n{i}" for i in range(40)]
    rows = []
    for i in range(260):
        x = list(base) + (banner if i % 3 == 0 else [])
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 8, 10])):
            j = rng.randrange(len(x))
            if i % 5 == 0:
                del x[j]
            elif i % 5 == 1:
                x.insert(j, f"z{rng.randrange(5)}")
            else:
                x[j] = f"z{i}" if rng.random() < 0.7 else "same"
        if i % 7 == 0:
            x = x[: rng.randrange(90, len(x))]
        rows.append((i, " ".join(x)))
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, lang string").repartition(4)
    got = {r[0]: tuple(r[1:]) for r in ngram_join.jaccard_components(frame).collect()}
    assert got == jaccard(rows, 4, 85)


def test_scores_equal_an_independent_gaussian_density(spark):
    rng = random.Random(1)
    make = lambda bad: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + (rng.choice(["!!", "###", ""]) if bad else "") for _ in range(rng.randrange(20, 80)))
    rows = [(i, make(i % 3 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality_qda.classify(frame, marks).collect()}
    import pyarrow as pa

    from quillpanel.llm import textstats
    from quillpanel.llm.vectext import chunks

    x = np.concatenate([quality_qda.vectors(textstats.counts(d, o, more=True)) for _, _, d, o in chunks(pa.array([t for _, t in rows]))])
    train = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows])
    y = np.array([int(i % 3 != 0) for i, _ in rows])
    own = [x[train & (y == k)] for k in (0, 1)]
    covs = [np.cov(z.T, bias=True) for z in own]
    pooled = sum(len(z) * c for z, c in zip(own, covs)) / sum(map(len, own))
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    logs = []
    for z, c in zip(own, covs):
        a = max(0.05, quality_qda.D / (len(z) + quality_qda.D))
        sigma = (1 - a) * c + a * 0.5 * (pooled + scale) + 1e-4 * scale
        diff = x - z.mean(0)
        logs.append(np.log(len(z)) - 0.5 * np.linalg.slogdet(sigma)[1] - 0.5 * np.einsum("ij,ij->i", diff, np.linalg.solve(sigma, diff.T).T))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert all(got[i] == pytest.approx(want[i], rel=1e-5, abs=1e-12) for i, _ in rows)


def redacted(text):
    """Base spans, overlapping ones as one region named by the first."""
    spans = []
    for k, p in enumerate(PII):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(v) <= 255 for v in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]:
                spans.append((m.start(), k, m.end()))
    out, at = "", 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += text[at:s] + f"<{pii_bootstrap.KINDS[k]}>"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_equals_a_chain_of_plain_versions(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(rng.randrange(5, 120))) for _ in range(60)]
    texts += [" ".join(w if rng.random() > 0.02 else word() for w in texts[i].split()) for i in range(30)]
    texts += [f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(rng.randrange(9)))}" for _ in range(8)]
    texts += [f"{' '.join(word() for _ in range(20))} a{i}@b.org 4111 1111 1111 1111 +1 (310) 555-12{i:02} 1.2.3.{i}" for i in range(9)] + [texts[3], "", None, "ab cd ef " * 30]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(i, t) for i, t in rows if (c := text_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    group = jaccard(kept, 5, 80)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    lost = repeats(kept, 50)
    seen = {}
    for i, t in kept:
        w = words(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    gone = {(i, k + j) for found in seen.values() if len(found) > 1 for i, k in found for j in range(50)}
    kept = [(i, " ".join(w for k, w in enumerate(words(t)) if (i, k) not in gone) if lost[i][1] else t) for i, t in kept]
    want = {i: redacted(t) for i, t in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(wordbpe.default_path())
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    assert {r.doc_id for r in got} == set(ids) and any("<card>" in t for t in want.values()) and any(n for _, n, _ in lost.values())
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    labels(spark).withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:  # their operators take the odd rows above
        out = stage(spark, odd(spark, True), str(tmp_path))
        assert out.columns == odd(spark, True).columns and out.count() == 0
    assert corpus_pipeline.passages(spark, odd(spark), str(tmp_path)).count() == odd(spark).count()
    assert corpus_pipeline.packed(spark, odd(spark), str(tmp_path)).count() >= odd(spark).count()
    assert corpus_pipeline.packed(spark, odd(spark, True), str(tmp_path)).count() == 0
