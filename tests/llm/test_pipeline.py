"""The pipeline on a small corpus, stage by stage."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages_keep_columns_and_their_decisions_take_effect(spark, tmp_path):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    clean = [" ".join(word() for _ in range(80)) for _ in range(20)]
    texts = [*clean, clean[0], clean[1] + " extra", "short text", *(f"{' '.join(word() for _ in range(70))} {passage}" for _ in range(3)), f"{' '.join(word() for _ in range(30))} mail me@x.org now", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = out.cache()
        seen.append({r.doc_id: r for r in out.collect()})
        docs = out
    rules, near, passages, private, packed = seen
    assert set(rules) == set(range(27)) - {22}
    assert set(near) == set(rules) - {20, 21}
    assert all(passage not in passages[i].text and passages[i].n_chars == len(passages[i].text) for i in (23, 24, 25))
    assert all(passages[i].text == clean[i] for i in range(20))
    assert "me@x.org" not in private[26].text and "<email>" in private[26].text
    assert set(packed) == set(private)
