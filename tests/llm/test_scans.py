"""Spans, counts, scores, packing and sampling."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from brute import pii, secrets, text_counts

from quillpanel.llm import packing, pii_bootstrap, quality_qda, quality_rules, secret_scan, sp_gumbel, token_counts, wordbpe

SCHEMA = "doc_id bigint, text string"


def mixed(alphabet, n, seed=1, most=30):
    rng = random.Random(seed)
    return [(i, None if i % 97 == 0 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, most)))) for i in range(n)]


PII_PARTS = ["a@b.co", "@", ".", "-", " ", "1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (310) 555-1212", "é", "\n", "+", "12", "255.", "1.2.3.4", "300.1.1.1", "x_y%", "a", "(", ")", "😀", "1" * 30, "01"]
SECRET_PARTS = ["password", "PassWD", "secret", "token", "Api_Key", "apikey", " ", "=", ":", "'", '"', "abcdef12", "é", "\n", "AKIA", "AKIAABCDEFGH1234XY", "0123456789abcdef" * 2, "deadbeef", "x", ".", "-", "A", "  = "]


def test_base_pii_equals_plain_expressions(spark):
    rows = [*mixed(PII_PARTS, 1500), (9001, "1 " * 4000), (9002, "1." * 4000), (9003, "a" * 20000 + "@")]
    got = pii_bootstrap.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    assert [r for r in got if tuple(r)[1:6] != pii(texts[r[0]], pii_bootstrap.KINDS)] == []


def test_many_matches_cost_their_number(spark):
    import time

    took = {}
    for n in (500, 64_000):
        text = "12345678901234 x " * n
        frame = spark.createDataFrame([(1, text)], SCHEMA)
        began = time.time()
        assert pii_bootstrap.redact(frame).first().text == text  # no digits pass the check sum
        assert pii_bootstrap.extract(frame).first().n_card == 0
        took[n] = time.time() - began
    assert took[64_000] < took[500] + 15


def test_planted_identifiers_are_found_with_precision_and_recall(spark):
    rng = random.Random(4)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = [(i, f"word{i} call her office line +1 {number()} today") for i in range(200)]
    rows += [(1000 + i, f"word{i} call her office line {number()} today") for i in range(50)]
    rows += [(2000 + i, f"word{i} the serial number is {number()} here") for i in range(50)]
    rows += [(3000 + i, f"word{i} parts {number()} and {number()} sold") for i in range(50)]
    got = {r.doc_id: r.spans for r in pii_bootstrap.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = [i for i, spans in got.items() if i >= 1000 and spans]
    assert {i for i in found} == set(range(1000, 1050))


def test_contexts_discover_unseen_identifiers_and_redaction_replaces_them(spark):
    rows = [(i, f"please call our desk at +1 (310) 555-{1000 + i} now or mail to u{i}@x.org") for i in range(30)]
    rows += [(100 + i, f"please call our desk at 310-555-{1000 + i} now. mail to v{i}(at)x.org, the count 1234567 of") for i in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii_bootstrap.extract(frame).collect()}
    assert got[101].spans == "phone:24:36,email:50:61" and got[101].n_phone == 0
    texts = {r.doc_id: r.text for r in pii_bootstrap.redact(frame).collect()}
    assert texts[101] == "please call our desk at <phone> now. mail to <email>, the count 1234567 of"
    assert texts[3] == "please call our desk at <phone> now or mail to <email>"


def test_secrets_equal_plain_expressions(spark):
    rows = mixed(SECRET_PARTS, 2000)
    got = secret_scan.scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    texts = dict(rows)
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    assert [r for r in got if tuple(r)[1:5] != secrets(texts[r[0]], kinds)] == []


def test_long_runs_cost_their_length():
    import time

    scan = secret_scan.scanner(secret_scan.BASE_RULES + secret_scan.MORE_RULES)
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    for text in ["abcdef" * 180_000, "z" * 1_000_000, "token=secret:abcdefghijk " * 40_000, "a:" * 500_000, "ghp_" * 250_000, "password=" * 110_000]:
        began, data = time.time(), np.frombuffer(text.encode(), np.uint8)
        begin, end, met = scan.flagged(data, np.array([0, len(data)]))
        found = [(x + s, k, x + e) for x, y, m in zip(begin.tolist(), end.tolist(), met.tolist()) for s, k, e in scan.spans(data[x:y].tobytes(), m) if k < 3]
        assert time.time() - began < 2
        counts = secrets(text, kinds)[:3]
        assert tuple(sum(k == j for _, k, _ in found) for j in range(3)) == counts


def test_more_rules_add_spans_in_code_points(spark):
    token = "ghp_" + "a" * 36
    row = secret_scan.scan(spark.createDataFrame([(1, f"é {token}, ok"), (2, None)], SCHEMA)).orderBy("doc_id").collect()
    assert "github:2:42" in row[0].spans and row[1].spans == "" and row[1].n_hex == 0


@pytest.mark.parametrize("pattern", ["a(b|c)*d{2,3}", "[^a-c]+x?", "(?:ab|a)(?:c|bcd)", r"\x41+\.", "a{3,}b"])
def test_automata_accept_what_expressions_match(pattern):
    import re

    rng = random.Random(0)
    dfa = secret_scan.compile_rules([pattern], search=False)
    for _ in range(400):
        text = "".join(rng.choice("abcdxA.") for _ in range(rng.randrange(0, 8)))
        state = 0
        for byte in text.encode():
            state = dfa.table[state][dfa.classes[byte]]
        assert bool(dfa.accepts[state]) == bool(re.fullmatch(pattern, text)), text


def test_text_counts_and_base_rules(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 50 == 0 else "".join(rng.choice(["ab", "c", " ", " ", "\n", "#", "é", "ab c ab c ab\n", "\r", "|"]) for _ in range(rng.randrange(0, 60)))) for i in range(600)]
    frame = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in rows], SCHEMA + ", lang string")
    got = quality_rules.judge(frame, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    texts = dict(rows)
    for r in got:
        n, *rest = text_counts(texts[r.doc_id])
        failed = n < 10 or 100 * rest[3] > 20 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (n, *rest, failed, not failed)
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in quality_rules.keep_good(frame, spark.createDataFrame([], "doc_id bigint, quality int")).collect()} == kept


def test_cutoffs_have_exact_binomial_bounds():
    assert quality_rules.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality_rules.binomial_tail(2, 20, 0.3) == pytest.approx(sum(math.comb(20, k) * 0.3**k * 0.7 ** (20 - k) for k in range(3)))
    assert quality_rules.binomial_tail(498_000, 10**8, 0.005) == pytest.approx(0.5 * math.erfc(1999.5 / math.sqrt(2 * 10**8 * 0.005 * 0.995)), rel=0.05)
    for n, p in ((50, 0.02), (400, 0.3), (1000, 0.999)):
        for k in range(0, n, max(1, n // 17)):
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9, abs=1e-200)
    cuts = {rule: len(c) for rule, (_, c) in quality_rules.RULES.items()}
    chosen = quality_rules.choose({rule: [0] * (n - 1) + [500] for rule, n in cuts.items()}, 5000, 2, 0.02, 0.05)
    assert all(chosen[rule] == quality_rules.RULES[rule][1][-2] for rule in cuts)
    assert quality_rules.choose({rule: [0] * n for rule, n in cuts.items()}, 20, 2, 0.02, 0.05) == {}


def test_rules_reject_junk_and_keep_good(spark):
    rng = random.Random(0)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows = [(i, good(), "en") for i in range(2500)] + [(i, " ".join(w + "###" for w in good().split()), "en") for i in range(2500, 2600)]
    labels = spark.createDataFrame([(i, 1) for i in range(2500)], "doc_id bigint, quality int")
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA + ", lang string"), labels).collect()
    assert all(r.kept == (r.doc_id < 2500) for r in got)


def test_discriminant_separates_and_scores_every_text(spark):
    rng = random.Random(0)
    make = lambda bad: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + (rng.choice(["!!", "###", ""]) if bad else "") for _ in range(rng.randrange(20, 80)))
    rows = [(i, make(i % 3 == 0), "en") for i in range(600)] + [(600, None, None), (601, "", None)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(600)] + [(5, None)], "doc_id bigint, quality int")
    got = quality_qda.classify(spark.createDataFrame(rows, SCHEMA + ", lang string"), labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    none = quality_qda.classify(spark.createDataFrame(rows[:3], SCHEMA + ", lang string"), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


TEXTS = ["Hello WORLD's  x", "aé́b  x. y,", "", None, "I'll goΣ AΣ. 12345 ##!!", "DON'T. stop,", "ﬁ. Ⅷ, 漢字.", "word, word. Word"]


def test_word_coder_equals_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillpanel.llm.vectext import chunks

    rng = random.Random(0)
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndofText|>", "don't", "'s", ".", ",", "I'll,", "İstanbul", "ñ", "ño.", "É.", "a.,", "1.", "2,", "ab.", "ΑΣ.", "Å", " ", "\n"]
    texts = [*TEXTS, *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(12)) for _ in range(500))]
    coder, plain = wordbpe.coder(wordbpe.default_path()), Tokenizer.from_file(wordbpe.default_path())
    for a, b, data, offs in chunks(pa.array(texts)):
        ids, at = coder.encode(data, offs)
        for i in range(b - a):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(texts[a + i] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, None: 2, "c": 1}])
def test_packing_is_whole_gapless_and_mixed(spark, weights):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(wordbpe.default_path())
    rows = [(i, (TEXTS[i % len(TEXTS)] or "") * (i % 9) or TEXTS[i % len(TEXTS)], ["a", None, "b", "c"][i % 4]) for i in range(160)]
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    got = packing.pack(spark.createDataFrame(rows, SCHEMA + ", source string").repartition(3), length=128, weights=weights).collect()
    docs, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(docs) == set(ids) and sorted(windows) == list(range(len(windows)))
    for i, parts in docs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            at += r.length
            assert zlib.crc32(np.array(ids[i][r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(ids[i])
    for k, parts in windows.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 128 or k == max(windows)
    source, total, done = {i: s for i, _, s in rows}, collections.Counter(), collections.Counter()
    for i, t in ids.items():
        total[source[i]] += len(t)
    share = weights or {s: n**0.5 for s, n in total.items()}
    longest = max(map(len, ids.values()))
    for k in sorted(windows):
        for r in sorted(windows[k], key=lambda r: r.offset):
            done[source[r.doc_id]] += r.length
        live = {s: done[s] / share[s] for s in total if done[s] < total[s]}
        if len(live) == len(total):
            # every queue has its target proportion within one document and one turn
            packed, whole = sum(done.values()), sum(share.values())
            assert all(abs(done[s] - packed * share[s] / whole) <= 2 * longest + 128 for s in total)
    assert len(got) <= 1.1 * len(ids) + len(windows)


def test_packed_ids_come_with_null_and_repeated_ids(spark):
    rows = [(1, "one two", "a"), (1, "three", "a"), (None, "four five six", None), (2, None, "b"), (3, "<|ENDOFTEXT|> x", "b")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA + ", source string"), length=4, keep_ids=True).collect()
    whole = [i for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) for i in r.ids]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(wordbpe.default_path())
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in rows]
    assert sorted(whole) == sorted(i for w in want for i in w) and all(len(r.ids) == r.length for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got) and sum(r.doc_id is None for r in got) >= 1
    assert packing.pack(spark.createDataFrame([], SCHEMA + ", source string")).count() == 0


def test_histogram_answers_totals_quantiles_and_limits(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(wordbpe.default_path())
    rows = [(i, (TEXTS[i % len(TEXTS)] or "") * (i % 5), ["x", None][i % 2]) for i in range(90)]
    size = {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t, _ in rows}
    hist = token_counts.histogram(spark.createDataFrame(rows, SCHEMA + ", lang string")).cache()
    for g in ("x", None):
        own = sorted(size[i] for i, _, lang in rows if lang == g)
        for r in [r for r in hist.collect() if r.lang == g]:
            assert r.n_docs == own.count(r.n_tokens) and r.docs_ge == sum(x >= r.n_tokens for x in own) and r.tokens_ge == sum(x for x in own if x >= r.n_tokens)
            assert r.truncated_total == sum(min(x, r.n_tokens) for x in own) and r.group_tokens == sum(own) and r.group_docs == len(own)
        cut = {r.lang: r.tokens for r in token_counts.truncated_total(hist, 7).collect()}
        assert cut[g] == sum(min(x, 7) for x in own)
        half = {r.lang: r.q0 for r in token_counts.quantiles(hist, [0.5]).collect()}
        assert half[g] == own[math.ceil(len(own) / 2) - 1]


def segmentations(m, unit):
    """Every segmentation of one unit with its log-probability, by enumeration."""
    full = [[((), 0.0)]]
    for at in range(1, len(unit) + 1):
        full.append([(h + (m.pieces[unit[f:at]][0],), lp + m.pieces[unit[f:at]][1]) for f in range(at) if unit[f:at] in m.pieces for h, lp in full[f]])
    whole = math.log(math.fsum(math.exp(lp) for _, lp in full[-1]))
    return {ids: lp - whole for ids, lp in full[-1]}


def test_segmentations_are_distinct_and_decode_alike():
    m = sp_gumbel.model(sp_gumbel.default_path(), 1.0)
    for text in ["Hello world  foo", "é😀 x\ny", "a", "", "  lead", None, "tab\tx", " " * 9, " " * 15, "a" * 3000, "\ue000\ue001"]:
        ((plain, got),) = m.sample([text], [sp_gumbel.row_seed(1, text)], 3)
        want = m.sp.decode(m.sp.encode(text or ""))
        assert len({tuple(ids) for ids, *_ in got}) == len(got) >= 1 and sp_gumbel.shown(plain) == want
        assert all(m.decode(ids.tolist()) == want == m.sp.decode(ids.tolist()) and 0 <= s <= 1 for ids, _, s in got)


@pytest.mark.parametrize("text", ["abcd efgh", " " * 9, "nation"])
def test_all_segmentations_come_when_asked_for(text):
    m = sp_gumbel.model(sp_gumbel.default_path(), 1.0)
    units = re.findall(f"{sp_gumbel.MARK}*[^{sp_gumbel.MARK}]+|{sp_gumbel.MARK}+", m.sp.normalize(text))
    want = {(): 0.0}
    for u in units:
        want = {h + ids: x + y for h, x in want.items() for ids, y in segmentations(m, u).items()}
    ((_, got),) = m.sample([text], [3], len(want) + 5)
    found = {tuple(ids.tolist()): lp for ids, lp, _ in got}
    assert len(got) == len(found) == len(want) and all(s == 1 for *_, s in got)
    assert all(found[ids] == pytest.approx(lp) for ids, lp in want.items())


def test_draws_follow_p_and_inclusion_scores_are_unbiased():
    m = sp_gumbel.model(sp_gumbel.default_path(), 1.0)
    p = {ids: math.exp(lp) for ids, lp in segmentations(m, sp_gumbel.MARK + "abc").items()}
    n, pairs, weight = 8000, collections.Counter(), collections.Counter()
    for _, got in m.sample(["abc"] * n, [sp_gumbel.row_seed(1, i) for i in range(n)], 2):
        pairs[tuple(tuple(ids.tolist()) for ids, *_ in got)] += 1
        for ids, _, s in got:
            weight[tuple(ids.tolist())] += 1 / s
    top = sorted(p, key=p.get)[-3:]
    for a in top:
        assert weight[a] / n == pytest.approx(1, abs=0.25)
        for b in top:
            if a != b:
                assert pairs[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.02)


def test_full_memory_keeps_the_lattices_met_most_and_the_draws(monkeypatch):
    texts = [f"some words here {'ab' * (i % 7)}q{i}x{i * i}" for i in range(300)]
    seeds = [sp_gumbel.row_seed(1, i) for i in range(len(texts))]
    learned = []
    got = {}
    for most in (sp_gumbel.REMEMBER, 400):
        monkeypatch.setattr(sp_gumbel, "REMEMBER", most)
        monkeypatch.setattr(sp_gumbel, "KEEP", most // 2, raising=False)
        m = sp_gumbel.Model(sp_gumbel.default_path(), 1.0)
        learn = m._learn
        m._learn = lambda cps, begin, size, learn=learn: (learned.extend("".join(map(chr, cps[b : b + n])) for b, n in zip(begin, size)), learn(cps, begin, size))
        learned.clear()
        got[most] = [[(ids.tolist(), lp, s) for ids, lp, s in found] for i in range(0, len(texts), 5) for _, found in m.sample(texts[i : i + 5], seeds[i : i + 5], 2)]
        assert all(learned.count(sp_gumbel.MARK + w) == 1 for w in ("some", "words", "here"))
        assert m.used < most + 5 * 400
    first, second = got.values()
    assert first == second


def test_sampling_rows_is_seeded_by_key(spark):
    rows = spark.createDataFrame([(1, 0, "some words here"), (2, None, "some words here"), (3, 1, None)], "conv_id bigint, turn bigint, text string")
    run = lambda: sorted(map(tuple, sp_gumbel.sample(rows, ["conv_id", "turn"], k=2, with_ids=False).collect()), key=str)
    once = run()
    assert once == run() and (3, 1, 1, 0, 0, 0.0, 1.0, 0, True) in once
    back = sp_gumbel.decode(sp_gumbel.sample(rows, ["conv_id", "turn"])).collect()
    assert {r.decoded for r in back if r.conv_id < 3} == {"some words here"}


def test_sampling_query_segments_documents_and_decodes_them(spark):
    from quillpanel.llm import queries

    got = queries.op6_sentencepiece_sampling(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    m = sp_gumbel.model(sp_gumbel.default_path(), 1.0)
    assert {r.doc_id for r in got} == set(texts) and all(r.round_trip for r in got)
    assert all(zlib.crc32(m.sp.decode(m.sp.encode(texts[r.doc_id] or "")).encode()) == r.decoded_crc32 == zlib.crc32(m.sp.decode(list(r.ids)).encode()) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_long_numbers_become_phones_or_cards_by_their_context(spark):
    rows = [(i, f"please call our desk at +1 (310) 555-{1000 + i} now") for i in range(30)]
    rows += [(100, "please call our desk at 0044 20 7946 0958 now"), (101, "the stock number 0044 20 7946 0958 is")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii_bootstrap.extract(frame).collect()}
    assert got[100].spans == "phone:24:41" and got[101].spans == ""
    texts = {r.doc_id: r.text for r in pii_bootstrap.redact(frame).collect()}
    assert texts[100] == "please call our desk at <phone> now"


def test_contexts_of_discovered_identifiers_become_patterns(spark):
    rows = [(i, f"please call our desk at +1 (310) 555-{1000 + i} now") for i in range(600)]
    rows += [(1000 + i, f"please call our desk at 310-555-{2000 + i} now") for i in range(30)]
    rows += [(2000 + i, f"or try the hotline under 310-555-{2000 + i} now") for i in range(30)]
    rows += [(3000, "or try the hotline under 310-555-3000 now"), (3001, "or try the hotel room 310-555-3001 now")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3000] == "phone:25:37" and got[2000] == "phone:25:37" and got[3001] == ""
