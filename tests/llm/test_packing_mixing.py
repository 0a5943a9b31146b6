from __future__ import annotations

import random
from collections import Counter

import pytest

from quarrylight.llm import mixing, packing
from quarrylight.llm.tokens import TOKENIZER, token_sizes

tokenizers = pytest.importorskip("tokenizers")
JSON = TOKENIZER.replace(".tiktoken", ".json")
DOCS = "doc_id long, text string, source string, tokens string, length string"
TARGETS = "source string, target_share double, max_repeats int, records string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_is_packed_whole_and_well(seed):
    rng = random.Random(seed)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(3000))
    packs = packing.pack_histogram(dict(histogram), 2048)
    placed = Counter()
    for lengths, count in packs:
        assert sum(lengths) <= 2048 and count > 0
        for x in lengths:
            placed[x] += count
    assert placed == histogram
    tokens, sequences = sum(k * v for k, v in histogram.items()), sum(c for _, c in packs)
    assert sequences <= tokens / 2048 * 1.02 + 2


def test_documents_are_packed_once(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(1, 400), "s") for i in range(300)] + [(1000, "long " * 6000, "s"), (1001, None, "s"), (1002, "", None), (None, "x", "s"), (1003, "same same", "s"), (1003, "same same", "s")]
    out = packing.pack_documents(documents(spark, rows), capacity=512).collect()
    size = {}
    t = tokenizers.Tokenizer.from_file(JSON)
    for i, text, _ in rows:
        if i is not None:
            size[i] = len(t.encode(text or "", add_special_tokens=False).ids)
    per = Counter()
    for r in out:
        per[r.sequence_id] += r.tokens
        assert r.to_token - r.from_token == r.tokens
    assert max(per.values()) <= 512
    got: dict = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.from_token, r.to_token))
    assert set(got) == set(size)
    for i, spans in got.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == size[i] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(spans) == 1 or size[i] > 512
    places = [(r.sequence_id, r.place) for r in out if r.place >= 0]
    assert len(places) == len(set(places))
    assert packing.pack_documents(documents(spark, []), capacity=512).count() == 0
    # Ranks in many small parts give as full sequences as ranks in one.
    small = packing.pack_documents(documents(spark, rows), capacity=512, rows_per_part=3).collect()
    assert sorted((r.doc_id, r.from_token, r.to_token) for r in small) == sorted((r.doc_id, r.from_token, r.to_token) for r in out)
    fill = Counter()
    for r in small:
        fill[r.sequence_id] += r.tokens
    assert max(fill.values()) <= 512 and len(fill) == len(per)
    assert len({(r.sequence_id, r.place) for r in small if r.place >= 0}) == sum(r.place >= 0 for r in small)


def test_both_kinds_of_tokenizer_files_count_alike(spark):
    rows = [(1, "def f(x):\n    return x  # ünïcode 中文 🙂", "s"), (2, "<|endoftext|> " * 3, "s"), (3, None, "s"), (4, "", "s"), (5, " " * 5000 + "a" * 5000 + "\r\n\t", "s")]
    sizes = [{r.doc_id: r.tokens for r in token_sizes(documents(spark, rows), tokenizer=x).collect()} for x in (TOKENIZER, JSON)]
    assert sizes[0] == sizes[1] and sizes[0][3] == sizes[0][4] == 0


def test_shares_are_met_within_the_repeat_limits(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(5, 60), rng.choice("aaaaaabbc")) for i in range(900)] + [(5000, None, "a"), (5001, "x", None), (5002, "", "b"), (3, rows_text := "word", "c")]
    assert rows_text
    targets = spark.createDataFrame([("a", 0.4, 1, "r"), ("b", 0.3, 2, "r"), ("c", 0.25, 3, "r"), ("gone", 0.05, 2, "r"), (None, 0.1, 1, "r")], TARGETS)
    mixed = mixing.mix_documents(documents(spark, rows), targets)
    shares = {r.source: r for r in mixing.reached_shares(mixed, targets).collect()}
    for s, want in (("a", 0.4), ("b", 0.3), ("c", 0.25)):
        assert abs(shares[s].reached_share - want / 0.95) < 0.004 and shares[s].most_copies <= shares[s].max_repeats
    assert shares["gone"].tokens == 0
    again = mixing.mix_documents(documents(spark, rows), targets)
    assert {(r.doc_id, r.copies) for r in mixed.collect()} == {(r.doc_id, r.copies) for r in again.collect()}


def test_odds_differ_by_size_and_are_kept_over_many_draws(spark):
    rows = [(i, "word " * (4 if i % 2 else 64), "a") for i in range(200)]
    targets = spark.createDataFrame([("a", 1.0, 3, "r")], TARGETS)
    sizes = {0: [], 1: []}
    for seed in range(12):
        mixed = mixing.mix_documents(documents(spark, rows), targets, total_tokens=8000, seed=seed, size_power=0.5).collect()
        assert abs(sum(r.tokens * r.copies for r in mixed) - 8000) <= 33 and max(r.copies for r in mixed) <= 3
        for odd in sizes:
            sizes[odd].append(sum(r.copies for r in mixed if r.doc_id % 2 == odd) / 100)
        expected = {r.doc_id % 2: r.expected for r in mixed}
    assert expected[0] > 2 * expected[1]
    for odd, seen in sizes.items():
        assert abs(sum(seen) / len(seen) - expected[odd]) < 0.08


def test_scale_keeps_the_repeat_limit():
    sums = [(1.0, 100.0), (2.0, 100.0), (8.0, 100.0)]
    c = mixing._scale(450.0, 2, sums)
    assert abs(sum(min(2, c * w) * t for w, t in sums) - 450) < 1e-6
    assert mixing._scale(600.0, 2, sums) >= 2 / 1.0 - 1e-9


def test_a_given_size_and_sources_too_small(spark):
    rows = [(i, "word " * 20, "a") for i in range(100)] + [(200 + i, "word " * 20, "b") for i in range(2)]
    targets = spark.createDataFrame([("a", 0.5, 1, "r"), ("b", 0.5, 3, "r")], TARGETS)
    mixed = mixing.mix_documents(documents(spark, rows), targets, total_tokens=1000).collect()
    copies = {r.doc_id: r.copies for r in mixed if r.source == "b"}
    assert copies == {200: 3, 201: 3}
    assert mixing.mix_documents(documents(spark, []), targets).count() == 0
