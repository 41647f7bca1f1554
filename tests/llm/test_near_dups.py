"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline
from marlstone.llm import near_dups, simhash


def test_near_dedup_stage_against_all_pairs(spark):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts = [None, "", " \n", "one two", "One  TWO", "one two three four five", "x " * 30, "x " * 40]
    for size in (60, 130, 130, 700):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9, 20, 40):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(size)] = word()
            texts.append(" ".join(copy))
    # A chain, and a group with more members than a bucket has pivots.
    base = [word() for _ in range(200)]
    texts += [" ".join([*base[k:], *[word() for _ in range(k)]]) for k in range(0, 60, 6)]
    base = [word() for _ in range(300)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rnd.randrange(9)):
            copy[rnd.randrange(300)] = word()
        texts.append(" ".join(copy))
    rnd.shuffle(texts)
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in words]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    table = spark.createDataFrame([(k, t, "en", 1) for k, t in enumerate(texts)], "doc_id long, text string, node string, bucket int")
    got = corpus_pipeline.near_dedup(spark, table, "")
    assert got.columns == table.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({find(k) for k in range(len(texts))})
    assert corpus_pipeline.near_dedup(spark, table.limit(0), "").count() == 0


def test_pairs_between_components_of_a_bucket_are_compared(spark, monkeypatch):
    """All in one bucket, one pivot: pairs that the pivot doesn't show are found by the second pass."""
    monkeypatch.setattr(near_dups, "PIVOTS", 1)
    monkeypatch.setattr(near_dups, "band_keys", lambda joined: [7] if joined else [])
    texts = [" ".join(f"g{g}w{k}" for k in range(100)) + " end" * c for g in range(6) for c in range(1, 4)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dups.keep_one(table).collect()) == [0, 3, 6, 9, 12, 15]


def _without_bands(monkeypatch):
    """Bands that no two texts share, so that only anchors find pairs."""
    monkeypatch.setattr(near_dups, "band_keys", lambda joined: [near_dups.xxhash.xxh64_intdigest(joined) >> 1] if joined else [])


def test_near_duplicates_are_found_by_anchors_of_five_word_fingerprints(spark, monkeypatch):
    _without_bands(monkeypatch)
    rnd = random.Random(3)
    texts, groups = [], []
    for _ in range(8):
        base = [f"w{rnd.randrange(5000)}" for _ in range(1500)]
        groups.append(len(texts))
        texts += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (0, 700, 1499)] + [" ".join(base)]
    prints = [int.from_bytes(near_dups.fingerprint(t.encode(), 5), "big") for t in texts]
    assert all(min((prints[k] ^ prints[g + j]).bit_count() for j in range(4) if g + j != k) <= 4 for g in groups for k in range(g, g + 4))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dups.keep_one(table).collect()) == groups


def test_anchors_alone_link_nothing(spark, monkeypatch):
    """All fingerprints are equal: the sets of shingles still decide, for each two nodes of the bucket."""
    _without_bands(monkeypatch)
    monkeypatch.setattr(near_dups, "fingerprint", lambda words, shingle: bytes(8))
    texts = [" ".join(f"g{g}w{k}" for k in range(100)) + " end" * c for g in range(6) for c in range(1, 4)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dups.keep_one(table).collect()) == [0, 3, 6, 9, 12, 15]


def test_blocks_of_the_stage_cover_four_bits(spark):
    rnd = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = []
    for _ in range(300):
        a = rnd.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5)))))
    table = spark.createDataFrame([(signed(x),) for x in {x for p in pairs for x in p}], "fp long")
    got = {(r.a, r.b) for r in simhash.close_pairs(table, blocks=near_dups.ANCHORED).collect()}
    assert {tuple(sorted(map(signed, p))) for p in pairs} <= got
