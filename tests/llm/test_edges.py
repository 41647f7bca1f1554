"""Very long texts, empty tables, repeated rows and columns of clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from marlstone.llm import decontam, html_extract, langid, quality, sadedup, simhash

SF = "/root/testdata/sf0.001"


def words(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfgh')}{rng.randrange(90_000)}" for _ in range(n)]


def test_repeats_far_apart_in_a_long_text(spark):
    """Repeats on both sides of the length at which texts are cut, and over a cut."""
    passage = " ".join(words(1, 60))
    long = f"{passage} {' '.join(words(2, 48_000))} {passage} {' '.join(words(3, 3_000))}"
    assert len(long) > sadedup.PIECE + 10_000
    middle = long[sadedup.PIECE - 150 : sadedup.PIECE + 150]
    rows = [(1, long), (2, "é " + passage), (3, None), (4, ""), (5, "other " + middle), (6, " ".join(words(4, 300))), (6, " ".join(words(4, 300)))]
    got = {}
    for r in sadedup.remove_repeats(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, piece int").select("doc_id", "text")).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + 200] for _, d in data for k in range(len(d) - 199))
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = len(re.findall(b"\x01+", bytes(gone)))
        want = (len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest())
        assert want in got[i], i
    assert got[1][0][1] >= 2 * len(passage) + 300


def test_benchmark_passage_at_the_end_of_a_long_text(spark):
    passage = words(5, 25)
    long = words(6, 120_000) + passage + words(7, 3)
    docs = spark.createDataFrame([(1, " ".join(long), "k", 1), (2, None, "k", 1)], "doc_id long, text string, key string, n_hit int")
    items = spark.createDataFrame([("b", " ".join(passage))], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, items).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (len(long), 25, 1) and not got[2]["contaminated"]
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.decontaminate(docs.limit(0), items).columns == docs.columns


def test_fingerprint_of_a_long_text(spark):
    text = words(8, 60_000)
    hashes = [xxhash.xxh64_intdigest(" ".join(text[k : k + 4]).encode(), 42) for k in range(len(text) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    got = simhash.near_duplicates(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")).first()
    assert got["fingerprint"] == f"{want:016x}" and got["component_id"] == 1


def test_long_page_and_no_pages(spark):
    body = " ".join(words(9, 80_000))
    pages = spark.createDataFrame([(1, "http://h/1", f"<article><p>{body}</p><nav>menu</nav></article>", "x"), (2, "http://h/2", None, "x"), (3, None, "", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(pages.drop("text")).collect()}
    assert got[1]["text"] == body and (got[2]["text"], got[2]["n_chars"], got[3]["n_chars"]) == ("", 0, 0)
    assert html_extract.extract(pages.drop("text").limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9001, "the and of " * 30_000, "en", "s", 1), (9002, None, "en", "s", 1), (9003, "123 456", None, None, 1)], docs.schema)
    both = docs.unionByName(more).unionByName(docs.limit(3))
    odd = both.selectExpr("*", "'a' AS score", "1 AS held_out", "'x' AS lang_pred", "2 AS host", "3 AS prior")
    return both, odd, spark.read.parquet(f"{SF}/labels.parquet")


def test_languages_with_clashing_columns_and_repeats(tables):
    both, odd, _ = tables
    plain = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(both).collect())
    assert plain == Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(odd.select(*both.columns, "host", "prior")).collect())
    found = dict(plain.keys())
    assert (found[9002], found[9003]) == ("und", "und") and found[9001] == "en" and sum(plain.values()) == both.count()


def test_quality_with_clashing_columns(tables):
    both, odd, labels = tables
    a, b = (sorted(map(str, quality.classify(x, labels).collect())) for x in (both, odd.select(*both.columns, "host", "prior")))
    assert a == b and len(a) == both.count()
