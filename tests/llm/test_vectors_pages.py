"""Nearest neighbours, pages, shards and the pipeline."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from marlstone.llm import ann, html_extract, shards
from marlstone.llm.common import fresh_path


def test_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[0][1]) for k in range(30)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, rows[1][1]), (2080, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, d int, id string")
    got = ann.nearest(table).toPandas()
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, data = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    recall = []
    for i, v in good:
        if i % 20:
            continue
        score = data @ v
        order = [k for k in np.lexsort((ids, -np.round(score, 9))) if ids[k] != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [data[ids == k][0] @ v for k in mine.vec_id])
        assert mine.score.is_monotonic_decreasing
        recall.append(len(set(ids[order]) & set(mine.vec_id)) / 20)
    assert np.mean(recall) >= 0.9
    tied = got[got.query_id == 0].sort_values("rank")
    assert tied.vec_id.tolist() == list(range(1000, 1020))
    assert set(got.query_id) == {i for i, _ in good if i % 20 == 0}
    assert ann.nearest(table.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    doubled = table.unionByName(table.filter("vec_id in (0, 1, 21)"))
    pdf = table.toPandas()
    data, ids = np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["vec_id"].to_numpy()
    got = ann.nearest(table).toPandas()
    asked = ids[ids % 20 == 0]
    assert len(got) == 20 * len(asked)
    mine = {q: set(g) for q, g in got.groupby("query_id")["vec_id"]}
    hit = 0
    for q in asked:
        score = data @ data[ids == q][0]
        score[ids == q] = -np.inf
        hit += len(mine[q] & set(ids[np.argsort(-score, kind="stable")[:20]]))
    assert hit >= 0.95 * 20 * len(asked)
    again = ann.nearest(doubled).toPandas()
    assert set(again.groupby("query_id").size()) == {20} and set(again["query_id"]) == set(asked)


def test_pages(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><a>Home</a></nav><div class="cookie-notice">We use</div>'
        '<article><h1>Head &amp; line</h1><p>a\n  b&nbsp;c</p><p><b>bold<br><p>open<div id="comments"><p>nice</p></div><form>f<input></form></article><aside>rel</aside><footer>f</footer>'
    )
    plain = "<body><p>{}</p><p>this very long line of words is on every single page here</p></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://g/1", plain.format("first own text")), (5, "http://g/2", plain.format("second own text")), (5, "http://g/2", plain.format("second own text")), (6, "x", "just text & <b>more")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame([(*r, "h", 3) for r in rows], "page_id long, url string, html string, host string, shard int")).collect())
    assert got[0] == (1, "Head & line\na b c\nbold\nopen", 27)
    assert [t for _, t, _ in got[1:3]] == ["", ""]
    assert got[3][1] == "first own text" and got[6][1] == "just text & more"
    assert all(n == len(t) for _, t, n in got)


def test_repeated_runs_need_two_pages():
    tokens = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 10])
    assert html_extract.repeated(tokens, np.array([0] * 9 + [1] * 9)).tolist() == ([True] * 8 + [False]) * 2
    assert not html_extract.repeated(tokens, np.zeros(18, int)).any()


def test_repeated_runs_against_plain_loops():
    rng = random.Random(4)
    for case in range(40):
        run, kinds = rng.choice([2, 3, 8]), rng.choice([2, 4, 30])
        sizes = [rng.randrange(0, 25) for _ in range(rng.randrange(1, 7))]
        phrase = [rng.randrange(kinds) for _ in range(run + 3)]
        streams = [[rng.randrange(kinds) for _ in range(n)] for n in sizes]
        for s in streams:
            if s and rng.random() < 0.6:
                at = rng.randrange(len(s))
                s[at:at] = phrase[rng.randrange(3) :]
        tokens = np.array([t for s in streams for t in s], np.int64)
        page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        part = page * 2 + np.array([k % 7 > 4 for k in range(len(page))], int) if case % 2 and len(page) else page
        whole = lambda k: k + run <= len(tokens) and part[k] == part[k + run - 1]  # noqa: B023, E731
        if case % 2:  # parts have to follow each other
            part = np.maximum.accumulate(part) if len(part) else part
        want = np.zeros(len(tokens), bool)
        for a in range(len(tokens)):
            if whole(a) and any(whole(b) and page[b] != page[a] and tokens[b : b + run].tolist() == tokens[a : a + run].tolist() for b in range(len(tokens))):
                want[a : a + run] = True
        assert html_extract.repeated(tokens, page, part, run).tolist() == want.tolist(), case


def text_of(page):
    return [t for kind, t in html_extract.blocks_of(page) if kind == html_extract.INSIDE]


def test_marks_and_quotes():
    wrap = lambda x: f"<body><article>{x}</article></body>"
    assert text_of(wrap("<p class=it's>Main text here, don't lose</p>")) == ["Main text here, don't lose"]
    assert text_of(wrap("<p title=\"a > b\" id='search'>kept</p><p class='social-studies'>this too</p><li class=ad>and this</li>")) == ["kept", "this too", "and this"]
    assert text_of(wrap("<div class='x ad'>gone</div><section id=comments><p>gone</p></section><div class='addendum'>kept</div>")) == ["kept"]
    assert text_of(wrap("<header><h1>gone</h1></header><nav>gone</nav><p>a<b>b</b>c &amp; d</p>")) == ["abc & d"]
    assert text_of("<div class=ad>open<article><p>kept</p></article><p>out</p>") == ["kept"]
    assert [t for k, t in html_extract.blocks_of("<div class='social-share'>no</div><p>yes</p>") if k == html_extract.OUTSIDE] == ["yes"]
    assert text_of(wrap('<p title="never closed>kept</p>')) == ["kept"]


def test_open_tags_take_time_in_proportion():
    import time

    def took(n):
        page = "<article>" + "<div class=x>" * n + "</p>" * n + "<main>" * n + "</article>" * n + "<a b='c" * n
        began = time.perf_counter()
        html_extract.blocks_of(page)
        return time.perf_counter() - began

    took(1_000)
    assert took(40_000) < 30 * took(4_000)


def test_permutation_and_shards(spark):
    for n in (1, 2, 3, 5, 1000, 70_001):
        assert sorted(shards.permute(np.arange(n), n).tolist()) == list(range(n))
    assert shards.permute(np.arange(99), 99, 1).tolist() != shards.permute(np.arange(99), 99, 2).tolist()
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.randint(0, 1500)))) for k in range(40)] + [(None, None), (7, ""), (7, "z" * 5000)]
    path = fresh_path(spark, "test-shards")
    n = shards.materialise(spark.createDataFrame(rows, "doc_id long, text string"), path)
    back = shards.read_shards(spark, path).toPandas().sort_values("slot")
    assert back.slot.tolist() == list(range(n)) and back.shard.is_monotonic_increasing
    assert all(g.byte_offset.tolist() == [k * shards.STRIDE for k in range(len(g))] for _, g in back.groupby("shard"))
    vocabulary = shards.default_vocabulary()
    whole = sorted(hashlib.sha256(str([*shards.token_ids(t, vocabulary), shards.END]).encode()).hexdigest() for _, t in rows)
    parts = back.assign(group=back.doc_id.fillna(-1)).sort_values(["group", "slot"])
    total = sum(len(x) for x in parts["ids"])
    assert total == sum(len(shards.token_ids(t, vocabulary)) + 1 for _, t in rows)
    single = [[*g.sort_values("seq_no")["ids"]] for k, g in parts.groupby("group") if k != 7]
    assert {hashlib.sha256(str([int(x) for p in g for x in p]).encode()).hexdigest() for g in single} <= set(whole)
    assert shards.read_shards(spark, path, n - 3).count() == 3
    assert shards.materialise(spark.createDataFrame([], "doc_id long, text string"), fresh_path(spark, "none")) == 0


def test_shards_of_any_plan_have_every_sequence_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans = {"scan": docs, "repartitioned": docs.repartition(4), "distinct": docs.dropDuplicates(["doc_id"]), "joined": docs.join(docs.select("doc_id"), "doc_id")}
    seen = set()
    for name, plan in plans.items():
        path = fresh_path(spark, f"test-{name}")
        n = shards.materialise(plan, path)
        back = shards.read_shards(spark, path, digest=True).toPandas()
        assert sorted(back.slot) == list(range(n)), name
        seen.add(tuple(sorted(zip(back.doc_id, back.seq_no, back.ids_sha256, strict=True))))
    assert len(seen) == 1
    assert shards.materialised(spark, "/root/testdata/sf0.001/documents.parquet").count() == n


def test_pipeline_stages_keep_columns_and_clean_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert 0.7 * docs.count() <= len(rows) <= docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.decoded_sha256 for r in rows)
