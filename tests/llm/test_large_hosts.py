"""Repeated runs of a large host are found whatever the number of its pages."""

from __future__ import annotations

import random

from marlstone.llm import html_extract


def test_runs_on_two_pages_of_a_large_host(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    notes = [words(12) for _ in range(20)]
    rows = []
    for k in range(60):
        blocks = [words(15), f"{words(5)} {notes[k % 20]} {words(5)}", notes[k % 7]]
        rows.append((k, f"http://a.b/{k}", "".join(f"<p>{b}</p>" for b in blocks)))
    once = words(20)
    rows += [rows[0], (60, "http://a.b/60", f"<p>{once}</p>"), (61, "http://a.b/60", f"<p>{once}</p>"), (62, "http://a.b/62", None), (63, "http://a.b/63", f"<article><p>{notes[0]}</p></article>")]
    rows += [(70 + k, None, f"<p>{notes[1]}</p><p>{words(9)}</p>") for k in range(20)]
    long = words(10)
    rows += [(90, "http://a.b/90", f"<p>{long}</p><p>tail</p>"), (91, "http://a.b/91", f"<p>{long[:20]}</p><p>{long[20:]} more of it</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda r: (r.page_id, str(r.url), r.text, r.n_chars)
    whole = sorted(map(key, html_extract.extract(table, shard=1000).collect()))
    assert sorted(map(key, html_extract.extract(table, shard=8).collect())) == whole
    assert all(n not in r[2] for n in notes for r in whole if r[0] < 60) and dict((r[0], r[2]) for r in whole)[60] == once
