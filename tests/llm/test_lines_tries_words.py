"""Line dedup, the prefix trie and spelling variants against brute force, with nulls, ties, long texts and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from marlstone.llm import line_dedup, prefix_trie, variants

SPACES = " \t\n\x0b\x0c\r"
COMMON = "All rights reserved; see the licence file for the terms."


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# Lines.


def plain_lines(rows, least_chars=40, least_docs=5):
    held = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: lowered(line.strip(SPACES))
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= least_chars:
                held[key(line)].add(i)
    last = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, lines in split:
        left = [x for x in lines if key(x) not in last or i is not None and i >= last[key(x)]]
        out.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out, key=str)


LINES = [
    *((k, f"own line {k}\n  {COMMON}\t\nlast {k}") for k in range(1, 6)),
    (6, COMMON.upper() + "\n" + COMMON + "\n\n"),
    (6, COMMON.upper() + "\n" + COMMON + "\n\n"),
    (7, None),
    (8, ""),
    (9, "\n\n"),
    (10, COMMON + "\x0b\u0085"),
    (11, "Ä" + COMMON),
    (12, "ä" + COMMON),
    (13, "short"),
    (None, COMMON + "\nwithout an id"),
    (None, "Ünïcode " + COMMON),
    (14, "\n".join(f"line {k} of a long text, with some words to reach the length" for k in range(3000)) + "\n" + COMMON),
    *((20 + k, "\n".join(f"line {j} of a long text, with some words to reach the length" for j in range(0, 3000, 7))) for k in range(4)),
    (2, COMMON + "\nthe second text of one id"),
]


def test_lines_against_plain_loops(spark):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in LINES], "doc_id long, text string, row_key int, h string")
    got = line_dedup.line_digests(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lines(LINES)
    assert sum(r["n_dropped"] for r in got) > 1700


def test_lines_keep_columns_and_texts(spark):
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in LINES], "doc_id long, text string, row_key int, gone_places string, built string")
    out = line_dedup.drop_common_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (1, "own line 1\nlast 1") in texts and (7, "") in texts and (9, "\n\n") in texts
    assert all(r["row_key"] == 7 and r["built"] == "y" for r in out.collect())
    with pytest.raises(ValueError):
        line_dedup.drop_common_lines(df.withColumnRenamed("built", "N_lines"))


@pytest.mark.parametrize("seed", range(3))
def test_lines_random(spark, seed):
    rng = random.Random(seed)
    pool = [f"{'Line' if k % 2 else ' line'} {k % 9} " + "padding of many words " * 2 for k in range(18)] + ["", "brief", " \t"]
    rows = [(k % 37, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for k in range(60)]
    got = line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lines(rows)


def test_lines_empty_table(spark):
    assert line_dedup.line_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Tries.


def plain_trie(rebuilt):
    """rebuilt: {conversation: [(role, text), ...]} -> rows of the query, by brute force over all prefixes."""
    members = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = Counter(), Counter()
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted(
        (
            (min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children[path]), leaves[path], saved[path], sha(",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(path))))))
            for path, who in members.items()
        ),
        key=str,
    )


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def talks(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        for turn in range(rng.randrange(1, 12)):
            text = "the same start" if hot and turn == 0 and c % 3 else rng.choice(["yes", "no", "Straße", "", None, f"own {c}"])
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if turn else "user", text))
    rows.append((4 * n + 5, None, "user", "null turn comes first"))
    rows += [(4 * n + 5, 0, "user", "then this"), (None, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize(("seed", "n", "hot"), [(1, 60, False), (2, 300, True), (3, 9, False)])
def test_trie_against_all_prefixes(spark, monkeypatch, seed, n, hot):
    monkeypatch.setattr(prefix_trie, "CONVERSATIONS", 16)  # many shards; workers of a local session are forked from here or read the default
    rows = talks(seed, n, hot)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string")
    got = sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=str)
    assert got == plain_trie(plain_rebuilt(rows))


def shard_rows(conversations):
    out = []
    for c in sorted(conversations):
        out.append((c, None, 0))
        out += [(c, struct.pack("<qq", hash(t) & 0x7FFFFFFF, len(t[1])), len(t[1].encode())) for t in conversations[c]]
    return out


def test_shards_are_cut_between_conversations():
    import numpy as np

    ids = np.repeat(np.arange(3000), 3)
    assert prefix_trie._cut(ids) == 3 * prefix_trie.CONVERSATIONS
    assert prefix_trie._cut(ids[:300]) == 0
    long = np.concatenate([[1, 1], np.full(60_000, 2), [3]])
    assert prefix_trie._cut(long) == 2 and prefix_trie._cut(long[2:]) == 60_000 and prefix_trie._cut(long[2:-1]) == 0


def test_trie_of_a_shard_and_long_conversation():
    talks = {5: [("u", f"t{k}") for k in range(2000)], 6: [("u", "t0"), ("u", "t1")], 7: [], 9: [("u", "t0"), ("u", "other")]}
    rows = shard_rows(talks)
    got = prefix_trie._shard([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]).to_pylist()
    assert len(got) == 2002 and got[0]["n"] == 4 and got[0]["ends"] == "7" and got[0]["size"] == 2002
    assert [x["low"] for x in got if x["depth"] == 2] in ([5, 9], [9, 5]) and max(x["depth"] for x in got) == 2000


def test_trie_empty_and_repeated(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, None, None), (0, 3, "u", "x" * 200_000)]
    got = sorted((tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == plain_trie(plain_rebuilt(rows))


# Words.


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(count, ratio=2):
    near = {w: [v for v in count if v != w and one_edit(w, v)] for w in count}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_variants_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    alphabet = "abé𝄞" if seed == 2 else "abcdö"
    count = {"".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9]))): rng.choice([3, 3, 4, 7, 16, 40, 100]) for _ in range(500)}
    stem = "z" * 4000
    count |= {stem: 50, stem + "a": 5, stem[:-1] + "b": 9, stem + "ab": 2, "chain": 3, "chair": 6, "choir": 12, "chois": 24, "chose": 50, "": 9}
    df = spark.createDataFrame(list(count.items()) + [(None, 5)], "word string, n int")
    got = sorted((tuple(r) for r in variants.spelling_variants(df).collect()), key=str)
    assert got == plain_variants(count)


def test_document_variants(spark):
    rng = random.Random(5)
    stems = ["harbour", "station", "Überraschung", "garçons", "thimble", "×÷letters", "naïvely"]
    texts = [(k % 50 if k % 9 else None, " ".join(rng.choice(stems) for _ in range(30)) + rng.choice(["; harbor, Stations", "\nGARÇONS9thimbles", ""])) for k in range(150)]
    rows = [*texts, (7, None), (8, ""), (9, "harbour " * 3000), (10, "q" * 5000), *[(11, "again again")] * 3]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert {r["word"]: r["n"] for r in variants.document_words(df).collect()} == plain_words(rows)
    got = sorted((tuple(r) for r in variants.document_variants(df).collect()), key=str)
    assert got == plain_variants(plain_words(rows)) and any(r[1] for r in got)


def test_variants_empty(spark):
    assert variants.document_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)
