"""Secret scans: fixed patterns, and guess-cost dynamic programming over values in a credential context.

A value that follows a credential word is cut into segments (words, dates, repeats, sequences, keyboard walks,
brute-force characters) so that the sum of the segments' costs in bits is least. Values that cost at least
``MIN_BITS`` to guess are secrets. Words are guessed by their rank: first a few that people choose, then the most
frequent words of the corpus itself, which are counted over all its texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_columns, only, written

# The base patterns and the least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "guess")

#: Any match of the patterns below holds one of these in lower case: a cheap gate before the regular expressions.
GATES = ("passw", "pwd", "passphrase", "passcode", "secret", "token", "key", "auth", "credential")
CONTEXT = re.compile(r"""(?ai)(?<![a-z])(?:password|passwd|pwd|passphrase|passcode|secret|token|(?:api|access|private)[ _-]?key|auth(?:orization)?|credentials?)["']?(?:\s*+(?:=>|->|[:=]++)\s*+|\s++is\s++)["']?([^\s"'<>,;(){}\[\]]{8,})""")
MIN_BITS = 36.0

# Words that people choose, before those of the corpus.
CHOSEN = (
    "password passwd pass secret token login welcome admin root user test demo example sample changeme default "
    "letmein qwerty dragon monkey master shadow sunshine princess football baseball hello love iloveyou summer winter "
    "placeholder redacted hidden enter insert none null true false value string"
).split()
#: The corpus's words: at most so many of the most frequent ones, of so many occurrences at least and so many letters.
WORDS, LEAST_SEEN, LETTERS = 50_000, 5, (3, 24)
LEET = str.maketrans("@40315$7!", "aaoelsstl")
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-_/.]?(?:0[1-9]|1[0-2])(?:[-_/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-_/.]?(?:0[1-9]|1[0-2])[-_/.]?(?:19|20)\d\d")
SEGMENT_BITS, SHORTEST = 1.0, 3
#: Lengths of units that a repeat may have, besides single characters.
UNITS = range(2, 9)


def _moves() -> dict[tuple[str, str], int]:
    """Direction (0 to 5) from each key to those that touch it; a row stands half a key to the right of the one above."""
    at = {key: (row, col) for row, keys in enumerate(KEYBOARD) for col, key in enumerate(keys)}
    ways = ((0, 1), (0, -1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    back = {place: key for key, place in at.items()}
    return {(key, back[row + r, col + c]): d for key, (row, col) in at.items() for d, (r, c) in enumerate(ways) if (row + r, col + c) in back}


MOVES = _moves()
KEYS = sum(map(len, KEYBOARD))
DEGREE = len(MOVES) / KEYS


@lru_cache(maxsize=4096)
def walk_bits(length: int, turns: int) -> float:
    """A start, a direction for each straight stretch, and where the turns are."""
    places = math.lgamma(length) - math.lgamma(turns) - math.lgamma(length - turns + 1)
    return math.log2(KEYS) + turns * math.log2(DEGREE) + places / math.log(2)


def _alphabet(value: str) -> float:
    """Bits of one brute-force character."""
    if re.fullmatch(r"\d+", value):
        return math.log2(10)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 4.0
    n = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search(r"\d", value)) + 33 * bool(re.search(r"[^a-zA-Z0-9]", value))
    return math.log2(n)


def _shape_bits(part: str) -> float:
    return 0.0 if part.islower() else 1.0 if part.istitle() or part.isupper() else 3.0


def ranked(words: list[str]) -> dict[str, int]:
    """Rank of each word, from 2 on: those that people choose first."""
    return {w: k + 2 for k, w in enumerate(dict.fromkeys([*CHOSEN, *words]))}


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Least cost in bits of guessing ``value``: the cheapest cut into segments, for a time linear in the length.

    A word may end anywhere; a repeat, a sequence or a walk that begins at a place goes on as far as it can.
    """
    if not value:
        return 0.0
    low, plain, bits, n = value.lower(), value.lower().translate(LEET), _alphabet(value), len(value)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    same, up, down, walk, turns = [n] * n, [n] * n, [n] * n, [n] * n, [1] * n
    agree = {u: [0] * (n + 1) for u in UNITS}  # how many characters from a place on are those u places later
    for i in range(n - 1, -1, -1):
        for u in UNITS:
            if i + u < n and low[i] == low[i + u]:
                agree[u][i] = agree[u][i + 1] + 1
        if i == n - 1:
            continue
        same[i] = same[i + 1] if low[i] == low[i + 1] else i + 1
        step = ord(low[i + 1]) - ord(low[i])
        up[i] = up[i + 1] if step == 1 else i + 1
        down[i] = down[i + 1] if step == -1 else i + 1
        way = MOVES.get((low[i], low[i + 1]))
        if way is None:
            walk[i] = i + 1
        else:
            walk[i] = walk[i + 1]
            further = MOVES.get((low[i + 1], low[i + 2])) if walk[i] > i + 2 else way
            turns[i] = turns[i + 1] + (further != way)
    for i in range(n):
        here = best[i] + SEGMENT_BITS

        def reach(j: int, cost: float) -> None:
            best[j] = min(best[j], here + cost)

        best[i + 1] = min(best[i + 1], best[i] + bits)
        for j in range(i + SHORTEST, min(n, i + LETTERS[1]) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j], 0) * 4
            if rank:
                reach(j, math.log2(rank) + _shape_bits(value[i:j]))
        if (m := DATE.match(value, i)) is not None:
            reach(m.end(), 7 if m.end() - i == 4 else 15)
        if same[i] - i >= SHORTEST:
            reach(same[i], bits + math.log2(same[i] - i))
        for run in (up[i], down[i]):
            if run - i >= SHORTEST:
                reach(run, bits + 1 + math.log2(run - i))
        for u in UNITS:
            times = agree[u][i] // u + 1
            if times >= 2:
                reach(i + times * u, u * bits + math.log2(times))
        if walk[i] - i >= SHORTEST:
            reach(walk[i], walk_bits(walk[i] - i, turns[i]))
    return best[n]


def frequent_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, most frequent first, ties by name. Words of one count are taken all or none,
    so that at most ``WORDS`` of them reach the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("w"))
    counts = words.filter(F.length("w").between(*LETTERS)).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SEEN)
    counts = written(counts, "words")
    # One row for each distinct count: a running sum over a small table.
    taken = F.sum("k").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    cut = counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("taken", taken).filter(F.col("taken") <= WORDS).agg(F.min("n")).first()[0]
    found = counts.filter(F.col("n") >= cut).collect() if cut is not None else []
    return [r["w"] for r in sorted(found, key=lambda r: (-r["n"], r["w"]))]


def spans_of(text: str | None, ranks: dict[str, int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in order; kinds are places in ``KINDS``."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(g in low for g in GATES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        out += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_bits(m[1].rstrip(".!?"), ranks) >= MIN_BITS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _ranks_of(packed: bytes) -> dict[str, int]:
    """The ranks of words packed as lines, kept by the worker."""
    key = ("words", hashlib.sha256(packed).hexdigest())
    return only(key, lambda: ranked(packed.decode().split("\n") if packed else []))


def _packed(docs: DataFrame, text_col: str, words: list[str] | None) -> bytes:
    return "\n".join(frequent_words(docs, text_col) if words is None else words).encode()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) for every row of ``docs``.

    Null and empty texts have no spans; repeated rows stay; very long texts are scanned whole, in linear time; other
    columns are ignored; empty in, empty out. A span of the patterns is the whole match; a ``guess`` span is the value
    alone. Positions are code points, ends exclusive. ``words``: ranked words, if they are known; else those of ``docs``.
    """
    packed = _packed(docs, text_col, words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = _ranks_of(packed)
        found = [spans_of(t, ranks) for t in batch.column(1).to_pylist()]
        n = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(4)]
        base = pa.array([hashlib.sha256(_said([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found], pa.string())
        return pa.record_batch([batch.column(0), *n[:3], base, pa.array([_said(x) for x in found], pa.string()), n[3]], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long", run).withColumnRenamed("id", id_col)


def masked(text: str | None, ranks: dict[str, int], mask: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans put out of sight."""
    if not text:
        return text
    out, at = [], 0
    runs: list[list[int]] = []
    for a, _, b in spans_of(text, ranks):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", words: list[str] | None = None) -> DataFrame:
    """``docs`` with its secrets masked; every row and column stays, ``length_col`` (if there) follows the text.

    Null texts stay null, empty ones empty, repeated rows stay, and an empty table is no error. ``words``: see ``scan``.
    """
    columns = docs.columns
    at, packed = columns.index(text_col), _packed(docs, text_col, words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = _ranks_of(packed)
        texts = [masked(t, ranks) for t in batch.column(at).to_pylist()]
        new = {text_col: pa.array(texts, batch.schema.field(at).type)}
        if length_col in columns:
            new[length_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(columns.index(length_col)).type)
        return pa.record_batch([new.get(c, batch.column(k)) for k, c in enumerate(columns)], names=columns)

    return map_columns(docs, columns, docs.schema, run)
