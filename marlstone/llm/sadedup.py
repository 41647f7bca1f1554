"""Exact removal of long repeated byte strings by externally sorted, sampled suffixes.

Sorting every suffix of a corpus externally doesn't fit the limits, so suffixes are sampled first. Each window of
``LENGTH`` bytes stands for its least k-gram hash (the leftmost of equal ones); the places so chosen are the
sampled suffixes, and equal windows choose the same place within them. A run of windows with one place carries a
suffix tuple: the k-gram's hash, a hash of all bytes that the run spans, and where it is. Grouping finds the tuples
whose whole span repeats. Where spans of one k-gram differ, the distinct suffixes are sorted (Spark's external sort,
spilled to disk in runs and merged), and so are the reversed texts in front of them; from the common-prefix values
of neighbours in both orders, the repeats of all windows in front of a sampled suffix are induced, place by place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import as_bytes, broadcast_if_small, map_columns, salted_join, written

LENGTH, GRAM = 200, 32
#: Texts are hashed in pieces of so many windows. Places within a piece fit into ``LOW`` bits.
PIECE, LOW = 1 << 18, np.uint64((1 << 20) - 1)
#: Groups of one k-gram with more distinct spans than this are resolved by window hashes instead of by sorting.
LARGE = 2_000
#: Rows whose windows are induced together.
TOGETHER = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(99).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Powers:
    def __init__(self, n: int):
        back = np.uint64(pow(int(_ODD), -1, 2**64))
        self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _ODD, np.uint64))])
        self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, back, np.uint64))])


_powers: list[_Powers] = []


def powers() -> _Powers:
    if not _powers:
        _powers.append(_Powers(PIECE + LENGTH))
    return _powers[0]


def _sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers().up[: len(raw)], out=out[1:])
    return out


def _window_runs(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window, sampled place, k-gram hash and span hash of each run, for one piece."""
    sums, down = _sums(raw), powers().down
    n = len(raw) - gram + 1
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[:n])
    keys = (grams & ~LOW) | np.arange(n, dtype=np.uint64)
    wide = length - gram + 1
    padded = np.concatenate([keys, np.full(-n % wide, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - wide + 1], ahead[wide - 1 : n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    place = (least[first] & LOW).astype(np.int64)
    span = _mixed((sums[last + length] - sums[first]) * down[first] + (place - first).astype(np.uint64) * _ODD + (last - first).astype(np.uint64))
    return first, last, place, grams[place], span


def tuples_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, kh, ch) of a text's runs: pos packs the first window, the number of windows after it and the place
    in it; kh is the k-gram's hash, ch the span's."""
    raw, parts = np.frombuffer(text, np.uint8), []
    for at in range(0, len(raw) - length + 1, PIECE):
        first, last, place, kh, ch = _window_runs(raw[at : at + PIECE + length - 1], length, gram)
        parts.append(((first + at) << 16 | (last - first) << 8 | (place - first), kh.view(np.int64), ch.view(np.int64)))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _neighbours(rows: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """Common-prefix value of each sorted row with the one before it; 0 at a new group."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    grid = np.zeros((len(rows), width), np.uint8)
    grid[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = grid[1:] != grid[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        out[1:] = np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), -1)
    out[:1] = -1
    return out


def induce(group: np.ndarray, right: list[bytes], left: list[bytes], after: np.ndarray, copies: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which windows repeat: (rows, offsets), for sampled suffixes sorted by (group, right).

    ``right``: the text from the place on; ``left``: the text in front of it, reversed; ``after``: by how much the
    last window begins before the place; ``copies``: occurrences of the row's span. Offset o is the window that
    begins o bytes before the place. Two windows are equal if they agree in o bytes to the left and in
    ``length - o`` to the right, that is, if no lower common-prefix value lies between them in either order.
    """
    n, offsets = len(right), length - gram + 1
    to_right = _neighbours(right, group, length)
    order = np.array(sorted(range(n), key=lambda k: (int(group[k]), left[k])), np.int64)
    to_left = _neighbours([left[k] for k in order], group[order], offsets)
    before = np.fromiter(map(len, left), np.int64, n)
    out = np.zeros((n, offsets), bool)
    for o in range(offsets):
        have = np.flatnonzero((after <= o) & (o <= before))
        if not len(have):
            continue
        kind_right = np.cumsum(to_right < length - o)
        kind_left = np.empty(n, np.int64)
        kind_left[order] = np.cumsum(to_left < max(o, 0))
        _, which = np.unique(kind_right[have] * (n + 1) + kind_left[have], return_inverse=True)
        out[have, o] = np.bincount(which, copies[have])[which] > 1
    return out


def _spans(places: np.ndarray, rows: list[int], rids: np.ndarray, repeats: np.ndarray, length: int) -> tuple[list[int], list[int], list[int]]:
    """(rid, first byte, byte after the last) of the runs of repeated windows of the given rows."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for k in rows:
        at = np.flatnonzero(repeats[k])
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            for near, far in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True):
                out[0].append(int(rids[k]))
                out[1].append(int(places[k]) - far)
                out[2].append(int(places[k]) - near + length)
    return out


def _resolve(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Stream sorted suffixes; whole groups are induced together, ``TOGETHER`` rows or one group at a time."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.Table) -> pa.RecordBatch:
        group, pos = rows["kh"].to_numpy(), rows["pos"].to_numpy()
        place = (pos >> 16) + (pos & 255)
        after, copies = (pos & 255) - (pos >> 8 & 255), rows["n"].to_numpy()
        repeats = induce(group, rows["right"].to_pylist(), rows["left"].to_pylist(), after, copies, length, gram)
        rid, first, end = _spans(place, np.flatnonzero(copies == 1).tolist(), rows["rid"].to_numpy(), repeats, length)
        return pa.record_batch([pa.array(rid, pa.int64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["rid", "s", "e"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            rows = pa.Table.from_batches(held).combine_chunks()
            group = rows["kh"].to_numpy()
            cut = int(np.searchsorted(group, group[-1], "left"))
            if cut:
                yield settle(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield settle(pa.Table.from_batches(held))


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, text) -> (rid, s, e): byte ranges covered by strings of ``length`` bytes that start elsewhere too.

    Ranges may overlap and touch. A row of the input is an occurrence even where its rid repeats.
    """
    ship(docs.sparkSession)

    def sample(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [tuples_of(t or b"", length, gram) for t in as_bytes(batch.column(1))]
        rid = np.repeat(batch.column(0).to_numpy(), [len(x[0]) for x in found])
        return pa.record_batch([pa.array(rid), *[pa.array(np.concatenate([x[k] for x in found])) for k in range(3)]], names=["rid", "pos", "kh", "ch"])

    tuples = map_columns(docs, ["rid", "text"], "rid long, pos long, kh long, ch long", sample)
    seen = tuples.groupBy("kh").agg(F.count("*").alias("n"), F.min("ch").alias("low"), F.max("ch").alias("high")).filter("n > 1")
    seen = written(seen.select("kh", (F.col("low") != F.col("high")).alias("differ")), "repeats")
    hits = written(tuples.join(seen, "kh"), "hits")
    first, windows = F.shiftright("pos", 16), F.shiftright("pos", 8).bitwiseAND(F.lit(255))
    whole = [F.col("rid"), first.alias("s"), (first + windows + length).alias("e")]
    alike = hits.filter(~F.col("differ")).select(*whole)

    mixed = hits.filter("differ")
    spans = written(mixed.groupBy("kh", "ch").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("one")), "spans")
    copied = salted_join(mixed, spans.filter("n > 1").select("kh", "ch"), ["kh", "ch"], ["rid", "pos"], salts=16).select(*whole)

    # The bytes of each distinct span, from one document that has it.
    large = written(spans.groupBy("kh").count().filter(F.col("count") > LARGE).select("kh", F.lit(True).alias("large")), "large")
    asked = spans.join(broadcast_if_small(large, 1_000_000), "kh", "left").select("one.rid", F.struct("one.pos", "kh", "n", F.coalesce("large", F.lit(False)).alias("large")).alias("x"))
    asked = asked.groupBy("rid").agg(F.collect_list("x").alias("xs"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for rid, packed, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = _unpacked(packed)
            for x in xs:
                a = x["pos"] >> 16
                p, end = a + (x["pos"] & 255), a + (x["pos"] >> 8 & 255) + length
                for column, value in zip(out, (x["kh"], rid, x["pos"], x["n"], x["large"], text[p:end], text[a:p][::-1]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["kh", "rid", "pos", "n", "large", "right", "left"])

    met = packed_texts(docs.select("rid", "text")).join(asked, "rid").select("rid", "packed", "xs")
    suffixes = map_columns(met, ["rid", "packed", "xs"], "kh long, rid long, pos long, n long, large boolean, right binary, left binary", cut)
    any_large = bool(large.take(1))
    if any_large:
        suffixes = written(suffixes, "suffixes")
    ordered = suffixes.filter(~F.col("large")).select("kh", "rid", "pos", "n", "right", "left").repartition("kh").sortWithinPartitions("kh", "right")
    induced = ordered.mapInArrow(lambda batches: _resolve(batches, length, gram), "rid long, s long, e long")
    out = alike.unionByName(copied).unionByName(induced)
    return out.unionByName(_by_windows(suffixes.filter("large"), length)) if any_large else out


def _by_windows(suffixes: DataFrame, length: int) -> DataFrame:
    """The same for groups with very many distinct spans: every window's hash is grouped, with partial sums."""

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[np.ndarray] = []
        rids, starts, copies = [], [], []
        for rid, pos, n, right, left in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            raw = np.frombuffer(left[::-1] + right, np.uint8)
            sums, count = _sums(raw), len(raw) - length + 1
            out.append(_mixed((sums[length:] - sums[:-length]) * powers().down[:count]).view(np.int64))
            rids.append(np.full(count, rid))
            starts.append((pos >> 16) + np.arange(count))
            copies.append(np.full(count, n))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in (rids, starts, copies, out)], names=["rid", "s", "n", "wh"])

    rows = written(map_columns(suffixes, ["rid", "pos", "n", "right", "left"], "rid long, s long, n long, wh long", hashes), "windows")
    again = written(rows.groupBy("wh").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("wh"), "again")
    return rows.filter("n = 1").join(again, "wh").select("rid", "s", (F.col("s") + length).alias("e"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(rid, text, ...) -> the other columns and the text's compressed bytes: half as much to shuffle."""
    others = [c for c in docs.columns if c != "text"]

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.record_batch([*[batch.column(k) for k in range(len(others))], pa.array([press(t or b"") for t in as_bytes(batch.column(len(others)))], pa.binary())], names=[*others, "packed"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in others]
    return map_columns(docs, [*others, "text"], ", ".join([*kinds, "packed binary"]), pack)


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same or another row, is
    removed; strings are judged on the input. Equal strings are found by 64-bit hashes of windows of the same k-gram hash,
    and rows are told apart by 64 bits: two different ones count as equal with a probability of about 1e-19 for each pair
    that meets. ``kept`` are the remaining bytes. Null and empty texts and texts
    shorter than ``length`` lose nothing; of repeated rows each loses what it shares with the other; other columns
    are ignored; empty in, empty out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(id_col).alias("id"), text.alias("text"))
    found = repeated_spans(named.select("rid", "text"), length, gram)
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("xs"))

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        for packed, xs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, parts, at = _unpacked(packed), [], 0
            gone = _merged(xs or [])
            for s, e in gone:
                parts.append(raw[at:s])
                at = e
            kept = b"".join([*parts, raw[at:]])
            for column, value in zip(out, (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.record_batch([batch.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    met = packed_texts(named.select("rid", "id", "text")).join(spans, "rid", "left").select("id", "packed", "xs")
    out = map_columns(met, ["id", "packed", "xs"], f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", strip)
    return out.withColumnRenamed("id", id_col)
