"""Byte-level BPE encoding and decoding in length-bucketed padded matrices.

The distinct pieces of a group of texts become rows of token matrices, one for each bucket of lengths. In each round every
row merges its leftmost pair of least rank: ranks are looked up in a hashed table of pairs, and the row is
compacted by one place. Rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, only

NO_RANK = np.int32(2**31 - 1)
#: Upper lengths in bytes of the buckets; longer rows are each merged in a heap, as n rounds over n places would be quadratic.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512)
BUCKET_OF = [next(b for b in BUCKETS if n <= b) for n in range(BUCKETS[-1] + 1)]
#: A batch of a bucket holds at most this many places; a worker remembers chunks of text until they take about so many bytes.
PLACES, REMEMBER = 1 << 18, 64 << 20
#: What a remembered chunk takes besides three times its own length, and the characters whose new pieces are merged together.
EACH, GROUP = 240, 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@contextlib.contextmanager
def no_collector() -> Iterator[None]:
    """Millions of small tuples without a cycle: the cyclic collector would only walk them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class PairTable:
    """(left id, right id) -> merged id, open addressing in two numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys) + 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        place, self.probes = self._place(key), 0
        while len(key):
            self.probes += 1
            free = self.keys[place] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(place, return_index=True)[1]] = True
            put = free & first
            self.keys[place[put]], self.values[place[put]] = key[put], value[put]
            key, value, place = key[~put], value[~put], (place[~put] + 1) & (len(self.keys) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NO_RANK where the pair doesn't merge or a side is negative (padding)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(key.shape, NO_RANK, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        flat, flat_key = out.reshape(-1), key.reshape(-1)
        place = self._place(flat_key[open_])
        for _ in range(self.probes):
            if not len(open_):
                break
            found = self.keys[place]
            hit = found == flat_key[open_]
            flat[open_[hit]] = self.values[place[hit]]
            on = ~hit & (found != -1)
            open_, place = open_[on], (place[on] + 1) & (len(self.keys) - 1)
        return out


class Memo:
    """What chunks of text turned into, in two halves: a full one is put aside, and only what comes again is taken over
    from it."""

    def __init__(self) -> None:
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}
        self.held = 0

    def missing(self, chunks: set[str]) -> set[str]:
        """Take over what is known of the chunks, and return the others."""
        if self.held > REMEMBER // 2:
            self.now, self.before, self.held = {}, self.now, 0
        new = chunks.difference(self.now)
        for chunk in new.intersection(self.before):
            self.put(chunk, self.before[chunk])
        return new.difference(self.before)

    def put(self, chunk: str, value: object) -> None:
        self.now[chunk] = value
        self.held += EACH + 3 * len(chunk)


class Codec:
    """Encoder and decoder for the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.uneven = re.compile(r"\s ").search
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known, self.said = Memo(), Memo()

    def _merge_matrix(self, rows: list[bytes]) -> list[tuple[int, ...]]:
        width = max(map(len, rows))
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        out: list[tuple[int, ...]] = [()] * len(rows)
        live = np.arange(len(rows))
        ranks = self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        while len(live):
            at = ranks.argmin(axis=1)
            line = np.arange(len(live))
            best = ranks[line, at]
            done = best == NO_RANK
            if done.any():
                for k, row, n in zip(live[done].tolist(), ids[done].tolist(), size[done].tolist(), strict=True):
                    out[k] = tuple(row[:n])
                on = ~done
                live, ids, ranks, size, at, best = live[on], ids[on], ranks[on], size[on], at[on], best[on]
                if not len(live):
                    break
                line = np.arange(len(live))
            width = int(size.max())
            ids, ranks = ids[:, :width], ranks[:, : width - 1]
            col = np.arange(width - 1)
            take = col + (col >= at[:, None] + 1)
            ids[line, at] = best
            ids = np.take_along_axis(ids, np.concatenate([take, np.full((len(live), 1), width - 1)], axis=1), axis=1)
            size = size - 1
            ids[np.arange(width) >= size[:, None]] = -1
            if width > 2:
                ranks = np.take_along_axis(ranks, np.minimum(col[: width - 2] + (col[: width - 2] >= at[:, None] + 1), width - 2), axis=1)
                right_of = np.minimum(at, width - 3)
                nxt = np.minimum(at + 1, width - 1)
                fresh = self.pairs.look_up(ids[line, at], np.where(at + 1 < width, ids[line, nxt], -1))
                keep = at <= width - 3
                ranks[line[keep], right_of[keep]] = fresh[keep]
                left = at > 0
                ranks[line[left], at[left] - 1] = self.pairs.look_up(ids[line[left], at[left] - 1], ids[line[left], at[left]])
                ranks[np.arange(ranks.shape[1]) >= (size - 1)[:, None]] = NO_RANK
                ids = ids[:, : width - 1]
            else:
                ids, ranks = ids[:, :1], np.full((len(live), 1), NO_RANK, np.int32)
        return out

    def _merge_long(self, row: bytes) -> tuple[int, ...]:
        """The same merges by a heap of (rank, place) over linked places."""
        from heapq import heapify, heappop, heappush

        ids = self.byte_ids[np.frombuffer(row, np.uint8)].astype(np.int64).tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pairs.look_up(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i) for i, r in enumerate(rank) if r != NO_RANK]
        heapify(heap)
        pair = self._pair
        rank.append(int(NO_RANK))
        while heap:
            r, i = heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            j = nxt[i]
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (i, prv[i]):
                if k >= 0:
                    rank[k] = pair(ids[k], ids[nxt[k]]) if nxt[k] < n else int(NO_RANK)
                    if rank[k] != NO_RANK:
                        heappush(heap, (rank[k], k))
        return tuple(x for x in ids if x >= 0)

    def _pair(self, left: int, right: int) -> int:
        return self.ranks.get(self.tokens[left] + self.tokens[right], int(NO_RANK))

    def encode_pieces(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each piece: the vocabulary's own token, or else the merges of its bytes."""
        out: dict[str, tuple[int, ...]] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {b: [] for b in BUCKETS}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = (whole,)
            elif len(raw) <= BUCKETS[-1]:
                buckets[BUCKET_OF[len(raw)]].append((piece, raw))
            else:
                out[piece] = self._merge_long(raw)
        for top, rows in buckets.items():
            step = max(1, PLACES // top)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                out.update(zip([p for p, _ in part], self._merge_matrix([r for _, r in part]), strict=True))
        return out

    def _learn(self, chunks: set[str], memo: Memo, make: Callable[[tuple[int, ...]], object]) -> None:
        """Encode the chunks that ``memo`` doesn't have yet; it gets what ``make`` does with their ids."""
        split = {c: self.pieces.findall(c) for c in memo.missing(chunks)}
        ids = self.encode_pieces(set(chain.from_iterable(split.values())))
        for chunk, pieces in split.items():
            memo.put(chunk, make(ids[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable([ids[p] for p in pieces]))))

    def _chunks(self, text: str | None) -> list[str]:
        """Parts of the text that the pattern splits separately. No match goes on over a blank that follows a
        character other than white space, so the text is cut before each of these; one with longer runs of
        white space before a blank is left whole."""
        if not text:
            return []
        if self.uneven(text) or text[0] == " ":
            return [text]
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def _groups(self, texts: list[str | None], memo: Memo, make: Callable[[tuple[int, ...]], object]) -> Iterator[list[str]]:
        """The chunks of each text, once ``memo`` has them all. Texts are taken in groups of about ``GROUP``
        characters, so that the matrices hold the new pieces of many texts; a longer text is a group of its own."""
        k = 0
        while k < len(texts):
            group, held = [], 0
            while k < len(texts) and (not group or held + len(texts[k] or "") <= GROUP):
                group.append(self._chunks(texts[k]))
                held += len(texts[k] or "")
                k += 1
            with no_collector():
                self._learn(set().union(*group), memo, make)
            yield from group

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; null is empty."""
        for chunks in self._groups(texts, self.known, tuple):
            yield list(chain.from_iterable(map(self.known.now.__getitem__, chunks)))

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """For each text: number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes decoded from the ids.
        What a chunk's ids read and decode to is remembered with the chunk."""
        out: tuple[list[int], list[str], list[str]] = ([], [], [])
        for chunks in self._groups(texts, self.said, lambda ids: (" ".join(map(str, ids)), self.decode(ids))):
            both = [*map(self.said.now.__getitem__, chunks)]
            line = " ".join([x[0] for x in both])
            out[0].append(line.count(" ") + 1 if line else 0)
            out[1].append(hashlib.sha256(line.encode()).hexdigest())
            out[2].append(hashlib.sha256(b"".join([x[1] for x in both])).hexdigest())
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, kept by the worker."""
    return only(("codec", path, pattern), lambda: Codec(read_ranks(path), pattern))


def default_vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id, ids array<int>) for every row: the token ids of the whole text, however long, without special tokens.

    Null and empty texts have no ids; repeated rows stay; other columns are ignored; empty in, empty out.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = list(codec(path, pattern).encode_all(batch.column(1).to_pylist()))
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"id {kind}, ids array<int>", run).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id, bytes binary) of each row of ids; null and empty ids give empty bytes, repeated rows each theirs, lists of any
    length are decoded whole, and an empty table gives an empty result. An id beyond the vocabulary is an error."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        return pa.record_batch([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "bytes"])

    kind = rows.schema[id_col].dataType.simpleString()
    return map_columns(rows, [id_col, ids_col], f"id {kind}, bytes binary", run).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``, in one pass and without a shuffle.

    Null and empty texts have no tokens; repeated rows stay; other columns are ignored. ``ids_sha256`` is over the
    decimal ids joined by one space, ``decoded_sha256`` over the bytes that the ids decode to.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, said, back = codec(path, pattern).digests(batch.column(1).to_pylist())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run).withColumnRenamed("id", id_col)


def add_tokens(docs: DataFrame, text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """All columns of ``docs`` and n_tokens, ids_sha256, decoded_sha256; those names, where taken, are replaced.

    Null and empty texts have no tokens; repeated rows stay; very long texts are encoded whole; empty in, empty out.
    """
    path, pattern = vocabulary or default_vocabulary()
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in made]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, said, back = codec(path, pattern).digests(batch.column(kept.index(text_col)).to_pylist())
        more = [pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
        return pa.record_batch([*batch.columns, *more], names=[*kept, *made])

    plain = docs.select(*kept)
    schema = plain.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return map_columns(plain, kept, schema, run)
