"""Training-order materialisation: token sequences in fixed-stride shards, in the order of a keyed permutation.

Documents become sequences of ``SEQUENCE`` token ids. A document of n bytes has n tokens at most, so that its sequences
get addresses of their own without tokenising anything first: prefix sums over the file splits and within each give
every document room for as many sequences as its bytes allow. A Feistel network over the least even number of bits
that holds all addresses permutes them; addresses that leave the range walk on through the network until they are back
in it. The sequences in the order of their permuted addresses have the global slots 0, 1, 2 and so on. A shard is a
range of permuted addresses: its records follow one another with a fixed stride, and as the shards' numbers of records
add up to its first slot, the record of a slot is at a known place and reading can start anywhere. Spark's own text
writer writes the shards, with the bytes of the end-of-text id as line separator: any store that Spark writes to will
do, and its commit protocol covers lost executors.

A record, little endian: id of the document (int64), number of the sequence in it (int32), number of ids (int32),
``SEQUENCE`` ids (uint16, padded with end-of-text), end-of-text (uint16).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from .bpe import codec, default_vocabulary, read_ranks
from .common import bounded_batches, broadcast_if_small, fresh_path, slices, written

SEQUENCE, SHARD, ROUNDS, KEY = 512, 4096, 6, 20260101
END = 50256
HEADER = np.dtype([("doc", "<i8"), ("nth", "<i4"), ("n", "<i4")])
STRIDE = HEADER.itemsize + 2 * SEQUENCE + 2
NO_ID = np.iinfo(np.int64).min
SEPARATOR, ENCODING = END.to_bytes(2, "little").decode("latin-1"), "ISO-8859-1"
_END, _HEAD = END.to_bytes(2, "little"), struct.Struct("<qii")
#: tiktoken is slow on very long pieces; texts this long that hold such a run go to our own encoder, with the same ids.
LONG_TEXT, LONG_RUN = 50_000, 20_000


def half_bits(n: int) -> int:
    """Bits of each half of the least even-sized domain that holds ``n`` indexes."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the indexes: a permutation of range(n) that depends on ``key``."""
    half = np.uint64(half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]
    x = index.astype(np.uint64)
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] >> half, x[walk] & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(32) & mask)
        x[walk] = left << half | right
        walk[walk] = x[walk] >= np.uint64(n)
    return x.astype(np.int64)


@lru_cache(maxsize=2)
def _fast(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def token_bytes(text: str | None, vocabulary: tuple[str, str]) -> bytes:
    """Token ids of the text as 16-bit little-endian numbers."""
    if not text:
        return b""
    if len(text) > LONG_TEXT and max(map(len, text.split()), default=len(text)) > LONG_RUN:
        return np.array(next(iter(codec(*vocabulary).encode_all([text]))), "<u2").tobytes()
    return np.array(_fast(*vocabulary).encode_ordinary(text), "<u2").tobytes()


def token_ids(text: str | None, vocabulary: tuple[str, str]) -> list[int]:
    return np.frombuffer(token_bytes(text, vocabulary), "<u2").tolist()


def _record(doc: int | None, nth: int, own: bytes) -> bytes:
    return _HEAD.pack(NO_ID if doc is None else doc, nth, len(own) // 2) + own + _END * (SEQUENCE - len(own) // 2)


def _split_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, part): part is the file split that a row comes from."""
    part = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), part.alias("part"))


def _room(n_bytes):
    """Sequences that a text of so many bytes and its end-of-text id have at most; for columns and numbers."""
    return n_bytes // SEQUENCE + 1


def sequences(docs: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """(part, place, record): the records of every document in turn, without their last two bytes; places leave the
    room that a document's bytes ask for.

    Every document ends with one end-of-text id, so that a null or empty text is one sequence with that id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in slices(whole):
                out: tuple[list[int], list[int], list[bytes]] = ([], [], [])
                size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                for doc, text, part, n in zip(*[batch.column(k).to_pylist() for k in range(3)], size, strict=True):
                    raw, place, nth = token_bytes(text, vocabulary) + _END, seen.get(part, 0), 0
                    for nth, at in enumerate(range(0, len(raw), 2 * SEQUENCE)):
                        out[0].append(part)
                        out[1].append(place + nth)
                        out[2].append(_record(doc, nth, raw[at : at + 2 * SEQUENCE]))
                    if nth >= _room(n):
                        raise ValueError("a token of the vocabulary has no byte: a text has more tokens than bytes")
                    seen[part] = place + _room(n)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["part", "place", "record"])
            pa.default_memory_pool().release_unused()

    bounded_batches(docs.sparkSession)
    return docs.select("id", "text", "part").mapInArrow(run, "part long, place long, record binary")


def materialise(docs: DataFrame, path: str, **options) -> int:
    """Write the shards of any table under ``path``: the table is written first, so that its rows have fixed places, and
    ``materialise_files`` does the rest. Returns the number of sequences."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    spark, source = docs.sparkSession, fresh_path(docs.sparkSession, "documents")
    docs.select(id_col, text_col).write.parquet(source)
    return materialise_files(spark, source, path, **options)


def materialise_files(spark: SparkSession, source: str, path: str, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> int:
    """Write the shards of the Parquet table at ``source`` under ``path`` as ``shard=K/``; returns the number of sequences.

    The lengths of its texts are summed over the splits of its files first; the second scan finds the same rows of a split
    in the same order, and tokenises them. Repeated rows are sequences of their own; null ids and texts are kept; other
    columns are ignored; an empty table writes no shard. Ids are 64-bit.
    """
    ship(spark)
    vocabulary = vocabulary or default_vocabulary()
    rows = _split_key(spark.read.parquet(source), id_col, text_col)
    room = F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / SEQUENCE) + 1
    parts = written(rows.groupBy("part").agg(F.sum(room).alias("n")), "parts")
    # One row for each file split: a running sum over a small table.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = written(parts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    if not total:
        return 0

    @F.pandas_udf("long")
    def permuted(address: pd.Series) -> pd.Series:
        return pd.Series(permute(address.to_numpy(), total, key))

    placed = sequences(rows, vocabulary).join(broadcast_if_small(parts.select("part", "first"), 1_000_000), "part")
    placed = placed.select(permuted(F.col("first") + F.col("place")).alias("at"), "record").withColumn("shard", F.expr(f"at div {SHARD}"))
    # Addresses are spread evenly, so that the bounds of equal ranges are known and no sample has to be taken.
    shards = -(-total // SHARD)
    n = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = placed.repartitionById(n, F.expr(f"cast(shard * {n} div {shards} as int)")).sortWithinPartitions("shard", "at")
    lines = ranged.select("shard", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("shard").option("lineSep", SEPARATOR).option("encoding", ENCODING).text(path)
    return shard_starts(spark, path).agg(F.sum("n")).first()[0]


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, n, first): records of each shard and its first slot, by the files' lengths alone."""
    files = spark.read.format("binaryFile").load(path).groupBy(F.col("shard").cast("long").alias("shard")).agg((F.sum("length") / STRIDE).cast("long").alias("n"))
    # One row for each shard of some megabytes: a running sum over a small table.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return files.select("shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def read_shards(spark: SparkSession, path: str, first_slot: int = 0, digest: bool = False) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq_no, n_tokens, ids or ids_sha256) in the shards from ``first_slot`` on.

    Each file is read once; shards before the first slot's aren't opened.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, content in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                grid = np.frombuffer(content, np.uint8).reshape(-1, STRIDE)
                head = np.ascontiguousarray(grid[:, : HEADER.itemsize]).view(HEADER)[:, 0]
                ids = np.ascontiguousarray(grid[:, HEADER.itemsize : -2]).view("<u2")
                place = np.arange(len(grid))
                keep = first + place >= first_slot
                lists = [i[:n] for i, n in zip(ids[keep], head["n"][keep], strict=True)]
                doc = head["doc"][keep].astype(np.int64)
                columns = {
                    "slot": pa.array(first + place[keep]),
                    "shard": pa.array(np.full(len(lists), shard, np.int64)),
                    "byte_offset": pa.array(place[keep] * STRIDE),
                    "doc_id": pa.array(doc, mask=doc == NO_ID),
                    "seq_no": pa.array(head["nth"][keep].astype(np.int32)),
                    "n_tokens": pa.array(head["n"][keep].astype(np.int32)),
                }
                if digest:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in lists], pa.string())
                else:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))
                yield pa.record_batch(list(columns.values()), names=list(columns))

    bounded_batches(spark)
    starts = shard_starts(spark, path).filter(F.col("first") + F.col("n") > first_slot)
    files = spark.read.format("binaryFile").load(path).select(F.col("shard").cast("long"), "content")
    files = files.join(broadcast_if_small(written(starts.select("shard", "first"), "starts"), 1_000_000), "shard").select("shard", "first", "content")
    return files.mapInArrow(run, SCHEMA + ("ids_sha256 string" if digest else "ids array<int>"))


SCHEMA = "slot long, shard long, byte_offset long, doc_id long, seq_no int, n_tokens int, "


def materialised(spark: SparkSession, source: str, key: int = KEY) -> DataFrame:
    """Write the shards of the Parquet table at ``source`` to a new folder of the shared ones and return what is read back
    from them, one row a sequence, with a digest in place of the ids (SHA-256 of the ids as 16-bit little-endian
    numbers). Nulls, repeated rows and empty tables: see ``materialise_files``."""
    path = fresh_path(spark, "shards")
    if not materialise_files(spark, source, path, key):
        return spark.createDataFrame([], SCHEMA + "ids_sha256 string")
    return read_shards(spark, path, digest=True)
