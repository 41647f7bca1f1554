"""SimHash near-duplicates found by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 31 and 33 bits. Two fingerprints that differ in at most 4 bits differ
in at most 2 bits of the first block or in at most 1 bit of the second one. In each block the codewords of a
Hamming code are the anchors: every block value lies within one bit of its home anchor, so a partner within t bits
lies within t + 1 bits of that anchor. Each fingerprint is sent to its home anchor and, as a visitor, to every
anchor within t + 1 bits; homes and visitors of an anchor are compared over all 64 bits. The number of copies
(about 176 for each distinct fingerprint) doesn't depend on the data.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, free_name, map_columns, salted_join, written
from .graph import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
CHUNK = 1 << 15
Blocks = tuple[tuple[int, int, int], ...]
#: (first bit, bits, bits that the two may differ in): thresholds 2 and 1 cover every split of 4 differing bits.
BLOCKS: Blocks = ((0, 31, 2), (31, 33, 1))
#: Bits of a block that the Hamming code covers; the others must agree with the anchor or count as an error.
CODE_BITS = 31


def fingerprint(text: bytes | None, shingle: int = 4) -> bytes:
    """8 bytes, most significant first. No words: zeros. Fewer words than a shingle has: the sequence is the one shingle."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        starts, ends = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, len(starts), CHUNK):
        packed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(starts)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) of every row; a null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = b"".join([fingerprint(x, shingle) for x in as_bytes(batch.column(1))])
        return pa.record_batch([batch.column(0), pa.array(np.frombuffer(packed, ">i8").astype(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"id {kind}, fp long", run)


def _syndrome(bits: tuple[int, ...]) -> int:
    out = 0
    for b in bits:
        if b < CODE_BITS:
            out ^= b + 1
    return out


def anchor_errors(spark: SparkSession, blocks: Blocks = BLOCKS) -> DataFrame:
    """(slot, error): slot is block * 32 + syndrome; value XOR error is an anchor in reach. 5,554 rows, whatever the data.
    A block shorter than the code is one whose missing bits are zero; its anchors may have them set."""
    rows = []
    for block, (_, bits, differ) in enumerate(blocks):
        for weight in range(differ + 2):
            rows += [(block * 32 + _syndrome(e), sum(1 << b for b in e)) for e in combinations(range(max(bits, CODE_BITS)), weight)]
    return spark.createDataFrame(rows, "slot int, error long")


def _block(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _slot(value: Column, block: int) -> Column:
    out = F.lit(block * 32)
    for j in range(5):
        mask = sum(1 << b for b in range(CODE_BITS) if (b + 1) >> j & 1)
        out = out + F.bit_count(value.bitwiseAND(F.lit(mask))) % 2 * (1 << j)
    return out.cast("int")


def _home_error(slot: Column) -> Column:
    return F.when(slot % 32 == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), slot % 32 - 1))


def close_pairs(values: DataFrame, limit: int = 4, blocks: Blocks = BLOCKS) -> DataFrame:
    """(fp) distinct -> (a, b) with a < b for each two that differ in 1 to ``limit`` bits, at most as many as the blocks cover.

    Homes and visitors meet in a shuffled equi-join on the anchor; only close pairs leave the join.
    """
    if limit > (covered := sum(differ + 1 for *_, differ in blocks) - 1):
        raise ValueError(f"the blocks cover up to {covered} differing bits")
    errors = F.broadcast(anchor_errors(values.sparkSession, blocks))
    cuts = [_block(F.col("fp"), first, bits) for first, bits, _ in blocks]
    parts = F.array(*[F.struct(F.lit(k).alias("block"), value.alias("value"), _slot(value, k).alias("slot")) for k, value in enumerate(cuts)])
    cut = values.select("fp", F.explode(parts).alias("p")).select("fp", "p.*")
    key = F.col("value").bitwiseXOR(F.col("error")).bitwiseOR(F.col("block").cast("long") * F.lit(1 << 40))
    home = cut.withColumn("error", _home_error(F.col("slot"))).select(key.alias("key"), F.col("fp").alias("a"))
    visit = cut.join(errors, "slot").select(key.alias("key"), F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)
    return home.join(visit, "key").filter(close).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Rows of one fingerprint form one node, so exact copies, however many, cost one comparison. ``component_id`` is
    the smallest id reachable by links of at most ``limit`` differing bits, the row's own included. Null and empty
    texts have fingerprint zero and are linked like any other; repeated rows stay; a null id never becomes the
    smallest one (a component of null ids only has a null one). Other columns are ignored. Empty in, empty out.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(close_pairs(nodes.select("fp"), limit))
    least = roots.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = salted_join(roots, least, ["root"], ["node"]).select(F.col("node").alias("fp"), "component_id")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = salted_join(prints, labels, ["fp"], ["id"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose (id, hash of the text) is one of ``chosen`` (id, h); one of repeated rows. All columns stay."""
    h, own = free_name(docs.columns, "row_hash"), free_name(docs.columns, "row_id")
    keys = chosen.select(F.col("id").alias(own), F.col("h").alias(h))
    rows = docs.withColumns({h: F.xxhash64(text_col), own: F.col(id_col)})
    kept = rows.join(keys, (rows[h] == keys[h]) & rows[own].eqNullSafe(keys[own]), "left_semi")
    return kept.dropDuplicates([h, own]).select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """One row of each group of near duplicates, with all columns: the one with the smallest id (a null id first;
    among equal ids the smaller hash of the text; one of repeated rows). Null and empty texts are copies of each other;
    very long texts are taken whole; columns may have any names; an empty table gives an empty result."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    found = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle, limit)
    chosen = written(found.filter(F.col("key").eqNullSafe(F.col("component_id"))).select("key.id", "key.h").distinct(), "chosen")
    return keep_rows(docs, chosen, id_col, text_col)
