"""Prefix trie of conversations, by vertical bitmaps.

Conversations are dealt out by ranges of their ids and cut into shards of a bounded number of them. Within a shard each
(position, turn) has a bitmap of the conversations that hold it; going down from the root, the bitmap of a node
intersected with those of the next position gives its children, and set bits give counts and end lists. Nodes of all
shards meet by a hash of their path. Sums over subtrees are taken in the shards: a node's own share counts in the
shard of its smallest member alone, so that a node's sum is that of its local sums.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import bounded_batches, written

#: Conversations of a shard at most (bits of a bitmap), and turns after which one is cut before; one longer conversation is a shard.
CONVERSATIONS, TURNS = 1_024, 50_000
ROOT = bytes(16)
TURN = "conv_id long, pos int, h long, g long, n_bytes int"
LOCAL = "shard long, at int, up int, size int, key binary, parent binary, depth int, low long, n long, n_bytes int, ends string"
NODE = "key binary, depth int, low long, parent_low long, n long, n_children long, leaves long, saved long"


def digest_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, h, g, n_bytes): turns numbered from 1 by turn, null first, with 128 bits for role and text.

    Null roles and texts are empty; ties go by those bits; rows without an id take no part; other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(1), text, role).alias("g"), F.octet_length(text).alias("n_bytes")
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h", "g")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "h", "g", "n_bytes")


def _cut(conv: np.ndarray) -> int:
    """Rows of the next shard in ``conv`` (sorted ids), of which the last conversation may go on; 0 if it needs more."""
    starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
    if len(starts) > CONVERSATIONS:
        starts = starts[: CONVERSATIONS + 1]
    elif len(conv) < TURNS:
        return 0
    within = starts[starts <= TURNS]
    return int(within[-1]) if within[-1] else int(starts[1]) if len(starts) > 1 else 0


def _shard(conv: list[int], turns: list[bytes | None], sizes: list[int]) -> pa.RecordBatch:
    """The trie of one shard, nodes in the order of a walk from the root. A turn of None marks a conversation."""
    ids: list[int] = []
    paths: list[list[bytes]] = []
    postings: dict[tuple[int, bytes], int] = {}
    n_bytes: dict[bytes, int] = {}
    for c, turn, size in zip(conv, turns, sizes, strict=True):
        if not ids or ids[-1] != c:
            ids.append(c)
            paths.append([])
        if turn is None:
            continue
        paths[-1].append(turn)
        place = (len(paths[-1]), turn)
        postings[place] = postings.get(place, 0) | 1 << (len(ids) - 1)
        n_bytes[turn] = size
    ending: dict[int, int] = {}
    for k, path in enumerate(paths):
        ending[len(path)] = ending.get(len(path), 0) | 1 << k

    out: list[tuple] = []
    ups: list[int] = []
    stack = [((1 << len(ids)) - 1, 0, -1, ROOT, None, 0)]
    while stack:
        bits, depth, up, key, parent, size = stack.pop()
        ends, at = bits & ending.get(depth, 0), len(out)
        out.append((key, parent, depth, ids[(bits & -bits).bit_length() - 1], bits.bit_count(), size, ",".join(str(ids[k]) for k in _set_bits(ends)) if ends else None))
        ups.append(up)
        rest = bits ^ ends
        while rest:
            turn = paths[(rest & -rest).bit_length() - 1][depth]
            child = rest & postings[depth + 1, turn]
            stack.append((child, depth + 1, at, hashlib.blake2b(key + turn, digest_size=16).digest(), key, n_bytes[turn]))
            rest ^= child
    below = np.ones(len(out), np.int32)
    for k in range(len(out) - 1, 0, -1):
        below[ups[k]] += below[k]
    key, parent, depth, low, n, size, ends = zip(*out, strict=True)
    columns = [
        pa.array(np.full(len(out), ids[0])), pa.array(np.arange(len(out), dtype=np.int32)), pa.array(ups, pa.int32()), pa.array(below), pa.array(key, pa.binary()), pa.array(parent, pa.binary()),
        pa.array(depth, pa.int32()), pa.array(low, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int32()), pa.array(ends, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LOCAL.split(", ")])


def _set_bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of the shards of one partition, whose rows come by conversation and position."""

    def trie(part: pa.Table) -> pa.RecordBatch:
        pos, h, g = (part.column(c).to_pylist() for c in ("pos", "h", "g"))
        return _shard(part.column("conv_id").to_pylist(), [struct.pack("<qq", a, b) if p else None for p, a, b in zip(pos, h, g, strict=True)], part.column("n_bytes").to_pylist())

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < min(CONVERSATIONS, TURNS):
            continue
        table = pa.Table.from_batches(held)
        while end := _cut(table.column("conv_id").to_numpy()):
            yield trie(table.slice(0, end))
            table = table.slice(end)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield trie(pa.Table.from_batches(held))


def _subtrees(part: pa.Table) -> pa.Table:
    """Sums over each local subtree, and each node's parent's smallest member over all shards."""
    part = part.sort_by("at")
    up, size, low = (part.column(c).to_numpy() for c in ("up", "size", "low"))
    at = np.arange(len(up))

    def summed(name: str) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(part.column(name).to_numpy())])
        return pa.array(total[at + size] - total[at])

    over = pa.array(low[np.maximum(up, 0)], mask=up < 0)
    return pa.table({"key": part.column("key"), "depth": part.column("depth"), "low": part.column("low"), "parent_low": over, "n": part.column("n"), "n_children": part.column("n_children"), "leaves": summed("leaf"), "saved": summed("saved")})


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end lists, which come in the order of nodes and shards; one list is held at a time."""
    key, state = None, None
    names = ["key", "ends_sha256"]
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ends.encode())
                continue
            if key is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=names)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: (key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has (conv_id, pos, h, g, n_bytes); positions only give the order, and a row at position 0 marks a
    conversation, with turns or without. ``key`` is a 128-bit hash of the node's path, ``conv_id`` its smallest member,
    ``ends_sha256`` the digest of the members without a further turn. Without conversations there are no nodes. A
    shard holds at most 1,024 conversations; a conversation's turns, 24 bytes each, are held together.
    """
    spark = turns.sparkSession
    ship(spark)
    bounded_batches(spark)
    local = written(turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_shards, LOCAL), "tries")
    nodes = local.groupBy("key").agg(F.any_value("parent").alias("parent"), F.min("low").alias("low"), F.sum("n").alias("n"))
    nodes = written(nodes, "nodes")
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    known = nodes.drop("parent").join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))

    own = F.col("low") == F.col("local_low")
    shares = local.select("shard", "at", "up", "size", "key", "depth", F.col("low").alias("local_low"), "n_bytes").join(known, "key").select(
        "shard", "at", "up", "size", "key", "depth", "low", "n", "n_children",
        F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(own, (F.col("n") - 1) * F.col("n_bytes")).otherwise(0).cast("long").alias("saved"),
    )
    parts = shares.groupBy("shard").applyInArrow(_subtrees, NODE)
    one = {"depth": "depth", "low": "conv_id", "parent_low": "parent_conv_id", "n": "n_convs", "n_children": "n_children"}
    whole = parts.groupBy("key").agg(*(F.max(a).cast("long").alias(b) for a, b in one.items()), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = local.filter("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_end_digests, "key binary, ends_sha256 string")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return whole.join(ends, "key", "left").select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def _heads(conv_id: Column) -> Column:
    """How many turns a conversation takes over: the CRC-32 of its decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns come from the conversation of the next lower id that 5 divides, with their marks.

    Negative ids take the remainder that isn't negative. Repeated rows are turns of their own.
    """
    ids = turns.select("conv_id").distinct()
    source = turns.filter((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("pos") <= 8))
    takers = source.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select(F.try_add("conv_id", "step").alias("conv_id"), "pos", "h", "g", "n_bytes")
    taken = takers.filter(F.col("pos") <= _heads(F.col("conv_id")))
    own = turns.filter(F.col("pos") > _heads(F.col("conv_id")))
    marks = ids.select("conv_id", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("n_bytes"))
    return taken.join(ids, "conv_id", "left_semi").unionByName(own).unionByName(marks)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt ``conversations``, without its keys."""
    return prefix_trie(rebuilt(written(digest_turns(conversations), "turns"))).drop("key")


ORACLE = """
WITH crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)
  )
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT ids.conv_id, pos, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id - ids.conv_id % 5 AND pos <= h
  UNION ALL SELECT conv_id, pos, role, text FROM ids JOIN t USING (conv_id) WHERE pos > h
), p AS (
  SELECT conv_id, row_number() OVER w AS d, strlen(text) AS b, md5(array_to_string(list(md5(role || chr(1) || text)) OVER w, ',')) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), n AS (SELECT node, min(d) AS d, min(b) AS b, min(conv_id) AS low, count(*) AS n FROM p GROUP BY node),
up AS (SELECT n.*, q.node AS parent FROM n LEFT JOIN p q ON q.conv_id = n.low AND q.d = n.d - 1),
kids AS (SELECT parent, count(*) AS kids FROM up GROUP BY parent),
f AS (SELECT up.*, coalesce(kids, 0) AS kids FROM up LEFT JOIN kids ON kids.parent = up.node),
s AS (SELECT a.node, count(*) FILTER (f.kids = 0) AS leaves, sum((f.n - 1) * f.b) AS saved FROM f JOIN p a ON a.conv_id = f.low AND a.d <= f.d GROUP BY a.node),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM p JOIN l USING (conv_id, d) GROUP BY node)
SELECT f.low AS conv_id, f.d AS depth, g.low AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN e USING (node) LEFT JOIN n g ON g.node = f.parent
"""
