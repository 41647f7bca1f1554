"""Near duplicates by the Jaccard similarity of their word shingles: the anchors of ``simhash`` and MinHash bands find
candidates, exact sets decide.

The words are those of ``simhash``. Texts of the same words form one node. Nodes whose SimHash fingerprints, over the same
shingles as the sets, are linked by 4 or fewer differing bits form an anchor bucket (``simhash.close_pairs``). A similarity
of 0.8 leaves 10 of 64 bits different, which no bounded number of anchors reaches, so that a node also has ``BANDS`` band
keys, which each hash ``ROWS`` minima over its distinct shingles; two nodes with a similarity of 0.8 miss each other in all
bands with a probability of (1 - 0.8 ** 6) ** 24, under 0.001. No candidate becomes a link before the two sets are compared.

A bucket's members are first compared with a few of its nodes, so that a large group of near copies costs a number
of comparisons that grows with the group, not with its square: those that share most buckets (near the text that the
others were copied from), and some by hash. Members of one component need no more comparisons. For the nodes of buckets
that still hold several components a prefix filter is exact: with shingles ordered from rare to common, two similar
sets share one early enough in both that as many as they must share can still follow. Copies that were changed too much
begin with shingles that no other text has, so that borderline groups leave few pairs to compare.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, broadcast_if_small, map_columns, salted_join, written
from .graph import connected_components
from .simhash import LOWER, SEED, close_pairs, fingerprint, keep_rows

SHINGLE = 5
#: Least similarity of near duplicates, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 24, 6
#: Blocks of a fingerprint for the anchors: 4 differing bits leave at most 1 in either long block, or none in the short one. That
#: takes 35 copies of a fingerprint, where the blocks of ``simhash`` take 178; a stage has the disk for the bands besides.
ANCHORED = ((0, 24, 1), (24, 24, 1), (48, 16, 0))
#: Nodes of a bucket that all its members are compared with before components are known: by hash, and most central ones.
PIVOTS, HUBS = 2, 2
#: Sets are binned by size; a bin's sizes differ by this factor at most.
BIN = 1.06
#: Hashes worked on at once, and pairs of one node that meet in one task.
CHUNK, DEALT = 256, 256

_random = np.random.default_rng(SEED)
FACTOR = (_random.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
OFFSET = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def joined_words(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(LOWER).split())


def shingles(joined: bytes) -> set[bytes]:
    """Distinct shingles. Fewer words than a shingle has: the sequence is the one shingle; no words: none."""
    if not joined:
        return set()
    size = np.fromiter(map(len, joined.split(b" ")), np.int64)
    if len(size) <= SHINGLE:
        return {joined}
    end = np.cumsum(size + 1) - 1
    return {joined[a:b] for a, b in zip((end - size)[: len(size) - SHINGLE + 1].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)}


def band_keys(joined: bytes) -> list[int]:
    """Signed band keys; none without words."""
    found = shingles(joined)
    if not found:
        return []
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) & 0xFFFFFFFF for s in found), np.uint32, len(found))
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[k : k + CHUNK] * FACTOR + OFFSET).min(axis=1), out=least)
    raw = least.tobytes()
    packed = b"".join(xxhash.xxh64_digest(raw[4 * ROWS * k : 4 * ROWS * (k + 1)], k) for k in range(BANDS))
    return np.frombuffer(packed, ">i8").tolist()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    up, down = SIMILAR
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    both = len(a & b)
    return both * down >= (len(a) + len(b) - both) * up


def _sketches(docs: DataFrame) -> DataFrame:
    """(key, text) -> (key, node, bands, fp); the node is the hash of the words, fp their fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [joined_words(x) for x in as_bytes(batch.column(1))]
        nodes, prints = (np.frombuffer(b"".join(x), ">i8").astype(np.int64) for x in ([xxhash.xxh64_digest(w, SEED) for w in words], [fingerprint(w, SHINGLE) for w in words]))
        return pa.record_batch([batch.column(0), pa.array(nodes), pa.array([band_keys(w) for w in words], pa.list_(pa.int64())), pa.array(prints)], names=["key", "node", "bands", "fp"])

    return map_columns(docs, ["key", "text"], f"key {docs.schema['key'].dataType.simpleString()}, node long, bands array<long>, fp long", run)


def _anchored(nodes: DataFrame) -> DataFrame:
    """(node, bucket): the anchor bucket of each node with words, named by its smallest fingerprint."""
    prints = nodes.filter(F.size("bands") > 0).select("node", "fp")
    roots = connected_components(close_pairs(prints.select("fp").distinct(), blocks=ANCHORED)).withColumnRenamed("node", "fp")
    return salted_join(prints, roots, ["fp"], ["node"], "left", salts=8).select("node", F.xxhash64(F.lit("anchors"), F.coalesce("root", "fp")).alias("bucket"))


def _with_text(pairs: DataFrame, texts: DataFrame, side: str, other: str) -> DataFrame:
    """The text of one side. A node with many pairs is dealt over tasks, and only its text is repeated for them."""
    many = pairs.groupBy(side).count().filter(F.col("count") > DEALT).select(side, F.ceil(F.col("count") / DEALT).alias("n"))
    many = broadcast_if_small(written(many, "many"), 100_000)
    salts = F.coalesce("n", F.lit(1).cast("long"))
    dealt = pairs.join(many, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts)).drop("n")
    copies = texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")).join(many, side, "left")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")
    return dealt.join(copies, [side, "salt"]).drop("salt")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes: the text of each node's least key."""
    rows = nodes.join(wanted, "node", "left_semi").select("node", F.col("least.id").alias("id"), F.col("least.h").alias("h"))
    rows = broadcast_if_small(written(rows, "wanted"), 200_000)
    texts = docs.join(rows, (docs["key.h"] == rows["h"]) & docs["key.id"].eqNullSafe(rows["id"])).select("node", "text")
    return written(texts.dropDuplicates(["node"]), "texts")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are similar."""
    texts = _texts(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), nodes, docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: dict[int, set[bytes]] = {}
        keep = []
        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
            for node, text in ((a, x), (b, y)):
                if node not in held:
                    if len(held) > 8:
                        held.clear()
                    held[node] = shingles(joined_words(text))
            keep.append(similar(held[a], held[b]) if a in held else similar(shingles(joined_words(x)), held[b]))
        mask = pa.array(keep, pa.bool_())
        return pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return map_columns(_with_text(_with_text(pairs, texts, "b", "a"), texts, "a", "b"), ["a", "b", "text_a", "text_b"], "a long, b long", run)


def _pivots(members: DataFrame) -> DataFrame:
    """(bucket, ys): the nodes of each bucket that its members are compared with. A node is the more central, the more
    nodes there are in its buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = salted_join(members, sizes, ["bucket"], ["node"], salts=8).groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "node").withColumn("r", F.struct("weight", F.col("node").alias("y")))
    top = [F.max("r").alias("t0")]
    found = weighed.groupBy("bucket").agg(*top, *[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("y"))).alias(f"p{k}") for k in range(PIVOTS)])
    names = ["t0", *[f"p{k}" for k in range(PIVOTS)]]
    for k in range(1, HUBS):
        rest = salted_join(weighed, found.select("bucket", F.col(f"t{k - 1}").alias("last")), ["bucket"], ["node"], salts=8).filter(F.col("r") < F.col("last"))
        found = found.join(rest.groupBy("bucket").agg(F.max("r").alias(f"t{k}")), "bucket", "left")
        names.append(f"t{k}")
    return found.select("bucket", F.array_distinct(F.array_compact(F.array(*[f"{n}.y" for n in names]))).alias("ys"))


def _bin(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(BIN)).cast("int")


def _filtered(open_: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, part) -> pairs (x, y) of nodes of different parts that may be similar; no similar pair is missed.

    Sets of n and m shingles are similar if they share at least 4 / 9 of n + m. In the order from rare to common, as
    many must follow the first shared one in both, that one included. A node meets nodes of each bin of sizes with
    those of its shingles that come early enough for the bin's least size; shingles that no other node has meet none.
    """
    up, down = SIMILAR
    share = up / (up + down)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted({xxhash.xxh64_intdigest(s, SEED) for s in shingles(joined_words(t))}) for t in as_bytes(batch.column(1))]
        size = [len(x) for x in found]
        take = pa.array(np.repeat(np.arange(len(found)), size))
        flat = np.fromiter((h for x in found for h in x), np.uint64, sum(size)).view(np.int64)
        return pa.record_batch([batch.column(0).take(take), pa.array(np.repeat(np.array(size, np.int32), size)), pa.array(flat)], names=["node", "n", "h"])

    texts = _texts(open_.select("node"), nodes, docs)
    each = written(map_columns(texts, ["node", "text"], "node long, n int, h long", run), "shingles")
    common = written(each.groupBy("h").agg(F.count("*").alias("seen")).filter("seen > 1"), "common")
    lists = salted_join(each, common, ["h"], ["node"], salts=8).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "h"))).alias("hs"))
    n, least = F.col("n"), F.ceil(F.col("n") * up / down)
    bins = F.sequence(_bin(least), _bin(F.floor(F.col("n") * down / up)))
    lists = lists.withColumn("bin", F.explode(bins)).withColumn("own", _bin(n))
    partner = F.greatest(least, F.floor(F.pow(F.lit(BIN), F.col("bin")) - 0.001))
    # Places from 0 on, those of a node's rare shingles first; "last" is the last one from which enough can follow.
    lists = lists.withColumn("first", n - F.size("hs")).withColumn("last", (n - F.ceil((n + partner) * share - 1e-6)).cast("int")).filter("last >= first")
    early = F.posexplode(F.slice("hs", 1, F.least(F.col("last") - F.col("first") + 1, F.size("hs"))))
    rows = lists.select("node", "n", "first", F.least("bin", "own").alias("lo"), F.greatest("bin", "own").alias("hi"), early.alias("i", "s"))
    rows = rows.select("node", "n", (F.col("first") + F.col("i")).alias("p"), F.col("s.h").alias("h"), "lo", "hi").join(open_, "node")
    key = ["h", "lo", "hi"]
    rows = written(rows, "prefixes")
    parts = rows.groupBy(*key, "part").agg(F.count("*").alias("c")).groupBy(*key).agg(F.count("*").alias("k"), F.max_by("part", F.struct("c", "part")).alias("largest"))
    met = written(salted_join(rows, parts.filter("k > 1").drop("k"), key, ["node"], salts=8), "met")
    small = met.filter("part <> largest").select(*key, F.col("node").alias("x"), F.col("part").alias("part_x"), F.col("n").alias("n_x"), F.col("p").alias("p_x"))
    enough = F.least(F.col("n") - F.col("p"), F.col("n_x") - F.col("p_x")) >= (F.col("n") + F.col("n_x")) * share - 1e-6
    both = salted_join(met, small, key, ["node"], salts=8).filter((F.col("part") != F.col("part_x")) & enough)
    return both.select("x", F.col("node").alias("y"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key (id, h), text) -> (node, least key) of all nodes, and (node, root) of those with a near duplicate."""
    prints = written(_sketches(docs), "sketches")
    nodes = written(prints.groupBy("node").agg(F.min("key").alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("bucket")).unionByName(written(_anchored(nodes), "anchored"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket")
    members = written(salted_join(bands, written(shared, "shared"), ["bucket"], ["node"], salts=8), "members")
    first = salted_join(members, written(_pivots(members), "pivots"), ["bucket"], ["node"], salts=8).select(F.col("node").alias("x"), F.explode("ys").alias("y"))
    compared = written(_ordered(first), "compared")
    roots = written(connected_components(_verified(compared, nodes, docs)), "roots")

    placed = written(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part")), "placed")
    split = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("bucket")
    open_ = written(salted_join(placed, written(split, "split"), ["bucket"], ["node"], salts=8).select("node", "part").distinct(), "open")
    rest = written(_ordered(_filtered(open_, nodes, docs)).join(compared, ["a", "b"], "left_anti"), "rest")
    late = written(_verified(rest, nodes, docs), "late")
    if late.isEmpty():
        return nodes, roots
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return nodes, connected_components(reduce(DataFrame.unionByName, [known, late]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns, chosen as in ``simhash.keep_one``. Null and empty
    texts are copies of each other; very long texts are compared whole; columns may have any names; an empty table gives an empty result."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    nodes, roots = components(docs.select(key.alias("key"), F.col(text_col).alias("text")))
    chosen = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("key"))
    return keep_rows(docs, written(chosen.select("key.id", "key.h"), "chosen"), id_col, text_col)
