"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of a text are hashed, k consecutive word hashes give a k-gram hash, and of every w consecutive k-grams the
least hash is kept. Any run of k + w - 1 words that a document shares with a benchmark item then holds a kept
k-gram that both have. Kept k-grams of documents are joined with those of the items; around each hit the windows
that cover it are extended to their full text and joined with the items' windows, so that results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, written

WINDOW = 10
#: The benchmark's fingerprints and windows are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents without a hit travel on one of these keys, so that none of them gets hot.
SENTINELS = 1024


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case; null has none."""
    whole = F.coalesce(text, F.lit(""))
    low = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_size(window: int) -> int:
    """k of the k-grams for windows of so many words; w is window - k + 1."""
    return (window + 1) // 2


def _grams(hashes: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - k + 1), lambda i: F.xxhash64(F.slice(hashes, i, k)))


def winnowed(hashes: Column, window: int) -> Column:
    """Distinct places (from 1) of the kept k-grams in an array of at least ``window`` word hashes, with their hashes."""
    k = gram_size(window)
    w = window - k + 1
    grams = _grams(hashes, k)

    def kept(g: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.size(g) - w + 1), lambda i: _leftmost(F.slice(g, i, w), i))
        return F.transform(F.array_distinct(least), lambda p: F.struct(p.cast("int").alias("p"), F.element_at(g, p.cast("int")).alias("h")))

    # One-element array and transform: the k-grams are computed once and bound to a name.
    return F.flatten(F.transform(F.array(grams), kept))


def _leftmost(part: Column, first: Column) -> Column:
    return first + F.array_position(part, F.array_min(part)) - 1


def _hits_of(starts: Column) -> Column:
    """Words covered by windows, given as an array of (s, e)."""
    folded = F.aggregate(
        F.array_sort(starts),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).cast("long").alias("n")),
    )
    return folded["n"]


def row_key(id_: Column, text: Column) -> Column:
    """128 bits that stand for a row: equal rows share them, which is all the same to their result."""
    return F.struct(F.xxhash64(id_, text).alias("h"), F.xxhash64(F.lit(1), text, id_).alias("g"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. Document words inside any
    occurrence of a window are hit. Null and empty texts have no words and no hits; repeated rows stay and each gets
    the same result; items with a null id make hits but aren't listed; an empty benchmark or table is no error;
    other columns are ignored.
    """
    tests = written(items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).filter(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(window))), "items")
    widths = sorted(r["width"] for r in tests.select("width").distinct().collect())  # at most ``window`` values

    spread = tests.select("item", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: F.array_join(F.slice("words", i, F.col("width")), " "))).alias("gram")).distinct()
    windows = broadcast_if_small(spread.select("gram").distinct(), BROADCAST_ROWS)

    hashed = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    tagged = [F.when(F.col("width") == n, winnowed(F.col("hashes"), n)) for n in widths]
    sentinels = docs.sparkSession.range(SENTINELS).select(F.col("id").alias("h"), F.lit(0).alias("width"))
    kept = sentinels
    if widths:
        kept = tests.withColumn("hashes", hashed).select("width", F.explode(F.coalesce(*tagged)).alias("f")).select(F.col("f.h").alias("h"), "width").distinct().unionByName(sentinels)
    kept = broadcast_if_small(written(kept, "kept"), BROADCAST_ROWS)

    # First pass over the texts: kept k-grams that the benchmark has too, and one row for each document.
    key = row_key(F.col(id_col), F.col(text_col))
    base = docs.select(F.col(id_col), key.alias("key"), words_of(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", hashed)
    nothing = F.array().cast("array<struct<p:int,h:bigint>>")

    def prints(n: int) -> Column:
        found = F.when(F.size("hashes") >= n, winnowed(F.col("hashes"), n)).otherwise(nothing)
        return F.transform(found, lambda f: F.struct(F.lit(n).alias("width"), f["p"].alias("p"), f["h"].alias("h")))

    parts = [prints(n) for n in widths]
    mark = F.array(F.struct(F.lit(0).alias("width"), F.lit(0).alias("p"), F.pmod(F.col("key.h"), F.lit(SENTINELS)).alias("h")))
    seen = base.select(id_col, "key", "n_words", F.explode(F.concat(mark, *parts)).alias("f")).select(id_col, "key", "n_words", "f.*")
    met = written(seen.join(kept, ["h", "width"]).select(id_col, "key", "n_words", "width", "p"), "met")

    # Second pass, over documents with such a k-gram only: the windows around it, as text.
    places = written(met.filter("p > 0").groupBy("key").agg(F.collect_set(F.struct("width", "p")).alias("places")), "places")
    again = docs.select(key.alias("key"), F.col(text_col).alias("text")).join(places, "key").select("key", "places", words_of(F.col("text")).alias("words"))

    def around(f: Column) -> Column:
        reach = f["width"] - F.floor((f["width"] + 1) / 2).cast("int")
        first = F.greatest(F.lit(1), f["p"] - reach)
        last = F.least(f["p"], F.size("words") - f["width"] + 1)
        return F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda s: F.struct(s.alias("s"), (s + f["width"]).alias("e")))

    spans = again.select("key", "words", F.explode(F.array_distinct(F.flatten(F.transform("places", around)))).alias("x"))
    text = F.array_join(F.slice("words", F.col("x.s"), F.col("x.e") - F.col("x.s")), " ")
    found = written(spans.select("key", "x", text.alias("gram")).join(windows, "gram").distinct(), "found")

    hit = found.groupBy("key").agg(F.collect_set("x").alias("xs")).select("key", _hits_of(F.col("xs")).alias("n_hit"))
    listed = found.select("key", "gram").distinct().join(spread.select("gram", "item"), "gram").filter("item is not null").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("names"))
    found_rows = written(hit.join(listed, "key", "left"), "hits")
    rows = met.filter("p = 0").select(id_col, "key", "n_words")
    out = rows.join(found_rows, "key", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        id_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns.

    Null and empty texts stay, repeated rows share their fate, an empty benchmark leaves all rows, and an empty table
    is no error. Columns may have any names.
    """
    name = free_name(docs.columns, "row_key")
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g"))
    found = contamination(docs.select(row.alias("row_key"), F.col(text_col).alias("text")), items, window, "row_key", "text")
    bad = written(found.filter("contaminated").select("row_key").distinct(), "contaminated").select(F.col("row_key").alias(name))
    return docs.withColumn(name, row).join(bad, name, "left_anti").drop(name)


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS gram FROM b WHERE len(w) > 0
), widths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
  FROM d, widths WHERE len(w) >= n
), hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (gram, n)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
