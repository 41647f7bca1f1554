"""Line deduplication over a corpus, in DataFrame functions only.

Lines are exploded, normalised and hashed; hashes that enough distinct documents hold are common, and a common line
stays in the document of the largest id alone. Texts are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, lower_ascii, written
from .decontam import row_key

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Common lines are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text: Column, least_chars: int) -> Column:
    """(place from 0, h, g) of the lines whose key has ``least_chars`` code points or more."""
    line = F.transform(lines_of(lower_ascii(text)), lambda x, k: F.struct(k.alias("place"), F.btrim(x, F.lit(SPACES)).alias("key")))
    long = F.filter(line, lambda x: F.length(x["key"]) >= least_chars)
    return F.transform(long, lambda x: F.struct(x["place"].alias("place"), F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(1), x["key"]).alias("g")))


def common_lines(docs: DataFrame, least_chars: int, least_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, place, h, g, last) for each line whose key at least ``least_docs`` documents hold; ``last`` is the
    largest id of them.

    Rows are counted first, as that needs one shuffle of partial counts; documents are counted apart for the keys that
    reach the threshold by rows.
    """
    row = row_key(F.col(id_col), F.col(text_col))
    held = docs.select(F.col(id_col).alias("id"), row.alias("row"), _keys(F.col(text_col), least_chars).alias("keys"))
    once = held.select(F.explode(F.array_distinct(F.transform("keys", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))).alias("x"))
    often = written(once.groupBy("x.h", "x.g").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("h", "g"), "often")
    each = held.select("row", "id", F.explode("keys").alias("x")).select("row", "id", "x.*")
    met = written(_joined(each, often), "met")
    # Two steps: the documents of a hot line are dealt out before they are counted.
    counted = met.groupBy("h", "g", "id").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    return _joined(met, written(counted.filter(F.col("n") >= least_docs).select("h", "g", "last"), "common"))


def _joined(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """A hot line's rows meet one row of ``keys``: where that is too large to broadcast, Spark splits the hot partition."""
    return lines.join(broadcast_if_small(keys, BROADCAST_ROWS), ["h", "g"])


def drop_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All rows and columns of ``docs`` with the lines left in ``text_col``, and how many lines there were and went.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of ``least_chars`` code points or
    more in at least ``least_docs`` documents (distinct ids) lose their lines but in the largest id; equal keys are those
    of equal 128-bit hashes. Null and empty texts are one empty line and come back empty; a text that loses all lines is
    empty; texts of any length are taken whole. Repeated rows are one document and share their fate, as do rows of one id
    with other texts; rows without an id are one document, less than any other. Columns of any names stay, but
    the two counts must be new names (``ValueError``). An empty table gives an empty result.
    """
    if taken := {c.lower() for c in docs.columns} & {n_lines.lower(), n_dropped.lower()}:
        raise ValueError(f"columns {sorted(taken)} are there already; name the counts otherwise")
    found = common_lines(docs, least_chars, least_docs, id_col, text_col)
    gone = found.filter("id is null or id < last").groupBy("row").agg(F.collect_set("place").alias("gone"))
    key, places = free_name(docs.columns, "row_key"), free_name(docs.columns, "gone_places")
    both = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))).join(gone.select(F.col("row").alias(key), F.col("gone").alias(places)), key, "left")
    gone_or_none, text = F.col(f"`{places}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def reassembled(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_or_none)
        return F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")

    # One-element array: the lines are split once and bound to a name.
    made = F.transform(F.array(lines_of(F.col(f"`{text_col}`"))), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.when(gone_or_none.isNull(), text).otherwise(reassembled(x)).alias("text")))
    built = free_name([*docs.columns, key, places], "built")
    both = both.withColumn(built, F.get(made, F.lit(0)))
    kept = [F.col(f"`{built}`.text").alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns]
    dropped = F.when(gone_or_none.isNull(), 0).otherwise(F.size(gone_or_none)).cast("long")
    return both.select(*kept, F.col(f"`{built}`.n").alias(n_lines), dropped.alias(n_dropped))


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``."""
    out = drop_common_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS place FROM d),
k AS (
  SELECT doc_id, place, lines[place] AS line,
    translate(trim(lines[place], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e
), common AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, place, line, last IS NOT NULL AND k.doc_id < last AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
