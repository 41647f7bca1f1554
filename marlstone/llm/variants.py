"""Spelling variants: words that one edit parts, by asymmetric q-chunks, and the commoner form that each follows.

Of two words at one edit, the shorter (or one of the same length) contributes two disjoint chunks, the first and the
second half; the other contributes its grams at the places where such a chunk can stand. One edit leaves one half whole,
at a shift of at most one. The half that holds the edit is chunked in the same way once more, so that a key is a half
and a quarter: it is held by few words where a half alone is held by thousands. What meets on a key is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, written

LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2
#: A letter of a run is left out where this divides its hash.
ODD_ONE = 97
#: Forms are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: A form has twice the count of its word, so that chains have 62 links at most, and six rounds of doubling reach their ends.
ROUNDS = 7


def _part(word: Column, start: Column | int, size: Column) -> Column:
    """``size`` code points from ``start`` (from 0)."""
    return F.substring(word, F.lit(start) + 1, size)


def _chunks(word: Column, n: Column, shift: int) -> list[Column]:
    """(half, quarter) of each way in which one edit can spare them, of a word of ``n`` code points; with a shift of 1,
    the grams of a word one longer that stand for them."""
    half, left, right = F.floor(n / 2).cast("int"), F.floor(n / 4).cast("int"), F.floor((n - F.floor(n / 2)) / 2).cast("int")
    first, second = _part(word, 0, half), _part(word, half + shift, half)
    return [
        F.struct(first.alias("half"), _part(word, half, right).alias("quarter")),
        F.struct(first.alias("half"), _part(word, half + right + shift, right).alias("quarter")),
        F.struct(second.alias("half"), _part(word, 0, left).alias("quarter")),
        F.struct(second.alias("half"), _part(word, left + shift, left).alias("quarter")),
    ]


def _keys(word: Column, n: Column, shift: int) -> list[Column]:
    return [F.struct(F.xxhash64(n, F.lit(k), c["half"], c["quarter"]).alias("key"), F.lit(k).alias("way"), F.lit(shift).alias("shift")) for k, c in enumerate(_chunks(word, n, shift))]


def _letters(word: Column) -> Column:
    """64 bits, one for the code points of each remainder: one edit changes two of them at most."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of different words of ``words`` (word, n) that one edit parts, once.

    Two words share up to four keys; the pair comes from the first way in which they agree.
    """
    sized = words.select("word", "n", F.length("word").alias("size"), _letters(F.col("word")).alias("bits"))
    sized = written(sized, "words")
    ones = sized.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), F.explode(F.array(*_keys(F.col("word"), F.col("size"), 0))).alias("x")).select("a", "a_n", "a_bits", "x.key")
    grams = F.concat(F.array(*_keys(F.col("word"), F.col("size"), 0)), F.when(F.col("size") > 0, F.array(*_keys(F.col("word"), F.col("size") - 1, 1))).otherwise(F.array().cast("array<struct<key:bigint,way:int,shift:int>>")))
    others = sized.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), F.explode(grams).alias("x")).select("b", "b_n", "b_bits", "x.*")
    likely = ((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2)
    met = ones.join(others, "key").filter(likely & (F.levenshtein("a", "b", 1) == 1))

    def first_way(shift: int) -> Column:
        n = F.length("a")
        same = [x["half"].eqNullSafe(y["half"]) & x["quarter"].eqNullSafe(y["quarter"]) for x, y in zip(_chunks(F.col("a"), n, 0), _chunks(F.col("b"), n, shift), strict=True)]
        return F.coalesce(*(F.when(s, k) for k, s in enumerate(same)))

    return met.filter(F.col("way") == F.when(F.col("shift") == 0, first_way(0)).otherwise(first_way(1))).select("a", "a_n", "b", "b_n")


def _ends(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): links are followed by doubling, each round written."""
    at = written(forms.select("word", F.col("form").alias("root")), "links")
    for _ in range(ROUNDS):
        step = broadcast_if_small(at.select(F.col("word").alias("root"), F.col("root").alias("next")), BROADCAST_ROWS)
        at = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if at.filter("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n), distinct words with their counts.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of the largest
    count (ties: smallest in code-point order) if that is at least ``ratio`` (over 1) times the word's, else null;
    ``root`` follows forms to the last. Words of any length are compared whole. A null word takes no part.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, as chains of forms must end")
    words = written(words.filter(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "counts")
    pairs = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("n")))).alias("x")).select("x.*")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("least"), F.col("near"))).alias("best"))
    leads = -F.col("best.least") >= F.col("n") * ratio
    told = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.least")).alias("form_n")), "forms")
    out = told.join(_ends(told.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least_chars`` code points with at least ``least_count`` occurrences in all texts.

    Words are the runs of letters up to U+00FF, A-Z in lower case; where 97 divides the CRC-32 of id and run, the run
    loses the code point at that hash modulo its length. Null texts have no words; a null id counts as an empty one;
    repeated rows count each; texts and runs of any length are taken whole; other columns are ignored.
    """
    runs = F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), r"[^A-Za-zÀ-ÿ]+")
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda r: F.length(r) >= least_chars)).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    size = F.length("run")
    cut = F.overlay("run", F.lit(""), (F.col("h") % size + 1).cast("int"), F.lit(1))
    words = each.select(F.when(F.col("h") % ODD_ONE == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def document_variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of ``docs``."""
    return spelling_variants(document_words(docs))


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)
  )
), runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), hashed AS (
  SELECT run, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END))),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM runs, crc WHERE length(run) >= 5
), cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
), words AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word
), near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS best, max(n) AS best_n FROM pairs JOIN words ON words.word = pairs.b GROUP BY a),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chain AS (
  SELECT word, form, 1 AS step FROM told WHERE form IS NOT NULL
  UNION ALL SELECT c.word, t.form, step + 1 FROM chain c JOIN told t ON t.word = c.form WHERE t.form IS NOT NULL
), last AS (SELECT word, arg_max(form, step) AS root FROM chain GROUP BY word)
SELECT t.word, t.form, coalesce(last.root, t.word) AS root, t.n, t.n_near, t.form_n FROM told t LEFT JOIN last USING (word)
"""
