"""Queries over messages and positions, in batches and through the stream, with SQL from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import fresh_path, written
from ..operators import hitlist, positions
from ..streaming import book_stream, streams
from .adapters import MESSAGES, position_events, raw_messages, read
from .desk_queries import DAY
from .registry import query, rounded
from .store_queries import in_parts

_SHARE = "CASE action WHEN 'close' THEN 1.0 WHEN 'trim' THEN coalesce(hint, 0.5) ELSE 0.0 END::DOUBLE AS share"


def _folded(source: str) -> str:
    """Positions of a table of messages: what is left is a running product, and a message counts while something is left."""
    return f"""f0 AS (
  SELECT *, {_SHARE}, count(*) FILTER (WHERE action = 'open') OVER (PARTITION BY key ORDER BY t_, message_id) AS grp FROM {source}
), f1 AS (
  SELECT *, coalesce(product(1 - share) OVER (PARTITION BY key, grp ORDER BY t_, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before
  FROM f0
), f2 AS (SELECT *, grp > 0 AND before >= 1e-6 AS live FROM f1),
f3 AS (
  SELECT key, arg_min(message_id, (t_, message_id)) AS open_id, arg_min(size_label, (t_, message_id)) AS size_label,
    arg_min(price, (t_, message_id)) AS entry_price, min(t_) AS entry_at, product(1 - share) AS p, sum(before * share * pct) AS realized, count(*) AS n_events,
    any_value(asset_type) AS asset_type, arg_min(hidden, (t_, message_id)) AS hidden, any_value(contract) AS contract, any_value(moderator) AS moderator
  FROM f2 WHERE live GROUP BY key, grp
), f4 AS (SELECT key, count(*) FILTER (WHERE NOT live AND action IN ('trim', 'close')) AS n_orphans FROM f2 GROUP BY 1),
pos AS (
  SELECT f3.* EXCLUDE (p), CASE WHEN p < 1e-6 THEN 0 ELSE p END::DOUBLE AS remaining, CASE WHEN p < 1e-6 THEN 'CLOSED' ELSE 'OPEN' END AS status, n_orphans
  FROM f3 JOIN f4 USING (key)
)"""


_POSITION = """key, open_id, size_label, round(entry_price, 6) AS entry_price, entry_at, round(remaining, 6) AS remaining,
  round(realized, 6) + 0.0 AS realized, status, CAST(n_events AS INTEGER) AS n_events"""


@query(
    "r5_positions",
    f"WITH {MESSAGES}, {_folded('msg')} SELECT {_POSITION}, CAST(n_orphans AS INTEGER) AS n_orphans, asset_type, moderator, hidden FROM pos",
)
def r5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(positions.stitch_positions(position_events(spark, sf_dir)))
    out = out.withColumns({"entry_at": F.col("entry_at").cast("timestamp_ntz"), "realized": F.col("realized") + 0.0})
    return out.select("key", "open_id", "size_label", "entry_price", "entry_at", "remaining", "realized", "status", "n_events", "n_orphans", "asset_type", "moderator", "hidden")


@query(
    "r5_position_events",
    f"""WITH {MESSAGES}, {_folded('msg')}, e AS (
  SELECT *, first_value(message_id) OVER (PARTITION BY key, grp ORDER BY t_, message_id) AS open_id,
    row_number() OVER (PARTITION BY key, grp ORDER BY t_, message_id) AS place
  FROM f2 WHERE live
) SELECT open_id, CAST(place AS INTEGER) AS place, action, round(price, 6) AS price, CASE WHEN share > 0 THEN round(before * share, 6) END AS frac_closed,
  CASE WHEN share > 0 THEN pct END AS pct, message_id FROM e""",
)
def r5_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of events of every position, one row each."""
    p = positions.stitch_positions(position_events(spark, sf_dir).select("key", *positions.MESSAGE))
    out = p.select("open_id", F.posexplode("events").alias("place", "e")).select("open_id", (F.col("place") + 1).alias("place"), "e.action", "e.price", "e.frac_closed", "e.pct", "e.message_id")
    return rounded(out)


@query(
    "r6_messages",
    r"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (
  SELECT event_id AS id, ts AS t_, CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'add' WHEN 'click' THEN 'trim' WHEN 'purchase' THEN 'close'
  END AS action,
    CASE k % 7 WHEN 0 THEN 'spy 400c' WHEN 1 THEN ' QQQ  350.5 P ' WHEN 2 THEN 'AMD' WHEN 3 THEN 'SPY 400 calendar' WHEN 4 THEN 'BRK.B 10p'
      WHEN 5 THEN '$TSLA 200c' ELSE 'LONGNAME 5c' END AS contract,
    CASE k % 6 WHEN 0 THEN '7/20' WHEN 1 THEN '1/3' WHEN 2 THEN '2/30' WHEN 3 THEN '12/19/25' WHEN 4 THEN 'next week' ELSE '' END AS expiration,
    CASE k % 5 WHEN 0 THEN '$1,0' || (event_id % 90 + 10) WHEN 1 THEN '.85' WHEN 2 THEN '$.85' WHEN 3 THEN 'n/a' ELSE '12.' END AS entry_price,
    CASE k % 4 WHEN 0 THEN '2.50' WHEN 1 THEN '$0.05 each' WHEN 3 THEN '1e1' END AS exit_price,
    CASE k % 3 WHEN 0 THEN 12.5 WHEN 1 THEN -3 END::DOUBLE AS pct,
    CASE k % 6 WHEN 0 THEN 'Large' WHEN 1 THEN 'Large' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Lotto' ELSE 'Small' END AS size_label,
    CASE WHEN k % 5 = 0 THEN 0.25 WHEN event_type = 'click' THEN 0.5 WHEN k % 5 = 1 THEN 0.333333 WHEN k % 5 = 4 THEN 0.25 END::DOUBLE AS hint,
    CASE WHEN user_id % 5 > 0 THEN 'mod' || (user_id % 5) ELSE 'unknown' END AS moderator, user_id % 2 = 0 AS options
  FROM e
), p AS (
  SELECT *, regexp_matches(contract, '^\s*[A-Za-z.]{1,6}\s+\d+(\.\d+)?\s*[cCpP]\s*$') AS opt, regexp_matches(contract, '^\s*[A-Za-z.]{1,6}\s*$')
  AND NOT options AS eq,
    TRY_CAST(regexp_extract(regexp_replace(CASE WHEN action IN ('open', 'add') THEN entry_price ELSE exit_price END, '[$,]', '', 'g'),
      '^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)', 1) AS DOUBLE) AS price,
    TRY_CAST(regexp_extract(expiration, '^(\d{1,2})/(\d{1,2})', 1) AS INTEGER) AS m, TRY_CAST(regexp_extract(expiration, '^(\d{1,2})/(\d{1,2})',
  2) AS INTEGER) AS d
  FROM r WHERE action IS NOT NULL
), x AS (
  SELECT *, CASE WHEN m IS NULL THEN NULL WHEN expiration LIKE '%/25' THEN DATE '2025-01-01' ELSE make_date(year(t_), 1, 1) END AS y FROM p WHERE (opt OR eq)
  AND price IS NOT NULL
), z AS (SELECT *, CAST(y + to_months(m - 1) AS DATE) + (d - 1) AS this FROM x)
SELECT id, action, CASE WHEN opt THEN upper(regexp_extract(contract, '([A-Za-z.]{1,6})', 1)) ELSE upper(trim(contract)) END AS ticker,
  CASE WHEN opt THEN CAST(regexp_extract(contract, '\s(\d+(\.\d+)?)', 1) AS DOUBLE) END AS strike,
  CASE WHEN NOT opt THEN 'LONG' WHEN upper(trim(contract)) LIKE '%C' THEN 'CALL' ELSE 'PUT' END AS side,
  CASE WHEN expiration NOT LIKE '%/25' AND this < t_ - INTERVAL 7 DAY THEN CAST(y + INTERVAL 1 YEAR + to_months(m - 1) AS DATE) + (d - 1) ELSE this
  END AS expiry,
  round(price, 6) AS price, pct, CASE WHEN action = 'open' THEN size_label END AS size_label, hint AS frac_hint, moderator
FROM z""",
)
def r6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as events; odd contracts, prices without a leading zero, days beyond a month's end and years left out."""
    return rounded(positions.parse_messages(raw_messages(spark, sf_dir)).select("id", "action", "ticker", "strike", "side", "expiry", "price", "pct", "size_label", "frac_hint", "moderator"))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = position_events(spark, sf_dir)
    expiry = F.date_add(F.lit("2024-01-14").cast("date"), (F.max("message_id") % 9).cast("int"))
    marks = messages.groupBy("key").agg(F.max_by("price", "message_id").alias("mark"), expiry.alias("expiry"))
    return positions.price_positions(positions.stitch_positions(messages.drop("expiry")), marks, F.lit(DAY).cast("date"))


PRICED = f"""{MESSAGES}, {_folded('msg')}, mk AS (
  SELECT key, arg_max(price, message_id) AS mark, DATE '2024-01-14' + CAST(max(message_id) % 9 AS INTEGER) AS expiry FROM msg GROUP BY 1
), p1 AS (SELECT pos.*, mark, status = 'OPEN' AND expiry < DATE '{DAY}' AS expired FROM pos LEFT JOIN mk USING (key)),
p2 AS (
  SELECT *, CASE WHEN status = 'OPEN' THEN (CASE WHEN expired THEN coalesce(mark, 0) ELSE mark END - entry_price) / nullif(entry_price, 0) * 100 END AS live
  FROM p1
), priced AS (
  SELECT key, open_id, entry_at, asset_type, hidden, contract, moderator, CASE WHEN expired THEN realized + remaining * coalesce(live, 0) ELSE realized
  END AS realized,
    CASE WHEN expired THEN 0 ELSE remaining END AS remaining, CASE WHEN expired THEN 'CLOSED' ELSE status END AS status, live,
    CASE size_label WHEN 'Large' THEN 0.1 WHEN 'Medium' THEN 0.05 WHEN 'Lotto' THEN 0.005 ELSE 0.01 END AS w
  FROM p2
), p3 AS (SELECT *, w::DOUBLE * (realized + remaining * coalesce(live, 0)) AS delta FROM priced)"""


@query(
    "r7_a21_position_stats",
    f"""WITH {PRICED} SELECT asset_type, round(coalesce(sum(delta) FILTER (WHERE status = 'OPEN'), 0), 6) AS open_book_pct,
  round(coalesce(avg(live) FILTER (WHERE status = 'OPEN'), 0), 6) AS mean_live_pct,
  round(coalesce(avg((realized > 0)::INT) FILTER (WHERE status = 'CLOSED'), 0), 6)::DOUBLE AS win_rate,
  count(*) FILTER (WHERE status = 'OPEN') AS n_open, count(*) FILTER (WHERE status = 'CLOSED') AS n_closed
FROM p3 WHERE NOT hidden GROUP BY 1""",
)
def a21_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(positions.position_stats(_priced(spark, sf_dir)))


@query(
    "a22_equity_curve",
    f"""WITH {PRICED} SELECT asset_type, entry_at, key, open_id, CAST(round(sum(CAST(w AS DECIMAL(4, 3)) * CAST(round(realized, 6) AS DECIMAL(18, 6)))
  OVER (PARTITION BY asset_type ORDER BY entry_at, key, open_id ROWS UNBOUNDED PRECEDING), 3) AS DOUBLE) AS cum
FROM p3 WHERE status = 'CLOSED' AND NOT hidden""",
)
def a22_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.equity_curve(_priced(spark, sf_dir)).withColumn("entry_at", F.col("entry_at").cast("timestamp_ntz"))


CUT = "2024-01-20"


@query(
    "r8_orphan_exits",
    f"""WITH {MESSAGES}, early AS (SELECT * FROM msg WHERE t_ < TIMESTAMP '{CUT}'), {_folded('early')},
last AS (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY key ORDER BY open_id DESC) = 1),
x AS (
  SELECT m.key, m.t_, m.message_id, m.pct, CASE m.action WHEN 'close' THEN 1.0 ELSE coalesce(hint, 0.5) END::DOUBLE AS share, remaining
  FROM msg m JOIN last ON m.key = last.key
  WHERE m.t_ >= TIMESTAMP '{CUT}' AND m.action IN ('trim', 'close') AND status = 'OPEN' AND m.message_id % 10 <> 0
), y AS (
  SELECT *, coalesce(product(1 - share) OVER (PARTITION BY key ORDER BY t_, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM x
), z AS (SELECT key, product(1 - share) AS p, sum(remaining * before * share * pct) AS gain, count(*) AS n FROM y GROUP BY 1)
SELECT key, open_id, round(CASE WHEN remaining * coalesce(p, 1) < 1e-6 THEN 0 ELSE remaining * coalesce(p, 1) END, 6)::DOUBLE AS remaining,
  round(realized + coalesce(gain, 0), 6) + 0.0 AS realized, CASE WHEN n IS NOT NULL AND remaining * p < 1e-6 THEN 'CLOSED' ELSE status END AS status
FROM last LEFT JOIN z USING (key)""",
)
def r8_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as stored at a time, a third of them corrected by hand, and the exits that come later; every tenth message
    was seen before."""
    messages, cut = position_events(spark, sf_dir), F.lit(CUT).cast("timestamp")
    late = messages.filter(F.col("at") >= cut).select("key", *positions.MESSAGE)
    seen = late.filter("message_id % 10 = 0").groupBy("key").agg(F.collect_list("message_id").alias("seen_ids"))
    early = positions.stitch_positions(messages.filter(F.col("at") < cut).select("key", *positions.MESSAGE))
    stored = early.groupBy("key").agg(F.max_by(F.struct("open_id", "remaining", "realized", "status"), "open_id").alias("p")).select("key", "p.*")
    stored = stored.join(seen, "key", "left").withColumn("frozen", F.substring("key", 2, 9).cast("int") % 3 == 0)
    out = rounded(positions.apply_orphan_exits(stored, late).select("key", "open_id", "remaining", "realized", "status"))
    return out.withColumn("realized", F.col("realized") + 0.0)


def _stored_and_derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Positions at a time, some of them corrected and frozen, and what all messages give; both with marks and contracts."""
    messages = position_events(spark, sf_dir).select("key", *positions.MESSAGE)
    early, whole = (positions.stitch_positions(m) for m in (messages.filter(F.col("at") < F.lit(CUT)), messages))
    frozen, typo = F.col("open_id") % 3 == 0, F.col("open_id") % 4 == 0
    mark = F.when((F.col("status") == "OPEN") & (F.col("open_id") % 5 != 0), F.col("entry_price") * 1.1)
    live = F.when(F.col("mark").isNotNull() & (F.col("entry_price") != 0), (F.col("mark") - F.col("entry_price")) / F.col("entry_price") * 100)
    derived = whole.withColumn("mark", mark).withColumns({"live_pct": live, "occ": F.col("key")})
    left = F.when(frozen & (F.col("status") == "OPEN"), 0.25).otherwise(F.col("remaining"))
    stored = early.withColumns({"frozen": frozen, "remaining": left, "mark": F.lit(1.0), "live_pct": F.lit(2.0), "occ": F.when(typo, F.lit("typo")).otherwise(F.col("key"))})
    return stored.withColumn("book_delta", F.lit(0.5)), derived


@query(
    "r8_overrides",
    f"""WITH {MESSAGES}, early AS (SELECT * FROM msg WHERE t_ < TIMESTAMP '{CUT}'), {_folded('early')}, stored AS (
  SELECT key, open_id, size_label, status, open_id % 3 = 0 AS frozen, CASE WHEN open_id % 3 = 0 AND status = 'OPEN' THEN 0.25 ELSE remaining END AS remaining,
  realized,
    CASE WHEN open_id % 4 = 0 THEN 'typo' ELSE key END AS occ FROM pos
),
  {_folded('msg').replace('f0 AS', 'g0 AS').replace('f1 AS', 'g1 AS').replace('f2 AS', 'g2 AS').replace('f3 AS', 'g3 AS').replace('f4 AS', 'g4 AS').replace('pos AS', 'whole AS')
    .replace('FROM f0', 'FROM g0').replace('FROM f1', 'FROM g1').replace('FROM f2', 'FROM g2').replace('FROM f3 JOIN f4', 'FROM g3 JOIN g4').replace('f3.*', 'g3.*')},
ends AS (
  SELECT min(message_id) FILTER (action = 'open') AS open_id, arg_max(pct, (t_, message_id)) FILTER (action = 'close') AS pct,
    arg_max(price, (t_, message_id)) FILTER (action = 'close') AS price
  FROM g2 WHERE live GROUP BY key, grp
), d AS (
  SELECT whole.*, pct, price, CASE WHEN status = 'OPEN' AND open_id % 5 <> 0 THEN entry_price * 1.1::DOUBLE END AS mark FROM whole LEFT JOIN ends
  USING (open_id)
), l AS (SELECT *, CASE WHEN entry_price <> 0 THEN (mark - entry_price) / entry_price * 100 END AS live FROM d),
b AS (
  SELECT coalesce(s.open_id, l.open_id) AS open_id, coalesce(s.size_label, l.size_label) AS size_label, coalesce(frozen, false) AS frozen, s.status AS st,
  l.status AS dt,
    s.remaining AS sr, s.realized AS sg, l.remaining AS dr, l.realized AS dg, pct, price, mark, live, s.occ IS NOT DISTINCT FROM l.key AS same
  FROM stored s FULL JOIN l ON s.open_id = l.open_id
), k AS (
  SELECT *, frozen AND st = 'OPEN' AND dt = 'CLOSED' AS ends, frozen AND st = 'OPEN' AND dt = 'OPEN' AND mark IS NOT NULL AND live IS NOT NULL
  AND same AS marks,
    NOT frozen AND (dt = 'CLOSED' OR mark IS NOT NULL OR st IS NULL) AS fresh FROM b
), o AS (
  SELECT open_id, size_label, frozen, ends OR marks OR fresh AS touched, st IS NULL AS is_new, CASE WHEN ends THEN 'CLOSED' WHEN frozen THEN st ELSE dt
  END AS status,
    CASE WHEN ends THEN 0 WHEN frozen THEN sr ELSE dr END::DOUBLE AS remaining,
    CASE WHEN ends THEN sg + sr * coalesce(pct, 0) WHEN frozen THEN sg ELSE dg END AS realized,
    CASE WHEN ends THEN coalesce(price, 1.0) WHEN marks OR fresh THEN mark ELSE 1.0 END AS mark, CASE WHEN ends THEN NULL WHEN marks OR fresh THEN live
  ELSE 2.0 END AS live
  FROM k
) SELECT open_id, frozen, status, round(remaining, 6) AS remaining, round(realized, 6) + 0.0 AS realized, round(mark, 6) AS mark, round(live, 6) AS live_pct,
  round(CASE WHEN touched THEN CASE size_label WHEN 'Large' THEN 0.1 WHEN 'Medium' THEN 0.05 WHEN 'Lotto' THEN 0.005 ELSE 0.01 END::DOUBLE
    * (realized + remaining * coalesce(live, 0)) ELSE 0.5 END, 6) + 0.0 AS book_delta
FROM o""",
)
def r8_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions derived anew, put onto stored ones of which a third is frozen, and a quarter names another contract."""
    stored, derived = _stored_and_derived(spark, sf_dir)
    out = positions.merge_derived(stored, derived)
    out = rounded(out.select("open_id", "frozen", "status", "remaining", "realized", "mark", "live_pct", "book_delta"))
    return out.withColumns({"realized": F.col("realized") + 0.0, "book_delta": F.col("book_delta") + 0.0})


@query(
    "r5_r8_book_stream",
    f"WITH {MESSAGES}, {_folded('msg')} SELECT {_POSITION} FROM pos",
)
def r5_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book at a time, taken on by the stream with what comes after it, in files of four days; its last rows."""
    messages, cut = position_events(spark, sf_dir), F.lit(CUT).cast("timestamp")
    early = positions.stitch_positions(messages.filter(F.col("at") < cut)).withColumns({"frozen": F.lit(False), "derived_remaining": F.lit(None).cast("double"), "mark": F.lit(None).cast("double"), "live_pct": F.lit(None).cast("double")})
    out, early = fresh_path(spark, "book"), written(early, "stored-book")
    late = messages.filter(F.col("at") >= cut)
    source = in_parts(late, F.floor(F.datediff("at", cut) / 4), "messages")
    changes = book_stream.book_stream(streams.file_stream(spark, source, late.schema, files=1), early)
    keep = streams.upsert_into(out, ["open_id"], "n_events", "entry_at")
    streams.drain(changes.writeStream.outputMode("update").foreachBatch(keep), fresh_path(spark, "book-checkpoint"))
    cols = ["open_id", "size_label", "entry_price", "entry_at", "remaining", "realized", "status", "n_events"]
    new = spark.read.parquet(out).select(F.col("ticker").alias("key"), *cols)
    old = early.select("key", *cols).join(new.select("open_id"), "open_id", "left_anti").select("key", *cols)
    both = rounded(old.unionByName(new))
    return both.withColumns({"entry_at": F.col("entry_at").cast("timestamp_ntz"), "realized": F.col("realized") + 0.0})


@query(
    "j10_open_positions",
    f"""WITH {PRICED}, u AS (SELECT DISTINCT 'm' || user_id AS ticker FROM events), o AS (
  SELECT key, open_id, contract, live, moderator, row_number() OVER (PARTITION BY key ORDER BY entry_at DESC, open_id DESC) AS n FROM p3 WHERE status = 'OPEN'
  AND NOT hidden
) SELECT u.ticker, count(open_id) AS n_open, max(contract) FILTER (n = 1) AS newest, round(max(live) FILTER (n = 1), 6) AS live_pct, max(moderator)
  FILTER (n = 1) AS moderator
FROM u LEFT JOIN o ON o.key = u.ticker GROUP BY 1""",
)
def j10_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's open positions, newest first; users stand in for hits."""
    hits = read(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("user_id")).alias("ticker")).distinct()
    out = hitlist.attach_positions(hits, _priced(spark, sf_dir))
    first = F.try_element_at("open_positions", F.lit(1))
    return rounded(out.select("ticker", F.coalesce(F.size("open_positions"), F.lit(0)).cast("long").alias("n_open"), first["contract"].alias("newest"), first["live_pct"].alias("live_pct"), first["moderator"].alias("moderator")))
