"""Queries over candidates: overlaps, weighted modes, verdicts, filled holes, coarse and fine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from ..operators import selection as C
from .base import EVENTS_SQL, events, query, table

W = "(PARTITION BY user_id ORDER BY t, event_id)"
#: Bins that overlaps are looked for in, in seconds and in days.
BIN, DAYS = 14_400.0, 90.0


@query("hole_fill", f"""WITH {EVENTS_SQL}, k AS (SELECT *, row_number() OVER {W} AS ref FROM e), r AS (SELECT user_id, event_id, ref, t AS t0, t + 600 * value AS t1 FROM k WHERE event_type NOT IN ('error', 'signup')),
  l AS (SELECT *, lag(ref) OVER w AS p_ref, lag(t1) OVER w AS p_t1 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ref)),
  h AS (SELECT user_id, p_ref, p_t1, ref - p_ref AS hole, (t0 - p_t1) / (ref - p_ref) AS step, unnest(range(1, ref - p_ref)) AS i FROM l WHERE ref - p_ref BETWEEN 2 AND 4 AND t0 > p_t1)
  SELECT user_id, ref, t0, t1, true AS measured FROM r UNION ALL SELECT user_id, p_ref + i, p_t1 + step * (i - 1), p_t1 + step * i, false FROM h""")
def hole_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of some types with rows put in for those left out between them, up to three in a row and only where time advances."""
    ref = F.row_number().over(I.by("user_id", "t", "event_id")).cast("long")
    rows = events(spark, sf_dir).withColumn("ref", ref).where("event_type not in ('error', 'signup')").select("user_id", "ref", F.col("t").alias("t0"), (F.col("t") + 600 * F.col("value")).alias("t1"))
    return I.holes_filled(rows, "user_id", I.by("user_id", "ref"))


@query("best_overlap", f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, event_id AS id, t AS s, t + 300 * value AS e FROM e WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS other, t - 3600 AS os, t + 600 * value AS oe FROM e WHERE event_type IN ('view', 'purchase')),
  p AS (SELECT a.user_id, id, other, os, least(e, oe) - greatest(s, os) AS o FROM a JOIN b ON a.user_id = b.user_id AND least(e, oe) - greatest(s, os) > 0),
  m AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY o DESC, os, other) AS r FROM p)
  SELECT a.user_id, a.id AS event_id, other, round(o, 5) AS overlap FROM a LEFT JOIN m ON a.user_id = m.user_id AND a.id = m.id AND r = 1""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click's interval the view or purchase of the user that it shares most time with."""
    e = events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + 300 * F.col("value")).alias("e"))
    right = e.where("event_type in ('view', 'purchase')").select("user_id", F.col("event_id").alias("other"), (F.col("t") - 3600).alias("os"), (F.col("t") + 600 * F.col("value")).alias("oe"))
    return C.best_overlap(left, right, ["user_id"], BIN).select("user_id", F.col("id").alias("event_id"), "other", F.round("overlap", 5).alias("overlap"))


@query("range_mode", f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, event_id AS id, t AS s, t + 172800.0 AS e FROM e WHERE event_type = 'signup'), b AS (SELECT user_id, event_id AS other, event_type AS label, floor(value)::BIGINT AS words, t AS os, t + 60 * value AS oe FROM e),
  p AS (SELECT a.user_id, id, label, sum(words)::BIGINT AS weight, count(*) AS n, arg_min(other, (os, other)) AS first, arg_max(other, (os, other)) AS last FROM a JOIN b ON a.user_id = b.user_id AND least(e, oe) - greatest(s, os) > 0 GROUP BY a.user_id, id, label)
  SELECT user_id, id AS event_id, label, weight, n, first, last FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY weight DESC, label) AS r FROM p) WHERE r = 1""")
def range_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type with most weight in the two days after each signup, and its first and last event there."""
    e = events(spark, sf_dir)
    ranges = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + 172_800.0).alias("e"))
    rows = e.select("user_id", F.col("event_id").alias("other"), F.col("event_type").alias("label"), F.floor("value").alias("words"), F.col("t").alias("os"), (F.col("t") + 60 * F.col("value")).alias("oe"))
    return C.weighted_mode(ranges, rows, ["user_id"], "label", "words", BIN).withColumnRenamed("id", "event_id")


DAY = "epoch_us(o_orderdate)::DOUBLE / 86400e6"


@query("judged_rerank", f"""WITH c AS (SELECT o_custkey AS clip, o_orderkey AS id, o_orderpriority AS label, {DAY} AS s, {DAY} + 400.0 AS e, o_totalprice AS score FROM orders),
  v AS (SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS stands, CASE WHEN o_orderkey % 2 = 0 THEN '1-URGENT' ELSE '3-MEDIUM' END AS wanted FROM orders WHERE o_orderkey % 7 <> 0),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 5),
  j AS (SELECT pool.*, stands, wanted FROM pool LEFT JOIN v USING (id)),
  o AS (SELECT j.id, c.id AS other, row_number() OVER (PARTITION BY j.id ORDER BY least(j.e, c.e) - greatest(j.s, c.s) DESC, c.s, c.id) AS r FROM j JOIN c ON c.clip = j.clip AND c.label = j.wanted AND least(j.e, c.e) - greatest(j.s, c.s) > 0 WHERE NOT j.stands),
  f AS (SELECT o.id, c.id AS other, c.label AS o_label, c.s AS o_s, c.score AS o_score FROM o JOIN v ON v.id = o.other AND v.stands JOIN c ON c.id = o.other WHERE r = 1),
  n AS (SELECT clip, coalesce(other, id) AS id, coalesce(o_label, label) AS label, coalesce(o_s, s) AS s, CASE WHEN other IS NOT NULL THEN o_score WHEN NOT stands THEN round(score * 0.8, 4) ELSE score END AS score,
    CASE WHEN stands IS NULL THEN 'unjudged' WHEN stands THEN 'stands' WHEN other IS NOT NULL THEN 'adjusted' ELSE 'lowered' END AS state, CASE WHEN other IS NOT NULL THEN id END AS from_id, rank AS old FROM j LEFT JOIN f USING (id)),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, label, s ORDER BY old) AS k FROM n) WHERE k = 1)
  SELECT clip AS o_custkey, id AS o_orderkey, score, state, from_id, row_number() OVER (PARTITION BY clip ORDER BY score DESC, old) AS rank FROM once""")
def judged_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's five best orders, after a verdict on them: replaced by a confirmed order of the wanted priority near in time, or lowered, made unique and ranked again."""
    orders = table(spark, sf_dir, "orders")
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86_400e6)
    every = orders.select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), day.alias("s"), (day + 400.0).alias("e"), F.col("o_totalprice").alias("score"))
    key = F.col("o_orderkey")
    verdicts = orders.where(key % 7 != 0).select(key.alias("id"), (key % 3 != 0).alias("stands"), F.when(key % 2 == 0, "1-URGENT").otherwise("3-MEDIUM").alias("wanted"))
    ranked = Window.partitionBy("clip").orderBy(F.desc("score"), "id")
    pool = every.withColumn("rank", F.row_number().over(ranked)).where("rank <= 5")
    return C.rejudged(pool, every, verdicts, "clip", DAYS).withColumnsRenamed({"clip": "o_custkey", "id": "o_orderkey"})


def _low_runs_sql(name: str, rows: str) -> str:
    """CTEs of I.low_runs over rows (user_id, t, level)."""
    return f"""{name}_m AS (SELECT user_id, median(level) AS med FROM {rows} GROUP BY user_id), {name}_q AS (SELECT r.*, level < med - 12 AS low FROM {rows} r JOIN {name}_m USING (user_id)),
  {name} AS (SELECT user_id, min(t) AS s, max(t) AS e, avg(level) AS depth FROM (SELECT *, sum(CASE WHEN low = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT *, lag(low) OVER (PARTITION BY user_id ORDER BY t) AS p FROM {name}_q)) WHERE low GROUP BY user_id, run)"""


@query("coarse_to_fine", f"""WITH {EVENTS_SQL}, bins AS (SELECT user_id, floor(t / 43200.0) * 43200.0 AS t, avg(value) AS level FROM e GROUP BY user_id, floor(t / 43200.0)), {_low_runs_sql("coarse", "bins")},
  best AS (SELECT user_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(depth, 9), s) AS r FROM coarse WHERE e - s + 43200.0 >= 86400.0) WHERE r = 1),
  near AS (SELECT e.user_id, e.t, value AS level FROM e JOIN best b ON e.user_id = b.user_id AND e.t BETWEEN b.s - 86400.0 AND b.e + 172800.0), {_low_runs_sql("fine", "near")},
  longest AS (SELECT user_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s - e, s) AS r FROM fine) WHERE r = 1)
  SELECT best.user_id, best.s AS coarse_s, best.e AS coarse_e, longest.s AS fine_s, longest.e AS fine_e FROM best LEFT JOIN longest USING (user_id)""")
def coarse_to_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's deepest quiet run of half days, of a day at least, and the longest quiet run of single events around it."""
    rows = events(spark, sf_dir).select("user_id", "t", F.col("value").alias("level"))
    return I.coarse_to_fine(rows, "user_id", 43_200.0, 12.0, 86_400.0, 172_800.0, 86_400.0)
