"""Queries over findings, reports, carried cuts, quorum medians and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from ..operators import reports as R
from .base import EVENTS_SQL, events, query, table

W = "(PARTITION BY user_id ORDER BY t, event_id)"


@query("anchored_cuts", f"""WITH {EVENTS_SQL}, k AS (SELECT user_id, event_type, row_number() OVER {W} AS a, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER {W} AS b FROM e),
  n AS (SELECT user_id, max(b)::BIGINT AS n FROM k GROUP BY user_id), p AS (SELECT user_id, a, b FROM k WHERE event_type IN ('view', 'click', 'signup')),
  c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m, a AS cut FROM k WHERE event_type = 'purchase' AND a % 3 = 0),
  f AS (SELECT c.user_id, c.i, c.m, c.cut, min(p.a) AS pa, min(p.b)::BIGINT AS pb FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.a >= c.cut GROUP BY c.user_id, c.i, c.m, c.cut),
  g AS (SELECT f.*, n.n, max(CASE WHEN pa IS NULL OR pa - cut > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY f.user_id) AS lost, max(pb - i) OVER (PARTITION BY f.user_id ORDER BY i) AS ahead FROM f JOIN n ON n.user_id = f.user_id)
  SELECT user_id, i, cut, CASE WHEN lost = 0 AND n > m THEN i + least(n - m, greatest(1, ahead)) END AS anchor FROM g""")
def anchored_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places among all of a user's events carried over to the events that are no errors, by pairs of some types."""
    own = I.by("user_id", "t", "event_id")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    k = events(spark, sf_dir).select("user_id", "event_type", F.row_number().over(own).cast("long").alias("a"), F.sum((F.col("event_type") != "error").cast("long")).over(so_far).alias("b"))
    words = k.groupBy("user_id").agg(F.max("b").alias("n"))
    chosen = k.where("event_type = 'purchase' and a % 3 = 0")
    cuts = chosen.select("user_id", (F.row_number().over(I.by("user_id", "a")) - 1).cast("long").alias("i"), F.col("a").alias("cut"))
    return R.anchored_cuts(cuts, k.where("event_type in ('view', 'click', 'signup')").select("user_id", "a", "b"), words, "user_id")


PLACE = "CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END"


@query("coverage_report", f"""WITH {EVENTS_SQL}, w AS (SELECT user_id, event_id, t, CASE WHEN event_type <> 'error' AND value > 20 THEN event_type END AS label, {PLACE} AS place, value / 100 AS conf FROM e),
  r AS (SELECT *, sum(b) OVER {W} AS run FROM (SELECT *, CASE WHEN (label IS NULL) = lag(label IS NULL) OVER {W} THEN 0 ELSE 1 END AS b FROM w)),
  g AS (SELECT user_id, count(*) AS stretches FROM (SELECT user_id, run FROM r WHERE label IS NULL GROUP BY user_id, run HAVING count(*) >= 4) GROUP BY user_id),
  q AS (SELECT *, sum(b) OVER {W} AS run FROM (SELECT *, CASE WHEN label = lag(label) OVER {W} THEN 0 ELSE 1 END AS b FROM w WHERE label IS NOT NULL)),
  s AS (SELECT user_id, run, avg(conf) AS conf, min(place) AS place, min(t) AS s, max(t) AS e, any_value(label) AS label FROM q GROUP BY user_id, run),
  o AS (SELECT user_id, count(*) AS segments, avg(conf) AS mean_conf, count(*) FILTER (conf < 0.5) AS unsure, count(DISTINCT label) AS labels, count(*) FILTER (back) AS backward, max(e) - min(s) AS span FROM (SELECT *, place < lag(place) OVER (PARTITION BY user_id ORDER BY run) AS back FROM s) GROUP BY user_id),
  n AS (SELECT user_id, count(*) AS n_words, avg((label IS NOT NULL)::INTEGER) AS coverage FROM w GROUP BY user_id)
  SELECT n.user_id, n_words, round(coverage, 6) AS coverage, coalesce(segments, 0) AS segments, round(mean_conf, 6) AS mean_conf, coalesce(unsure, 0) AS unsure, coalesce(labels, 0) AS labels, coalesce(backward, 0) AS backward, span, coalesce(stretches, 0) AS stretches
  FROM n LEFT JOIN o ON o.user_id = n.user_id LEFT JOIN g ON g.user_id = n.user_id""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each user's events is placed, how surely, and in which order."""
    label = F.when((F.col("event_type") != "error") & (F.col("value") > 20), F.col("event_type"))
    words = events(spark, sf_dir).select("user_id", "t", F.col("event_id").alias("id"), label.alias("label"), F.expr(PLACE).alias("place"), (F.col("value") / 100).alias("conf"))
    told = R.coverage_report(words, "user_id")
    return told.withColumns({"coverage": F.round("coverage", 6), "mean_conf": F.round("mean_conf", 6)}).select("user_id", "n_words", "coverage", "segments", "mean_conf", "unsure", "labels", "backward", "span", "stretches")


@query("cut_findings", f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, event_id AS cut, t - 5000 AS s, t + value * 200 - 8000 AS e, 2500000.0 AS length FROM e WHERE event_type = 'error'),
  p AS (SELECT user_id, event_id AS phrase, t AS ps, t + value * 40 AS pe FROM e WHERE event_type IN ('view', 'click'))
  SELECT user_id, 'order' AS rule, cut, NULL::BIGINT AS other FROM c WHERE s >= e UNION ALL SELECT user_id, 'bounds', cut, NULL FROM c WHERE s < 0 OR e > length + 1e-6
  UNION ALL SELECT user_id, 'overlap', cut, nxt FROM (SELECT *, lead(cut) OVER o AS nxt, lead(s) OVER o AS nxt_s FROM c WINDOW o AS (PARTITION BY user_id ORDER BY s, e, cut)) WHERE nxt_s < e
  UNION ALL SELECT c.user_id, 'phrase', cut, phrase FROM c JOIN p ON c.user_id = p.user_id AND s < pe AND ps < e""")
def cut_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as cuts: out of order, out of bounds, over each other, or over a view or click."""
    e = events(spark, sf_dir)
    cuts = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("cut"), (F.col("t") - 5000).alias("s"), (F.col("t") + F.col("value") * 200 - 8000).alias("e"), F.lit(2_500_000.0).alias("length"))
    phrases = e.where("event_type in ('view', 'click')").select("user_id", F.col("event_id").alias("phrase"), F.col("t").alias("ps"), (F.col("t") + F.col("value") * 40).alias("pe"))
    return R.cut_findings(cuts, phrases, "user_id", 14_400.0)


@query("quorum_median", """WITH d AS (SELECT o_custkey, o_orderkey, l_partkey AS x, l_suppkey AS y, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount > 0.06),
  f AS (SELECT o_custkey, x, y FROM d WHERE r = 1), m AS (SELECT o_custkey, count(*) AS frames, count(x) AS hits, list_sort(list(x) FILTER (x IS NOT NULL)) AS xs, list_sort(list(y) FILTER (y IS NOT NULL)) AS ys FROM f GROUP BY o_custkey)
  SELECT o_custkey, hits, CASE WHEN hits * 2 >= frames THEN xs[hits // 2 + 1] END AS x, CASE WHEN hits * 2 >= frames THEN ys[hits // 2 + 1] END AS y FROM m""")
def quorum_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames, the largest of an order's items at a discount as what is seen there; a customer's median where half of the orders have one."""
    items = table(spark, sf_dir, "lineitem").where("l_discount > 0.06").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))).alias("largest"))
    frames = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(items, "o_orderkey", "left").select("o_custkey", F.col("largest.x").alias("x"), F.col("largest.y").alias("y"))
    return R.quorum_medians(frames, "o_custkey", ["x", "y"])


@query("marker_sync", """WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS record, CASE WHEN o_orderkey % 5 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 2 THEN '' END AS record_at,
    CASE WHEN (o_orderkey // 15) % 4 <> 0 THEN o_orderpriority END AS own, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS exported FROM orders),
  s AS (SELECT *, CASE WHEN exported IS NOT NULL THEN CASE exported WHEN 'F' THEN true WHEN 'O' THEN false END ELSE CASE WHEN own IN ('1-URGENT', '2-HIGH') THEN true WHEN own IN ('5-LOW') THEN false END END AS seen FROM o)
  SELECT id, CASE WHEN seen AND NOT coalesce(record, false) THEN true WHEN NOT seen AND record IS NULL THEN false ELSE record END AS value,
    CASE WHEN seen AND NOT coalesce(record, false) THEN CASE WHEN trim(coalesce(record_at, '')) <> '' THEN record_at ELSE 'unknown' END WHEN NOT seen AND record IS NULL THEN '' ELSE coalesce(record_at, '') END AS at,
    CASE WHEN seen IS NULL THEN 'unseen' WHEN seen AND NOT coalesce(record, false) THEN 'promote' WHEN NOT seen AND record IS NULL THEN 'settle' WHEN record AND NOT seen THEN 'conflict' ELSE 'ok' END AS action FROM s""")
def marker_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three values with a date, after the marker of the exported file, or else of the folder, was seen: all nine cases."""
    key = F.col("o_orderkey")
    record = F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    at = F.when(key % 5 < 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 5 == 2, "")
    own = F.when(F.floor(key / 15) % 4 != 0, F.array("o_orderpriority"))
    exported = F.when(key % 2 == 0, F.array("o_orderstatus"))
    tags = F.coalesce(exported, own)  # the exported file's tags, if there is one, even where they say nothing
    seen = R.marker(tags, ["F", "1-URGENT", "2-HIGH"], ["O", "5-LOW"])
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), record.alias("record"), at.alias("record_at"), seen.alias("seen"))
    return rows.select("id", R.marked(F.col("record"), F.col("record_at"), F.col("seen")).alias("m")).select("id", "m.value", "m.at", "m.action")
