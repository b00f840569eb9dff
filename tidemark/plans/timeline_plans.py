"""Queries over timelines: runs, gaps, intervals, signals, folds. A user's events are one clip."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, timecode
from ..operators import folds
from ..operators import intervals as I
from ..operators import selection as C
from .base import EVENTS_SQL, events, query, table

W = "(PARTITION BY user_id ORDER BY t, event_id)"
END = 2_592_000.0
#: Bins of time that intervals meet in, in seconds.
BIN = 14_400.0


def order():
    """A clip in order of time."""
    return I.by("user_id", "t", "event_id")


@query("repeat_segments", f"""WITH {EVENTS_SQL}, l AS (SELECT *, lag(event_type) OVER {W} AS before, lag(t) OVER {W} AS t_before FROM e WHERE t BETWEEN 86400 AND 1728000)
  SELECT user_id, event_id, t_before AS first_start, t AS second_start FROM l WHERE event_type = before AND event_type <> ''""")
def repeat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of one type inside a window of time, both bounds included."""
    e = events(spark, sf_dir).where(F.col("t").between(86400, 1728000))
    e = e.withColumn("before", F.lag("event_type").over(order())).withColumn("first_start", F.lag("t").over(order()))
    return e.where("event_type = before and event_type <> ''").select("user_id", "event_id", "first_start", F.col("t").alias("second_start"))


@query("dedupe_stream_words", """WITH w AS (SELECT conv_id, turn, unnest(x) AS word, unnest(range(len(x))) AS k FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS x FROM conversations))
  SELECT conv_id, word, min(turn * 100000 + k) AS first_at, count(*) AS n FROM w GROUP BY conv_id, word""")
def dedupe_stream_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each word of a conversation; later ones are dropped and counted."""
    from ..functions.text import words

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("k", "word"))
    return rows.groupBy("conv_id", "word").agg(F.min(F.col("turn") * 100000 + F.col("k")).alias("first_at"), F.count("*").alias("n"))


@query("runs_by_breaks", f"""WITH {EVENTS_SQL}, l AS (SELECT *, lag(event_type) OVER {W} AS p, lag(t) OVER {W} AS pt, lag(value) OVER {W} AS pv FROM e),
  r AS (SELECT *, sum(CASE WHEN p IS NULL OR event_type <> p OR value < pv OR t - pt > 86400 THEN 1 ELSE 0 END) OVER {W} AS run FROM l)
  SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(t) AS s, max(t) AS e, count(*) AS n FROM r GROUP BY user_id, run""")
def runs_by_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one type whose values don't fall and whose events are at most a day apart."""
    p, pt, pv = (F.lag(c).over(order()) for c in ("event_type", "t", "value"))
    runs = I.islands(events(spark, sf_dir), "user_id", p.isNull() | (F.col("event_type") != p) | (F.col("value") < pv) | (F.col("t") - pt > 86400), order())
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))


@query("session_islands", f"""WITH {EVENTS_SQL}, r AS (SELECT *, sum(b) OVER {W} AS session FROM (SELECT *, CASE WHEN t - lag(t) OVER {W} <= 3600 THEN 0 ELSE 1 END AS b FROM e))
  SELECT user_id, session::BIGINT AS session, min(t) AS s, max(t) AS e, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY user_id, session""")
def session_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("t") - F.lag("t").over(order())
    rows = I.islands(events(spark, sf_dir), "user_id", gap.isNull() | (gap > 3600), order(), "session")
    return rows.groupBy("user_id", "session").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("hole_islands", f"""WITH {EVENTS_SQL}, k AS (SELECT *, row_number() OVER {W} AS k FROM e),
  g AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY k) AS run FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY user_id, event_type ORDER BY k) <= 3 THEN 0 ELSE 1 END AS b FROM k))
  SELECT user_id, event_type, min(k) AS i, max(k) AS j, count(*) AS n FROM g GROUP BY user_id, event_type, run HAVING max(k) - min(k) + 1 >= 3""")
def hole_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one type that may have holes of up to two other events, three places long or more."""
    k = events(spark, sf_dir).withColumn("k", F.row_number().over(order()).cast("long"))
    own = Window.partitionBy("user_id", "event_type").orderBy("k")
    gap = F.col("k") - F.lag("k").over(own)
    runs = I.islands(k, "user_id", gap.isNull() | (gap > 3), own)
    return runs.groupBy("user_id", "event_type", "run").agg(F.min("k").alias("i"), F.max("k").alias("j"), F.count("*").alias("n")).where("j - i + 1 >= 3").drop("run")


PHANTOM_SQL = f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, event_id, event_type, list(event_type) OVER {W[:-1]} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, list(event_type) OVER {W[:-1]} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM e),
  c AS (SELECT *, coalesce(len(l), 0) AS nl, coalesce(len(r), 0) AS nr, coalesce(len(l), 0) = 0 OR (len(list_distinct(l)) = 1 AND NOT list_contains(l, event_type)) AS okl, coalesce(len(r), 0) = 0 OR (len(list_distinct(r)) = 1 AND NOT list_contains(r, event_type)) AS okr FROM n)
  SELECT user_id, event_id, event_type FROM c WHERE okl AND okr AND CASE WHEN nl > 0 AND nr > 0 THEN l[1] = r[1] ELSE greatest(nl, nr) >= 2 END"""


@query("phantom_filter", PHANTOM_SQL)
def phantom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose two neighbours on each side all agree on one other type; at an end of the clip both of the only side must be there."""
    left = F.collect_list("event_type").over(order().rowsBetween(-2, -1))
    right = F.collect_list("event_type").over(order().rowsBetween(1, 2))
    e = events(spark, sf_dir).select("user_id", "event_id", "event_type", left.alias("l"), right.alias("r"))
    alike = lambda s: (F.size(s) == 0) | ((F.size(F.array_distinct(s)) == 1) & ~F.array_contains(F.col(s), F.col("event_type")))
    both = (F.size("l") > 0) & (F.size("r") > 0)
    agree = F.when(both, F.get("l", F.lit(0)) == F.get("r", F.lit(0))).otherwise(F.greatest(F.size("l"), F.size("r")) >= 2)
    return e.where(alike("l") & alike("r") & agree).select("user_id", "event_id", "event_type")


@query("gap_fill_hold", f"""WITH {EVENTS_SQL} SELECT user_id, event_id, t AS s, least(greatest(coalesce(lead(t) OVER {W}, {END}), t + value), t + value + 3.0) AS e FROM e""")
def gap_fill_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = I.gap_filled(F.col("t"), F.col("t") + F.col("value"), F.lit(END), order())
    return events(spark, sf_dir).select("user_id", "event_id", F.col("t").alias("s"), end.alias("e"))


@query("monotone_clamp", f"""WITH {EVENTS_SQL}, m AS (SELECT user_id, event_id, value * 10 AS s, value * 11 - 5 AS e, coalesce(max(greatest(value * 10, value * 11 - 5)) OVER {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS m FROM e)
  SELECT user_id, event_id, greatest(s, m) AS s, greatest(e, greatest(s, m)) AS e FROM m""")
def monotone_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = I.monotone(F.col("value") * 10, F.col("value") * 11 - 5, order())
    return events(spark, sf_dir).select("user_id", "event_id", s.alias("s"), e.alias("e"))


@query("interpolate_missing", f"""WITH {EVENTS_SQL}, a AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER {W} AS k FROM e),
  b AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER f AS k1 FROM a
    WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT user_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL AND v1 IS NULL THEN NULL WHEN v0 IS NULL THEN v1 - 0.5 * (k1 - k) WHEN v1 IS NULL THEN v0 + 0.5 * (k - k0) ELSE v0 + (v1 - v0) * (k - k0) / (k1 - k0) END, 6) AS v FROM b""")
def interpolate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return events(spark, sf_dir).withColumn("v", v).select("user_id", "event_id", F.round(I.interpolated(F.col("v"), order(), 0.5), 6).alias("v"))


TRAPEZOID = "CASE WHEN d < 3600 OR d > 86400 THEN 0.0 WHEN d BETWEEN 14400 AND 43200 THEN 1.0 WHEN d < 14400 THEN 0.4 + 0.6 * (d - 3600) / 10800 ELSE 0.4 + 0.6 * (86400 - d) / 43200 END"


@query("contiguous_subwindows", f"""WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER {W} AS k, sum(b) OVER {W} AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER {W} <= 21600 THEN 0 ELSE 1 END AS b FROM e)),
  p AS (SELECT a.user_id, a.event_id AS first_event, b.event_id AS last_event, b.k - a.k + 1 AS n, b.t - a.t AS d FROM r a JOIN r b ON a.user_id = b.user_id AND a.run = b.run AND b.k >= a.k AND b.k - a.k < 4 WHERE b.t - a.t BETWEEN 3600 AND 86400)
  SELECT user_id, first_event, last_event, n, round({TRAPEZOID}, 6) AS score FROM p""")
def contiguous_subwindows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of up to four adjacent events of a run, scored by their length. A row is paired with its next three only, by window functions, so no run is joined with itself."""
    gap = F.col("t") - F.lag("t").over(order())
    run = I.islands(events(spark, sf_dir), "user_id", gap.isNull() | (gap > 21600), order())
    at = Window.partitionBy("user_id", "run").orderBy("t", "event_id")
    rows = run.select("*", *(F.lead(c, k).over(at).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("event_id", "t")))
    rows = rows.withColumns({"event_id0": F.col("event_id"), "t0": F.col("t")})
    ahead = F.array(*(F.struct(F.col(f"event_id{k}").alias("event_id"), F.col(f"t{k}").alias("t"), F.lit(k + 1).alias("n")) for k in range(4)))
    pairs = rows.select("user_id", F.col("event_id").alias("first_event"), F.col("t").alias("s"), F.explode(ahead).alias("b")).where(F.col("b.event_id").isNotNull())
    scored = pairs.withColumn("d", F.col("b.t") - F.col("s")).where("d between 3600 and 86400")
    return scored.select("user_id", "first_event", F.col("b.event_id").alias("last_event"), F.col("b.n").cast("long").alias("n"), F.round(scores.trapezoid(F.col("d"), 3600.0, 14400.0, 43200.0, 86400.0), 6).alias("score"))


CARDS = "c AS (SELECT user_id, event_id AS card, t AS s, t + value * 60 AS e FROM e WHERE event_type IN ('view', 'purchase'))"
CUTS = "x AS (SELECT user_id, event_id AS cut, t AS s, t + value * 20 AS e FROM e WHERE event_type = 'error')"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type in ('view', 'purchase')").select("user_id", F.col("event_id").alias("card"), F.col("t").alias("s"), (F.col("t") + F.col("value") * 60).alias("e"))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("event_id").alias("cut"), F.col("t").alias("s"), (F.col("t") + F.col("value") * 20).alias("e"))


@query("interval_overlap", f"""WITH {EVENTS_SQL}, {CARDS}, {CUTS} SELECT c.user_id, card, cut, greatest(0.0, least(c.e, x.e) - greatest(c.s, x.s)) AS shared FROM c JOIN x ON c.user_id = x.user_id AND c.s < x.e AND x.s < c.e""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = C.meeting(_cards(spark, sf_dir), _cuts(spark, sf_dir).select("user_id", "cut", F.col("s").alias("os"), F.col("e").alias("oe")), ["user_id"], BIN)
    return pairs.where("s < oe and os < e").select("user_id", "card", "cut", scores.overlap(F.col("s"), F.col("e"), F.col("os"), F.col("oe")).alias("shared"))


@query("interval_clip", f"""WITH {EVENTS_SQL}, {CARDS}, {CUTS} SELECT user_id, card, s, coalesce(min(q), e) AS e FROM (SELECT c.user_id, c.card, c.s, c.e, x.s AS q FROM c LEFT JOIN x ON c.user_id = x.user_id AND x.e - x.s >= 300 AND x.s > c.s AND x.s < c.e) GROUP BY user_id, card, s, e""")
def interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.clipped(_cards(spark, sf_dir), _cuts(spark, sf_dir), "user_id", 300.0)


@query("interval_remap", f"""WITH {EVENTS_SQL}, {CUTS} SELECT e.user_id, e.event_id, round(e.t - coalesce(sum(x.e - x.s), 0), 6) AS t_new FROM e LEFT JOIN x ON e.user_id = x.user_id AND x.e <= e.t GROUP BY e.user_id, e.event_id, e.t""")
def interval_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), "t")
    return I.remapped(times, _cuts(spark, sf_dir), "user_id").select("user_id", F.col("id").alias("event_id"), F.round("t_new", 6).alias("t_new"))


@query("interval_complement", f"""WITH {EVENTS_SQL}, {CUTS}, g AS (SELECT user_id, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s, s AS e FROM x UNION ALL SELECT user_id, max(e), {END} FROM x GROUP BY user_id)
  SELECT user_id, s, e FROM g WHERE e > s""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.complement(_cuts(spark, sf_dir).withColumn("end", F.lit(END)), "user_id", "end")


SUBTRACT_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, {CARDS}, {CUTS},
  win AS (SELECT user_id, s AS a, e AS b, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM x),
  r AS (SELECT user_id, card, s, e, false AS gone, 0::BIGINT AS k FROM c
    UNION ALL SELECT r.user_id, card, CASE WHEN NOT gone AND a <= s AND s < b THEN b ELSE s END,
      CASE WHEN NOT gone AND NOT (a <= s AND s < b) AND ((a < e AND e <= b) OR (s < a AND e > b)) THEN a ELSE e END,
      gone OR (s >= a AND e <= b), win.k FROM r JOIN win ON r.user_id = win.user_id AND win.k = r.k + 1),
  most AS (SELECT user_id, max(k) AS last FROM win GROUP BY user_id)
  SELECT user_id, card, s, e FROM r LEFT JOIN most USING (user_id) WHERE k = coalesce(last, 0) AND NOT gone AND e - s >= 0.2"""


@query("interval_subtract_ordered", SUBTRACT_SQL)
def interval_subtract_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards less their user's errors, taken in order of time."""
    cards, cuts = _cards(spark, sf_dir), _cuts(spark, sf_dir).select("user_id", F.col("s").alias("os"), F.col("e").alias("oe"))
    # A card only shrinks, so windows that don't meet it as it was have nothing to take from what is left.
    windows = C.meeting(cards, cuts, ["user_id"], BIN).groupBy("user_id", "card").agg(F.array_sort(F.collect_list(F.struct(F.col("os").alias("a"), F.col("oe").alias("b")))).alias("windows"))
    cards = cards.join(windows, ["user_id", "card"], "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<struct<a: double, b: double>>")))
    return cards.withColumn("left", I.subtracted(F.col("s"), F.col("e"), F.col("windows"))).where("left is not null").select("user_id", "card", "left.s", "left.e")


@query("nearest_within_radius", f"""WITH {EVENTS_SQL}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), m AS (SELECT * FROM e WHERE event_type = 'view'),
  r AS (SELECT p.user_id, p.event_id, m.event_id AS mark, abs(m.t - p.t) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY m.value DESC, abs(m.t - p.t), m.event_id) AS r FROM p JOIN m ON p.user_id = m.user_id AND m.t BETWEEN p.t - 7200 AND p.t + 7200)
  SELECT user_id, event_id, mark, gap FROM r WHERE r = 1""")
def nearest_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    points = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), "t")
    marks = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("mark"), F.col("t").alias("mt"), F.col("value").alias("depth"))
    return I.nearest(points, marks, "user_id", 7200.0).withColumnRenamed("id", "event_id")


@query("asof_forward", f"""WITH {EVENTS_SQL}, p AS (SELECT * FROM e WHERE event_type = 'view'), m AS (SELECT * FROM e WHERE event_type = 'purchase'),
  r AS (SELECT p.user_id, p.event_id, m.event_id AS mark, m.t AS mark_t, row_number() OVER (PARTITION BY p.event_id ORDER BY m.t, m.event_id) AS r FROM p LEFT JOIN m ON p.user_id = m.user_id AND m.t >= p.t)
  SELECT user_id, event_id, mark, mark_t FROM r WHERE r = 1""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    points = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), "t")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("mark"), F.col("t").alias("mt"))
    return I.next_after(points, marks, "user_id").withColumnRenamed("id", "event_id")


@query("words_drawn_back", f"""WITH {EVENTS_SQL}, w AS (SELECT user_id, event_type, value, row_number() OVER {W} AS i, t AS s, t + value * 60 AS e FROM e),
  h AS (SELECT c.user_id, c.s - c.value * 30 AS first, min(w.i) AS i FROM w c JOIN w ON c.user_id = w.user_id AND w.s >= c.s WHERE c.event_type = 'click' GROUP BY c.user_id, c.i, c.s, c.value),
  p AS (SELECT user_id, i, min(first) AS first FROM h GROUP BY user_id, i),
  m AS (SELECT w.*, first, coalesce(s - first >= 0.5 AND first > coalesce(lag(s) OVER o, '-infinity'::DOUBLE), false) AS moves FROM w LEFT JOIN p USING (user_id, i) WINDOW o AS (PARTITION BY user_id ORDER BY i))
  SELECT user_id, i, CASE WHEN moves THEN first ELSE s END AS s, least(e, CASE WHEN lead(moves) OVER o THEN lead(first) OVER o END) AS e FROM m WINDOW o AS (PARTITION BY user_id ORDER BY i)""")
def words_drawn_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words, after repeats that say a click really began earlier: it does, unless it would reach the one ahead of it."""
    e = events(spark, sf_dir).select("*", F.row_number().over(order()).cast("long").alias("i"))
    words = e.select("user_id", "i", F.col("t").alias("s"), (F.col("t") + F.col("value") * 60).alias("e"))
    repeats = e.where("event_type = 'click'").select("user_id", (F.col("t") - F.col("value") * 30).alias("first"), F.col("t").alias("second"))
    return I.drawn_back(words, repeats, "user_id")


@query("rms_bins", f"""WITH {EVENTS_SQL} SELECT user_id, floor(t / 86400)::BIGINT AS bin, count(*) AS n, round(20 * log10(greatest(sqrt(avg(value * value)), 1.0) / 32768), 6) AS db FROM e GROUP BY 1, 2 HAVING count(*) >= 2""")
def rms_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = 20 * F.log10(F.greatest(F.sqrt(F.avg(F.col("value") * F.col("value"))), F.lit(1.0)) / 32768)
    binned = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 86400).alias("bin"))
    return binned.agg(F.count("*").alias("n"), F.round(db, 6).alias("db")).where("n >= 2")


@query("rms_sliding", f"""WITH {EVENTS_SQL}, w AS (SELECT user_id, event_id, row_number() OVER {W} - 1 AS k, avg(value * value) OVER {W[:-1]} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM e)
  SELECT user_id, event_id, round(20 * log10(greatest(sqrt(m), 1.0) / 32768), 6) AS db FROM w WHERE k % 5 = 0""")
def rms_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg(F.col("value") * F.col("value")).over(order().rowsBetween(-5, 4))
    rows = events(spark, sf_dir).select("user_id", "event_id", (F.row_number().over(order()) - 1).alias("k"), mean.alias("m")).where("k % 5 = 0")
    return rows.select("user_id", "event_id", F.round(20 * F.log10(F.greatest(F.sqrt("m"), F.lit(1.0)) / 32768), 6).alias("db"))


@query("level_nearest_rank", f"""WITH {EVENTS_SQL}, l AS (SELECT user_id, list_sort(list(value)) AS v FROM e GROUP BY user_id)
  SELECT user_id, v[least(len(v) - 1, floor(0.9 * len(v))::BIGINT) + 1] AS speech, v[least(len(v) - 1, floor(0.05 * len(v))::BIGINT) + 1] AS floor_level FROM l""")
def level_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by a window and a count, so a clip's values are never gathered into one array."""
    of = Window.partitionBy("user_id")
    e = events(spark, sf_dir).select("user_id", "value", (F.row_number().over(of.orderBy("value")) - 1).alias("k"), F.count("*").over(of).alias("n"))
    rank = lambda p: F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))), F.col("value")))
    return e.groupBy("user_id").agg(rank(0.9).alias("speech"), rank(0.05).alias("floor_level"))


@query("low_runs_vs_median", f"""WITH {EVENTS_SQL}, m AS (SELECT user_id, median(value) AS med FROM e GROUP BY user_id), q AS (SELECT e.*, value < med - 12 AS low FROM e JOIN m USING (user_id)),
  r AS (SELECT *, sum(CASE WHEN low = p THEN 0 ELSE 1 END) OVER {W} AS run FROM (SELECT *, lag(low) OVER {W} AS p FROM q))
  SELECT user_id, run::BIGINT AS run, min(t) AS s, max(t) AS e, count(*) AS n FROM r WHERE low GROUP BY user_id, run HAVING max(t) - min(t) >= 3600""")
def low_runs_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    low = e.join(e.groupBy("user_id").agg(F.median("value").alias("med")), "user_id").withColumn("low", F.col("value") < F.col("med") - 12)
    changed = F.lag("low").over(order())
    runs = I.islands(low, "user_id", changed.isNull() | (F.col("low") != changed), order()).where("low")
    return runs.groupBy("user_id", "run").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n")).where("e - s >= 3600")


@query("attack_points", f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, event_id, t, value, lag(value) OVER {W} AS before, max(value) OVER {W[:-1]} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS quiet, min(value) OVER {W[:-1]} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS held FROM e)
  SELECT user_id, event_id, t FROM a WHERE value >= 50 AND before < 50 AND quiet < 60 AND held >= 30""")
def attack_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upward crossings of a level after quiet events and held by the next."""
    v = F.col("value")
    quiet, held = F.max(v).over(order().rowsBetween(-3, -1)), F.min(v).over(order().rowsBetween(0, 1))
    rows = events(spark, sf_dir).select("user_id", "event_id", "t", "value", F.lag(v).over(order()).alias("before"), quiet.alias("quiet"), held.alias("held"))
    return rows.where("value >= 50 and before < 50 and quiet < 60 and held >= 30").select("user_id", "event_id", "t")


@query("crossings", f"""WITH {EVENTS_SQL} SELECT user_id, event_id, max(CASE WHEN value >= 80 THEN t END) OVER {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fell, min(CASE WHEN value >= 80 THEN t END) OVER {W[:-1]} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rose FROM e""")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last time before and the first time after an event at which the level was reached."""
    loud = F.when(F.col("value") >= 80, F.col("t"))
    before, after = order().rowsBetween(Window.unboundedPreceding, -1), order().rowsBetween(1, Window.unboundedFollowing)
    return events(spark, sf_dir).select("user_id", "event_id", F.max(loud).over(before).alias("fell"), F.min(loud).over(after).alias("rose"))


@query("greedy_spacing", f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
  UNION ALL SELECT r.user_id, min(e.t) FROM r JOIN e ON e.user_id = r.user_id AND e.t - r.t >= 86400.0 GROUP BY r.user_id) SELECT user_id, t FROM r""")
def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at least a day after the last one taken."""
    return folds.spaced_out(events(spark, sf_dir), "user_id", "t", 86_400.0)


#: Intervals of a clip, best first, and for the folds over them the state before the first.
BEST_FIRST = f"""{EVENTS_SQL}, o AS MATERIALIZED (SELECT user_id, event_id AS id, t AS s, t + value * 2000 AS e, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM e)"""
NONE_KEPT = "SELECT DISTINCT user_id, 0::BIGINT AS k, []::STRUCT(s DOUBLE, e DOUBLE)[] AS kept, false AS took FROM o"
KEEP = "SELECT user_id, k, CASE WHEN took THEN list_append(kept, {'s': s, 'e': e}) ELSE kept END, took"


@query("topk_diverse", f"""WITH RECURSIVE {BEST_FIRST}, r AS ({NONE_KEPT} UNION ALL {KEEP} FROM (
    SELECT o.user_id, o.k, r.kept, o.s, o.e, len(list_filter(r.kept, lambda x: least(o.e, x.e) - greatest(o.s, x.s) > 0.5 * least(greatest(o.e - o.s, 1e-6), greatest(x.e - x.s, 1e-6)))) = 0 AS took
    FROM r JOIN o ON r.user_id = o.user_id AND o.k = r.k + 1 WHERE len(r.kept) < 5))
  SELECT user_id, id, s, e, score, len(kept)::INTEGER AS rank FROM r JOIN o USING (user_id, k) WHERE took""")
def topk_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + F.col("value") * 2000).alias("e"), F.col("value").alias("score"))
    return folds.diverse(e, "user_id", 5)


@query("timeline_suppress", f"""WITH RECURSIVE {BEST_FIRST}, r AS ({NONE_KEPT} UNION ALL {KEEP} FROM (
    SELECT o.user_id, o.k, r.kept, o.s, o.e, coalesce(list_sum(list_transform(r.kept, lambda x: greatest(0.0, least(o.e, x.e) - greatest(o.s, x.s)))), 0) / greatest(o.e - o.s, 1e-6) < 0.5 AS took
    FROM r JOIN o ON r.user_id = o.user_id AND o.k = r.k + 1))
  SELECT user_id, id, s, e, score FROM r JOIN o USING (user_id, k) WHERE took""")
def timeline_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + F.col("value") * 2000).alias("e"), F.col("value").alias("score"))
    return folds.suppressed(e, "user_id")


@query("cards_fold", f"""WITH RECURSIVE {EVENTS_SQL}, w AS MATERIALIZED (SELECT user_id, t + value AS e, lead(t) OVER o AS nxt, row_number() OVER o AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, t + value, event_id)),
  r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0 AS open, -1 AS card, false AS ends FROM w
    UNION ALL SELECT user_id, k, open, card + ends::INTEGER, ends FROM (
      SELECT w.user_id, w.k, CASE WHEN r.ends THEN 1 ELSE r.open + 1 END AS open, r.card,
        (CASE WHEN r.ends THEN 1 ELSE r.open + 1 END) >= 7 OR w.k = w.n OR ((CASE WHEN r.ends THEN 1 ELSE r.open + 1 END) >= 3 AND coalesce(w.nxt - w.e > 40000.0, false)) AS ends
      FROM r JOIN w ON r.user_id = w.user_id AND w.k = r.k + 1))
  SELECT user_id, card, open AS n_words FROM r WHERE ends""")
def cards_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("s"), (F.col("t") + F.col("value")).alias("e"), "event_id"))).alias("words"))
    return words.select("user_id", F.posexplode(folds.carded(F.col("words"), pause=40_000.0)).alias("card", "n_words"))


@query("schedule_overlap", f"""WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER {W} AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e)
  SELECT user_id, event_id, CASE WHEN k = 1 THEN greatest(0.0, t - 0.05) ELSE t - 0.24 END AS t_in, CASE WHEN k = n THEN least({END} - 0.45, t + value - 0.15) ELSE t + value + 0.02 END AS t_out FROM n""")
def schedule_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fades of cards that dissolve into each other: the first up a hair early, the last gone before its end."""
    k, n = F.row_number().over(order()), F.count("*").over(Window.partitionBy("user_id"))
    e = events(spark, sf_dir).select("*", k.alias("k"), n.alias("n"))
    t_in = F.when(F.col("k") == 1, F.greatest(F.lit(0.0), F.col("t") - 0.05)).otherwise(F.col("t") - 0.24)
    t_out = F.when(F.col("k") == F.col("n"), F.least(F.lit(END - 0.45), F.col("t") + F.col("value") - 0.15)).otherwise(F.col("t") + F.col("value") + 0.02)
    return e.select("user_id", "event_id", t_in.alias("t_in"), t_out.alias("t_out"))


SEQUENTIAL_SQL = f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, event_id AS i, t AS s, t + value AS e, lead(t) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM e),
  z AS (SELECT *, CASE WHEN nxt IS NULL THEN NULL WHEN nxt - e - 0.5 / 30 >= 0.9 THEN 0.45 ELSE greatest(0.1, greatest(nxt - e - 0.5 / 30, 0) / 2) END AS size FROM c),
  o AS (SELECT *, round_even((nxt - size) * 30, 0) / 30 AS next_in FROM z),
  g AS (SELECT *, coalesce(lag(next_in) OVER w, greatest(s - 0.05, 0)) AS t_in, coalesce(lag(size) OVER w, 0.45) AS d_in, next_in - 0.5 / 30 AS gone FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i)),
  f AS (SELECT *, greatest(size, least(0.45, gone - round_even(e * 30, 0) / 30)) AS wished, gone - t_in - d_in AS room FROM g),
  h AS (SELECT *, CASE WHEN size IS NULL THEN 0.45 WHEN wished > room THEN greatest(1.0 / 30, room) ELSE wished END AS d_out FROM f)
  SELECT user_id, i, s, e, t_in, CASE WHEN size IS NULL THEN least({END} - 0.45, e - 0.15) ELSE gone - d_out END AS t_out, d_in, d_out,
  coalesce(lag(wished > room) OVER (PARTITION BY user_id ORDER BY i), false) AS hard_cut FROM h"""


@query("schedule_sequential", SEQUENTIAL_SQL)
def schedule_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = events(spark, sf_dir).select("user_id", F.col("event_id").alias("i"), F.col("t").alias("s"), (F.col("t") + F.col("value")).alias("e"))
    return I.sequential_schedule(cards, "user_id", 30, 0.45, 0.1, END)


@query("signal_dips")
def signal_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        envelope = rows.sort_values(["t", "event_id"])[["t", "value"]].rename(columns={"value": "db"})
        return folds.dips(envelope, rows["value"].quantile(0.9), 10.0, 20, 20.0, 3600.0).assign(user_id=rows["user_id"].iloc[0])

    return folds.per_clip(events(spark, sf_dir), "user_id", fold, "user_id long, t double, db double, prom double, depth double, sustain double, t1 double, t0 double, pause boolean")


@query("timecode_roundtrip", f"""WITH {EVENTS_SQL}, m AS (SELECT event_id, round_even(t * 1000, 0)::BIGINT AS ms FROM e)
  SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, ms / 1000.0 AS seconds FROM m""")
def timecode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = events(spark, sf_dir).select("event_id", timecode.stamp(F.col("t")).alias("stamp"))
    return stamped.withColumn("seconds", F.round(timecode.seconds(F.col("stamp")), 3))


@query("srt_stamp", f"""WITH {EVENTS_SQL}, m AS (SELECT event_id, round_even(t * 1000, 0)::BIGINT AS ms, round_even(t * 100, 0)::BIGINT AS cs FROM e)
  SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass, printf('%d:%02d.%02d', cs // 6000, cs // 100 % 60, cs % 100) AS short FROM m""")
def srt_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return events(spark, sf_dir).select("event_id", timecode.srt(t).alias("srt"), timecode.ass(t).alias("ass"), timecode.short(t).alias("short"))
