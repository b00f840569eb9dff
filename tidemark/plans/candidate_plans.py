"""Queries that compose operators: framing, candidates, cards and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import scores
from ..functions import text as T
from ..operators import intervals as I
from ..operators import search as S
from .base import EVENTS_SQL, events, query, table

MEASURES = """m AS (SELECT p_partkey, 1280 + p_size * 8 AS w, 720 + p_size % 7 * 30 AS h, 0.2 + p_size % 11 / 20.0 AS cx, 0.08 + p_size % 5 / 100.0 AS head_w, 0.1 + p_size % 6 / 30.0 AS crown, 0.2 + p_size % 6 / 30.0 AS face, CASE p_size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'frontal' END AS facing FROM part)"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the role of measured shots."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (1280 + s * 8).alias("w"),
        (720 + s % 7 * 30).alias("h"),
        (0.2 + s % 11 / 20.0).alias("cx"),
        (0.08 + s % 5 / 100.0).alias("head_w"),
        (0.1 + s % 6 / 30.0).alias("crown"),
        (0.2 + s % 6 / 30.0).alias("face"),
        F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("frontal")), s % 3 + 1).alias("facing"),
    )


@query("framing_targets", f"""WITH {MEASURES}, g AS (SELECT *, (1 - head_w - 0.5) / 3 AS third, CASE WHEN facing IN ('left', 'right') THEN facing = 'left' ELSE cx > 0.5 END AS on_left FROM m),
  o AS (SELECT *, CASE WHEN third < 0.03 THEN 0.0 ELSE third END AS outer_gap, CASE WHEN third < 0.03 THEN greatest((1 - head_w - 0.5) / 2, 0.03) ELSE third END AS inner_gap FROM g),
  f AS (SELECT *, outer_gap + head_w / 2 AS fx, outer_gap + head_w + inner_gap + 0.25 AS cap FROM o),
  c AS (SELECT *, (floor(least(w::DOUBLE, h * 16 / 9.0) / 2) * 2)::BIGINT AS cw FROM f)
  SELECT p_partkey, on_left, round(CASE WHEN on_left THEN 1 - fx ELSE fx END, 6) AS fx, round(CASE WHEN on_left THEN 1 - cap ELSE cap END, 6) AS cap, cw, (floor(least(h::DOUBLE, cw * 9 / 16.0) / 2) * 2)::BIGINT AS ch FROM c""")
def framing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = G.caption_on_left(F.col("facing"), F.col("cx"))
    rows = _measures(spark, sf_dir).select("p_partkey", left.alias("on_left"), G.equal_gaps(F.col("head_w"), 0.5, left).alias("t"), G.centred(F.col("w"), F.col("h"), 16, 9).alias("c"))
    return rows.select("p_partkey", "on_left", F.round("t.fx", 6).alias("fx"), F.round("t.cap", 6).alias("cap"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))


@query("framing_solve")
def framing_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest window of each shot over zooms and moves aside, the head at its target and the face in its band.

    Within a zoom the cost only grows with the distance aside, moves are 8 pixels at least, and the frame's edges are
    even: no move comes nearer to the target than the place it asks for, rounded and held in the frame, and ties go to
    the shorter move. So that place stands for all moves of its zoom, and a shot has one place a zoom. Shots are small
    rows and are dealt out by number.
    """
    shots = S.dealt(_measures(spark, sf_dir)).withColumn("left", G.caption_on_left(F.col("facing"), F.col("cx")))
    width, height, cx = F.col("w"), F.col("h"), F.col("cx")
    largest = F.least(width.cast("double"), height * 16 / 9.0)

    def sized(i):
        scale = 1.0 - 0.02 * i
        return F.struct(i.alias("i"), scale.alias("scale"), G.even(largest * scale).alias("w"))

    def targeted(z):
        h, target = G.even(z["w"] * 9 / 16.0), G.equal_gaps(F.least(F.col("head_w") * width / z["w"], F.lit(1.0)), 0.3, F.col("left"))["fx"]
        return F.struct(*(z[name].alias(name) for name in ("i", "scale", "w")), h.alias("h"), target.alias("target"))

    def placed(z):
        x = F.least(F.greatest(F.lit(0), G.even(cx * width - z["target"] * z["w"])), G.even_down(width - z["w"]))
        y = G.height_band(F.col("crown") * height, F.col("face") * height, z["h"], height)["y"]
        return F.struct(*(z[name].alias(name) for name in ("i", "scale", "w", "h", "target")), x.alias("x"), y.alias("y"))

    def priced(z):
        fx, fy = (cx * width - z["x"]) / z["w"], (F.col("face") * height - z["y"]) / z["h"]
        cost = F.round(G.framing_cost(fx, z["target"], fy, z["scale"]), 9)
        return F.struct(cost.alias("cost"), *(z[name].alias(name) for name in ("i", "x", "y", "w", "h")))

    zooms = F.filter(F.transform(F.sequence(F.lit(0), F.lit(25)), sized), lambda z: z["w"] >= 160)
    for step in (targeted, placed, priced):
        zooms = F.transform(zooms, step)
    best = shots.select("p_partkey", F.array_min(zooms).alias("b"))
    return best.select("p_partkey", F.col("b.i").alias("zoom"), "b.x", "b.y", "b.w", "b.h", F.round("b.cost", 6).alias("cost"))


@query("sample_instants", f"""WITH {EVENTS_SQL}, k AS (SELECT unnest(range(0, 4)) AS k) SELECT event_id, k, round(t + value * (0.06 + 0.88 * k / 3.0), 6) AS at FROM e, k WHERE event_type = 'signup'""")
def sample_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'signup'")
    rows = e.select("event_id", F.posexplode(G.inset(F.col("t"), F.col("t") + F.col("value"), 4)).alias("k", "at"))
    return rows.select("event_id", F.col("k").cast("long").alias("k"), F.round("at", 6).alias("at"))


@query("shared_size", """SELECT p_partkey, greatest(12, floor(40 * least(1.0, 9.0 / greatest(max(length(p_name)) OVER (PARTITION BY p_brand), 1)))::INTEGER) AS size FROM part""")
def shared_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One size for the lines of a brand, set by its widest."""
    widest = F.max(F.length("p_name")).over(Window.partitionBy("p_brand")).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", G.shrunk(F.lit(40.0), F.lit(12), F.lit(9.0), widest).alias("size"))


@query("sublist_contains", r"""WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' AS body FROM documents)
  SELECT doc_id, contains(body, ' of the ') AS of_the, contains(body, ' in the and ') AS in_the_and FROM w""")
def sublist_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the words of a text hold a sequence of words."""
    body = F.concat(F.lit(" "), T.normalized(F.col("text")), F.lit(" "))
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return rows.select("doc_id", F.contains("body", F.lit(" of the ")).alias("of_the"), F.contains("body", F.lit(" in the and ")).alias("in_the_and"))


RUNS = """r AS (SELECT *, row_number() OVER w AS k, sum(b) OVER w AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 43200 THEN 0 ELSE 1 END AS b FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


@query("candidates_scored", f"""WITH {EVENTS_SQL}, {RUNS},
  p AS (SELECT a.user_id, a.event_id AS first_event, b.event_id AS last_event, b.t - a.t AS d, b.k - a.k + 1 AS n, a.run FROM r a JOIN r b ON a.user_id = b.user_id AND a.run = b.run AND b.k - a.k BETWEEN 1 AND 3),
  s AS (SELECT p.*, sum(r.value * r.value) / sum(r.value) AS conf, count(*) FILTER (r.value < 10) * 1.0 / count(*) AS low FROM p JOIN r ON r.user_id = p.user_id AND r.event_id >= p.first_event AND r.event_id <= p.last_event GROUP BY ALL)
  SELECT user_id, first_event, last_event, n, round(0.5 * least(1.0, conf / 200) + 0.3 * CASE WHEN d < 3600 OR d > 86400 THEN 0.0 WHEN d BETWEEN 14400 AND 43200 THEN 1.0 WHEN d < 14400 THEN 0.4 + 0.6 * (d - 3600) / 10800 ELSE 0.4 + 0.6 * (86400 - d) / 43200 END + 0.2 * (1 - low), 5) AS score FROM s""")
def candidates_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two to four events of a run with a weighted score: the mean value by value, the length, and how few are low."""
    order = I.by("user_id", "t", "event_id")
    gap = F.col("t") - F.lag("t").over(order)
    run = I.islands(events(spark, sf_dir), "user_id", gap.isNull() | (gap > 43200), order)
    at = Window.partitionBy("user_id", "run").orderBy("t", "event_id")
    rows = run.select("*", *(F.lead(F.struct("event_id", "t", "value"), k).over(at).alias(f"n{k}") for k in (1, 2, 3)))
    own = F.struct("event_id", "t", "value")
    windows = F.array(*(F.array(own, *(F.col(f"n{j}") for j in range(1, k + 1))) for k in (1, 2, 3)))
    w = rows.select("user_id", F.explode(windows).alias("w")).where(F.element_at("w", -1).isNotNull())
    total = lambda f: F.aggregate("w", F.lit(0.0), lambda a, x: a + f(x))
    v = w.select(
        "user_id",
        F.col("w")[0]["event_id"].alias("first_event"),
        F.element_at("w", -1)["event_id"].alias("last_event"),
        F.size("w").cast("long").alias("n"),
        (F.element_at("w", -1)["t"] - F.col("w")[0]["t"]).alias("d"),
        F.try_divide(total(lambda x: x["value"] * x["value"]), total(lambda x: x["value"])).alias("conf"),
        (F.size(F.filter("w", lambda x: x["value"] < 10)) / F.size("w")).alias("low"),
    )
    score = 0.5 * F.least(F.lit(1.0), F.col("conf") / 200) + 0.3 * scores.trapezoid(F.col("d"), 3600.0, 14400.0, 43200.0, 86400.0) + 0.2 * (1 - F.col("low"))
    return v.select("user_id", "first_event", "last_event", "n", F.round(score, 5).alias("score"))


@query("gap_assignment", f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, event_id AS gap, t AS lo, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS hi FROM e WHERE event_type = 'view'),
  d AS (SELECT user_id, event_id AS dip, t, value AS depth FROM e WHERE event_type = 'click'),
  n AS (SELECT d.*, gap, row_number() OVER (PARTITION BY dip ORDER BY greatest(0.0, lo - t, t - hi), gap) AS r FROM d JOIN g ON d.user_id = g.user_id AND hi IS NOT NULL AND greatest(0.0, lo - t, t - hi) <= 600),
  b AS (SELECT *, row_number() OVER (PARTITION BY user_id, gap ORDER BY depth DESC, dip) AS best FROM n WHERE r = 1)
  SELECT user_id, gap, dip, depth FROM b WHERE best = 1""")
def gap_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dip goes to the nearest gap between words, within a radius; a gap keeps its deepest."""
    e, order = events(spark, sf_dir), I.by("user_id", "t", "event_id")
    gaps = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("gap"), F.col("t").alias("lo"), F.lead("t").over(order).alias("hi")).where("hi is not null")
    dips = e.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("dip"), "t", F.col("value").alias("depth"))
    far = F.greatest(F.lit(0.0), F.col("lo") - F.col("t"), F.col("t") - F.col("hi"))
    near = dips.join(gaps, (F.col("u") == F.col("user_id")) & (F.col("lo") <= F.col("t") + 600) & (F.col("hi") >= F.col("t") - 600))
    own = near.groupBy("user_id", "dip", "depth").agg(F.min(F.struct(far.alias("far"), F.col("gap"))).alias("n")).where("n.far <= 600")
    best = own.groupBy("user_id", F.col("n.gap").alias("gap")).agg(F.min(F.struct((-F.col("depth")).alias("less"), F.col("dip"))).alias("b"))
    return best.select("user_id", "gap", "b.dip", (-F.col("b.less")).alias("depth"))


@query("context_rows", "SELECT d.o_orderkey, k FROM (SELECT o_orderkey, greatest(0, o_orderkey % 25 - 2) AS lo, least(24, o_orderkey % 25 + 2) AS hi FROM orders) d, LATERAL (SELECT unnest(range(lo, hi + 1)) AS k)")
def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places around a place, within the bounds of its chapter."""
    at = F.col("o_orderkey") % 25
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.greatest(F.lit(0), at - 2), F.least(F.lit(24), at + 2))).alias("k"))


@query("card_extents", """WITH c AS (SELECT conv_id, turn // 2 AS card, role, turn FROM conversations) SELECT conv_id, card, role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM c GROUP BY ALL""")
def card_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("card"), "role", "turn")
    return rows.groupBy("conv_id", "card", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("caption_choice", """WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS long_text, string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn) AS short_text FROM conversations GROUP BY conv_id)
  SELECT conv_id, CASE WHEN length(long_text) <= 2200 THEN 'full' WHEN length(short_text) <= 2200 THEN 'reduced' ELSE 'too long' END AS choice, md5(CASE WHEN length(long_text) <= 2200 THEN long_text WHEN length(short_text) <= 2200 THEN short_text ELSE '' END) AS digest FROM c""")
def caption_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full caption if it is short enough, else a reduced one, else none."""
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined(F.lit(True)).alias("full"), joined(F.col("role") == "user").alias("short"))
    fits = lambda name: F.length(name) <= 2200
    choice = F.when(fits("full"), "full").when(fits("short"), "reduced").otherwise("too long")
    return c.select("conv_id", choice.alias("choice"), F.md5(F.when(fits("full"), F.col("full")).when(fits("short"), F.col("short")).otherwise("")).alias("digest"))


@query("frequent_trigram", """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM benchmark),
  g AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda k: array_to_string(w[k : k + 2], ' '))) AS gram FROM w), c AS (SELECT gram, count(DISTINCT item_id) AS n FROM g GROUP BY gram)
  SELECT gram, n FROM c WHERE n >= 2""")
def frequent_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word trigrams that two items or more share."""
    w = T.words(F.col("text"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)), F.lit(1)), lambda k: F.array_join(F.slice("w", k, 3), " "))
    rows = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 3).select("item_id", F.explode(grams).alias("gram"))
    return rows.distinct().groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2")
