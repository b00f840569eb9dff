"""Queries that frame shots: what lines say of a part are its frames, their medians its shot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import framing as G
from ..operators import reports as R
from ..operators import search as S
from .base import query, table

SHOTS_SQL = """f AS (SELECT l_partkey AS p_partkey, l_discount > 0.04 AS seen, (48 + l_partkey * 7 % 160 + l_quantity::BIGINT % 9) / 256.0::DOUBLE AS cx, (40 + l_partkey * 3 % 50 + l_quantity::BIGINT % 5) / 256.0::DOUBLE AS cy FROM lineitem),
  d AS (SELECT p_partkey, count(*) AS frames, count(*) FILTER (seen) AS hits, list_sort(list(cx) FILTER (seen)) AS cxs, list_sort(list(cy) FILTER (seen)) AS cys FROM f GROUP BY p_partkey),
  shots AS (SELECT p.p_partkey, [640, 1280, 1440, 1920][p_size % 4 + 1]::BIGINT AS width, [480, 720, 1080, 1080][p_size % 4 + 1]::BIGINT AS height, CASE WHEN hits * 2 >= frames THEN cxs[hits // 2 + 1] END AS cx, CASE WHEN hits * 2 >= frames THEN cys[hits // 2 + 1] END AS cy,
    (20 + p.p_partkey % 23) / 256.0::DOUBLE AS head_w, (30 + p.p_partkey % 17) / 256.0::DOUBLE AS head_h, (p.p_partkey % 11 - 5) / 256.0::DOUBLE AS lower, (24 + p.p_partkey % 40) / 256.0::DOUBLE AS reach_l, (24 + p.p_partkey % 37) / 256.0::DOUBLE AS reach_r,
    CASE p_size % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'frontal' END AS facing, p_size % 5 < 2 AS logo, p_size % 7 < 2 AS banner FROM part p LEFT JOIN d USING (p_partkey))"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shots: the medians of the frames that show a head, in 256ths of the frame, where half of them do."""
    key, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    at = lambda x: F.when(F.col("l_discount") > 0.04, x / 256.0)
    frames = table(spark, sf_dir, "lineitem").select(key.alias("p_partkey"), at(48 + key * 7 % 160 + q % 9).alias("cx"), at(40 + key * 3 % 50 + q % 5).alias("cy"))
    seen = R.quorum_medians(frames, "p_partkey", ["cx", "cy"])
    size, part, share = F.col("p_size"), F.col("p_partkey"), lambda x: x / 256.0
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), size % len(v) + 1)
    box = lambda x, y, w, h: F.struct(*(F.lit(v / 256).alias(n) for n, v in zip("xywh", (x, y, w, h))))
    boxes = F.filter(F.array(F.when(size % 5 < 2, box(8, 8, 30, 20)), F.when(size % 7 < 2, box(96, 220, 120, 24))), lambda b: b.isNotNull())
    shots = S.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).join(seen, "p_partkey", "left")
    return shots.select(
        "p_partkey", pick(640, 1280, 1440, 1920).cast("long").alias("width"), pick(480, 720, 1080, 1080).cast("long").alias("height"), "cx", "cy",
        share(20 + part % 23).alias("head_w"), share(30 + part % 17).alias("head_h"), (F.col("cy") + share(part % 11 - 5)).alias("face"),
        (F.col("cx") - share(24 + part % 40)).alias("body_left"), (F.col("cx") + share(24 + part % 37)).alias("body_right"), pick("left", "right", "frontal").alias("facing"), boxes.alias("boxes"),
    )


def framing_sql(style: G.Style) -> str:
    even = lambda x: f"(round_even(({x}) / 2.0::DOUBLE, 0) * 2)::BIGINT"
    down = lambda x: f"(floor(({x}) / 2.0::DOUBLE) * 2)::BIGINT"
    real = lambda x: f"{x}::DOUBLE"
    lo, hi = map(real, G.FACE_BAND)
    head, at, reach = real(G.HEADROOM), real(G.FACE_AT), real(G.REACH)
    if style.caption is None:
        targets, keep = "0.5::DOUBLE AS fx, 0.5::DOUBLE AS cap", "0.0::DOUBLE AS k_lo, (width - w)::DOUBLE AS k_hi"
    else:
        half = real(style.caption / 2)
        targets = f"CASE WHEN on_left THEN 1.0::DOUBLE - (margin + block / 2) ELSE margin + block / 2 END AS fx, CASE WHEN on_left THEN 1.0::DOUBLE - (margin + block + gap + {half}) ELSE margin + block + gap + {half} END AS cap"
        keep = f"""CASE WHEN on_left THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least((width - w)::DOUBLE, (cx + head_w / 2) * width - (cap - {half}) * w)) END AS k_lo,
      CASE WHEN on_left THEN greatest(0.0::DOUBLE, least((width - w)::DOUBLE, (cx - head_w / 2) * width - (cap + {half}) * w)) ELSE (width - w)::DOUBLE END AS k_hi"""
    free = real(1.0 - (style.caption or 0.0))
    move = lambda o, limit: f"CASE WHEN {o} % 2 = 1 THEN ({o} + 1) // 2 * step ELSE -({o} // 2) * step END"
    return f"""WITH {SHOTS_SQL},
  a AS (SELECT *, cy - head_h / 2 AS crown, CASE WHEN facing IN ('left', 'right') THEN facing = 'left' ELSE cx > 0.5 END AS on_left FROM shots WHERE cx IS NOT NULL),
  b AS (SELECT *, greatest(crown + {real(G.FACE_IN_HEAD[0])} * head_h, least(crown + {real(G.FACE_IN_HEAD[1])} * head_h, cy + lower)) AS face, greatest((cx - reach_l) * width, cx * width - {reach} * head_w * width, 0.0::DOUBLE) AS body_l, least((cx + reach_r) * width, cx * width + {reach} * head_w * width, width::DOUBLE) AS body_r FROM a),
  z0 AS (SELECT *, 1.0::DOUBLE - {real(G.ZOOM_STEP)} * i AS scale, {even(f"least(width::DOUBLE, height * {style.across} / {style.down}.0::DOUBLE) * (1.0::DOUBLE - {real(G.ZOOM_STEP)} * i)")} AS w FROM b, (SELECT unnest(range({G.ZOOMS})) AS i)),
  z1 AS (SELECT *, {even(f"w * {style.down} / {style.across}.0::DOUBLE")} AS h, least(head_w * width / w, 1.0::DOUBLE) AS block FROM z0 WHERE w >= {G.LEAST_WIDTH} AND w <= width),
  z2 AS (SELECT *, CASE WHEN ({free} - block) / 3 >= {real(G.LEAST_GAP)} THEN ({free} - block) / 3 ELSE 0.0::DOUBLE END AS margin, CASE WHEN ({free} - block) / 3 >= {real(G.LEAST_GAP)} THEN ({free} - block) / 3 ELSE greatest(({free} - block) / 2, {real(G.LEAST_GAP)}) END AS gap FROM z1 WHERE h <= height),
  z3 AS (SELECT *, {targets} FROM z2),
  z4 AS (SELECT *, {keep}, crown * height AS crown_px, face * height AS face_px FROM z3),
  z5 AS (SELECT * REPLACE (greatest(k_lo, k_hi) AS k_hi), greatest(0.0::DOUBLE, crown_px - {head} * h, face_px - {hi} * h) AS y_lo1, least((height - h)::DOUBLE, crown_px, face_px - {lo} * h) AS y_hi1, greatest(0.0::DOUBLE, crown_px - {head} * h) AS y_lo2, least((height - h)::DOUBLE, crown_px) AS y_hi2 FROM z4),
  z6 AS (SELECT *, greatest(k_lo, body_r - w) <= least(k_hi, body_l) AS contained, CASE WHEN y_lo1 <= y_hi1 THEN y_lo1 ELSE y_lo2 END AS y_lo, CASE WHEN y_lo1 <= y_hi1 THEN y_hi1 ELSE greatest(y_lo2, y_hi2) END AS y_hi FROM z5),
  z7 AS (SELECT *, CASE WHEN contained THEN greatest(k_lo, body_r - w) ELSE k_lo END AS e_lo, CASE WHEN contained THEN least(k_hi, body_l) ELSE k_hi END AS e_hi, {down("width - w")} AS last_x, {down("height - h")} AS last_y, greatest(8, w // 100) AS step FROM z6),
  z8 AS (SELECT *, least(greatest(0, (-floor(-e_lo / 2) * 2)::BIGINT), last_x) AS x_lo FROM z7),
  z9 AS (SELECT *, least(greatest(x_lo, {down("e_hi")}), last_x) AS x_hi, greatest(0, least({even(f"greatest(y_lo, least(y_hi, face_px - {at} * h))")}, last_y)) AS y0 FROM z8),
  z AS (SELECT *, {even("greatest(x_lo::DOUBLE, least(x_hi::DOUBLE, cx * width - fx * w))")} AS x0 FROM z9),
  xs AS (SELECT p_partkey, i, x, min(o) AS kx FROM (SELECT p_partkey, i, o, greatest(x_lo, least(x_hi, {even(f"greatest(x_lo, least(x_hi, x0 + {move('o', 'x')}))")})) AS x FROM (SELECT *, unnest(range(2 * (floor(w * {real(G.MOVE_X)})::BIGINT // step) + 1)) AS o FROM z)) GROUP BY p_partkey, i, x),
  ys AS (SELECT p_partkey, i, y, min(o) AS ky FROM (SELECT p_partkey, i, o, greatest(0, least(last_y, {even(f"greatest(y_lo, least(y_hi, (y0 + {move('o', 'y')})::DOUBLE))")})) AS y FROM (SELECT *, unnest(range(2 * (floor(h * {real(G.MOVE_Y)})::BIGINT // step) + 1)) AS o FROM z)) GROUP BY p_partkey, i, y),
  c AS (SELECT z.p_partkey, z.i, scale, kx, ky, x, y, w, h, contained, cap, abs((cx * width - x) / w - fx) AS aside, abs((face * height - y) / h - {at}) AS off,
      (logo AND x < 8 / 256.0::DOUBLE * width - 6 + 30 / 256.0::DOUBLE * width + 12 AND 8 / 256.0::DOUBLE * width - 6 < x + w AND y < 8 / 256.0::DOUBLE * height - 6 + 20 / 256.0::DOUBLE * height + 12 AND 8 / 256.0::DOUBLE * height - 6 < y + h)
      OR (banner AND x < 96 / 256.0::DOUBLE * width - 6 + 120 / 256.0::DOUBLE * width + 12 AND 96 / 256.0::DOUBLE * width - 6 < x + w AND y < 220 / 256.0::DOUBLE * height - 6 + 24 / 256.0::DOUBLE * height + 12 AND 220 / 256.0::DOUBLE * height - 6 < y + h) AS blocked
    FROM z JOIN xs ON xs.p_partkey = z.p_partkey AND xs.i = z.i JOIN ys ON ys.p_partkey = z.p_partkey AND ys.i = z.i),
  r AS (SELECT *, aside > {real(style.gate)} AS forced, {real(style.x)} * aside + {real(style.y)} * off + {real(style.zoom)} * (1.0::DOUBLE - scale) AS cost FROM c),
  per AS (SELECT p_partkey, i, scale, min({{'forced': forced, 'blocked': blocked, 'cost': cost, 'zoom': i, 'kx': kx, 'ky': ky, 'x': x, 'y': y, 'w': w, 'h': h, 'contained': contained, 'near': aside < {real(G.CONTENT_X)}, 'cap': cap}}) AS place FROM r GROUP BY p_partkey, i, scale),
  upto AS (SELECT p_partkey, i, scale, min(place) OVER (PARTITION BY p_partkey ORDER BY i) AS place FROM per),
  best AS (SELECT p_partkey, coalesce(arg_min(place, i) FILTER (scale > {real(G.CONTENT_ZOOM)} AND NOT place.forced AND NOT place.blocked AND place.near), arg_max(place, i)) AS b FROM upto GROUP BY p_partkey),
  cen AS (SELECT p_partkey, width, height, {down(f"least(width::DOUBLE, height * {style.across} / {style.down}.0::DOUBLE)")} AS cw FROM shots),
  cen2 AS (SELECT *, {down(f"least(height::DOUBLE, cw * {style.down} / {style.across}.0::DOUBLE)")} AS ch FROM cen)
  SELECT p_partkey, CASE WHEN b IS NULL THEN 'centred' WHEN b.forced THEN 'forced' WHEN b.blocked THEN 'blocked' ELSE 'framed' END AS state, b.zoom::INTEGER AS zoom, coalesce(b.x, {down("floor((width - cw) / 2.0)")}) AS x, coalesce(b.y, {down("floor((height - ch) / 2.0)")}) AS y, coalesce(b.w, cw) AS w, coalesce(b.h, ch) AS h, b.contained AS contained, round(b.cost, 6) AS cost,
    coalesce(round_even((b.cap - 0.5) * {style.canvas}, 0)::BIGINT, 0) AS x_offset FROM cen2 LEFT JOIN best USING (p_partkey)"""


@query("framing_beside", framing_sql(G.STYLES["bars"]))
def framing_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for each shot with the head beside a column of captions: medians of its frames, the best place of the first content zoom."""
    return G.framed(_shots(spark, sf_dir), "p_partkey", G.STYLES["bars"]).withColumn("cost", F.round("cost", 6))


@query("framing_upright", framing_sql(G.STYLES["vertical"]))
def framing_upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upright window for each shot, which has no column beside the head."""
    return G.framed(_shots(spark, sf_dir), "p_partkey", G.STYLES["vertical"]).withColumn("cost", F.round("cost", 6))
