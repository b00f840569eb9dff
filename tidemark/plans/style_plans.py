"""Queries over settings, names, colours and block anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import style as Y
from ..operators import naming as N
from .base import EVENTS_SQL, events, query, table

SETTINGS_SQL = """s AS (SELECT p_partkey AS style, unnest(['text.size_px', 'text.lead_pt', 'text.ratio', 'frame.width_px', 'name']) AS path, unnest([p_size::VARCHAR, (p_size * 3)::VARCHAR, (p_size / 16.0)::VARCHAR, (p_size * 7 + 1)::VARCHAR, p_type]) AS value, unnest(['int', 'int', 'float', 'int', 'text']) AS kind FROM part)"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(style, path, value, kind): parts in the role of style templates."""
    size = F.col("p_size")
    rows = [("text.size_px", size, "int"), ("text.lead_pt", size * 3, "int"), ("text.ratio", size / 16.0, "float"), ("frame.width_px", size * 7 + 1, "int"), ("name", F.col("p_type"), "text")]
    listed = F.array(*(F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"), F.lit(k).alias("kind")) for p, v, k in rows))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("style"), F.inline(listed))


@query("style_scaled", f"""WITH {SETTINGS_SQL}, z AS (SELECT style, path, kind, CASE WHEN path = 'name' THEN value WHEN kind = 'int' THEN round_even(TRY_CAST(value AS DOUBLE) * 0.5, 0)::BIGINT::VARCHAR ELSE round_even(TRY_CAST(value AS DOUBLE) * 0.5, 4)::VARCHAR END AS value FROM s)
  SELECT style, path, CASE WHEN path = 'frame.width_px' AND value::BIGINT % 2 = 1 THEN (value::BIGINT - 1)::VARCHAR ELSE value END AS value FROM z""")
def style_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each style's settings at half size, the frame's width kept even."""
    half = _settings(spark, sf_dir).withColumn("value", Y.scaled(F.col("value"), F.col("kind"), 0.5))
    return half.select("style", "path", F.when(F.col("path") == "frame.width_px", Y.made_even(F.col("value"))).otherwise(F.col("value")).alias("value"))


@query("unlisted_pixels", f"WITH {SETTINGS_SQL} SELECT style, path FROM s WHERE (path LIKE '%\\_px' ESCAPE '\\' OR path LIKE '%\\_pt' ESCAPE '\\') AND path NOT IN ('text.size_px', 'text.ratio')")
def unlisted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in pixels or points that a list of scaled paths forgets."""
    listed = spark.createDataFrame([("text.size_px",), ("text.ratio",)], "path string")
    return N.unlisted(_settings(spark, sf_dir), listed).select("style", "path")


@query("endpoint_list", """WITH e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN [] ELSE [['static', 'http://' || s_name], ['static', 'https://u:pw@' || s_name || '.net']] END || [['datacenter', 'http://u@h' || s_nationkey], ['datacenter', 'http://z']] AS x FROM supplier),
  r AS (SELECT s_suppkey, unnest(x) AS p, unnest(range(len(x))) AS place FROM e) SELECT s_suppkey, place, p[1] AS tier, p[2] AS url, p[1] || ' ' || CASE WHEN contains(p[2], '@') THEN split_part(p[2], '@', 2) ELSE p[2] END AS label FROM r""")
def endpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's endpoints, those of the first tier before those of the second."""
    name, nation = F.col("s_name"), F.col("s_nationkey").cast("string")
    first = F.when(F.col("s_suppkey") % 5 != 0, F.concat(name, F.lit(", ,https://u:pw@"), name, F.lit(".net,")))
    second = F.concat(F.lit(" u@h"), nation, F.lit(" ,z"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(Y.endpoints([("static", first), ("datacenter", second)])).alias("place", "e"))
    return rows.select("s_suppkey", F.col("place").cast("long").alias("place"), "e.tier", "e.url", "e.label")


@query("resolved_names", """WITH c AS (SELECT 'clip-' || c_custkey AS clip, c_custkey AS k, upper(regexp_replace(regexp_replace(lower(coalesce(CASE WHEN c_custkey % 11 > 0 THEN 'Al ' || c_mktsegment END, 'unknown')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) || '-' || n_name || '-' || (c_custkey % 9) || '-' || (c_custkey % 9 + 3) || '.mp4' AS derived FROM customer JOIN nation ON n_nationkey = c_nationkey),
  f AS (SELECT DISTINCT derived AS file FROM c WHERE k % 3 > 0), b AS (SELECT derived AS file, min(clip) AS owner FROM c GROUP BY derived),
  a AS (SELECT k AS id, CASE k % 4 WHEN 0 THEN clip WHEN 1 THEN lower(derived) WHEN 2 THEN replace(derived, '.mp4', '') ELSE 'no-' || clip END AS arg FROM c),
  w AS (SELECT id, arg, CASE WHEN ends_with(lower(arg), '.mp4') THEN lower(arg) ELSE lower(arg) || '.mp4' END AS want FROM a),
  l AS (SELECT lower(file) AS want, min(file) AS file FROM f GROUP BY ALL)
  SELECT id, CASE WHEN c.clip IS NOT NULL THEN c.clip ELSE b.owner END AS clip, CASE WHEN c.clip IS NOT NULL THEN f.file ELSE l.file END AS file FROM w LEFT JOIN c ON c.clip = arg LEFT JOIN f ON f.file = c.derived LEFT JOIN l USING (want) LEFT JOIN b ON b.file = l.file""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the role of clips, asked for by their own name, by a file's name in any case, or by a name that nothing has."""
    k = F.col("c_custkey")
    owner = F.when(k % 11 > 0, F.concat(F.lit("Al "), F.col("c_mktsegment")))
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    clips = named.select(F.concat(F.lit("clip-"), k.cast("string")).alias("clip"), k.alias("k"), Y.derived_name(owner, F.col("n_name"), k % 9, k % 9 + 3).alias("derived"))
    how = F.col("k") % 4
    arg = F.when(how == 0, F.col("clip")).when(how == 1, F.lower("derived")).when(how == 2, F.replace("derived", F.lit(".mp4"), F.lit(""))).otherwise(F.concat(F.lit("no-"), F.col("clip")))
    files = clips.where("k % 3 > 0").select(F.col("derived").alias("file"))
    return N.resolved(clips.select(F.col("k").alias("id"), arg.alias("arg")), clips.select("clip", "derived"), files)


@query("scalar_forms", """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders)
  SELECT k, translate(k::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS is_on,
    CASE WHEN k % 7 > 0 AND k % 1000 * 9 >= k % 7 * 1000 THEN k % 7 * 1000 // 2 ELSE k % 1000 * 9 END AS cover, least((k % 90 + k % 90 + k % 8 / 2.0) / 2, k % 90 + 0.75) AS mid,
    k % 3 <> 1 AS is_time, v >= 100000 AND k % 6 > 0 AS usable, greatest(10, floor(2 * greatest(1, least(k % 1080 - 60, 1080 - 60 - k % 1080)) / ((20 + k % 30) * 0.32)))::INTEGER AS chars,
    CASE WHEN k % 2 = 0 THEN 'a' || k || CASE WHEN k % 3 = 0 THEN ' b' ELSE '' END WHEN k % 5 = 0 THEN '' ELSE 'whole' END AS caption FROM o""")
def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rules over numbers that orders give: digits, switches, covers, middles of gaps, literals, usable files, room for characters, captions."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    switch = F.element_at(F.array(F.lit(None).cast("string"), F.lit(" Yes "), F.lit("off"), F.lit("2"), F.lit("0")), (k % 5 + 1).cast("int"))
    spec = F.when(k % 3 == 0, " 1:02.5 ").when(k % 3 == 1, "1m02s").otherwise("75")
    start = (k % 90).cast("double")
    text = k.cast("string")
    two, second = F.when(k % 2 == 0, F.concat(F.lit("a"), text)), F.when(k % 3 == 0, "b").otherwise("")
    return o.select(
        k.alias("k"),
        Y.arabic_digits(k).alias("digits"),
        Y.switched_on(switch).alias("is_on"),
        Y.cover_at(k % 1000 * 9, k % 7 * 1000).alias("cover"),
        Y.inside_gap(start, start + k % 8 / 2.0).alias("mid"),
        Y.is_timestamp(spec).alias("is_time"),
        Y.is_usable(F.col("o_totalprice"), k % 6).alias("usable"),
        Y.most_chars(k % 1080, F.lit(1080), F.lit(60), 20 + k % 30).alias("chars"),
        Y.caption(F.when(k % 5 != 0, "whole"), two, second).alias("caption"),
    )


@query("drawn_colours", """WITH h AS (SELECT p_partkey, (p_partkey * 7919 % 16777216) AS x FROM part), c AS (SELECT p_partkey, x // 65536 AS r0, x // 256 % 256 AS g0, x % 256 AS b0 FROM h),
  l AS (SELECT *, greatest(r0, g0, b0) / 255.0::DOUBLE AS hi, least(r0, g0, b0) / 255.0::DOUBLE AS lo FROM c), m AS (SELECT *, (hi + lo) / 2 AS li, hi - lo AS ch FROM l),
  d AS (SELECT *, greatest(0.0, 1 - (1 - li) / (1 - 0.18::DOUBLE)) AS dk FROM m), f AS (SELECT *, CASE WHEN ch > 0 THEN least(1.0, ch / (1 - abs(2 * li - 1)) / 0.9::DOUBLE) * (1 - abs(2 * dk - 1)) / ch ELSE 0 END AS q FROM d)
  SELECT p_partkey, r0::INTEGER AS r0, g0::INTEGER AS g0, b0::INTEGER AS b0, round_even((dk + q * (r0 / 255.0::DOUBLE - li)) * 255, 0)::INTEGER AS r, round_even((dk + q * (g0 / 255.0::DOUBLE - li)) * 255, 0)::INTEGER AS g, round_even((dk + q * (b0 / 255.0::DOUBLE - li)) * 255, 0)::INTEGER AS b FROM f""")
def drawn_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour of each part, and the one to draw for a screen that lifts it."""
    code = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16_777_216), 6, "0"))
    seen = table(spark, sf_dir, "part").select("p_partkey", Y.rgb(code).alias("c"))
    drawn = seen.select("p_partkey", "c", Y.drawn_before(F.col("c"), 0.18, 0.9).alias("d"))
    return drawn.select("p_partkey", F.col("c.r").alias("r0"), F.col("c.g").alias("g0"), F.col("c.b").alias("b0"), "d.r", "d.g", "d.b")


@query("centred_blocks", """WITH b AS (SELECT l_orderkey AS clip, (900 + l_quantity + (900 + l_quantity + l_linenumber * 40)) / 2.0::DOUBLE AS mid FROM lineitem),
  m AS (SELECT clip, mid, row_number() OVER (PARTITION BY clip ORDER BY mid) AS r, count(*) OVER (PARTITION BY clip) AS n FROM b), s AS (SELECT clip, round_even(0.55::DOUBLE - (mid / 1900 - 0.5::DOUBLE), 3) AS anchor FROM m WHERE r = n // 2 + 1)
  SELECT clip AS l_orderkey, any_value(anchor) AS anchor, round(min(mid) / 1900 - 0.5::DOUBLE + any_value(anchor), 4) AS lowest, round(max(mid) / 1900 - 0.5::DOUBLE + any_value(anchor), 4) AS highest FROM b JOIN s USING (clip) GROUP BY clip""")
def centred_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order in the role of a clip's caption blocks: the anchor that centres the median one."""
    top = F.lit(900.0) + F.col("l_quantity")
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", top.alias("top"), (top + F.col("l_linenumber") * 40).alias("bottom"))
    return N.centred_blocks(blocks, "l_orderkey", 1900, 0.55)  # a height without ties in the last decimal


@query("hop_levels", f"""WITH {EVENTS_SQL} SELECT user_id, floor(t / 3600.0) * 3600.0 AS t, round(20 * log10(greatest(1e-6, sqrt(avg(value * value)))), 6) AS db FROM e GROUP BY user_id, floor(t / 3600.0)""")
def hop_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of each user's events by the hour."""
    return N.hop_levels(events(spark, sf_dir), "user_id", "t", "value", 3600.0).withColumn("db", F.round("db", 6))


@query("cached_spans", """WITH f AS (SELECT p_partkey, 'heat_' || p_size || CASE WHEN p_partkey % 3 = 0 THEN 's' WHEN p_partkey % 3 = 1 THEN 'sec' ELSE '' END || '_o' || p_partkey % 4 || '.mp4' AS name FROM part)
  SELECT p_partkey, regexp_extract(name, '^heat_([0-9]+)s_o2[.]mp4$', 1)::INTEGER AS seconds FROM f WHERE regexp_matches(name, '^heat_[0-9]+s_o2[.]mp4$')""")
def cached_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, in seconds, that names of cached files say, of those made with the settings asked for."""
    ending = F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "sec").otherwise("")
    name = F.concat(F.lit("heat_"), F.col("p_size").cast("string"), ending, F.lit("_o"), (F.col("p_partkey") % 4).cast("string"), F.lit(".mp4"))
    span = F.regexp_extract(name, "^heat_([0-9]+)s_o2[.]mp4$", 1)
    return table(spark, sf_dir, "part").select("p_partkey", span.try_cast("int").alias("seconds")).where("seconds is not null")
