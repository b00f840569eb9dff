"""Queries over caption cards, overlapping chunks and captions beside a subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import search as S
from .base import EVENTS_SQL, events, query, table


@query("card_fit", r"""WITH v AS (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s FROM documents),
  w AS (SELECT doc_id, lang, list_transform(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: length(x)) AS l FROM v),
  z AS (SELECT doc_id, lang, l, ceil(len(l) / ceil(len(l) / 8.0))::BIGINT AS size FROM w WHERE len(l) > 0),
  c AS (SELECT doc_id, lang, unnest(list_transform(range(0, len(l), size), lambda i: l[i + 1 : i + size])) AS l FROM z),
  b AS (SELECT doc_id, lang, CASE WHEN len(l) = 1 OR (len(l) <= 4 AND list_sum(l) + len(l) - 1 <= 20) THEN {'over': false, 'widest': (list_sum(l) + len(l) - 1)::BIGINT, 'back': 0::BIGINT}
    ELSE list_min(list_transform(range(1, len(l)), lambda k: {'over': k > 4 OR len(l) - k > 4, 'widest': greatest(list_sum(l[1 : k]) + k - 1, list_sum(l[k + 1 : len(l)]) + len(l) - k - 1)::BIGINT, 'back': -k})) END AS cut FROM c),
  f AS (SELECT doc_id, cut.over AS fat, cut.widest <= CASE lang WHEN 'en' THEN 22 WHEN 'de' THEN 26 END AS fits FROM b),
  n AS (SELECT doc_id, count(*) AS cards, count(*) FILTER (fat) AS fat, count(*) FILTER (NOT fat AND NOT fits) AS wide, count(*) FILTER (NOT fat AND fits IS NULL) AS unmeasured FROM f GROUP BY doc_id)
  SELECT d.doc_id, coalesce(cards, 0) AS cards, coalesce(fat, 0) AS fat, coalesce(wide, 0) AS wide, coalesce(unmeasured, 0) AS unmeasured, round(coalesce((cards - fat - wide + 0.45::DOUBLE * wide) / cards, 0.0::DOUBLE), 6) AS score FROM documents d LEFT JOIN n USING (doc_id)""")
def card_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document's verses break into short caption lines; the cap on a line's characters is known for two languages."""
    cap = F.when(F.col("lang") == "en", 22).when(F.col("lang") == "de", 26)
    docs = S.spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return C.card_fit(docs, "doc_id", "text", cap).withColumn("score", F.round("score", 6))


@query("chunk_windows", f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, min(t) AS f, max(t) AS u, greatest(0, ceil((max(t) - min(t) - 90000.0::DOUBLE) / 79200.0::DOUBLE)::BIGINT) AS last FROM e GROUP BY user_id),
  c AS (SELECT user_id, f, u, last, unnest(range(last + 1)) AS chunk FROM r),
  s AS (SELECT user_id, chunk, last, f + chunk * 79200.0::DOUBLE AS s, f + chunk * 79200.0::DOUBLE + 90000.0::DOUBLE AS w, u FROM c)
  SELECT s.user_id, chunk, s, least(w, u) AS e, count(event_id) AS n FROM s LEFT JOIN e ON e.user_id = s.user_id AND t >= s AND (t < w OR (t = u AND chunk = last)) GROUP BY s.user_id, chunk, s, w, u""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 25 hours over each user's events, three hours of each shared with the next."""
    return C.chunked(events(spark, sf_dir), "user_id", "t", 90_000.0, 10_800.0)


@query("subject_layout", """WITH s AS (SELECT p_partkey, (1280 + p_size * 8)::BIGINT AS w, (720 + p_size % 7 * 30)::BIGINT AS h, CASE WHEN p_partkey % 5 <> 0 THEN (100 + p_partkey * 13 % 1100)::BIGINT END AS cx, (90 + p_partkey % 71)::BIGINT AS sw, (120 + p_partkey % 53)::BIGINT AS sh, (200 + p_partkey * 7 % 500)::BIGINT AS bottom, p_size % 2 = 0 AS upright FROM part),
  f AS (SELECT *, coalesce(cx - sw // 2, w // 2) AS l, coalesce(w - cx - sw // 2, w // 2) AS r, floor(h * 1080 / 1920.0::DOUBLE)::BIGINT // 2 * 2 AS cw FROM s)
  SELECT p_partkey, greatest(0, least(w - cw, coalesce(cx, w // 2) - cw // 2)) AS x, cw AS w, CASE WHEN upright THEN 0 WHEN r > l THEN w - r // 2 - w // 2 ELSE l // 2 - w // 2 END AS x_offset, CASE WHEN upright AND cx IS NOT NULL THEN least(floor(h * 0.78::DOUBLE)::BIGINT, bottom + floor(sh * 0.45::DOUBLE)::BIGINT) END AS top FROM f""")
def subject_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shots: the upright window around a subject, if one was seen, and where the caption goes."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    w, h, cx = 1280 + size * 8, 720 + size % 7 * 30, F.when(key % 5 != 0, 100 + key * 13 % 1100)
    place = C.caption_place(w, h, size % 2 == 0, cx, 90 + key % 71, 120 + key % 53, 200 + key * 7 % 500)
    return table(spark, sf_dir, "part").select("p_partkey", C.upright_window(w, h, cx).alias("c"), place.alias("p")).select("p_partkey", "c.x", "c.w", "p.x_offset", "p.top")
