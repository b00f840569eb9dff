r"""DuckDB SQL of the queries of this subpackage that SQL can express: those whose results a contract fixes word by word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .personal_data import KINDS, find
from .quality_rules import filter_quality
from .whitening import op11_whitening

#: (doc_id, w): the words of a text, none of a null one. RE2's \v is the vertical tab.
WORDS = r"SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents"

SUBSTRING_DEDUP = f"""WITH d AS ({WORDS.format(text="text")}),
  win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
  gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(20)) AS k)),
  place AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM d),
  left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM place ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, len(d.w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)"""

#: Equal sets are one class, named after its first document; links are looked for between classes of sizes that allow one.
JACCARD_JOIN = f"""WITH RECURSIVE d AS ({WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}),
  sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM d),
  named AS (SELECT doc_id, s, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(s, chr(10)))) END AS class FROM sets),
  class AS MATERIALIZED (SELECT doc_id AS class, n_shingles AS n, s FROM named WHERE doc_id = class AND n_shingles > 0),
  token AS MATERIALIZED (SELECT class, n, hash(unnest(s)) AS h FROM class),
  pair AS MATERIALIZED (SELECT a.class AS a, b.class AS b FROM token a JOIN token b ON a.h = b.h AND a.class < b.class AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  edge AS MATERIALIZED (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
  reach AS (SELECT DISTINCT a AS class, a AS other FROM edge UNION SELECT r.class, e.b FROM reach r JOIN edge e ON r.other = e.a),
  component AS (SELECT class, min(other) AS component_id FROM reach GROUP BY class)
  SELECT doc_id, n_shingles, coalesce(component_id, class) AS component_id FROM named LEFT JOIN component USING (class)"""

#: What op5_quality_rules says before its learned rules.
BASE_STATISTICS = rf"""WITH d AS (SELECT t.doc_id, t.text, w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) t JOIN ({WORDS.format(text="text")}) USING (doc_id)),
  win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 8], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) >= 8))),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM win, (SELECT unnest(range(8)) AS k) WHERE n > 1 GROUP BY doc_id),
  c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines FROM d)
  SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN rep USING (doc_id)"""

#: What op6_personal_data finds by its fixed kinds. Two matches of a kind don't overlap, so that they can be counted without their places.
BASE_PERSONAL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  m AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
    list_transform(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_transform(string_split(x, '.'), lambda p: ltrim(p, '0'))) AS ips,
    list_filter(list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: length(x) BETWEEN 16 AND 19) AS cards,
    list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d)
  SELECT doc_id, n_email,
    len(list_filter(ips, lambda x: len(list_filter(x, lambda p: length(p) > 3 OR coalesce(try_cast(p AS INTEGER), 0) > 255)) = 0))::BIGINT AS n_ip,
    len(list_filter(cards, lambda x: list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[i + 1]::INTEGER WHEN x[i + 1]::INTEGER > 4 THEN 2 * x[i + 1]::INTEGER - 9 ELSE 2 * x[i + 1]::INTEGER END)) % 10 = 0))::BIGINT AS n_card,
    len(list_filter(phones, lambda n: n BETWEEN 8 AND 15))::BIGINT AS n_phone FROM m"""

#: (vec_id, label, x): the rows whose vector counts, as whole 256ths.
VECTORS = "x AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)"


def _nearest(books: str) -> str:
    """Each part with its nearest entry: the least of (distance, entry), both in one number."""
    return f"""SELECT p.vec_id, p.label, p.part, any_value(p.v) AS v, min(c.entry + 64 * list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))) AS m
    FROM p JOIN {books} c USING (part) GROUP BY p.vec_id, p.label, p.part"""


def _learned(books: str, near: str) -> str:
    return f"""SELECT part, entry, coalesce(mean, v) AS v FROM {books} LEFT JOIN (SELECT part, entry, list(mean ORDER BY place) AS mean FROM
      (SELECT part, (m % 64)::BIGINT AS entry, place, floor(sum(v[place]) / count(*))::BIGINT AS mean FROM {near}, (SELECT unnest(range(1, 5)) AS place) GROUP BY part, (m % 64)::BIGINT, place) GROUP BY part, entry) USING (part, entry)"""


VECTOR_CODES = f"""WITH {VECTORS},
  p AS MATERIALIZED (SELECT vec_id, label, part, x[4 * part + 1 : 4 * part + 4] AS v FROM x, (SELECT unnest(range(16)) AS part)),
  b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM x ORDER BY vec_id LIMIT 64)),
  n0 AS MATERIALIZED ({_nearest("b0")}), b1 AS MATERIALIZED ({_learned("b0", "n0")}),
  n1 AS MATERIALIZED ({_nearest("b1")}), b2 AS MATERIALIZED ({_learned("b1", "n1")}),
  n2 AS MATERIALIZED ({_nearest("b2")}),
  coded AS (SELECT vec_id, label, string_agg(printf('%02x', (m % 64)::INTEGER), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM n2 GROUP BY vec_id, label)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM coded"""

#: What op11_whitening returns exactly, without eigenvectors.
BASE_DEVIATIONS = f"""WITH {VECTORS},
  fit AS (SELECT DISTINCT x FROM x),
  place AS (SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM fit),
  mean AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, sum(c)::BIGINT AS s FROM place GROUP BY i)),
  size AS (SELECT count(*) AS n FROM fit)
  SELECT vec_id, n, list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i])))::BIGINT AS deviation FROM x, mean, size"""

#: Windows are bytes; a passage's first document is the one with the smallest id.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
  win AS (SELECT doc_id, i, array_slice(b, i + 1, i + 50) AS w FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS i FROM d WHERE octet_length(b) >= 50)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first_id FROM win) WHERE doc_id > first_id),
  run AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later)),
  span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM run GROUP BY doc_id, r),
  gone AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
  SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(CASE WHEN starts IS NULL THEN b ELSE unhex(list_aggregate(list_transform(range(len(starts) + 1), lambda k:
      hex(array_slice(b, CASE WHEN k = 0 THEN 1 ELSE ends[k] + 1 END, CASE WHEN k = len(starts) THEN octet_length(b) ELSE starts[k + 1] END))), 'string_agg', '')) END) AS kept_sha256
  FROM d LEFT JOIN gone USING (doc_id)"""

SQL = {"op13_suffix_dedup": SUFFIX_DEDUP, "op12_vector_codes": VECTOR_CODES, "base_deviations": BASE_DEVIATIONS, "op8_substring_dedup": SUBSTRING_DEDUP, "op9_jaccard_join": JACCARD_JOIN, "base_statistics": BASE_STATISTICS, "base_personal_data": BASE_PERSONAL}


def base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the base rule of op5_quality_rules, without learned rules."""
    return filter_quality(table(spark, sf_dir, "documents"), []).drop("kept")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each fixed kind op6_personal_data finds, without learned patterns."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(table(spark, sf_dir, "documents"), {}).select("doc_id", *map(count, KINDS[:4]))


def base_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op11_whitening, of its first component."""
    return op11_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")
