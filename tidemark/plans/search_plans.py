"""Queries over texts: index, search, votes, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import lookup as L
from ..operators import search as S
from .base import query, table

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
SKELETON = "CASE WHEN length(translate({t}, 'aeiouy', '')) >= 2 THEN translate({t}, 'aeiouy', '') ELSE {t} END"

SEARCH_CTES = f"""
post AS (SELECT doc_id AS doc, token, pos, {SKELETON.format(t="token")} AS skel FROM (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents))),
ex AS (SELECT token, count(*) AS np, count(DISTINCT doc) AS df FROM post GROUP BY token),
sk AS (SELECT skel, count(*) AS np, count(DISTINCT doc) AS df FROM post GROUP BY skel),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
w AS (SELECT q.*, ex.np IS NOT NULL AS is_exact, coalesce(ex.np, sk.np) AS np,
        CASE WHEN coalesce(ex.df, sk.df) IS NULL THEN 1.0 ELSE ln(1 + n.n / coalesce(ex.df, sk.df)) END AS w
      FROM q LEFT JOIN ex USING (token) LEFT JOIN sk USING (skel), n),
tot AS (SELECT query, sum(w) AS total_w FROM w GROUP BY query),
hit AS (SELECT query, qi, doc, pos, w.w AS vote FROM w JOIN post USING (token) WHERE is_exact AND np <= 4000
        UNION ALL SELECT query, qi, doc, pos, w.w * 0.6 FROM w JOIN post ON w.skel = post.skel WHERE NOT is_exact AND np <= 4000),
fol AS (SELECT *, CASE WHEN lead(qi) OVER (PARTITION BY query, doc, pos - qi ORDER BY qi) = qi + 1 THEN 1 ELSE 0 END AS f FROM hit),
sc AS (SELECT query, doc, round((sum(vote) + 1.2 * sum(f)) / greatest(any_value(total_w), 1e-6), 6) AS score, count(DISTINCT qi) AS hits
       FROM fol JOIN tot USING (query) GROUP BY query, doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)"""
ITEM_TOKENS = f"""q AS (SELECT item_id AS query, qi, token, {SKELETON.format(t="token")} AS skel FROM (
  SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS qi FROM (SELECT item_id, {WORDS} AS w FROM benchmark)))"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    docs = table(spark, sf_dir, "documents")
    return S.worded(docs, "doc_id", T.words), docs.count()


def _item_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.posexplode(T.words(F.col("text"))).alias("qi", "token"))


@query("rank_search_idf", f"WITH {ITEM_TOKENS}, {SEARCH_CTES} SELECT query AS item_id, doc AS doc_id, score, hits, rank FROM ranked WHERE rank <= 3")
def rank_search_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = _index(spark, sf_dir)
    out = S.ranked(*S.matches(docs, _item_tokens(spark, sf_dir), T.skeleton, n), 3)
    return out.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "hits", "rank")


@query("index_df_idf", f"""WITH p AS (SELECT doc_id, unnest({WORDS}) AS token FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
  SELECT token, count(*) AS np, count(DISTINCT doc_id) AS df, round(ln(1 + any_value(n) / count(DISTINCT doc_id)), 6) AS idf FROM p, n GROUP BY token""")
def index_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = _index(spark, sf_dir)
    return S.form_stats(docs).select("token", "np", "df", F.round(F.ln(1 + F.lit(float(n)) / F.col("df")), 6).alias("idf"))


HOPS = """list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(0, ceil((len(w) - 12) / 3.0)::BIGINT) + 1 END), lambda k: {'start': k * 3, 'words': w[k * 3 + 1 : k * 3 + 12]})"""


@query("hop_windows", f"""WITH h AS (SELECT conv_id, turn, unnest({HOPS}) AS x FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations))
  SELECT conv_id, turn, x.start AS start, len(x.words) AS n, md5(array_to_string(x.words, ' ')) AS digest FROM h""")
def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = S.spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", T.words(F.col("text")).alias("words"))
    rows = said.select("conv_id", "turn", F.explode_outer(S.hopping(F.col("words"))).alias("x")).where("x is not null")
    return rows.select("conv_id", "turn", F.col("x.start").cast("long").alias("start"), F.size("x.words").cast("long").alias("n"), F.md5(F.array_join("x.words", " ")).alias("digest"))


@query("chunk_vote_label", f"""WITH h AS (SELECT item_id, unnest({HOPS}) AS x FROM (SELECT item_id, {WORDS} AS w FROM benchmark)),
  q AS (SELECT query, qi, token, {SKELETON.format(t="token")} AS skel FROM (SELECT item_id * 1000 + x.start AS query, unnest(x.words) AS token, unnest(range(len(x.words))) AS qi FROM h)),
  {SEARCH_CTES},
  won AS (SELECT query // 1000 AS item_id, doc AS doc_id, source FROM ranked JOIN documents ON doc = doc_id WHERE rank = 1),
  votes AS (SELECT item_id, source, count(*) AS n FROM won GROUP BY ALL),
  best AS (SELECT item_id, source, n, sum(n) OVER (PARTITION BY item_id) AS windows, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, source) AS r FROM votes)
  SELECT b.item_id, b.source AS label, b.n AS votes, b.windows::BIGINT AS windows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM best b JOIN won USING (item_id, source) WHERE r = 1 GROUP BY ALL""")
def chunk_vote_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window of an item votes for the source of its best document; the item gets the most frequent one and the range of documents that voted for it."""
    texts, n = _index(spark, sf_dir)
    windows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(S.hopping(T.words(F.col("text")))).alias("x"))
    queries = windows.select((F.col("item_id") * 1000 + F.col("x.start")).alias("query"), F.posexplode("x.words").alias("qi", "token"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    won = S.ranked(*S.matches(texts, queries, T.skeleton, n), 1).join(docs, "doc").select(F.floor(F.col("query") / 1000).alias("item_id"), "doc", "source")
    votes = won.groupBy("item_id", "source").agg(F.count("*").alias("votes"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    of = Window.partitionBy("item_id")
    best = votes.withColumn("windows", F.sum("votes").over(of)).withColumn("r", F.row_number().over(of.orderBy(F.desc("votes"), "source")))
    return best.where("r = 1").select("item_id", F.col("source").alias("label"), "votes", "windows", "first_doc", "last_doc")


@query("positional_vote", f"""WITH {ITEM_TOKENS}, {SEARCH_CTES},
  cand AS (SELECT DISTINCT query, doc, score, qi FROM ranked JOIN hit USING (query, doc) WHERE rank <= 6 AND score >= 0.2),
  isl AS (SELECT *, qi - row_number() OVER (PARTITION BY query, doc ORDER BY qi) AS g FROM cand),
  ph AS (SELECT *, count(*) OVER (PARTITION BY query, doc, g) AS run FROM isl),
  v AS (SELECT query, qi, doc, score, sum(score) OVER (PARTITION BY query, qi) AS total, row_number() OVER (PARTITION BY query, qi ORDER BY score DESC, doc) AS r FROM ph WHERE run >= 2)
  SELECT query AS item_id, qi, doc AS doc_id, round(score / total, 4) AS share FROM v WHERE r = 1""")
def positional_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of an item gets the document with the most weight among the candidates that match it within a phrase, and that document's share of the weight."""
    docs, n = _index(spark, sf_dir)
    hits, totals = S.matches(docs, _item_tokens(spark, sf_dir), T.skeleton, n)
    best = S.ranked(hits, totals, 6).where("score >= 0.2").select("query", "doc", "score")
    found = hits.join(best, ["query", "doc"]).select("query", "doc", "score", "qi").distinct()
    votes = S.phrase_runs(found, ["query", "doc"], "qi")
    at = Window.partitionBy("query", "qi")
    shares = votes.withColumn("total", F.sum("score").over(at)).withColumn("r", F.row_number().over(at.orderBy(F.desc("score"), "doc")))
    return shares.where("r = 1").select(F.col("query").alias("item_id"), F.col("qi").cast("long").alias("qi"), F.col("doc").alias("doc_id"), F.round(F.col("score") / F.col("total"), 4).alias("share"))


@query("text_normalize", f"SELECT doc_id, len({WORDS}) AS n_tokens, md5(array_to_string({WORDS}, ' ')) AS digest FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(t)).cast("long").alias("n_tokens"), F.md5(T.normalized(t)).alias("digest"))


@query("tokens_split", r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
  SELECT item_id, CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN w[:-2] ELSE w END AS token, count(*) AS n FROM t GROUP BY ALL""")
def tokens_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.english_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("item_id", "token").agg(F.count("*").alias("n"))


@query("skeleton_key", f"""WITH t AS (SELECT unnest({WORDS}) AS token FROM documents), k AS (SELECT token, {SKELETON.format(t="token")} AS skel FROM t)
  SELECT skel, count(*) AS n, count(DISTINCT token) AS n_forms, min(token) AS first_form FROM k GROUP BY skel""")
def skeleton_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = S.postings(S.worded(table(spark, sf_dir, "documents"), "doc_id", T.words))
    forms = post.groupBy("token").agg(F.count("*").alias("n")).withColumn("skel", T.skeleton(F.col("token")))
    return forms.groupBy("skel").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"), F.min("token").alias("first_form"))


@query("nfc_equal", "SELECT doc_id, text = nfc_normalize(text) AS is_nfc, md5(nfc_normalize(text)) AS digest FROM documents")
def nfc_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("canonical", T.nfc("text"))
    return docs.select("doc_id", (F.col("text") == F.col("canonical")).alias("is_nfc"), F.md5("canonical").alias("digest"))


@query("arabic_forms", r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word FROM benchmark)
  SELECT count(*) AS n_words, 0 AS n_with_letters FROM w""")
def arabic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that hold a letter once marks are dropped; the tables' texts are Latin, so none of theirs does."""
    word = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return word.agg(F.count("*").alias("n_words"), F.count_if(T.arabic_letters(F.col("word")) != "").cast("int").alias("n_with_letters"))


#: The cut after chunk k of four: at a comma or semicolon within three words of the even place, the nearest first.
CUT = """, c{k} AS (SELECT *, greatest(at{before} + 1, least(coalesce(list_filter(list_transform([0, 1, -1, 2, -2, 3, -3], lambda o: round_even(n / 4.0 * {k}, 0)::BIGINT + o),
  lambda c: c > 0 AND c < n AND regexp_matches(w[c], '[,;]$'))[1], round_even(n / 4.0 * {k}, 0)::BIGINT), n - 4 + {k})) AS at{k} FROM c{before})"""
SPLIT_SQL = (
    r"WITH c0 AS (SELECT doc_id, w, len(w) AS n, 0::BIGINT AS at0 FROM (SELECT doc_id, regexp_split_to_array(trim(text), '[ \t\n\v\f\r]+') AS w FROM documents))"
    + "".join(CUT.format(k=k, before=k - 1) for k in (1, 2, 3))
    + """, p AS (SELECT doc_id, unnest(range(4))::INTEGER AS part, CASE WHEN n <= 4 THEN list_resize(w, 4, '')
    ELSE [array_to_string(w[1:at1], ' '), array_to_string(w[at1 + 1:at2], ' '), array_to_string(w[at2 + 1:at3], ' '), array_to_string(w[at3 + 1:], ' ')] END AS chunks FROM c3)
  SELECT doc_id, part, md5(chunks[part + 1]) AS digest, length(chunks[part + 1])::INTEGER AS n_chars FROM p"""
)


@query("split_ratio", SPLIT_SQL)
def split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_even(F.col("text"), 4)).alias("part", "chunk"))
    return rows.select("doc_id", "part", F.md5("chunk").alias("digest"), F.length("chunk").alias("n_chars"))


@query("wrap_greedy", r"""WITH RECURSIVE w AS (SELECT item_id, unnest(x) AS word, unnest(range(len(x))) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(trim(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS x FROM benchmark)),
  r AS (SELECT item_id, k, 0 AS line, word AS words FROM w WHERE k = 0
    UNION ALL SELECT r.item_id, w.k, CASE WHEN length(words) + 1 + length(word) <= 42 THEN line ELSE line + 1 END, CASE WHEN length(words) + 1 + length(word) <= 42 THEN words || ' ' || word ELSE word END
    FROM r JOIN w ON r.item_id = w.item_id AND w.k = r.k + 1)
  SELECT item_id, line, arg_max(words, k) AS words FROM r GROUP BY item_id, line""")
def wrap_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.wrap_greedy(F.col("text"), 42)).alias("line", "words"))
    return rows.select("item_id", "line", "words")


@query("wrap_balanced")
def wrap_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spread(table(spark, sf_dir, "benchmark")).select("item_id", F.posexplode(T.wrap_balanced("text", F.lit(42))).alias("line", "words"))


@query("offset_votes", f"""WITH {ITEM_TOKENS}, {SEARCH_CTES}, c AS (SELECT query, doc, qi, unnest([o, o - 1]) AS cell FROM (SELECT *, floor((pos - qi) / 8.0)::BIGINT AS o FROM hit)),
  v AS (SELECT query, doc, cell, count(DISTINCT qi) AS votes FROM c GROUP BY query, doc, cell HAVING count(DISTINCT qi) >= 2)
  SELECT query AS item_id, doc AS doc_id, cell, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, doc, cell) AS rank FROM v) WHERE rank <= 6""")
def offset_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = _index(spark, sf_dir)
    hits, _ = S.matches(docs, _item_tokens(spark, sf_dir), T.skeleton, n)
    return L.offset_votes(hits).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "cell", "votes", "rank")


def _passages(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    """Common words vote too: in large tables all words are common."""
    docs = S.worded(table(spark, sf_dir, "documents"), "doc_id", T.words)
    voted = L.cells_voted(docs, S.forms_asked(docs, _item_tokens(spark, sf_dir), T.skeleton))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    found = L.compared(items, table(spark, sf_dir, "documents").select("doc_id", "text"), voted, top)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "verse_from", "verse_to", "ratio", "rank")


@query("match_passages")
def match_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passages of all texts that are most like each item: windows of up to six sentences, chosen by offset votes."""
    return _passages(spark, sf_dir, 3)


@query("similarity_ratio")
def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each item to the passage of all texts that is most like it."""
    return _passages(spark, sf_dir, 1).select("item_id", "doc_id", "ratio")
