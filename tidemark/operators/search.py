"""Inverted index and ranked search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FUZZY, RUN_BONUS, STOP_POSTINGS = 0.6, 1.2, 4000
#: Rows of (query, place, form, vote) up to which they are broadcast: some 200 MB. More are left to Spark's own choice.
BROADCAST_ROWS = 1_000_000
#: Texts that a task splits and counts: some 8 MB of the driver's documents.
ROWS_A_TASK = 4_000
#: Of resolved(): a token met as it is stands for itself, another one for all forms of its skeleton.
MEANT = "form is not null and (form = token or e_df is null)"


def worded(docs: DataFrame, key: str, words: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """(doc, words): the words of each document in order."""
    return spread(docs.select(key, text)).select(F.col(key).alias("doc"), words(F.col(text)).alias("words"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to as many tasks as there are cores, and to more where a task would have over ROWS_A_TASK: a task is as long at any size, however many parts or row groups the table has."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // ROWS_A_TASK)))


def dealt(rows: DataFrame) -> DataFrame:
    """Small rows that each take much work, dealt out by number: to as many tasks as a shuffle has, or as there are cores."""
    session = rows.sparkSession
    return rows.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def postings(docs: DataFrame) -> DataFrame:
    """(doc, pos, token, next) of (doc, words): one row a token and place with the token after it, never a list a term, so that common terms stay spread out."""
    pairs = F.arrays_zip(F.col("words").alias("token"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))
    # The outer form: the inner one has the texts split once more, below the dealing out, to see whether they are empty.
    rows = docs.select("doc", F.posexplode_outer(pairs).alias("pos", "pair")).select("doc", "pos", "pair.*")
    return rows.where("token is not null")


def form_stats(docs: DataFrame, skeleton: Callable[[Column], Column] = lambda w: F.lit("")) -> DataFrame:
    """(skel, token, np, df, first_skel): a token's postings and documents, and how many documents have it as the first token of its skeleton.

    first_skel summed over a skeleton's tokens is the skeleton's number of documents. Each document's words are
    sorted within the row, so that equal ones stand together: one aggregation over tokens, combined before its
    shuffle, and none over pairs of token and document.
    """
    ordered = F.sort_array(F.transform("words", lambda w: F.struct(skeleton(w).alias("skel"), w.alias("token"))))

    def marked(xs: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            before = F.get(xs, i - 1)
            return F.struct(x["skel"].alias("skel"), x["token"].alias("token"), (~before["token"].eqNullSafe(x["token"])).alias("opens"), (~before["skel"].eqNullSafe(x["skel"])).alias("opens_skel"))

        return F.transform(xs, mark)

    rows = docs.select(F.inline(F.transform(F.array(ordered), marked)[0]))
    return rows.groupBy("skel", "token").agg(F.count("*").alias("np"), F.count_if("opens").alias("df"), F.count_if("opens_skel").alias("first_skel"))


def resolved(docs: DataFrame, queries: DataFrame, skeleton: Callable[[Column], Column]) -> DataFrame:
    """(token, form, e_df, n_forms, n_in) of the tokens of queries: the corpus's tokens of the same skeleton, over the vocabulary.

    e_df is the number of documents that have the token as it is, null if none has; n_forms are the postings and n_in the documents of
    what it stands for: itself, or else all forms of its skeleton. MEANT tells those rows.
    """
    asked = queries.select("token").distinct().withColumn("skel", skeleton(F.col("token")))
    vocabulary = form_stats(docs, skeleton).withColumnRenamed("token", "form")
    same = F.col("form") == F.col("token")
    of = Window.partitionBy("token")
    return (
        asked.join(vocabulary, "skel", "left")
        .withColumn("e_df", F.max(F.when(same, F.col("df"))).over(of))
        .withColumn("n_forms", F.when(F.col("e_df").isNotNull(), F.max(F.when(same, F.col("np"))).over(of)).otherwise(F.sum("np").over(of)))
        .withColumn("n_in", F.coalesce("e_df", F.sum("first_skel").over(of)))
        .persist()
    )


def forms_asked(docs: DataFrame, queries: DataFrame, skeleton: Callable[[Column], Column]) -> DataFrame:
    """(query, qi, form): the corpus's tokens that a query's token stands for, however many postings they have."""
    return queries.join(resolved(docs, queries, skeleton).where(MEANT).select("token", "form"), "token").select("query", "qi", "form")


def matches(docs: DataFrame, queries: DataFrame, skeleton: Callable[[Column], Column], n_docs: int) -> tuple[DataFrame, DataFrame]:
    """(hits, totals) of queries (query, qi, token) in documents (doc, words).

    A token is looked up as it is; only if no document has it, by its skeleton, at a lower weight. Its
    weight is ln(1 + N / df); one found nowhere still costs 1 in the total. Forms of more than
    STOP_POSTINGS postings count in the total but vote for nothing. hits: (query, qi, doc, pos, vote, follows);
    follows says that the token after this one in the document is a hit of the token after this one in the query.

    Tokens asked for are first resolved to the corpus's tokens, over the vocabulary, and counted; the postings are then
    read once and joined by their token alone. A token's forms at the next place of the query come with it, so whether
    hits follow each other is known in their row, and nothing is sorted by document.
    """
    found = resolved(docs, queries, skeleton).withColumn("weight", F.when(F.col("n_in").isNull(), F.lit(1.0)).otherwise(F.ln(1 + F.lit(float(n_docs)) / F.col("n_in"))))
    weights = found.groupBy("token").agg(F.first("weight").alias("weight"))
    totals = queries.join(weights, "token").groupBy("query").agg(F.sum("weight").alias("total_w"))
    is_exact = F.col("e_df").isNotNull()
    votes = found.where((F.col("n_forms") <= STOP_POSTINGS) & F.expr(MEANT)).select("token", "form", F.when(is_exact, F.col("weight")).otherwise(F.col("weight") * FUZZY).alias("vote"))
    keys = queries.join(votes, "token").select("query", "qi", "form", "vote")
    later = keys.groupBy("query", (F.col("qi") - 1).alias("qi")).agg(F.collect_set("form").alias("later"))
    paired = keys.join(later, ["query", "qi"], "left")
    small = keys.count() <= BROADCAST_ROWS
    met = postings(docs).join(F.broadcast(paired) if small else paired, F.col("token") == F.col("form"))
    follows = F.coalesce(F.array_contains("later", F.col("next")), F.lit(False))
    return met.select("query", "qi", "doc", "pos", "vote", follows.alias("follows")), totals


def ranked(hits: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """(query, doc, score, hits, rank): the best documents of each query, by weighted votes and a bonus for query tokens that follow each other in the document too. Ties: the smaller doc. Hits are summed by place of the query before they move."""
    voted = hits.groupBy("query", "doc", "qi").agg(F.sum("vote").alias("vote"), F.count_if("follows").alias("run"))
    voted = voted.groupBy("query", "doc").agg(F.sum("vote").alias("votes"), F.sum("run").alias("run"), F.count("*").alias("hits"))
    scored = voted.join(totals, "query").select("query", "doc", F.round((F.col("votes") + RUN_BONUS * F.col("run")) / F.greatest("total_w", F.lit(1e-6)), 6).alias("score"), "hits")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def hopping(words: Column, size: int = 12, step: int = 3) -> Column:
    """Windows (start, words) of `size` words every `step`; the last may be short, and none follows the one that reaches the end."""
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.slice(words, k * step + 1, size).alias("words"))))


def phrase_runs(hits: DataFrame, keys: list[str], at: str, least: int = 2) -> DataFrame:
    """Rows whose place belongs to a run of at least `least` adjacent places of their key."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    named = hits.withColumn("island", island)
    return named.withColumn("run", F.count("*").over(Window.partitionBy(*keys, "island"))).where(F.col("run") >= least).drop("island", "run")
