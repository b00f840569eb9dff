"""Queries over the dimension and fact tables, labels, pages and JSON properties."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..functions import text as T
from ..operators import alignment, folds, quality, search
from .base import events, query, table


@query("point_in_range_dim", """WITH d AS (SELECT n_nationkey, n_name, sum(n) OVER (ORDER BY n_nationkey) - n AS first_at, sum(n) OVER (ORDER BY n_nationkey) AS end_at FROM (SELECT n_nationkey, n_name, n_nationkey * 37 + 10 AS n FROM nation))
  SELECT o_orderkey, n_nationkey, o_orderkey % 11000 - first_at::BIGINT AS offset_in FROM orders JOIN d ON o_orderkey % 11000 >= first_at AND o_orderkey % 11000 < end_at""")
def point_in_range_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter that a flat position falls in, from running offsets of a dimension of fixed size."""
    n = F.col("n_nationkey") * 37 + 10
    upto = F.sum("n").over(Window.orderBy("n_nationkey"))
    dim = table(spark, sf_dir, "nation").select("n_nationkey", n.alias("n")).select("n_nationkey", (upto - F.col("n")).alias("first_at"), upto.alias("end_at"))
    at = F.col("o_orderkey") % 11000
    return table(spark, sf_dir, "orders").join(dim, (at >= F.col("first_at")) & (at < F.col("end_at"))).select("o_orderkey", "n_nationkey", (at - F.col("first_at")).alias("offset_in"))


@query("positional_join", """SELECT c_custkey, c_name, s_name, n_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel tables joined by place; a place that one lacks is null."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return c.join(s, F.col("s_suppkey") == F.col("c_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_name", "s_name", "n_name")


@query("robust_summary", """SELECT l_returnflag, l_linestatus, median(l_quantity) AS med, round(quantile_cont(l_extendedprice, 0.1), 2) AS p10, round(quantile_cont(l_extendedprice, 0.9), 2) AS p90, max(l_tax) - min(l_tax) AS spread, count(*) FILTER (l_discount > 0.05) * 2 > count(*) AS mostly_discounted, count(*) AS n FROM lineitem GROUP BY ALL""")
def robust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["l_returnflag", "l_linestatus"]
    columns = {"quantity": "l_quantity", "price": "l_extendedprice", "tax": "l_tax", "discount": "l_discount"}
    counts = quality.value_counts(search.spread(table(spark, sf_dir, "lineitem").select(*by, *columns.values())), by, {k: F.col(c) for k, c in columns.items()} | {"rows": F.lit(1)})
    of = lambda what, x=F.col("value"): F.when(F.col("what") == what, x)
    return counts.groupBy(*by).agg(
        quality.quantile("quantity", 0.5).alias("med"),
        F.round(quality.quantile("price", 0.1), 2).alias("p10"),
        F.round(quality.quantile("price", 0.9), 2).alias("p90"),
        (F.max(of("tax")) - F.min(of("tax"))).alias("spread"),
        (F.sum(F.when((F.col("what") == "discount") & (F.col("value") > 0.05), F.col("n")).otherwise(0)) * 2 > F.sum(of("rows", F.col("n")))).alias("mostly_discounted"),
        F.sum(of("rows", F.col("n"))).alias("n"),
    )


@query("category_vote", """WITH v AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM v) SELECT o_custkey, o_orderstatus AS vote, n FROM r WHERE r = 1""")
def category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent value of a key, the lowest of equals."""
    votes = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("o_orderstatus").alias("vote"))).alias("best")
    return votes.groupBy("o_custkey").agg(best).select("o_custkey", "best.vote", (-F.col("best.less")).alias("n"))


@query("inliers", """WITH m AS (SELECT l_suppkey, median(l_quantity) AS med FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem JOIN m USING (l_suppkey) WHERE abs(l_quantity - med) < 10 GROUP BY l_suppkey""")
def inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    med = li.groupBy("l_suppkey").agg(F.median("l_quantity").alias("med"))
    near = li.join(med, "l_suppkey").where(F.abs(F.col("l_quantity") - F.col("med")) < 10)
    return near.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))


FIT = "CASE WHEN x BETWEEN 0.85 AND 1.3 THEN 1.0 WHEN x < 0.85 THEN greatest(0.0, 1 - (0.85 - x) / 0.55) ELSE greatest(0.0, 1 - (x - 1.3) / 0.55) END"


@query("weighted_scores", f"""WITH o AS (SELECT l_orderkey, sum(round(l_discount * 100)::BIGINT * l_quantity::BIGINT)::DOUBLE / (100 * sum(l_quantity)) AS conf, sum(l_quantity) / (count(*) * 25.0) AS x, least(1.0, count(*) / 5.0) AS cover FROM lineitem GROUP BY 1)
  SELECT l_orderkey, conf, {FIT} AS fit, cover, 0.5 * conf + 0.3 * ({FIT}) + 0.2 * cover AS score FROM o""")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean (in whole hundredths, so that its sum is exact), a ratio with a dead band, a clamped coverage, and their weighted sum."""
    q = F.sum("l_quantity")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long") * F.col("l_quantity").cast("long")) / (100 * q)).alias("conf"), (q / (F.count("*") * 25.0)).alias("x"), F.least(F.lit(1.0), F.count("*") / 5.0).alias("cover"))
    o = o.withColumn("fit", scores.fit(F.col("x"), 0.85, 1.3))
    total = 0.5 * F.col("conf") + 0.3 * F.col("fit") + 0.2 * F.col("cover")
    return o.select("l_orderkey", "conf", "fit", "cover", total.alias("score"))


@query("best_pass_per_key", """SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN 'preferred' ELSE 'other' END AS flag FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""")
def best_pass_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.count("*").over(of).alias("n"), F.row_number().over(of.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r"))
    return o.where("n > 1").select("o_custkey", "o_orderkey", F.when(F.col("r") == 1, "preferred").otherwise("other").alias("flag"))


@query("run_length_groups", """WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l)
  SELECT user_id, any_value(event_type) AS event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM r GROUP BY user_id, run""")
def run_length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import intervals as I

    order = I.by("user_id", "t", "event_id")
    before = F.lag("event_type").over(order)
    runs = I.islands(events(spark, sf_dir), "user_id", before.isNull() | (before != F.col("event_type")), order)
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n")).drop("run")


@query("partition_check", """WITH p AS (SELECT l_orderkey, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total, n IS NULL AS missing, coalesce(total, 0.0) = floor(coalesce(total, 0.0)) AS whole FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether parts add up: the parts of each order, those without any included."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"))
    total = F.coalesce("total", F.lit(0.0))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(p, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), total.alias("total"), F.col("n").isNull().alias("missing"), (total == F.floor(total)).alias("whole"))


@query("boundary_marks", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS upto FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, upto FROM l WHERE upto::BIGINT % 10 = 0""")
def boundary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose running sum lands on a boundary."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    upto = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(order).alias("upto"))
    return upto.where(F.col("upto").cast("long") % 10 == 0)


@query("topk_stable", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("argmin_grid", """WITH g AS (SELECT p_partkey, p_size, p_retailprice, z, dx FROM part, (SELECT unnest(range(0, 11)) AS z), (SELECT unnest(range(-3, 4)) AS dx)),
  c AS (SELECT p_partkey, z, dx, CASE WHEN (p_size + dx) % 5 = 0 THEN 1 ELSE 0 END AS tier, abs(p_size * (100 - 2 * z) - 1500 - 40 * dx) + 10 * z AS cost FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, cost, z, dx) AS r FROM c) SELECT p_partkey, z, dx, tier, cost FROM r WHERE r = 1""")
def argmin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest place of a small grid for each row, in tiers; the grid is an array in the row, so nothing is multiplied out."""
    z, dx = F.sequence(F.lit(0), F.lit(10)), F.sequence(F.lit(-3), F.lit(3))

    def place(z, dx):
        tier = F.when((F.col("p_size") + dx) % 5 == 0, 1).otherwise(0)
        cost = F.abs(F.col("p_size") * (100 - 2 * z) - 1500 - 40 * dx) + 10 * z
        return F.struct(tier.alias("tier"), cost.cast("long").alias("cost"), z.cast("long").alias("z"), dx.cast("long").alias("dx"))

    grid = F.flatten(F.transform(z, lambda a: F.transform(dx, lambda b: place(a, b))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_min(grid).alias("g")).select("p_partkey", "g.z", "g.dx", "g.tier", "g.cost")


@query("name_in_title", """SELECT p_partkey, w.word FROM part, (SELECT unnest(['ring', 'widget', 'bolt', 'red', 'blue']) AS word) w WHERE contains(' ' || lower(p_name) || ' ', ' ' || w.word || ' ')""")
def name_in_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known names (a fixed list) that a title holds as whole words."""
    names = ["ring", "widget", "bolt", "red", "blue"]
    title = F.concat(F.lit(" "), F.lower("p_name"), F.lit(" "))
    held = F.filter(F.array(*map(F.lit, names)), lambda w: F.contains(title, F.concat(F.lit(" "), w, F.lit(" "))))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(held).alias("word"))


@query("anti_unowned", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unowned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("outer_owner", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
def outer_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("unknown_keys", "SELECT event_id, key FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('m', 'n')")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each event's properties that a closed schema of m and n doesn't have."""
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return quality.unknown_keys(table(spark, sf_dir, "events"), "event_id", keys, ["m", "n"])


@query("longest_suffix_dim", """WITH d AS (SELECT n_nationkey, n_name FROM nation), p AS (SELECT c_custkey, c_name || '-NATION_' || (c_custkey % 30)::VARCHAR AS name FROM customer),
  m AS (SELECT c_custkey, n_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY length(n_name) DESC, n_nationkey) AS r FROM p JOIN d ON ends_with(name, n_name)) SELECT c_custkey, n_nationkey FROM m WHERE r = 1""")
def longest_suffix_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest entry of a dimension of fixed size that a name ends with."""
    name = F.concat("c_name", F.lit("-NATION_"), (F.col("c_custkey") % 30).cast("string"))
    named = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    found = named.join(table(spark, sf_dir, "nation"), F.expr("endswith(name, n_name)"))
    best = F.min(F.struct((-F.length("n_name")).alias("less"), F.col("n_nationkey"))).alias("best")
    return found.groupBy("c_custkey").agg(best).select("c_custkey", "best.n_nationkey")


@query("redact_url", r"SELECT page_id, regexp_replace(replace(url, '://', '://user:pw@'), '(https?://)[^@/\s]+@', '\1***@', 'g') AS url FROM pages")
def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    risky = F.replace("url", F.lit("://"), F.lit("://user:pw@"))
    return table(spark, sf_dir, "pages").select("page_id", T.redact_credentials(risky).alias("url"))


@query("slug", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("url_id", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '/([0-9]+)(\?|#|$)', 1) AS number, regexp_extract(url, '[?&]ref=([^&#]+)', 1) AS ref FROM pages")
def url_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.url_host(F.col("url")).alias("host"), F.regexp_extract("url", r"/([0-9]+)(\?|#|$)", 1).alias("number"), F.regexp_extract("url", "[?&]ref=([^&#]+)", 1).alias("ref"))


@query("strip_markup", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<sup.*?</sup>|<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM pages""")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("digest"))


@query("strip_article", r"SELECT c_custkey, regexp_replace('Al-' || c_mktsegment, '^(adh|ash|al|an|ar|as|at|az|ad)-', '', 'i') AS name FROM customer")
def strip_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_article(F.concat(F.lit("Al-"), "c_mktsegment")).alias("name"))


@query("json_props", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, max((props->>'k')::BIGINT) AS largest FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


@query("json_validate", """SELECT event_id, CASE WHEN props->>'k' IS NULL THEN 'missing k' WHEN (props->>'k')::BIGINT > 90 THEN 'k out of range' END AS problem FROM events WHERE props->>'k' IS NULL OR (props->>'k')::BIGINT > 90""")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    problem = F.when(k.isNull(), "missing k").when(k > 90, "k out of range")
    return table(spark, sf_dir, "events").select("event_id", problem.alias("problem")).where("problem is not null")


@query("first_json_object", "SELECT event_id, props AS found FROM events")
def first_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first balanced object of a noisy text."""
    noisy = F.concat(F.lit("Here you are: "), "props", F.lit(" } and {more"))
    return table(spark, sf_dir, "events").select("event_id", T.first_object(noisy).alias("found"))


#: Lines that a task of quality_findings sorts: some 50 MB.
LINES_A_TASK = 500_000


@query("quality_findings", """WITH l AS (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS before FROM lineitem)
  SELECT l_orderkey::VARCHAR AS entity, 'order' AS rule, 'fail' AS severity, 'ships before the line above it' AS message FROM l WHERE l_shipdate < before
  UNION ALL SELECT l_orderkey::VARCHAR, 'bounds', 'warn', 'more than 45 pieces' FROM lineitem WHERE l_quantity > 45
  UNION ALL SELECT l_orderkey::VARCHAR, 'owner', 'fail', 'no such order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT o_orderkey::VARCHAR, 'name', 'fail', 'unknown status ' || o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # Orders come before their lines in one ordered pass, so a line sees both the line above it and whether there is its order; so many lines a task that its sort stays small at any size.
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.lit(1).alias("line"))
    both = lines.unionByName(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("line")), allowMissingColumns=True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // LINES_A_TASK))
    order = Window.partitionBy("l_orderkey").orderBy("line", "l_linenumber", "l_partkey", "l_shipdate")
    seen = both.repartition(tasks, "l_orderkey").select("l_orderkey", "line", "l_shipdate", F.lag("l_shipdate").over(order).alias("before"), F.first("line").over(order).alias("first"))
    rules = [("order", "fail", F.col("l_shipdate") < F.col("before"), "ships before the line above it"), ("owner", "fail", (F.col("first") == 1) & F.col("l_orderkey").isNotNull(), "no such order")]
    return quality.all_findings(
        [
            quality.findings_of_rows(seen.where("line = 1"), F.col("l_orderkey"), rules),
            quality.findings(li, F.col("l_orderkey"), "bounds", "warn", F.col("l_quantity") > 45, "more than 45 pieces"),
            quality.findings(orders, F.col("o_orderkey"), "name", "fail", ~F.col("o_orderstatus").isin("O", "F"), F.concat(F.lit("unknown status "), "o_orderstatus")),
        ]
    )


@query("reconcile_state", """SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'unknown' WHEN (l.quality = 1) = (d.n_chars > 1000) THEN 'ok' WHEN l.quality = 1 THEN 'promote' ELSE 'conflict' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""")
def reconcile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-valued marker (labels) against a record (a property of the document)."""
    marked = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("record")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("marker")), "doc_id", "left")
    return marked.select("doc_id", quality.reconciled(F.col("marker"), F.col("record")).alias("action"))


@query("set_ops", """SELECT 'union' AS op, count(*) AS n, sum(doc_id)::BIGINT AS s FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
  UNION ALL SELECT 'intersect', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    told = lambda op, rows: rows.agg(F.lit(op).alias("op"), F.count("*").alias("n"), F.sum("doc_id").alias("s"))
    return told("union", d.union(l).distinct()).unionByName(told("except", d.subtract(l))).unionByName(told("intersect", d.intersect(l)))


BOX = "SELECT p_partkey, p_partkey // 40 AS frame, p_size % 13 * 10 AS x, p_size % 7 * 10 AS y, 8 + p_size % 5 AS w, 8 + p_size % 3 AS h FROM part"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    box = F.struct((size % 13 * 10).alias("x"), (size % 7 * 10).alias("y"), (8 + size % 5).alias("w"), (8 + size % 3).alias("h"))
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("frame"), box.alias("box"))


@query("box_overlap", f"WITH b AS ({BOX}) SELECT a.p_partkey AS one, b.p_partkey AS two FROM b a JOIN b ON a.frame = b.frame AND a.p_partkey < b.p_partkey AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _boxes(spark, sf_dir).alias("a"), _boxes(spark, sf_dir).alias("b")
    meets = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.p_partkey") < F.col("b.p_partkey")) & scores.boxes_overlap(F.col("a.box"), F.col("b.box"))
    return a.join(b, meets).select(F.col("a.p_partkey").alias("one"), F.col("b.p_partkey").alias("two"))


BOX_CLUSTER_SQL = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY p_partkey) AS k FROM ({BOX})),
  v AS (SELECT frame, count(DISTINCT p_partkey // 10) AS views, count(*) AS n FROM b GROUP BY frame),
  r AS (SELECT frame, 0::BIGINT AS k, []::STRUCT(x BIGINT, y BIGINT, x2 BIGINT, y2 BIGINT, n BIGINT)[] AS c FROM v
    UNION ALL SELECT frame, k, CASE WHEN hit IS NULL THEN list_append(c, {{'x': x, 'y': y, 'x2': x2, 'y2': y2, 'n': 1::BIGINT}})
      ELSE list_concat(c[: hit - 1], [{{'x': least(c[hit].x, x), 'y': least(c[hit].y, y), 'x2': greatest(c[hit].x2, x2), 'y2': greatest(c[hit].y2, y2), 'n': c[hit].n + 1}}], c[hit + 1 :]) END
    FROM (SELECT r.frame, b.k, r.c, b.x::BIGINT AS x, b.y::BIGINT AS y, (b.x + b.w)::BIGINT AS x2, (b.y + b.h)::BIGINT AS y2,
        list_min(list_filter(range(1, len(r.c) + 1), lambda i: r.c[i].x < b.x + b.w AND b.x < r.c[i].x2 AND r.c[i].y < b.y + b.h AND b.y < r.c[i].y2)) AS hit
      FROM r JOIN b ON b.frame = r.frame AND b.k = r.k + 1))
  SELECT frame, c.x::INTEGER AS x, c.y::INTEGER AS y, (c.x2 - c.x)::INTEGER AS w, (c.y2 - c.y)::INTEGER AS h FROM (SELECT r.frame, unnest(c) AS c, views FROM r JOIN v ON r.frame = v.frame AND r.k = v.n) WHERE c.n >= greatest(1, round_even(0.5 * views, 0))"""


@query("box_cluster", BOX_CLUSTER_SQL)
def box_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a frame's parts gathered into clusters; ten parts are a view of the frame."""

    rows = _boxes(spark, sf_dir).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "box"))).alias("parts"))
    views = F.size(F.array_distinct(F.transform("parts", lambda p: F.floor(p["p_partkey"] / 10))))
    found = folds.box_clusters(F.transform("parts", lambda p: p["box"]), views)
    return rows.select("frame", F.inline(found)).drop("n")


@query("box_merge")
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        boxes = np.array([(b["x"], b["y"], b["w"], b["h"]) for b in rows.sort_values("p_partkey")["box"]])
        return pd.DataFrame(folds.merged_boxes(boxes, 2), columns=["x", "y", "w", "h"]).assign(frame=rows["frame"].iloc[0])

    return folds.per_clip(_boxes(spark, sf_dir), "frame", fold, "frame long, x int, y int, w int, h int")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with what was heard of them: every seventh word lost, and the third to sixth said twice."""
    w = T.words(F.col("text"))
    heard = F.filter(F.concat(F.slice(w, 1, 6), F.slice(w, 3, F.size(w))), lambda x, i: i % 7 != 5)
    return search.spread(table(spark, sf_dir, "benchmark")).select("item_id", w.alias("ref"), heard.alias("heard"))


def _aligned(rows: DataFrame, align, schema: str) -> DataFrame:
    def run(parts):
        for p in parts:
            out = [(item, *r) for item, ref, heard in zip(p["item_id"], p["ref"], p["heard"]) for r in align(list(ref), list(heard))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def _skeleton(word: str) -> str:
    short = "".join(c for c in word if c not in T.WEAK_LATIN)
    return short if len(short) >= 2 else word


@query("align_global")
def align_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(_paired(spark, sf_dir), lambda ref, heard: alignment.global_pairs(ref, heard, _skeleton), "item_id long, ref int, heard int")


@query("align_repeats")
def align_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(ref, heard):
        found, restarts = alignment.with_restarts(ref, heard)
        yield from (("event", h, r, None, float(s)) for h, r, s in found)
        yield from (("restart", h, to, float(frm), None) for h, frm, to in restarts)

    return _aligned(_paired(spark, sf_dir), rows, "item_id long, kind string, heard int, ref int, from_ref double, likeness double")


@query("lcs_weighted")
def lcs_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    glue = {"the", "of", "and", "to", "in", "is", "it", "a"}
    weigh = lambda ref, heard: alignment.weighted_lcs([(t, 0.15 if t in glue else 1.0) for t in ref], heard)
    return _aligned(_paired(spark, sf_dir), weigh, "item_id long, ref int, heard int")
