"""Upserts, lists and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import ids
from tidemill.operators import merge, pages
from tidemill.plans.grids import TABLES, tables
from tidemill.session import table


def enqueue(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ref_id"), F.col("event_type").alias("kind"), "event_id")
    return merge.insert_new(e.filter("event_id % 3 > 0"), e.filter("event_id % 3 = 0"), ["kind", "ref_id"], "event_id")


def school_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("boards"), F.when(F.col("event_type") == "error", "failed").alias("reason"))
    return merge.last_given(rows, ["user_id"], ["ts", "event_id"], ["event_type", "boards", "reason"])


def corpus_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    old = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint")).filter("doc_id % 7 > 0")
    return merge.changed(d, old, "doc_id", "fingerprint").select("doc_id")


def rearm_jobs(spark, sf_dir):
    i = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(i.alias("ref_id"), F.when(i % 3 == 0, "done").when(i % 3 == 1, "running").otherwise("error").alias("status"), (i % 6).cast("int").alias("attempts"))
    return merge.rearmed(jobs, jobs.filter("ref_id % 2 = 0"), ["ref_id"]).groupBy("status", "attempts").agg(F.count("*").alias("n"))


def queue_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 4 > 0 or doc_id % 8 = 0").select("doc_id", F.lit(10).alias("score"))
    return merge.replaced(old, d.filter("doc_id % 4 = 0").select("doc_id", F.lit(20).alias("score")), ["doc_id"]).groupBy("score").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def migration(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("approved"))
    return merge.migrated(l).groupBy("review_status").agg(F.count("*").alias("n"), F.count("split").alias("split"))


def captures(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(merge.capture(F.col("doc_id") % 10 - 8, F.lit(0), F.col("text")).alias("capture")).agg(F.count("*").alias("n"))


def campaign_seed(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(day.alias("d")).distinct().select(F.col("d").cast("string").alias("end"), F.substring(F.sha2(F.concat(F.lit("backfill:"), F.col("d").cast("string")), 256), 1, 16).alias("seed"), F.date_sub("d", 730).cast("string").alias("start"))


def quotas(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_name", ids.quota(F.when(F.col("n_nationkey") == 3, "B10").otherwise("Q10"), F.when(F.col("n_nationkey") == 4, "경기도").otherwise(F.col("n_name"))).alias("quota"))


def overrides(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = c.filter("c_custkey % 100 = 0").select("c_custkey", F.lit("disabled").alias("override"))
    return c.select("c_custkey", "c_nationkey").join(F.broadcast(o) if o.count() <= 10_000 else o, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("override").alias("overridden"), F.count("*").alias("n"))


def recent_history(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


def follow_redirects(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("url"), F.when(F.col("n_nationkey") % 4 > 0, (F.col("n_nationkey") - 1).cast("string")).alias("target"))
    return pages.follow(n.select("url"), n.filter("target is not null"), 2).select("url", "final", F.col("steps").cast("bigint").alias("steps"))


def first_board(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("school"), F.col("l_linenumber").alias("place")).agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"))
    rows = li.select("school", F.lit(1).alias("priority"), "place", F.concat(F.lit("board"), "place").alias("board"), (F.col("r") % 3).alias("posts"), F.concat(F.lit("error"), "place").alias("error"))
    return pages.first_board(rows)


def render_table(spark, sf_dir):
    return pages.rendered(tables(spark, sf_dir)).select("table_id", F.sha2("html", 256).alias("html"))


def key_values(spark, sf_dir):
    return pages.key_values(tables(spark, sf_dir)).select("table_id", F.col("row").cast("bigint").alias("row"), "key", "value")


PLANS = {
    "enqueue": (enqueue, "SELECT user_id AS ref_id, event_type AS kind, min(event_id) AS event_id FROM events WHERE event_id % 3 > 0 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 3 = 0) GROUP BY ALL"),
    "school_state": (school_state, """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) FILTER (WHERE event_id % 3 = 0 AND props IS NOT NULL) AS boards,
  CASE WHEN bool_or(event_type = 'error') THEN 'failed' END AS reason FROM events GROUP BY user_id"""),
    "corpus_upsert": (corpus_upsert, "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0"),
    "rearm_jobs": (rearm_jobs, """SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1 THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'running' ELSE 'error' END AS status,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1 THEN 0 ELSE o_orderkey % 6 END AS attempts, count(*) AS n FROM orders GROUP BY ALL"""),
    "queue_replace": (queue_replace, "SELECT CASE WHEN doc_id % 4 = 0 THEN 20 ELSE 10 END AS score, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 4 > 0 OR doc_id % 8 = 0) GROUP BY 1"),
    "migration": (migration, "SELECT CASE WHEN quality = 1 THEN 'approved' ELSE 'candidate' END AS review_status, count(*) AS n, CAST(0 AS BIGINT) AS split FROM labels GROUP BY 1"),
    "captures": (captures, "SELECT CASE WHEN doc_id % 10 = 9 OR trim(text) = '' THEN 'partial_capture' ELSE 'full' END AS capture, count(*) AS n FROM documents GROUP BY 1"),
    "campaign_seed": (campaign_seed, "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS \"end\", sha256('backfill:' || strftime(o_orderdate, '%Y-%m-%d'))[1:16] AS seed, strftime(CAST(o_orderdate AS DATE) - 730, '%Y-%m-%d') AS start FROM orders"),
    "quotas": (quotas, "SELECT n_name, CASE WHEN n_nationkey IN (3, 4) THEN 50 ELSE 20 END AS quota FROM nation"),
    "overrides": (overrides, "SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 100 = 0) AS overridden, count(*) AS n FROM customer GROUP BY 1"),
    "recent_history": (recent_history, "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"),
    "follow_redirects": (follow_redirects, "SELECT CAST(n_nationkey AS VARCHAR) AS url, CAST(n_nationkey - least(n_nationkey % 4, 2) AS VARCHAR) AS final, CAST(least(n_nationkey % 4, 2) AS BIGINT) AS steps FROM nation"),
    "first_board": (first_board, """WITH b AS (SELECT l_suppkey AS school, l_linenumber AS place, count(*) FILTER (WHERE l_returnflag = 'R') % 3 AS posts FROM lineitem GROUP BY ALL)
SELECT school, 'board' || min(place) FILTER (WHERE posts > 0) AS board, CASE WHEN NOT bool_or(posts > 0) THEN 'error' || max(place) END AS error FROM b GROUP BY school"""),
    "render_table": (render_table, f"""WITH {TABLES}, r AS (SELECT table_id, row, string_agg(CASE WHEN row = 0 THEN '<th' ELSE '<td' END || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || '>' || text || CASE WHEN row = 0 THEN '</th>' ELSE '</td>' END, '' ORDER BY col) AS h FROM cells GROUP BY ALL)
SELECT table_id, sha256('<table>' || string_agg('<tr>' || h || '</tr>', '' ORDER BY row) || '</table>') AS html FROM r GROUP BY table_id"""),
    "key_values": (key_values, f"WITH {TABLES} SELECT table_id, row, max(text) FILTER (WHERE col = 0) AS key, max(text) FILTER (WHERE col = 1) AS value FROM cells GROUP BY ALL"),
}
