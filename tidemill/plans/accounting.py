"""Identity and accounting queries over the synthetic tables: language plays the office, source the school."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemill.functions import ids
from tidemill.operators import accounting, identity
from tidemill.session import table


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("id"), F.col("lang").alias("office"), F.col("source").alias("school"), "text", "n_chars")


NOTICES = "notices AS (SELECT doc_id AS seq, sha256(text) AS id, lang AS office, source AS school, text, n_chars FROM documents)"
SEEN = f"WITH {NOTICES}, seen AS (SELECT *, seq = min(seq) OVER (PARTITION BY id) AS is_new FROM notices)"


def goal():
    return F.when(F.col("office") == "en", ids.LARGE_QUOTA).otherwise(ids.QUOTA)


def region_report(spark, sf_dir):
    return accounting.region_report(identity.first_seen(notices(spark, sf_dir)), goal())


REGION = SEEN + """, counted AS (
  SELECT office, count(*) FILTER (WHERE is_new) AS new, count(*) FILTER (WHERE NOT is_new) AS duplicates,
    CAST(CASE WHEN office = 'en' THEN 50 ELSE 20 END AS BIGINT) AS goal FROM seen GROUP BY office)
SELECT *, greatest(goal - new, 0) AS shortfall, CASE WHEN goal > new THEN 'partial' ELSE 'complete' END AS status FROM counted"""


def split_assignment(spark, sf_dir):
    return notices(spark, sf_dir).select("seq", ids.split_of(F.col("id")).alias("split"))


SPLIT = "CASE CAST('0x' || substr(sha256({0}), 1, 8) AS BIGINT) % 10 WHEN 9 THEN 'eval' WHEN 8 THEN 'dev' ELSE 'train' END"


def split_counts(spark, sf_dir):
    rows = notices(spark, sf_dir).select("office", ids.split_of(F.col("id")).alias("split"))
    return rows.groupBy("office", "split").agg(F.count("*").alias("n"))


def object_dedup(spark, sf_dir):
    objects = notices(spark, sf_dir).select(F.col("id").alias("sha256"), F.col("text").alias("bytes"), "seq")
    return identity.put_objects(objects).select("sha256", "seq", F.length("bytes").cast("bigint").alias("n"), ids.object_path(F.col("sha256")).alias("path"))


def sightings_upsert(spark, sf_dir):
    return identity.sightings(notices(spark, sf_dir), ["id", "office", "school"], "seq")


def version_chain(spark, sf_dir):
    return identity.version_chain(notices(spark, sf_dir), url="school").select("seq", "school", "id", "previous_version")


def alias_notices(spark, sf_dir):
    rows = notices(spark, sf_dir).select("id", "school").distinct()
    many = rows.groupBy("id").agg(F.count("*").alias("schools")).filter("schools > 1")
    return rows.join(many, "id")


def registry_summary(spark, sf_dir):
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.groupBy("n_name").agg(F.count("*").alias("schools"), F.countDistinct("c_mktsegment").alias("kinds"), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).cast("bigint").alias("without_home"))


def stratified_sample(spark, sf_dir):
    return identity.stratified(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey", "2024-01-01").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("turn").cast("bigint").alias("turn"))


def school_caps(spark, sf_dir):
    new = identity.first_seen(notices(spark, sf_dir)).filter("is_new")
    return accounting.capped(new, ["office", "school"], ["office"], "seq", 10, 50).select("seq", "office", "school")


def daily_increment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate").cast("string"))
    return orders.filter(F.col("o_orderstatus") == "O").groupBy("day", "o_orderpriority").agg(F.count("*").alias("n"))


def campaign_status(spark, sf_dir):
    rows = notices(spark, sf_dir).groupBy("school").agg(F.count("*").alias("collected"))
    return accounting.campaign_status(rows, 10_000, 20_000)


def campaign_by_state(spark, sf_dir):
    rows = notices(spark, sf_dir).groupBy("school").agg(F.countDistinct("id").alias("collected"))
    state = F.when(F.col("collected") >= 48, "capped").when(F.col("collected") >= 46, "done").otherwise("active")
    return rows.groupBy(state.alias("status")).agg(F.count("*").alias("schools"), F.sum("collected").cast("bigint").alias("collected"))


def lookback_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("published", F.when(F.col("o_custkey") % 7 == 0, None).otherwise(F.to_date("o_orderdate")))
    day = F.lit("1996-06-30").cast("date")
    return accounting.within(orders, "published", F.date_sub(day, 365), day).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("published").alias("dated"))


def blocked_schools(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_type", "e.ts")
    reason = F.when(F.col("event_type") == "error", "SSL error").when(F.col("event_type") == "click", "robots").when(F.col("event_type") == "view", "로그인 필요").otherwise("")
    kind, days = accounting.failure(reason)
    states = last.select("user_id", reason.alias("reason"), F.when(reason == "", "ok").otherwise(kind).alias("status"), (F.col("ts") + F.make_dt_interval(days)).alias("next_retry"))
    return accounting.blocked(states, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("user_id", "status", "blocked_for")


def usage_by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("requests"))


def budget_running(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "ts", "event_id", F.lit(1).alias("n"))
    ordered = events.withColumn("o", F.struct("ts", "event_id"))
    return accounting.budget(ordered, "day", "o", "n", 200, F.hour("o.ts")).filter("granted").groupBy("day").agg(F.count("*").alias("granted"), F.max("spent_before").alias("spent_before"))


def status_dashboard(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    state = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "held").otherwise("candidate")
    return accounting.dashboard(rows.select("lang", "source", state.alias("review_status"), ids.split_of(F.col("source")).alias("split")), ["lang", "source", "review_status", "split"])


def distinct_families(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.countDistinct(F.sha2(F.concat_ws(":", "lang", "source"), 256)).alias("families"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


def case_ids(spark, sf_dir):
    return notices(spark, sf_dir).select("seq", ids.case_id(F.col("id"), F.lit("body"), F.lit(0)).alias("case_id"), ids.collected_id(F.col("id")).alias("collected_id"), ids.revision_id(F.col("id"), F.lit(3)).alias("revision_id"))


def notice_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", ids.notice_key(F.col("c_name"), F.concat(F.lit(" <p>"), F.col("c_mktsegment"), F.lit("</p> \n <b></b> ")), F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("id"))


def attempted_days(spark, sf_dir):
    runs = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error", "signup"))
    day = F.to_date("ts").cast("string").alias("day")
    return runs.groupBy(day).agg(F.bool_or((F.col("event_type") != "error") & (F.col("user_id") % 2 == 0)).alias("attempted"), F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("last_run"))


def retry_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    return events.withColumn("before", before).select("event_id", (F.col("before").isNotNull() & (F.col("ts") < F.col("before") + F.expr("INTERVAL 1 DAY"))).alias("within_ttl"))


def pacing_wait(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    since = seconds("ts") - F.lag(seconds("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    delay = F.when(F.col("event_type") == "error", 20_000_000_000).otherwise(7_200_000_000)
    wait = F.greatest(delay - since, F.lit(0)).cast("bigint")
    return events.select("event_id", F.coalesce(wait, F.lit(0)).cast("bigint").alias("wait_us"), (F.coalesce(wait, F.lit(0)) > 7_200_000_000).alias("refused"))


def backfill_stop(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") / 50).cast("bigint").alias("page"))
    start = F.lit("1995-01-01").cast("date")
    dated = F.sum(F.when(F.col("o_custkey") % 5 > 0, 1).otherwise(0))
    newest = F.max(F.when(F.col("o_custkey") % 5 > 0, F.to_date("o_orderdate")))
    return pages.agg(dated.cast("bigint").alias("dated"), F.coalesce((dated >= 3) & (newest < start), F.lit(False)).alias("stop"))


def unclassified(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


PLANS = {
    "region_report": (region_report, REGION),
    "split_assignment": (split_assignment, f"WITH {NOTICES} SELECT seq, {SPLIT.format('id')} AS split FROM notices"),
    "split_counts": (split_counts, f"WITH {NOTICES} SELECT office, {SPLIT.format('id')} AS split, count(*) AS n FROM notices GROUP BY ALL"),
    "object_dedup": (object_dedup, f"WITH {NOTICES} SELECT id AS sha256, min(seq) AS seq, CAST(length(arg_min(text, seq)) AS BIGINT) AS n, 'objects/' || id[1:2] || '/' || id AS path FROM notices GROUP BY id"),
    "sightings_upsert": (sightings_upsert, f"WITH {NOTICES} SELECT id, office, school, min(seq) AS first_seen, max(seq) AS last_seen FROM notices GROUP BY ALL"),
    "version_chain": (version_chain, SEEN + " SELECT seq, school, id, lag(id) OVER (PARTITION BY school ORDER BY seq) AS previous_version FROM seen WHERE is_new"),
    "alias_notices": (alias_notices, f"WITH {NOTICES}, r AS (SELECT DISTINCT id, school FROM notices) SELECT id, school, count(*) OVER (PARTITION BY id) AS schools FROM r QUALIFY schools > 1"),
    "registry_summary": (registry_summary, "SELECT n_name, count(*) AS schools, count(DISTINCT c_mktsegment) AS kinds, count(*) FILTER (WHERE c_acctbal < 0) AS without_home FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "stratified_sample": (stratified_sample, """WITH o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY sha256('2024-01-01:' || c_custkey), c_custkey) AS own FROM customer)
SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY own, sha256('2024-01-01:' || c_mktsegment), c_mktsegment) AS turn FROM o"""),
    "school_caps": (school_caps, SEEN + """, a AS (SELECT *, row_number() OVER (PARTITION BY office, school ORDER BY seq) AS n FROM seen WHERE is_new),
b AS (SELECT *, row_number() OVER (PARTITION BY office ORDER BY seq) AS m FROM a WHERE n <= 10) SELECT seq, office, school FROM b WHERE m <= 50"""),
    "daily_increment": (daily_increment, "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL"),
    "campaign_status": (campaign_status, "SELECT count(*) AS schools, CAST(sum(n) AS BIGINT) AS collected, CAST(greatest(10000 - sum(n), 0) AS BIGINT) AS to_target, CAST(greatest(20000 - sum(n), 0) AS BIGINT) AS to_cap FROM (SELECT count(*) AS n FROM documents GROUP BY source)"),
    "campaign_by_state": (campaign_by_state, "SELECT CASE WHEN n >= 48 THEN 'capped' WHEN n >= 46 THEN 'done' ELSE 'active' END AS status, count(*) AS schools, CAST(sum(n) AS BIGINT) AS collected FROM (SELECT source, count(DISTINCT sha256(text)) AS n FROM documents GROUP BY source) GROUP BY 1"),
    "lookback_filter": (lookback_filter, """WITH o AS (SELECT *, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS published FROM orders)
SELECT o_orderstatus, count(*) AS n, count(published) AS dated FROM o WHERE published IS NULL OR published BETWEEN DATE '1996-06-30' - 365 AND DATE '1996-06-30' GROUP BY 1"""),
    "blocked_schools": (blocked_schools, """WITH l AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
s AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'tls' WHEN 'click' THEN 'robots' WHEN 'view' THEN 'login' ELSE 'ok' END AS status,
  CASE event_type WHEN 'error' THEN 'SSL error' WHEN 'click' THEN 'robots' WHEN 'view' THEN '로그인 필요' ELSE '' END AS reason,
  CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 7 WHEN 'view' THEN 30 ELSE 1 END AS days FROM l)
SELECT user_id, status, reason AS blocked_for FROM s WHERE status <> 'ok' AND ts + to_days(days) > TIMESTAMP '2024-01-30 00:00:00'"""),
    "usage_by_day": (usage_by_day, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests FROM events GROUP BY 1"),
    "budget_running": (budget_running, """WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS spent FROM events)
SELECT day, count(*) AS granted, max(spent) AS spent_before FROM r WHERE spent + 1 <= 200 GROUP BY day"""),
    "status_dashboard": (status_dashboard, f"""WITH r AS (SELECT lang, source, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'held' ELSE 'candidate' END AS review_status,
  {SPLIT.format('source')} AS split FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'review_status', review_status, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'split', split, count(*) FROM r GROUP BY ALL"""),
    "distinct_families": (distinct_families, "SELECT lang, count(DISTINCT source) AS families, count(DISTINCT text) AS texts FROM documents GROUP BY lang"),
    "case_ids": (case_ids, f"WITH {NOTICES} SELECT seq, sha256(id || ':body:0') AS case_id, sha256('collected:' || id)[1:32] AS collected_id, sha256(id || ':3') AS revision_id FROM notices"),
    "notice_ids": (notice_ids, """SELECT c_custkey, sha256('{"assets": ["a", "b"], "html": "<p>' || c_mktsegment || '</p><b></b>", "title": "' || c_name || '"}') AS id FROM customer"""),
    "attempted_days": (attempted_days, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, bool_or(event_type <> 'error' AND user_id % 2 = 0) AS attempted, max(event_id) FILTER (WHERE event_type = 'purchase') AS last_run FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY 1"),
    "retry_ttl": (retry_ttl, "SELECT event_id, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY, false) AS within_ttl FROM events"),
    "pacing_wait": (pacing_wait, """WITH g AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 20000000000 ELSE 7200000000 END - (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS w FROM events)
SELECT event_id, CAST(coalesce(greatest(w, 0), 0) AS BIGINT) AS wait_us, coalesce(greatest(w, 0), 0) > 7200000000 AS refused FROM g"""),
    "backfill_stop": (backfill_stop, """SELECT o_orderkey // 50 AS page, count(*) FILTER (WHERE o_custkey % 5 > 0) AS dated,
  coalesce(count(*) FILTER (WHERE o_custkey % 5 > 0) >= 3 AND max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_custkey % 5 > 0) < DATE '1995-01-01', false) AS stop FROM orders GROUP BY 1"""),
    "unclassified": (unclassified, "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source"),
}
