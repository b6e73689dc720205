"""Reports, look-ups and rendered pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import ids
from tidemill.operators import accounting, campaign, grids, identity, merge, pages
from tidemill.plans.accounting import SEEN, notices
from tidemill.plans.grids import TABLES, tables
from tidemill.session import table
from tidemill.sources import blocks


def _regions(spark, sf_dir):
    rows = identity.first_seen(notices(spark, sf_dir)).select("office", "is_new", (F.col("seq") % 3 == 0).alias("before"))
    targets = spark.createDataFrame([("en", 500), ("fr", 60), ("de", 60), ("xx", 20)], "office string, target bigint")
    return accounting.daily_report(rows, targets)


def daily_report(spark, sf_dir):
    return _regions(spark, sf_dir)


def run_report(spark, sf_dir):
    return campaign.run_report(_regions(spark, sf_dir), F.lit("2024-01-01")).withColumn("short", F.array_join("short", ","))


REGIONS = SEEN + """, t AS (SELECT unnest(['en', 'fr', 'de', 'xx']) AS office, unnest([500, 60, 60, 20]::BIGINT[]) AS target),
g AS (SELECT office, count(*) FILTER (WHERE seq % 3 = 0 AND is_new) AS before, count(*) FILTER (WHERE seq % 3 > 0 AND is_new) AS new, count(*) FILTER (WHERE seq % 3 > 0 AND NOT is_new) AS duplicates FROM seen GROUP BY office),
r AS (SELECT office, target, coalesce(before, 0) AS before, coalesce(new, 0) AS new, coalesce(duplicates, 0) AS duplicates, coalesce(before + new, 0) AS total, greatest(target - coalesce(before + new, 0), 0) AS shortfall FROM t LEFT JOIN g USING (office)),
z AS (SELECT *, CASE WHEN shortfall > 0 THEN 'partial' ELSE 'complete' END AS status, 640::BIGINT AS daily_target FROM r)"""


def lookback(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_custkey") % 7 == 0, None).when(F.col("o_custkey") % 7 == 1, "2024-13-40").otherwise(F.to_date("o_orderdate").cast("string"))
    return o.select("o_orderkey", accounting.lookback(text, F.lit("1996-06-30").cast("date")).alias("outcome"))


def cached_results(spark, sf_dir):
    """Turns as results of their conversation's text."""
    t = table(spark, sf_dir, "conversations")
    n = F.length("text")
    rows = t.select(F.col("conv_id").cast("string").alias("sha256"), F.col("turn").alias("at"), F.when(n % 2 == 0, "p1").otherwise("p2").alias("parser"), (n * 200_000).cast("bigint").alias("size"))
    return merge.cached(rows, "p2")


def point_lookups(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"))
    return merge.looked_up(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), wanted, ["c_custkey"])


def school_defaults(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    n = F.length("text")
    rows = t.select("conv_id", "turn", F.when(n % 9 == 0, "done").alias("status"), F.when(n % 4 == 0, n).cast("bigint").alias("collected"))
    return merge.with_defaults(rows, ["conv_id"], ["turn"], {"status": "active", "collected": 0})


def site_overrides(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    given = c.filter("c_custkey % 3 = 0").select("c_custkey", (k % 5 == 0).alias("disabled"), F.when(k % 2 == 0, "other").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return merge.overridden(c, given, "c_custkey", ["c_name", "c_mktsegment"])


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "error").otherwise("done").alias("status"),
                    F.when(F.col("user_id") % 3 == 0, "B10").alias("only_office"), F.when(F.col("user_id") % 5 > 0, "r").alias("report"))


def last_national_runs(spark, sf_dir):
    return campaign.last_national(_runs(spark, sf_dir)).select("day", "run_id", "status")


def attempted_runs(spark, sf_dir):
    return campaign.attempted(_runs(spark, sf_dir))


def recent_notices(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    return last.orderBy(F.desc("updated"), "conv_id").limit(60)


def pending_notices(spark, sf_dir):
    """Customers with an order that is still open."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


def campaign_windows(spark, sf_dir):
    day = F.to_date("o_orderdate")
    days = table(spark, sf_dir, "orders").select(day.alias("d")).distinct()
    parts = [days.select(F.col("d").cast("string").alias("end"), F.lit(y).alias("years"), ids.campaign_window(F.col("d"), y)[0].alias("seed"), ids.campaign_window(F.col("d"), y)[1].cast("string").alias("start")) for y in (1, 3)]
    return parts[0].unionByName(parts[1])


def merge_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 6 == 0, " ").when(F.col("p_size") % 6 == 1, "x").when(F.col("p_size") % 6 == 2, "0").otherwise(F.col("p_partkey").cast("string"))
    return p.select("p_partkey", grids.span(text).cast("bigint").alias("span"))


def page_flow(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit("<p>글 "), n, F.lit("</p><nav>메뉴</nav><table><tr><td>왼쪽<table><tr><th>가<th>나<tr><td>"), n, F.lit("<td>2</table></td><td>끝</td></tr></table><ul><li><a href='/x'>파일</a></ul>"))
    return blocks.flow(p.select(F.lit("n").alias("notice_id"), F.col("page_id").alias("file_id"), html.alias("html"))).select("file_id", F.col("place").cast("bigint").alias("place"), "type", "text", F.size("cells").cast("bigint").alias("cells"))


def table_pages(spark, sf_dir):
    cells = tables(spark, sf_dir)
    t = F.col("table_id")
    layouts = cells.select("table_id").distinct().select("table_id", F.when(t % 5 == 0, "key_value_cards").when(t % 5 == 1, "grade_cards").when(t % 5 == 2, "timeline").when(t % 5 == 3, "scroll_table").otherwise("other").alias("layout"))
    return pages.as_layout(layouts, cells).select("table_id", F.sha2("html", 256).alias("html"))


def notice_pages(spark, sf_dir):
    """Conversations as notices, their turns as paragraphs, tables and source information."""
    t = table(spark, sf_dir, "conversations")
    c, n = F.col("conv_id"), F.col("turn")
    notices_ = t.select("conv_id").distinct().select(c.alias("notice_id"), F.concat(F.lit("제목 <"), c.cast("string"), F.lit(">")).alias("title"), (c % 2 == 0).alias("approved"))
    rows = t.select(c.alias("notice_id"), F.lit(0).alias("file_place"), n.alias("place"), F.when(n % 4 == 3, "table").otherwise("paragraph").alias("type"), F.when(n == 0, F.concat(F.lit("제목 <"), c.cast("string"), F.lit(">"))).when(n % 4 == 2, "[일정 & 장소]").otherwise(F.col("role")).alias("text"),
                    F.when(n == 0, "title").when((n == 1) & (c % 3 == 0), "source_info").alias("placement"), F.when(n % 4 == 3, "t").alias("table_id"))
    one = spark.createDataFrame([("t", "<table>x</table>")], "table_id string, html string")
    files = notices_.select("notice_id", F.lit(0).alias("place"), F.lit("가&나.hwp").alias("filename"), F.when(F.col("notice_id") % 5 == 0, "attachment").otherwise("convert").alias("role"), F.lit("/f?id=1&x").alias("url"))
    warnings = notices_.filter("notice_id % 7 = 0").select("notice_id", F.lit("경계를 확인하세요.").alias("message"))
    return pages.notices_html(notices_, rows, one, files, warnings).select("notice_id", F.sha2("html", 256).alias("html"))


PLANS = {
    "daily_report": (daily_report, REGIONS + " SELECT * FROM z"),
    "run_report": (run_report, REGIONS + " SELECT '2024-01-01' AS day, count(*) AS offices, CAST(sum(new) AS BIGINT) AS new, CAST(sum(shortfall) AS BIGINT) AS shortfall, CASE WHEN count(*) FILTER (WHERE shortfall > 0) > 0 THEN 'partial' ELSE 'complete' END AS status, string_agg(office, ',' ORDER BY office) FILTER (WHERE shortfall > 0) AS short FROM z"),
    "lookback": (lookback, """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'passes' WHEN o_custkey % 7 = 1 THEN 'malformed' WHEN CAST(o_orderdate AS DATE) > DATE '1996-06-30' THEN 'in_future' WHEN CAST(o_orderdate AS DATE) < DATE '1995-07-01' THEN 'too_old' ELSE 'passes' END AS outcome FROM orders"""),
    "cached_results": (cached_results, """SELECT CAST(conv_id AS VARCHAR) AS sha256, turn AS at, CASE WHEN length(text) % 2 = 0 THEN 'p1' ELSE 'p2' END AS parser, CAST(length(text) * 200000 AS BIGINT) AS size FROM conversations WHERE length(text) * 200000 <= 31457280
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 2 DESC, turn DESC) = 1"""),
    "point_lookups": (point_lookups, "SELECT DISTINCT o_custkey * 2 AS c_custkey, c_name, c_name IS NOT NULL AS found FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2"),
    "school_defaults": (school_defaults, "SELECT conv_id, CASE WHEN bool_or(length(text) % 9 = 0) THEN 'done' ELSE 'active' END AS status, coalesce(arg_max(length(text), turn) FILTER (WHERE length(text) % 4 = 0), 0) AS collected FROM conversations GROUP BY conv_id"),
    "site_overrides": (site_overrides, "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'other' ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 15 <> 0"),
    "last_national_runs": (last_national_runs, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(event_id) AS run_id, CASE arg_max(event_type, event_id) WHEN 'error' THEN 'error' ELSE 'done' END AS status FROM events WHERE event_type <> 'view' AND user_id % 3 <> 0 GROUP BY 1"),
    "attempted_runs": (attempted_runs, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE user_id % 3 <> 0 AND user_id % 5 <> 0 AND event_type NOT IN ('view', 'error')) > 0 AS attempted FROM events GROUP BY 1"),
    "recent_notices": (recent_notices, "SELECT conv_id, max(turn) AS updated FROM conversations GROUP BY conv_id ORDER BY updated DESC, conv_id LIMIT 60"),
    "pending_notices": (pending_notices, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "campaign_windows": (campaign_windows, "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT CAST(d AS VARCHAR) AS \"end\", y AS years, sha256('backfill:' || d)[1:16] AS seed, CAST(CAST(d - CASE y WHEN 1 THEN 365 ELSE 1095 END AS DATE) AS VARCHAR) AS start FROM d, (VALUES (1), (3)) v(y)"),
    "merge_counts": (merge_counts, "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CASE WHEN p_partkey BETWEEN 1 AND 200 THEN p_partkey END END AS span FROM part"),
    "page_flow": (page_flow, """SELECT page_id AS file_id, unnest([0, 1, 2, 3, 4]::BIGINT[]) AS place, unnest(['paragraph', 'paragraph', 'table', 'paragraph', 'paragraph']) AS type,
  unnest(['글 ' || page_id, '왼쪽', '가 나 ' || page_id || ' 2', '끝', '파일 (/x)']) AS text, unnest([NULL, NULL, 4, NULL, NULL]::BIGINT[]) AS cells FROM pages"""),
    "table_pages": (table_pages, f"""WITH {TABLES}, w AS (SELECT table_id, row, max(text) FILTER (WHERE col = 0) AS a, max(text) FILTER (WHERE col = 1) AS b, max(rowspan) AS s FROM cells GROUP BY table_id, row),
h AS (SELECT table_id, '<div class="scroll"><table>' || string_agg('<tr>' || CASE WHEN row = 0 THEN '<th' || CASE WHEN s > 1 THEN ' rowspan="2"' ELSE '' END || '>' || a || '</th><th>' || b || '</th>' ELSE '<td>' || a || '</td><td>' || b || '</td>' END || '</tr>', '' ORDER BY row) || '</table></div>' AS raw,
  '<div class="cards">' || string_agg('<div class="kv"><div class="k">' || a || '</div><div class="v">' || b || '</div></div>', '' ORDER BY row) || '</div>' AS keys,
  '<div class="cards">' || string_agg('<div class="card"><h4>' || a || '</h4><div class="kv"><div class="k">' || f || '</div><div class="v">' || b || '</div></div></div>', '' ORDER BY row) FILTER (WHERE row > 0) || '</div>' AS grade,
  '<ol class="timeline">' || string_agg('<li><span class="when">' || a || '</span><span>' || b || '</span></li>', '' ORDER BY row) || '</ol>' AS times
  FROM (SELECT *, first_value(b) OVER (PARTITION BY table_id ORDER BY row) AS f FROM w) GROUP BY table_id),
x AS (SELECT table_id, raw, CASE table_id % 5 WHEN 0 THEN keys WHEN 1 THEN grade WHEN 2 THEN times WHEN 3 THEN raw END AS body FROM h)
SELECT table_id, sha256(CASE WHEN body IS NULL THEN '<p class="note">{pages.NO_LAYOUT}</p>' || raw ELSE body || '<details><summary>{pages.RAW}</summary>' || raw || '</details>' END) AS html FROM x"""),
    "notice_pages": (notice_pages, f"""WITH b AS (SELECT conv_id AS c, string_agg(CASE WHEN turn % 4 = 3 THEN '<table>x</table>' WHEN turn % 4 = 2 THEN '<h2 class="paragraph">[일정 &amp; 장소]</h2>' ELSE '<p class="paragraph">' || role || '</p>' END, '' ORDER BY turn) FILTER (WHERE turn > 0 AND NOT (turn = 1 AND conv_id % 3 = 0)) AS body,
  string_agg('<p class="paragraph">' || role || '</p>', '') FILTER (WHERE turn = 1 AND conv_id % 3 = 0) AS aside FROM conversations GROUP BY conv_id)
SELECT c AS notice_id, sha256('<!doctype html><html lang="ko"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>제목 &lt;' || c || '&gt;</title></head><body><h3>제목 &lt;' || c || '&gt;</h3>'
  || CASE WHEN c % 2 = 1 THEN '<p class="note">{pages.UNREVIEWED}</p>' ELSE '' END || CASE WHEN c % 7 = 0 THEN '<p class="warning">경계를 확인하세요.</p>' ELSE '' END || '<article class="notice">' || coalesce(body, '')
  || coalesce('<section><h2>{pages.SENDER}</h2>' || aside || '</section>', '') || '</article><section class="attachments"><h2>{pages.FILES}</h2><ul><li><a href="/f?id=1&amp;x">가&amp;나.hwp</a><span> · ' || CASE WHEN c % 5 = 0 THEN '{pages.AS_FILE}' ELSE '{pages.AS_SOURCE}' END || '</span></li></ul></section></body></html>') AS html FROM b"""),
}
