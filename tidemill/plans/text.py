"""Text and URL queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text, urls
from tidemill.session import table

#: The oracle's engine has no look-around: edges are kept as groups, and a second pass meets numbers that shared an edge.
EDGE = r"[^\p{L}\p{N}_]"
NUMBERS = r"(?:\p{Nd}{6}[\s\p{Z}]*-[\s\p{Z}]*[1-8]\p{Nd}{6}|01[016789][- .]?\p{Nd}{3,4}[- .]?\p{Nd}{4})"
ONCE = f"regexp_replace(@, '(^|{EDGE}){NUMBERS}($|{EDGE})', '\\1{text.PII_MARK}\\2', 'g')"


def pii_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.has_pii(F.col("text")), F.lit(False)).alias("privacy_flag"))


def pii_mask(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.mask_pii(F.col("text")), 256).alias("masked"))


def risk_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_risky(F.col("text")).alias("risk"))


def date_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("접수 2019-1-2 ~ "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit(" 마감")).alias("t"))
    return docs.select("o_orderkey", text.last_date(F.regexp_replace("t", "199", "201")).cast("string").alias("day"))


def attachment_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("첨부 "), F.col("p_brand"), F.lit(".PDF 내려받기"))).when(F.col("p_partkey") % 3 == 1, " ").otherwise("안내")
    url = F.concat(F.lit("https://a.example/f/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".hwpx?x=1").otherwise(""))
    return parts.select("p_partkey", text.attachment_name(label, url).alias("name"))


def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


def current_page(spark, sf_dir):
    plain = F.regexp_replace("url", "#.*$", "")
    url = F.concat(plain, F.when(plain.contains("?"), "&").otherwise("?"), F.lit("pageNo="), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", urls.current_page(url).alias("page"))


def redirect_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    html = F.concat(F.lit("<!-- location.href='/old' --><script>location.href = '"), "url", F.lit("'; location.replace('/next')</script>"))
    return pages.select("page_id", F.array_join(urls.redirects(html), " ").alias("targets"))


def search_cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter(text.like_ascii(F.col("text"), "The And")).orderBy("doc_id").limit(20).select("doc_id", "lang")


def default_roles(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " 신청서.hwp").otherwise(".hwp"))
    return table(spark, sf_dir, "part").select("p_partkey", text.default_role(name).alias("role"))


def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("escaped"))


def login_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    form = F.when(F.col("page_id") % 3 == 0, '<INPUT name=x type="password">').when(F.col("page_id") % 3 == 1, "<p>login, password</p>").otherwise("")
    return pages.select("page_id", text.login_required(F.concat("html", form)).alias("gated"))


PLANS = {
    "pii_flag": (pii_flag, f"SELECT doc_id, coalesce(regexp_matches(text, '(^|{EDGE}){NUMBERS}($|{EDGE})') OR regexp_matches(text, '{text.PII_MAIL}'), false) AS privacy_flag FROM documents"),
    "pii_mask": (pii_mask, f"SELECT doc_id, sha256(regexp_replace({ONCE.replace('@', ONCE.replace('@', 'text'))}, '{text.PII_MAIL}', '{text.PII_MARK}', 'g')) AS masked FROM documents"),
    "risk_flag": (risk_flag, f"SELECT doc_id, regexp_matches(text, '{text.RISK}') AS risk FROM documents"),
    "date_extract": (date_extract, "SELECT o_orderkey, replace(strftime(o_orderdate, '%Y-%m-%d'), '199', '201') AS day FROM orders"),
    "attachment_names": (attachment_names, """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '.PDF' WHEN p_partkey % 2 = 0 THEN p_partkey || '.hwpx'
  WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE '안내' END AS name FROM part"""),
    "canonical_url": (canonical_url, r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS s, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS h,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ';.*$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT lower(split_part(x, '=', 1)) IN ('fbclid', 'gclid'))) AS l FROM p)
SELECT page_id, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(l) = 0 THEN '' ELSE '?' || array_to_string(l, '&') END AS url FROM k"""),
    "current_page": (current_page, r"SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=(\d+)(&|#|$)', 1) AS BIGINT), page_id) AS page FROM pages"),
    "redirect_targets": (redirect_targets, "SELECT page_id, url || ' /next' AS targets FROM pages"),
    "search_cases": (search_cases, "SELECT doc_id, lang FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the and') ORDER BY doc_id LIMIT 20"),
    "default_roles": (default_roles, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'attachment' ELSE 'convert' END AS role FROM part"),
    "html_escape": (html_escaped, """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages"""),
    "login_gate": (login_gate, """SELECT page_id, page_id % 3 = 0 OR regexp_matches(lower(html), 'fm_xb_login|loginpost.php|name=["'']?(mem_id|userid)["'']?|input[^>]+type=["'']?password') AS gated FROM pages"""),
}
