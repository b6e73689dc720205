"""Queries over stored pages: each page gets links, posts or a shell of a known kind put in, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.session import table
from tidemill.sources import crawl


def _pages(spark, sf_dir, extra, keep=True):
    p = table(spark, sf_dir, "pages")
    html = F.concat(F.when(F.lit(keep), F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)href", "data-x")).otherwise(""), extra)
    return p.select("page_id", F.concat(F.lit("https://s.example/b/list.do?page="), F.col("page_id").cast("string")).alias("url"), html.alias("html"))


def _id(before: str, after: str):
    return F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit(after))


def board_links(spark, sf_dir):
    extra = F.concat(_id('<nav><a href="/board/', '?utm_source=x">가정 통신문</a>'), _id('<a href="#" onclick="location.href=\'/c/', '\'" title="학교통신">x</a><a href="/view/5">가정통신</a><a href="/board/0">공지</a></nav>'))
    found = crawl.read(_pages(spark, sf_dir, extra), "boards", "maps")
    return found.select("page_id", F.array_join("boards", " ").alias("boards"), F.size("maps").cast("bigint").alias("maps"))


def post_links(spark, sf_dir):
    rows = [_id("<table><tr><td><a href='/view/", "'>첫 글</a><td>2024.3.5"), _id("<tr><td><a href='/view/9?idx=", "' title=둘째></a><td>2023-12-31 ~ 2024/1/9"), F.lit("<tr><td><a href='/fileDown?num=1'>파일</a><a href='/about'>소개</a></table>")]
    found = crawl.read(_pages(spark, sf_dir, F.concat(*rows)), "posts").select("page_id", F.explode("posts").alias("p"))
    return found.select("page_id", "p.url", "p.title", F.col("p.day").alias("day"))


def scripted_posts(spark, sf_dir):
    p = _pages(spark, sf_dir, F.concat(F.lit("<ul><li><a href='javascript:;' onclick=\"nttInfo('"), (F.col("page_id") + 100).cast("string"), F.lit("')\">글</a> 2024-01-02</li></ul>")))
    return crawl.read(p.withColumn("url", F.lit("https://s.example/na/selectNttList.do?mi=7&bbsId=3")), "posts").select("page_id", F.array_join(F.transform("posts", lambda x: F.concat_ws(" ", x["url"], x["day"])), ",").alias("posts"))


def next_pages(spark, sf_dir):
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a href='?pageNo="), (F.col("page_id") + 1).cast("string"), F.lit("'>다음</a>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<a href='#' onclick='goPage("), (F.col("page_id") + 1).cast("string"), F.lit(")'>다음</a>"))).otherwise("<a href='?page=1'>처음</a>")
    return crawl.read(_pages(spark, sf_dir, link), "next").select("page_id", "next")


def post_detail(spark, sf_dir):
    body = F.when(F.col("page_id") % 5 == 0, "<input type=password>").when(F.col("page_id") % 5 == 1, "<div class='view_con'>짧음</div>").otherwise("<div class='a view_con'><form>x</form><p>운동회를 알립니다. 모두 오세요.</p><img src='/i/a.png'></div>")
    head = _id("<h1 class='tit'>제목 : 알림 ", "</h1>")
    file = F.when(F.col("page_id") % 5 == 2, "<a href='/download?id=1'>안내 문서.hwp</a><a href='/synap/skin/doc.html?f=a.hwp'>바로보기</a><script>AddUploadedFile('1','둘째 파일.pdf','/f/2.pdf')</script>").otherwise("")
    found = crawl.read(_pages(spark, sf_dir, F.concat(head, body, file), False), "error", "title", "body", "attachments")
    return found.select("page_id", "error", "title", "body", F.array_join(F.transform("attachments", lambda a: F.concat_ws("=", a["url"], a["filename"])), ",").alias("attachments"))


def shell_pages(spark, sf_dir):
    shell = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<!-- location.href='/old' --><script>location.href='https://s.example/b/list.do?page="), (F.col("page_id") + 4).cast("string"), F.lit("'</script>"))).when(F.col("page_id") % 4 == 1, "<a href='/x'>x</a><script>location.href='/y'</script>").otherwise("")
    return crawl.read(_pages(spark, sf_dir, shell, False), "shell")


def shells(spark, sf_dir):
    return shell_pages(spark, sf_dir).select("page_id", F.array_join("shell", " ").alias("targets"))


def opened_pages(spark, sf_dir):
    stored = shell_pages(spark, sf_dir)
    return crawl.opened(stored.select("url"), stored)


def frame_pages(spark, sf_dir):
    extra = F.when(F.col("page_id") % 2 == 0, "<frameset><frame src='/top.do'><frame src='main.do'><frame src='/third.do'></frameset>").otherwise("<a href='/x'>x</a><iframe src='/f.do'></iframe>")
    return crawl.read(_pages(spark, sf_dir, extra, False), "frames").select("page_id", F.array_join("frames", " ").alias("frames"))


def chosen_boards(spark, sf_dir):
    """Customers as schools: boards from an override, what is known, the cache, the home page or the site map."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("school"))
    s = F.col("school")
    boards = lambda name, share, n: c.filter(s % share == 0).select("school", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("place")).select("school", F.concat_ws("/", F.lit(name), "place").alias("board"), "place")
    found = crawl.find_boards(c, override=boards("o", 13, 1), known=boards("k", 7, 0), cached=boards("c", 5, 0), home=boards("h", 2, 2), sitemap=boards("m", 3, 0))
    return found.select("school", "board", F.col("place").cast("bigint").alias("place"), "origin")


def redirect_hosts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hops = e.select(F.col("user_id").alias("chain"), F.col("event_id").alias("step"), F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("host"))
    allowed = e.select(F.col("user_id").alias("chain"), F.lit("h0").alias("host")).unionByName(e.filter("user_id % 3 = 0").select(F.col("user_id").alias("chain"), F.lit("h1").alias("host")))
    return crawl.moved(hops, allowed, 12)


def request_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    attempt = (F.col("event_id") % 3 + 1).cast("int")
    rows = e.select((F.col("event_id") / 3).cast("bigint").alias("request"), attempt.alias("attempt"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "purchase", 429).alias("status"))
    return crawl.retries(rows).select("request", "outcome", F.col("rests_until").isNotNull().alias("rests"))


def robots(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 2 == 0, "User-agent: *\nCrawl-delay: 7\nDisallow: /private/\n").otherwise("<html>blocked</html>")
    requests = p.select("page_id", F.when(F.col("page_id") % 3 == 0, _id("https://s.example/private/", "")).otherwise(_id("https://s.example/", "")).alias("url"), F.when(F.col("page_id") % 5 == 0, 404).when(F.col("page_id") % 5 == 1, 503).otherwise(200).alias("status"), body.alias("body"))
    return crawl.robots_verdicts(requests, "tidemill").select("page_id", "allowed", "crawl_delay")


def public_hosts(spark, sf_dir):
    a = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("8.8.8.8"))).when(F.col("page_id") % 4 == 1, F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1"))).when(F.col("page_id") % 4 == 2, F.array(F.lit("127.0.0.1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "pages").select("page_id", crawl.public_addresses(a).alias("public"))


def exact_urls(spark, sf_dir):
    url = F.concat(F.when(F.col("page_id") % 2 == 0, "HTTP://학교.example:80").otherwise("https://A.Example:8443"), _id("/a;jsessionid=1?b=", " 가&utm_x=1&a=2#f"))
    return table(spark, sf_dir, "pages").select("page_id", crawl.canonical_any(url).alias("url"))


def page_charsets(spark, sf_dir):
    content = F.encode(F.concat(F.lit("<meta charset=utf-8>"), F.substring("html", 1, 50)), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(crawl.page_text(content), 256).alias("text"))


PLANS = {
    "board_links": (board_links, "SELECT page_id, 'https://s.example/board/' || page_id || ' https://s.example/c/' || page_id AS boards, CAST(0 AS BIGINT) AS maps FROM pages"),
    "post_links": (post_links, "SELECT page_id, 'https://s.example/view/' || page_id AS url, '첫 글' AS title, '2024-03-05' AS day FROM pages UNION ALL SELECT page_id, 'https://s.example/view/9?idx=' || page_id, '둘째', '2024-01-09' FROM pages"),
    "scripted_posts": (scripted_posts, "SELECT page_id, 'https://s.example/na/selectNttInfo.do?bbsId=3&mi=7&nttSn=' || (page_id + 100) || ' 2024-01-02' AS posts FROM pages"),
    "next_pages": (next_pages, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://s.example/b/list.do?pageNo=' || (page_id + 1) WHEN 1 THEN 'https://s.example/b/list.do?page=' || (page_id + 1) END AS next FROM pages"),
    "post_detail": (post_detail, """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'denied' WHEN 1 THEN 'unknown' END AS error, CASE WHEN page_id % 5 > 1 THEN '알림 ' || page_id END AS title,
  CASE WHEN page_id % 5 > 1 THEN '<div class="a view_con"><p>운동회를 알립니다. 모두 오세요.</p><img src="/i/a.png"></div>' END AS body,
  CASE WHEN page_id % 5 = 2 THEN 'https://s.example/download?id=1=안내 문서.hwp,https://s.example/f/2.pdf=둘째 파일.pdf,https://s.example/i/a.png=a.png' WHEN page_id % 5 > 2 THEN 'https://s.example/i/a.png=a.png' ELSE '' END AS attachments FROM pages"""),
    "shells": (shells, "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://s.example/b/list.do?page=' || (page_id + 4) ELSE '' END AS targets FROM pages"),
    "opened_pages": (opened_pages, """WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN least(3, (SELECT max(page_id) FROM pages) // 4 - page_id // 4 + 1) ELSE 0 END AS n FROM pages)
SELECT 'https://s.example/b/list.do?page=' || page_id AS url, 'https://s.example/b/list.do?page=' || (page_id + 4 * n) AS final, n AS steps FROM p"""),
    "frame_pages": (frame_pages, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://s.example/top.do https://s.example/b/main.do' ELSE '' END AS frames FROM pages"),
    "chosen_boards": (chosen_boards, """WITH c AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 13 = 0 THEN 'override' WHEN c_custkey % 7 = 0 THEN 'known' WHEN c_custkey % 5 = 0 THEN 'cached' WHEN c_custkey % 2 = 0 THEN 'home' WHEN c_custkey % 3 = 0 THEN 'sitemap' END AS o FROM customer),
b AS (SELECT s, o, unnest(range(CASE o WHEN 'override' THEN 2 WHEN 'home' THEN 3 ELSE 1 END)) AS p FROM c WHERE o IS NOT NULL)
SELECT s AS school, CASE o WHEN 'sitemap' THEN 'm' ELSE o[1] END || '/' || p AS board, p AS place, o AS origin FROM b"""),
    "redirect_hosts": (redirect_hosts, """SELECT user_id AS chain, CASE WHEN count(DISTINCT event_id % 5) FILTER (WHERE event_id % 5 <> 0 AND NOT (event_id % 5 = 1 AND user_id % 3 = 0)) > 2 THEN 'foreign_host' WHEN count(*) > 12 THEN 'too_long' ELSE 'ok' END AS verdict FROM events GROUP BY user_id"""),
    "request_outcomes": (request_outcomes, """WITH r AS (SELECT event_id // 3 AS request, event_id % 3 + 1 AS a, CASE event_type WHEN 'view' THEN 200 WHEN 'purchase' THEN 429 END AS s FROM events),
g AS (SELECT request, max(a) AS tries, bool_or(s = 429) AS limited, arg_max(s, a) FILTER (WHERE s IS NOT NULL) AS s FROM r GROUP BY request)
SELECT request, CASE WHEN limited THEN 'rests' WHEN s IS NOT NULL THEN 'answered' WHEN tries >= 3 THEN 'failed' ELSE 'again' END AS outcome, coalesce(limited, false) AS rests FROM g"""),
    "robots": (robots, """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN true WHEN page_id % 5 = 1 OR page_id % 2 = 1 THEN false ELSE page_id % 3 <> 0 END AS allowed, CASE WHEN page_id % 5 > 1 AND page_id % 2 = 0 THEN 7.0::DOUBLE END AS crawl_delay FROM pages"""),
    "public_hosts": (public_hosts, "SELECT page_id, page_id % 4 = 0 AS public FROM pages"),
    "exact_urls": (exact_urls, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://xn--9d0b527e.example/a?a=2&b=' || page_id || '+%EA%B0%80' END AS url FROM pages"),
    "page_charsets": (page_charsets, "SELECT page_id, sha256('<meta charset=utf-8>' || html[1:50]) AS text FROM pages"),
}
