"""What stored pages of a site lead to: shells, frames, boards, posts, next pages, and the detail of a post."""

from __future__ import annotations

import ipaddress
import re
import urllib.robotparser
from functools import reduce
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemill.functions.text import FILE_TOKEN
from tidemill.functions.urls import COMMENT, META_TARGET, PAGE_NAMES, SCRIPT_TARGET, TRACKING
from tidemill.sources import tree

#: Labels of boards and site maps; addresses of posts, downloads and viewers; file ends (fixed values).
NOTICE = re.compile(r"가정\s*통신|학부모\s*통신|가정\s*안내|학교\s*통신")
SITEMAP = "사이트맵"
POST = re.compile(r"/view/\d+|/read/\d+|selectNttInfo\.do|boardCnts/view\.do|[?&](?:nttSn|boardSeq|wr_id|articleSeq|num|idx)=[\w-]+", re.I)
DOWNLOAD = re.compile(r"nttFileDownload|fileDown|download|atchFile|atchmnfl", re.I)
VIEWER = re.compile(r"/synap/skin/|/webviewer|documentViewer|/DocViewer|/viewer\.do|/skin/doc\.html", re.I)
FILE_END = re.compile(r"\.(?:pdf|hwpx?|docx|png|jpe?g|webp)(?:$|[?&#\s(])", re.I)
#: Where posts keep their title and body, tried in this order (fixed values).
TITLES = ".nttTitle,.bbs_view_tit,.bbs_view_title,.view_title,.board_view_title,.subject,th.tch-tit,.tch-tit,.bbs_view_tit_wrap,h1.tit,.viewBox h1,.bbs_ViewA h3,.bbsView h3,h1.title,h2.title"
BODIES = (
    "#nttCn", ".nttCn", ".bbs_view_cont", ".bbs_view_con", ".view_con", ".view_cont", ".viewCont", "#boardContents", ".board_view_con", ".board_view_content", ".bbsContent", ".view-content", ".board-view-body",
    ".bbs_view_body", "td.tch-ctnt", ".tch-ctnt", ".usm-editor-view", ".usm-content-body-id", ".bbs_view_cont_wrap", ".view_cont_wrap", "#content_body", ".viewBox", ".cntBody", ".board-text", ".subContent_body",
    ".subContent", ".subCntBody", "article",
)
#: Texts of a page that denies, the uploader's call, handlers that open a post or a page (fixed values).
DENIED = ("로그인이 필요합니다", "접근 권한이 없습니다", "자동입력 방지문자")
UPLOADED = re.compile(r"AddUploadedFile\(\s*'[^']*'\s*,\s*'([^']{1,240})'\s*,\s*'([^']{1,400})'", re.I)
OPENED = re.compile(r"""(?:location(?:\.href)?\s*=|window\.open\()\s*['"]([^'"]+)""")
POST_CALL = re.compile(r"""(?:nttInfo|goView|fnView|viewNtt|fnDetail|goDetail|viewArticle|[A-Za-z_]*[Vv]iew[A-Za-z_]*)\s*\(\s*['"]?(\d{2,})""")
VIEW_CALL = re.compile(r"goView\s*\(([^)]{0,200})\)")
PAGE_CALL = re.compile(
    r"""(?:fn_egov_link_page|goPage|linkPage|fnLinkPage|pageClick|fn_paging|movePage|fnPage|listPage|goList|fn_selectList|fnSearch|pageMove|go_page|fn_page)\s*\(\s*['"]?(\d+)""", re.I)
DAY = re.compile(r"\b(20\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})\b")
SHELL_BYTES, MOST_BOARDS, MOST_POSTS, MOST_MAPS, MOST_FRAMES, MOST_FILES, LEAST_BODY = 6000, 6, 50, 2, 2, 12, 10


def canonical(url: str) -> str | None:
    """functions.urls.canonical for any address: hosts of other scripts in their ASCII form, queries decoded and encoded anew."""
    if "\\" in url or any(ord(c) < 32 for c in url):
        return None
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").encode("idna").decode().lower(), parts.port
    except (ValueError, UnicodeError):
        return None
    if parts.scheme not in ("http", "https") or not host or parts.username or parts.password or port not in (None, 80, 443):
        return None
    host = f"[{host}]" if ":" in host else host
    if port and port != {"http": 80, "https": 443}[parts.scheme]:
        host += f":{port}"
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING))
    return urlunsplit((parts.scheme, host, parts.path.split(";", 1)[0] or "/", urlencode(query), ""))


@F.pandas_udf(T.StringType())
def canonical_any(url: pd.Series) -> pd.Series:
    return url.map(lambda u: canonical(u) if isinstance(u, str) else None)


def resolved(a: tree.Node, base: str) -> str | None:
    """The canonical address a link leads to, or that its script sets."""
    href = a.attrs.get("href", "")
    if not href or href.startswith(("#", "javascript:")):
        found = OPENED.search(f"{a.attrs.get('onclick', '')} {href}")
        href = found[1] if found else ""
    return canonical(urljoin(base, href)) if href else None


def _distinct(items, most: int) -> list:
    return list(dict.fromkeys(items))[:most]


def shell_targets(html: str, base: str, size: int) -> list[str]:
    """Where a small page without links redirects to, the best first: https, http, then relative; none for other pages."""
    if size > SHELL_BYTES or any("href" in a.attrs for a in tree.parse(html).select("a")):
        return []
    plain = re.sub(COMMENT, "", html)
    found = _distinct((t.strip() for p in (SCRIPT_TARGET, META_TARGET) for t in re.findall(p, plain)), 1000)
    useful = [t for t in found if t and not t.startswith(("javascript:", "#", "mailto:", "tel:"))]
    useful.sort(key=lambda t: next((i for i, s in enumerate(("https://", "http://")) if t.startswith(s)), 2))
    return _distinct((u for t in useful if (u := canonical(urljoin(base, t)))), 1000)


def frames(html: str, base: str) -> list[str]:
    """The first frames of a page that has no links of its own."""
    page = tree.parse(html)
    if any("href" in a.attrs for a in page.select("a")):
        return []
    return [urljoin(base, f.attrs["src"]) for f in page.select("frame,iframe") if f.attrs.get("src")][:MOST_FRAMES]


def board_links(html: str, base: str) -> list[str]:
    """Up to six addresses whose link's label or title names a notice board, posts and the page itself left out."""
    own = canonical(base)
    pairs = ((resolved(a, base), f"{a.text()} {a.attrs.get('title', '')}") for a in tree.parse(html).select("a"))
    return _distinct((u for u, label in pairs if u and u != own and NOTICE.search(label) and not POST.search(u)), MOST_BOARDS)


def sitemap_links(html: str, base: str) -> list[str]:
    pairs = ((resolved(a, base), a.text() + a.attrs.get("title", "")) for a in tree.parse(html).select("a"))
    return _distinct((u for u, label in pairs if u and SITEMAP in label), MOST_MAPS)


def _with_query(base, path: str, **query: str) -> str | None:
    return canonical(urlunsplit((base.scheme, base.netloc, path, urlencode({**dict(parse_qsl(base.query)), **query}), "")))


def _scripted(a: tree.Node, base) -> str | None:
    """The post that a script of the two known kinds of boards opens."""
    action = f"{a.attrs.get('onclick', '')} {a.attrs.get('href', '')}"
    if "selectNttList.do" in base.path:
        number = next((a.attrs[k] for k in ("data-id", "data-nttsn", "data-num") if a.attrs.get(k)), None) or ((m := POST_CALL.search(action)) and m[1])
        if number and str(number).isdigit():
            return _with_query(base, base.path.replace("selectNttList.do", "selectNttInfo.do"), nttSn=str(number))
    if "/boardCnts/list.do" in base.path and (call := VIEW_CALL.search(action)) and len(numbers := re.findall(r"\d{3,}", call[1])) > 1:
        return _with_query(base, base.path.replace("list.do", "view.do"), boardID=numbers[0], boardSeq=numbers[-1], lev="0")
    return None


def post_links(html: str, base: str, selector: str = "") -> list[tuple[str, str, str | None]]:
    """(url, title, day) of up to fifty posts of a board page; the day is the last date in the link's row."""
    own, out = urlsplit(base), {}
    for a in tree.parse(html).select(selector or "a"):
        url, title = resolved(a, base), a.text() or a.attrs.get("title", "")
        if not url or not POST.search(url):
            url = _scripted(a, own) or url
        if not url or not title or url in out or DOWNLOAD.search(url) or not (POST.search(url) or selector):
            continue
        days = DAY.findall((a.within("tr", "li") or a).text())
        out[url] = (url, title, "{}-{:0>2}-{:0>2}".format(*days[-1]) if days else None)
    return list(out.values())[:MOST_POSTS]


def _number(text: str | None) -> int | None:
    """The page number a text is, of any length that int reads; null if it is none."""
    try:
        return int(text) if text and text.isdigit() else None
    except ValueError:
        return None


def next_page(html: str, base: str) -> str | None:
    """The list page after this one, by a link to its number or a script that opens it; null without one."""
    own = urlsplit(base)
    query = dict(parse_qsl(own.query))
    wanted = 1 + next((n for k in PAGE_NAMES if (n := _number(query.get(k))) is not None), 1)
    links = tree.parse(html).select("a")
    for a in links:
        url = resolved(a, base)
        held = dict(parse_qsl(urlsplit(url).query)) if url else {}
        if any(_number(held.get(k)) == wanted for k in PAGE_NAMES):
            return url
    name = next((k for k in PAGE_NAMES if k in query), "pageIndex" if re.search("selectNttList|selectBBS|bbsList", own.path) else "page")
    calls = (PAGE_CALL.search(f"{a.attrs.get('onclick', '')} {a.attrs.get('href', '')}") for a in links)
    return _with_query(own, own.path, **{name: str(wanted)}) if any(c and _number(c[1]) == wanted for c in calls) else None


def detail(html: str, base: str, fallback: str = "", selector: str = "") -> dict:
    """error, title, body and attachments (url, filename) of a post.

    error is denied for a page that asks for a password or refuses, unknown for one without a body of ten characters or an
    attachment, too_many beyond twelve attachments; then nothing else is given.
    """
    page = tree.parse(html)
    failed = lambda code: {"error": code, "title": None, "body": None, "attachments": []}
    whole = page.text()
    if any(i.attrs.get("type", "").lower() == "password" for i in page.select("input")) or any(t in whole for t in DENIED):
        return failed("denied")
    heading = next(iter(page.select(TITLES)), None)
    title = re.sub(r"^(?:제\s*목|title)\s*[:：]?\s*", "", heading.text() if heading else fallback, flags=re.I).strip() or fallback
    files: dict[str, str] = {}
    for a in page.select("a"):
        url, label = resolved(a, base), a.text()
        if not url or url in files or VIEWER.search(url) or not (FILE_END.search(label) or FILE_END.search(url) or DOWNLOAD.search(url)):
            continue
        if "문서보기" in label and not DOWNLOAD.search(url):
            continue
        files[url] = (label if FILE_END.search(label) else urlsplit(url).path.rsplit("/", 1)[-1])[:240] or "attachment"
    for name, path in UPLOADED.findall(html):
        if (url := canonical(urljoin(base, path))) and url not in files:
            files[url] = (name.strip() or file_name("", url))[:240] or "attachment"
    node = next((n[0] for s in ([selector] if selector else BODIES) if (n := page.select(s))), None)
    body = ""
    if node is not None:
        without = frozenset(("script", "style", "form", "iframe", "object", "embed", "nav", "button"))
        body = node.html(without)
        for img in tree.parse(body).select("img[src]"):
            if (url := canonical(urljoin(base, img.attrs["src"]))) and url not in files:
                files[url] = urlsplit(url).path.rsplit("/", 1)[-1] or "image"
    if len(tree.parse(body).text()) < LEAST_BODY and not files:
        return failed("unknown")
    if len(files) > MOST_FILES:
        return failed("too_many")
    return {"error": None, "title": title, "body": body, "attachments": [{"url": u, "filename": n} for u, n in files.items()]}


def file_name(label: str, url: str) -> str:
    """functions.text.attachment_name of one link."""
    name = urlsplit(url).path.rsplit("/", 1)[-1]
    found = re.search(FILE_TOKEN, label)
    return found[0] if found else name if FILE_END.search(name) else label.strip() or name or "attachment"


def decoded(data: bytes) -> str:
    """A page's text by its byte order mark, the charset it names, then UTF-8, then the Korean Windows one."""
    named = re.search(rb"""charset\s*=\s*["']?([\w-]+)""", data[:2048], re.I)
    marked = [n for mark, n in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if data.startswith(mark)]
    for name in [*marked, *([named[1].decode()] if named else []), "utf-8", "cp949"]:
        try:
            return data.decode("cp949" if name.lower() in ("euc-kr", "ks_c_5601-1987", "ksc5601") else name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def page_text(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else decoded(bytes(c)))


def is_public(addresses: list[str]) -> bool:
    """Whether there is an address and all are of the public network."""
    try:
        return bool(addresses) and all(ipaddress.ip_address(a).is_global for a in addresses)
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def public_addresses(addresses: pd.Series) -> pd.Series:
    return addresses.map(lambda a: a is not None and is_public(list(a)))


def robots_verdicts(requests: DataFrame, agent: str) -> DataFrame:
    """The rows of `requests` (url, status, body of the site's rules) with allowed and crawl_delay (seconds, null if none is set).

    404 and 410 allow all; 200 that is no page goes by its rules; anything else forbids all.
    """

    def run(frames_):
        for frame in frames_:
            known, out = {}, []
            for url, status, body in zip(frame["url"], frame["status"], frame["body"]):
                key = (int(status), body or "")
                if key not in known:
                    parser = urllib.robotparser.RobotFileParser()
                    page = "<html" in key[1][:500].lower()
                    lines = ["User-agent: *", "Disallow:"] if key[0] in (404, 410) else key[1].splitlines() if key[0] == 200 and not page else ["User-agent: *", "Disallow: /"]
                    parser.parse(lines)
                    known[key] = parser
                delay = known[key].crawl_delay(agent) or known[key].crawl_delay("*")
                out.append((known[key].can_fetch(agent, url), float(delay) if delay else None))
            frame = frame.copy()
            frame["allowed"], frame["crawl_delay"] = [a for a, _ in out], [d for _, d in out]
            yield frame

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{shape}, allowed boolean, crawl_delay double")


POSTS = "array<struct<url:string,title:string,day:string>>"
READ = f"""shell array<string>, frames array<string>, boards array<string>, maps array<string>, posts {POSTS}, next string,
  error string, title string, body string, attachments array<struct<url:string,filename:string>>"""


def read(pages: DataFrame, *wanted: str) -> DataFrame:
    """The rows of `pages` (url, html) with the `wanted` columns of READ, each page parsed by itself; null html is empty."""
    whole = T._parse_datatype_string(READ)
    picked = [f for f in whole.fields if f.name in wanted]
    simple = {"shell": lambda h, u: shell_targets(h, u, len(h.encode())), "frames": frames, "boards": board_links, "maps": sitemap_links, "posts": post_links, "next": next_page}
    deep = [n for n in ("error", "title", "body", "attachments") if n in wanted]

    def run(frames_):
        for frame in frames_:
            frame = frame.copy()
            pairs = [(h or "", u or "") for h, u in zip(frame["html"], frame["url"])]
            for name in (n for n in wanted if n in simple):
                frame[name] = [[dict(zip(("url", "title", "day"), p)) for p in simple[name](*x)] if name == "posts" else simple[name](*x) for x in pairs]
            if deep:
                found = [detail(*x) for x in pairs]
                for name in deep:
                    frame[name] = [d[name] for d in found]
            yield frame[[*names, *[f.name for f in picked]]]

    names = list(pages.columns)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), *(f"{f.name} {f.dataType.simpleString()}" for f in picked)])
    return pages.mapInPandas(run, shape)


def opened(start: DataFrame, stored: DataFrame, hops: int = 3) -> DataFrame:
    """url, final and steps: where each start ends after up to `hops` shells among stored pages (url, shell); no page is met twice."""
    out = start.select("url", F.col("url").alias("final"), F.array("url").alias("seen"))
    step = stored.select(F.col("url").alias("__u"), F.col("shell").alias("__s"))
    for _ in range(hops):
        both = out.join(step, out["final"] == step["__u"], "left")
        target = F.get(F.filter(F.coalesce("__s", F.array().cast("array<string>")), lambda t: ~F.array_contains(F.col("seen"), t)), 0)
        both = both.withColumn("__t", target)
        out = both.select("url", F.coalesce("__t", "final").alias("final"), F.when(F.col("__t").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("__t"))).alias("seen"))
    return out.select("url", "final", (F.size("seen") - 1).cast("bigint").alias("steps"))


def find_boards(schools: DataFrame, **sources: DataFrame) -> DataFrame:
    """school, board, place and origin: the boards to read of each school, from the first source that has any.

    Sources (school, board, place) in order: override, known, cached, home, sitemap; those not given are left out.
    """
    order = [n for n in ("override", "known", "cached", "home", "sitemap") if n in sources]
    parts = [sources[n].select("school", "board", "place", F.lit(i).alias("rank"), F.lit(n).alias("origin")) for i, n in enumerate(order)]
    every = reduce(DataFrame.unionByName, parts).join(schools.select("school"), "school", "left_semi")
    best = every.groupBy("school").agg(F.min("rank").alias("rank"))
    rows = every.join(best, ["school", "rank"])
    return rows.groupBy("school", "board").agg(F.min("place").alias("place"), F.min("origin").alias("origin"))


def moved(hops: DataFrame, allowed: DataFrame, most: int = 6, hosts: int = 2) -> DataFrame:
    """verdict of each redirect chain (chain, step, host) against the hosts allowed for it (chain, host): ok, too_long, or
    foreign_host where it leaves them for more than `hosts` new ones."""
    known = allowed.select("chain", "host").distinct().withColumn("__k", F.lit(True))
    both = hops.join(known, ["chain", "host"], "left")
    new = F.size(F.collect_set(F.when(F.col("__k").isNull(), F.col("host"))))
    return both.groupBy("chain").agg(F.count("*").alias("steps"), new.alias("new")).select("chain", F.when(F.col("new") > hosts, "foreign_host").when(F.col("steps") > most, "too_long").otherwise("ok").alias("verdict"))


def retries(attempts: DataFrame, most: int = 3, cooldown: int = 3600) -> DataFrame:
    """outcome of each request (request, at, attempt, status; status null for a broken connection) and until when its host rests.

    A connection is tried up to `most` times; 429 ends it and rests the host for `cooldown` seconds.
    """
    out = attempts.groupBy("request").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("attempt"))).alias("status"), F.max("attempt").alias("tries"), F.max(F.when(F.col("status") == 429, F.col("at"))).alias("limited"))
    outcome = F.when(F.col("limited").isNotNull(), "rests").when(F.col("status").isNull() & (F.col("tries") >= most), "failed").when(F.col("status").isNull(), "again").otherwise("answered")
    return out.select("request", outcome.alias("outcome"), (F.col("limited") + F.expr(f"INTERVAL {cooldown} SECONDS")).alias("rests_until"))


def hosts_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
