"""Stored pages and sinks."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill import sinks
from tidemill.functions import urls
from tidemill.sources import crawl

BASE = "https://s.example/na/list.do?page=2"


def test_addresses():
    assert crawl.canonical("HTTP://A.example:80/x;jsessionid=1?b=2&utm_x=1&a=가#f") == "http://a.example/x?a=%EA%B0%80&b=2"
    assert crawl.canonical("https://학교.kr/") == "https://xn--9d0b527e.kr/" and crawl.canonical("http://a.example:443/") == "http://a.example:443/"
    assert [crawl.canonical(u) for u in ("ftp://a/", "http://u:p@a/", "http://a:8080/", "http://a/\\x", "http://a/\x01", "/x")] == [None] * 6


def test_boards_posts_and_pages():
    page = """<nav><a href="/b1">가정 통신문</a><a href="/view/1">가정통신문 글</a><a href="/map" title="x">사이트맵</a><a href="#" onclick="window.open('/b2')">학부모통신</a></nav>
      <table><tr><td><a href="/view/7">알림</a></td><td>2024.3.5</td></tr></table><a href="?page=3">다음</a>"""
    assert crawl.board_links(page, BASE) == ["https://s.example/b1", "https://s.example/b2"] and crawl.sitemap_links(page, BASE) == ["https://s.example/map"]
    assert crawl.post_links(page, BASE)[1] == ("https://s.example/view/7", "알림", "2024-03-05") and crawl.next_page(page, BASE) == "https://s.example/na/list.do?page=3"
    assert crawl.next_page("<a onclick=\"goPage('3')\" href='#'>3</a>", BASE) == "https://s.example/na/list.do?page=3" and crawl.next_page("", BASE) is None
    view = crawl.post_links("<a href=\"javascript:goView('123','x','4567')\">글</a>", "https://s.example/boardCnts/list.do?m=1")
    assert view == [("https://s.example/boardCnts/view.do?boardID=123&boardSeq=4567&lev=0&m=1", "글", None)]


def test_next_page_reads_whole_numbers():
    call = lambda n: f"<a href='#' onclick='goPage({n})'>x</a>"
    at = lambda n: f"https://s.example/list.do?page={n}"
    assert crawl.next_page(call(9999), at(9998)) == at(9999) and crawl.next_page(call(10000), at(9999)) == at(10000)
    assert crawl.next_page(call(123457), at(123456)) == at(123457) and crawl.next_page(call(10001), at(999)) is None
    assert crawl.next_page(call("1" * 5000), at(1)) is None and crawl.next_page("<a href='?page=2'>x</a>", at("%C2%B2")) == at(2)


def test_detail_and_guards():
    assert crawl.detail("<input type=PASSWORD>", BASE)["error"] == crawl.detail("<p>로그인이 필요합니다</p>", BASE)["error"] == "denied"
    assert crawl.detail("<div class=view_con>짧다</div>", BASE)["error"] == "unknown"
    assert crawl.detail("".join(f"<a href='/f{i}.pdf'>x</a>" for i in range(13)), BASE)["error"] == "too_many"
    found = crawl.detail("<h1 class=tit>제목: 운동회</h1><article><button>x</button>운동회를 알려 드립니다.<img src=/i.png></article>", BASE, "다른 제목")
    assert found["title"] == "운동회" and "button" not in found["body"] and found["attachments"] == [{"url": "https://s.example/i.png", "filename": "i.png"}]


def test_shells_frames_charsets():
    assert crawl.shell_targets("<!-- location.href='/a' --><script>location.replace('/b')</script>", BASE, 80) == ["https://s.example/b"]
    assert crawl.shell_targets("<a href=/x></a><script>location.href='/b'</script>", BASE, 60) == crawl.shell_targets("<script>location.href='/b'</script>", BASE, 7000) == []
    assert crawl.frames("<frame src=a><iframe src=/b></iframe><frame src=c>", BASE) == ["https://s.example/na/a", "https://s.example/b"]
    assert crawl.decoded("<meta charset=euc-kr>안내".encode("cp949")) == "<meta charset=euc-kr>안내" and crawl.decoded("안내".encode("cp949")) == "안내" and crawl.decoded("﻿안".encode()) == "안"


def test_opened_pages_meet_none_twice(spark):
    stored = spark.createDataFrame([("a", ["b"]), ("b", ["a", "c"]), ("c", ["a", "b"]), ("d", [])], "url string, shell array<string>")
    assert {r.url: (r.final, r.steps) for r in crawl.opened(stored.select("url"), stored).collect()} == {"a": ("c", 2), "b": ("a", 1), "c": ("b", 2), "d": ("d", 0)}


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/out.json"
    sinks.replace(spark.range(3), path)
    with pytest.raises(Exception):
        sinks.replace(spark.range(3).select(F.raise_error(F.lit("x")).alias("id")), path)
    assert spark.read.json(path).count() == 3 and len(list(tmp_path.glob("out.json*"))) == 1
    sinks.report(spark.range(1), f"file://{tmp_path}/reports", "run", "2024-01-01")
    assert spark.read.json(f"file://{tmp_path}/reports/run-latest.json").count() == 1
    assert sinks.bootstrap(spark, f"file://{tmp_path}/t", {"a": "x int"}) == ["a"] and sinks.bootstrap(spark, f"file://{tmp_path}/t", {"a": "x int"}) == []
    sinks.snapshot(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/copy")
    assert spark.read.parquet(f"file://{tmp_path}/copy/a.parquet").columns == ["x"]
    with sinks.Lock(spark, f"file://{tmp_path}/lock"), pytest.raises(RuntimeError):
        with sinks.Lock(spark, f"file://{tmp_path}/lock"):
            pass
    assert not list(tmp_path.glob("lock"))
    notices = spark.createDataFrame([("n", "<p>"), ("m", None)], "notice_id string, html string")
    files = spark.createDataFrame([("n", "a/x", bytearray(b"1")), ("n", "a/x", bytearray(b"1"))], "notice_id string, path string, content binary")
    found = {r.notice_id: zipfile.ZipFile(io.BytesIO(r.bundle)).namelist() for r in sinks.bundles(notices, files).collect()}
    assert found == {"n": ["a/x", "index.html"], "m": ["index.html"]}


def test_canonical_column_equals_the_exact_one(spark):
    rows = [("https://A.example:443/p;x=1?b=2&a=1&utm_q=1#z",), ("http://a.example",), ("mailto:x",)]
    found = spark.createDataFrame(rows, "u string").select(urls.canonical(F.col("u")).alias("c"), crawl.canonical_any("u").alias("e")).collect()
    assert all(r.c == r.e for r in found)


def test_uploads_and_results_that_are_there(spark, tmp_path):
    from tidemill.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_bytes("<html><p>안내 말씀</p>".encode())
    (tmp_path / "y.pdf").write_bytes(b"plain")
    (tmp_path / "z.exe").write_bytes(b"MZ")
    found = {r.filename: (r.kind, r.error) for r in files.scan(spark, str(tmp_path)).select("filename", "kind", "error").collect()}
    assert found == {"x.html": ("html", None), "y.pdf": ("unsupported", "content_mismatch"), "z.exe": ("unsupported", "bad_extension")}
    rows = spark.createDataFrame([("s1", bytearray(b"<html><p>one"), "a.html"), ("s2", bytearray(b"<html><p>two"), "b.html"), ("s2", bytearray(b"<html><p>two"), "c.html")], "sha256 string, content binary, filename string")
    stored = spark.createDataFrame([("s1", "html", "extracted", None, ["kept"], [], "p2"), ("s2", "html", "parse_error", "x", [], [], "p2")], f"sha256 string, kind string, {files.RESULT}, parser string")
    got = {r.sha256: (r.status, r.paragraphs) for r in files.extract_new(rows, stored, "p2").collect()}
    assert got == {"s1": ("extracted", ["kept"]), "s2": ("extracted", ["two"])}
