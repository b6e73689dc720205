"""URL functions: canonical form, paging, redirects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query keys that only track (fixed values).
TRACKING = ("fbclid", "gclid")
#: Names of a page number in a query, the first one present counting (fixed values).
PAGE_NAMES = ("pageIndex", "page", "pageNo", "cpage", "pageNum", "page_num", "PageNo", "page_no")
#: Script and meta forms of a redirect (fixed values).
SCRIPT_TARGET = r"""(?i)(?:location\s*\.\s*(?:href|replace)\s*(?:=\s*|\()|location\s*=\s*)["']([^"']{1,300})["']"""
META_TARGET = r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]*content=["'][^;"']*;\s*url=([^"'\s>]+)"""
COMMENT = r"(?s)<!--.*?-->"


def canonical(url: Column) -> Column:
    """Scheme, lower-case host, path without parameters, and the query sorted and without tracking; null if not allowed.

    Allowed are http and https on their own ports or 80 and 443, without user names, control characters or backslashes.
    ASCII hosts and queries that are already encoded come out exact.
    """
    url = F.trim(url)
    pattern = r"^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host, path, query = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3, 4))
    port = F.regexp_extract(host, r":(\d+)$", 1)
    name = F.lower(F.regexp_replace(host, r":\d*$", ""))
    own = F.when(scheme == "https", "443").otherwise("80")
    place = F.when((port == "") | (port == own), name).otherwise(F.concat(name, F.lit(":"), port))
    clean = F.regexp_replace(path, ";.*$", "")
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    kept = F.filter(pairs, lambda p: ~F.lower(p).startswith("utm_") & ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).isin(*TRACKING))
    ordered = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(F.regexp_extract(p, "^[^=]*", 0).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    out = F.concat(scheme, F.lit("://"), place, F.when(clean == "", "/").otherwise(clean), F.when(ordered == "", "").otherwise(F.concat(F.lit("?"), ordered)))
    allowed = url.rlike(pattern) & (name != "") & ~host.contains("@") & port.isin("", "80", "443") & ~url.rlike(r"[\x00-\x1F\\]")
    return F.when(allowed, out)


def current_page(url: Column) -> Column:
    found = [F.regexp_extract(url, rf"[?&]{name}=(\d+)(?:&|#|$)", 1) for name in PAGE_NAMES]
    return F.coalesce(*[F.when(f != "", f.try_cast("bigint")) for f in found], F.lit(1).cast("bigint"))


def redirects(html: Column) -> Column:
    """Targets of script and meta redirects outside comments: https first, then http, then relative, else as they stand."""
    plain = F.regexp_replace(html, COMMENT, "")
    found = F.concat(F.regexp_extract_all(plain, F.lit(SCRIPT_TARGET), F.lit(1)), F.regexp_extract_all(plain, F.lit(META_TARGET), F.lit(1)))
    useful = F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: (t != "") & ~t.rlike("^(javascript:|#|mailto:|tel:)")))
    kind = lambda t: F.when(t.startswith("https://"), 0).when(t.startswith("http://"), 1).otherwise(2)
    ranked = F.transform(useful, lambda t, i: F.struct(kind(t).alias("kind"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(ranked), lambda s: s["t"])
