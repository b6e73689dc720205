"""Stored pages: redirect shells, board choice, rendering of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions import text, urls


def follow(start: DataFrame, hops: DataFrame, most: int = 3) -> DataFrame:
    """url, final, steps: where each start ends after up to `most` shells; hops (url, target) has one target a url."""
    out = start.select("url", F.col("url").alias("final"), F.lit(0).alias("steps"))
    step = hops.select(F.col("url").alias("__u"), F.col("target").alias("__t"))
    for _ in range(most):
        joined = out.join(step, out["final"] == step["__u"], "left")
        out = joined.select("url", F.coalesce("__t", "final").alias("final"), (F.col("steps") + F.col("__t").isNotNull().cast("int")).alias("steps"))
    return out


def first_board(boards: DataFrame) -> DataFrame:
    """The first board of each school, by priority and place, that has posts; without any, the last error."""
    found = boards.groupBy("school").agg(
        F.min_by("board", F.when(F.col("posts") > 0, F.struct("priority", "place"))).alias("board"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("priority", "place"))).alias("error"))
    return found.withColumn("error", F.when(F.col("board").isNull(), F.col("error")))


def rendered(cells: DataFrame) -> DataFrame:
    """html of each table as it is: rows and cells in order, merges kept, text escaped. A table's cells are bounded."""
    one = F.concat(
        F.when(F.col("header"), "<th").otherwise("<td"),
        F.when(F.col("rowspan") > 1, F.concat(F.lit(' rowspan="'), F.col("rowspan").cast("string"), F.lit('"'))).otherwise(""),
        F.when(F.col("colspan") > 1, F.concat(F.lit(' colspan="'), F.col("colspan").cast("string"), F.lit('"'))).otherwise(""),
        F.lit(">"), text.html_escape(F.coalesce("text", F.lit(""))), F.when(F.col("header"), "</th>").otherwise("</td>"))
    joined = lambda items: F.array_join(F.transform(F.array_sort(items), lambda s: s["h"]), "")
    rows = cells.withColumn("h", one).groupBy("table_id", "row").agg(joined(F.collect_list(F.struct("col", "h"))).alias("h"))
    whole = rows.withColumn("h", F.concat(F.lit("<tr>"), "h", F.lit("</tr>"))).groupBy("table_id").agg(joined(F.collect_list(F.struct("row", "h"))).alias("h"))
    return whole.select("table_id", F.concat(F.lit("<table>"), "h", F.lit("</table>")).alias("html"))


def key_values(cells: DataFrame) -> DataFrame:
    """table_id, row, key, value of tables with exactly two columns; others give no rows and are shown as they are."""
    width = cells.groupBy("table_id").agg(F.max(F.col("col") + F.col("colspan")).alias("w")).filter("w = 2").select("table_id")
    side = lambda i: F.max(F.when(F.col("col") == i, F.col("text")))
    return cells.join(width, "table_id").groupBy("table_id", "row").agg(side(0).alias("key"), side(1).alias("value"))


#: Sentences around a conversion (fixed values).
UNREVIEWED, NO_TABLE, NO_LAYOUT, RAW = "미검수 변환 결과 — 원문 대조 후 사용하세요.", "추출된 표가 없습니다. 원문을 확인하세요.", "이 구조는 아직 전용 컴포넌트가 없어 원문 표를 표시합니다.", "원문 표 그대로 보기"
SENDER, FILES, AS_FILE, AS_SOURCE = "발신 정보·문의처 (원문 표기)", "원본 및 함께 첨부한 파일", "원본 첨부 유지", "안내 원본 / 작성용 서식 포함 시 원본 사용"


def _tag(name: str, kind: str | None, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}{f' class="{kind}"' if kind else ''}>"), *inner, F.lit(f"</{name}>"))


def as_layout(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id and html of each table (table_id, layout): cards, a timeline or the table itself, and the whole table below it.

    Cards of two columns, cards by the first cell under the first row's labels, a timeline of first cells; a table that does
    not fit its layout is shown as it is. Every text is escaped, none is left out.
    """
    text_of = text.html_escape(F.coalesce("text", F.lit("")))
    rows = cells.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", text_of.alias("t")))), lambda s: s["t"]).alias("c"), F.max(F.col("col") + F.col("colspan")).alias("w"))
    grids_ = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "c"))), lambda s: s["c"]).alias("rows"), F.max("w").alias("cols"))
    raw = rendered(cells).select("table_id", F.col("html").alias("raw"))
    pair = lambda k, v: _tag("div", "kv", _tag("div", "k", k), _tag("div", "v", v))
    alone = lambda c: _tag("div", "kv", _tag("div", "v", F.array_join(c, " ")))
    all_of = lambda items: F.array_join(items, "")
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    head = F.get("rows", 0)
    keys = F.when(F.col("cols") == 2, all_of(F.transform("rows", lambda c: F.when(F.size(c) == 2, pair(F.get(c, 0), F.get(c, 1))).otherwise(alone(c)))))
    grade = all_of(F.transform(rest(F.col("rows")), lambda c: _tag("div", "card", _tag("h4", None, F.get(c, 0)), all_of(F.transform(rest(c), lambda t, i: pair(F.coalesce(F.get(head, i + 1), F.lit("")), t))))))
    times = all_of(F.transform("rows", lambda c: F.concat(F.lit("<li>"), _tag("span", "when", F.get(c, 0)), _tag("span", None, F.array_join(rest(c), " ")), F.lit("</li>"))))
    boxed = _tag("div", "scroll", F.col("raw"))
    body = (
        F.when(F.col("layout") == "key_value_cards", F.when(keys != "", _tag("div", "cards", keys))).when(F.col("layout") == "grade_cards", F.when(grade != "", _tag("div", "cards", grade)))
        .when(F.col("layout") == "timeline", _tag("ol", "timeline", times)).when(F.col("layout").isin("scroll_table", "comparison", "read_only_form"), boxed))
    whole = F.concat(body, F.lit(f"<details><summary>{RAW}</summary>"), boxed, F.lit("</details>"))
    html = F.when(F.col("raw").isNull(), _tag("p", "note", F.lit(NO_TABLE))).otherwise(F.coalesce(whole, F.concat(_tag("p", "note", F.lit(NO_LAYOUT)), boxed)))
    return tables.join(grids_, "table_id", "left").join(raw, "table_id", "left").select("table_id", html.alias("html"))


def notices_html(notices: DataFrame, blocks: DataFrame, tables: DataFrame, files: DataFrame, warnings: DataFrame) -> DataFrame:
    """notice_id and html, a whole page for each notice (notice_id, title, approved).

    `blocks` has notice_id, file_place, place, type, text, placement, table_id; `tables` table_id and html; `files` notice_id,
    place, filename, role, url; `warnings` notice_id and message. Blocks stand in order of their files, source information
    after them, then the files; a paragraph that repeats the title is left out, headings are set as such.
    """
    esc = lambda c: text.html_escape(F.coalesce(c, F.lit("")))
    line = F.col("text")
    heading = (line.startswith("[") & F.rtrim(line).endswith("]")) | line.rlike(r"^[가-하][.．]\s*.{1,25}$")
    drawn = F.when(F.col("type") == "table", F.coalesce("html", F.lit(""))).when(heading, _tag("h2", "paragraph", esc(line))).otherwise(_tag("p", "paragraph", esc(line)))
    own = blocks.join(tables, "table_id", "left").join(notices.select("notice_id", "title"), "notice_id")
    again = (F.col("placement") == "title") & (line == F.col("title"))
    spot = F.struct("file_place", "place", drawn.alias("h"))
    aside = F.coalesce(F.col("placement") == "source_info", F.lit(False))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["h"]), "")
    parts = own.filter(~F.coalesce(again, F.lit(False))).groupBy("notice_id").agg(joined(F.collect_list(F.when(~aside, spot))).alias("body"), joined(F.collect_list(F.when(aside, spot))).alias("aside"))
    role = F.when(F.col("role") == "attachment", AS_FILE).otherwise(AS_SOURCE)
    item = F.concat(F.lit('<li><a href="'), esc(F.col("url")), F.lit('">'), esc(F.col("filename")), F.lit("</a><span> · "), role, F.lit("</span></li>"))
    lists = files.groupBy("notice_id").agg(joined(F.collect_list(F.struct("place", item.alias("h")))).alias("files"))
    notes = warnings.groupBy("notice_id").agg(F.array_join(F.array_sort(F.collect_list(_tag("p", "warning", esc(F.col("message"))))), "").alias("notes"))
    every = notices.join(parts, "notice_id", "left").join(lists, "notice_id", "left").join(notes, "notice_id", "left")
    or_none = lambda c: F.coalesce(c, F.lit(""))
    html = F.concat(
        F.lit('<!doctype html><html lang="ko"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>'), esc(F.col("title")), F.lit("</title></head><body><h3>"), esc(F.col("title")), F.lit("</h3>"),
        F.when(~F.col("approved"), _tag("p", "note", F.lit(UNREVIEWED))).otherwise(""), or_none("notes"), F.lit('<article class="notice">'), or_none("body"),
        F.when(or_none("aside") != "", F.concat(F.lit(f"<section><h2>{SENDER}</h2>"), F.col("aside"), F.lit("</section>"))).otherwise(""),
        F.lit(f'</article><section class="attachments"><h2>{FILES}</h2><ul>'), or_none("files"), F.lit("</ul></section></body></html>"))
    return every.select("notice_id", html.alias("html"))


def redirect_target(html: Column) -> Column:
    return F.get(urls.redirects(html), 0)
