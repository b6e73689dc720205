"""Cases, conversion and corpus state on small Korean fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import ids, text
from tidemill.operators import conversion, corpus, curation, grids, pages
from tidemill.sources import blocks

CELLS = "table_id string, row int, col int, rowspan int, colspan int, text string, header boolean, nested boolean"


def cells(name, rows, spans={}, nested=False):
    return [(name, r, c, *spans.get((r, c), (1, 1)), t, r == 0, nested) for r, row in enumerate(rows) for c, t in enumerate(row)]


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


@pytest.mark.parametrize("given,masked", [
    ("전화 010-1234-5678 010-1111-2222 끝", "전화 X X 끝"), ("010-1234-5678,01011112222", "X,X"), ("900101-1234567 850505 - 2345678", "X X"), ("가010-1234-5678", "가010-1234-5678"),
    ("01012345678@x.com", "X@x.com"), ("문의 a.b@school.kr, c@d.co.kr", "문의 X, X"), ("2024-05-02", "2024-05-02"), ("", ""),
])
def test_masking(spark, given, masked):
    found = spark.createDataFrame([(given,)], "t string").select(text.mask_pii(F.col("t")).alias("m"), text.has_pii(F.col("t")).alias("f")).first()
    assert found.m == masked.replace("X", text.PII_MARK) and found.f == ("X" in masked)


def test_notice_identity_is_that_of_the_canonical_record(spark):
    rows = [("제목\x0b\"인용\"\\", " <p>가</p> 　<b>나</b>\x1f", ["b", "a", "b"]), ("　가\x1c", "<p>1</p>\n <p>\x01</p>", []), ("", "", ["z"])]
    found = spark.createDataFrame(rows, "t string, h string, s array<string>").select(ids.notice_key(F.col("t"), F.col("h"), F.col("s")).alias("id")).collect()
    import re
    want = [hashlib.sha256(canonical({"title": t.strip(), "html": re.sub(r">\s+<", "><", h.strip()), "assets": sorted(set(s))}).encode()).hexdigest() for t, h, s in rows]
    assert [r.id for r in found] == want


def test_structure_of_tables(spark):
    rows = cells("a", [["가;나", "다"], ["1", "2"]]) + cells("b", [["가", "나;다"], ["1", "2"]]) + cells("c", [["시간", "내용"], ["9", "시작"]], nested=True) + cells("d", [["일시", '장소 "강당"'], ["5월", "x"]], {(1, 0): (1, 2)})
    df = spark.createDataFrame(rows, CELLS)
    keys = {r.table_id: r.structure_key for r in grids.structure_keys(df).collect()}
    head = {"headers": ["가;나", "다"], "cols": 2, "body_merges": [], "header_spans": [[0, 1, 1], [1, 1, 1]]}
    assert keys["a"] != keys["b"] and keys["a"] == hashlib.sha256(canonical(head).encode()).hexdigest()[:24]
    merged = {"headers": ["일시", '장소"강당"'], "cols": 3 - 1, "body_merges": [[0, 1, 2]], "header_spans": [[0, 1, 1], [1, 1, 1]]}
    assert keys["d"] == hashlib.sha256(canonical(merged).encode()).hexdigest()[:24]
    found = {r.table_id: r for r in grids.patterns(df).collect()}
    assert found["c"].layout == found["d"].layout == "scroll_table"
    shape = {"rows": 2, "cols": 2, "anchors": ["시간"], "spans": [[0, 0, 1, 1], [0, 1, 1, 1], [1, 0, 1, 1], [1, 1, 1, 1]], "uncertain": False}
    assert found["c"].pattern == hashlib.sha256(canonical(shape).encode()).hexdigest()
    family = {r.table_id: r.family for r in grids.families(df).collect()}
    want = {"headers": ["내용", "시간"], "roles": ["시간"], "units": ["시간"], "shape": [2, 2, 0], "nested": True}
    assert family["c"] == hashlib.sha256(canonical(want).encode()).hexdigest()[:24]


def test_reading_order_takes_layout_tables_apart():
    page = "<p>머리말</p><nav>메뉴</nav><table><tr><td>왼쪽<table><tr><th>일시<th>장소<tr><td>5월<td>강당</table>아래</td><td>오른쪽</td></tr></table><table><tr><td>한 줄<td>두 칸</table><ul><li>끝 <a href='/x'>파일</a></ul>"
    found = blocks.ordered(page)
    assert [(b["type"], b["text"]) for b in found] == [("paragraph", "머리말"), ("paragraph", "왼쪽"), ("table", "일시 장소 5월 강당"), ("paragraph", "아래"), ("paragraph", "오른쪽"), ("paragraph", "한 줄"), ("paragraph", "두 칸"), ("paragraph", "끝 파일 (/x)")]


def test_conversion_of_a_notice(spark):
    files = spark.createDataFrame([
        ("n", "body", "운동회 안내.hwp", "convert", "auto", None, False, False, "extracted"), ("n", "1", "신청서.hwp", "attachment", "auto", None, False, False, "extracted"), ("m", "1", "x.png", "convert", "mixed", None, False, True, "needs_vision"),
        ("o", "1", "동의서.hwp", "attachment", "auto", None, False, False, "extracted")], "notice_id string, file_id string, filename string, role string, scope string, form_start int, boundary_confirmed boolean, incomplete boolean, status string")
    flow = spark.createDataFrame([
        ("n", "body", 0, "paragraph", "행복 초등학교 가정 통신문", None), ("n", "body", 1, "paragraph", "운동회  안내", None), ("n", "body", 2, "paragraph", "※ ※", None), ("n", "body", 3, "table", "일시 5월 2일", "t1"), ("n", "body", 4, "paragraph", "참가 신청서", None),
        ("n", "body", 5, "paragraph", "이름", None)], "notice_id string, file_id string, place int, type string, text string, table_id string")
    tables = spark.createDataFrame([("t1", "key_value_cards", "k", False, True)], "table_id string, layout string, structure_key string, unfolded boolean, uncertain boolean")
    rules = spark.createDataFrame([("k", "timeline", "z")], "structure_key string, layout string, notice_id string")
    out, excluded, warnings = conversion.conversion(files, flow, tables, rules)
    assert [(r.place, r.placement, r.layout, r.rule_origin) for r in out.orderBy("place").collect()] == [(0, "source_info", None, None), (1, "title", None, None), (3, None, "timeline", "z")]
    assert sorted((r.place, r.reason) for r in excluded.collect()) == [(2, "decorative"), (4, "form"), (5, "form")]
    assert sorted((r.notice_id, r.code) for r in warnings.collect()) == [("m", "boundary"), ("m", "empty"), ("m", "incomplete"), ("m", "needs_vision"), ("n", "boundary"), ("n", "geometry"), ("o", "empty"), ("o", "no_guide")]


def test_pages_show_every_cell(spark):
    df = spark.createDataFrame([(*r[:-1],) for r in cells("t", [["학년", "날짜"], ["1학년", "<5월>"], ["2학년", "6월"]])], CELLS.rsplit(",", 1)[0])
    layouts = [("grade_cards", "<h4>1학년</h4>"), ("key_value_cards", '<div class="k">1학년</div>'), ("timeline", '<span class="when">1학년</span>'), ("read_only_form", "scroll"), ("unknown", pages.NO_LAYOUT)]
    for layout, mark in layouts:
        html = pages.as_layout(spark.createDataFrame([("t", layout), ("none", layout)], "table_id string, layout string"), df).collect()
        by = {r.table_id: r.html for r in html}
        assert mark in by["t"] and "&lt;5월&gt;" in by["t"] and "<5월>" not in by["t"] and pages.NO_TABLE in by["none"]


def test_case_gate_passes_short_text_only_for_approved(spark):
    files = spark.createDataFrame([
        ("n", "body", "s1", "convert", "candidate", False, ["rights_unreviewed"], "extracted", True, False, False, False), ("n", "1", "s2", "uncertain", "held", False, ["insufficient_text"], "extracted", True, False, False, False),
        ("n", "2", "s3", "convert", "candidate", False, [], "extracted", True, False, False, False)],
        "notice_id string, file_id string, sha256 string, effective_role string, effective_use string, overridden boolean, reasons array<string>, status string, parser_current boolean, incomplete boolean, privacy_flag boolean, evaluation boolean")
    cases = spark.createDataFrame([("a", "n", "body", False, "train"), ("b", "n", "s2", True, "train"), ("c", "n", "1", False, "train"), ("d", "n", "s3", True, "train"), ("e", "n", "body", True, "eval"), ("f", "x", "body", True, "train")], "case_id string, notice_id string, source string, approved boolean, split string")
    notices = spark.createDataFrame([("n", "candidate")], "notice_id string, use string")
    none, bad = spark.createDataFrame([], "notice_id string"), spark.createDataFrame([("s3",)], "sha256 string")
    got = lambda **k: sorted(r.case_id for r in corpus.allowed_cases(cases, files, notices, none, bad, **k).collect())
    assert got() == ["a", "b"] and got(candidates=True) == ["a", "b", "c"]


def test_learning_freezes_human_decisions(spark):
    shape = "case_id string, notice_id string, source string, table_index int, pattern string, layout string, method string, family string, split string, body string, privacy_flag boolean, merged boolean"
    row = lambda case, body, split="train": (case, "n", "body", 0, f"p-{body}", "timeline", "h", "f", split, body, False, False)
    stored = spark.createDataFrame([(*row("a", "old"), "p1", "approved"), (*row("b", "old"), "p1", "candidate"), (*row("c", "same"), "p2", "candidate"), (*row("d", "gone"), "p1", "candidate")], f"{shape}, parser string, review_status string")
    found = spark.createDataFrame([row("a", "new", "dev"), row("b", "new", "dev"), row("c", "same", "dev"), row("e", "fresh", "dev")], shape)
    got = {r.case_id: (r.body, r.split, r.parser, r.review_status) for r in curation.learned(stored, found, "p2").collect()}
    assert got == {"a": ("old", "train", "p1", "approved"), "b": ("new", "train", "p2", "candidate"), "c": ("same", "train", "p2", "candidate"), "d": ("gone", "train", "p1", "candidate"), "e": ("fresh", "dev", "p2", "candidate")}
