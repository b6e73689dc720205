from pyspark.sql import functions as F

from tidemill.functions import ids, text, urls
from tidemill.operators import grids, identity, queue
from tidemill.sources import files, html
from tidemill.streaming.queue import advance

CELLS = "table_id string, row int, col int, rowspan int, colspan int, text string, header boolean"


def cells(spark, name, rows, spans={}):
    return spark.createDataFrame([(name, r, c, *spans.get((r, c), (1, 1)), t, r == 0) for r, row in enumerate(rows) for c, t in enumerate(row) if t is not None], CELLS)


def test_layouts_and_families(spark):
    tables = {
        "form": [["보호자", "서명"], ["", ""]], "grade": [["학년", "날"], ["1", "2"]], "time": [["시간", "내용"], ["1", "2"]], "keys": [["일시", "5월 2일"], ["장소", "강당"]],
        "keys2": [["일시", "6월 9일"], ["장소", "교정"]], "plain": [["가", "나"], ["1", "2"]],
    }
    all_ = None
    for name, rows in tables.items():
        part = cells(spark, name, rows)
        all_ = part if all_ is None else all_.unionByName(part)
    all_ = all_.unionByName(cells(spark, "merged", [["시간", None], ["1", "2"]], {(0, 0): (1, 2)}))
    layouts = {r.table_id: r.layout for r in grids.patterns(all_).collect()}
    assert layouts == {"form": "read_only_form", "grade": "grade_cards", "time": "timeline", "keys": "key_value_cards", "keys2": "key_value_cards", "plain": "scroll_table", "merged": "scroll_table"}
    family = {r.table_id: r.family for r in grids.families(all_).collect()}
    assert family["keys"] != family["plain"] and family["time"] != family["grade"]
    keys = {r.table_id: r.structure_key for r in grids.structure_keys(all_.unionByName(cells(spark, "numbers", [["1", "2"], ["3", "4"]]))).collect()}
    assert keys["numbers"] == "" and keys["keys"] == keys["keys2"] and len(set(keys.values())) == 7


def test_repeated_columns(spark):
    rows = [["연번", "학과", "교실"] * 2] + [[str(i + 1), f"과{i}", "101", str(i + 10), f"과{i}", "102"] if i < 8 else ["9", "과", "103", "", "", ""] for i in range(9)]
    good = cells(spark, "t", rows)
    found = grids.unfolded(good).orderBy("number").collect()
    assert [r.number for r in found] == list(range(1, 18))
    rows[2][0] = "x"
    assert grids.unfolded(cells(spark, "t", rows)).count() == 0
    assert grids.unfolded(cells(spark, "t", [["연번", "학과", "교실", "연번", "학과", "장소"], ["1", "a", "b", "2", "c", "d"]])).count() == 0


def test_html_grid_shifts_under_rowspans_and_survives_missing_ends():
    page = html.parse("<body><p>안내<script>x</script><table><tr><td rowspan=2>가<td>나<tr><td>다</table><a href='/x'>첨부 <b>파일</b></a>")
    assert [(c["row"], c["col"], c["text"]) for c in page["tables"][0]["cells"]] == [(0, 0, "가"), (0, 1, "나"), (1, 1, "다")]
    assert page["paragraphs"][0] == "안내" and page["links"][0]["label"] == "첨부 파일" and page["paragraphs"][-1] == "첨부 파일 (/x)"
    assert html.parse("<table><tr><td rowspan=999>a</table>")["status"] == "parse_error"


def test_packages(spark):
    import io
    import zipfile

    def packed(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
        return out.getvalue()

    section = "<s><t>머리</t><tbl><tr><tc><cellAddr rowAddr='0' colAddr='0'/><cellSpan rowSpan='1' colSpan='2'/><t>제목</t></tc></tr></tbl></s>"
    word = "<w:document xmlns:w='u'><w:body><w:p><w:r><w:t>앞</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr><w:p><w:r><w:t>가</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>"
    rows = [(1, packed(Contents__section0_xml=section), "a.hwpx"), (2, packed(word__document_xml=word), "b.docx"), (3, packed(Contents__section0_xml="<!DOCTYPE x><s/>"), "c.hwpx"), (4, b"%PDF-1.7", "d.pdf"), (5, b"  <HTML><p>x", "e.html"), (6, b"", None)]
    found = {r.id: r for r in files.extract(spark.createDataFrame(rows, "id int, content binary, filename string")).collect()}
    assert [(found[i].kind, found[i].status) for i in range(1, 7)] == [("hwpx", "extracted"), ("docx", "extracted"), ("hwpx", "parse_error"), ("pdf", "needs_parser"), ("html", "extracted"), ("unsupported", "needs_parser")]
    assert found[1].tables[0].cells[0].colspan == 2 and found[1].paragraphs == ["머리"]
    assert [(c.row, c.col, c.rowspan) for c in found[2].tables[0].cells] == [(0, 0, 2), (0, 1, 1), (1, 1, 1)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(urls.canonical(F.lit("HTTP://a.b/"))) is None and one(urls.canonical(F.lit("http://u@a.b/"))) is None
    assert one(urls.canonical(F.lit(" https://A.B:443/x;jsessionid=1?b=2&a=&utm_x=1&fbclid=3#f "))) == "https://a.b/x?a=&b=2"
    assert one(urls.canonical(F.lit("http://a.b:443"))) == "http://a.b:443/" and one(urls.canonical(F.lit("http://a.b:8080/"))) is None
    assert one(urls.redirects(F.lit("<script>location.href='/a'</script><meta http-equiv=refresh content='0; url=https://b/c'>"))) == ["https://b/c", "/a"]
    assert one(text.mask_pii(F.lit("전화 010-1234-5678, é.a@b.co"))) == f"전화 {text.PII_MARK}, {text.PII_MARK}"
    assert one(text.last_date(F.lit("2024.3.1 ~ 2024-03-9"))).isoformat() == "2024-03-09" and one(text.last_date(F.lit("2024.13.1"))) is None
    assert one(text.attachment_name(F.lit(" "), F.lit("https://a/b.hwp?x"))) == "b.hwp" and one(text.attachment_name(F.lit(""), F.lit("https://a/"))) == "attachment"
    assert one(ids.quota(F.lit("B10"), F.lit(""))) == one(ids.quota(F.lit("x"), F.lit("경기도"))) == 50 and one(ids.quota(F.lit("x"), F.lit("y"))) == 20
    assert one(grids.span(F.lit(""))) == 1 and one(grids.span(F.lit("201"))) is None
    assert files.robots_allow(404, "", "b", "/x") and not files.robots_allow(403, "", "b", "/x") and not files.robots_allow(200, "User-agent: *\nDisallow: /x", "b", "http://a/x")


def test_notice_identity(spark):
    import hashlib
    import json

    rows = spark.createDataFrame([(' 제목 "a" ', "<p>1</p>\n <p>2</p>", ["b", "a", "b"])], "t string, h string, s array<string>")
    want = hashlib.sha256(json.dumps({"title": '제목 "a"', "html": "<p>1</p><p>2</p>", "assets": ["a", "b"]}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert rows.select(ids.notice_key(F.col("t"), F.col("h"), F.col("s")).alias("x")).first().x == want
    chain = identity.version_chain(spark.createDataFrame([(1, "a", "u"), (2, "a", "v"), (3, "b", "u")], "seq int, id string, url string")).collect()
    assert [(r.id, r.previous_version) for r in sorted(chain, key=lambda r: r.seq)] == [("a", None), ("b", "a")]


def test_queue_fold_and_stream_agree(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from tidemill.streaming.queue import job_states

    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(rng.randrange(12), start + timedelta(minutes=rng.randrange(600)), i, rng.choice(("enqueue", "claim", "claim", "finish", "fail", "heartbeat"))) for i in range(600)]
    rows.sort(key=lambda r: (r[1], r[2]))
    shape = "job bigint, at timestamp, seq bigint, kind string"
    batch = {r.job: (r.status, r.attempts) for r in queue.fold(spark.createDataFrame(rows, shape)).collect()}
    plain = {}
    for job, at, _, kind in rows:
        plain[job] = advance(plain.get(job, ("none", 0, datetime(1970, 1, 1), False)), kind, at)
    assert batch == {job: state[:2] for job, state in plain.items()}
    for i in range(3):
        spark.createDataFrame(rows[i * 200 : (i + 1) * 200], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    got = {}
    stream = job_states(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: got.update({r.job: (r.status, r.attempts) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    # A claim that was stale when the stream had come to its end was given back by its timer, without an event.
    end = max(at for _, at, _, _ in rows) - timedelta(minutes=10)
    since = {job: state[2] for job, state in plain.items()}
    want = {job: ("pending", n) if status == "running" and since[job] + timedelta(minutes=30) <= end else (status, n) for job, (status, n) in batch.items()}
    assert got == want
