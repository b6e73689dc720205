import pytest
from pyspark.sql import functions as F

from tidemill.operators import rules

FILES = "name string, filename string, text string, kind string, status string, parser_current boolean, evaluation boolean, incomplete boolean, privacy_flag boolean, rights_denied boolean, unrelated boolean"
GUIDE = "운동회 안내 말씀을 드립니다. 5월 2일 운동장."
FORM = "희망 신청서\n성명: ___ 보호자: ___ 서명"


def row(name, filename="a.html", text=GUIDE, kind="html", status="extracted", **flags):
    keys = ("parser_current", "evaluation", "incomplete", "privacy_flag", "rights_denied", "unrelated")
    return (name, filename, text, kind, status, *[flags.get(k, True if k == "parser_current" else None) for k in keys])


CASES = [
    (row("guide"), "guide", "convert", "candidate", ["rights_unreviewed"]),
    (row("form by name", "체험 신청서.hwp"), "form", "attachment", "attachment", ["original_form"]),
    (row("both by name", "안내 및 동의서.hwp"), "mixed", "convert", "held", ["boundary_unconfirmed"]),
    (row("both by text", text=GUIDE + "\n" + FORM), "mixed", "convert", "held", ["boundary_unconfirmed"]),
    (row("form by text", text=FORM), "form", "attachment", "attachment", ["original_form"]),
    (row("mention in a sentence", text="신청서를 작성하여 기한 안에 학교로 보내 주시기 바랍니다 ___ ___"), "guide", "convert", "candidate", ["rights_unreviewed"]),
    (row("reference", "급식 참고자료.pdf", kind="pdf"), "reference", "attachment", "attachment", ["original_reference"]),
    (row("thin", text=" 짧음　\n"), "unknown", "uncertain", "held", ["insufficient_text"]),
    (row("image", kind="image", status="needs_vision"), "guide", "convert", "held", ["status_unusable", "needs_vision"]),
    (row("many holds", kind="zip", parser_current=False, incomplete=True, privacy_flag=True), "guide", "convert", "held", ["parser_stale", "incomplete", "privacy_review", "needs_parser"]),
    (row("evaluation first", evaluation=True, rights_denied=True, status="missing"), "guide", "convert", "evaluation", ["evaluation"]),
    (row("excluded", unrelated=True, status="missing"), "guide", "convert", "excluded", ["unrelated"]),
    (row("missing original", "양식.hwp", status="missing"), "form", "attachment", "held", ["original_form", "original_missing"]),
    (row("nothing known", None, None, None, None, parser_current=None), "unknown", "uncertain", "held", ["insufficient_text", "status_unusable", "needs_parser"]),
]


def test_classification_matrix(spark):
    files = spark.createDataFrame([c[0] for c in CASES], FILES)
    files = files.withColumn("content_kind", rules.content_kind(F.col("filename"), F.col("text")))
    found = {r["name"]: (r["content_kind"], r["role"], r["use"], r["reasons"]) for r in rules.classify(files).collect()}
    assert found == {c[0][0]: tuple(c[1:]) for c in CASES}


@pytest.mark.parametrize("files,use", [
    ([("convert", "candidate"), ("attachment", "excluded")], "candidate"), ([("convert", "excluded"), ("convert", "candidate")], "excluded"),
    ([("uncertain", "excluded"), ("convert", "evaluation")], "evaluation"), ([("uncertain", "attachment"), ("convert", "candidate")], "held"),
    ([("attachment", "attachment")], "attachment"), ([("attachment", "excluded")], "held"),
])
def test_notice_use(spark, files, use):
    rows = spark.createDataFrame([("n", *f) for f in files], "notice_id string, role string, use string")
    assert rules.notice_use(rows).first()["use"] == use


def test_reserved_content_never_leaks(spark):
    rows = [("n1", "a", "s1", "convert", "candidate"), ("n2", "a", "s1", "convert", "candidate"), ("n3", "a", "s2", "convert", "candidate"), ("n4", "a", "s1", "convert", "evaluation")]
    files = spark.createDataFrame(rows, "notice_id string, file_id string, sha256 string, role string, use string").withColumns({"reasons": F.array(F.lit("rights_unreviewed")), "status": F.lit("extracted")})
    reserved = rules.reserved_files(files, spark.createDataFrame([("n1", "a", "evaluation"), ("n3", "a", "held")], "notice_id string, file_id string, use string"))
    assert sorted(r.notice_id for r in rules.leaked(files, reserved).collect()) == ["n1", "n2"]
    assert [r.notice_id for r in rules.allowed_notices(files, reserved).collect()] == ["n3"]


def test_review_history(spark):
    rows = [("c", 1, "approved", "x", "timeline"), ("c", 2, "held", None, None), ("c", 3, "candidate", None, None), ("c", 4, "rejected", None, None), ("d", 1, "candidate", None, None), ("d", 2, "approved", None, "grade_cards")]
    found = {r.case_id: r for r in rules.fold_reviews(spark.createDataFrame(rows, "case_id string, seq int, status string, correction string, layout string"), ["seq"]).collect()}
    assert (found["c"].status, found["c"].correction, found["c"].layout, found["c"].history, found["c"].approved) == ("rejected", "x", "timeline", 4, False)
    assert found["d"].approved


def test_rules_are_revoked_and_suggestions_need_one_layout(spark):
    shape = "notice_id long, structure_key string, layout string, state string, revision int, approved_revision int, split string, at int"
    rows = [(1, "k", "timeline", "approved", 1, 1, "train", 1), (2, "k", "grade_cards", "approved", 2, 1, "train", 2), (3, "k", "scroll_table", "approved", 1, 1, "eval", 3), (4, "", "timeline", "approved", 1, 1, "train", 1)]
    assert [(r.structure_key, r.layout) for r in rules.approved_rules(spark.createDataFrame(rows, shape), ["at", "notice_id"]).collect()] == [("k", "timeline")]
    tables = spark.createDataFrame([("p",), ("q",), ("r",)], "pattern string")
    approved = spark.createDataFrame([("p", "timeline"), ("p", "timeline"), ("q", "timeline"), ("q", "grade_cards")], "pattern string, layout string")
    assert {r.pattern: r.suggested for r in rules.suggestions(tables, approved).collect()} == {"p": "timeline", "q": None, "r": None}


def test_decisions(spark):
    current = spark.createDataFrame([("n", "f", "v2", "extracted", "html", False, True)], "notice_id string, file_id string, fingerprint string, status string, kind string, evaluation boolean, privacy_flag boolean")
    shape = "notice_id string, file_id string, seen_fingerprint string, new_role string, new_use string, reviewer string, note string, privacy_checked boolean"
    for wanted, verdict in [
        (("v1", "convert", "held", "r", "", False), "stale"), (("v2", "attachment", "candidate", "r", "", False), "role_mismatch"), (("v2", "convert", "candidate", " ", "", False), "malformed"),
        (("v2", "convert", "candidate", "r", " ", True), "privacy_note"), (("v2", "convert", "candidate", "r", "checked", True), "accepted"),
    ]:
        assert rules.check_decisions(spark.createDataFrame([("n", "f", *wanted)], shape), current).first().verdict == verdict
