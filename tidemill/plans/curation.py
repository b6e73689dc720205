"""Case queries: documents play cases, their labels reviews, their sources and languages offices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions import ids, text
from tidemill.operators import curation
from tidemill.plans.accounting import SPLIT
from tidemill.plans.text import EDGE, NUMBERS
from tidemill.session import table


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a case of the family of its source, language and length; labelled ones are reviewed."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    family = F.sha2(F.concat_ws(":", "lang", "source", (F.col("n_chars") % 3).cast("string")), 256)
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("candidate")
    out = docs.select(
        F.col("doc_id").alias("case_id"), "lang", F.concat_ws("/", "source", "lang").alias("office"), family.alias("family"), status.alias("review_status"), (status == "approved").alias("approved"),
        F.coalesce("text", F.lit("")).alias("body"), (F.col("n_chars") % 5 == 0).alias("merged"), F.coalesce(text.has_pii(F.col("text")), F.lit(False)).alias("privacy_flag"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("corrected "), F.col("doc_id").cast("string"))).alias("correction"), F.concat_ws("-", "lang", F.lit("layout")).alias("layout"))
    return out.withColumn("split", ids.split_of(F.col("family")))


CASES = f"""docs AS (SELECT d.*, l.quality, sha256(concat_ws(':', lang, source, n_chars % 3)) AS family FROM documents d LEFT JOIN labels l USING (doc_id)),
cases AS (SELECT doc_id AS case_id, lang, source || '/' || lang AS office, family, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'candidate' END AS review_status, coalesce(quality = 1, false) AS approved,
  coalesce(text, '') AS body, n_chars % 5 = 0 AS merged, coalesce(regexp_matches(text, '(^|{EDGE}){NUMBERS}($|{EDGE})') OR regexp_matches(text, '{text.PII_MAIL}'), false) AS privacy_flag,
  CASE WHEN n_chars % 2 = 0 THEN 'corrected ' || doc_id END AS correction, lang || '-layout' AS layout, {SPLIT.format('family')} AS split FROM docs)"""


def allowed(spark, sf_dir):
    return cases(spark, sf_dir).filter("not privacy_flag").select("case_id")


def review_queue(spark, sf_dir):
    found = curation.review_queue(cases(spark, sf_dir))
    return found.withColumn("reasons", F.array_join("reasons", ","))


#: Each term is a row of its own here; points and reasons are summed up over them.
REVIEW_QUEUE_SQL = f"""
WITH {CASES},
fam AS (SELECT family, count(*) FILTER (WHERE approved) AS n FROM cases GROUP BY family),
off AS (SELECT office, count(*) AS n FROM cases GROUP BY office),
open AS (FROM cases WHERE review_status = 'candidate' AND split <> 'eval'),
terms AS (
  SELECT case_id, 0 AS i, 100 AS points, '신규 양식' AS reason FROM open JOIN fam USING (family) WHERE n = 0
  UNION ALL SELECT case_id, 1, 50, '승인 사례 부족' FROM open JOIN fam USING (family) WHERE n IN (1, 2)
  UNION ALL SELECT case_id, 2, 40, '날짜·금액·대상 확인 필요' FROM open WHERE regexp_matches(body, '20[0-9][0-9]|[0-9]{{1,2}}월|[0-9]{{1,2}}일|[0-9,]+\\s*원|[0-9]+\\s*명|무료|유료|제외|마감|기한|동의|서명')
  UNION ALL SELECT case_id, 3, 30, '병합 셀' FROM open WHERE merged
  UNION ALL SELECT case_id, 4, 20, '부족 지역' FROM open WHERE office IN (SELECT office FROM off WHERE n < 5)
  UNION ALL SELECT case_id, 5, 10, '개인정보 검토' FROM open WHERE privacy_flag),
scores AS (SELECT case_id, CAST(sum(points) AS BIGINT) AS score, string_agg(reason, ',' ORDER BY i) AS reasons FROM terms GROUP BY case_id)
SELECT case_id, family, office, coalesce(score, 0) AS score, coalesce(reasons, '') AS reasons
FROM open LEFT JOIN scores USING (case_id) ORDER BY score DESC, case_id LIMIT 20
"""


def _events(spark, sf_dir):
    """Turns as review events; every seventh conversation is no known case."""
    t = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return t.select(
        F.col("conv_id").alias("case_id"), "turn", F.when(n % 11 == 0, "done").when(F.col("role") == "user", "candidate").when(n % 3 == 0, "held").otherwise("approved").alias("status"),
        F.when(n % 2 == 0, "timeline").when(n % 13 == 0, "other").alias("layout"), F.when(n % 7 == 0, " ").otherwise(F.concat(F.col("role"), F.lit(" "))).alias("reviewer"),
        (n % 5 != 0).alias("rights_reviewed"), (n % 17 != 0).alias("privacy_reviewed"), F.col("text").alias("note"), F.when(n % 3 == 1, F.sha2("text", 256)).alias("correction"))


EVENTS = """e AS (SELECT conv_id AS case_id, turn, CASE WHEN length(text) % 11 = 0 THEN 'done' WHEN role = 'user' THEN 'candidate' WHEN length(text) % 3 = 0 THEN 'held' ELSE 'approved' END AS status,
  CASE WHEN length(text) % 2 = 0 THEN 'timeline' WHEN length(text) % 13 = 0 THEN 'other' END AS layout, CASE WHEN length(text) % 7 = 0 THEN '' ELSE role END AS reviewer,
  length(text) % 5 <> 0 AND length(text) % 17 <> 0 AS sure, text, CASE WHEN length(text) % 3 = 1 THEN sha256(text) END AS correction FROM conversations),
v AS (SELECT *, CASE WHEN status = 'done' THEN 'unknown_status' WHEN case_id % 7 = 0 THEN 'unknown_case' WHEN status = 'approved' AND (layout IS DISTINCT FROM 'timeline' OR reviewer = '') THEN 'layout_or_reviewer'
  WHEN status = 'approved' AND NOT sure THEN 'unconfirmed' ELSE 'accepted' END AS verdict FROM e)"""


def _known(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id")).distinct().filter("case_id % 7 <> 0")


def review_verdicts(spark, sf_dir):
    return curation.reviewed(_events(spark, sf_dir), _known(spark, sf_dir), ["turn"])[0].select("case_id", "turn", "verdict")


def review_states(spark, sf_dir):
    found = curation.reviewed(_events(spark, sf_dir), _known(spark, sf_dir), ["turn"])[1]
    return found.withColumn("last_note", F.sha2("last_note", 256))


def review_actor(spark, sf_dir):
    """Turns as decisions: assistants come by the interface, users by a browser, others by the console."""
    t = table(spark, sf_dir, "conversations")
    channel = F.when(F.col("role") == "assistant", "api").when(F.col("role") == "user", "browser").otherwise("console")
    quick = F.col("turn") % 2 == 0
    implied, note = curation.quick_approval(channel, quick)
    login = F.when(F.col("conv_id") % 5 == 0, " ").otherwise(F.concat(F.lit("user"), F.col("conv_id").cast("string")))
    return t.select("conv_id", "turn", curation.actor(channel, login, F.lit("someone else")).alias("actor"), implied.alias("implied"), note.alias("note"))


def learned_cases(spark, sf_dir):
    """Documents as stored cases; of those whose id is no multiple of nine a run finds some with another text or none stored."""
    own = cases(spark, sf_dir).withColumns({"notice_id": F.col("case_id"), "source": F.lit("body"), "table_index": F.lit(0), "pattern": F.sha2("body", 256), "method": F.lit("heuristic")})
    names = ["case_id", "notice_id", "source", "table_index", "pattern", "layout", "method", "family", "split", "body", "privacy_flag", "merged"]
    i = F.col("case_id")
    stored = own.filter(i % 4 != 0).select(*names, F.when(i % 3 == 0, "p1").otherwise("p2").alias("parser"), "review_status")
    found = own.filter(i % 9 != 0).withColumns({"body": F.when(i % 5 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")), "pattern": F.lit("new"), "split": F.lit("dev")}).select(*names)
    return curation.learned(stored, found, "p2").select("case_id", "pattern", "split", F.sha2("body", 256).alias("body"), "parser", "review_status")


LEARNED_SQL = f"""WITH {CASES}, s AS (FROM cases WHERE case_id % 4 <> 0), f AS (FROM cases WHERE case_id % 9 <> 0)
SELECT case_id, 'new' AS pattern, 'dev' AS split, sha256(body || CASE WHEN case_id % 5 = 0 THEN '!' ELSE '' END) AS body, 'p2' AS parser, 'candidate' AS review_status FROM f WHERE case_id NOT IN (SELECT case_id FROM s)
UNION ALL
SELECT case_id, CASE WHEN anew THEN 'new' ELSE sha256(body) END, split, sha256(body || CASE WHEN anew AND case_id % 5 = 0 THEN '!' ELSE '' END), CASE WHEN anew OR case_id % 3 <> 0 THEN 'p2' ELSE 'p1' END, review_status
FROM (SELECT *, review_status = 'candidate' AND case_id % 9 <> 0 AND (case_id % 3 = 0 OR case_id % 5 = 0) AS anew FROM s)"""


def notice_state(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    results = li.select(F.col("l_orderkey").alias("notice_id"), F.when(F.col("l_returnflag") == "R", "needs_parser").otherwise("extracted").alias("status"), (F.col("l_suppkey") % 3 == 0).cast("int").alias("tables"))
    return curation.notice_state(results)


def cases_export(spark, sf_dir):
    own, gate = cases(spark, sf_dir), allowed(spark, sf_dir)
    return curation.export_approved(own, gate).withColumns({"table": F.sha2("table", 256), "extracted_table": F.sha2("extracted_table", 256)})


def candidates_export(spark, sf_dir):
    return curation.export_candidates(cases(spark, sf_dir), allowed(spark, sf_dir)).withColumn("table", F.sha2("table", 256))


def gated_search(spark, sf_dir):
    return curation.search(cases(spark, sf_dir), allowed(spark, sf_dir), "The And").withColumn("table", F.sha2("table", 256))


def unreviewed(spark, sf_dir):
    """All unreviewed candidates, the first two hundred by id."""
    return cases(spark, sf_dir).filter("review_status = 'candidate' AND split <> 'eval'").orderBy("case_id").limit(200).select("case_id", "family")


def case_totals(spark, sf_dir):
    """Counts of the status page in one pass."""
    one = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")
    return cases(spark, sf_dir).agg(
        F.count("*").alias("cases"), one(F.col("approved")).alias("approved"), one(F.col("review_status") == "candidate").alias("pending"), F.count_distinct("office").alias("offices"), one(F.col("privacy_flag")).alias("private"))


PLANS = {
    "review_queue": (review_queue, REVIEW_QUEUE_SQL),
    "review_verdicts": (review_verdicts, f"WITH {EVENTS} SELECT case_id, turn, verdict FROM v"),
    "review_states": (review_states, f"""WITH {EVENTS} SELECT case_id, arg_max(status, turn) AS status, arg_max(layout, turn) FILTER (WHERE layout IS NOT NULL) AS layout, arg_max(correction, turn) FILTER (WHERE correction IS NOT NULL) AS correction,
  arg_max(reviewer, turn) AS reviewer, count(*) AS history, sha256(arg_max(text, turn)[1:500]) AS last_note, arg_max(status, turn) = 'approved' AS approved FROM v WHERE verdict = 'accepted' GROUP BY case_id"""),
    "review_actor": (review_actor, """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'api' WHEN 'user' THEN CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'user' || conv_id END ELSE 'someone else' END AS actor,
  role = 'user' AND turn % 2 = 0 AS implied, CASE WHEN role = 'user' AND turn % 2 = 0 THEN '빠른 승인: 원문 대조·이용 권한·개인정보 확인' END AS note FROM conversations"""),
    "learned_cases": (learned_cases, LEARNED_SQL),
    "notice_state": (notice_state, """WITH n AS (SELECT l_orderkey AS notice_id, count(*) FILTER (WHERE l_returnflag = 'R') AS bad, CAST(count(*) FILTER (WHERE l_suppkey % 3 = 0) AS BIGINT) AS tables FROM lineitem GROUP BY 1)
SELECT notice_id, CASE WHEN bad = 0 THEN 'extracted' ELSE 'partial' END AS analysis_status, tables, CASE WHEN tables > 0 THEN 'has_table' WHEN bad = 0 THEN 'no_table' ELSE 'pending' END AS table_state FROM n"""),
    "cases_export": (cases_export, f"WITH {CASES} SELECT case_id, split, layout, sha256(coalesce(correction, body)) AS \"table\", CASE WHEN correction IS NOT NULL THEN sha256(body) END AS extracted_table FROM cases WHERE approved AND split <> 'eval' AND NOT privacy_flag"),
    "candidates_export": (candidates_export, f"WITH {CASES} SELECT case_id, split, sha256(body) AS \"table\", 'unreviewed_not_training_input' AS learning_permission FROM cases WHERE NOT approved AND split <> 'eval' AND NOT privacy_flag"),
    "gated_search": (gated_search, f"""WITH {CASES}, t AS (FROM cases WHERE approved AND split <> 'eval' AND lower(body || coalesce(correction, '')) LIKE '%the and%' ORDER BY case_id LIMIT 20)
SELECT case_id, split, sha256(coalesce(correction, body)) AS "table" FROM t WHERE NOT privacy_flag"""),
    "unreviewed": (unreviewed, f"WITH {CASES} SELECT case_id, family FROM cases WHERE review_status = 'candidate' AND split <> 'eval' ORDER BY case_id LIMIT 200"),
    "case_totals": (case_totals, f"WITH {CASES} SELECT count(*) AS cases, count(*) FILTER (WHERE approved) AS approved, count(*) FILTER (WHERE review_status = 'candidate') AS pending, count(DISTINCT office) AS offices, count(*) FILTER (WHERE privacy_flag) AS private FROM cases"),
}
