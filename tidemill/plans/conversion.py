"""Conversion queries: documents play files, their lines blocks, their sources and languages notices, turns of talk decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemill.functions import ids
from tidemill.operators import conversion
from tidemill.plans.accounting import SPLIT
from tidemill.session import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang").alias("notice_id"), F.col("doc_id").alias("file_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".hwp")).alias("filename"),
        F.when(F.col("lang") == "fr", "attachment").when(F.col("doc_id") % 5 == 0, "attachment").otherwise("convert").alias("role"), F.when(F.col("doc_id") % 7 == 0, "mixed").when(F.col("doc_id") % 7 == 1, "notice").otherwise("auto").alias("scope"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(4)).alias("form_start"), (F.col("doc_id") % 2 == 0).alias("boundary_confirmed"), (F.col("doc_id") % 17 == 0).alias("incomplete"), F.when(F.col("doc_id") % 19 == 0, "needs_vision").otherwise("extracted").alias("status"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    p, odd = F.col("place"), F.col("doc_id") % 4 == 0
    line = (
        F.when(odd & (p == 0), "가정 통신문 제1호").when(odd & (p == 1), F.concat(F.lit("doc  "), F.col("doc_id").cast("string"))).when((F.col("doc_id") + p * 3) % 31 == 7, "2026 희망 신청서 ")
        .when((F.col("doc_id") + p) % 37 == 3, "· ㆍ ·").when((p % 9 == 8) & (F.col("doc_id") % 3 == 0), "지원자 성명 서명").otherwise(F.col("line")))
    kind = F.when(p % 9 == 8, "table").otherwise("paragraph")
    return rows.select(F.concat_ws("/", "source", "lang").alias("notice_id"), F.col("doc_id").alias("file_id"), "place", kind.alias("type"), line.alias("text"), F.when(p % 9 == 8, F.concat_ws(":", "doc_id", "place")).alias("table_id"))


def tables(flow_: DataFrame) -> DataFrame:
    n, p = F.col("file_id"), F.col("place")
    return flow_.filter("type = 'table'").select("table_id", F.when(n % 2 == 0, "timeline").otherwise("scroll_table").alias("layout"), F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("k"), ((n + p) % 15).cast("string"))).alias("structure_key"),
                                                 (n % 6 == 1).alias("unfolded"), (n % 8 == 3).alias("uncertain"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.filter("n_nationkey < 12").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("structure_key"), F.lit("key_value_cards").alias("layout"), F.concat(F.lit("src"), F.col("n_nationkey").cast("string"), F.lit("/en")).alias("notice_id"))


FLOW = """raw AS (SELECT source || '/' || lang AS notice_id, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS place FROM documents),
flow AS (SELECT notice_id, doc_id, place, place % 9 = 8 AS tab, CASE WHEN doc_id % 4 = 0 AND place = 0 THEN '가정 통신문 제1호' WHEN doc_id % 4 = 0 AND place = 1 THEN 'doc  ' || doc_id WHEN (doc_id + place * 3) % 31 = 7 THEN '2026 희망 신청서 '
  WHEN (doc_id + place) % 37 = 3 THEN '· ㆍ ·' WHEN place % 9 = 8 AND doc_id % 3 = 0 THEN '지원자 성명 서명' ELSE line END AS text FROM raw WHERE NOT split_part(notice_id, '/', 2) = 'fr' AND doc_id % 5 <> 0),
full_ AS (FROM flow WHERE regexp_matches(text, '[^\\s\\p{Z}]')),
shown AS (SELECT *, regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') = 'doc' || doc_id AND NOT tab AS named,
  CASE WHEN tab THEN text = '지원자 성명 서명' ELSE regexp_matches(trim(text), '^([\\p{L}\\p{N}_ ·ㆍ:()\\-]{0,70})?(희망 신청서|희망신청서|참가 신청서|참가신청서|동의서|신청서)\\s*$') END AS form
  FROM full_ WHERE tab OR regexp_matches(text, '[\\p{L}\\p{N}_]')),
edge AS (SELECT doc_id, min(place) FILTER (WHERE form) AS form_at, min(place) FILTER (WHERE named) AS title_at FROM shown GROUP BY doc_id),
head AS (SELECT doc_id, coalesce(bool_and(NOT tab AND length(text) < 150) FILTER (WHERE place < title_at), false) AND coalesce(bool_or(contains(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'), '가정통신문')) FILTER (WHERE place < title_at), false) AS mast FROM shown JOIN edge USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, title_at, mast, CASE WHEN doc_id % 13 = 0 THEN 4 WHEN doc_id % 7 <> 1 THEN form_at END AS start FROM edge JOIN head USING (doc_id)),
kept AS (SELECT s.*, c.title_at, c.mast FROM shown s JOIN cut c USING (doc_id) WHERE start IS NULL OR place < start),
r AS (SELECT 'k' || n_nationkey AS k, 'src' || n_nationkey || '/en' AS origin FROM nation WHERE n_nationkey < 12)"""


def _all(spark, sf_dir):
    own = flow(spark, sf_dir)
    return conversion.conversion(files(spark, sf_dir), own, tables(own), rules(spark, sf_dir))


def conversion_blocks(spark, sf_dir):
    return _all(spark, sf_dir)[0].select("notice_id", "block_id", "type", F.sha2("text", 256).alias("text"), "placement", "layout", "method")


def conversion_excluded(spark, sf_dir):
    return _all(spark, sf_dir)[1]


def conversion_warnings(spark, sf_dir):
    return _all(spark, sf_dir)[2]


def register_collected(spark, sf_dir):
    """Orders as collected notices, their lines as assets; every fourth is registered already."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.struct(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"),
        F.when(F.col("l_suppkey") % 3 == 0, "신청서.hwp").otherwise("안내.hwp").alias("filename"), F.when(F.col("l_suppkey") % 2 == 0, "hwp").alias("kind")).alias("a"))
    assets = F.transform(F.array_sort(F.collect_list("a")), lambda a: F.struct(a["sha256"], a["filename"], a["kind"]))
    notices = li.groupBy("notice_id").agg(assets.alias("assets")).withColumn("body", F.when(F.col("notice_id") % 3 == 0, " ").otherwise(F.concat(F.lit("<p>"), F.col("notice_id").cast("string"))))
    stored = notices.filter("notice_id % 4 = 0").select(F.col("notice_id").alias("origin"), F.lit("old").alias("mobile_id"), F.array().cast(f"array<{conversion.FILE}>").alias("files"), F.lit("train").alias("split"))
    found = conversion.registered(notices, stored, notices.filter("notice_id % 6 = 0").select("notice_id"))
    return found.select("origin", "mobile_id", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["file_id"], f["kind"], f["role"], F.substring(f["sha256"], 1, 6))), ",").alias("files"), "split")


def file_roles(spark, sf_dir):
    own = files(spark, sf_dir)
    edits = own.filter("file_id % 3 <> 0").select(
        "notice_id", "file_id", F.when(F.col("file_id") % 11 == 0, "other").when(F.col("file_id") % 11 == 1, "attachment").alias("role"), F.when(F.col("file_id") % 23 == 0, "all").alias("scope"),
        F.when(F.col("file_id") % 4 == 0, "").when(F.col("file_id") % 4 == 1, (F.col("file_id") * 2).cast("string")).when(F.col("file_id") % 4 == 2, "x").alias("form_start"), (F.col("file_id") % 2 == 0).alias("boundary_confirmed"), F.lit(None).cast("boolean").alias("incomplete"))
    return conversion.file_roles(own, edits).select("file_id", "role", "scope", F.col("form_start").cast("bigint").alias("form_start"), "boundary_confirmed", "incomplete", "error")


def add_attachments(spark, sf_dir):
    """Orders as notices, their lines as uploads."""
    li = table(spark, sf_dir, "lineitem")
    uploads = li.select(F.col("l_orderkey").alias("mobile_id"), F.when(F.col("l_orderkey") % 5 == 0, "old").otherwise("r1").alias("seen_revision"), F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"),
                        F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), F.lit("a.pdf").alias("filename"), F.lit("pdf").alias("kind"), (F.col("l_quantity") * 300_000).cast("bigint").alias("size"),
                        F.when(F.col("l_suppkey") % 50 == 7, "content_mismatch").alias("error"))
    notices = li.select(F.col("l_orderkey").alias("mobile_id")).distinct().select("mobile_id", F.lit("r1").alias("latest_revision"), F.when(F.col("mobile_id") % 9 == 0, "processing").otherwise("candidate").alias("state"), F.array().cast(f"array<{conversion.FILE}>").alias("files"))
    return conversion.attached(notices, uploads).select("mobile_id", "verdict", F.size("files").cast("bigint").alias("files"))


def blocks_error(spark, sf_dir):
    """Orders as revisions, their lines as table blocks of one or two cells."""
    li = table(spark, sf_dir, "lineitem")
    place = F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    blocks = li.select(o.alias("revision_id"), place.alias("place"), F.when(s % 40 == 0, "image").when(s % 40 < 9, "paragraph").otherwise("table").alias("type"), F.when(s % 40 != 3, "x").alias("text"), F.when(s % 97 == 11, "cards").otherwise("timeline").alias("layout"), F.when(s % 89 == 13, 0).otherwise(2).alias("rows"), F.lit(2).alias("cols"))
    cells = li.filter("l_suppkey % 40 >= 9").select(o.alias("revision_id"), place.alias("place"), F.explode(F.array(
        F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("rowspan"), F.when(s % 31 == 2, 2).otherwise(1).alias("colspan"), F.lit("a").alias("text")),
        F.struct(F.lit(0).alias("row"), F.lit(1).alias("col"), F.when(s % 29 == 3, 3).otherwise(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit("b").alias("text")))).alias("c")).select("revision_id", "place", "c.*")
    return conversion.blocks_error(blocks, cells)


def _notices(spark, sf_dir):
    """Conversations as notices: the last turn names the latest revision."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    m = F.col("conv_id")
    return last.select(m.alias("mobile_id"), F.concat(F.lit("r"), F.col("t").cast("string")).alias("latest_revision"), F.when(m % 8 == 0, "processing").when(m % 8 < 4, "approved").otherwise("candidate").alias("state"),
                       F.when(m % 8 < 4, F.concat(F.lit("r"), (F.col("t") - (m % 3 == 0).cast("int")).cast("string"))).alias("approved_revision"), F.concat(F.lit("title "), m.cast("string")).alias("title"), ids.split_of(m.cast("string")).alias("split"))


NOTICES = f"""n AS (SELECT conv_id AS mobile_id, max(turn) AS t, 'r' || max(turn) AS latest, CASE WHEN conv_id % 8 = 0 THEN 'processing' WHEN conv_id % 8 < 4 THEN 'approved' ELSE 'candidate' END AS state,
  CASE WHEN conv_id % 8 < 4 THEN 'r' || (max(turn) - CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END) END AS approved, {SPLIT.format("CAST(conv_id AS VARCHAR)")} AS split FROM conversations GROUP BY conv_id)"""


def _turns(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("mobile_id"), "turn", F.concat(F.lit("r"), F.when(n % 4 == 0, F.col("turn")).otherwise(F.max("turn").over(Window.partitionBy("conv_id"))).cast("string")).alias("seen_revision"), F.when(n % 13 == 0, "done").when(n % 3 == 0, "held").otherwise("approved").alias("action"),
        F.when(n % 17 == 0, "because").alias("reason"), F.when(n % 7 == 0, " ").otherwise("reviewer").alias("reviewer"), (n % 5 != 0).alias("compared"), F.lit(True).alias("rights"), (n % 11 != 0).alias("privacy"),
        F.when(n % 2 == 0, "  ").otherwise(F.concat(F.lit(" new "), F.col("turn").cast("string"))).alias("title"), F.when(n % 19 == 0, "overlap").alias("error"))


TURNS = """e AS (SELECT conv_id AS mobile_id, turn, length(text) AS n, 'r' || CASE WHEN length(text) % 4 = 0 THEN turn ELSE max(turn) OVER (PARTITION BY conv_id) END AS seen,
  CASE WHEN length(text) % 13 = 0 THEN 'done' WHEN length(text) % 3 = 0 THEN 'held' ELSE 'approved' END AS action FROM conversations),
v AS (SELECT e.*, n.t, CASE WHEN seen <> latest OR state = 'processing' THEN 'stale' WHEN action = 'done' OR n % 17 = 0 THEN 'unknown_action' WHEN n % 7 = 0 THEN 'no_reviewer' WHEN action = 'approved' AND (n % 5 = 0 OR n % 11 = 0) THEN 'unconfirmed'
  WHEN action = 'approved' AND mobile_id % 10 = 5 THEN 'blocked' ELSE 'accepted' END AS verdict FROM e JOIN n USING (mobile_id))"""


def _warnings(spark, sf_dir):
    return _notices(spark, sf_dir).select("mobile_id", F.when(F.col("mobile_id") % 10 == 5, "boundary").otherwise("geometry").alias("code"))


def decision_verdicts(spark, sf_dir):
    return conversion.decisions(_turns(spark, sf_dir), _notices(spark, sf_dir), _warnings(spark, sf_dir), ["turn"])[0].select("mobile_id", "turn", "verdict")


def decision_states(spark, sf_dir):
    return conversion.decisions(_turns(spark, sf_dir), _notices(spark, sf_dir), _warnings(spark, sf_dir), ["turn"])[1]


def correction_verdicts(spark, sf_dir):
    return conversion.corrections(_turns(spark, sf_dir), _notices(spark, sf_dir)).select("mobile_id", "turn", "title", "verdict")


def _revisions(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return t.select(F.concat_ws(":", "conv_id", F.concat(F.lit("r"), F.col("turn").cast("string"))).alias("revision_id"), "conv_id", F.when(n % 6 == 0, "p1").otherwise("p2").alias("parser"), F.when(n % 10 == 0, "c1").otherwise("c2").alias("converter"), "turn")


def _whole(df, *columns):
    """Revisions named by their notice too."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.concat_ws(":", "mobile_id", c)) for c in columns})


def approved_structure_rules(spark, sf_dir):
    revisions = _revisions(spark, sf_dir)
    key = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit("k"), (F.col("conv_id") % 40 + F.col("turn")).cast("string")))
    blocks = revisions.select("revision_id", F.col("turn").alias("place"), F.concat_ws("/", "revision_id", F.lit("0")).alias("block_id"), key.alias("structure_key"), F.when(F.col("turn") % 2 == 0, "timeline").alias("layout"))
    notices = _whole(_notices(spark, sf_dir), "latest_revision", "approved_revision")
    return conversion.approved_rules(notices, revisions, blocks, notices.filter("mobile_id % 7 <> 0").select("mobile_id"), "p2", "c2")


def outdated_notices(spark, sf_dir):
    return conversion.outdated(_whole(_notices(spark, sf_dir), "latest_revision"), _revisions(spark, sf_dir), "p2", "c2").select("mobile_id", "state")


def queue_conversion(spark, sf_dir):
    notices = _notices(spark, sf_dir)
    requests = notices.filter("mobile_id % 3 <> 0").select("mobile_id", F.when(F.col("mobile_id") % 5 == 0, "r0").otherwise(F.col("latest_revision")).alias("seen_revision"))
    return conversion.queued(notices, requests)[1].select("mobile_id", "state", "approved_revision")


def current_citations(spark, sf_dir):
    cited = _revisions(spark, sf_dir).select(F.col("conv_id").alias("mobile_id"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("revision_id"))
    return conversion.still_current(cited, _notices(spark, sf_dir))


def revision_history(spark, sf_dir):
    """The newest hundred revisions, and sixty notices last worked on: by time, then id."""
    newest = _revisions(spark, sf_dir).orderBy(F.desc("turn"), "revision_id").limit(100)
    return newest.select("revision_id", F.col("turn").alias("sequence"), "parser")


PLANS = {
    "conversion_blocks": (conversion_blocks, f"""WITH {FLOW} SELECT notice_id, doc_id || ':' || place AS block_id, CASE WHEN tab THEN 'table' ELSE 'paragraph' END AS type, sha256(text) AS text,
  CASE WHEN mast AND place < title_at THEN 'source_info' WHEN mast AND place = title_at THEN 'title' END AS placement,
  CASE WHEN tab THEN CASE WHEN r.k IS NOT NULL THEN 'key_value_cards' WHEN doc_id % 6 = 1 THEN 'grade_cards' WHEN doc_id % 2 = 0 THEN 'timeline' ELSE 'scroll_table' END END AS layout,
  CASE WHEN tab AND r.k IS NOT NULL THEN 'approved-structure-only' WHEN tab AND doc_id % 6 = 1 THEN 'fixed-component' END AS method
FROM kept LEFT JOIN r ON tab AND doc_id % 10 <> 0 AND r.k = 'k' || ((doc_id + place) % 15) AND r.origin <> notice_id"""),
    "conversion_excluded": (conversion_excluded, f"""WITH {FLOW} SELECT s.notice_id, s.doc_id AS file_id, place, 'form' AS reason FROM shown s JOIN cut c USING (doc_id) WHERE place >= start
UNION ALL SELECT notice_id, doc_id, place, 'decorative' FROM full_ WHERE NOT tab AND NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}_]')"""),
    "conversion_warnings": (conversion_warnings, f"""WITH {FLOW}, f AS (SELECT source || '/' || lang AS notice_id, doc_id FROM documents WHERE lang <> 'fr' AND doc_id % 5 <> 0),
b AS (SELECT f.*, CASE WHEN doc_id % 13 = 0 THEN 4 WHEN doc_id % 7 <> 1 THEN form_at END AS start FROM f LEFT JOIN edge USING (doc_id))
SELECT notice_id, CAST(doc_id AS VARCHAR) AS file_id, 'needs_vision' AS code FROM f WHERE doc_id % 19 = 0 UNION ALL SELECT notice_id, CAST(doc_id AS VARCHAR), 'incomplete' FROM f WHERE doc_id % 17 = 0
UNION ALL SELECT notice_id, CAST(doc_id AS VARCHAR), 'boundary' FROM b WHERE start IS NULL AND doc_id % 7 = 0 OR start IS NOT NULL AND doc_id % 2 = 1
UNION ALL SELECT DISTINCT notice_id, CAST(doc_id AS VARCHAR), 'geometry' FROM kept WHERE tab AND doc_id % 8 = 3
UNION ALL SELECT DISTINCT source || '/' || lang, NULL, 'no_guide' FROM documents d WHERE source || '/' || lang NOT IN (SELECT notice_id FROM f)
UNION ALL SELECT DISTINCT source || '/' || lang, NULL, 'empty' FROM documents d WHERE source || '/' || lang NOT IN (SELECT notice_id FROM kept)"""),
    "register_collected": (register_collected, """WITH a AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, sha256(CAST(l_partkey AS VARCHAR))[1:6] AS sha, l_suppkey AS s FROM lineitem),
f AS (SELECT o, string_agg(i || ':' || CASE WHEN s % 2 = 0 THEN 'hwp' ELSE 'unsupported' END || ':' || CASE WHEN s % 3 = 0 THEN 'attachment' ELSE 'convert' END || ':' || sha, ',' ORDER BY i) AS files FROM a GROUP BY o)
SELECT o AS origin, CASE WHEN o % 4 = 0 THEN 'old' ELSE sha256('collected:' || o)[1:32] END AS mobile_id,
  CASE WHEN o % 4 = 0 THEN '' WHEN o % 3 = 0 THEN files ELSE 'body:html:convert:' || sha256('<p>' || o)[1:6] || ',' || files END AS files, CASE WHEN o % 6 = 0 THEN 'eval' ELSE 'train' END AS split FROM f"""),
    "file_roles": (file_roles, """WITH f AS (SELECT doc_id AS i, CASE WHEN lang = 'fr' OR doc_id % 5 = 0 THEN 'attachment' ELSE 'convert' END AS role, CASE WHEN doc_id % 7 = 0 THEN 'mixed' WHEN doc_id % 7 = 1 THEN 'notice' ELSE 'auto' END AS scope, doc_id % 3 <> 0 AS edited FROM documents),
e AS (SELECT i, CASE WHEN edited AND i % 11 = 0 THEN 'other' WHEN edited AND i % 11 = 1 THEN 'attachment' ELSE role END AS role, CASE WHEN edited AND i % 23 = 0 THEN 'all' ELSE scope END AS scope,
  CASE WHEN edited AND i % 4 = 0 THEN NULL WHEN edited AND i % 4 = 1 THEN CAST(i * 2 AS VARCHAR) WHEN edited AND i % 4 = 2 THEN 'x' WHEN i % 13 = 0 THEN '4' END AS s, edited FROM f)
SELECT i AS file_id, role, scope, TRY_CAST(s AS BIGINT) AS form_start, edited AND i % 2 = 0 AS boundary_confirmed, false AS incomplete,
  CASE WHEN role = 'other' THEN 'bad_role' WHEN scope = 'all' THEN 'bad_scope' WHEN s = 'x' OR TRY_CAST(s AS BIGINT) > 2000 THEN 'bad_form_start' END AS error FROM e"""),
    "add_attachments": (add_attachments, """WITH u AS (SELECT l_orderkey AS mobile_id, count(*) AS n, sum(CAST(l_quantity * 300000 AS BIGINT)) AS size, bool_or(l_suppkey % 50 = 7) AS bad FROM lineitem GROUP BY 1),
v AS (SELECT *, CASE WHEN mobile_id % 5 = 0 OR mobile_id % 9 = 0 THEN 'stale' WHEN n > 10 OR size > 52428800 THEN 'too_much' WHEN bad THEN 'content_mismatch' ELSE 'accepted' END AS verdict FROM u)
SELECT mobile_id, verdict, CASE WHEN verdict = 'accepted' THEN n ELSE 0 END AS files FROM v"""),
    "blocks_error": (blocks_error, """WITH b AS (SELECT l_orderkey AS o, l_suppkey AS s, l_suppkey % 40 >= 9 AS tab FROM lineitem)
SELECT o AS revision_id, CASE WHEN bool_or(s % 40 = 0) THEN 'unknown_type' WHEN bool_or(s % 40 = 3) THEN 'no_text' WHEN bool_or(tab AND s % 97 = 11) THEN 'unknown_layout' WHEN bool_or(tab AND s % 89 = 13) THEN 'bad_extent'
  WHEN bool_or(tab AND s % 29 = 3) THEN 'bad_span' WHEN bool_or(tab AND s % 31 = 2) THEN 'overlap' END AS error FROM b GROUP BY o"""),
    "decision_verdicts": (decision_verdicts, f"WITH {NOTICES}, {TURNS} SELECT mobile_id, turn, verdict FROM v"),
    "decision_states": (decision_states, f"WITH {NOTICES}, {TURNS} SELECT mobile_id, arg_max(action, turn) AS state, CASE WHEN arg_max(action, turn) = 'approved' THEN arg_max(seen, turn) END AS approved_revision FROM v WHERE verdict = 'accepted' GROUP BY mobile_id"),
    "correction_verdicts": (correction_verdicts, f"""WITH {NOTICES}, {TURNS} SELECT mobile_id, turn, CASE WHEN n % 2 = 0 THEN 'title ' || mobile_id ELSE 'new ' || turn END AS title,
  CASE WHEN verdict = 'stale' THEN 'stale' WHEN n % 19 = 0 THEN 'overlap' ELSE 'accepted' END AS verdict FROM v"""),
    "approved_structure_rules": (approved_structure_rules, f"""WITH {NOTICES}, b AS (SELECT mobile_id, turn, mobile_id || ':r' || turn AS rev, 'k' || (mobile_id % 40 + turn) AS k, CASE WHEN turn % 2 = 0 THEN 'timeline' ELSE 'scroll_table' END AS layout
  FROM n JOIN conversations ON conv_id = mobile_id AND turn = t WHERE state = 'approved' AND latest = approved AND split <> 'eval' AND mobile_id % 7 <> 0 AND length(text) % 6 <> 0 AND length(text) % 10 <> 0 AND turn % 5 <> 4)
SELECT k AS structure_key, arg_max(layout, mobile_id) AS layout, max(mobile_id) AS notice_id, arg_max(rev, mobile_id) AS revision_id, arg_max(rev, mobile_id) || '/0' AS block_id FROM b GROUP BY k"""),
    "outdated_notices": (outdated_notices, f"WITH {NOTICES} SELECT mobile_id, state FROM n JOIN conversations ON conv_id = mobile_id AND turn = t WHERE state <> 'processing' AND (length(text) % 6 = 0 OR length(text) % 10 = 0)"),
    "queue_conversion": (queue_conversion, f"""WITH {NOTICES}, q AS (SELECT *, state <> 'processing' AND mobile_id % 3 <> 0 AND (mobile_id % 5 <> 0 OR latest = 'r0') AS taken FROM n)
SELECT mobile_id, CASE WHEN taken THEN 'processing' ELSE state END AS state, CASE WHEN NOT taken THEN approved END AS approved_revision FROM q"""),
    "current_citations": (current_citations, f"WITH {NOTICES} SELECT mobile_id, approved AS revision_id FROM n JOIN conversations ON conv_id = mobile_id AND 'r' || turn = approved WHERE state = 'approved'"),
    "revision_history": (revision_history, "SELECT conv_id || ':r' || turn AS revision_id, turn AS sequence, CASE WHEN length(text) % 6 = 0 THEN 'p1' ELSE 'p2' END AS parser FROM conversations ORDER BY turn DESC, revision_id LIMIT 100"),
}
