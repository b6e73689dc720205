"""Classification, gates, decisions, exports and queue queries. Cue words in play are English stems, as the tables hold no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions import ids, text
from tidemill.operators import queue, rules
from tidemill.plans.accounting import SPLIT
from tidemill.plans.text import EDGE, NUMBERS
from tidemill.session import table
from tidemill.streaming.queue import sessions, usage



def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file of the notice of its source and language; flags come from ids and labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    out = d.select(
        F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", (i % 7).cast("string")).alias("notice_id"), F.sha2("text", 256).alias("sha256"), "text", "lang",
        F.concat("source", F.when(i % 11 == 0, " ing").otherwise(""), F.when(i % 13 == 0, " Ation.hwp").otherwise(".hwp")).alias("filename"),
        F.when(i % 10 < 6, "html").when(i % 10 < 8, "hwp").when(i % 10 == 8, "image").otherwise("zip").alias("kind"),
        F.when(i % 17 == 0, "missing").when(i % 19 == 0, "parse_error").otherwise("extracted").alias("status"),
        (i % 23 != 0).alias("parser_current"), (i % 29 == 0).alias("incomplete"), F.coalesce(text.has_pii(F.col("text")), F.lit(False)).alias("privacy_flag"),
        (ids.split_of(F.col("source")) == "eval").alias("evaluation"), (F.coalesce("toxic", F.lit(0)) == 1).alias("rights_denied"), F.lit(None).cast("boolean").alias("unrelated"), "quality")
    kind = rules.content_kind(F.col("filename"), F.col("text"), ("Ation",), ("src7",), ("ing",), ("the", "and", "was", "of", "her"), "er ")
    return out.withColumn("content_kind", kind)


FILES = f"""base AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
f0 AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || (doc_id % 7) AS notice_id, sha256(text) AS sha256, text, lang, quality,
  source || CASE WHEN doc_id % 11 = 0 THEN ' ing' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN ' Ation.hwp' ELSE '.hwp' END AS filename,
  CASE WHEN doc_id % 10 < 6 THEN 'html' WHEN doc_id % 10 < 8 THEN 'hwp' WHEN doc_id % 10 = 8 THEN 'image' ELSE 'zip' END AS kind,
  CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 19 = 0 THEN 'parse_error' ELSE 'extracted' END AS status,
  doc_id % 23 <> 0 AS parser_current, doc_id % 29 = 0 AS incomplete,
  coalesce(regexp_matches(text, '(^|{EDGE}){NUMBERS}($|{EDGE})') OR regexp_matches(text, '{text.PII_MAIL}'), false) AS privacy_flag,
  {SPLIT.format('source')} = 'eval' AS evaluation, coalesce(toxic, 0) = 1 AS rights_denied FROM base),
f1 AS (SELECT *, contains(filename, 'Ation') AS nform, contains(filename, 'src7') AS nref, contains(filename, 'ing') AS nguide, contains(trim(text, ' \t\n\r'), 'ing') AS g,
  len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) <= 15 AND contains(x, 'Ation'))) > 0 AS heading,
  (length(text) - length(replace(text, 'er ', ''))) // 3 >= 2 OR CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'and') AS INT) + CAST(contains(text, 'was') AS INT) + CAST(contains(text, 'of') AS INT) + CAST(contains(text, 'her') AS INT) >= 3 AS filled FROM f0),
f2 AS (SELECT *, CASE WHEN nform AND nguide OR g AND heading AND filled THEN 'mixed' WHEN nform THEN 'form' WHEN nref THEN 'reference' WHEN heading AND filled AND NOT g THEN 'form'
  WHEN length(trim(text, ' \t\n\r')) < 10 THEN 'unknown' ELSE 'guide' END AS content_kind FROM f1),
f3 AS (SELECT *, content_kind IN ('form', 'reference') AS original, list_filter([
  CASE WHEN NOT parser_current THEN 'parser_stale' END, CASE WHEN incomplete THEN 'incomplete' END, CASE WHEN privacy_flag THEN 'privacy_review' END, CASE WHEN status <> 'extracted' THEN 'status_unusable' END,
  CASE WHEN kind = 'image' THEN 'needs_vision' WHEN kind = 'zip' THEN 'needs_parser' END, CASE content_kind WHEN 'mixed' THEN 'boundary_unconfirmed' WHEN 'unknown' THEN 'insufficient_text' END], lambda x: x IS NOT NULL) AS holds FROM f2),
classified AS (SELECT *, CASE WHEN original THEN 'attachment' WHEN content_kind = 'unknown' THEN 'uncertain' ELSE 'convert' END AS role,
  CASE WHEN evaluation THEN 'evaluation' WHEN rights_denied THEN 'excluded' WHEN status = 'missing' THEN 'held' WHEN original THEN 'attachment' WHEN len(holds) > 0 THEN 'held' ELSE 'candidate' END AS use,
  list_concat(CASE content_kind WHEN 'form' THEN ['original_form'] WHEN 'reference' THEN ['original_reference'] WHEN 'mixed' THEN ['boundary_unconfirmed'] WHEN 'unknown' THEN ['insufficient_text'] ELSE [] END,
    list_filter(CASE WHEN evaluation THEN ['evaluation'] WHEN rights_denied THEN ['rights_denied'] WHEN status = 'missing' THEN ['original_missing'] WHEN original THEN [] WHEN len(holds) > 0 THEN holds ELSE ['rights_unreviewed'] END,
      lambda x: x <> 'boundary_unconfirmed' AND x <> 'insufficient_text' OR content_kind NOT IN ('mixed', 'unknown'))) AS reasons FROM f3)"""
NOTICE = """notices AS (SELECT notice_id, count(*) AS files, CASE WHEN bool_or(use = 'evaluation') THEN 'evaluation' WHEN bool_or(use = 'excluded' AND role <> 'attachment') THEN 'excluded'
  WHEN bool_or(role = 'uncertain' OR use = 'held') THEN 'held' WHEN bool_or(use = 'candidate') THEN 'candidate' WHEN bool_or(use = 'attachment') THEN 'attachment' ELSE 'held' END AS use FROM classified GROUP BY notice_id)"""
RESERVED = "reserved AS (SELECT DISTINCT sha256 FROM classified WHERE file_id % 31 = 0)"


def classified(spark, sf_dir):
    return rules.classify(files(spark, sf_dir))


def content_kind(spark, sf_dir):
    return files(spark, sf_dir).groupBy("content_kind", "lang").agg(F.count("*").alias("n"))


def classify_file(spark, sf_dir):
    return classified(spark, sf_dir).select("file_id", "role", "use", "content_kind", F.array_join("reasons", ",").alias("reasons"))


def notice_use(spark, sf_dir):
    return rules.notice_use(classified(spark, sf_dir))


def use_by_file(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("use").agg(F.count("*").alias("n"))


def use_by_notice(spark, sf_dir):
    return notice_use(spark, sf_dir).groupBy("use").agg(F.count("*").alias("n"))


def hold_reasons(spark, sf_dir):
    return classified(spark, sf_dir).filter("use = 'held'").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _decisions(spark, sf_dir):
    return files(spark, sf_dir).filter(F.col("file_id") % 31 == 0).select("notice_id", "file_id", F.lit("evaluation").alias("use"))


def evaluation_leak(spark, sf_dir):
    own = classified(spark, sf_dir)
    return rules.leaked(own, rules.reserved_files(own, _decisions(spark, sf_dir).withColumnRenamed("use", "use"))).select("file_id", "notice_id")


def case_gate(spark, sf_dir):
    own = classified(spark, sf_dir)
    return rules.allowed_notices(own, own.filter(F.col("file_id") % 31 == 0).select("sha256").distinct())


def mobile_gate(spark, sf_dir):
    own = classified(spark, sf_dir)
    notices = rules.notice_use(own).filter("use = 'candidate'")
    bad = own.join(own.filter(F.col("file_id") % 31 == 0).select("sha256").distinct(), "sha256", "left_semi").select("notice_id").distinct()
    return notices.join(bad, "notice_id", "left_anti").select("notice_id", "files")


def decision_validation(spark, sf_dir):
    own = classified(spark, sf_dir)
    current = own.select("notice_id", "file_id", "status", "kind", "evaluation", "privacy_flag", F.substring("sha256", 1, 8).alias("fingerprint"))
    i = F.col("file_id")
    wanted = own.select(
        "notice_id", "file_id", F.when(i % 3 == 0, "attachment").otherwise("convert").alias("new_role"), F.when(i % 4 == 0, "attachment").when(i % 4 == 1, "held").otherwise("candidate").alias("new_use"),
        F.when(i % 37 == 0, " ").otherwise("reviewer").alias("reviewer"), F.when(i % 41 == 0, "old").otherwise(F.substring("sha256", 1, 8)).alias("seen_fingerprint"), F.lit(True).alias("privacy_checked"), F.when(i % 2 == 0, "seen").otherwise("").alias("note"))
    return rules.check_decisions(wanted, current).select("file_id", "verdict")


def latest_decision(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return rules.latest(turns.select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


def revision_sequence(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg((F.max("turn") + 2).alias("next_sequence"), ids.revision_id(F.sha2(F.max_by("text", "turn"), 256), F.max("turn") + 1).alias("latest_revision"))


def review_fold(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    status = F.when(F.col("role") == "user", "candidate").when(F.length("text") % 3 == 0, "approved").otherwise("held")
    events = turns.select(F.col("conv_id").alias("case_id"), "turn", status.alias("status"), F.when(F.length("text") % 5 == 0, F.sha2("text", 256)).alias("correction"), F.when(F.length("text") % 2 == 0, F.concat(F.lit("layout"), F.col("turn").cast("string"))).alias("layout"))
    return rules.fold_reviews(events, ["turn"])


def outdated_revisions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    last = rules.latest(turns.select("conv_id", "turn", "text"), ["conv_id"], ["turn"])
    return last.filter(F.length("text") % 4 != 0).select("conv_id", "turn")


def approved_pattern_suggestion(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    approved = p.filter(F.col("p_size") > 45).select(F.col("p_brand").alias("pattern"), F.col("p_type").alias("layout"))
    return rules.suggestions(p.select("p_partkey", F.col("p_brand").alias("pattern")), approved).select("p_partkey", "suggested")


def _blocks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    return p.select(i.alias("notice_id"), F.when(i % 10 == 0, "").otherwise(F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string"))).alias("structure_key"), F.col("p_type").alias("layout"),
                    F.when(i % 3 == 0, "approved").otherwise("held").alias("state"), F.lit(1).alias("revision"), F.when(i % 7 == 0, 2).otherwise(1).alias("approved_revision"), ids.split_of(F.col("p_name")).alias("split"), F.col("p_retailprice").alias("at"))


def approved_rules(spark, sf_dir):
    return rules.approved_rules(_blocks(spark, sf_dir), ["at", "notice_id"])


def rule_lookup(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    found = rules.approved_rules(blocks, ["at", "notice_id"]).select("structure_key", F.col("layout").alias("suggested"), F.col("notice_id").alias("origin"))
    return blocks.join(found, "structure_key").filter(F.col("notice_id") != F.col("origin")).select("notice_id", "suggested", "origin")


def _exports(spark, sf_dir):
    own = classified(spark, sf_dir)
    gate = rules.allowed_notices(own, own.filter(F.col("file_id") % 31 == 0).select("sha256").distinct())
    return own.withColumn("split", ids.split_of(F.col("notice_id"))), gate


def export_candidates(spark, sf_dir):
    own, gate = _exports(spark, sf_dir)
    return own.filter("split <> 'eval' AND coalesce(quality, 0) = 0").join(gate, "notice_id", "left_semi").select("file_id", "split", F.lit("not_for_training").alias("learning_permission"))


def export_approved(spark, sf_dir):
    own, gate = _exports(spark, sf_dir)
    return own.filter("split <> 'eval' AND quality = 1").join(gate, "notice_id", "left_semi").select("file_id", "split")


def export_eval(spark, sf_dir):
    return _exports(spark, sf_dir)[0].filter("split = 'eval'").select("file_id", "notice_id")


def corpus_stats(spark, sf_dir):
    facets = lambda df, name: df.select(F.lit(name).alias("facet"), F.col("use").alias("value"), "n")
    return facets(use_by_file(spark, sf_dir), "file").unionByName(facets(use_by_notice(spark, sf_dir), "notice"))


def listing(spark, sf_dir):
    return notice_use(spark, sf_dir).filter("use = 'held'").orderBy(F.desc("files"), "notice_id").offset(10).limit(50)


def _jobs(spark, sf_dir):
    """Users' events as jobs' events; views are claims, purchases finishes, errors failures, signups enqueues."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "fail").otherwise("heartbeat")
    return queue.fold(e.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind")))


def job_fold(spark, sf_dir):
    return _jobs(spark, sf_dir).select("job", "status", F.col("attempts").cast("bigint").alias("attempts"))


def ready_jobs(spark, sf_dir):
    return queue.ready(_jobs(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp"), 20).select("job", F.col("attempts").cast("bigint").alias("attempts"))


#: The log walked event by event.
JOBS = """RECURSIVE o AS (SELECT user_id AS job, ts, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'heartbeat' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT DISTINCT user_id AS job, 0::BIGINT AS n, 'none' AS status, 0::BIGINT AS attempts, TIMESTAMP '1970-01-01' AS since, false AS failed FROM events
  UNION ALL SELECT job, n, CASE WHEN takes THEN CASE kind WHEN 'enqueue' THEN 'pending' WHEN 'claim' THEN 'running' WHEN 'finish' THEN 'done' ELSE CASE WHEN attempts >= 5 THEN 'error' ELSE 'pending' END END ELSE now END,
    CASE WHEN takes AND kind = 'enqueue' THEN 0 WHEN takes AND kind = 'claim' THEN attempts + 1 ELSE attempts END, CASE WHEN takes THEN ts ELSE since END, CASE WHEN takes THEN kind = 'fail' ELSE failed END
  FROM (SELECT *, CASE kind WHEN 'enqueue' THEN now IN ('none', 'done', 'error') WHEN 'claim' THEN now = 'pending' AND NOT (failed AND ts < since + INTERVAL 30 MINUTE) WHEN 'finish' THEN now = 'running' WHEN 'fail' THEN now = 'running' ELSE false END AS takes
    FROM (SELECT o.job, o.n, o.ts, o.kind, w.attempts, w.since, w.failed, CASE WHEN w.status = 'running' AND o.ts >= w.since + INTERVAL 30 MINUTE THEN 'pending' ELSE w.status END AS now FROM w JOIN o ON o.job = w.job AND o.n = w.n + 1))),
l AS (SELECT job, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts, arg_max(since, n) AS since, arg_max(failed, n) AS failed FROM w GROUP BY job)"""


def user_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("string").alias("start"), "events")


def hourly_usage(spark, sf_dir):
    return usage(table(spark, sf_dir, "events")).select(F.col("start").cast("string").alias("start"), "event_type", "n")


def attachment_outcome(spark, sf_dir):
    """Attachments in turn of size, within 50 MB for a notice and at most 12."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), (F.col("l_quantity") * 1_000_000).cast("bigint").alias("bytes"), "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("o")
    total = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(w)
    out = F.when(F.col("l_returnflag") == "R", "skipped").when(F.col("bytes") > 20_000_000, "too_large").when((total > 50_000_000) | (n > 12), "over_limit").otherwise("kept")
    return li.withColumn("outcome", out).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


PLANS = {
    "content_kind": (content_kind, f"WITH {FILES} SELECT content_kind, lang, count(*) AS n FROM classified GROUP BY ALL"),
    "classify_file": (classify_file, f"WITH {FILES} SELECT file_id, role, use, content_kind, array_to_string(reasons, ',') AS reasons FROM classified"),
    "notice_use": (notice_use, f"WITH {FILES}, {NOTICE} SELECT * FROM notices"),
    "use_by_file": (use_by_file, f"WITH {FILES} SELECT use, count(*) AS n FROM classified GROUP BY use"),
    "use_by_notice": (use_by_notice, f"WITH {FILES}, {NOTICE} SELECT use, count(*) AS n FROM notices GROUP BY use"),
    "hold_reasons": (hold_reasons, f"WITH {FILES}, r AS (SELECT unnest(reasons) AS reason FROM classified WHERE use = 'held') SELECT reason, count(*) AS n FROM r GROUP BY reason"),
    "evaluation_leak": (evaluation_leak, f"WITH {FILES}, {RESERVED} SELECT file_id, notice_id FROM classified WHERE use <> 'evaluation' AND sha256 IN (FROM reserved)"),
    "case_gate": (case_gate, f"WITH {FILES}, {RESERVED} SELECT notice_id FROM classified GROUP BY notice_id HAVING bool_and((role = 'convert' AND use = 'candidate' OR use = 'held' AND array_to_string(reasons, ',') = 'insufficient_text' AND status = 'extracted') AND sha256 NOT IN (FROM reserved))"),
    "mobile_gate": (mobile_gate, f"WITH {FILES}, {NOTICE}, {RESERVED} SELECT notice_id, files FROM notices WHERE use = 'candidate' AND notice_id NOT IN (SELECT notice_id FROM classified WHERE sha256 IN (FROM reserved))"),
    "decision_validation": (decision_validation, f"""WITH {FILES}, w AS (SELECT *, CASE WHEN file_id % 3 = 0 THEN 'attachment' ELSE 'convert' END AS r, CASE WHEN file_id % 4 = 0 THEN 'attachment' WHEN file_id % 4 = 1 THEN 'held' ELSE 'candidate' END AS u FROM classified)
SELECT file_id, CASE WHEN file_id % 37 = 0 THEN 'malformed' WHEN r = 'attachment' AND u = 'candidate' OR r = 'convert' AND u = 'attachment' THEN 'role_mismatch' WHEN file_id % 41 = 0 THEN 'stale'
  WHEN evaluation THEN 'evaluation_is_final' WHEN u = 'candidate' AND (status <> 'extracted' OR kind IN ('image', 'zip')) THEN 'source_unusable' WHEN u = 'candidate' AND privacy_flag AND file_id % 2 = 1 THEN 'privacy_note' ELSE 'accepted' END AS verdict FROM w"""),
    "latest_decision": (latest_decision, "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id"),
    "revision_sequence": (revision_sequence, "SELECT conv_id, max(turn) + 2 AS next_sequence, sha256(sha256(arg_max(text, turn)) || ':' || (max(turn) + 1)) AS latest_revision FROM conversations GROUP BY conv_id"),
    "review_fold": (review_fold, """WITH e AS (SELECT conv_id AS case_id, turn, CASE WHEN role = 'user' THEN 'candidate' WHEN length(text) % 3 = 0 THEN 'approved' ELSE 'held' END AS status,
  CASE WHEN length(text) % 5 = 0 THEN sha256(text) END AS correction, CASE WHEN length(text) % 2 = 0 THEN 'layout' || turn END AS layout FROM conversations)
SELECT case_id, arg_max(status, turn) AS status, arg_max(correction, turn) FILTER (WHERE correction IS NOT NULL) AS correction, arg_max(layout, turn) FILTER (WHERE layout IS NOT NULL) AS layout, count(*) AS history, arg_max(status, turn) = 'approved' AS approved FROM e GROUP BY case_id"""),
    "outdated_revisions": (outdated_revisions, "SELECT conv_id, turn FROM (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS t FROM conversations GROUP BY conv_id) WHERE length(t) % 4 <> 0"),
    "approved_pattern_suggestion": (approved_pattern_suggestion, "WITH a AS (SELECT p_brand, min(p_type) AS l FROM part WHERE p_size > 45 GROUP BY p_brand HAVING count(DISTINCT p_type) = 1) SELECT p_partkey, l AS suggested FROM part LEFT JOIN a USING (p_brand)"),
    "approved_rules": (approved_rules, f"""WITH b AS (SELECT p_partkey AS notice_id, p_brand || '/' || (p_size % 5) AS structure_key, p_type AS layout, p_retailprice AS t FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AND {SPLIT.format('p_name')} <> 'eval')
SELECT structure_key, arg_max(layout, (t, notice_id)) AS layout, arg_max(notice_id, (t, notice_id)) AS notice_id FROM b GROUP BY structure_key"""),
    "rule_lookup": (rule_lookup, f"""WITH b AS (SELECT *, p_partkey AS notice_id, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand || '/' || (p_size % 5) END AS k FROM part),
r AS (SELECT k, arg_max(p_type, (p_retailprice, notice_id)) AS suggested, arg_max(notice_id, (p_retailprice, notice_id)) AS origin FROM b WHERE k <> '' AND p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AND {SPLIT.format('p_name')} <> 'eval' GROUP BY k)
SELECT notice_id, suggested, origin FROM b JOIN r USING (k) WHERE notice_id <> origin"""),
    "corpus_stats": (corpus_stats, f"WITH {FILES}, {NOTICE} SELECT 'file' AS facet, use AS value, count(*) AS n FROM classified GROUP BY use UNION ALL SELECT 'notice', use, count(*) FROM notices GROUP BY use"),
    "listing": (listing, f"WITH {FILES}, {NOTICE} SELECT notice_id, use, files FROM notices WHERE use = 'held' ORDER BY files DESC, notice_id LIMIT 50 OFFSET 10"),
    "job_fold": (job_fold, f"WITH {JOBS} SELECT job, status, attempts FROM l"),
    "ready_jobs": (ready_jobs, f"WITH {JOBS} SELECT job, attempts FROM l WHERE status = 'pending' AND (NOT failed OR since + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-20') ORDER BY job LIMIT 20"),
    "user_sessions": (user_sessions, """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(min(ts)) % 1000000 = 0 THEN '' ELSE rtrim(strftime(min(ts), '.%f'), '0') END AS start, count(*) AS events FROM n GROUP BY user_id, i"""),
    "hourly_usage": (hourly_usage, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "attachment_outcome": (attachment_outcome, """WITH r AS (SELECT l_returnflag, CAST(l_quantity * 1000000 AS BIGINT) AS bytes, sum(CAST(l_quantity * 1000000 AS BIGINT)) OVER w AS total, row_number() OVER w AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING))
SELECT CASE WHEN l_returnflag = 'R' THEN 'skipped' WHEN bytes > 20000000 THEN 'too_large' WHEN total > 50000000 OR n > 12 THEN 'over_limit' ELSE 'kept' END AS outcome, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1"""),
}
_GATE = f"WITH {FILES}, {RESERVED}, gate AS ({PLANS['case_gate'][1].split(RESERVED, 1)[1].strip()}), x AS (SELECT *, {SPLIT.format('notice_id')} AS split FROM classified)"
PLANS |= {
    "export_candidates": (export_candidates, _GATE + " SELECT file_id, split, 'not_for_training' AS learning_permission FROM x WHERE split <> 'eval' AND coalesce(quality, 0) = 0 AND notice_id IN (FROM gate)"),
    "export_approved": (export_approved, _GATE + " SELECT file_id, split FROM x WHERE split <> 'eval' AND quality = 1 AND notice_id IN (FROM gate)"),
    "export_eval": (export_eval, f"WITH {FILES} SELECT file_id, notice_id FROM classified WHERE {SPLIT.format('notice_id')} = 'eval'"),
}
