"""Corpus state queries: documents play files of the notices of their source, language and a seventh of the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import ids, text
from tidemill.operators import corpus, rules
from tidemill.plans.text import EDGE, NUMBERS
from tidemill.session import table

VERSION = "v2"


def files(spark, sf_dir):
    """Files with their extraction results beside them: content missing for some, results for others."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    own = d.select(
        i.alias("file_id"), F.concat_ws("/", "source", "lang", (i % 7).cast("string")).alias("notice_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.concat(F.lit("doc "), i.cast("string"), F.when(i % 9 == 0, " 신청서").otherwise(""), F.lit(".hwp")).alias("filename"),
        F.when(i % 10 < 8, "hwp").when(i % 10 == 8, "image").otherwise("zip").alias("kind"), (i % 17 != 0).alias("stored"), F.when(i % 31 == 0, "partial_capture").otherwise("full").alias("capture"), (i % 37 == 0).alias("incomplete"), F.when(i % 41 == 0, 600_000).alias("body_length"),
        F.when(i % 3 == 0, "mixed").otherwise("auto").alias("scope"), F.when(i % 3 == 0, 5).alias("form_start"), (i % 2 == 0).alias("boundary_confirmed"), (i % 4 == 0).alias("approved"))
    results = d.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.min("doc_id").alias("i"), F.first("text").alias("text"))
    results = results.filter("i % 13 <> 0").select("sha256", F.when(F.col("i") % 5 == 0, "p1").otherwise("p2").alias("parser"), F.when(F.col("i") % 19 == 0, "parse_error").otherwise("extracted").alias("status"), "text")
    return own, results


def decisions(spark, sf_dir):
    own = files(spark, sf_dir)[0]
    return own.filter("file_id % 53 = 0").select("notice_id", "file_id", F.lit("operator_decision").alias("action"), F.when(F.col("file_id") % 2 == 0, "evaluation").otherwise("held").alias("use"))


def uploads(spark, sf_dir):
    own = files(spark, sf_dir)[0]
    return own.filter("file_id % 59 = 0").select("sha256", F.when(F.col("file_id") % 2 == 1, "eval").otherwise("train").alias("split"))


def cases(spark, sf_dir):
    own = files(spark, sf_dir)[0]
    return own.select(F.concat(F.lit("c"), F.col("file_id").cast("string")).alias("case_id"), "notice_id", F.when(F.col("file_id") % 2 == 0, F.col("file_id").cast("string")).otherwise(F.col("sha256")).alias("source"), (F.col("file_id") % 4 == 0).alias("approved"), F.when(F.col("file_id") % 47 == 0, "eval").otherwise("train").alias("split"))


def reserved(spark, sf_dir):
    return corpus.reserved(files(spark, sf_dir)[0], decisions(spark, sf_dir), uploads(spark, sf_dir))


def evaluation(spark, sf_dir):
    return corpus.evaluation_notices(cases(spark, sf_dir), decisions(spark, sf_dir))


def _described(spark, sf_dir):
    own, results = files(spark, sf_dir)
    return corpus.descriptors(own, results, evaluation(spark, sf_dir), reserved(spark, sf_dir), "p2")


def descriptors(spark, sf_dir):
    return _described(spark, sf_dir).select("file_id", *corpus.FLAGS, "parser")


def _settled(spark, sf_dir):
    described = _described(spark, sf_dir).withColumns({"rights_denied": F.col("file_id") % 61 == 0, "unrelated": F.lit(False)})
    kind = F.when(F.length("text") < 300, "unknown").when(F.col("file_id") % 9 == 0, "form").when(F.col("file_id") % 6 == 0, "mixed").otherwise("guide")
    return corpus.settled(rules.classify(described.withColumn("content_kind", kind)), VERSION)


def settled_files(spark, sf_dir):
    return _settled(spark, sf_dir).select("file_id", "role", "use", F.array_join("reasons", ",").alias("reasons"))


def _effective(spark, sf_dir):
    now = _settled(spark, sf_dir)
    previous = now.filter("file_id % 5 < 3").select("notice_id", "file_id", F.when(F.col("file_id") % 10 == 1, "old").otherwise(F.col("stamp")).alias("stamp"), F.when(F.col("file_id") % 5 < 2, "convert").alias("override_role"), F.when(F.col("file_id") % 5 < 2, "candidate").alias("override_use"))
    return corpus.effective(now, previous)


def effective_files(spark, sf_dir):
    return _effective(spark, sf_dir)[0].select("file_id", "overridden", "effective_role", "effective_use")


def ended_overrides(spark, sf_dir):
    return _effective(spark, sf_dir)[1].select("file_id", "action", "use")


def corpus_records(spark, sf_dir):
    return corpus.records(_effective(spark, sf_dir)[0], VERSION).select("notice_id", "use", "files")


def allowed_cases(spark, sf_dir):
    now, _ = _effective(spark, sf_dir)
    return corpus.allowed_cases(cases(spark, sf_dir), now.withColumn("file_id", F.col("file_id").cast("string")), corpus.records(now, VERSION), evaluation(spark, sf_dir), reserved(spark, sf_dir))


def allowed_conversions(spark, sf_dir):
    """Notices as converted ones, every fifth an upload of files with the same contents."""
    now, _ = _effective(spark, sf_dir)
    records = corpus.records(now, VERSION)
    named = lambda df: df.withColumn("mobile_id", F.concat(F.lit("m/"), "notice_id"))
    upload = F.crc32("notice_id") % 5 == 0
    notices = named(records).select("mobile_id", F.when(~upload, F.col("notice_id")).alias("origin"))
    return corpus.allowed_notices(notices, named(now).select("mobile_id", "sha256"), reserved(spark, sf_dir), records, now.select("notice_id", "sha256"), evaluation(spark, sf_dir))


def eligible_approvals(spark, sf_dir):
    now, _ = _effective(spark, sf_dir)
    records = corpus.records(now, VERSION)
    n = F.crc32("notice_id")
    notices = records.select(F.concat(F.lit("m/"), "notice_id").alias("mobile_id"), F.when(n % 3 < 2, "approved").otherwise("held").alias("state"), F.lit("r2").alias("latest_revision"), F.when(n % 4 < 3, "r2").otherwise("r1").alias("approved_revision"), F.when(n % 11 == 0, "eval").otherwise("train").alias("split"))
    return corpus.eligible(notices, records.select(F.concat(F.lit("m/"), "notice_id").alias("mobile_id"), "use"), allowed_conversions(spark, sf_dir)).select("mobile_id")


def unclassified_notices(spark, sf_dir):
    own = files(spark, sf_dir)[0].select("notice_id").distinct()
    n = F.crc32("notice_id")
    done = own.filter(n % 3 > 0).select("notice_id", F.when(n % 3 == 1, "v1").otherwise(VERSION).alias("version"))
    return corpus.unclassified(own, done, VERSION)


def decided_files(spark, sf_dir):
    now, _ = _effective(spark, sf_dir)
    current = now.select("notice_id", "file_id", "status", "kind", "evaluation", "privacy_flag", "stored", "parser_current", "incomplete", "content_kind", "boundary_confirmed", F.when(F.col("file_id") % 43 == 0, "processing").otherwise("candidate").alias("state"), F.substring("sha256", 1, 8).alias("fingerprint"))
    wanted = now.select("notice_id", "file_id", F.when(F.col("file_id") % 3 == 0, "attachment").otherwise("convert").alias("new_role"), F.when(F.col("file_id") % 4 == 0, "attachment").when(F.col("file_id") % 4 == 1, "held").otherwise("candidate").alias("new_use"), F.when(F.col("file_id") % 37 == 0, " ").otherwise("reviewer").alias("reviewer"),
                        F.when(F.col("file_id") % 41 == 0, "old").otherwise(F.substring("sha256", 1, 8)).alias("seen_fingerprint"), F.lit(True).alias("privacy_checked"), F.when(F.col("file_id") % 2 == 0, "seen").otherwise("").alias("note"))
    return corpus.decided(wanted, current).select("file_id", "verdict")


def _consequences(spark, sf_dir):
    own = files(spark, sf_dir)[0].withColumn("role", F.lit("convert"))
    accepted = own.filter("file_id % 6 = 1").select("notice_id", "file_id", F.when(F.col("file_id") % 5 == 0, "attachment").otherwise("convert").alias("new_role"), F.when(F.col("file_id") % 4 == 1, "evaluation").otherwise("held").alias("new_use"))
    notices = own.select("notice_id").distinct().select("notice_id", F.when(F.crc32("notice_id") % 2 == 0, "r1").alias("latest_revision"))
    return corpus.consequences(accepted, own, notices)


def aliases_again(spark, sf_dir):
    return _consequences(spark, sf_dir)[0]


def ended_approvals(spark, sf_dir):
    return _consequences(spark, sf_dir)[1]


NOTICE = "source || '/' || lang || '/' || (doc_id % 7)"
#: crc32 is not at hand in the oracle's engine; where a rule hangs on it, it is spelt out bit by bit.
CRC = """crc AS (SELECT notice_id, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(length(notice_id)), lambda i: ord(notice_id[i + 1])::UBIGINT)),
  lambda a, c: list_reduce(list_concat([xor(a, c)], list_transform(range(8), lambda x: 0::UBIGINT)), lambda v, x: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)) AS raw FROM (SELECT DISTINCT notice_id FROM f)),
crcs AS (SELECT notice_id, xor(raw, 4294967295::UBIGINT) AS n FROM crc)"""
FILES = f"""f AS (SELECT doc_id AS i, {NOTICE} AS notice_id, sha256(coalesce(text, '')) AS sha, text FROM documents),
held AS (SELECT notice_id FROM f WHERE i % 47 = 0 OR i % 106 = 0),
bad AS (SELECT sha FROM f WHERE i % 106 = 0 OR i % 118 = 59),
res AS (SELECT sha, min(i) AS r FROM f GROUP BY sha),
g AS (SELECT f.*, CASE WHEN i % 10 < 8 THEN 'hwp' WHEN i % 10 = 8 THEN 'image' ELSE 'zip' END AS kind, i % 17 <> 0 AS stored, r % 13 <> 0 AS has, r,
  notice_id IN (FROM held) OR sha IN (FROM bad) AS evaluation, i % 31 = 0 OR i % 37 = 0 OR i % 41 = 0 AS incomplete FROM f JOIN res USING (sha)),
d AS (SELECT *, CASE WHEN NOT stored THEN 'missing' WHEN NOT has THEN CASE WHEN kind = 'image' THEN 'needs_vision' ELSE 'needs_parser' END WHEN r % 19 = 0 THEN 'parse_error' ELSE 'extracted' END AS status,
  stored AND has AND r % 5 <> 0 AS parser_current, CASE WHEN stored AND has THEN CASE WHEN r % 5 = 0 THEN 'p1' ELSE 'p2' END ELSE '' END AS parser,
  CASE WHEN stored AND has THEN coalesce(text, '') ELSE '' END AS body FROM g),
e AS (SELECT *, regexp_matches(body, '(^|{EDGE}){NUMBERS}($|{EDGE})') OR regexp_matches(body, '{text.PII_MAIL}') AS privacy_flag, CASE WHEN length(body) < 300 THEN 'unknown' WHEN i % 9 = 0 THEN 'form' WHEN i % 6 = 0 THEN 'mixed' ELSE 'guide' END AS ck FROM d),
h AS (SELECT *, list_filter([CASE WHEN NOT parser_current THEN 'parser_stale' END, CASE WHEN incomplete THEN 'incomplete' END, CASE WHEN privacy_flag THEN 'privacy_review' END, CASE WHEN status <> 'extracted' THEN 'status_unusable' END,
  CASE WHEN kind = 'image' THEN 'needs_vision' WHEN kind = 'zip' THEN 'needs_parser' END, CASE WHEN ck = 'mixed' AND i % 2 = 1 THEN 'boundary_unconfirmed' END, CASE WHEN ck = 'unknown' THEN 'insufficient_text' END], lambda x: x IS NOT NULL) AS w FROM e),
c AS (SELECT *, CASE WHEN ck = 'form' THEN 'attachment' WHEN ck = 'unknown' THEN 'uncertain' ELSE 'convert' END AS role,
  CASE WHEN evaluation THEN 'evaluation' WHEN i % 61 = 0 THEN 'excluded' WHEN status = 'missing' THEN 'held' WHEN ck = 'form' THEN 'attachment' WHEN len(w) > 0 THEN 'held' ELSE 'candidate' END AS use FROM h),
v AS (SELECT *, i % 5 < 2 AND i % 10 <> 1 AS ov FROM c),
k AS (SELECT *, CASE WHEN ov THEN 'convert' ELSE role END AS erole, CASE WHEN evaluation THEN 'evaluation' WHEN ov THEN 'candidate' ELSE use END AS euse FROM v),
n AS (SELECT notice_id, count(*) AS files, CASE WHEN bool_or(euse = 'evaluation') THEN 'evaluation' WHEN bool_or(euse = 'excluded' AND erole <> 'attachment') THEN 'excluded' WHEN bool_or(erole = 'uncertain' OR euse = 'held') THEN 'held'
  WHEN bool_or(euse = 'candidate') THEN 'candidate' WHEN bool_or(euse = 'attachment') THEN 'attachment' ELSE 'held' END AS use FROM k GROUP BY notice_id)"""
#: An evaluation or excluded file keeps its own short list of reasons, so only held ones show all of theirs.
SHORT = "euse = 'held' AND len(w) = 1 AND w[1] = 'insufficient_text' AND NOT ov AND status = 'extracted' AND parser_current AND NOT incomplete AND NOT privacy_flag AND NOT evaluation"
ALLOWED = f"""m AS (SELECT n.notice_id, n.use, cr.n % 5 = 0 AS up FROM n JOIN crcs cr USING (notice_id)),
sh AS (SELECT DISTINCT k.sha FROM k JOIN n USING (notice_id) WHERE n.use = 'evaluation' AND k.notice_id IN (FROM held)),
al AS (SELECT notice_id FROM m WHERE notice_id NOT IN (SELECT notice_id FROM k WHERE sha IN (FROM bad)) AND CASE WHEN up THEN notice_id NOT IN (SELECT notice_id FROM k WHERE sha IN (FROM sh)) ELSE use = 'candidate' END)"""

PLANS = {
    "reserved_contents": (reserved, f"WITH {FILES} SELECT DISTINCT sha AS sha256 FROM bad"),
    "evaluation_notices": (evaluation, f"WITH {FILES} SELECT DISTINCT notice_id FROM held"),
    "descriptors": (descriptors, f"WITH {FILES} SELECT i AS file_id, kind, status, parser_current, evaluation, incomplete, privacy_flag, parser FROM e"),
    "settled_files": (settled_files, f"""WITH {FILES}, p AS (SELECT *, CASE WHEN ck = 'form' THEN 'original_form' WHEN ck = 'mixed' AND i % 2 = 1 THEN 'boundary_unconfirmed' WHEN ck = 'unknown' THEN 'insufficient_text' END AS first FROM k),
q AS (SELECT *, CASE WHEN evaluation THEN ['evaluation'] WHEN i % 61 = 0 THEN ['rights_denied'] WHEN status = 'missing' THEN ['original_missing'] WHEN ck = 'form' THEN [] WHEN len(w) > 0 THEN w ELSE ['rights_unreviewed'] END AS rest FROM p)
SELECT i AS file_id, role, use, array_to_string(list_concat(CASE WHEN first IS NULL THEN [] ELSE [first] END, list_filter(rest, lambda x: x IS DISTINCT FROM first)), ',') AS reasons FROM q"""),
    "effective_files": (effective_files, f"WITH {FILES} SELECT i AS file_id, ov AS overridden, erole AS effective_role, euse AS effective_use FROM k"),
    "ended_overrides": (ended_overrides, f"WITH {FILES} SELECT i AS file_id, 'source_changed' AS action, 'candidate' AS use FROM f WHERE i % 10 = 1"),
    "corpus_records": (corpus_records, f"WITH {FILES} SELECT notice_id, use, files FROM n"),
    "allowed_cases": (allowed_cases, f"""WITH {FILES}, x AS (SELECT notice_id, i, sha, sha NOT IN (FROM bad) AND (erole = 'convert' AND euse = 'candidate') AS fine, sha NOT IN (FROM bad) AND {SHORT} AS short FROM k),
q AS (SELECT i, notice_id, sha FROM f WHERE i % 47 <> 0 AND notice_id NOT IN (FROM held) AND notice_id IN (SELECT notice_id FROM n WHERE use <> 'excluded'))
SELECT 'c' || q.i AS case_id FROM q JOIN x ON x.notice_id = q.notice_id AND CASE WHEN q.i % 2 = 0 THEN x.i = q.i ELSE x.sha = q.sha END GROUP BY q.i HAVING bool_and(fine OR short AND q.i % 4 = 0)"""),
    "allowed_conversions": (allowed_conversions, f"WITH {FILES}, {CRC}, {ALLOWED} SELECT 'm/' || notice_id AS mobile_id FROM al"),
    "eligible_approvals": (eligible_approvals, f"WITH {FILES}, {CRC}, {ALLOWED} SELECT 'm/' || notice_id AS mobile_id FROM al JOIN n USING (notice_id) JOIN crcs cr USING (notice_id) WHERE use = 'candidate' AND cr.n % 3 < 2 AND cr.n % 4 < 3 AND cr.n % 11 <> 0"),
    "unclassified_notices": (unclassified_notices, f"WITH {FILES}, {CRC} SELECT notice_id FROM crcs WHERE n % 3 < 2"),
    "decided_files": (decided_files, f"""WITH {FILES}, t AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'attachment' ELSE 'convert' END AS nr, CASE WHEN i % 4 = 0 THEN 'attachment' WHEN i % 4 = 1 THEN 'held' ELSE 'candidate' END AS nu FROM k)
SELECT i AS file_id, CASE WHEN i % 37 = 0 THEN 'malformed' WHEN nr = 'attachment' AND nu = 'candidate' OR nr = 'convert' AND nu = 'attachment' THEN 'role_mismatch' WHEN i % 41 = 0 THEN 'stale' WHEN nu <> 'held' AND NOT stored THEN 'original_missing'
  WHEN evaluation THEN 'evaluation_is_final' WHEN nu = 'candidate' AND (status <> 'extracted' OR kind IN ('image', 'zip') OR NOT parser_current OR incomplete) THEN 'source_unusable' WHEN i % 43 = 0 THEN 'processing'
  WHEN nu = 'candidate' AND privacy_flag AND i % 2 = 1 THEN 'privacy_note' WHEN nu = 'candidate' AND ck = 'mixed' AND i % 2 = 1 THEN 'boundary_unconfirmed' ELSE 'accepted' END AS verdict FROM t"""),
    "aliases_again": (aliases_again, f"WITH {FILES}, s AS (SELECT DISTINCT sha, notice_id AS o FROM f WHERE i % 12 = 1) SELECT DISTINCT notice_id FROM f JOIN s USING (sha) WHERE notice_id <> o"),
    "ended_approvals": (ended_approvals, f"WITH {FILES}, {CRC} SELECT DISTINCT notice_id FROM f JOIN crcs USING (notice_id) WHERE i % 6 = 1 AND i % 5 = 0 AND n % 2 = 0"),
}
