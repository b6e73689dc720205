"""State of the classified corpus: descriptors, overrides, operator decisions, reuse gates and its queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions import ids, text
from tidemill.operators import rules

MOST_BODY = 500_000
STALE_MINUTES = 2
FLAGS = ("kind", "status", "parser_current", "evaluation", "incomplete", "privacy_flag")


def reserved(files: DataFrame, decisions: DataFrame, uploads: DataFrame) -> DataFrame:
    """sha256 of every file content reserved for evaluation: by an operator's decision on any notice, or by an upload in evaluation.

    `files` has notice_id, file_id, sha256; `decisions` notice_id, file_id, action, use; `uploads` sha256 and split.
    """
    marked = decisions.filter("action = 'operator_decision' and use = 'evaluation'").select("notice_id", "file_id").distinct()
    return files.join(marked, ["notice_id", "file_id"], "left_semi").select("sha256").unionByName(uploads.filter("split = 'eval'").select("sha256")).distinct()


def evaluation_notices(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """notice_id of every notice with a case in the evaluation split or an operator's decision for evaluation."""
    return cases.filter("split = 'eval'").select("notice_id").unionByName(decisions.filter("action = 'operator_decision' and use = 'evaluation'").select("notice_id")).distinct()


def descriptors(files: DataFrame, results: DataFrame, evaluation: DataFrame, reserved_: DataFrame, parser: str) -> DataFrame:
    """Files with what their classification rests on: status, text, parser, and the flags of FLAGS.

    `files` has notice_id, file_id, sha256, filename, kind, stored (whether its content is there), capture (of the notice),
    incomplete and body_length (of a body, else null); `results` has sha256, parser, status and text of extractions. Missing
    content has status missing; content without a result needs a parser, an image vision. A body beyond MOST_BODY characters
    was read in part.
    """
    held = evaluation.select("notice_id").distinct().withColumn("__eval", F.lit(True))
    same = reserved_.select("sha256").distinct().withColumn("__same", F.lit(True))
    found = results.select("sha256", F.col("parser").alias("__parser"), F.col("status").alias("__status"), F.col("text").alias("__text"))
    both = files.join(found, "sha256", "left").join(held, "notice_id", "left").join(same, "sha256", "left")
    unread = F.when(F.col("kind") == "image", "needs_vision").otherwise("needs_parser")
    body = F.coalesce("__text", F.lit(""))
    return both.withColumns({
        "status": F.when(~F.col("stored"), "missing").otherwise(F.coalesce("__status", unread)), "text": F.when(F.col("stored"), body).otherwise(""),
        "parser": F.when(F.col("stored"), F.coalesce("__parser", F.lit(""))).otherwise(""), "parser_current": F.col("stored") & F.coalesce(F.col("__parser") == parser, F.lit(False)),
        "evaluation": F.col("__eval").isNotNull() | F.col("__same").isNotNull(),
        "incomplete": F.coalesce("incomplete", F.lit(False)) | F.coalesce(F.col("capture") == "partial_capture", F.lit(False)) | F.coalesce(F.col("body_length") > MOST_BODY, F.lit(False)),
        "privacy_flag": F.col("stored") & text.has_pii(body),
    }).drop("__eval", "__same", "__parser", "__status", "__text")


def settled(files: DataFrame, version: str) -> DataFrame:
    """Classified descriptors with their stamp; a mixed file whose boundary an operator confirmed is no longer held for it.

    Wants the columns of rules.classify's result, and scope, form_start and boundary_confirmed.
    """
    sure = (F.col("content_kind") == "mixed") & F.coalesce("boundary_confirmed", F.lit(False)) & F.col("form_start").isNotNull()
    left = F.filter("reasons", lambda r: r != "boundary_unconfirmed")
    clean = sure & (F.size(left) == 0) & (F.col("status") == "extracted") & F.col("parser_current") & ~F.col("incomplete") & ~F.col("privacy_flag")
    out = files.withColumns({
        "use": F.when(clean, "candidate").otherwise(F.col("use")), "reasons": F.when(clean, F.array(F.lit("rights_unreviewed"))).when(sure, left).otherwise(F.col("reasons"))})
    return out.withColumn("stamp", ids.source_stamp(F.col("sha256"), F.struct(*FLAGS), F.col("parser"), version, F.struct("scope", "form_start", "boundary_confirmed")))


def effective(files: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their effective role and use, and overridden; the overrides that a changed source ended).

    `previous` has notice_id, file_id, stamp, override_role and override_use (null without one). An override holds while the
    stamp is equal; evaluation forces the use whatever an override says.
    """
    keys = ["notice_id", "file_id"]
    before = previous.select(*keys, F.col("stamp").alias("__stamp"), F.col("override_role").alias("__role"), F.col("override_use").alias("__use"))
    both = files.join(before, keys, "left")
    holds = F.coalesce((F.col("__stamp") == F.col("stamp")) & F.col("__use").isNotNull(), F.lit(False))
    use = F.when(F.col("evaluation"), "evaluation").when(holds, F.col("__use")).otherwise(F.col("use"))
    out = both.withColumns({"overridden": holds, "effective_role": F.when(holds, F.col("__role")).otherwise(F.col("role")), "effective_use": use})
    ended = out.filter(F.col("__use").isNotNull() & ~F.col("overridden")).select(*keys, F.lit("source_changed").alias("action"), F.col("__use").alias("use"))
    return out.drop("__stamp", "__role", "__use"), ended


def records(files: DataFrame, version: str) -> DataFrame:
    """notice_id, use, files and fingerprint of each notice from its files' effective roles and uses."""
    uses = rules.notice_use(files.select("notice_id", F.col("effective_role").alias("role"), F.col("effective_use").alias("use")))
    parts = F.collect_list(F.struct("file_id", "sha256", "stamp", "effective_role", "effective_use"))
    prints = files.groupBy("notice_id").agg(ids.record_fingerprint(parts, version).alias("fingerprint"))
    return uses.join(prints, "notice_id")


def decided(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """verdict of each operator decision on a file: accepted, or the code of the first rule it breaks.

    As rules.check_decisions, and beside it: the content must be stored for any use of it, a candidate must be read by the
    current parser as a whole, nothing may be under way, and a mixed file needs its boundary confirmed.
    """
    plain = rules.check_decisions(decisions, current)
    use = F.col("new_use")
    missing = use.isin("candidate", "attachment") & ~F.coalesce("stored", F.lit(False))
    partly = (use == "candidate") & (~F.coalesce("parser_current", F.lit(False)) | F.coalesce("incomplete", F.lit(False)))
    mixed = (use == "candidate") & (F.col("content_kind") == "mixed") & ~F.coalesce("boundary_confirmed", F.lit(False))
    early = F.col("verdict").isin("malformed", "role_mismatch", "stale")
    verdict = (
        F.when(early, F.col("verdict")).when(missing, "original_missing").when(F.col("verdict") == "evaluation_is_final", F.col("verdict"))
        .when((F.col("verdict") == "source_unusable") | partly, "source_unusable").when(F.col("state") == "processing", "processing").when(F.col("verdict") != "accepted", F.col("verdict"))
        .when(mixed, "boundary_unconfirmed").otherwise("accepted")
    )
    return plain.withColumn("verdict", verdict)


def consequences(accepted: DataFrame, files: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notices to classify again: the others that hold a content now reserved; notices whose approval a changed role ends).

    `accepted` has notice_id, file_id, new_role, new_use; `files` notice_id, file_id, sha256, role; `notices` notice_id and
    latest_revision.
    """
    own = accepted.join(files, ["notice_id", "file_id"])
    shared = own.filter("new_use = 'evaluation'").select("sha256", F.col("notice_id").alias("__by")).distinct()
    again = files.join(shared, "sha256").filter(F.col("notice_id") != F.col("__by")).select("notice_id").distinct()
    ended = own.filter("new_role <> role").select("notice_id").distinct().join(notices.filter("latest_revision is not null").select("notice_id"), "notice_id", "left_semi")
    return again, ended


def allowed_cases(cases: DataFrame, files: DataFrame, notices: DataFrame, evaluation: DataFrame, reserved_: DataFrame, candidates: bool = False) -> DataFrame:
    """case_id of the cases whose tables may be reused.

    Not in evaluation, on a classified notice that is neither excluded nor in evaluation, and every file the case is from
    (by file_id or content) is a converted candidate of no reserved content. A file held for short text alone passes too, if
    it was read whole by the current parser, holds no personal data and no override, for approved cases, or for all with
    `candidates`. `files` has effective_role, effective_use, overridden, reasons and the flags of FLAGS.
    """
    bad = reserved_.select("sha256").distinct().withColumn("__bad", F.lit(True))
    notice = notices.filter("use <> 'excluded'").select("notice_id").join(evaluation.select("notice_id"), "notice_id", "left_anti")
    open_ = cases.filter("split <> 'eval'").join(notice, "notice_id", "left_semi")
    marked = files.join(bad, "sha256", "left")
    short = (
        (F.col("effective_use") == "held") & (F.concat_ws(",", "reasons") == "insufficient_text") & ~F.col("overridden") & (F.col("status") == "extracted") & F.col("parser_current")
        & ~F.col("incomplete") & ~F.col("privacy_flag") & ~F.col("evaluation"))
    fine = (F.col("effective_role") == "convert") & (F.col("effective_use") == "candidate")
    own = marked.select("notice_id", "file_id", "sha256", (fine & F.col("__bad").isNull()).alias("__fine"), (short & F.col("__bad").isNull()).alias("__short"))
    by_id = open_.select("case_id", "notice_id", "approved", F.col("source").alias("file_id")).join(own, ["notice_id", "file_id"])
    by_sha = open_.select("case_id", "notice_id", "approved", F.col("source").alias("sha256")).join(own, ["notice_id", "sha256"])
    both = by_id.select("case_id", "approved", "__fine", "__short").unionByName(by_sha.select("case_id", "approved", "__fine", "__short"))
    return both.groupBy("case_id").agg(F.bool_and(F.col("__fine") | (F.col("__short") & (F.col("approved") | F.lit(candidates)))).alias("ok")).filter("ok").select("case_id")


def allowed_notices(notices: DataFrame, files: DataFrame, reserved_: DataFrame, corpus: DataFrame, corpus_files: DataFrame, evaluation: DataFrame) -> DataFrame:
    """mobile_id of converted notices that may feed rules: none of their contents is reserved; a collected one is a candidate; an
    uploaded one shares no content with a notice in evaluation. `notices` has mobile_id and origin (null for uploads)."""
    bad = files.join(reserved_.select("sha256").distinct(), "sha256", "left_semi").select("mobile_id")
    shared = corpus_files.join(corpus.filter("use = 'evaluation'").select("notice_id"), "notice_id", "left_semi").join(evaluation.select("notice_id"), "notice_id", "left_semi").select("sha256").distinct()
    touched = files.join(shared, "sha256", "left_semi").select("mobile_id")
    collected = notices.filter("origin is not null").join(corpus.filter("use = 'candidate'").select(F.col("notice_id").alias("origin")), "origin", "left_semi")
    uploaded = notices.filter("origin is null").join(touched, "mobile_id", "left_anti")
    return collected.select("mobile_id").unionByName(uploaded.select("mobile_id")).join(bad, "mobile_id", "left_anti")


def eligible(notices: DataFrame, corpus: DataFrame, allowed: DataFrame) -> DataFrame:
    """Approved notices whose approval is of the latest revision, of candidates outside evaluation, that may be reused."""
    good = notices.filter("state = 'approved' and approved_revision = latest_revision and split <> 'eval'")
    return good.join(corpus.filter("use = 'candidate'").select("mobile_id"), "mobile_id", "left_semi").join(allowed, "mobile_id", "left_semi")


def unclassified(notices: DataFrame, corpus: DataFrame, version: str) -> DataFrame:
    """notice_ids that were never classified, or by other rules than `version`."""
    return notices.select("notice_id").join(corpus.filter(F.col("version") == version).select("notice_id"), "notice_id", "left_anti")


def requeued(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Jobs with those that have run for over `minutes` pending again, without an owner."""
    late = (F.col("status") == "running") & (F.col("updated") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumns({"owner": F.when(~late, F.col("owner")), "status": F.when(late, "pending").otherwise(F.col("status"))})


def restarted(jobs: DataFrame, kind: str) -> DataFrame:
    """Jobs after their worker starts anew: what was running is pending at once, attempts as they were."""
    was = (F.col("kind") == kind) & (F.col("status") == "running")
    return jobs.withColumns({"owner": F.when(~was, F.col("owner")), "status": F.when(was, "pending").otherwise(F.col("status"))})


def outcomes(jobs: DataFrame) -> DataFrame:
    """jobs of each kind and status, and how many are still pending by kind."""
    return jobs.groupBy("kind").agg(*[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint").alias(s) for s in ("pending", "running", "done", "error")])
