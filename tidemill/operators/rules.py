"""File and notice classification, reuse gates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Cues of file names and texts (fixed values).
FORM_CUES = ("신청서", "동의서", "서식", "양식")
REFERENCE_CUES = ("참고자료", "자료집")
GUIDE_CUES = ("안내", "일정", "운영", "공지")
FIELD_WORDS = ("지원자", "보호자", "서명", "성명", "신청자")
BLANK, LEAST_BLANKS, LEAST_FIELDS, LEAST_CHARS, HEADING_CHARS = "___", 2, 3, 10, 15
READABLE = ("html", "pdf", "hwp", "hwpx", "docx")
#: Ends of a line, and white space at either end of a text, as Unicode has them.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
FULL = r"[^\s\p{Z}\x1C-\x1F\x85]"
EDGE = r"^[\s\p{Z}\x1C-\x1F\x85]+|[\s\p{Z}\x1C-\x1F\x85]+$"


def _any(text: Column, cues) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return out


def content_kind(filename: Column, text: Column, form=FORM_CUES, reference=REFERENCE_CUES, guide=GUIDE_CUES, fields=FIELD_WORDS, blank=BLANK) -> Column:
    """guide, form, reference, mixed or unknown by cues of the name, short form headings, blanks and field words."""
    filename, text = F.coalesce(filename, F.lit("")), F.coalesce(text, F.lit(""))
    # Lines are looked at only where the text holds a cue at all, and trimmed only if they hold one themselves.
    lines = F.split(text, LINE_END)
    heading = _any(text, form) & F.exists(lines, lambda x: _any(x, form) & (F.length(F.regexp_replace(x, EDGE, "")) <= HEADING_CHARS))
    filled_out = text.rlike(rf"(?s){FULL}.{{{LEAST_CHARS - 2},}}{FULL}")  # LEAST_CHARS characters from the first to the last that is no blank
    blanks = (F.length(text) - F.length(F.replace(text, F.lit(blank), F.lit("")))) / len(blank)
    named = sum((text.contains(w).cast("int") for w in fields[1:]), text.contains(fields[0]).cast("int"))
    filled = (blanks >= LEAST_BLANKS) | (named >= LEAST_FIELDS)
    says_guide = _any(text, guide)
    return (
        F.when(_any(filename, form) & _any(filename, guide), "mixed").when(says_guide & heading & filled, "mixed")
        .when(_any(filename, form), "form").when(_any(filename, reference), "reference")
        .when(heading & filled & ~says_guide, "form").when(~filled_out, "unknown").otherwise("guide")
    )


def classify(files: DataFrame) -> DataFrame:
    """role, use and reasons of files with content_kind, kind, status and flags; a missing flag is the harmless one.

    Evaluation comes before exclusion, that before a missing original; originals (forms, references) then are attachments,
    and other files are held for any reason there is, else candidates.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(name == "parser_current"))
    kind, status = F.col("content_kind"), F.coalesce("status", F.lit(""))
    original = kind.isin("form", "reference")
    role = F.when(original, "attachment").when(kind == "unknown", "uncertain").otherwise("convert")
    named = F.when(kind == "form", "original_form").when(kind == "reference", "original_reference").when(kind == "mixed", "boundary_unconfirmed").when(kind == "unknown", "insufficient_text")
    holds = F.array_compact(F.array(
        F.when(~flag("parser_current"), "parser_stale"), F.when(flag("incomplete"), "incomplete"), F.when(flag("privacy_flag"), "privacy_review"),
        F.when(status != "extracted", "status_unusable"),
        F.when(~F.coalesce(F.col("kind"), F.lit("")).isin(*READABLE), F.when(F.col("kind") == "image", "needs_vision").otherwise("needs_parser")),
        F.when(kind == "mixed", "boundary_unconfirmed"), F.when(kind == "unknown", "insufficient_text"),
    ))
    held = ~original & (F.size(holds) > 0)
    use = (
        F.when(flag("evaluation"), "evaluation").when(flag("rights_denied") | flag("unrelated"), "excluded").when(status == "missing", "held")
        .when(original, "attachment").when(held, "held").otherwise("candidate")
    )
    one = lambda *codes: F.array(*[F.lit(c) for c in codes])
    why = (
        F.when(flag("evaluation"), one("evaluation")).when(flag("rights_denied"), one("rights_denied")).when(flag("unrelated"), one("unrelated"))
        .when(status == "missing", one("original_missing")).when(original, F.array().cast("array<string>")).when(held, holds).otherwise(one("rights_unreviewed"))
    )
    return files.withColumns({"role": role, "use": use, "reasons": F.array_distinct(F.concat(F.array_compact(F.array(named)), why))})


def notice_use(files: DataFrame, key: str = "notice_id") -> DataFrame:
    """use of each notice from role and use of its files: evaluation, excluded, held, candidate, attachment, in this order."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    use, role = F.col("use"), F.col("role")
    out = files.groupBy(key).agg(
        F.when(has(use == "evaluation"), "evaluation").when(has((use == "excluded") & (role != "attachment")), "excluded")
        .when(has((role == "uncertain") | (use == "held")), "held").when(has(use == "candidate"), "candidate")
        .when(has(use == "attachment"), "attachment").otherwise("held").alias("use"), F.count("*").alias("files"))
    return out


def reserved_files(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """sha256 of every file that an operator reserved for evaluation anywhere."""
    return decisions.filter(F.col("use") == "evaluation").join(files, ["notice_id", "file_id"]).select("sha256").distinct()


def leaked(files: DataFrame, reserved: DataFrame) -> DataFrame:
    """Files outside evaluation whose content is reserved."""
    return files.filter(F.col("use") != "evaluation").join(reserved, "sha256", "left_semi")


def allowed_notices(files: DataFrame, reserved: DataFrame) -> DataFrame:
    """notice_ids all of whose files may be reused: convert and candidate, or held only for short text, and none reserved."""
    narrow = (F.col("use") == "held") & (F.concat_ws(",", "reasons") == "insufficient_text") & (F.col("status") == "extracted")
    fine = ((F.col("role") == "convert") & (F.col("use") == "candidate")) | narrow
    marked = files.join(reserved.withColumn("__r", F.lit(True)), "sha256", "left").withColumn("__ok", fine & F.col("__r").isNull())
    return marked.groupBy("notice_id").agg(F.bool_and("__ok").alias("ok")).filter("ok").select("notice_id")


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key: one struct maximum, combined before the shuffle, instead of a sort of each group."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__e")).select(*keys, "__e.*")


def check_decisions(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """verdict of each operator decision on a file: accepted, or the code of the first rule it breaks."""
    d = decisions.join(current, ["notice_id", "file_id"], "left")
    use, role = F.col("new_use"), F.col("new_role")
    verdict = (
        F.when(~role.isin("convert", "attachment") | ~use.isin("candidate", "attachment", "held", "excluded", "evaluation") | (F.trim("reviewer") == ""), "malformed")
        .when(((role == "attachment") & (use == "candidate")) | ((role == "convert") & (use == "attachment")), "role_mismatch")
        .when(F.col("fingerprint").isNull() | (F.col("seen_fingerprint") != F.col("fingerprint")), "stale")
        .when(F.col("evaluation") & (use != "evaluation"), "evaluation_is_final")
        .when((use == "candidate") & ((F.col("status") != "extracted") | ~F.col("kind").isin(*READABLE)), "source_unusable")
        .when((use == "candidate") & F.col("privacy_flag") & ~(F.col("privacy_checked") & (F.trim("note") != "")), "privacy_note")
        .otherwise("accepted")
    )
    return d.withColumn("verdict", verdict)


def suggestions(tables: DataFrame, approved: DataFrame) -> DataFrame:
    """layout of tables whose pattern was approved in exactly one layout; a suggestion is no approval."""
    one = approved.groupBy("pattern").agg(F.min("layout").alias("suggested"), F.max("layout").alias("__hi")).filter(F.col("suggested") == F.col("__hi")).drop("__hi")
    return tables.join(one, "pattern", "left")


def approved_rules(blocks: DataFrame, order: list[str]) -> DataFrame:
    """layout for each structure key from approved blocks, the last by `order` where they differ."""
    good = blocks.filter((F.col("state") == "approved") & (F.col("revision") == F.col("approved_revision")) & (F.col("split") != "eval") & (F.col("structure_key") != ""))
    return good.groupBy("structure_key").agg(F.max_by(F.struct("layout", "notice_id"), F.struct(*order)).alias("r")).select("structure_key", "r.layout", "r.notice_id")


def fold_reviews(events: DataFrame, order: list[str]) -> DataFrame:
    """State of each case after its review events: the last status, approved while it is that, the last correction and layout given."""
    place = F.struct(*order)
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))
    out = events.groupBy("case_id").agg(F.max_by("status", place).alias("status"), given("correction").alias("correction"), given("layout").alias("layout"), F.count("*").alias("history"))
    return out.withColumn("approved", F.col("status") == "approved")
