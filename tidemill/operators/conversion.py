"""Conversion of notices into pages: registration, file roles, blocks, warnings, revisions and decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions import ids, text
from tidemill.operators.curation import LAYOUTS

#: Titles that begin a form, words of a form's fields and of a masthead (fixed values).
FORM_TITLE = r"^(?:[\p{L}\p{N}_ ·ㆍ:()\-]{0,70})?(?:희망 신청서|희망신청서|참가 신청서|참가신청서|동의서|신청서)\s*$"
FORM_FIELDS, MASTHEAD = ("지원자", "성명", "보호자", "서명", "신청자"), "가정통신문"
ROLES, SCOPES, ACTIONS = ("convert", "attachment"), ("auto", "notice", "mixed"), ("approved", "held", "rejected", "candidate")
REASONS = ("unconfirmed", "missing", "table", "readability", "role", "incomplete", "other")
#: Warnings that no approval passes over (fixed values).
BLOCKING = ("needs_vision", "needs_parser", "parse_error", "incomplete", "boundary", "empty", "no_guide")
MOST_BLOCKS, MOST_CELLS, MOST_ROWS, MOST_COLS, MOST_START = 2000, 10_000, 1000, 200, 2000
MOST_FILES, MOST_UPLOAD, MASTHEAD_CHARS = 10, 50 << 20, 150

FILE = "struct<file_id:string,sha256:string,filename:string,kind:string,role:string,scope:string,form_start:int,boundary_confirmed:boolean,incomplete:boolean>"


def file_entry(file_id: Column, sha256: Column, filename: Column, kind: Column, role: Column) -> Column:
    """A file of a notice as it is first registered."""
    values = (file_id, sha256, filename, kind, role, F.lit("auto"), F.lit(None).cast("int"), F.lit(False), F.lit(False))
    names = ("file_id", "sha256", "filename", "kind", "role", "scope", "form_start", "boundary_confirmed", "incomplete")
    return F.struct(*[v.alias(n) for v, n in zip(values, names)])


def registered(notices: DataFrame, stored: DataFrame, evaluation: DataFrame) -> DataFrame:
    """origin, mobile_id, files and split of every notice once registered; registering again changes nothing but the split.

    `notices` has notice_id, body (its html) and assets (array of sha256, filename, kind); `stored` has origin, mobile_id,
    files and split; `evaluation` the notice_ids with a case in the evaluation split. The body, if it is not blank, is the
    first file, then come the assets, forms by their names as attachments. A notice in evaluation is so as a whole, for good.
    """
    body = F.when(F.trim(F.coalesce("body", F.lit(""))) != "", F.array(file_entry(F.lit("body"), F.sha2("body", 256), F.lit("게시글 본문.html"), F.lit("html"), F.lit("convert"))))
    assets = F.transform(F.coalesce("assets", F.array().cast("array<struct<sha256:string,filename:string,kind:string>>")), lambda a, i: file_entry(
        i.cast("string"), a["sha256"], a["filename"], F.coalesce(a["kind"], F.lit("unsupported")), text.default_role(F.coalesce(a["filename"], F.lit("")))))
    files = F.concat(F.coalesce(body, F.array().cast(f"array<{FILE}>")), assets)
    new = notices.select(F.col("notice_id").alias("origin"), ids.collected_id(F.col("notice_id").cast("string")).alias("__id"), files.alias("__files"))
    held = evaluation.select(F.col("notice_id").alias("origin")).distinct().withColumn("__eval", F.lit(True))
    both = new.join(stored, "origin", "left").join(held, "origin", "left")
    return both.select("origin", F.coalesce("mobile_id", "__id").alias("mobile_id"), F.when(F.col("mobile_id").isNull(), F.col("__files")).otherwise(F.col("files")).alias("files"),
                       F.when(F.col("__eval"), "eval").otherwise(F.coalesce("split", F.lit("train"))).alias("split"))


def file_roles(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files (notice_id, file_id, role, scope, form_start) after an operator's edits, with error: null or the first rule broken.

    An edit gives role, scope, form_start (text) or none of them; boundary_confirmed and incomplete are false unless it says
    otherwise.
    """
    keys = ["notice_id", "file_id"]
    own = edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("role", "scope", "form_start", "boundary_confirmed", "incomplete")])
    both = files.join(own, keys, "left")
    role, scope = F.coalesce("__role", "role"), F.coalesce("__scope", "scope", F.lit("auto"))
    given = F.nullif(F.coalesce("__form_start", F.col("form_start").cast("string")), F.lit(""))
    start = given.try_cast("int")
    error = (
        F.when(~role.isin(*ROLES), "bad_role").when(~scope.isin(*SCOPES), "bad_scope")
        .when(given.isNotNull() & ~F.coalesce(start.between(0, MOST_START), F.lit(False)), "bad_form_start")
    )
    return both.select(*keys, role.alias("role"), scope.alias("scope"), start.alias("form_start"), F.coalesce("__boundary_confirmed", F.lit(False)).alias("boundary_confirmed"),
                       F.coalesce("__incomplete", F.lit(False)).alias("incomplete"), error.alias("error"))


def attached(notices: DataFrame, uploads: DataFrame) -> DataFrame:
    """mobile_id, verdict and files of notices that files were uploaded to.

    `uploads` has mobile_id, seen_revision, place, sha256, filename, kind, size and error (of the file itself). All uploads of
    a notice are taken or none: its latest revision must have been seen, nothing be under way, and number and size be within
    the limits. New files are attachments.
    """
    entry = file_entry(F.substring(F.sha2(F.concat_ws(":", "mobile_id", "place"), 256), 1, 12), F.col("sha256"), F.col("filename"), F.col("kind"), F.lit("attachment"))
    new = uploads.groupBy("mobile_id").agg(
        F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))).alias("__new"), F.sum("size").alias("__size"), F.max(F.coalesce("seen_revision", F.lit(""))).alias("__seen"), F.max("error").alias("__error"))
    both = notices.join(new, "mobile_id")
    stale = (F.coalesce("latest_revision", F.lit("")) != F.col("__seen")) | (F.col("state") == "processing")
    verdict = F.when(stale, "stale").when((F.size("files") + F.size("__new") > MOST_FILES) | (F.col("__size") > MOST_UPLOAD), "too_much").otherwise(F.coalesce("__error", F.lit("accepted")))
    files = F.when(verdict == "accepted", F.concat("files", F.transform("__new", lambda s: s["e"]))).otherwise(F.col("files"))
    return both.select("mobile_id", verdict.alias("verdict"), files.alias("files"))


def conversion(files: DataFrame, flow: DataFrame, tables: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, excluded, warnings) of notices from the ordered flow of the files that are converted.

    `files` has notice_id, file_id, filename, role, scope, form_start, boundary_confirmed, incomplete, status; `flow` has
    notice_id, file_id, place, type, text (of a table, its cells' texts) and table_id; `tables` has table_id, layout,
    structure_key, unfolded and uncertain; `rules` has structure_key, layout and notice_id. A paragraph that is the file's
    name after short paragraphs with a masthead is the title, these are source information. From the form's start on (given,
    else the first form title or table of form fields, unless the whole file is a notice) blocks are excluded. A table takes
    the layout of another notice's approved rule for its structure. Decorative paragraphs are excluded before.
    """
    keys = ["notice_id", "file_id"]
    used = files.filter("role = 'convert'")
    tight = lambda c: F.regexp_replace(c, rf"{ids.BLANK}+", "")
    rows = flow.join(used.select(*keys, "filename", "scope", "form_start", "boundary_confirmed"), keys)
    ornament = (F.col("type") == "paragraph") & text.is_decorative(F.col("text"))
    filled = F.col("text").rlike(rf"[^{ids.BLANK[1:]}")
    shown = rows.filter(~ornament & filled)
    fields = sum((F.col("text").contains(w).cast("int") for w in FORM_FIELDS[1:]), F.col("text").contains(FORM_FIELDS[0]).cast("int"))
    form = F.when(F.col("type") == "table", fields >= 3).otherwise(ids.strip(F.col("text")).rlike(FORM_TITLE))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    titled = (F.col("type") == "paragraph") & (tight(F.col("text")) == tight(stem))
    firsts = shown.groupBy(*keys).agg(F.min(F.when(form, F.col("place"))).alias("__form"), F.min(F.when(titled, F.col("place"))).alias("__title"))
    placed = shown.join(firsts, keys)
    before = F.col("place") < F.col("__title")
    heads = placed.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.when(before, (F.col("type") == "paragraph") & (F.length("text") < MASTHEAD_CHARS))), F.lit(False)).alias("__short"),
        F.coalesce(F.bool_or(F.when(before, tight(F.col("text")).contains(MASTHEAD))), F.lit(False)).alias("__named"))
    placed = placed.join(heads, keys)
    masthead = F.col("__short") & F.col("__named")
    start = F.coalesce("form_start", F.when(F.col("scope") != "notice", F.col("__form")))
    placement = F.when(masthead & before, "source_info").when(masthead & (F.col("place") == F.col("__title")), "title")
    placed = placed.withColumns({"placement": placement, "start": start})

    inside = placed.filter(F.col("start").isNull() | (F.col("place") < F.col("start")))
    own = tables.select("table_id", F.col("layout").alias("__layout"), "structure_key", "unfolded", "uncertain")
    known = rules.select(F.col("structure_key").alias("__key"), F.col("layout").alias("__rule"), F.col("notice_id").alias("__origin"))
    with_tables = inside.join(own, "table_id", "left")
    ruled = with_tables.join(known, (with_tables["structure_key"] == known["__key"]) & (F.col("structure_key") != "") & (with_tables["notice_id"] != known["__origin"]), "left")
    layout = F.when(F.col("type") == "table", F.coalesce("__rule", F.when(F.col("unfolded"), F.lit("grade_cards")), "__layout"))
    method = F.when(F.col("__rule").isNotNull(), "approved-structure-only").when(F.col("unfolded"), "fixed-component")
    blocks = ruled.select(*keys, "place", F.concat_ws(":", "file_id", "place").alias("block_id"), "type", "text", "table_id", "placement", layout.alias("layout"), method.alias("method"), F.col("__origin").alias("rule_origin"))

    cut = placed.filter(F.col("start").isNotNull() & (F.col("place") >= F.col("start"))).select(*keys, "place", F.lit("form").alias("reason"))
    excluded = cut.unionByName(rows.filter(ornament & filled).select(*keys, "place", F.lit("decorative").alias("reason")))

    no_file = F.lit(None).cast("string").alias("file_id")
    bounds = used.join(firsts, keys, "left").withColumn("start", F.coalesce("form_start", F.when(F.col("scope") != "notice", F.col("__form"))))
    seen = ruled.filter(F.coalesce(F.col("uncertain"), F.lit(False))).select(*keys, F.lit("geometry").alias("code"))
    notices = files.groupBy("notice_id").agg(F.bool_or(F.col("role") == "convert").alias("any"))
    nonempty = blocks.select("notice_id").distinct().withColumn("full", F.lit(True))
    warnings = (
        used.filter("status <> 'extracted'").select(*keys, F.col("status").alias("code"))
        .unionByName(used.filter("incomplete").select(*keys, F.lit("incomplete").alias("code")))
        .unionByName(bounds.filter("(start is null and scope = 'mixed') or (start is not null and not boundary_confirmed)").select(*keys, F.lit("boundary").alias("code")))
        .unionByName(seen.distinct())
        .unionByName(notices.filter("not any").select("notice_id", no_file, F.lit("no_guide").alias("code")))
        .unionByName(notices.join(nonempty, "notice_id", "left").filter("full is null").select("notice_id", no_file, F.lit("empty").alias("code")))
    )
    return blocks, excluded, warnings


def blocks_error(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """revision_id and error of submitted blocks: the first rule broken, null if none.

    `blocks` has revision_id, place, type, text, layout, rows, cols; `cells` has revision_id, place, row, col, rowspan,
    colspan, text of the tables among them.
    """
    squares = cells.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.greatest(F.least("rowspan", F.lit(MOST_ROWS)), F.lit(1)) - 1)))
    squares = squares.withColumn("c", F.explode(F.sequence("col", F.col("col") + F.greatest(F.least("colspan", F.lit(MOST_COLS)), F.lit(1)) - 1)))
    twice = squares.groupBy("revision_id", "place", "r", "c").count().filter("count > 1").select("revision_id").distinct().withColumn("overlap", F.lit(True))
    sized = cells.join(blocks.select("revision_id", "place", "rows", "cols"), ["revision_id", "place"])
    out = (F.col("row") < 0) | (F.col("col") < 0) | (F.col("rowspan") < 1) | (F.col("colspan") < 1) | (F.col("row") + F.col("rowspan") > F.col("rows")) | (F.col("col") + F.col("colspan") > F.col("cols"))
    per_table = sized.groupBy("revision_id", "place").agg(F.count("*").alias("n"), F.bool_or(out).alias("out"), F.bool_or(F.col("text").isNull()).alias("blank"))
    bad = per_table.groupBy("revision_id").agg(F.max("n").alias("most"), F.bool_or("out").alias("out"), F.bool_or("blank").alias("blank"))
    is_table = F.col("type") == "table"
    own = blocks.groupBy("revision_id").agg(
        F.count("*").alias("blocks"), F.bool_or(~F.coalesce(F.col("type").isin("paragraph", "table"), F.lit(False))).alias("kind"), F.bool_or((F.col("type") == "paragraph") & F.col("text").isNull()).alias("mute"),
        F.bool_or(is_table & ~F.coalesce(F.col("layout").isin(*LAYOUTS), F.lit(False))).alias("layout"),
        F.bool_or(is_table & ~F.coalesce(F.col("rows").between(1, MOST_ROWS) & F.col("cols").between(1, MOST_COLS), F.lit(False))).alias("extent"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    error = (
        F.when(F.col("blocks") > MOST_BLOCKS, "too_many_blocks").when(no("kind"), "unknown_type").when(no("mute"), "no_text").when(no("layout"), "unknown_layout").when(no("extent"), "bad_extent")
        .when(F.coalesce("most", F.lit(0)) > MOST_CELLS, "too_many_cells").when(no("blank"), "no_text").when(no("out"), "bad_span").when(no("overlap"), "overlap")
    )
    return own.join(bad, "revision_id", "left").join(twice, "revision_id", "left").select("revision_id", error.alias("error"))


def corrections(events: DataFrame, notices: DataFrame) -> DataFrame:
    """verdict of each submitted correction (mobile_id, seen_revision, error of its blocks) on the notices' current state, and the title it leaves."""
    both = events.join(notices.select("mobile_id", "latest_revision", "state", F.col("title").alias("__title")), "mobile_id", "left")
    stale = F.col("latest_revision").isNull() | (F.col("seen_revision") != F.col("latest_revision")) | (F.col("state") == "processing")
    title = F.coalesce(F.nullif(F.substring(F.trim(F.coalesce("title", F.lit(""))), 1, 300), F.lit("")), F.col("__title"))
    return both.select(*[c for c in events.columns if c != "title"], title.alias("title"), F.when(stale, "stale").otherwise(F.coalesce("error", F.lit("accepted"))).alias("verdict"))


def decisions(events: DataFrame, notices: DataFrame, warnings: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(each decision with its verdict, mobile_id, state and approved_revision of the notices that an accepted one is on).

    Events have mobile_id, seen_revision, action, reason, reviewer, compared, rights, privacy; `notices` has mobile_id,
    latest_revision, state; `warnings` mobile_id and code, of the latest revision. An approval needs the three confirmations
    and none of the BLOCKING warnings; any other action ends an approval.
    """
    blocked = warnings.filter(F.col("code").isin(*BLOCKING)).select("mobile_id").distinct().withColumn("__blocked", F.lit(True))
    both = events.join(notices.select("mobile_id", "latest_revision", F.col("state").alias("__state")), "mobile_id", "left").join(blocked, "mobile_id", "left")
    good = F.col("action") == "approved"
    verdict = (
        F.when(F.col("latest_revision").isNull() | (F.col("seen_revision") != F.col("latest_revision")) | (F.col("__state") == "processing"), "stale")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS) & F.coalesce("reason", F.lit("unconfirmed")).isin(*REASONS), F.lit(False)), "unknown_action")
        .when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "no_reviewer")
        .when(good & ~(F.col("compared") & F.col("rights") & F.col("privacy")), "unconfirmed").when(good & F.col("__blocked"), "blocked").otherwise("accepted")
    )
    judged = both.withColumn("verdict", verdict).drop("__blocked", "__state")
    last = judged.filter("verdict = 'accepted'").groupBy("mobile_id").agg(F.max_by(F.struct("action", "seen_revision"), F.struct(*order)).alias("e"))
    return judged, last.select("mobile_id", F.col("e.action").alias("state"), F.when(F.col("e.action") == "approved", F.col("e.seen_revision")).alias("approved_revision"))


def approved_rules(notices: DataFrame, revisions: DataFrame, blocks: DataFrame, allowed: DataFrame, parser: str, converter: str) -> DataFrame:
    """structure_key, layout, notice_id, revision_id and block_id from tables of approved notices; the last by (mobile_id, place) counts.

    Only notices whose latest revision is the approved one, outside evaluation, that may be reused, and whose revision was
    made by the current parser and converter.
    """
    good = notices.filter("state = 'approved' and latest_revision = approved_revision and split <> 'eval'").join(allowed.select("mobile_id"), "mobile_id", "left_semi")
    current = revisions.filter((F.col("parser") == parser) & (F.col("converter") == converter)).select("revision_id")
    rows = good.select("mobile_id", F.col("approved_revision").alias("revision_id")).join(current, "revision_id", "left_semi").join(blocks.filter("structure_key <> ''"), "revision_id")
    last = rows.groupBy("structure_key").agg(F.max_by(F.struct(F.coalesce("layout", F.lit("scroll_table")).alias("layout"), "mobile_id", "revision_id", "block_id"), F.struct("mobile_id", "place")).alias("r"))
    return last.select("structure_key", "r.layout", F.col("r.mobile_id").alias("notice_id"), "r.revision_id", "r.block_id")


def queued(notices: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their verdict, notices after them): a request for the seen latest revision sets its notice to processing
    and ends its approval; one for an older revision, or while a conversion runs, is stale."""
    both = requests.join(notices.select("mobile_id", "latest_revision", "state"), "mobile_id", "left")
    stale = F.col("state").isNull() | (F.col("state") == "processing") | (F.coalesce("latest_revision", F.lit("")) != F.coalesce("seen_revision", F.lit("")))
    judged = both.withColumn("verdict", F.when(stale, "stale").otherwise("accepted")).drop("latest_revision", "state")
    taken = judged.filter("verdict = 'accepted'").select("mobile_id").distinct().withColumn("__t", F.lit(True))
    after = notices.join(taken, "mobile_id", "left")
    changes = {"state": F.when(F.col("__t"), "processing").otherwise(F.col("state")), "approved_revision": F.when(F.col("__t").isNull(), F.col("approved_revision"))}
    return judged, after.withColumns(changes).drop("__t")


def outdated(notices: DataFrame, revisions: DataFrame, parser: str, converter: str) -> DataFrame:
    """Notices not under way whose latest revision an older parser or converter made."""
    old = revisions.filter((F.col("parser") != parser) | (F.col("converter") != converter)).select(F.col("revision_id").alias("latest_revision"))
    return notices.filter("state <> 'processing'").join(old, "latest_revision", "left_semi")


def still_current(citations: DataFrame, notices: DataFrame) -> DataFrame:
    """Citations (mobile_id, revision_id) of an approval that still holds."""
    held = notices.filter("state = 'approved'").select("mobile_id", F.col("approved_revision").alias("revision_id"))
    return citations.join(held, ["mobile_id", "revision_id"], "left_semi")
