"""Cases of tables: learning, the review queue, review decisions, exports and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions import ids, text
from tidemill.operators import grids

#: Scores of the review queue (fixed values).
NEW_FAMILY, FEW_APPROVED, RISKY, MERGED, THIN_OFFICE, PRIVATE = 100, 50, 40, 30, 20, 10
FEW, THIN = 3, 5
#: What each score is given for (fixed values).
REASONS = ("신규 양식", "승인 사례 부족", "날짜·금액·대상 확인 필요", "병합 셀", "부족 지역", "개인정보 검토")
LAYOUTS = ("read_only_form", "grade_cards", "timeline", "key_value_cards", "scroll_table")
STATUSES = ("approved", "rejected", "held", "candidate")
MOST_NOTE, MOST_QUERY = 500, 200


def review_queue(cases: DataFrame, limit: int = 20) -> DataFrame:
    """case_id, family, office, score and reasons of the `limit` best candidates to review, by score and case_id.

    `cases` has case_id, family, office, review_status, split, approved, body (the table's text), merged and privacy_flag.
    Only candidates outside the evaluation split are queued, but approvals of families and sizes of offices count all cases.
    """
    families = cases.groupBy(F.coalesce("family", F.lit("")).alias("__f")).agg(F.sum(F.col("approved").cast("int")).alias("__approved"))
    offices = cases.groupBy(F.col("office").alias("__o")).agg(F.count("*").alias("__cases"))
    open_ = cases.filter((F.col("review_status") == "candidate") & (F.col("split") != "eval"))
    rows = open_.join(families, F.coalesce("family", F.lit("")) == F.col("__f")).join(offices, F.col("office").eqNullSafe(F.col("__o")))
    known = F.coalesce("__approved", F.lit(0))
    terms = list(zip(REASONS, (
        (known == 0, NEW_FAMILY), ((known > 0) & (known < FEW), FEW_APPROVED), (text.is_risky(F.col("body")), RISKY), (F.col("merged"), MERGED),
        (F.col("__cases") < THIN, THIN_OFFICE), (F.col("privacy_flag"), PRIVATE))))
    score = sum((F.when(hit, points).otherwise(0) for _, (hit, points) in terms), F.lit(0)).cast("bigint")
    reasons = F.array_compact(F.array(*[F.when(hit, reason) for reason, (hit, _) in terms]))
    out = rows.select("case_id", "family", "office", score.alias("score"), reasons.alias("reasons"))
    return out.orderBy(F.desc("score"), "case_id").limit(limit)


def cases_of(cells: DataFrame, tables: DataFrame, approved: DataFrame) -> DataFrame:
    """A case for each table that has cells: case_id, notice_id, source, pattern, layout, method, family, split, body, privacy_flag, merged.

    `tables` has table_id, notice_id, source (body or a file's digest) and table_index. The layout is that of the structure,
    but where approved cases of the pattern agree on one, theirs, as a suggestion. Personal data is masked in `body`, the
    cells' texts in order; the flag says whether there was any.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda s: F.coalesce(s["text"], F.lit("")))
    bodies = cells.groupBy("table_id").agg(F.array_join(texts, "\n").alias("raw"), F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("merged"))
    one = approved.groupBy("pattern").agg(F.min("layout").alias("suggested"), F.max("layout").alias("__hi")).filter(F.col("suggested") == F.col("__hi")).drop("__hi")
    found = tables.join(grids.patterns(cells), "table_id").join(grids.families(cells), "table_id").join(bodies, "table_id").join(one, "pattern", "left")
    return found.select(
        ids.case_id(F.col("notice_id").cast("string"), F.col("source"), F.col("table_index")).alias("case_id"), "notice_id", "source", "table_index", "pattern",
        F.coalesce("suggested", "layout").alias("layout"), F.when(F.col("suggested").isNotNull(), "approved-pattern-suggestion").otherwise("heuristic").alias("method"),
        "family", ids.split_of(F.col("family")).alias("split"), text.mask_pii(F.col("raw")).alias("body"), text.has_pii(F.col("raw")).alias("privacy_flag"), "merged")


def learned(stored: DataFrame, found: DataFrame, parser: str) -> DataFrame:
    """Stored cases after a run that found `found`: new cases enter as candidates, human decisions are frozen.

    A stored candidate takes pattern, layout, family, body and flags anew if the parser or its body changed; its split is
    kept. Cases that were not found again stay as they are. `stored` has the columns of `found`, parser and review_status.
    """
    fresh = [c for c in ("pattern", "layout", "method", "family", "body", "privacy_flag", "merged")]
    kept = [c for c in found.columns if c != "case_id"]
    new = found.select("case_id", *[F.col(c).alias(f"__{c}") for c in kept])
    both = stored.join(new, "case_id", "full")
    is_new = F.col("review_status").isNull()
    again = (F.col("review_status") == "candidate") & F.col("__body").isNotNull() & ((F.col("parser") != parser) | ~F.col("body").eqNullSafe(F.col("__body")))
    columns = [F.when(is_new | (again if c in fresh else F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in kept]
    return both.select("case_id", *columns, F.when(is_new | again, F.lit(parser)).otherwise(F.col("parser")).alias("parser"), F.coalesce("review_status", F.lit("candidate")).alias("review_status"))


def notice_state(results: DataFrame) -> DataFrame:
    """analysis_status (extracted, or partial if any source was not), tables and table_state of each notice from its sources' results."""
    out = results.groupBy("notice_id").agg(F.bool_and(F.col("status") == "extracted").alias("whole"), F.sum("tables").cast("bigint").alias("tables"))
    return out.select("notice_id", F.when(F.col("whole"), "extracted").otherwise("partial").alias("analysis_status"), "tables",
                      F.when(F.col("tables") > 0, "has_table").when(F.col("whole"), "no_table").otherwise("pending").alias("table_state"))


def review_verdict(event: str = "") -> Column:
    """accepted, or the code of the first rule that a review event breaks."""
    at = lambda c: F.col(f"{event}{c}")
    good = at("status") == "approved"
    return (
        F.when(~F.coalesce(at("status").isin(*STATUSES), F.lit(False)), "unknown_status").when(~at("known"), "unknown_case")
        .when(good & (~F.coalesce(at("layout").isin(*LAYOUTS), F.lit(False)) | (F.trim(F.coalesce(at("reviewer"), F.lit(""))) == "")), "layout_or_reviewer")
        .when(good & ~(at("rights_reviewed") & at("privacy_reviewed")), "unconfirmed").otherwise("accepted")
    )


def reviewed(events: DataFrame, cases: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(every event with its verdict, the state of each case after the accepted ones).

    Events have case_id, status, layout, reviewer, rights_reviewed, privacy_reviewed, note, correction and the order's
    columns. The last accepted status counts, approved only while it is that; the last layout and correction given stay; the
    history keeps one entry for each accepted event, its note cut to MOST_NOTE characters.
    """
    known = events.join(cases.select("case_id").distinct().withColumn("__k", F.lit(True)), "case_id", "left").withColumns({"known": F.col("__k").isNotNull()}).drop("__k")
    judged = known.withColumn("verdict", review_verdict()).drop("known")
    place = F.struct(*order)
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))
    state = judged.filter("verdict = 'accepted'").groupBy("case_id").agg(
        F.max_by("status", place).alias("status"), given("layout").alias("layout"), given("correction").alias("correction"), F.max_by(F.trim("reviewer"), place).alias("reviewer"),
        F.count("*").alias("history"), F.max_by(F.substring("note", 1, MOST_NOTE), place).alias("last_note"))
    return judged, state.withColumn("approved", F.col("status") == "approved")


def actor(channel: Column, login: Column, claimed: Column, api_actor: str = "api") -> Column:
    """Who a decision is by: the login of a browser, one fixed name for the interface; a name that a client sends never counts."""
    return F.when(channel == "api", F.lit(api_actor)).when(channel == "browser", F.nullif(F.trim(login), F.lit(""))).otherwise(F.nullif(F.trim(F.when(channel == "console", claimed)), F.lit("")))


def quick_approval(channel: Column, quick: Column) -> tuple[Column, Column]:
    """(whether all three confirmations are implied, the fixed note): a quick approval by a browser login only."""
    implied = quick & (channel == "browser")
    return implied, F.when(implied, "빠른 승인: 원문 대조·이용 권한·개인정보 확인")


def effective_table(extracted: Column, corrected: Column) -> Column:
    """The table to show, search and export: the human correction wins over the extraction."""
    return F.coalesce(corrected, extracted)


def export_candidates(cases: DataFrame, allowed: DataFrame) -> DataFrame:
    """Unapproved cases of train and dev whose notice may be reused, marked as no training input, by case_id."""
    rows = cases.filter(~F.col("approved") & F.col("split").isin("train", "dev")).join(allowed, "case_id", "left_semi")
    return rows.select("case_id", "split", F.col("body").alias("table"), F.lit("unreviewed_not_training_input").alias("learning_permission")).orderBy("case_id")


def export_approved(cases: DataFrame, allowed: DataFrame) -> DataFrame:
    """Approved cases of train and dev, by case_id: the corrected table takes the place of the extracted one, which is kept beside it."""
    rows = cases.filter(F.col("approved") & F.col("split").isin("train", "dev")).join(allowed, "case_id", "left_semi")
    return rows.select("case_id", "split", "layout", effective_table(F.col("body"), F.col("correction")).alias("table"), F.when(F.col("correction").isNotNull(), F.col("body")).alias("extracted_table")).orderBy("case_id")


def search(cases: DataFrame, allowed: DataFrame, query: str, candidates: bool = False, limit: int = 20) -> DataFrame:
    """The first `limit` cases by case_id whose table or correction holds the query, %, _ and backslashes being themselves.

    Approved cases only, unless candidates are asked for; evaluation never. As the cut comes before the gate, fewer may come
    out. The case of A-Z does not count.
    """
    if len(query) > MOST_QUERY:
        raise ValueError("query too long")
    held = text.like_ascii(F.concat(F.col("body"), F.coalesce("correction", F.lit(""))), query)
    rows = cases.filter(held & (F.col("split") != "eval") & (F.col("approved") | F.lit(candidates))).orderBy("case_id").limit(limit)
    rows = rows if candidates else rows.join(allowed, "case_id", "left_semi")
    return rows.select("case_id", "split", effective_table(F.col("body"), F.col("correction")).alias("table"))
