"""Line dedup over overlapping three-line windows (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, text_hash

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, mark, at, w1, w2: a row for each window of lines that are not all blank; lines count from 0."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cut = docs.select("doc_id", "mark", lines.alias("lines")).filter(F.size("lines") >= WINDOW)
    part = lambda i: F.get("lines", i)
    every = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*[part(i + j) for j in range(WINDOW)]).alias("w1"),
            F.hash(*[part(i + j) for j in range(WINDOW)]).alias("w2"),
            F.concat(*[part(i + j) for j in range(WINDOW)]).rlike(r"[^\x20\x09-\x0D]").alias("full"),
        ),
    )
    return cut.select("doc_id", "mark", F.explode(every).alias("w")).filter("w.full").select("doc_id", "mark", "w.at", "w.w1", "w.w2")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, gone: the lines covered by a window that stood before, by (doc_id, mark, at)."""
    windows = _windows(docs)
    place = F.struct("doc_id", "mark", "at")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w1", "w2", "first")
    later = windows.join(first, ["w1", "w2"]).filter(place > F.col("first"))
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + WINDOW - 1))))
    return later.groupBy("doc_id", "mark").agg(covered.alias("gone"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `text` less the lines of later repeated windows, and n_lines, n_removed added.

    A line is what stands between \\n; windows are three consecutive lines of one text, blank ones included, but not all
    three blank. Of equal windows the first by (doc_id, hash of the text, line) stays; overlapping later ones are merged.
    Null and empty texts count one empty line and stay. Rows that repeat a doc_id and its text are one text read twice:
    they come out alike. Null doc_ids sort first. Columns named n_lines or n_removed are overwritten, others pass through.
    """
    marked = docs.withColumns({"__mark": text_hash()})
    keyed = marked.select("doc_id", F.col("__mark").alias("mark"), "text")
    gone = repeated_lines(keyed).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("gone").alias("__gone"))
    joined = marked.join(gone, marked["doc_id"].eqNullSafe(gone["__d"]) & (marked["__mark"] == gone["__m"]), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    where = F.array_sort("__gone")
    # Stretches between removed lines, so that the cost is that of the lines and not of lines times removals.
    ends = F.concat(F.array(F.lit(-1)), where, F.array(F.size("__lines")))
    stretches = F.transform(F.sequence(F.lit(0), F.size("__ends") - 2), lambda i: F.slice("__lines", F.get("__ends", i) + 2, F.get("__ends", i + 1) - F.get("__ends", i) - 1))
    out = joined.withColumns({"__lines": lines}).withColumns({"__ends": ends})
    return out.withColumns({
        "n_lines": F.size("__lines").cast("bigint"),
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"),
        "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n")),
    }).drop("__mark", "__d", "__m", "__gone", "__lines", "__ends")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_repeated_lines() over all documents: lines, lines removed, digest of the text left."""
    found = drop_repeated_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
spots AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 0))) AS pos FROM d),
keyed AS (SELECT doc_id, pos, array_to_string(l[pos + 1:pos + 3], chr(10)) AS k FROM spots),
full_ AS (SELECT * FROM keyed WHERE regexp_matches(k, '[^\\x20\\x09-\\x0D]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM full_),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS i FROM ranked WHERE n > 1),
lost AS (SELECT doc_id, list(i) AS g, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN l ELSE
    list_transform(list_filter(list_zip(l, range(0, len(l))), lambda p: NOT list_contains(g, p[2])), lambda p: p[1]) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
