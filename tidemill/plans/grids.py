"""Grid queries: the lines of an order play the rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemill.operators import grids
from tidemill.session import table

WORDS = ("", "일시", "장소", "시간", "학년", "성명", "금액 300원", "비용")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by line number, which repeats within an order and so overlaps."""
    li = table(spark, sf_dir, "lineitem")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), t.alias("text")) for i, t in enumerate((F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey").cast("string")))]))
    return li.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), cells.alias("c"), "l_suppkey").select(
        "table_id", "row", "c.col", F.lit(1).alias("rowspan"), F.when((F.col("c.col") == 1) & (F.col("l_suppkey") % 10 == 0), 2).otherwise(1).alias("colspan"), "c.text", (F.col("row") == 0).alias("header"), "l_suppkey")


LINES = """li AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row, l_suppkey, l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR) AS part FROM lineitem),
cells AS (SELECT table_id, row, 0 AS col, 1 AS colspan, l_returnflag AS text, l_suppkey FROM li
  UNION ALL SELECT table_id, row, 1, CASE WHEN l_suppkey % 10 = 0 THEN 2 ELSE 1 END, l_linestatus, l_suppkey FROM li UNION ALL SELECT table_id, row, 2, 1, part, l_suppkey FROM li),
squares AS (SELECT table_id, row AS r, unnest(range(col, col + colspan)) AS c, text, col, l_suppkey FROM cells)"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one line each, in order, with labels from a short list."""
    li = table(spark, sf_dir, "lineitem").withColumn("row", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1).cast("int"))
    named = lambda n: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (n % len(WORDS) + 1).cast("int"))
    cells = F.explode(F.array(F.struct(F.lit(0).alias("col"), named(F.col("l_orderkey") + F.col("row")).alias("text")), F.struct(F.lit(1).alias("col"), F.col("l_returnflag").alias("text"))))
    merged = F.when((F.col("l_orderkey") % 9 == 0) & (F.col("row") == 0), 2).otherwise(1)
    return li.select(F.col("l_orderkey").alias("table_id"), "row", merged.alias("rowspan"), cells.alias("c")).select("table_id", "row", "c.col", F.when(F.col("c.col") == 0, F.col("rowspan")).otherwise(1).alias("rowspan"), F.lit(1).alias("colspan"), "c.text", (F.col("row") == 0).alias("header"))


TABLES = f"""li AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row, l_returnflag FROM lineitem),
cells AS (SELECT table_id, row, 0 AS col, CASE WHEN table_id % 9 = 0 AND row = 0 THEN 2 ELSE 1 END AS rowspan, (['{"', '".join(WORDS)}'])[(table_id + row) % {len(WORDS)} + 1] AS text FROM li
  UNION ALL SELECT table_id, row, 1, 1, l_returnflag FROM li),
shapes AS (SELECT table_id, max(row + rowspan) AS rows, max(col + 1) AS cols, count(*) FILTER (WHERE rowspan > 1) AS merges,
  string_agg(text, ' ' ORDER BY row, col) FILTER (WHERE row = 0 OR col = 0) AS labels, string_agg(text, ' ' ORDER BY row, col) AS all_text,
  string_agg('[' || row || ', ' || col || ', ' || rowspan || ', 1]', ', ' ORDER BY row, col) AS spans FROM cells GROUP BY table_id)"""
FOUND = """'[' || array_to_string(list_transform(list_sort(list_distinct(regexp_extract_all({0}, '{1}'))), lambda x: '"' || x || '"'), ', ') || ']'"""
PATTERN = f"""sha256('{{"anchors": ' || {FOUND.format('labels', grids.ANCHORS)} || ', "cols": ' || cols || ', "rows": ' || rows || ', "spans": [' || spans || '], "uncertain": false}}')"""
LAYOUT = """CASE WHEN merges > 0 THEN 'scroll_table' WHEN regexp_matches(labels, '동의|서명|성명|보호자') THEN 'read_only_form' WHEN regexp_matches(labels, '학년|학급') THEN 'grade_cards'
  WHEN regexp_matches(labels, '시간|시각') AND cols <= 4 THEN 'timeline' WHEN cols = 2 AND regexp_matches(labels, '일시|장소|대상|비용|준비물|기한|문의') THEN 'key_value_cards' ELSE 'scroll_table' END"""


def grid_extent(spark, sf_dir):
    return grids.extent(lines(spark, sf_dir))


def grid_coverage(spark, sf_dir):
    return grids.coverage(lines(spark, sf_dir))


def grid_overlap(spark, sf_dir):
    return grids.overlaps(lines(spark, sf_dir)).select("table_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "n")


def grid_last_cell_wins(spark, sf_dir):
    cells = lines(spark, sf_dir).withColumn("o", F.struct("l_suppkey", "col", "text"))
    return grids.placed(cells, "o").select("table_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "text")


def table_layout(spark, sf_dir):
    return grids.patterns(tables(spark, sf_dir)).groupBy("layout").agg(F.count("*").alias("n"))


def table_pattern(spark, sf_dir):
    return grids.patterns(tables(spark, sf_dir))


def pattern_counts(spark, sf_dir):
    cases = grids.patterns(tables(spark, sf_dir)).withColumn("approved", F.col("table_id") % 5 == 0)
    return grids.counted(cases, "pattern")


def family_counts(spark, sf_dir):
    cases = grids.families(tables(spark, sf_dir)).withColumn("approved", F.col("table_id") % 5 == 0)
    return grids.counted(cases, "family")


def structure_key(spark, sf_dir):
    return grids.structure_keys(tables(spark, sf_dir))


def repeated_columns(spark, sf_dir):
    """Parts as the rows of six-column lists, two parts to a row."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor(F.col("p_partkey") / 20).alias("table_id"), (F.col("p_partkey") % 20).alias("i"), "p_brand", "p_type")
    side = F.when(F.col("i") < 10, 0).otherwise(3)
    body = p.select("table_id", (F.col("i") % 10 + 1).cast("int").alias("row"), F.explode(F.array(*[F.struct((side + j).alias("col"), t.alias("text")) for j, t in enumerate((F.when((F.col("table_id") % 4 == 3) & (F.col("i") == 5), "x").otherwise((F.col("i") + 1).cast("string")), F.col("p_brand"), F.col("p_type")))])).alias("c"))
    heads = p.select("table_id").distinct().select("table_id", F.lit(0).alias("row"), F.explode(F.array(*[F.struct(F.lit(j).alias("col"), F.lit(t).alias("text")) for j, t in enumerate(("연 번", "학과", "교실") * 2)])).alias("c"))
    cells = body.unionByName(heads).select("table_id", "row", "c.col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), "c.text", (F.col("row") == 0).alias("header"))
    return grids.unfolded(cells).select("table_id", F.col("number").cast("bigint").alias("number"), "name", "place")


PLANS = {
    "grid_extent": (grid_extent, f"WITH {LINES} SELECT table_id, CAST(max(row + 1) AS BIGINT) AS rows, CAST(max(col + colspan) AS BIGINT) AS cols FROM cells GROUP BY table_id"),
    "grid_coverage": (grid_coverage, f"""WITH {LINES}, q AS (SELECT table_id, r, c, count(*) AS n FROM squares GROUP BY ALL),
p AS (SELECT table_id, CAST(sum(n) AS BIGINT) AS squares, count(*) AS places FROM q GROUP BY table_id),
e AS (SELECT table_id, CAST(max(row + 1) AS BIGINT) AS rows, CAST(max(col + colspan) AS BIGINT) AS cols FROM cells GROUP BY table_id)
SELECT *, squares > places AS overlap, squares = places AND places = rows * cols AS full FROM p JOIN e USING (table_id)"""),
    "grid_overlap": (grid_overlap, f"WITH {LINES} SELECT table_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, count(*) AS n FROM squares GROUP BY ALL HAVING count(*) > 1"),
    "grid_last_cell_wins": (grid_last_cell_wins, f"WITH {LINES} SELECT table_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, arg_max(text, (l_suppkey, col, text)) AS text FROM squares GROUP BY table_id, r, c"),
    "table_layout": (table_layout, f"WITH {TABLES} SELECT {LAYOUT} AS layout, count(*) AS n FROM shapes GROUP BY 1"),
    "table_pattern": (table_pattern, f"WITH {TABLES} SELECT table_id, {LAYOUT} AS layout, {PATTERN} AS pattern FROM shapes"),
    "pattern_counts": (pattern_counts, f"WITH {TABLES} SELECT {PATTERN} AS pattern, count(*) AS examples, count(*) FILTER (WHERE table_id % 5 = 0) AS approved FROM shapes GROUP BY 1 ORDER BY examples DESC, pattern"),
    "family_counts": (family_counts, f"""WITH {TABLES}, f AS (SELECT table_id, sha256('{{"headers": [' ||
  array_to_string(list_transform(list_slice(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(labels, '{grids.FREED}', ' ', 'g'), '\\s+'), lambda w: length(w) > 1))), 1, 20), lambda w: '"' || w || '"'), ', ') ||
  '], "nested": false, "roles": ' || {FOUND.format('labels', grids.ROLES)} || ', "shape": [' || least(rows, 50) || ', ' || least(cols, 20) || ', ' || least(merges, 50) || '], "units": ' || {FOUND.format('all_text', grids.UNITS)} || '}}')[1:24] AS family FROM shapes)
SELECT family, count(*) AS examples, count(*) FILTER (WHERE table_id % 5 = 0) AS approved FROM f GROUP BY family ORDER BY examples DESC, family"""),
    "structure_key": (structure_key, f"""WITH {TABLES}, k AS (SELECT table_id,
  string_agg('"' || regexp_replace(text, '[0-9]|\\s', '', 'g') || '"', ', ' ORDER BY row, col) FILTER (WHERE row = 0) AS labels, max(col + 1) AS cols,
  coalesce(string_agg('[' || col || ', ' || rowspan || ', 1]', ', ' ORDER BY row, col) FILTER (WHERE row > 0 AND rowspan > 1), '') AS body,
  string_agg('[' || col || ', ' || rowspan || ', 1]', ', ' ORDER BY row, col) FILTER (WHERE row = 0) AS heads FROM cells GROUP BY table_id)
SELECT table_id, CASE WHEN regexp_matches(labels, '[A-Za-z가-힣]') THEN sha256('{{"body_merges": [' || body || '], "cols": ' || cols || ', "header_spans": [' || heads || '], "headers": [' || labels || ']}}')[1:24] ELSE '' END AS structure_key FROM k"""),
    "repeated_columns": (repeated_columns, "SELECT p_partkey // 20 AS table_id, p_partkey % 20 + 1 AS number, p_brand AS name, p_type AS place FROM part WHERE (p_partkey // 20) % 4 <> 3"),
}
