"""Table grids as rows of cells: table_id, row, col, rowspan, colspan, text, header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions import ids

#: Words that mark the layout of a table by its labels, tried in this order (fixed values).
LAYOUTS = (
    ("동의|서명|성명|보호자", "read_only_form"), ("학년|학급", "grade_cards"), ("시간|시각", "timeline"),
    ("일시|장소|대상|비용|준비물|기한|문의", "key_value_cards"),
)
ANCHORS = "학년|학급|시간|시각|일시|장소|대상|비용|준비물|기한|동의|서명|성명|보호자"
ROLES = f"{ANCHORS}|인원|금액"
UNITS = "원|명|시간|분|cm|kg|%|학년|학급|교실"
#: What the words of a header are freed of (fixed values; numbers first, so the dates after them seldom match).
FREED = r"[0-9]+|[일이삼사오육칠팔구십]?학년|[\p{L}\p{N}_]*(?:초등학교|중학교|고등학교|학교|유치원)|20\d{2}년?|\d{1,2}월|\d{1,2}일|테스트|\s+"
SPANS = 200


def span(value: Column) -> Column:
    """A merge count from 1 to 200; blank is 1, anything else null."""
    number = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.lit(1)).otherwise(F.trim(value).try_cast("int"))
    return F.when(number.between(1, SPANS), number)


def extent(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.max(F.col("row") + F.col("rowspan")).cast("bigint").alias("rows"), F.max(F.col("col") + F.col("colspan")).cast("bigint").alias("cols"))


def covered(cells: DataFrame) -> DataFrame:
    """A row for each square that a cell covers."""
    down = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    return down.withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))


def coverage(cells: DataFrame) -> DataFrame:
    """squares, distinct squares, overlap and full (every square of the extent covered once) of each table."""
    squares = covered(cells).groupBy("table_id", "r", "c").agg(F.count("*").alias("n"))
    found = squares.groupBy("table_id").agg(F.sum("n").cast("bigint").alias("squares"), F.count("*").alias("places"))
    found = found.join(extent(cells), "table_id").withColumn("overlap", F.col("squares") > F.col("places"))
    return found.withColumn("full", ~F.col("overlap") & (F.col("places") == F.col("rows") * F.col("cols")))


def overlaps(cells: DataFrame) -> DataFrame:
    """Squares that two or more cells cover: what makes a corrected table invalid."""
    return covered(cells).groupBy("table_id", "r", "c").agg(F.count("*").alias("n")).filter("n > 1")


def placed(cells: DataFrame, order: str) -> DataFrame:
    """text of each square, that of the last cell by `order` that covers it."""
    return covered(cells).groupBy("table_id", "r", "c").agg(F.max_by("text", order).alias("text"))


def _joined(condition: Column, order: list[str]) -> Column:
    kept = F.array_sort(F.collect_list(F.when(condition, F.struct(*order, "text"))))
    return F.array_join(F.transform(kept, lambda s: F.coalesce(s["text"], F.lit(""))), " ")


def _flag(cells: DataFrame, name: str) -> Column:
    return F.coalesce(F.bool_or(name), F.lit(False)) if name in cells.columns else F.lit(False)


def _numbers(*columns: str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *columns), F.lit("]"))


def shapes(cells: DataFrame) -> DataFrame:
    """rows, cols, merges, labels (texts of the first row and column), spans and anchors of each table, whose cells are bounded.

    Cells may carry nested and uncertain, which mark their whole table; without these columns no table is either.
    """
    label = (F.col("row") == 0) | (F.col("col") == 0)
    order = ["row", "col", "rowspan", "colspan"]
    spans = F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda s: F.concat(F.lit("["), F.concat_ws(", ", *[s[c] for c in order]), F.lit("]")))
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), 1, SPANS), lambda s: F.coalesce(s["text"], F.lit("")))
    out = cells.groupBy("table_id").agg(
        F.max(F.col("row") + F.col("rowspan")).cast("bigint").alias("rows"), F.max(F.col("col") + F.col("colspan")).cast("bigint").alias("cols"),
        F.sum(F.when((F.col("rowspan") > 1) | (F.col("colspan") > 1), 1).otherwise(0)).cast("bigint").alias("merges"),
        _joined(label, ["row", "col"]).alias("labels"), _joined(label | F.col("header"), ["row", "col"]).alias("headers"),
        F.array_join(first, " ").alias("first_text"), spans.alias("spans"), _flag(cells, "nested").alias("nested"), _flag(cells, "uncertain").alias("uncertain"),
    )
    return out.withColumn("anchors", found(F.col("labels"), ANCHORS))


def found(text: Column, pattern: str) -> Column:
    """The distinct matches of a pattern, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def layout(merged: Column, labels: Column, cols: Column) -> Column:
    """How a table is best shown: by its labels, but as it is if cells are merged or the table is nested or uncertain."""
    (form, a), (grade, b), (time, c), (key, d) = LAYOUTS
    return (
        F.when(merged, "scroll_table").when(labels.rlike(form), a).when(labels.rlike(grade), b)
        .when(labels.rlike(time) & (cols <= 4), c).when((cols == 2) & labels.rlike(key), d).otherwise("scroll_table")
    )


def patterns(cells: DataFrame) -> DataFrame:
    """table_id, layout and pattern, a digest of the canonical record of the exact structure."""
    shape = shapes(cells)
    plain = (F.col("merges") > 0) | F.col("nested") | F.col("uncertain")
    record = ids.json_object(
        rows=F.col("rows").cast("string"), cols=F.col("cols").cast("string"), anchors=ids.json_array(F.col("anchors")),
        spans=ids.json_array(F.col("spans"), False), uncertain=F.col("uncertain").cast("string"))
    return shape.select("table_id", layout(plain, F.col("labels"), F.col("cols")).alias("layout"), F.sha2(record, 256).alias("pattern"))


def families(cells: DataFrame) -> DataFrame:
    """table_id and family, a digest of what the table means: header words freed of names and numbers, roles, units, shape.

    Units are those of the first 200 cells; of the header words the first twenty in order count.
    """
    shape = shapes(cells)
    freed = F.filter(F.split(F.regexp_replace("headers", FREED, " "), r"\s+"), lambda w: F.length(w) > 1)
    size = F.concat(F.lit("["), F.concat_ws(", ", F.least("rows", F.lit(50)), F.least("cols", F.lit(20)), F.least("merges", F.lit(50))), F.lit("]"))
    record = ids.json_object(
        headers=ids.json_array(F.slice(F.array_sort(F.array_distinct(freed)), 1, 20)), roles=ids.json_array(found(F.col("headers"), ROLES)),
        units=ids.json_array(found(F.col("first_text"), UNITS)), shape=size, nested=F.col("nested").cast("string"))
    return shape.select("table_id", F.substring(F.sha2(record, 256), 1, 24).alias("family"))


def structure_keys(cells: DataFrame) -> DataFrame:
    """table_id and structure_key, of header labels without digits and blanks and of merges; empty where no label has a letter.

    Header rows are those with a header cell, else the first row. The key is a digest of a canonical record, so labels that
    hold any separator stay apart.
    """
    rows = cells.groupBy("table_id", "row").agg(F.bool_or("header").alias("head"))
    heads = rows.groupBy("table_id").agg(F.collect_set(F.when(F.col("head"), F.col("row"))).alias("marked"), F.min("row").alias("first"))
    heads = heads.select("table_id", F.when(F.size("marked") > 0, F.col("marked")).otherwise(F.array("first")).alias("heads"))
    is_head = F.array_contains("heads", F.col("row"))
    marked = cells.join(heads, "table_id").withColumns({"is_head": is_head, "label": F.regexp_replace(F.coalesce("text", F.lit("")), r"\p{Nd}|[\s\p{Z}\x1C-\x1F\x85]", "")})
    merged = (F.col("rowspan") > 1) | (F.col("colspan") > 1)
    ordered = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("row", "col", value.alias("v"))))), lambda s: s["v"])
    span = _numbers("col", "rowspan", "colspan")
    out = marked.groupBy("table_id").agg(
        ordered(F.col("is_head"), F.col("label")).alias("labels"), F.max(F.col("col") + F.col("colspan")).cast("string").alias("cols"),
        ordered(~F.col("is_head") & merged, span).alias("body"), ordered(F.col("is_head"), span).alias("spans"),
    )
    record = ids.json_object(headers=ids.json_array(F.col("labels")), cols=F.col("cols"), body_merges=ids.json_array(F.col("body"), False), header_spans=ids.json_array(F.col("spans"), False))
    key = F.substring(F.sha2(record, 256), 1, 24)
    return out.select("table_id", F.when(F.exists("labels", lambda x: x.rlike("[A-Za-z가-힣]")), key).otherwise("").alias("structure_key"))


def counted(cases: DataFrame, key: str) -> DataFrame:
    """examples and approved of each pattern or family, the most frequent first."""
    approved = F.sum(F.col("approved").cast("bigint")).alias("approved")
    return cases.groupBy(key).agg(F.count("*").alias("examples"), approved).orderBy(F.desc("examples"), key)


#: Header words of the twice repeated triple (fixed values).
TRIPLE = (("연번", "번호"), ("학과", "학과명"), ("수업교실", "교실", "장소"))


def unfolded(cells: DataFrame, triple: tuple = TRIPLE) -> DataFrame:
    """table_id, number, name, place of six-column tables whose header triple stands twice, as one list.

    Refused unless below the header every group of three is empty or whole and unmerged with a number first, and the
    numbers are 1 to n. Other tables give no rows.
    """
    row = cells.groupBy("table_id", "row").agg(
        *[F.max(F.when(F.col("col") == i, F.trim("text"))).alias(f"t{i}") for i in range(6)],
        F.max(F.when((F.col("rowspan") > 1) | (F.col("colspan") > 1), 1).otherwise(0)).alias("merged"), F.max("col").alias("last"),
    )
    tight = lambda i: F.regexp_replace(F.coalesce(f"t{i}", F.lit("")), r"\s+", "")
    is_head = F.lit(True)
    for i in range(3):
        is_head = is_head & (tight(i) == tight(i + 3)) & tight(i).isin(*triple[i])
    w = Window.partitionBy("table_id")
    row = row.withColumn("head", F.min(F.when(is_head, F.col("row"))).over(w)).withColumn("width", F.max("last").over(w)).filter((F.col("width") == 5) & (F.col("row") > F.col("head")))
    group = F.explode(F.array(*[F.struct(F.col(f"t{o}").alias("number"), F.col(f"t{o + 1}").alias("name"), F.col(f"t{o + 2}").alias("place")) for o in (0, 3)]))
    parts = row.select("table_id", "merged", group.alias("g")).select("table_id", "merged", "g.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    parts = parts.filter(~(blank("number") & blank("name") & blank("place")))
    good = (F.col("merged") == 0) & F.coalesce("number", F.lit("")).rlike("^[0-9]+$") & ~blank("name") & ~blank("place")
    n = F.col("number").try_cast("int")
    ok = parts.groupBy("table_id").agg(F.min(good.cast("int")).alias("good"), F.min(n).alias("low"), F.max(n).alias("high"), F.countDistinct(n).alias("kinds"), F.count("*").alias("all"))
    ok = ok.filter((F.col("good") == 1) & (F.col("low") == 1) & (F.col("high") == F.col("kinds")) & (F.col("kinds") == F.col("all"))).select("table_id")
    return parts.join(ok, "table_id").select("table_id", n.alias("number"), "name", "place")
