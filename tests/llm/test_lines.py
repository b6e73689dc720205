from pyspark.sql import functions as F

from tidemill.llm.lines import drop_repeated_lines

COLUMNS = "doc_id bigint, text string, gone string, n_lines int"


def test_later_windows_go(spark):
    rows = [
        (2, "x\na\nb\nc\nd\ny", "", 0), (1, "a\nb\nc\nd", "", 0), (3, "a\nb", "", 0), (4, "q\nq\nq\nq\nq", "", 0),
        (5, None, None, None), (6, "", "", 0), (7, "\n\n\n\n", "", 0), (8, "\n\n\n\n", "", 0), (9, "a\nb\nc", "", 0), (9, "a\nb\nc", "", 0), (None, "n\nm\no", "", 0),
    ]
    found = drop_repeated_lines(spark.createDataFrame(rows, COLUMNS)).orderBy(F.col("doc_id")).collect()
    assert [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in found] == [
        (None, "n\nm\no", 3, 0), (1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 6, 4), (3, "a\nb", 2, 0), (4, "q", 5, 4), (5, None, 1, 0), (6, "", 1, 0),
        (7, "\n\n\n\n", 5, 0), (8, "\n\n\n\n", 5, 0), (9, "", 3, 3), (9, "", 3, 3),
    ]
    assert drop_repeated_lines(spark.createDataFrame([], COLUMNS)).count() == 0
