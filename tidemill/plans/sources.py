"""Queries over raw pages: text, tables, links, kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import grids
from tidemill.sources import files
from tidemill.session import table


def _pages(spark, sf_dir):
    """Pages as files, a table of their id and address put in so that there are some."""
    p = table(spark, sf_dir, "pages")
    extra = F.concat(F.lit("<table><tr><th>id<th>url<tr><td rowspan=2>"), F.col("page_id").cast("string"), F.lit("<td>"), F.regexp_replace("url", "&", "&amp;"), F.lit("<tr><td>x</table>"))
    return p.select("page_id", F.encode(F.concat(F.lit("<html>"), "html", extra), "UTF-8").alias("content"), F.concat("page_id", F.lit(".html")).alias("filename"))


def html_text(spark, sf_dir):
    out = files.extract(_pages(spark, sf_dir))
    return out.select("page_id", "kind", "status", F.size("paragraphs").alias("paragraphs"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("text"))


def html_tables(spark, sf_dir):
    return files.cells(files.extract(_pages(spark, sf_dir)), "page_id")


def html_layouts(spark, sf_dir):
    return grids.patterns(html_tables(spark, sf_dir))


def html_links(spark, sf_dir):
    return files.links(table(spark, sf_dir, "pages"))


def detect_kind(spark, sf_dir):
    heads = ("255044462D31", "504B0304", "89504E470D0A1A0A", "D0CF11E0A1B11AE1", "3C68746D6C3E", "00")
    p = table(spark, sf_dir, "part")
    content = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("p_partkey") % 6 + 1).cast("int")))
    return p.select("p_partkey", files.kind_of(content, F.when(F.col("p_size") % 2 == 0, "a.HWP").otherwise("b.doc")).alias("kind"))


def validate_file(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    name = F.concat(F.when(i % 9 == 0, "a/").otherwise("x"), F.when(i % 9 == 0, "").when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".exe").otherwise(".txt"))
    return p.select("p_partkey", files.upload_error(name, F.col("p_size") - 1, F.when(i % 8 == 0, "pdf").otherwise("image")).alias("error"))


PLANS = {
    "html_text": (html_text, None), "html_tables": (html_tables, None), "html_layouts": (html_layouts, None), "html_links": (html_links, None),
    "detect_kind": (detect_kind, """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'image' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'hwp' ELSE 'legacy_ole' END WHEN 4 THEN 'html' ELSE 'unsupported' END AS kind FROM part"""),
    "validate_file": (validate_file, """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'bad_name' WHEN p_size <= 1 THEN 'bad_size' WHEN p_partkey % 4 = 1 THEN 'bad_extension' WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 0 THEN 'content_mismatch' END AS error FROM part"""),
}
