"""File kinds by content, upload checks and extraction of tables of files."""

from __future__ import annotations

import io
import re
import urllib.robotparser
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemill.sources import compound, office
from tidemill.sources import html as web

#: Extensions and the kind each must hold (fixed values).
KINDS = {
    "hwp": "hwp", "hwpx": "hwpx", "docx": "docx", "pdf": "pdf", "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "webp": "image",
    "tif": "image", "tiff": "image", "html": "html", "htm": "html",
}
FREE = ("txt", "xlsx", "xls")
MOST_BYTES, MOST_NAME, MOST_READ = 25 << 20, 220, 64 << 20

CELL = "struct<row:int,col:int,rowspan:int,colspan:int,text:string,header:boolean>"
TABLE = f"struct<rows:int,cols:int,nested:boolean,cells:array<{CELL}>>"
RESULT = f"status string, error string, paragraphs array<string>, tables array<{TABLE}>"


def kind_of(content: Column, filename: Column) -> Column:
    """pdf, zip, hwp, legacy_ole, image, html or unsupported by the first bytes; a zip's kind needs package_kind."""
    head = lambda hexes: F.hex(F.substring(content, 1, len(hexes) // 2)) == hexes
    # In the first 512 bytes after white space, as ASCII in lower case.
    start = F.lower(F.decode(F.substring(content, 1, 600), "ISO-8859-1"))
    start = F.substring(F.regexp_replace(start, r"^\s+", ""), 1, 512)
    image = head("89504E470D0A1A0A") | head("FFD8FF") | head("47494638") | head("49492A00") | head("4D4D002A") | (head("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"))
    return (
        F.when(head("255044462D"), "pdf").when(head("504B0304"), "zip")
        .when(head("D0CF11E0A1B11AE1"), F.when(F.lower(filename).contains(".hwp"), "hwp").otherwise("legacy_ole"))
        .when(image, "image").when(start.contains("<html") | start.contains("<!doctype html") | start.contains("<body"), "html").otherwise("unsupported")
    )


def package_kind(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = archive.namelist()
    except zipfile.BadZipFile:
        return "unsupported"
    if any(re.fullmatch(r"Contents/section\d+\.xml", n) for n in names):
        return "hwpx"
    return "docx" if "word/document.xml" in names else "unsupported"


def upload_error(filename: Column, size: Column, kind: Column) -> Column:
    """The code of the first rule an upload breaks, null if none: name, size, extension, content."""
    name = F.regexp_extract(F.replace(filename, F.lit("\\"), F.lit("/")), r"[^/]*$", 0)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), extension)
    return (
        F.when((name == "") | (F.length(name) > MOST_NAME) | name.rlike(r"[\x00-\x1F]"), "bad_name").when((size < 1) | (size > MOST_BYTES), "bad_size")
        .when(~extension.isin(*KINDS, *FREE), "bad_extension").when(wanted.isNotNull() & (wanted != kind), "content_mismatch")
    )


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """filename, content, size, kind and error of every file below a folder; error as upload_error, packages opened to know their kind."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = found.select(F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), "content", F.col("length").alias("size"))
    by_head = kind_of(F.col("content"), F.col("filename"))
    return named.withColumn("kind", F.when(by_head == "zip", packed_kind("content")).otherwise(by_head)).withColumn("error", upload_error(F.col("filename"), F.col("size"), F.col("kind")))


@F.pandas_udf(T.StringType())
def packed_kind(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else package_kind(bytes(c)))


def extract_new(files: DataFrame, stored: DataFrame, parser: str) -> DataFrame:
    """Results by sha256 after a run: those stored by this parser that are no parse_error, and the other files read anew, each content once.

    `files` has sha256, content and filename, `stored` sha256, parser and the columns of RESULT and kind.
    """
    good = stored.filter((F.col("parser") == parser) & (F.col("status") != "parse_error"))
    new = files.dropDuplicates(["sha256"]).join(good.select("sha256"), "sha256", "left_anti").select("sha256", "content", "filename")
    columns = ["sha256", "kind", "status", "error", "paragraphs", "tables"]
    return good.select(*columns, "parser").unionByName(extract(new).select(*columns, F.lit(parser).alias("parser")))


def extract(files: DataFrame) -> DataFrame:
    """The rows of `files` (content, filename and more) with kind, status, error, paragraphs and tables.

    html, hwp, hwpx and docx are read; pdf and legacy files need a parser that is not here, images need vision. A file that
    cannot be read has status parse_error and why; no file stops the others.
    """
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name not in ("content",)]
    names = [f.name for f in files.schema if f.name != "content"]

    def one(data, filename, kind):
        if len(data) > MOST_READ:
            return kind, {"status": "parse_error", "error": "file too large", "paragraphs": [], "tables": []}
        if kind == "zip":
            kind = package_kind(data)
        try:
            if kind == "html":
                return kind, web.parse(data.decode("utf-8", "replace"))
            if kind == "hwpx":
                return kind, office.section_package(data)
            if kind == "docx":
                return kind, office.document_package(data)
            if kind == "hwp":
                return kind, compound.document(data)
        except Exception as error:  # a broken file is a result, not a failure of the job
            return kind, {"status": "parse_error", "error": str(error)[:300], "paragraphs": [], "tables": []}
        return kind, {"status": "needs_vision" if kind == "image" else "needs_parser", "error": None, "paragraphs": [], "tables": []}

    def run(frames):
        for frame in frames:
            found = [one(bytes(c), n, k) for c, n, k in zip(frame["content"], frame["filename"], frame["__kind"])]
            out = frame[names].copy()
            out["kind"] = [k for k, _ in found]
            for key in ("status", "error", "paragraphs", "tables"):
                out[key] = [r[key] for _, r in found]
            yield out

    marked = files.withColumn("__kind", kind_of(F.col("content"), F.coalesce("filename", F.lit(""))))
    return marked.mapInPandas(run, ", ".join([*rest, "kind string", RESULT]))


def cells(extracted: DataFrame, key: str) -> DataFrame:
    """The cells of all tables as rows for operators.grids; table_id joins the key and the table's place."""
    tables = extracted.select(key, F.posexplode("tables").alias("i", "t"))
    return tables.select(F.concat_ws(":", F.col(key).cast("string"), "i").alias("table_id"), "t.nested", F.explode("t.cells").alias("c")).select("table_id", "c.*", "nested")


def links(pages: DataFrame) -> DataFrame:
    """page_id, target, label of every link of a page that leads somewhere."""

    def run(frames):
        for frame in frames:
            rows = [(p, web.target(x, u or ""), x["label"]) for p, u, h in zip(frame["page_id"], frame["url"], frame["html"]) for x in web.parse(h or "")["links"]]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["page_id", "target", "label"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, target string, label string")


def robots_allow(status: int, body: str, agent: str, url: str) -> bool:
    """404 and 410 allow all; 200 that is no page goes by its rules; anything else forbids all."""
    rules = urllib.robotparser.RobotFileParser()
    if status in (404, 410):
        return True
    if status != 200 or "<html" in body[:500].lower():
        return False
    rules.parse(body.splitlines())
    return rules.can_fetch(agent, url)
