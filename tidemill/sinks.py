"""Writing results: files that appear whole or not at all, reports, snapshots, table folders and the lock of a run."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def replace(df: DataFrame, path: str, kind: str = "json", order: list[str] | None = None) -> None:
    """Write beside the old data and then take its place; a job that fails leaves the old data as it was.

    With an order, the rows are written in it, file after file.
    """
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        (df.orderBy(*order) if order else df).write.format(kind).save(new)
    except Exception:
        at, files = _files(spark, new)
        files.delete(at, True)
        raise
    (at, files), (aside, _), (fresh, _) = _files(spark, path), _files(spark, old), _files(spark, new)
    if files.exists(at):
        files.rename(at, aside)
    files.rename(fresh, at)
    files.delete(aside, True)


def report(df: DataFrame, folder: str, name: str, day: str) -> None:
    """A report of one row, under its day and as the latest."""
    for label in (day, "latest"):
        replace(df.coalesce(1), f"{folder}/{name}-{label}.json")


def snapshot(spark: SparkSession, folder: str, target: str) -> None:
    """Copy a folder of tables. Tables are only ever replaced whole, so a copy holds each as it was at one moment."""
    (source, files), (goal, _) = _files(spark, folder), _files(spark, target)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, files, goal, False, conf)


def bootstrap(spark: SparkSession, folder: str, tables: dict[str, str]) -> list[str]:
    """Make the tables that are not there yet, empty, from their schemas; the names of those made."""
    made = []
    for name, schema in tables.items():
        at, files = _files(spark, f"{folder}/{name}.parquet")
        if not files.exists(at):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
            made.append(name)
    return made


class Lock:
    """A file that only one run can make; it goes when the run ends, whatever became of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self) -> "Lock":
        at, files = _files(self.spark, self.path)
        if not files.createNewFile(at):
            raise RuntimeError("another run holds the lock")
        return self

    def __exit__(self, *_) -> None:
        at, files = _files(self.spark, self.path)
        files.delete(at, False)


class Heartbeat(StreamingQueryListener):
    """Keeps when each query last made progress, for campaign.healthy."""

    def __init__(self):
        self.beats: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.beats[event.name or str(event.id)] = event.timestamp

    def onQueryProgress(self, event) -> None:
        self.beats[event.progress.name or str(event.progress.id)] = event.progress.timestamp

    def onQueryIdle(self, event) -> None:
        self.beats[str(event.id)] = event.timestamp

    def onQueryTerminated(self, event) -> None:
        self.beats.pop(str(event.id), None)


def bundles(notices: DataFrame, files: DataFrame) -> DataFrame:
    """notice_id and bundle, a zip of index.html and the attached files, each path once.

    `notices` has notice_id and html; `files` notice_id, path and content. A notice has ten files of 50 MB in all at most.
    """
    held = files.groupBy("notice_id").agg(F.collect_list(F.struct("path", "content")).alias("files"))

    def run(frames):
        for frame in frames:
            out = []
            for html, rows in zip(frame["html"], frame["files"]):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                    for path, content in sorted({r["path"]: bytes(r["content"]) for r in (rows if rows is not None else [])}.items()):
                        archive.writestr(zipfile.ZipInfo(path), content)
                    archive.writestr(zipfile.ZipInfo("index.html"), html or "")
                out.append(data.getvalue())
            yield pd.DataFrame({"notice_id": frame["notice_id"], "bundle": out})

    joined = notices.select("notice_id", "html").join(held, "notice_id", "left")
    return joined.mapInPandas(run, f"notice_id {notices.schema['notice_id'].dataType.simpleString()}, bundle binary")
