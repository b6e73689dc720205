"""Upserts as folds: Parquet has no MERGE, so tables are events and their current state is a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def insert_new(rows: DataFrame, there: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key is not there yet, the first of each key by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__e")).select(*keys, "__e.*")
    return first.join(there.select(*keys).distinct(), keys, "left_anti")


def last_given(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last value that is not null of each column, key by key: COALESCE(new, old) over a log."""
    place = F.struct(*order)
    return events.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def with_defaults(events: DataFrame, keys: list[str], order: list[str], defaults: dict) -> DataFrame:
    """last_given of the columns in `defaults`, and the default where none was ever given."""
    last = last_given(events, keys, order, list(defaults))
    return last.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def looked_up(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Each wanted key with its row's columns and found: many look-ups as one join, keys without a row included."""
    return wanted.select(*keys).distinct().join(rows.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.col("found").isNotNull())


def cached(results: DataFrame, parser: str, most: int = 30 << 20) -> DataFrame:
    """The result to use of each sha256: one of the current parser before others, then the newest; results of over `most` bytes are none."""
    rest = [c for c in results.columns if c != "sha256"]
    best = results.filter(F.col("size") <= most).groupBy("sha256").agg(F.max_by(F.struct(*rest), F.struct((F.col("parser") == parser).alias("c"), "at")).alias("e"))
    return best.select("sha256", "e.*")


def overridden(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the overrides' columns where they are given, those disabled left out. One override a key."""
    given = overrides.select(key, "disabled", *[F.col(c).alias(f"__{c}") for c in columns])
    both = base.join(given, key, "left").filter(~F.coalesce("disabled", F.lit(False)))
    return both.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop("disabled", *[f"__{c}" for c in columns])


def changed(new: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """New rows whose fingerprint is not the stored one."""
    return new.join(stored.select(key, fingerprint).distinct(), [key, fingerprint], "left_anti")


def rearmed(jobs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs after a request to run them again: only those done or in error become pending, with no attempts."""
    hit = jobs.join(wanted.select(*keys).distinct().withColumn("__w", F.lit(True)), keys, "left")
    again = F.col("__w").isNotNull() & F.col("status").isin("done", "error")
    return hit.withColumns({"attempts": F.when(again, 0).otherwise(F.col("attempts")), "status": F.when(again, "pending").otherwise(F.col("status"))}).drop("__w")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows but for the keys that new rows bring, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def migrated(cases: DataFrame) -> DataFrame:
    """Rows of the first schema with the columns of the current one; what was approved is reviewed as such."""
    return cases.withColumns({"review_status": F.when(F.col("approved"), "approved").otherwise("candidate"), "split": F.lit(None).cast("string"), "history": F.array().cast("array<string>")})


def capture(skipped: Column, failed: Column, body: Column) -> Column:
    """partial_capture if an attachment was skipped or failed or the body is blank."""
    return F.when((skipped > 0) | (failed > 0) | (F.trim(F.coalesce(body, F.lit(""))) == ""), "partial_capture").otherwise("full")
