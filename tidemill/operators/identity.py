"""Identity of notices: first sightings, versions, aliases, objects, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_seen(notices: DataFrame, identity: str = "id", order: str = "seq") -> DataFrame:
    """is_new: whether a row is the first of its identity by `order`. One aggregate and a join, so a hot identity can split."""
    first = notices.groupBy(identity).agg(F.min(order).alias("__first"))
    return notices.join(first, identity).withColumn("is_new", F.col(order) == F.col("__first")).drop("__first")


def version_chain(notices: DataFrame, url: str = "url", order: str = "seq") -> DataFrame:
    """previous_version: the id of the new notice before on the same url."""
    new = first_seen(notices).filter("is_new").drop("is_new")
    return new.withColumn("previous_version", F.lag("id").over(Window.partitionBy(url).orderBy(order)))


def sightings(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """first_seen and last_seen of each key."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def put_objects(objects: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Objects to be stored: one for each digest that is not there yet, the first by `seq`."""
    new = objects.groupBy("sha256").agg(F.min_by("bytes", "seq").alias("bytes"), F.min("seq").alias("seq"))
    return new if stored is None else new.join(stored.select("sha256"), "sha256", "left_anti")


def damaged(objects: DataFrame) -> DataFrame:
    """Stored objects whose content no longer has the digest they are kept under."""
    return objects.filter(F.sha2("content", 256) != F.col("sha256"))


def stratified(rows: DataFrame, group: list[str], stratum: str, key: str, seed: str) -> DataFrame:
    """turn: place of a row in a reproducible draw that takes one of each stratum in turn, each stratum in hash order.

    A row's place in its stratum is its place among rows whose hash begins alike and the number of those before; its turn
    follows from that and the sizes of the group's strata, so neither a group nor a stratum need stand in one task.
    """
    mixed = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    by = F.sha2(F.concat_ws(":", F.lit(seed), F.col(stratum)), 256)
    cut = rows.withColumns({"__h": mixed, "__part": F.substring(mixed, 1, 2), "__g": F.struct(*group), "__s": F.struct(*group, stratum), "__by": F.struct(by, F.col(stratum))})
    parts = cut.groupBy("__s", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    sizes = cut.groupBy("__g", "__s").agg(F.count("*").alias("n"), F.first("__by").alias("by")).groupBy("__g").agg(F.collect_list(F.struct("n", "by")).alias("__strata"))
    placed = cut.join(parts, ["__s", "__part"]).withColumn("__own", F.col("__before") + F.row_number().over(Window.partitionBy("__s", "__part").orderBy("__h", key)))
    own = F.col("__own")
    earlier = F.aggregate("__strata", F.lit(0).cast("bigint"), lambda n, s: n + F.least(s["n"], own - 1))
    now = F.size(F.filter("__strata", lambda s: (s["n"] >= own) & (s["by"] <= F.col("__by"))))
    return placed.join(sizes, "__g").withColumn("turn", earlier + now).select(*rows.columns, "turn")
