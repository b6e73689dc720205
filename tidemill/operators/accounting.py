"""Quotas, shortfalls, caps, budgets and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def region_report(notices: DataFrame, goal: Column) -> DataFrame:
    """new, duplicates, goal, shortfall and status of each office from rows with is_new."""
    out = notices.groupBy("office").agg(
        F.sum(F.when(F.col("is_new"), 1).otherwise(0)).cast("bigint").alias("new"),
        F.sum(F.when(F.col("is_new"), 0).otherwise(1)).cast("bigint").alias("duplicates"),
    )
    out = out.withColumn("goal", goal.cast("bigint"))
    out = out.withColumn("shortfall", F.greatest(F.col("goal") - F.col("new"), F.lit(0)))
    return out.withColumn("status", F.when(F.col("shortfall") > 0, "partial").otherwise("complete"))


def daily_report(notices: DataFrame, targets: DataFrame) -> DataFrame:
    """office, target, before, new, duplicates, total, shortfall, status and daily_target of each office with a target.

    `notices` has office, before (whether a row was there when the run began) and is_new (first of its identity). daily_target
    is the sum over offices.
    """
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    per = notices.groupBy("office").agg(one(F.col("before") & F.col("is_new")).alias("before"), one(~F.col("before") & F.col("is_new")).alias("new"), one(~F.col("before") & ~F.col("is_new")).alias("duplicates"))
    out = targets.join(per, "office", "left").na.fill(0, ["before", "new", "duplicates"])
    out = out.withColumn("total", F.col("before") + F.col("new"))
    out = out.withColumn("shortfall", F.greatest(F.col("target") - F.col("total"), F.lit(0)))
    whole = targets.agg(F.sum("target").alias("daily_target"))
    return out.withColumn("status", F.when(F.col("shortfall") > 0, "partial").otherwise("complete")).crossJoin(F.broadcast(whole))  # one row


def lookback(published: Column, day: Column, days: int = 365) -> Column:
    """passes, too_old, in_future or malformed for a date given as text; without one a post passes."""
    given = F.try_to_date(published, "yyyy-MM-dd")
    return F.when(published.isNull(), "passes").when(given.isNull(), "malformed").when(given > day, "in_future").when(given < F.date_sub(day, days), "too_old").otherwise("passes")


def capped(rows: DataFrame, school: list[str], office: list[str], order: str, cap: int, goal: int) -> DataFrame:
    """The first `cap` rows of each school, then the first `goal` of each office."""
    per = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*school).orderBy(order))).filter(F.col("__n") <= cap)
    return per.withColumn("__n", F.row_number().over(Window.partitionBy(*office).orderBy(order))).filter(F.col("__n") <= goal).drop("__n")


def budget(requests: DataFrame, day: str, order: str, amount: str, cap: int, part: Column | None = None) -> DataFrame:
    """spent before each request of a day and whether the request is still within the cap.

    `part` is a coarse, never falling function of the order (an hour, say): sums of whole parts are added up first, so that a
    day's requests need not stand in one task.
    """
    cut = requests.withColumn("__part", F.lit(0) if part is None else part)
    sums = cut.groupBy(day, "__part").agg(F.sum(amount).alias("__sum"))
    whole = F.sum("__sum").over(Window.partitionBy(day).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__whole", F.coalesce(whole, F.lit(0))).drop("__sum")
    before = Window.partitionBy(day, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(sums, [day, "__part"]).withColumn("spent_before", (F.col("__whole") + F.coalesce(F.sum(amount).over(before), F.lit(0))).cast("bigint"))
    return out.withColumn("granted", F.col("spent_before") + F.col(amount) <= cap).drop("__part", "__whole")


def campaign_status(rows: DataFrame, target: int, cap: int) -> DataFrame:
    """One row: schools, collected, and what remains to the target and the cap."""
    out = rows.agg(F.count("*").alias("schools"), F.sum("collected").cast("bigint").alias("collected"))
    left = lambda n: F.greatest(F.lit(n) - F.coalesce("collected", F.lit(0)), F.lit(0)).cast("bigint")
    return out.withColumns({"to_target": left(target), "to_cap": left(cap)})


def dashboard(rows: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value and count of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return rows.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def within(rows: DataFrame, date: str, start: Column, end: Column) -> DataFrame:
    """Rows dated from start to end; rows without a date pass."""
    return rows.filter(F.col(date).isNull() | F.col(date).between(start, end))


#: Words of a failure, its state and the days until the next try, the first match counting (fixed values).
FAILURES = (
    (("요청 상한",), "budget", 0), (("robots",), "robots", 7), (("로그인", "인증", "권한"), "login", 30),
    (("Name or service", "getaddrinfo", "address associated"), "dns", 1), (("CERTIFICATE", "SSL"), "tls", 1),
    (("게시판 링크",), "no_board", 7), (("미지원", "빈 게시판"), "unsupported", 3),
)


def failure(reason: Column) -> tuple[Column, Column]:
    """State and days until the next try of a failure by its reason."""
    kind = days = None
    for words, state, wait in FAILURES:
        hit = F.lit(False)
        for word in words:
            hit = hit | reason.contains(word)
        kind = F.when(hit, state) if kind is None else kind.when(hit, state)
        days = F.when(hit, wait) if days is None else days.when(hit, wait)
    return kind.otherwise("error"), days.otherwise(1)


def blocked(states: DataFrame, now: Column) -> DataFrame:
    """Schools whose next try lies ahead, with the reason (else the status) they are blocked for."""
    out = states.filter((F.col("status") != "ok") & (F.col("next_retry") > now))
    return out.withColumn("blocked_for", F.coalesce(F.when(F.col("reason") != "", F.col("reason")), F.col("status")))
