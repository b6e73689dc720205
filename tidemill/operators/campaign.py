"""Collection runs and campaigns: who is asked, in which order, when boards and runs end, and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

EXCLUDED = ("V10",)
MOST_PAGES, SEEN, LEAST_DATED = 40, 2000, 3
SCHOOL_CAP, DAY_CAP = 10, 2
RETRY_MINUTES, LEAST_REQUESTS, ALIVE_SECONDS, REGISTRY_DAYS, LONGEST_WAIT = 60, 200, 600, 7, 120


def eligible(schools: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    return schools.filter(~F.col("office").isin(*excluded)) if excluded else schools


def day_notices(notices: DataFrame, day: Column, office: str | None = None) -> DataFrame:
    """Notices of the daily run: of that day, of no campaign, of one office if it is given."""
    out = notices.filter((F.col("day") == day) & F.col("campaign_id").isNull())
    return out if office is None else out.filter(F.col("office") == office)


def campaign_notices(notices: DataFrame, campaign: int) -> DataFrame:
    return notices.filter(F.col("campaign_id") == campaign)


def plan(schools: DataFrame, blocked: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """One row: schools, and of these eligible and blocked."""
    marked = schools.join(blocked.select("school").distinct().withColumn("__b", F.lit(True)), "school", "left")
    open_ = ~F.col("office").isin(*excluded) if excluded else F.lit(True)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return marked.agg(F.count("*").alias("schools"), F.coalesce(one(open_), F.lit(0)).alias("eligible"), F.coalesce(one(open_ & F.col("__b").isNotNull()), F.lit(0)).alias("blocked"))


def school_rank(schools: DataFrame, states: DataFrame, blocked: DataFrame) -> DataFrame:
    """rank: 0 never worked on, 1 under way, 2 done or capped, 3 blocked; every school keeps its row."""
    known = states.select("school", F.col("status").alias("__s"), F.col("updated").alias("__u"))
    both = schools.join(known, "school", "left").join(blocked.select("school").distinct().withColumn("__b", F.lit(True)), "school", "left")
    rank = F.when(F.col("__b"), 3).when(F.col("__s").isin("done", "capped"), 2).when(F.col("__s").isNotNull(), 1).otherwise(0)
    return both.withColumns({"rank": rank, "updated": F.when(rank.isin(1, 2), F.col("__u"))}).drop("__s", "__u", "__b")


def school_order(ranked: DataFrame, seed: str) -> DataFrame:
    """turn: offices take turns, each its schools by rank and then in an order that a hash with the seed gives.

    The place of a school within its office is all that is computed; turn and office order the whole, so no task holds it all.
    """
    mixed = F.sha2(F.concat_ws(":", F.lit(seed), F.col("school").cast("string")), 256)
    return ranked.withColumn("turn", F.row_number().over(Window.partitionBy("office").orderBy("rank", mixed, "school")))


def school_caps(posts: DataFrame, collected: DataFrame, order: str, cap: int = SCHOOL_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """The posts (school, day) that a campaign takes: up to `day_cap` of a school's day and up to `cap` of it in all.

    `collected` (school, n) is what it has already.
    """
    daily = posts.withColumn("__d", F.row_number().over(Window.partitionBy("school", "day").orderBy(order))).filter(F.col("__d") <= day_cap)
    counted = daily.withColumn("__n", F.row_number().over(Window.partitionBy("school").orderBy(order)))
    return counted.join(collected, "school", "left").filter(F.col("__n") + F.coalesce("n", F.lit(0)) <= cap).drop("__d", "__n", "n")


def board_stop(pages: DataFrame, posts: DataFrame, start: Column, most: int = MOST_PAGES) -> DataFrame:
    """board, page and stop of every page (board, page, url, next): why the board ends there, null if it goes on.

    A board ends at a page without a next one, whose next one was met before, that is the last allowed, that shows no post
    not met before, or all of whose dated posts, three or more, are older than the window. `posts` has board, page, url, day.
    """
    first = posts.groupBy("board", "url").agg(F.min("page").alias("__first"))
    shown = posts.join(first, ["board", "url"])
    per = shown.groupBy("board", "page").agg(
        F.sum((F.col("page") == F.col("__first")).cast("int")).alias("new"), F.count("day").alias("dated"), F.bool_and(F.when(F.col("day").isNotNull(), F.col("day") < start)).alias("old"))
    met = pages.groupBy("board", F.col("url").alias("next")).agg(F.min("page").alias("__met"))
    both = pages.join(per, ["board", "page"], "left").join(met, ["board", "next"], "left")
    stop = (
        F.when(F.col("next").isNull(), "last_page").when(F.col("__met") <= F.col("page"), "page_repeats").when(F.col("page") >= most, "page_cap")
        .when(F.coalesce("new", F.lit(0)) == 0, "nothing_new").when((F.col("dated") >= LEAST_DATED) & F.col("old"), "older_than_window")
    )
    return both.select("board", "page", stop.alias("stop"))


def batch_of(rows: DataFrame, order: list[str], batch: int, total: int, cap: int) -> DataFrame:
    """The new notices that a batch takes: the first `batch` by the order, and no more than leave `total` and them within `cap`."""
    return rows.orderBy(*order).limit(max(0, min(batch, cap - total)))


def batch_stop(taken: Column, left: Column, batch: int, total: Column, cap: int) -> Column:
    """Why a batch ended: cap_reached, batch_notices, or candidates_exhausted, and coverage_exhausted where no school is left."""
    return F.when(total + taken >= cap, "cap_reached").when(taken >= batch, "batch_notices").when(left > 0, "candidates_exhausted").otherwise("coverage_exhausted")


def cursor(checkpoints: DataFrame) -> DataFrame:
    """Where each school's campaign goes on: its last checkpoint by seq, with collected and the day's count as they were.

    The day's count is that of the checkpoint's own day; another day starts at none.
    """
    rest = [c for c in checkpoints.columns if c != "school"]
    return checkpoints.groupBy("school").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("school", "e.*")


def campaign_events(events: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(each event with its verdict, the status of each campaign). An event starts, or sets active or paused; only an active
    or paused campaign can be set, and its end (cap_reached, coverage_exhausted) is final."""
    ends = ("cap_reached", "coverage_exhausted")
    before = Window.partitionBy("campaign_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("status") == "start", F.col(order))).over(before)
    last = F.max(F.when(F.col("status").isin(*ends), F.col(order))).over(before)
    started, over = first.isNotNull(), F.coalesce(last > first, F.lit(False))
    verdict = (
        F.when(~F.col("status").isin("start", "active", "paused", *ends), "unknown_status").when((F.col("status") == "start") & started, "exists")
        .when((F.col("status") != "start") & (~started | over), "no_campaign").otherwise("accepted")
    )
    judged = events.withColumn("verdict", verdict)
    state = judged.filter("verdict = 'accepted'").groupBy("campaign_id").agg(F.max_by(F.when(F.col("status") == "start", "active").otherwise(F.col("status")), order).alias("status"))
    return judged, state


def active_campaign(campaigns: DataFrame) -> DataFrame:
    """The newest campaign that is active or paused; no row without one."""
    return campaigns.filter(F.col("status").isin("active", "paused")).orderBy(F.desc("campaign_id")).limit(1)


def next_step(state: DataFrame) -> DataFrame:
    """step of each moment (daily_done, minutes_since, pending, requests_left, campaign): daily, wait, analyse, backfill or idle.

    The daily run comes first and is tried again after RETRY_MINUTES; then the queue is emptied; a campaign goes on only
    after both, with more than LEAST_REQUESTS left.
    """
    step = (
        F.when(~F.col("daily_done") & (F.col("minutes_since").isNull() | (F.col("minutes_since") >= RETRY_MINUTES)), "daily").when(F.col("pending") > 0, "analyse").when(~F.col("daily_done"), "wait")
        .when(F.col("campaign") & (F.col("requests_left") > LEAST_REQUESTS), "backfill").otherwise("idle")
    )
    return state.withColumn("step", step)


def healthy(beat: Column, now: Column) -> Column:
    """Whether the last heartbeat is less than ALIVE_SECONDS old."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(beat) < ALIVE_SECONDS, F.lit(False))


def last_run(runs: DataFrame) -> DataFrame:
    """The run opened last, whatever became of it; no row without runs."""
    rest = [c for c in runs.columns if c != "run_id"]
    return runs.agg(F.max("run_id").alias("run_id"), F.max_by(F.struct(*rest), "run_id").alias("e")).filter("run_id is not null").select("run_id", "e.*")


def last_national(runs: DataFrame) -> DataFrame:
    """The last finished run of all offices of each day; runs of one office or under way don't count."""
    whole = runs.filter("only_office is null and status <> 'running'")
    rest = [c for c in runs.columns if c != "day"]
    return whole.groupBy("day").agg(F.max_by(F.struct(*rest), "run_id").alias("e")).select("day", "e.*")


def attempted(runs: DataFrame) -> DataFrame:
    """day and attempted: whether a run of all offices ended without an error and left a report."""
    fine = F.col("only_office").isNull() & ~F.col("status").isin("running", "error") & F.col("report").isNotNull()
    return runs.groupBy("day").agg(F.bool_or(fine).alias("attempted"))


def run_report(regions: DataFrame, day: Column) -> DataFrame:
    """One row: day, offices, new, shortfall, status and the offices that fell short."""
    return regions.agg(
        day.alias("day"), F.count("*").alias("offices"), F.sum("new").cast("bigint").alias("new"), F.sum("shortfall").cast("bigint").alias("shortfall"),
        F.when(F.bool_or(F.col("status") == "partial"), "partial").otherwise("complete").alias("status"), F.array_sort(F.collect_list(F.when(F.col("shortfall") > 0, F.col("office")))).alias("short"))


def registry(rows: DataFrame, offices: list[str]) -> tuple[DataFrame, DataFrame]:
    """(schools, problems) from the pages of a registry: rows (office, page, total, school_code, name, kind, home).

    A school counts once by office and code, the last page winning. Problems: an office without a row, and one whose distinct
    or fetched rows are not the total that its pages state.
    """
    keys = ["office", "school_code"]
    rest = [c for c in rows.columns if c not in (*keys, "total")]
    schools = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("page", "name")).alias("e")).select(*keys, "e.*").drop("page")
    per = rows.groupBy("office").agg(F.max("total").alias("total"), F.count("*").alias("fetched"))
    wanted = rows.sparkSession.createDataFrame([(o,) for o in offices], "office string")
    both = wanted.join(per, "office", "left")
    problems = both.filter(F.col("total").isNull() | (F.col("fetched") != F.col("total"))).select("office", F.when(F.col("total").isNull(), "no_rows").otherwise("count_differs").alias("problem"))
    return schools, problems


def registry_choice(synced: Column, today: Column, reachable: Column, days: int = REGISTRY_DAYS) -> Column:
    """fresh, sync (it is old and can be fetched), stale (old, but all there is) or none."""
    old = synced.isNull() | (F.date_diff(today, synced) >= days)
    return F.when(~old, "fresh").when(reachable, "sync").when(synced.isNotNull(), "stale").otherwise("none")


def retry_at(now: Column, days: Column) -> Column:
    """When a school that failed is asked again; null where the failure is not the school's (0 days)."""
    return F.when(days > 0, now + F.make_dt_interval(days))


def pacing(requests: DataFrame, delay: float, server: str = "server", at: str = "at", crawl_delay: str = "crawl_delay") -> DataFrame:
    """wait before each request, in seconds: what is left of the larger of `delay` and the site's own since the server's last
    request; refused beyond LONGEST_WAIT."""
    since = F.unix_micros(at) - F.unix_micros(F.lag(at).over(Window.partitionBy(server).orderBy(at)))
    wait = F.greatest(F.greatest(F.lit(delay), F.coalesce(crawl_delay, F.lit(0.0))) - F.coalesce(since / 1e6, F.lit(1e9)), F.lit(0.0))
    return requests.withColumn("wait", wait).withColumn("refused", F.col("wait") > LONGEST_WAIT)


def attachments(rows: DataFrame, notice: str, order: str, most: int = 50 << 20, hosts: int = 3) -> DataFrame:
    """outcome of each attachment (bytes, kind, robots, error, host, own_host): skipped by robots rules, failed, kept, or over_limit.

    Hosts beside the notice's own are followed in turn up to `hosts`; once the kept bytes pass `most`, the notice is too large.
    """
    w = Window.partitionBy(notice).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    foreign = F.when(F.col("host") != F.col("own_host"), F.col("host"))
    rank = F.size(F.collect_set(foreign).over(upto))
    seen = rows.withColumn("__rank", rank)
    first = seen.groupBy(notice, "host").agg(F.min("__rank").alias("__first"))
    both = seen.join(first, [notice, "host"], "left")
    outside = (F.col("host") != F.col("own_host")) & (F.col("__first") > hosts)
    outcome = F.when(outside, "failed").when(F.col("robots"), "skipped").when(F.col("error").isNotNull() | F.col("kind").isin("html", "unsupported"), "failed").otherwise("kept")
    kept = both.withColumn("outcome", outcome)
    total = F.sum(F.when(F.col("outcome") == "kept", F.col("bytes")).otherwise(0)).over(upto)
    return kept.withColumn("outcome", F.when((F.col("outcome") == "kept") & (total > most), "over_limit").otherwise(F.col("outcome"))).drop("__rank", "__first")


def collectable(body_length: Column, kept: Column) -> Column:
    """Whether a post counts as collected: a body of ten characters or an attachment."""
    return (body_length >= 10) | (kept > 0)


def setting(value: Column, default: int, low: int, high: int) -> Column:
    """A number given as text; null where it is none or out of range, the default where nothing is given."""
    number = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.lit(default)).otherwise(F.trim(value).try_cast("int"))
    return F.when(number.between(low, high), number)


def totals(**tables: DataFrame) -> DataFrame:
    """name and n: how many rows each table has, for the status page."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
