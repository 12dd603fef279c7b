"""Queries that run as streams over the files of a table; their oracles are the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.plans.aggregates import rounded
from regiolith.plans.registry import query
from regiolith.streaming import runs as R


def crime(spark, sf_dir):
    e = R.event_stream(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 20).cast("int").alias("zip"), F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("ts"), "value", "user_id")


@query("M1_stream_counts", "select category, count(*) n from crime group by 1")
def stream_counts(spark, sf_dir):
    return R.finished(R.counts_by_name(crime(spark, sf_dir), "category"), "complete", "counts")


@query(
    "M2_rolling_windows",
    """with s as (select zip, value, date_trunc('day', ts) - interval 1 day * k as "start" from crime, (select unnest(range(0, 7)) k))
    select zip, "start", "start" + interval 7 day as "end", count(*) n, round(avg(value), 6) mean from s group by 1, 2""",
)
def rolling_windows(spark, sf_dir):
    return rounded(R.finished(R.rolling(crime(spark, sf_dir), "zip", "ts", "7 days", "1 day"), "complete", "rolling"))


@query("M3_latest_indicators", "select category, max(ts) ts, round(max_by(value, struct_pack(a := ts, b := event_id)), 6) as value from crime group by 1")
def latest_indicators(spark, sf_dir):
    return rounded(R.finished(R.latest(crime(spark, sf_dir), "category", "ts", "event_id", "value"), "complete", "latest"))


@query("M4_first_seen", "select distinct user_id from events")
def first_seen(spark, sf_dir):
    out = R.finished(R.first_seen(crime(spark, sf_dir), ["user_id"], "ts", "60 days"), "append", "first")
    return out.select("user_id")


@query("M5_stage_progress", "select zip, category, round(max(value), 6) progress from crime group by 1, 2")
def stage_progress(spark, sf_dir):
    return rounded(R.finished(R.progress(crime(spark, sf_dir), "zip", "category", "value"), "complete", "progress"))


#: Stages of a run and their weights; the kinds of events stand for stages, and the users' zips for tasks.
WEIGHTS = {"view": 12, "click": 8, "signup": 35, "purchase": 25, "error": 20}
OVERALL = " + ".join(f"coalesce(max(case when category = '{k}' then least(greatest(value, 0), 100) end), 0) / 100 * {w}" for k, w in WEIGHTS.items())


@query("M5_overall_progress", f"select zip, cast(floor({OVERALL} + 0.000000001) as int) overall, cast(count(distinct category) as int) stages from crime where value < 90 and value is not null group by 1")
def overall_progress(spark, sf_dir):
    """Readings of 90 and more are left out, so that tasks are at different points."""
    out, marks = R.shared_folder(spark, "overall"), R.shared_folder(spark, "overall-marks")
    return R.resumed(R.overall_progress(crime(spark, sf_dir).where("value < 90"), "zip", "category", "value", WEIGHTS), out, marks)
