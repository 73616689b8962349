"""Ad clicks: parsing, the click guard and the counts behind the ad reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.functions import count_pairs_json, day_label, minute_label

CLICK_COLUMNS = ["ts", "area", "city", "user_id", "ads_id"]

# Milliseconds from 1970 to the end of year 9999. Others do not convert, or give days whose
# labels do not sort; such lines are rejected.
LAST_MILLIS = 253_402_300_799_999

# Parts into which the clicks of one user are dealt for a join on the user.
SALTS = 32

# Seconds by which the window of the last-hour report moves.
SLIDE = 10


def _fields(f: Column) -> Column:
    """Named fields of a split line; ``epoch`` is NULL unless the line is well formed."""
    millis = F.get(f, F.lit(0)).try_cast("bigint")
    epoch = F.when((F.size(f) == 5) & millis.between(0, LAST_MILLIS), millis)
    rest = [F.get(f, F.lit(i)).alias(name) for i, name in enumerate(CLICK_COLUMNS[1:], start=1)]
    return F.struct(epoch.alias("epoch"), *rest)


def _parsed() -> Column:
    """The line's fields in an array of one. Passing the parts through the array's lambda
    splits the line once, however many fields are taken."""
    return F.transform(F.array(F.split(F.rtrim("value"), " ")), _fields)


def parse_ads_log(lines: DataFrame) -> DataFrame:
    """Lines ``epochMillis area city userId adId`` to columns; other lines are left out.

    Works on batch and streaming frames. :func:`ads_log_rejects` returns what is left out.
    """
    well_formed = F.filter(_parsed(), lambda r: r["epoch"].isNotNull())
    return lines.select(F.inline(well_formed)).select(
        F.timestamp_millis("epoch").alias("ts"), *CLICK_COLUMNS[1:]
    )


def is_rejected() -> Column:
    return F.get(_parsed(), F.lit(0))["epoch"].isNull()


def ads_log_rejects(lines: DataFrame) -> DataFrame:
    """Lines that :func:`parse_ads_log` leaves out, blank ones and NULL included."""
    return lines.where(is_rejected())


def observe_lines(lines: DataFrame) -> DataFrame:
    """Report the lines read and rejected as metrics ``ads_log``; a stream has them in its
    progress, batch by batch."""
    return lines.observe(
        "ads_log", F.count(F.lit(1)).alias("lines"), F.count_if(is_rejected()).alias("rejected")
    )


def parse_observed_ads_log(lines: DataFrame) -> DataFrame:
    """The clicks of :func:`parse_ads_log`, with the metrics of :func:`observe_lines`, from one
    look at each line."""
    parsed = lines.select(F.inline(_parsed())).observe(
        "ads_log", F.count(F.lit(1)).alias("lines"), F.count_if(F.col("epoch").isNull()).alias("rejected")
    )
    return parsed.where(F.col("epoch").isNotNull()).select(F.timestamp_millis("epoch").alias("ts"), *CLICK_COLUMNS[1:])


def click_buckets(clicks: DataFrame, seconds: int = 5) -> DataFrame:
    """Add ``bucket``, the number of the batch interval a click falls into."""
    return clicks.withColumn("bucket", F.floor(F.unix_seconds("ts") / F.lit(seconds)))


def flagged_users(bucketed: DataFrame, threshold: int = 100) -> DataFrame:
    """Users over the threshold, with the bucket in which they are flagged.

    A user is flagged in the first bucket holding a click on an ad the user had already
    clicked more than ``threshold`` times that day in earlier buckets. Clicks after that
    cannot move it, so all clicks can be counted without dropping any first. They are
    counted before the window, which sees one row per user, ad, day and bucket.
    """
    counts = bucketed.groupBy("user_id", "ads_id", day_label(F.col("ts")).alias("day"), "bucket").agg(
        F.count(F.lit(1)).alias("n")
    )
    return _flagged(counts, threshold)


def _flagged(counts: DataFrame, threshold: int) -> DataFrame:
    earlier = (
        Window.partitionBy("user_id", "ads_id", "day")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counts.withColumn("prior", F.sum("n").over(earlier))
        .where(F.col("prior") > threshold)
        .groupBy("user_id")
        .agg(F.min("bucket").alias("flag_bucket"))
    )


def click_guard(bucketed: DataFrame, threshold: int = 100) -> DataFrame:
    """Clicks without those of users flagged in an earlier bucket.

    Clicks in the flag bucket itself stay. No join hint: the flagged users are usually
    few, and adaptive execution picks the join by their measured size. Where it shuffles,
    the clicks of a user are dealt over ``SALTS`` tasks and the flags repeated for each.
    """
    flags = flagged_users(bucketed, threshold).select(
        F.col("user_id").alias("flagged"), "flag_bucket", _every_salt()
    )
    late = (
        (F.col("user_id") == F.col("flagged")) & (F.col("own_salt") == F.col("salt"))
        & (F.col("bucket") > F.col("flag_bucket"))
    )
    return bucketed.withColumn("own_salt", _salt()).join(flags, late, "left_anti").drop("own_salt")


def _salt() -> Column:
    return F.pmod(F.xxhash64("ts", "area", "city", "ads_id"), F.lit(SALTS))


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")


def guarded_day_counts(bucketed: DataFrame, keys: list[str], threshold: int = 100) -> DataFrame:
    """Clicks that pass :func:`click_guard`, per ``keys`` and day.

    Clicks are counted once, per user, place, ad, day and bucket. Flags come from these
    counts, and the counts of late buckets are dropped, so the log is read once and a user
    with most of the clicks is a few rows.
    """
    counts = bucketed.groupBy(
        "user_id", "area", "city", "ads_id", day_label(F.col("ts")).alias("day"), "bucket"
    ).agg(F.count(F.lit(1)).alias("n"))
    per_ad = counts.groupBy("user_id", "ads_id", "day", "bucket").agg(F.sum("n").alias("n"))
    flags = _flagged(per_ad, threshold).withColumnRenamed("user_id", "flagged")
    late = (F.col("user_id") == F.col("flagged")) & (F.col("bucket") > F.col("flag_bucket"))
    return counts.join(flags, late, "left_anti").groupBy(*keys, "day").agg(F.sum("n").alias("click_count"))


def drop_users(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users that are not on a given list.

    Clicks of one user are dealt over ``SALTS`` tasks where the join is by shuffle.
    """
    listed = blacklist.select(F.col("user_id").alias("listed"), _every_salt())
    same = (F.col("user_id") == F.col("listed")) & (F.col("own_salt") == F.col("salt"))
    return clicks.withColumn("own_salt", _salt()).join(listed, same, "left_anti").select(*clicks.columns)


def user_ads_day_count(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("user_id", "ads_id", day_label(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("click_count")
    )


def area_city_ads_day_count(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("area", "city", "ads_id", day_label(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("click_count")
    )


def area_ads_day_count(counts: DataFrame) -> DataFrame:
    """Roll the counts per city up to areas."""
    return counts.groupBy("day", "area", "ads_id").agg(F.sum("click_count").alias("click_count"))


def area_ads_top(counts: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most clicked ads per day and area, as JSON text in rank order.

    ``counts`` is per area, city, ad and day. Ranks are cut before the lists are
    collected, so a list has at most ``k`` entries.
    """
    by_clicks = Window.partitionBy("day", "area").orderBy(F.desc("click_count"), "ads_id")
    ranked = (
        area_ads_day_count(counts)
        .withColumn("rk", F.row_number().over(by_clicks))
        .where(F.col("rk") <= k)
    )
    return top_ads_lists(ranked)


def top_ads_lists(ranked: DataFrame) -> DataFrame:
    """Ranked ads (``rk``) of each day and area to one JSON text."""
    entries = F.array_sort(F.collect_list(F.struct("rk", "ads_id", "click_count")))
    return ranked.groupBy("day", "area").agg(
        count_pairs_json(entries, "ads_id", "click_count").alias("top_ads")
    )


def minute_lists(per_minute: DataFrame) -> DataFrame:
    """Counts per ad and minute label to one JSON text per ad, in order of the labels."""
    entries = F.array_sort(F.collect_list(F.struct("minute", "click_count")))
    return per_minute.groupBy("ads_id").agg(
        count_pairs_json(entries, "minute", "click_count").alias("minute_counts"))


def window_bounds(as_of: datetime | Column, minutes: int, slide: int = SLIDE) -> tuple[Column, Column]:
    """Start and end of the window that was last complete at ``as_of``.

    Windows of ``minutes`` move every ``slide`` seconds; they hold their start, not their end.
    """
    given = as_of if isinstance(as_of, Column) else F.lit(as_of)
    end = F.timestamp_seconds(F.floor(F.unix_seconds(given) / F.lit(slide)) * F.lit(slide))
    return end - F.expr(f"INTERVAL {int(minutes)} MINUTES"), end


def in_window(arrival: str, as_of: datetime | Column, minutes: int, slide: int = SLIDE) -> Column:
    """Whether ``arrival`` lies in the window of :func:`window_bounds`."""
    start, end = window_bounds(as_of, minutes, slide)
    return (F.col(arrival) >= start) & (F.col(arrival) < end)


def last_hour_minutes(
    clicks: DataFrame, as_of: datetime | Column, minutes: int = 60, arrival: str = "ts"
) -> DataFrame:
    """Clicks of each ad by minute label over the window of arrivals at ``as_of``, as JSON text.

    The window is by ``arrival``, the label by the click's own time: a click that comes hours
    late counts when it comes. Clicks are counted per ad and label first, so a list has at
    most 1440 entries.
    """
    per_minute = (
        clicks.where(in_window(arrival, as_of, minutes))
        .groupBy("ads_id", minute_label(F.col("ts")).alias("minute"))
        .agg(F.count(F.lit(1)).alias("click_count"))
    )
    return minute_lists(per_minute)
