"""Feed rates, load windows and backlog of a running system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import pearson, round_half_up, share
from tidemark.operators.quantiles import summarise_histogram
from tidemark.operators.scan import running
from tidemark.session import stored

MAX_STEP_SECONDS = 180
MINUTE = 60
DAY = 86_400


def _by_day(df: DataFrame, seconds: Column, margin: int) -> DataFrame:
    """Deal a time series to days: ``__day``, and rows of the day before's last ``margin`` seconds as ``__context``.

    A window that looks back no further than the margin finds all it needs in its day.
    """
    day = F.floor(seconds / F.lit(DAY)).cast("bigint")
    near_end = seconds - day * DAY >= DAY - margin
    dealt = df.withColumn("__day", F.explode(F.when(near_end, F.array(day, day + 1)).otherwise(F.array(day))))
    return dealt.withColumn("__context", F.coalesce(F.col("__day") != day, F.lit(False)))


def per_period(df: DataFrame, time: Column, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, n): events per aligned period, ``t`` in epoch seconds."""
    start = (F.floor(F.unix_seconds(time) / F.lit(seconds)) * seconds).cast("bigint")
    return df.groupBy(*keys, start.alias("t")).agg(F.count("*").alias("n"))


def rate_summary(df: DataFrame, time: Column, series: dict[str, Column]) -> DataFrame:
    """Events per second of each named subset, by event time: n, mean, p50, p95, p99, max.

    The span is that of all events without its first and last (partial) second.
    Silent seconds count as zeros; they are added as one histogram entry instead of
    being generated, so the span may be years.
    """
    second = F.unix_seconds(time)
    per_second = df.groupBy(second.alias("t")).agg(*[F.count_if(cond).alias(name) for name, cond in series.items()])
    # Its span and its values are read apart; the log is counted once.
    per_second = stored(per_second, "per-second")
    span = per_second.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    whole = per_second.where((F.col("t") > lo) & (F.col("t") < hi))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("value")) for n in series])).alias("s")
    busy = whole.select(pairs).select("s.*").where("value > 0").groupBy("series", "value").agg(F.count("*").alias("n"))
    names = span.select(F.explode(F.array(*[F.lit(n) for n in series])).alias("series"), (F.col("hi") - F.col("lo") - 1).alias("seconds"))
    silent = (
        names.join(busy.groupBy("series").agg(F.sum("n").alias("busy")), "series", "left")
        .select("series", F.lit(0).cast("bigint").alias("value"), (F.col("seconds") - F.coalesce("busy", F.lit(0))).alias("n"))
        .where("n > 0")
    )
    return summarise_histogram(busy.unionByName(silent), ["series"])


def shares(df: DataFrame, category: Column, name: str = "category") -> DataFrame:
    """(category, count, share): order by count for a report, ``limit`` for a top list."""
    counts = df.where(category.isNotNull()).groupBy(category.alias(name)).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", share(F.col("count"), total))


def top(shares_: DataFrame, k: int, name: str = "category") -> DataFrame:
    return shares_.orderBy(F.desc("count"), name).limit(k)


def rates(samples: DataFrame, source: Sequence[str] = ()) -> DataFrame:
    """Per-minute feed from a cumulative counter sampled about once a minute.

    A step of zero, backwards, or over three minutes gives no point, and neither
    does a sample with a NULL. Samples are one row a minute per source.
    """
    w = W.partitionBy(*source, "__day").orderBy("t")
    samples = _by_day(samples, F.unix_micros("t") / 1e6, MAX_STEP_SECONDS + 1)
    step = F.unix_micros("t") / 1e6 - F.unix_micros(F.lag("t").over(w)) / 1e6
    stepped = samples.withColumn("__step", step).withColumn("__last", F.lag("scored").over(w))
    good = (
        (F.col("__step") > 0)
        & (F.col("__step") <= MAX_STEP_SECONDS)
        & F.col("__last").isNotNull()
        & F.col("scored").isNotNull()
        & F.col("replicas").isNotNull()
        & F.col("classifier_lag").isNotNull()
    )
    return stepped.where(good & ~F.col("__context")).select(
        *source,
        "t",
        ((F.col("scored") - F.col("__last")) * 60 / F.col("__step")).alias("feed"),
        "replicas",
        F.col("classifier_lag").alias("lag"),
    )


def sample_gaps(samples: DataFrame, source: Sequence[str] = ()) -> DataFrame:
    """Where the recording itself paused."""
    day = F.floor(F.unix_seconds("t") / F.lit(DAY)).cast("bigint")
    seconds = F.unix_micros("t") / 1e6 - F.unix_micros("__from") / 1e6
    seen = running(samples.select(*source, "t"), keys=source, bucket=day, order=[F.col("t")], values={"__from": ("max", F.col("t"))})
    return (
        seen.where(seconds > MAX_STEP_SECONDS)
        .select(*source, F.col("__from").alias("gap_from"), F.col("t").alias("gap_to"), F.floor(seconds / 60 + 0.5).cast("bigint").alias("minutes"))
    )


def kept_per_minute(scored: DataFrame, time: str = "arrived") -> DataFrame:
    """(t, all, kept) per minute from raw scored messages; unreadable ones are skipped."""
    keep = F.from_json("value", "filter STRUCT<keep: BOOLEAN>")["filter"]["keep"]
    minute = (F.floor(F.unix_seconds(time) / F.lit(MINUTE)) * MINUTE).cast("bigint")
    rows = scored.select(minute.alias("t"), keep.alias("keep")).where("t IS NOT NULL AND keep IS NOT NULL")
    return rows.groupBy("t").agg(F.count("*").alias("all"), F.count_if("keep").alias("kept"))


def attach_kept(minutes: DataFrame, per_minute: DataFrame, trailing: int = 5, source: Sequence[str] = ()) -> DataFrame:
    """Mean kept rate of the ``trailing`` whole minutes before each point; silent minutes count as 0.

    Points and minute counts are merged into one series and read with a range frame.
    """
    minute = (F.floor(F.unix_seconds("t") / F.lit(MINUTE)) * MINUTE).cast("bigint")
    points = minutes.select(*source, minute.alias("m"), F.lit(None).cast("bigint").alias("kept"), F.struct(*minutes.columns).alias("p"))
    counts = per_minute.select(
        *source, F.col("t").alias("m"), "kept", F.lit(None).cast(points.schema["p"].dataType).alias("p")
    )
    series = _by_day(points.unionByName(counts), F.col("m"), trailing * MINUTE)
    frame = W.partitionBy(*source, "__day").orderBy("m").rangeBetween(-trailing * MINUTE, -MINUTE)
    mean = F.coalesce(F.sum("kept").over(frame), F.lit(0)) / trailing
    return series.withColumn("kept", mean).where("p IS NOT NULL AND NOT __context").select("p.*", "kept")


def windows(minutes: DataFrame, size: int, coverage: float = 0.8) -> DataFrame:
    """Means over aligned windows of ``size`` minutes that hold enough points."""
    span = size * MINUTE
    start = (F.floor(F.unix_seconds("t") / F.lit(span)) * span).cast("bigint")
    figures = [
        F.count("*").alias("minutes"),
        round_half_up(F.avg("feed")).alias("feed"),
        round_half_up(F.avg("replicas")).alias("replicas"),
        F.max("lag").alias("max_lag"),
    ]
    if "kept" in minutes.columns:
        all_known = F.count("kept") == F.count("*")
        figures.append(F.when(all_known, round_half_up(F.avg("kept"))).alias("kept"))
    return minutes.groupBy(start.alias("start")).agg(*figures).where(F.col("minutes") >= size * coverage)


def load_report(samples: DataFrame, minutes: DataFrame, coverage: float = 0.8) -> DataFrame:
    """One row: span, replica range, busiest and quietest hours by feed and by kept edits, and correlations over half hours."""
    half, hour = windows(minutes, 30, coverage), windows(minutes, 60, coverage)
    busiest = hour.agg(
        F.max_by("start", F.struct("feed", (-F.col("start")).alias("s"))).alias("busiest_hour"),
        F.min_by("start", F.struct("feed", "start")).alias("quietest_hour"),
    )
    parts = {}
    if "kept" in minutes.columns:
        parts["__kept"] = hour.where("kept IS NOT NULL").agg(
            F.max_by("start", F.struct("kept", (-F.col("start")).alias("s"))).alias("busiest_kept_hour"),
            F.min_by("start", F.struct("kept", "start")).alias("quietest_kept_hour"),
        )
    figures = [pearson(F.col("feed"), F.col("replicas")).alias("feed_vs_replicas")]
    if "kept" in minutes.columns:
        figures.append(pearson(F.col("kept"), F.col("replicas")).alias("kept_vs_replicas"))
    together = half.agg(*figures)
    extent = samples.agg(
        F.unix_seconds(F.min("t")).alias("from_s"),
        F.unix_seconds(F.max("t")).alias("to_s"),
        round_half_up((F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 3.6e9).alias("hours_spanned")
    )
    span = minutes.agg(F.count("*").alias("minutes_recorded"), F.min("replicas").alias("replicas_min"), F.max("replicas").alias("replicas_max"))
    # One-row tables side by side, as scalar subqueries.
    parts |= {"__span": span, "__busiest": busiest, "__together": together}
    row = extent.select("*", *[df.select(F.struct("*")).scalar().alias(name) for name, df in parts.items()])
    return row.select("from_s", "to_s", "hours_spanned", *[f"{name}.*" for name in parts])


def trailing_mean(minutes: DataFrame, value: str, points: int = 15, minutes_back: int = 15, source: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``points`` samples that are also within ``minutes_back`` of the row."""
    minutes = _by_day(minutes, F.unix_micros("t") / 1e6, minutes_back * MINUTE + 1)
    w = W.partitionBy(*source, "__day").orderBy("t").rowsBetween(-(points - 1), 0)
    # At most ``points`` entries are held per row.
    recent = F.collect_list(F.struct(F.unix_micros("t").alias("t"), F.col(value).cast("double").alias("v"))).over(w)
    inside = F.filter("__recent", lambda e: e["t"] >= F.unix_micros("t") - minutes_back * 60_000_000)
    total = F.aggregate(inside, F.lit(0.0), lambda acc, e: acc + e["v"])
    return (
        minutes.withColumn("__recent", recent)
        .withColumn("trailing", total / F.size(inside))
        .where(~F.col("__context"))
        .drop("__recent", "__day", "__context")
    )


def backlog(arrivals: DataFrame, completions: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """(t, lag): items arrived and not yet completed at the end of each second with activity.

    Both inputs need ``at``. Counts collapse to seconds first; the running sum is
    then cut into days.
    """
    delta = arrivals.select(F.unix_seconds("at").alias("t"), F.lit(1).cast("bigint").alias("d")).unionByName(
        completions.select(F.unix_seconds("at").alias("t"), F.lit(-1).cast("bigint").alias("d"))
    )
    per_second = delta.groupBy("t").agg(F.sum("d").alias("d"))
    return running(
        per_second,
        bucket=F.floor(F.col("t") / F.lit(bucket_seconds)).cast("bigint"),
        order=[F.col("t")],
        values={"lag": ("sum", F.col("d"))},
        inclusive=True,
    ).select("t", "lag")
