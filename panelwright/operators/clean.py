"""Incident cleaning: coordinates, dates, boxes, caps and feed screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import geo
from panelwright.operators.ranks import exact_percentiles

# ---- fixed values -----------------------------------------------------------
LAT_PAD, LON_PAD = 1.0, 1.5
START_DATE = "2018-01-01"
MAX_ROWS = 600_000
OLDEST = "0001-01-01"
PARKING_SENTINEL = 5555.0
PROPERTY_CATEGORIES = ["Larceny Theft", "Burglary", "Motor Vehicle Theft", "Robbery", "Arson",
                       "Malicious Mischief", "Stolen Property"]
# ---- end of fixed values ----------------------------------------------------


def coerce_numeric(col: Column) -> Column:
    """Text to double; what does not parse, and NaN, becomes null."""
    d = col.try_cast("double")
    return F.when(~F.isnan(d), d)


def valid_latlon(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & (lat != 0) & (lon != 0)


def axis_percentiles(df: DataFrame, feed: str, lat: str, lon: str, probs: list[float],
                     names: list[str]) -> DataFrame:
    """Percentiles of both coordinates in one pass: columns lat_<name>, lon_<name>."""
    both = F.array(F.struct(F.lit("lat").alias("axis"), F.col(lat).alias("v")),
                   F.struct(F.lit("lon").alias("axis"), F.col(lon).alias("v")))
    long = df.select(feed, F.explode(both).alias("_b")).select(feed, "_b.axis", "_b.v")
    q = exact_percentiles(long, [feed, "axis"], "v", probs, names)
    return q.groupBy(feed).agg(*[F.max(F.when(F.col("axis") == a, F.col(n))).alias(f"{a}_{n}")
                                 for a in ("lat", "lon") for n in names])


def feed_medians(df: DataFrame, feed: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    m = axis_percentiles(df, feed, lat, lon, [0.5], ["med"])
    return m.select(feed, F.col("lat_med").alias("med_lat"), F.col("lon_med").alias("med_lon"))


def median_anchor_filter(df: DataFrame, feed: str, lat: str = "lat", lon: str = "lon",
                         anchors: DataFrame | None = None) -> DataFrame:
    """Keep rows within a degree (1.5 in longitude) of their feed's median point."""
    anchors = feed_medians(df, feed, lat, lon) if anchors is None else anchors
    near = ((F.abs(F.col(lat) - F.col("med_lat")) <= LAT_PAD)
            & (F.abs(F.col(lon) - F.col("med_lon")) <= LON_PAD))
    return df.join(anchors, feed).where(near).drop("med_lat", "med_lon")


DATE_FORMATS = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a",
                "yyyy/M/d", "yyyy/M/d H:mm", "yyyy/M/d H:mm:ss"]
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def parse_mixed(text: Column) -> Column:
    """ISO dates (a blank or T before the time, any fraction, any zone), then each layout in turn; null where none fits."""
    iso = F.when(text.rlike(ISO_DATE), text.try_cast("timestamp"))
    plain = F.trim(text)
    return F.coalesce(iso, *[F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS])


def parse_epoch_ms(text: Column) -> Column:
    return F.timestamp_millis(text.try_cast("double").cast("bigint"))


def parse_datetime(df: DataFrame, feed: str, text: str, out: str = "ts") -> DataFrame:
    """Parse dates per feed, and recover feeds whose text is really epoch milliseconds.

    A feed switches when over half its rows date before 1980 (digits-only text
    counts as such: read as a date it collapses to 1970) and the epoch reading
    parses at least as many rows.
    """
    digits = F.col(text).rlike(r"^\d{11,}$")
    plain = F.when(digits, F.lit("1970-01-01").cast("timestamp")).otherwise(parse_mixed(F.col(text)))
    d = df.withColumn("_plain", plain).withColumn("_epoch", parse_epoch_ms(F.col(text)))
    share = d.groupBy(feed).agg(
        F.avg(F.when(F.year("_plain") < 1980, 1.0).otherwise(0.0)).alias("_old"),
        F.count("_plain").alias("_np"), F.count("_epoch").alias("_ne"))
    switch = (F.col("_old") > 0.5) & (F.col("_ne") >= F.col("_np"))
    return (d.join(share, feed)
             .withColumn(out, F.when(switch, F.col("_epoch")).otherwise(F.col("_plain")))
             .drop("_plain", "_epoch", "_old", "_np", "_ne"))


def date_window(ts: Column, now: Column, first: str = "2000-01-01") -> Column:
    """From the first sane date to two days past ``now`` (a parameter, so runs repeat)."""
    return ts.between(F.lit(first).cast("timestamp"), now + F.expr("INTERVAL 2 DAYS"))


def robust_bbox(df: DataFrame, feed: str, pad_m: float = 1500.0,
                lat: str = "lat", lon: str = "lon") -> DataFrame:
    """0.3 to 99.7 percentile box, padded in metres."""
    q = axis_percentiles(df, feed, lat, lon, [0.003, 0.997], ["a", "b"])
    w, s, e, n = geo.pad_bbox(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"), pad_m)
    return q.select(feed, w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))


def cap_recent(df: DataFrame, feed: str, ts: str, tie: str, cap: int = MAX_ROWS) -> DataFrame:
    """The newest ``cap`` rows of each feed, ties by ``tie`` ascending; undated rows count as the oldest.

    Daily and then per-second counts locate the instant where the cap bites;
    only rows of that one instant are ever put in order, so a feed with a third
    of all rows is not sorted anywhere.
    """
    day = F.coalesce(F.to_date(ts), F.lit(OLDEST).cast("date"))
    sec = F.coalesce(F.date_trunc("second", F.col(ts)), F.lit(OLDEST).cast("timestamp"))
    d = df.withColumn("_day", day).withColumn("_sec", sec)
    w = Window.partitionBy(feed)
    newest = w.orderBy(F.col("_day").desc())
    days = d.groupBy(feed, "_day").agg(F.count("*").alias("_c")).withColumn(
        "_cum", F.sum("_c").over(newest))
    # a feed's cut day: the first (newest-down) on which the running count reaches the cap
    cut_day = (days.where(F.col("_cum") >= cap)
               .groupBy(feed).agg(F.max(F.struct("_day", (F.col("_cum") - F.col("_c")).alias("_o"))).alias("_m"))
               .select(feed, F.col("_m._day").alias("_cut"), F.col("_m._o").alias("_o")))
    d = d.join(cut_day, feed, "left")
    on_day = d.where(F.col("_day") == F.col("_cut"))
    secs = on_day.groupBy(feed, "_sec", "_o").agg(F.count("*").alias("_c")).withColumn(
        "_cum", F.col("_o") + F.sum("_c").over(w.orderBy(F.col("_sec").desc())))
    cut_sec = (secs.where(F.col("_cum") >= cap)
               .groupBy(feed).agg(F.max(F.struct("_sec", (F.col("_cum") - F.col("_c")).alias("_os"))).alias("_m"))
               .select(feed, F.col("_m._sec").alias("_cs"), F.col("_m._os").alias("_os")))
    d = d.join(cut_sec, feed, "left")
    sure = d.where(F.col("_cs").isNull() | (F.col("_sec") > F.col("_cs")))
    edge = d.where(F.col("_sec") == F.col("_cs")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(feed).orderBy(F.col(ts).desc(), F.col(tie))))
    keep = edge.where(F.col("_rn") <= cap - F.col("_os")).drop("_rn")
    return sure.unionByName(keep).select(*df.columns)


def cap_start_date(df: DataFrame, feed: str, ts: str, cap: int = MAX_ROWS, first: str = START_DATE) -> DataFrame:
    """Per feed, the earliest start day, from ``first`` on, whose row count still fits under the cap.

    A feed whose newest day alone is over the cap starts at ``first``, with all its rows; so does, with
    none, a feed that has only undated and earlier rows.
    """
    days = (df.where(F.to_date(ts) >= F.lit(first).cast("date"))
            .groupBy(feed, F.to_date(ts).alias("day")).agg(F.count("*").alias("_c")))
    cum = days.withColumn("_k", F.sum("_c").over(Window.partitionBy(feed).orderBy(F.col("day").desc())))
    fits = F.col("_k") <= cap
    got = cum.groupBy(feed).agg(F.min(F.when(fits, F.col("day"))).alias("_day"), F.coalesce(F.max(F.when(fits, F.col("_k"))), F.sum("_c")).alias("_rows"))
    feeds = df.select(feed).distinct().withColumnRenamed(feed, "_feed")
    return feeds.join(got, feeds["_feed"].eqNullSafe(got[feed]), "left").select(
        F.col("_feed").alias(feed), F.coalesce("_day", F.lit(first).cast("date")).alias("start_day"), F.coalesce("_rows", F.lit(0)).alias("rows_kept"))


def sentinel_code_drop(df: DataFrame, value: str, sentinel: float = PARKING_SENTINEL) -> DataFrame:
    return df.where(F.col(value).isNotNull() & (F.col(value) != sentinel))


def active_meter(flag: Column, place: Column) -> Column:
    return flag.isin("M", "T") & (place == "ON")


def flag_of_text(text: Column) -> Column:
    return F.coalesce(F.lower(text.cast("string")).isin("true", "1"), F.lit(False)).cast("double")


def category_filter(category: Column, ts: Column, wanted=None, start: str = START_DATE) -> Column:
    return category.isin(wanted or PROPERTY_CATEGORIES) & (ts >= F.lit(start).cast("timestamp"))


def center_gate(medians: DataFrame, centres: DataFrame, key: str, limit: float = 0.45) -> DataFrame:
    """Distance in degrees of a feed's median point from the expected centre, and a verdict."""
    off = F.hypot(F.col("med_lat") - F.col("c_lat"),
                  (F.col("med_lon") - F.col("c_lon")) * F.cos(F.radians(F.col("c_lat"))))
    return medians.join(centres, key).withColumn("deg_off", off).withColumn("ok", off <= limit)
