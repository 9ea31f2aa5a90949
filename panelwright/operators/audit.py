"""Data audit: one aggregate per table turned into (city, check, ok, severity, detail) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.stats import safe_corr
from panelwright.operators.ranks import exact_percentiles


def _rows(agg: DataFrame, city: str, checks: list[tuple[str, Column, str, Column]]) -> DataFrame:
    items = [F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"),
                      F.lit(sev).alias("severity"), d.cast("double").alias("detail"))
             for n, ok, sev, d in checks]
    return agg.select(city, F.explode(F.array(*items)).alias("_r")).select(city, "_r.*")


def panel_audit(panel: DataFrame, city: str = "city") -> DataFrame:
    cls = [c for c in panel.columns if c.startswith("n_") and c not in ("n_total", "n_returned")]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cls])
    expo = F.coalesce("housing_units_bldg", F.lit(0.0)) + F.coalesce("pop_bldg", F.lit(0.0))
    neg = reduce(lambda a, b: a + b, [F.when(F.col(c) < 0, 1).otherwise(0) for c in cls])
    g = panel.groupBy(city).agg(
        F.count_if(total != F.col("n_total")).alias("mismatch"), F.sum(neg).alias("neg"),
        F.count_if(expo < 0).alias("neg_expo"), F.min("slope_deg").alias("smin"), F.max("slope_deg").alias("smax"),
        F.count_if(F.col("slope_deg").isNull() | F.isnan("slope_deg")).alias("snull"),
        F.count_if(F.col("GEOID").isNull()).alias("gnull"), F.sum("n_NO_LOOT").alias("nl"), F.sum(total).alias("all"),
        reduce(lambda a, b: a + b, [F.when(F.sum(c) == 0, 1).otherwise(0) for c in cls]).alias("empty"))
    c, share = F.col, F.col("nl") / F.greatest("all", F.lit(1))
    return _rows(g, city, [
        ("total_matches_classes", c("mismatch") == 0, "fail", c("mismatch")),
        ("no_negative_counts", c("neg") == 0, "fail", c("neg")),
        ("no_negative_exposure", c("neg_expo") == 0, "fail", c("neg_expo")),
        ("no_missing_slope", c("snull") == 0, "fail", c("snull")),
        ("slope_not_negative", c("smin") >= 0, "fail", c("smin")),
        ("slope_at_most_90", c("smax") <= 90, "fail", c("smax")),
        ("group_id_present", c("gnull") == 0, "warn", c("gnull")),
        ("no_empty_class", c("empty") == 0, "warn", c("empty")),
        ("noloot_share_sane", (share > 0.02) & (share < 0.45), "warn", share)])


def redownload_audit(old: DataFrame, new: DataFrame, keys: list[str], city: str = "city") -> DataFrame:
    """Correlation and volume of two independent builds of the same cells (old, new columns)."""
    m = old.join(new, keys, "left").withColumn("new", F.coalesce("new", F.lit(0))).where("old + new > 0")
    g = m.groupBy(city).agg(safe_corr(F.col("old").cast("double"), F.col("new").cast("double")).alias("r"),
                            (F.sum("new") / F.greatest(F.sum("old"), F.lit(1))).alias("ratio"))
    return _rows(g, city, [("redownload_correlates", F.col("r") > 0.99, "fail", F.col("r")),
                           ("redownload_volume", F.lit(True), "info", F.col("ratio"))])


def window_audit(inc: DataFrame, now: Column, city: str = "city") -> DataFrame:
    g = inc.groupBy(city).agg(
        F.count_if(F.col("ts") > now + F.expr("INTERVAL 1 DAY")).alias("future"),
        (F.datediff(F.max("ts"), F.min("ts")) / 365.25).alias("span"))
    return _rows(g, city, [("no_future_dates", F.col("future") == 0, "fail", F.col("future")),
                           ("window_over_18_months", F.col("span") > 1.5, "fail", F.col("span"))])


def centre_audit(inc: DataFrame, centres: DataFrame, city: str = "city", limit: float = 0.15) -> DataFrame:
    med = exact_percentiles(inc, [city], "lat", [0.5], ["mla"]).join(
        exact_percentiles(inc, [city], "lon", [0.5], ["mlo"]), city).join(centres, city)
    dla, dlo = F.abs(F.col("mla") - F.col("c_lat")), F.abs(F.col("mlo") - F.col("c_lon"))
    return _rows(med, city, [("median_near_centre", (dla < limit) & (dlo < limit), "fail", F.greatest(dla, dlo))])


def sink_audit(sample: DataFrame, city: str = "city", cap: float = 50.0) -> DataFrame:
    worst = F.max(F.col("n_total") / F.greatest("exposure", F.lit(1.0)))
    g = sample.groupBy(city).agg(worst.alias("worst"))
    return _rows(g, city, [("sink_filter_holds", F.col("worst") < cap, "fail", F.col("worst"))])
