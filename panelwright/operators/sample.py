"""Estimation samples: derived controls, ordered filters and the seven variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ranks import with_group

# ---- fixed values -----------------------------------------------------------
SES = ["log_income", "log_value", "owner_share", "vacancy_rate", "log_density"]
INCOME_FLOOR, VALUE_FLOOR, RATE_CAP, MIN_GROUP = 5000.0, 50000.0, 50.0, 3
MIN_TPI_SD, MIN_EVENTS, MIN_EV_PER_UNIT = 4.0, 20000, 1.0
# ---- end of fixed values ----------------------------------------------------


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN is not a value here."""
    fix = {c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def floor_log(col: Column, floor: float) -> Column:
    """log(max(col, floor)), null where col is null (``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.log(F.greatest(col.cast("double"), F.lit(floor))))


def exposure(units: str, people: str) -> Column:
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return z(units) + z(people)


def exposure_floor(df: DataFrame, col: str = "exposure", floor: float = 5.0) -> DataFrame:
    return df.where(F.col(col) > floor)


def clip_log_controls(df: DataFrame, expo: str = "exposure") -> DataFrame:
    return df.withColumns({
        "log_income": floor_log(F.col("median_hh_income"), INCOME_FLOOR),
        "log_value": floor_log(F.col("median_home_value"), VALUE_FLOOR),
        "log_density": F.log(F.col(expo)),
        "owner_share": F.col("owner_share").cast("double"),
        "vacancy_rate": F.col("vacancy_rate").cast("double"),
    })


def zscore_by(df: DataFrame, city: str, cols: list[str], suffix: str = "_z",
              zero_sd: str = "zero") -> DataFrame:
    """Within-city z-scores; a constant column gives 0, or (``raw``) the bare deviation."""
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"] = F.avg(c)
        aggs[f"_s_{c}"] = F.stddev_samp(c)
    out = with_group(df, [city], **aggs)
    for c in cols:
        dev, sd = F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")
        if zero_sd == "zero":
            z = F.when(sd > 0, dev / sd).otherwise(F.lit(0.0))
        else:
            z = dev / F.when(sd != 0, sd).otherwise(F.lit(1.0))
        out = out.withColumn(f"{c}{suffix}", z)
    return out.drop(*aggs)


def covered_groups(df: DataFrame, keys: list[str], total: str = "n_total") -> DataFrame:
    return with_group(df, keys, _cov=F.sum(total)).where("_cov > 0").drop("_cov")


def sink_filter(df: DataFrame, total: str = "n_total", expo: str = "exposure",
                cap: float = RATE_CAP) -> DataFrame:
    return df.where(F.col(total) / F.greatest(F.col(expo), F.lit(1.0)) < cap)


def min_group_size(df: DataFrame, keys: list[str], least: int = MIN_GROUP) -> DataFrame:
    return with_group(df, keys, _sz=F.count("*")).where(F.col("_sz") >= least).drop("_sz")


def drop_incomplete(df: DataFrame, need: list[str]) -> DataFrame:
    return df.dropna(subset=[c for c in need if c in df.columns])


def sum_classes(*cols: str) -> Column:
    out = F.lit(0).cast("bigint")
    for c in cols:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def theft_total(df: DataFrame) -> Column:
    return sum_classes(*[c for c in df.columns if c.startswith("n_MASS_")])


def _has(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def prep_sample(df: DataFrame, variant: str, city: str = "city", group: str = "GEOID",
                radii=(50, 100, 250, 500, 1000, 2000)) -> DataFrame:
    """The estimation sample.  Steps and their order differ by variant on purpose.

    Group counts and city moments are partial-aggregated and joined back, so a
    hot group never lands in one task.
    """
    keys = [city, group]
    tpis = _has(df, [f"tpi_{r}" for r in radii])
    if variant == "pilot":
        d = df.withColumn("exposure", exposure("housing_units_cell", "pop_cell"))
        d = clip_log_controls(exposure_floor(d))
        more = _has(df, [f"{m}_{r}" for r in radii for m in ("tpiz", "pctl", "relief")])
        d = zscore_by(d, city, tpis + more)
        d = drop_incomplete(d, SES + [f"{c}_z" for c in tpis] + ["exposure", group])
        return min_group_size(d, keys)
    if variant in ("national", "spatial"):
        bldg = variant == "spatial" and "housing_units_bldg" in df.columns
        u, p = ("housing_units_bldg", "pop_bldg") if bldg else ("housing_units_cell", "pop_cell")
        d = clip_log_controls(exposure_floor(df.withColumn("exposure", exposure(u, p))))
        d = zscore_by(d, city, tpis)
        d = sink_filter(covered_groups(d, keys))
        need = SES + ["exposure", group, "n_total"]
        need += [f"{c}_z" for c in tpis] if variant == "national" else ["slope_deg", "x", "y"]
        return min_group_size(drop_incomplete(d, need), keys)
    if variant in ("cells", "dated"):
        d = df.withColumn("exposure", exposure("housing_units_bldg", "pop_bldg"))
        d = sink_filter(clip_log_controls(exposure_floor(d)))
        d = min_group_size(d, keys).withColumn("slope_deg_raw", F.col("slope_deg").cast("double"))
        if variant == "dated":
            return drop_incomplete(d, SES + ["slope_deg_raw", "exposure", group])
        d = zscore_by(d, city, ["tpi_500", "slope_deg"], zero_sd="raw")
        clean = _has(d, ["n_MASS_1", "n_MASS_2", "n_MASS_4", "n_MASS_5", "n_MVT", "n_NO_LOOT"])
        d = d.withColumn("n_theft", theft_total(d)).withColumn("n_clean", sum_classes(*clean))
        return drop_incomplete(d, SES + ["slope_deg_raw", "tpi_500_z", "exposure", group])
    if variant == "segments":
        d = df.where("seg_len_m >= 20") if "seg_len_m" in df.columns else df
        d = d.withColumn("exposure", exposure("housing_units_cell", "pop_cell"))
        d = clip_log_controls(exposure_floor(d, floor=2.0))
        prop = [c for c in d.columns if c.startswith("n_MASS_")] + _has(d, ["n_MVT", "n_NO_LOOT"])
        d = sink_filter(d.withColumn("n_prop", sum_classes(*prop)), total="n_prop")
        d = min_group_size(d, keys).withColumn("slope_deg_raw", F.col("slope_deg").cast("double"))
        net = _has(d, ["betweenness", "intersection_density", "permeability", "egress_count",
                       "walk_drive_ratio"])
        if net:
            d = zscore_by(d, city, net, zero_sd="raw")
        return drop_incomplete(d, SES + ["slope_deg_raw", "exposure", group])
    if variant == "targets":
        d = df.withColumn("expo_housing", exposure("housing_units_cell", "pop_cell"))
        d = clip_log_controls(exposure_floor(d, "expo_housing"), "expo_housing")
        d = sink_filter(covered_groups(d, keys), expo="expo_housing")
        alt = {"expo_park": F.col("park_spaces"), "expo_doors": F.col("front_doors"),
               "expo_both": F.col("park_spaces") + F.col("front_doors"),
               "expo_park_all": F.col("park_spaces") + F.col("garage_parcels") + F.col("osm_park_cap"),
               "expo_units": F.col("addr_units"), "expo_resunits": F.col("resunits"),
               "expo_bldg": F.col("bldg_front")}
        inputs = {"expo_park": ["park_spaces"], "expo_doors": ["front_doors"],
                  "expo_both": ["park_spaces", "front_doors"],
                  "expo_park_all": ["park_spaces", "garage_parcels", "osm_park_cap"],
                  "expo_units": ["addr_units"], "expo_resunits": ["resunits"],
                  "expo_bldg": ["bldg_front"]}
        d = d.withColumns({k: v for k, v in alt.items() if all(c in d.columns for c in inputs[k])})
        d = drop_incomplete(d, SES + ["slope_deg", "tpi_500", group, "n_total"])
        d = zscore_by(d, city, ["slope_deg", "tpi_500"])
        return min_group_size(d, keys)
    raise ValueError(f"unknown sample variant {variant!r}")


def qualifies(df: DataFrame, city: str = "city", radius: int = 500) -> DataFrame:
    """Inclusion by terrain spread and volume, never by the outcome; failing tests are named."""
    g = df.groupBy(city).agg(F.stddev_samp(f"tpi_{radius}").alias("tpi_sd"),
                             F.sum("n_total").cast("bigint").alias("events"),
                             F.count("*").alias("n_units"))
    per = F.col("events") / F.greatest(F.col("n_units"), F.lit(1))
    reasons = F.array_compact(F.array(
        F.when(F.col("tpi_sd") < MIN_TPI_SD, "tpi_sd"),
        F.when(F.col("events") < MIN_EVENTS, "events"),
        F.when(per < MIN_EV_PER_UNIT, "events_per_unit")))
    return g.withColumn("reasons", F.array_join(reasons, ";")).withColumn(
        "included", F.size(reasons) == 0)


def size_gate(df: DataFrame, city: str, min_rows: int, min_events: int,
              total: str = "n_total") -> DataFrame:
    g = df.groupBy(city).agg(F.count("*").alias("_n"), F.sum(total).alias("_e"))
    keep = g.where((F.col("_n") >= min_rows) & (F.col("_e") >= min_events)).select(city)
    return df.join(keep, city, "left_semi")
