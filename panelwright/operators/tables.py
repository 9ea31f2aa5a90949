"""Key joins, grid keys and grouped summaries of panels, incidents and feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.stats import safe_corr
from panelwright.functions.text import ALL_CLASSES, PROPERTY_CLASSES
from panelwright.operators.ranks import average_rank, exact_percentiles, with_group

# ---- fixed values: subcategories regrouped by the target they attack ---------
TARGET_SUBCATS = {
    "n_TFV": ["Larceny - From Vehicle", "Theft From Vehicle"],
    "n_AUTOPARTS": ["Larceny - Auto Parts"],
    "n_MVT_chk": ["Motor Vehicle Theft", "Motor Vehicle Theft (Attempted)"],
    "n_BURG_RES": ["Burglary - Residential", "Burglary - Hot Prowl"],
    "n_BURG_ALL": ["Burglary - Residential", "Burglary - Hot Prowl",
                   "Burglary - Other", "Burglary - Commercial"],
}
VEHICLE_COLUMNS = ["n_TFV", "n_AUTOPARTS", "n_MVT_chk"]
# ---- end of fixed values ------------------------------------------------------


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.when(b != 0, b)


# ---- joins --------------------------------------------------------------------
def outer_join_acs(tables: list[DataFrame], key: str = "GEOID") -> DataFrame:
    """Full outer join of census tables; suppressed medians to null, shares with 0 as null."""
    out = reduce(lambda a, b: a.join(b, key, "full"), tables)
    for c in ("median_hh_income", "median_home_value"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    return out.withColumns({"owner_share": div(F.col("owner_occupied"), F.col("occupied_units")),
                            "vacancy_rate": div(F.col("vacant_units"), F.col("housing_units"))})


def attach_counts(cells: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.join(counts, keys, "left")
    fill = [c for c in counts.columns if c not in keys]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in fill})


def attach_attrs(df: DataFrame, attrs: DataFrame, key: str = "GEOID") -> DataFrame:
    return df.join(attrs, key, "left")


def anti_missing_keys(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def semi_in_list(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return df.join(keep.select(key), key, "left_semi")


def join_many_outer(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), tables).na.fill(0)


def first_per_group_join(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Group attributes that are constant within the group, taken once and mapped back."""
    g = df.groupBy(key).agg(*[F.min(c).alias(f"{c}_first") for c in cols])
    return df.join(g, key)


def dedupe_undirected(edges: DataFrame, city: list[str] = ()) -> DataFrame:
    """One face per (low node, high node, key); a reciprocal pair is one street."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    k = [*city]
    return (edges.withColumns({"lo": lo, "hi": hi})
                 .withColumn("seg_id", F.concat_ws("_", "lo", "hi", "key"))
                 .groupBy(*k, "seg_id", "lo", "hi", "key")
                 .agg(*[F.min(c).alias(c) for c in ("length", "travel_time") if c in edges.columns]))


def shortest_undirected(edges: DataFrame, city: list[str] = ()) -> DataFrame:
    """Shortest of any parallel edges per node pair, self loops dropped."""
    return (edges.where("src != dst").groupBy(*city, F.least("src", "dst").alias("lo"),
                                              F.greatest("src", "dst").alias("hi"))
                 .agg(F.min("length").alias("length")))


# ---- keys ---------------------------------------------------------------------
def grid_bin(df: DataFrame, x: Column, y: Column, left: float, top: float, step: float,
             ncol: int, nrow: int) -> DataFrame:
    """Point to grid cell; truncation toward zero keeps points just off the left/top edge."""
    col = ((x - left) / step).cast("int")
    row = ((top - y) / step).cast("int")
    d = df.withColumns({"col": col, "row": row})
    inside = F.col("row").between(0, nrow - 1) & F.col("col").between(0, ncol - 1)
    return d.where(inside).withColumn("cell", (F.col("row") * ncol + F.col("col")).cast("bigint"))


def centroid_cell(df: DataFrame, x: Column, y: Column, x0: float, y0: float, step: float) -> DataFrame:
    """Cell by nearest centroid from the grid's first centroid (floor of v/step + 1/2)."""
    return df.withColumns({"col_": F.floor((x - x0) / step + 0.5), "row_": F.floor((y0 - y) / step + 0.5)})


# ---- aggregations ---------------------------------------------------------------
SEGMENT_CLASSES = [c for c in ALL_CLASSES if c != "OTHER"]


def class_pivot(df: DataFrame, keys: list[str], klass: str = "klass", classes=None, summed=PROPERTY_CLASSES) -> DataFrame:
    """Counts per key and class with every class present, and n_total over the ``summed`` classes.

    A grid's total is over the property classes; a segment's over all classes but OTHER (SEGMENT_CLASSES).
    """
    classes = classes or ALL_CLASSES
    p = df.groupBy(*keys).pivot(klass, classes).agg(F.count(F.lit(1)))
    p = p.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(f"n_{c}") for c in classes])
    total = reduce(lambda a, b: a + b, [F.col(f"n_{c}") for c in classes if c in summed])
    return p.withColumn("n_total", total)


def conditional_counts(inc: DataFrame, cell: str = "cell") -> DataFrame:
    """Per-cell counts by offence group and period; ``w`` is the stratum weight."""
    th, post = F.col("grp") == "THEFT", F.col("post")
    return inc.groupBy(cell).agg(
        F.count_if(th).alias("n_theft_d"), F.count_if(F.col("grp") == "VANDALISM").alias("n_vandal"),
        F.count_if(F.col("grp") == "ARSON").alias("n_arson"), F.count_if(~th).alias("n_noloot_d"),
        F.sum(F.when(~th, F.col("w")).otherwise(0.0)).alias("n_noloot_w"),
        F.count_if(th & ~post).alias("n_theft_pre"), F.count_if(th & post).alias("n_theft_post"),
        F.count_if(~post).alias("n_all_pre"), F.count_if(post).alias("n_all_post"))


def subset_counts(df: DataFrame, key: str, subcat: str) -> DataFrame:
    out = df.groupBy(key).agg(*[F.count_if(F.col(subcat).isin(v)).alias(k)
                                for k, v in TARGET_SUBCATS.items()])
    return out.withColumn("n_VEH", reduce(lambda a, b: a + b, [F.col(c) for c in VEHICLE_COLUMNS]))


def share_by_group(df: DataFrame, group: list[str], value: str, fallback: str) -> DataFrame:
    """Value share within the group; the length share where that is null or not positive."""
    d = with_group(df, group, _tv=F.sum(value), _tl=F.sum(fallback))
    share = div(F.col(value), F.col("_tv"))
    bad = share.isNull() | (share <= 0)
    return (d.withColumn("exposure_fallback", bad)
             .withColumn("share", F.when(bad, div(F.col(fallback), F.col("_tl"))).otherwise(share))
             .drop("_tv", "_tl"))


def area_apportion(units: Column, cell_area: Column, land_frac: Column, aland: Column) -> Column:
    return units * cell_area * land_frac / F.when(aland != 0, aland)


def value_counts_norm(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of each value among the key's rows, from counts (never from rows)."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if not keys:
        return value_counts_norm(df.withColumn("_all", F.lit(1)), ["_all"], value).drop("_all")
    return with_group(c, keys, _t=F.sum("n")).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def county_share_filter(df: DataFrame, keys: list[str], county: str, least: float = 0.02) -> DataFrame:
    return value_counts_norm(df, keys, county).where(F.col("share") >= least)


def crosstab_weighted(df: DataFrame, pred: str, truth: str, weight: str) -> DataFrame:
    """P(true | predicted), long; labels seen on either side are completed with zeros.

    The label set is a taxonomy (a dozen names); the grid is made of distinct
    labels only.
    """
    d = df.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    n = d.groupBy(F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.sum(weight).alias("n"))
    labels = n.select(F.explode(F.array("pred", "truth")).alias("label")).distinct()
    held = labels.agg(F.array_sort(F.collect_list("label")).alias("_a")).withColumn("_k", F.lit(1))
    grid = labels.select(F.col("label").alias("pred"), F.lit(1).alias("_k")).join(F.broadcast(held), "_k").select(
        "pred", F.explode("_a").alias("truth"))
    full = grid.join(n, ["pred", "truth"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tot = F.sum("n").over(Window.partitionBy("pred"))
    return full.withColumn("p", F.coalesce(F.col("n") / F.when(tot != 0, tot), F.lit(0.0)))


def precision_recall(df: DataFrame, pred: str, truth: str, weight: str) -> DataFrame:
    """Per-class precision, recall and F1, by string and by weight, with a Wilson interval."""
    c = df.groupBy(F.col(pred).alias("p"), F.col(truth).alias("t")).agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"))
    side = F.explode(F.array(F.struct(F.col("p").alias("klass"), F.lit("p").alias("s")),
                             F.struct(F.col("t").alias("klass"), F.lit("t").alias("s"))))
    e = c.select("p", "t", "n", "w", side.alias("_e")).select("p", "t", "n", "w", "_e.*")
    hit, as_p, as_t = (F.col("p") == F.col("t")) & (F.col("s") == "p"), F.col("s") == "p", F.col("s") == "t"
    z = lambda cond, v: F.sum(F.when(cond, F.col(v)).otherwise(0))
    g = e.groupBy("klass").agg(z(hit, "n").alias("tp"), z(as_p, "n").alias("np"), z(as_t, "n").alias("nt"),
                               z(hit, "w").alias("tpw"), z(as_p, "w").alias("npw"), z(as_t, "w").alias("ntw"))
    pr, rc = div(F.col("tp"), F.col("np")), div(F.col("tp"), F.col("nt"))
    zz = 1.96 * 1.96
    mid = (pr + zz / (2 * F.col("np"))) / (1 + zz / F.col("np"))
    half = 1.96 * F.sqrt(pr * (1 - pr) / F.col("np") + zz / (4 * F.col("np") * F.col("np"))) / (1 + zz / F.col("np"))
    return g.select("klass", pr.alias("precision"), rc.alias("recall"), div(2 * pr * rc, pr + rc).alias("f1"),
                    div(F.col("tpw"), F.col("npw")).alias("precision_w"),
                    div(F.col("tpw"), F.col("ntw")).alias("recall_w"),
                    F.when(F.col("np") > 0, mid - half).alias("wilson_lo"),
                    F.when(F.col("np") > 0, mid + half).alias("wilson_hi"))


def class_flow(df: DataFrame, before: Column, after: Column) -> DataFrame:
    return df.groupBy(before.alias("v1"), after.alias("v2")).agg(F.count("*").alias("n"))


def class_delta(df: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Counts before and after reclassing, full-joined, with their difference."""
    side = F.explode(F.array(F.struct(before.alias("klass"), F.lit(1).alias("b"), F.lit(0).alias("a")),
                             F.struct(after.alias("klass"), F.lit(0).alias("b"), F.lit(1).alias("a"))))
    g = df.select(*keys, side.alias("_s")).groupBy(*keys, F.col("_s.klass").alias("klass")).agg(
        F.sum("_s.b").alias("before"), F.sum("_s.a").alias("after"))
    return g.withColumn("delta", F.col("after") - F.col("before"))


def strata_reweight(inc: DataFrame, feed: list[str] = ()) -> DataFrame:
    """Weight no-loot incidents so their hour-by-weekday mix matches theft's; theft keeps 1.

    Only stratum counts (168 per feed) are joined back.
    """
    th = F.col("grp") == "THEFT"
    s = inc.groupBy(*feed, "hour", "dow").agg(F.count_if(th).alias("_t"), F.count_if(~th).alias("_n"))
    w = Window.partitionBy(*feed) if feed else Window.partitionBy(F.lit(1))
    one = lambda c: F.greatest(F.sum(c).over(w), F.lit(1))
    ratio = div(F.col("_t") / one("_t"), F.col("_n") / one("_n"))
    s = s.withColumn("_w", F.coalesce(ratio, F.lit(0.0))).select(*feed, "hour", "dow", "_w")
    return inc.join(s, [*feed, "hour", "dow"], "left").withColumn(
        "w", F.when(th, 1.0).otherwise(F.coalesce("_w", F.lit(0.0)))).drop("_w")


def city_profile(df: DataFrame, city: str = "city", radius: int = 500) -> DataFrame:
    t = f"tpi_{radius}"
    g = df.groupBy(city).agg(
        F.count("*").alias("n_cells"), F.countDistinct("GEOID").alias("n_bg"),
        F.sum("n_total").cast("bigint").alias("n_events"),
        safe_corr(F.col(t).cast("double"), F.col("median_hh_income").cast("double")).alias("rho_income"),
        safe_corr(F.col(t).cast("double"), F.col("median_home_value").cast("double")).alias("rho_value"),
        safe_corr(F.col("elev").cast("double"), F.col("median_hh_income").cast("double")).alias("rho_abs_income"),
        F.stddev_samp("elev").alias("relief_sd"), F.stddev_samp(t).alias("tpi_sd"),
        F.avg(F.when(F.col("n_total") == 0, 1.0).otherwise(0.0)).alias("share_zero"))
    rel = exact_percentiles(df, [city], "elev", [0.01, 0.99], ["_p1", "_p99"])
    area = df.groupBy(city, "GEOID").agg(F.min("ALAND").alias("_a"))
    med = exact_percentiles(area, [city], "_a", [0.5], ["_area"])
    exp_med = exact_percentiles(df, [city], "exposure", [0.5], ["exposure_median"])
    out = g.join(rel, city, "left").join(med, city, "left").join(exp_med, city, "left")
    return (out.withColumn("relief_p99", F.col("_p99") - F.col("_p1"))
               .withColumn("bg_area_km2", F.col("_area") / 1e6).drop("_p1", "_p99", "_area"))


def corr_pairs(df: DataFrame, keys: list[str], pairs: list[tuple[str, Column, Column, str]],
               where: dict[str, Column] | None = None) -> DataFrame:
    """Many correlations in one job: (name, a, b, 'pearson' or 'spearman') per key, long.

    Spearman ranks come from value counts, so ties and hot keys cost nothing extra.
    """
    where = where or {}
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    items = []
    for name, a, b, method in pairs:
        a, b = a.cast("double"), b.cast("double")
        ok = finite(a) & finite(b) & where.get(name, F.lit(True))
        items.append(F.when(ok, F.struct(F.lit(name).alias("metric"), F.lit(method).alias("method"),
                                         a.alias("a"), b.alias("b"))))
    long = df.select(*keys, F.explode(F.array_compact(F.array(*items))).alias("_p")).select(*keys, "_p.*")
    methods = {m for *_, m in pairs}
    out = None
    if "pearson" in methods:
        out = long.where("method = 'pearson'").groupBy(*keys, "metric").agg(
            F.when(F.count("*") > 2, safe_corr(F.col("a"), F.col("b"))).alias("r"))
    if "spearman" in methods:
        k = [*keys, "metric"]
        s = average_rank(average_rank(long.where("method = 'spearman'"), k, "a", "ra"), k, "b", "rb")
        s = s.groupBy(*k).agg(F.when(F.count("*") > 2, safe_corr(F.col("ra"), F.col("rb"))).alias("r"))
        out = s if out is None else out.unionByName(s)
    return out


def weighted_corr(df: DataFrame, keys: list[str], x: str, y: str, w: Column) -> DataFrame:
    """Inverse-variance weighted correlation and line; means first, then centred sums."""
    d = df.withColumn("_w", w)
    m = with_group(d, keys, _mx=F.sum(F.col("_w") * F.col(x)) / F.sum("_w"),
                   _my=F.sum(F.col("_w") * F.col(y)) / F.sum("_w")) if keys else d.join(F.broadcast(
                       d.agg((F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias("_mx"),
                             (F.sum(F.col("_w") * F.col(y)) / F.sum("_w")).alias("_my"))))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    s = lambda e: F.sum(F.col("_w") * e)
    g = m.groupBy(*keys).agg(s(dx * dy).alias("_c"), s(dx * dx).alias("_x"), s(dy * dy).alias("_y"),
                             F.first("_mx").alias("_mx"), F.first("_my").alias("_my"))
    slope = div(F.col("_c"), F.col("_x"))
    return g.select(*keys, (F.col("_c") / F.sqrt(F.col("_x") * F.col("_y"))).alias("r"),
                    slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"))


def qcut_bucket(df: DataFrame, keys: list[str], value: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed quantile bins; repeated edges collapse, as quantile cutting does."""
    probs = [i / bins for i in range(bins + 1)]
    names = [f"_e{i}" for i in range(bins + 1)]
    e = exact_percentiles(df, keys, value, probs, names)
    e = e.select(*keys, F.array_distinct(F.array(*names)).alias("_e"))
    below = F.size(F.filter("_e", lambda c: c < F.col(value)))
    b = F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)))
    return df.join(e, keys, "left").withColumn(out, b).drop("_e")


def dose_response(df: DataFrame, keys: list[str], x: str, rate: Column, bins: int = 10) -> DataFrame:
    d = qcut_bucket(df, keys, x, bins, "dec").withColumn("_rate", rate)
    return d.groupBy(*keys, "dec").agg(F.avg("_rate").alias("rate"), F.avg(x).alias("tpi"), F.count("*").alias("n"))


def tercile(rank: Column, n: Column) -> Column:
    return F.least(F.greatest((rank / n * 3).cast("int"), F.lit(0)), F.lit(2))


def bivariate_class(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    d = average_rank(average_rank(df, keys, a, "_ra"), keys, b, "_rb")
    return d.withColumns({"xi": tercile(F.col("_ra"), F.col("_ra_n")),
                          "yi": tercile(F.col("_rb"), F.col("_rb_n"))}).drop("_ra", "_rb", "_ra_n", "_rb_n")


def coverage_report(df: DataFrame, items: dict[str, Column]) -> DataFrame:
    """Count and share of rows meeting each predicate, long."""
    aggs = []
    for i, cond in enumerate(items.values()):
        c = F.coalesce(cond, F.lit(False))
        aggs += [F.count_if(c).alias(f"n{i}"), F.avg(F.when(c, 1.0).otherwise(0.0)).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("item"), F.col(f"n{i}").alias("n_segments"),
                              F.col(f"s{i}").alias("share")) for i, name in enumerate(items)])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def denominator_pairs(est: DataFrame, keys: list[str]) -> DataFrame:
    """Long (key, offset, beta) to wide housing/target columns."""
    return est.groupBy(*keys).pivot("offset", ["housing", "target"]).agg(F.first("beta"))


def bg_diagonal(df: DataFrame, city: str = "city", group: str = "GEOID") -> DataFrame:
    g = df.groupBy(city, group).agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_d"))
    return exact_percentiles(g, [city], "_d", [0.5], ["bg_diagonal"])


def temporal_counts(inc: DataFrame, keys: list[str], cut: Column) -> DataFrame:
    return inc.groupBy(*keys).agg(
        F.to_date(F.min("ts")).cast("string").alias("window_start"),
        F.to_date(F.max("ts")).cast("string").alias("window_end"),
        F.count_if(F.col("ts") < cut).alias("n_pre"), F.count_if(F.col("ts") >= cut).alias("n_post"))


def noloot_composition(inc: DataFrame, keys: list[str]) -> DataFrame:
    v, a, o = [F.count_if(F.col("grp") == g) for g in ("VANDALISM", "ARSON", "OTHER_NOLOOT")]
    return inc.groupBy(*keys).agg(v.alias("vandalism"), a.alias("arson"), o.alias("other_noloot"),
                                  (a / F.greatest(v + a + o, F.lit(1))).alias("arson_share"))


def relief_split_mean(est: DataFrame, cut: float = 30.0) -> DataFrame:
    flat = F.col("relief_p99") < cut
    return est.agg(F.count_if(flat).alias("n_flat"), F.avg(F.when(flat, F.col("pct"))).alias("mean_flat"),
                   F.count_if(~flat).alias("n_hilly"), F.avg(F.when(~flat, F.col("pct"))).alias("mean_hilly"))


def exposure_diagnose(df: DataFrame, city: str = "city", tpi: str = "tpi_500") -> DataFrame:
    """Old (area) against new (building) exposure, and whether the change follows terrain."""
    old, new = F.col("housing_units_cell"), F.col("housing_units_bldg")
    ok = old.isNotNull() & new.isNotNull() & (old > 0)
    solid = ok & ~F.col("exposure_fallback")
    zero = F.col("bldg_area_m2") <= 0
    big = ok & ((new > 2 * old) | (new < old / 2))
    ratio = F.log((new + 1e-6) / (old + 1e-6))
    d = df.withColumn("_ratio", F.when(ok, ratio)).withColumn("_has", F.when(zero, 0.0).otherwise(1.0))
    n = F.col("n_total").cast("double")
    g = d.groupBy(city).agg(
        F.count("*").alias("cells"), F.sum("bldg_count").cast("bigint").alias("buildings_in_cells"),
        F.count_if(zero).alias("cells_with_no_building"),
        F.count_if(F.col("exposure_fallback")).alias("cells_fallback"),
        F.sum(old).alias("old_sum"), F.sum(new).alias("new_sum"), F.count_if(big).alias("n_change_gt_2x"),
        (F.count_if(big) / F.greatest(F.count_if(ok), F.lit(1))).alias("share_change_gt_2x"),
        F.sum(n).alias("crime_total"),
        (F.sum(F.when(zero, n).otherwise(0.0)) / F.greatest(F.sum(n), F.lit(1.0))).alias("crime_share_in_zero_bldg_cells"))
    t = F.col(tpi)
    pairs = [("pearson_level", old, new, "pearson"), ("spearman_level", old, new, "spearman"),
             ("pearson_log", F.log1p(old), F.log1p(new), "pearson"),
             ("corr_logratio_tpi_all", F.col("_ratio"), t, "spearman"),
             ("corr_logratio_tpi_solid", F.col("_ratio"), t, "spearman"),
             ("corr_logratio_tpi_built", F.col("_ratio"), t, "spearman"),
             ("corr_hasbldg_tpi", F.col("_has"), t, "spearman"),
             ("corr_old_tpi", old, t, "spearman"), ("corr_new_tpi", new, t, "spearman")]
    where = {name: ok for name, *_ in pairs}
    where["corr_logratio_tpi_solid"], where["corr_logratio_tpi_built"] = solid, solid & ~zero
    c = corr_pairs(d, [city], pairs, where).groupBy(city).pivot("metric", [p[0] for p in pairs]).agg(F.first("r"))
    # a city's terciles are reported only when more than 30 solid cells carry a height
    solid_t = with_group(d.where(solid & t.isNotNull()), [city], _nt=F.count("*")).where("_nt > 30")
    b = qcut_bucket(solid_t, [city], tpi, 3, "_b").groupBy(city, "_b").agg((F.sum(new) / F.sum(old)).alias("_q"))
    names = F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.col("_b") + 1)
    b = b.withColumn("_b", F.concat(F.lit("tercile_"), names)).groupBy(city).pivot(
        "_b", ["tercile_low", "tercile_mid", "tercile_high"]).agg(F.first("_q"))
    return g.join(c, city, "left").join(b, city, "left")
