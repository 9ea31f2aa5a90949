"""Choosing a feed's columns from their names and contents; screening and merging feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.text import FLAGS, PROPERTY_CLASSES, classify_text, norm_text

# ---- fixed values: column and feed name patterns ----------------------------
FEED_BAD = (r"(311|fire|ems|medical|dispatch|calls for service|traffic stop|citation|"
            r"parking|permit|inspection|budget|salary|shooting|use of force|resistance|"
            r"complaint against|internal affairs|by (year|month|beat|district|neighborhood)|"
            r"summary|statistic|clearance|stop and frisk|field interview|towed|"
            r"coalition|survey|health)")
FEED_GOOD = (r"(crime|incident|offense|offence|police report|complaint data|"
             r"part 1|part i\b)")
LAYER_GOOD = (r"(crime|incident|offen[cs]e|police|arrest|theft|burglar|larceny|"
              r"blotter|nibrs|ucr|part.?1)")
LAYER_BAD = (r"(density|kernel|heat|hot.?spot|per.?capita|neighborhood|block|tract|"
             r"beat|district|boundar|zone|precinct|summar|aggregat|choropleth|"
             r"buffer|parcel|school|centroid|station|office|camera|fire|ems|"
             r"medical|weather|traffic|crash|accident|shooting|homicide)")
TEST_DOMAIN = r"(demo|test|staging)\."
LAT_NAME = r"(^|_)lat(itude)?(_|$)|^(y|point_y|ycoord|y_coord)$"
LON_NAME = r"(^|_)(lon|lng|long)(gitude|itude)?(_|$)|^(x|point_x|xcoord|x_coord)$"
DATE_NAME = r"(date|datetime|occur|report)"
NOT_DATE_NAME = r"(_id$|^id$|number|num$|code|zip|badge|case|report_?id)"
NOT_COORD_NAME = r"(desc|type|cat|name|code|text|note)"
DESC_NAME = r"(desc|offense|offence|category|type|crime|nibrs|statute)"
DESC_GOOD = (r"(crm_cd_desc|offense|offence|nibrs|ucr|charge|statute|"
             r"crime|incident|violation)")
DESC_BAD = (r"(weapon|premis|vict|status|suspect|arrest|disposition|"
            r"resolution|report_type|agency|beat|district|sector)")
LAT_CATALOG = r"^(lat|latitude|y|point_y|lat_?y|ycoord|y_coord)$"
LON_CATALOG = r"^(lon|long|lng|longitude|x|point_x|lon_?x|xcoord|x_coord)$"
DATE_TIME = r"(date|datetime|occur|report|time)"
DESC_CATALOG = r"(desc|offense|offence|category|type|crime|nibrs|ucr|charge|statute)"
LAT_LAYER = (r"^((geo|map|pt|point|incident)_?)?(lat|latitude|y|ycoord|y_coord|lat_?y)"
             r"(_?(public|wgs84|dd))?$")
LON_LAYER = (r"^((geo|map|pt|point|incident)_?)?(lon|long|lng|longitude|x|xcoord|"
             r"x_coord|lon_?x)(_?(public|wgs84|dd))?$")
DESC_LAYER = (r"(desc|offen|categ|type|crime|nibrs|ucr|charge|statute|text|"
              r"narrat|classif|title|nature|hierarchy)")
OCCURRENCE_NAME = r"(occur|incident|began|start)"
EMPTY_WORDS = ["none", "nan", "null"]
# ---- end of fixed values ----------------------------------------------------


#: Name rules by where a feed was found: registered feeds, catalogue entries, map layers.
DIALECTS = {
    "registry": {"lat": LAT_NAME, "lon": LON_NAME, "date": DATE_NAME, "desc": DESC_NAME, "not_coord": NOT_COORD_NAME},
    "catalog": {"lat": LAT_CATALOG, "lon": LON_CATALOG, "date": DATE_TIME, "desc": DESC_CATALOG, "not_coord": None},
    "layer": {"lat": LAT_LAYER, "lon": LON_LAYER, "date": DATE_TIME, "desc": DESC_LAYER, "not_coord": None},
}


def _like(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(FLAGS + pattern), F.lit(False))


def name_gate(name: Column, good: str = FEED_GOOD, bad: str = FEED_BAD) -> Column:
    return _like(name, good) & ~_like(name, bad)


def desc_score(name: Column) -> Column:
    points = lambda pattern, n: F.when(_like(name, pattern), n).otherwise(0)
    return (points(DESC_GOOD, 2) + points("desc", 1) + points("categor", -1) + points(DESC_BAD, -3))


def rank_desc(cols: DataFrame, feed: str = "feed", pos: str = "pos", name: str = "column_name", dialect: str = "registry"):
    """Description-like columns, most offence-like first, original order within a score."""
    w = Window.partitionBy(feed).orderBy(F.col("score").desc(), F.col(pos))
    return (cols.where(_like(F.col(name), DIALECTS[dialect]["desc"]))
                .withColumn("score", desc_score(F.col(name)))
                .withColumn("place", F.row_number().over(w)))


def pick_coord(cols: DataFrame, pattern: str, out: str, feed: str = "feed", pos: str = "pos",
               name: str = "column_name", but_not: str | None = NOT_COORD_NAME) -> DataFrame:
    """First column of a feed whose name looks like the coordinate and not like ``but_not``."""
    ok = _like(F.col(name), pattern)
    if but_not:
        ok = ok & ~_like(F.col(name), but_not)
    return cols.where(ok).groupBy(feed).agg(F.min_by(name, pos).alias(out))


def pick_field(cols: DataFrame, feed: str = "feed", pos: str = "pos", name: str = "column_name", dialect: str = "registry"):
    """Coordinate, date and description columns of every feed by the name rules of a dialect."""
    rule = DIALECTS[dialect]
    feeds = cols.select(feed).distinct()
    date_ok = _like(F.col(name), rule["date"]) & ~_like(F.col(name), NOT_DATE_NAME)
    best = rank_desc(cols, feed, pos, name, dialect).where("place = 1").select(
        feed, F.col(name).alias("desc_col"))
    coord = lambda axis: pick_coord(cols, rule[axis], f"{axis}_col", feed, pos, name, rule["not_coord"])
    return (feeds.join(coord("lat"), feed, "left").join(coord("lon"), feed, "left")
                 .join(cols.where(date_ok).groupBy(feed).agg(F.min_by(name, pos).alias("date_col")),
                       feed, "left")
                 .join(best, feed, "left"))


def long_values(df: DataFrame, feed: str, columns: list[str]) -> DataFrame:
    """Wide rows to (feed, column_name, value) in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(feed, F.explode(cells).alias("_c")).select(feed, "_c.*")


def score_desc_fields(values: DataFrame, feed: str = "feed", min_values: int = 20,
                      keep: float = 0.15, top: int = 3) -> DataFrame:
    """Share of a column's values the cascade resolves; near-unique columns count 0.3.

    Distinct values are counted first, so every regex runs once per distinct
    value of a column and not once per row.
    """
    v = values.where(F.col("value").isNotNull() & (F.col("value") != "")
                     & ~F.lower("value").isin(EMPTY_WORDS))
    per = v.groupBy(feed, "column_name", "value").agg(F.count("*").alias("_c"))
    hit = F.when(classify_text(norm_text(F.col("value"))) != "OTHER", F.col("_c")).otherwise(0)
    s = per.groupBy(feed, "column_name").agg(
        F.sum("_c").alias("n_values"), F.count("*").alias("n_unique"), F.sum(hit).alias("n_hit"))
    share = F.col("n_hit") / F.col("n_values")
    score = share * F.when(F.col("n_unique") / F.col("n_values") > 0.6, 0.3).otherwise(1.0)
    w = Window.partitionBy(feed).orderBy(F.col("score").desc(), F.col("column_name").desc())
    return (s.where(F.col("n_values") >= min_values).withColumn("score", score)
             .where(F.col("score") > keep)
             .withColumn("place", F.row_number().over(w)).where(F.col("place") <= top))


def pick_date_field(values: DataFrame, parsed: Column, feed: str = "feed",
                    start: str = "2018-01-01", now: Column | None = None) -> DataFrame:
    """The date column with the most rows in the window, occurrence names ahead of paperwork.

    A column whose latest date is not between 1990 and 400 days from ``now`` holds no dates of events.
    """
    now = F.current_timestamp() if now is None else now
    v = values.withColumn("_t", parsed)
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    s = v.groupBy(feed, "column_name").agg(
        F.count("*").alias("_n"), F.count_if(filled).alias("_filled"),
        F.count("_t").alias("_ok"), F.max("_t").alias("_last"), F.countDistinct(F.to_date("_t")).alias("_days"),
        F.count_if(F.col("_t") >= F.lit(start).cast("timestamp")).alias("rows"))
    cover = F.col("_filled") / F.col("_n")
    bonus = F.when(_like(F.col("column_name"), OCCURRENCE_NAME), 1.15).otherwise(1.0)
    good = ((F.col("_filled") >= 20) & (F.col("_ok") >= 0.8 * F.col("_filled"))
            & (F.col("_days") >= 2) & (cover >= 0.5) & (F.col("rows") > 0)
            & (F.col("_last") > F.lit("1990-01-01").cast("timestamp")) & (F.col("_last") < now + F.expr("INTERVAL 400 DAYS"))
            & ~_like(F.col("column_name"), NOT_DATE_NAME))
    s = s.where(good).withColumn("score", F.col("rows") * bonus * cover)
    best = F.max_by(F.struct("column_name", "rows", "score"),
                    F.struct("score", F.col("column_name"))).alias("_b")
    return s.groupBy(feed).agg(best).select(feed, "_b.*")


def feed_quality_gate(feeds: DataFrame) -> DataFrame:
    """Geography, extent and name screens, then the biggest feed of each domain."""
    la, lo = F.col("mxla") - F.col("mnla"), F.col("mxlo") - F.col("mnlo")
    ok = ((F.coalesce("geo_share", F.lit(0.0)) > 0.5) & la.between(0.01, 1.5) & lo.between(0.01, 1.5)
          & F.col("mnla").between(18, 72) & F.col("mxlo").between(-180, -65)
          & name_gate(F.col("name")) & ~_like(F.col("domain"), TEST_DOMAIN))
    w = Window.partitionBy("domain").orderBy(F.col("rows").desc(), F.col("id"))
    return feeds.where(ok).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def class_share_profile(df: DataFrame, feed: str, klass: str = "klass") -> DataFrame:
    prop = F.col(klass).isin(PROPERTY_CLASSES)
    n_prop, n_none = F.count_if(prop), F.count_if(F.col(klass) == "NO_LOOT")
    share = n_none / F.greatest(n_prop, F.lit(1))
    return df.groupBy(feed).agg(
        F.count("*").alias("n"), (n_prop / F.count("*")).alias("prop_share"),
        share.alias("no_loot_share"), (F.round(share, 3) >= 0.03).alias("no_loot"))


def merge_shards(layers: DataFrame, most: int = 6) -> DataFrame:
    """Per city, walk layers best first and keep those that overlap none kept so far.

    Only the best layer's host can contribute, and of layers with one date
    range only the best can be kept (a second would overlap it).  Both cuts are
    grouped reductions made before a city's distinct ranges are folded.
    """
    rank = F.struct(F.col("no_loot").cast("int").alias("a"), F.col("date_max").alias("b"),
                    F.col("rows").alias("c"), F.col("url"))
    item = F.struct(rank.alias("rank"), "url", "host", "date_min", "date_max", "rows")
    best = layers.groupBy("city").agg(F.max(item)["host"].alias("host"))
    home = layers.join(best, ["city", "host"], "left_semi")
    one = home.groupBy("city", "date_min", "date_max").agg(F.max(item).alias("_x"))
    ordered = one.groupBy("city").agg(F.reverse(F.array_sort(F.collect_list("_x"))).alias("_l"))
    empty = F.slice("_l", 1, 0)

    def step(kept, x):
        clash = F.exists(kept, lambda k: ~((x["date_max"] < k["date_min"]) | (k["date_max"] < x["date_min"])))
        return F.when(clash | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(x)))

    kept = ordered.select("city", F.aggregate("_l", empty, step).alias("k"))
    total = F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + x["rows"])
    return kept.select("city", F.array_join(F.transform("k", lambda x: x["url"]), "|").alias("url"),
                       total.alias("rows"),
                       F.array_min(F.transform("k", lambda x: x["date_min"])).alias("date_min"),
                       F.array_max(F.transform("k", lambda x: x["date_max"])).alias("date_max"),
                       F.size("k").cast("bigint").alias("n_layers"))
