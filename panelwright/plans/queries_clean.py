"""Queries: scans, sinks, cleaning, predicates, feed screens (with SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import geo, terrain, text
from panelwright.functions.stats import _ERFC, ln, norm_cdf
from panelwright.operators import clean, fields, sample
from panelwright.plans import inputs as I
from panelwright.plans.inputs import INC_SQL, PANEL_SQL, q6, r6
from panelwright.plans.registry import query
from panelwright.session import scratch_path
from panelwright.sources import readers, writers

TS_SQL = "epoch_us(ts)"
ts_us = lambda c: F.unix_micros(F.col(c))


@query("scan_parquet", 'SELECT l_orderkey, l_partkey, l_quantity FROM lineitem')
def _(t):
    return readers.scan_parquet(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@query("scan_parquet_glob", """SELECT 'region' AS city, 'cell' AS unit, count(*) AS n FROM region
  UNION ALL SELECT 'nation', 'segment', count(*) FROM nation""")
def _(t):
    stage = scratch_path(t.spark, "glob")
    for name in ("region", "nation"):
        t.spark.read.parquet(f"{t.folder}/{name}.parquet").select(
            F.col(f"{name[0]}_{name}key").cast("bigint").alias("k")).write.parquet(f"{stage}/{name}.parquet")
    found = readers.scan_parquet_glob(t.spark, f"{stage}/*.parquet").groupBy("city").agg(F.count("*").alias("n"))
    unit = F.when(F.col("city") == "nation", F.array(F.lit("cell"), F.lit("segment"))).otherwise(F.array(F.lit("cell")))
    return readers.prefer_segments(found.select("city", F.explode(unit).alias("unit"), "n"))


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey::INT AS c_nationkey, c_acctbal FROM customer")
def _(t):
    path = scratch_path(t.spark, "csv")
    writers.sink_csv(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return readers.scan_csv(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double")


@query("scan_psv_acs", """SELECT printf('%012d', s_suppkey) AS "GEOID",
  CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS median_hh_income FROM supplier WHERE s_suppkey % 4 <> 0""")
def _(t):
    path = scratch_path(t.spark, "psv")
    k = F.col("s_suppkey")
    head = F.when(k % 4 != 0, F.lit("1500000US")).otherwise(F.lit("1400000US"))
    t.supplier.select(
        F.concat(head, F.lpad(k.cast("string"), 12, "0")).alias("GEO_ID"),
        F.when(k % 9 != 0, F.col("s_acctbal").cast("string")).otherwise("N/A").alias("B19013_E001"),
    ).write.option("sep", "|").option("header", "true").csv(path)
    return readers.scan_psv_acs(t.spark, path, {"B19013_E001": "median_hh_income"})


@query("scan_json_pages", f"""WITH {INC_SQL} SELECT feed AS source, event_id AS record_id, desc1, lat, lon FROM inc
  WHERE lat IS NOT NULL AND desc1 IS NOT NULL""")
def _(t):
    path = scratch_path(t.spark, "pages")
    rows = I.incidents(t).where("lat is not null and desc1 is not null")
    rec = F.struct(F.struct(F.col("event_id").alias("record_id"), "desc1").alias("attributes"),
                   F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("geometry"))
    # pages of 50 records; every tenth record is repeated on the next page
    page = F.array(F.floor(F.col("event_id") / 50),
                   F.when(F.col("event_id") % 10 == 0, F.floor(F.col("event_id") / 50) + 1))
    pages = rows.select(F.col("feed").alias("source"), F.explode(F.array_compact(page)).alias("page"), rec.alias("r"))
    pages.groupBy("source", "page").agg(F.collect_list("r").alias("features")).select(
        "source", "features").write.json(path)
    return readers.scan_json_pages(t.spark, path, "record_id: bigint, desc1: string")


PAGES_SQL = f"""WITH {INC_SQL} SELECT feed AS source, event_id AS record_id, desc1, lat, lon FROM inc WHERE lat IS NOT NULL AND desc1 IS NOT NULL"""


def _pages(t, page):
    """Rows landed in pages of 50, every tenth record also on the next page, as (source, page) with ``page`` made of the rows."""
    path = scratch_path(t.spark, "pages")
    rows = I.incidents(t).where("lat is not null and desc1 is not null")
    at = F.array(F.floor(F.col("event_id") / 50), F.when(F.col("event_id") % 10 == 0, F.floor(F.col("event_id") / 50) + 1))
    rec = F.struct(F.col("event_id").cast("string").alias("record_id"), "desc1", F.col("lat").cast("string").alias("latitude"), "lon")
    d = rows.select(F.col("feed").alias("source"), F.explode(F.array_compact(at)).alias("n"), rec.alias("r"))
    d.groupBy("source", "n").agg(F.collect_list("r").alias("r")).select("source", page.alias("page")).write.json(path)
    return readers.scan_json_pages(t.spark, path, "record_id: bigint, desc1: string", lat="latitude", lon="lon")


@query("scan_json_rows", PAGES_SQL)
def _(t):
    return _pages(t, F.col("r"))


@query("scan_json_records", PAGES_SQL)
def _(t):
    return _pages(t, F.struct(F.struct(F.col("r").alias("records"), F.size("r").alias("total")).alias("result")))


@query("scan_geojsonseq", f"""WITH {I.BLD_SQL} SELECT b AS id, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy FROM bld
  WHERE x1 >= 500 AND x0 <= 4000 AND y1 >= 100 AND y0 <= 3000""")
def _(t):
    path = scratch_path(t.spark, "geojson")
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda v: F.array(v["x"], v["y"]))
    I.buildings(t).select(
        F.lit("Feature").alias("type"), F.struct(F.col("b").alias("id")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    ).write.option("compression", "gzip").json(path)
    return readers.scan_geojsonseq(t.spark, path, (500.0, 100.0, 4000.0, 3000.0)).drop("parts")


@query("scan_pixels", f"WITH {I.PIX_SQL} SELECT raster_id, row, col, CASE WHEN z < 60 THEN z END AS z FROM px")
def _(t):
    return readers.scan_pixels(I.pixels(t), high=60.0)


@query("cap_recent", f"""WITH {INC_SQL} SELECT feed, event_id FROM inc
  QUALIFY row_number() OVER (PARTITION BY feed ORDER BY ts DESC, event_id) <= 500""")
def _(t):
    return clean.cap_recent(I.incidents(t), "feed", "ts", "event_id", 500).select("feed", "event_id")


@query("limit_recent", f"""WITH {INC_SQL} SELECT feed, event_id FROM inc ORDER BY ts DESC, event_id LIMIT 100""")
def _(t):
    return I.incidents(t).orderBy(F.col("ts").desc(), "event_id").limit(100).select("feed", "event_id")


@query("cap_start_date", f"""WITH {INC_SQL}, a AS (SELECT feed, ts FROM inc UNION ALL SELECT feed || '_old', CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 30 YEARS END FROM inc WHERE event_id % 40 = 0),
  d AS (SELECT feed, ts::DATE AS day, count(*) AS c FROM a WHERE ts >= DATE '2018-01-01' GROUP BY 1, 2), f AS (SELECT DISTINCT feed FROM a),
  r AS (SELECT feed, day, c, sum(c) OVER (PARTITION BY feed ORDER BY day DESC) AS k FROM d)
  SELECT feed, coalesce(min(day) FILTER (k <= CASE WHEN feed = 'feed_3' THEN 1 ELSE 700 END), DATE '2018-01-01')::VARCHAR AS start_day,
    coalesce(max(k) FILTER (k <= CASE WHEN feed = 'feed_3' THEN 1 ELSE 700 END), sum(c), 0)::BIGINT AS rows_kept FROM f LEFT JOIN r USING (feed) GROUP BY feed""")
def _(t):
    # one feed is held to a cap that its newest day exceeds; feeds with old and undated rows only stay
    inc, one, k = I.incidents(t), F.col("feed") == "feed_3", F.col("event_id")
    old = inc.where(k % 40 == 0).select(F.concat("feed", F.lit("_old")).alias("feed"), F.when(k % 2 == 0, F.col("ts") - F.expr("INTERVAL 30 YEARS")).alias("ts"))
    inc = inc.select("feed", "ts").unionByName(old)
    got = clean.cap_start_date(inc.where(~one), "feed", "ts", 700).unionByName(clean.cap_start_date(inc.where(one), "feed", "ts", 1))
    return got.withColumn("start_day", F.col("start_day").cast("string"))


@query("sink_parquet", 'SELECT c_custkey, c_nationkey::INT AS c_nationkey FROM customer')
def _(t):
    path = scratch_path(t.spark, "sink")
    writers.sink_parquet(t.customer.select("c_custkey", "c_nationkey"), path, by="c_nationkey")
    return t.spark.read.parquet(path)


@query("sink_csv", "SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation")
def _(t):
    path = scratch_path(t.spark, "sinkcsv")
    writers.sink_csv(t.nation.select("n_nationkey", "n_name"), path)
    return readers.scan_csv(t.spark, path, "n_nationkey int, n_name string")


@query("sink_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = scratch_path(t.spark, "sinkjson")
    writers.sink_json(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return t.spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").json(path)


@query("upsert_rows", """SELECT c_nationkey::INT AS city, sum(c_custkey)::BIGINT AS v, NULL::BIGINT AS extra FROM customer
    WHERE c_nationkey % 5 <> 0 GROUP BY 1
  UNION ALL SELECT s_nationkey::INT, sum(s_suppkey)::BIGINT, count(*) FROM supplier WHERE s_nationkey % 5 = 0 GROUP BY 1
  UNION ALL SELECT c_nationkey::INT, sum(c_custkey)::BIGINT, NULL FROM customer WHERE c_nationkey % 5 = 0
    AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 5 = 0) GROUP BY 1""")
def _(t):
    old = t.customer.groupBy(F.col("c_nationkey").cast("int").alias("city")).agg(F.sum("c_custkey").alias("v"))
    new = t.supplier.where("s_nationkey % 5 = 0").groupBy(F.col("s_nationkey").cast("int").alias("city")).agg(
        F.sum("s_suppkey").alias("v"), F.count("*").alias("extra"))
    return writers.upsert_rows(old, new)


@query("append_manifest", """SELECT 'customer' AS name, count(*) AS n FROM customer
  UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "manifest")
    for name in ("customer", "supplier"):
        src = t.spark.read.parquet(f"{t.folder}/{name}.parquet")
        writers.append_manifest(src.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"), path)
    return t.spark.read.parquet(path)


@query("cache_or_build", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "stage")
    build = lambda: t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    writers.cache_or_build(t.spark, path, build)
    return writers.cache_or_build(t.spark, path, build)


@query("union_by_name", """SELECT c_custkey AS k, c_nationkey::INT AS nation, c_mktsegment AS seg FROM customer
  UNION ALL SELECT s_suppkey, s_nationkey::INT, NULL FROM supplier""")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_mktsegment").alias("seg"))
    b = t.supplier.select(F.col("s_nationkey").cast("int").alias("nation"), F.col("s_suppkey").alias("k"))
    return writers.union_by_name(a, b)


# ---- cleaning -------------------------------------------------------------------
@query("coerce_numeric", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events""")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n/a "), F.col("value"))).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", clean.coerce_numeric(raw).alias("v"))


@query("valid_latlon", f"""WITH {INC_SQL} SELECT event_id, lat, lon FROM inc
  WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND lat <> 0 AND lon <> 0""")
def _(t):
    return I.incidents(t).where(clean.valid_latlon(F.col("lat"), F.col("lon"))).select("event_id", "lat", "lon")


VALID_SQL = f"""{INC_SQL}, v AS (SELECT * FROM inc WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
    AND lat <> 0 AND lon <> 0),
  med AS (SELECT feed, median(lat) AS med_lat, median(lon) AS med_lon FROM v GROUP BY feed),
  anch AS (SELECT v.* FROM v JOIN med USING (feed) WHERE abs(lat - med_lat) <= 1.0 AND abs(lon - med_lon) <= 1.5)"""


def valid(t):
    return I.incidents(t).where(clean.valid_latlon(F.col("lat"), F.col("lon")))


@query("median_anchor_filter", f"WITH {VALID_SQL} SELECT feed, event_id FROM anch")
def _(t):
    return clean.median_anchor_filter(valid(t), "feed").select("feed", "event_id")


@query("parse_datetime", """SELECT event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS sec FROM events WHERE event_id % 11 <> 0
  UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 11 = 0""")
def _(t):
    k, ts = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    layouts = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'",
               "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss'+00'", "MM/dd/yyyy hh:mm:ss a", "M/d/yyyy H:mm:ss", "MM/dd/yyyy HH:mm:ss",
               "yyyy/MM/dd HH:mm:ss"]
    epoch = (F.unix_seconds(ts) * 1000).cast("string")
    raw = F.when(k % 11 == 0, "not a date").when(k % 3 == 2, epoch)
    for n, f in enumerate(layouts):
        raw = raw.when(k % 10 == n, F.date_format(ts, f))
    d = t.events.select(k, (k % 3).alias("feed"), raw.alias("raw"))
    return clean.parse_datetime(d, "feed", "raw").select("event_id", F.unix_seconds("ts").alias("sec"))


@query("date_window", """SELECT event_id FROM events WHERE ts + to_days(((event_id % 5) * 9)::INT)
   BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2024-02-01' + INTERVAL 2 DAYS""")
def _(t):
    ts = F.col("ts").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 5) * 9)
    return t.events.where(clean.date_window(ts, F.lit("2024-02-01").cast("timestamp"))).select("event_id")


@query("robust_bbox", f"""WITH {VALID_SQL}, b AS (SELECT feed, quantile_cont(lat, 0.003) AS s0, quantile_cont(lat, 0.997) AS n0,
    quantile_cont(lon, 0.003) AS w0, quantile_cont(lon, 0.997) AS e0 FROM anch GROUP BY feed)
  SELECT feed, {q6('w0 - 1500 / (111000.0 * cos(radians((s0 + n0) / 2)))')} AS w, {q6('s0 - 1500 / 111000.0::DOUBLE')} AS s,
    {q6('e0 + 1500 / (111000.0 * cos(radians((s0 + n0) / 2)))')} AS e, {q6('n0 + 1500 / 111000.0::DOUBLE')} AS n FROM b""")
def _(t):
    b = clean.robust_bbox(clean.median_anchor_filter(valid(t), "feed"), "feed")
    return b.select("feed", *[r6(c).alias(c) for c in "wsen"])


@query("pad_bbox", f"""WITH {VALID_SQL}, b AS (SELECT feed, min(lon) w, min(lat) s, max(lon) e, max(lat) n FROM anch GROUP BY 1)
  SELECT feed, {q6('w - 500 / (111000.0 * cos(radians((s + n) / 2)))')} AS w, {q6('s - 500 / 111000.0::DOUBLE')} AS s,
    {q6('e + 500 / (111000.0 * cos(radians((s + n) / 2)))')} AS e, {q6('n + 500 / 111000.0::DOUBLE')} AS n FROM b""")
def _(t):
    b = clean.median_anchor_filter(valid(t), "feed").groupBy("feed").agg(
        F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    w, s, e, n = geo.pad_bbox(*[F.col(c) for c in "wsen"], 500.0)
    return b.select("feed", r6(w).alias("w"), r6(s).alias("s"), r6(e).alias("e"), r6(n).alias("n"))


@query("utm_zone", f"""WITH {INC_SQL} SELECT event_id,
   (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6)::INT + 1)::INT AS epsg FROM inc WHERE lat IS NOT NULL""")
def _(t):
    return I.incidents(t).where("lat is not null").select("event_id", geo.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"))


def utm_sql(source: str) -> str:
    """The same Krueger series in SQL over (event_id, lat, lon) rows of ``source``."""
    at = lambda v: f"(0.5 * ln((1 + {v}) / (1 - {v})))"
    sh = lambda v: f"((exp({v}) - exp(-({v}))) / 2)"
    ch = lambda v: f"((exp({v}) + exp(-({v}))) / 2)"
    e = "eta" + "".join(f" + {a!r}::DOUBLE * cos({2*j}*xi) * {sh(f'{2*j}*eta')}" for j, a in enumerate(geo.ALPHA, 1))
    n = "xi" + "".join(f" + {a!r}::DOUBLE * sin({2*j}*xi) * {ch(f'{2*j}*eta')}" for j, a in enumerate(geo.ALPHA, 1))
    scale = f"{0.9996 * geo.RECTIFYING!r}::DOUBLE"
    return f"""p1 AS (SELECT *, radians(lat) AS phi, radians(lon - ((floor((lon + 180) / 6) + 1) * 6 - 183)) AS lam FROM {source}),
      p2 AS (SELECT *, {sh(f"({at('sin(phi)')} - {geo.ECC!r}::DOUBLE * {at(f'({geo.ECC!r}::DOUBLE * sin(phi))')})")} AS tt FROM p1),
      p3 AS (SELECT *, atan2(tt, cos(lam)) AS xi, {at('(sin(lam) / sqrt(1 + tt * tt))')} AS eta FROM p2),
      utm AS (SELECT *, 500000.0::DOUBLE + {scale} * ({e}) AS ux,
        CASE WHEN lat < 0 THEN 10000000.0::DOUBLE ELSE 0 END + {scale} * ({n}) AS uy FROM p3)"""


@query("project_utm", f"WITH {VALID_SQL}, {utm_sql('anch')} SELECT event_id, {q6('ux', 4)} AS ux, {q6('uy', 4)} AS uy FROM utm")
def _(t):
    d = clean.median_anchor_filter(valid(t), "feed")
    return geo.project_utm(d).select("event_id", r6("ux", 4).alias("ux"), r6("uy", 4).alias("uy"))


DESC_SQL = "(coalesce(desc1, '') || ' ' || coalesce(event_type, '') || ' ' || coalesce(subcat, ''))"


@query("concat_desc", f"WITH {INC_SQL} SELECT event_id, {DESC_SQL} AS text FROM inc")
def _(t):
    return I.incidents(t).select("event_id", text.concat_desc(F.col("desc1"), F.col("event_type"), F.col("subcat")).alias("text"))


@query("norm_text", f"""WITH {INC_SQL} SELECT event_id, regexp_replace(coalesce(desc1, ''), '[-_/|]+', ' ', 'g') AS text FROM inc""")
def _(t):
    return I.incidents(t).select("event_id", text.norm_text(F.col("desc1")).alias("text"))


# ---- classification ---------------------------------------------------------------
AHEAD = r"\s*(part|accessor|licen|plate|tag)"
PART_PHRASE = r"(theft of (a )?(motor )?vehicle|larceny of motor vehicle)" + AHEAD


def cascade_sql(textexpr: str, rules) -> str:
    """RE2 has no look-ahead: the excluded phrases are masked out of a copy before the rule is tried."""
    out = "CASE"
    esc = lambda p: p.replace("'", "''")
    for klass, pattern, guard in rules:
        subject = textexpr
        if text.PARTS_AHEAD in pattern:
            pattern = pattern.replace(text.PARTS_AHEAD, "")
            subject = f"regexp_replace({textexpr}, '{esc(PART_PHRASE)}', '#', 'gi')"
        cond = f"regexp_matches({subject}, '{esc(pattern)}', 'i')"
        if guard:
            cond += f" AND regexp_matches({textexpr}, '{esc(guard)}', 'i')"
        out += f" WHEN {cond} THEN '{klass}'"
    return out + " ELSE 'OTHER' END"


TEXTS_SQL = f"""{INC_SQL}, txt AS (
    SELECT 'inc' AS src, event_id AS id, coalesce(desc1, '') AS s FROM inc
    UNION ALL SELECT 'doc', doc_id, text FROM documents
    UNION ALL SELECT 'page', page_id, html FROM pages
    UNION ALL SELECT 'conv', conv_id * 1000 + turn, text FROM conversations
    UNION ALL SELECT 'part', p_partkey, p_name || ' ' || p_type FROM part)"""


def texts(t):
    one = lambda df, src, key, s: df.select(F.lit(src).alias("src"), key.cast("bigint").alias("id"), s.alias("s"))
    return writers.union_by_name(
        one(I.incidents(t), "inc", F.col("event_id"), F.coalesce("desc1", F.lit(""))),
        one(t.documents, "doc", F.col("doc_id"), F.col("text")),
        one(t.pages, "page", F.col("page_id"), F.col("html")),
        one(t.conversations, "conv", F.col("conv_id") * 1000 + F.col("turn"), F.col("text")),
        one(t.part, "part", F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type")))


@query("classify_text", f"WITH {TEXTS_SQL} SELECT src, id::BIGINT AS id, {cascade_sql('s', text.RULES_V1)} AS klass FROM txt")
def _(t):
    return texts(t).select("src", "id", text.classify_text(F.col("s")).alias("klass"))


@query("classify_text_v2", f"""WITH {TEXTS_SQL}, n AS (SELECT src, id, regexp_replace(s, '[-_/|]+', ' ', 'g') AS s FROM txt)
  SELECT src, id::BIGINT AS id, {cascade_sql('s', text.RULES_V2)} AS klass FROM n""")
def _(t):
    return texts(t).select("src", "id", text.classify_text_v2(F.col("s")).alias("klass"))


EXACT_SQL = "CASE subcat " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in {**{k: f"MASS_{r}" for k, r in text.RANK_OF_SUBCATEGORY.items()},
                                          **text.CLASS_OF_SUBCATEGORY}.items()) + " ELSE 'OTHER' END"
KLASS_SQL = f"""{INC_SQL}, kl AS (SELECT *, {cascade_sql("coalesce(desc1, '')", text.RULES_V1)} AS klass FROM inc)"""


@query("classify_exact", f"""WITH {INC_SQL} SELECT event_id, {EXACT_SQL} AS klass FROM inc""")
def _(t):
    return I.incidents(t).select("event_id", text.classify_exact(F.col("subcat")).alias("klass"))


@query("mask_lookup", f"""WITH {INC_SQL}, k AS (SELECT event_id, {EXACT_SQL} AS klass FROM inc)
  SELECT event_id, klass, CASE WHEN klass LIKE 'MASS_%' THEN klass[6:6]::INT END AS rank FROM k""")
def _(t):
    k = text.classify_exact(F.col("subcat"))
    return I.incidents(t).select("event_id", k.alias("klass"), text.loot_rank(k).alias("rank"))


@query("loot_rank", f"""WITH {KLASS_SQL} SELECT event_id, CASE WHEN klass LIKE 'MASS_%' THEN klass[6:6]::INT END AS rank FROM kl""")
def _(t):
    return I.incidents(t).select("event_id", text.loot_rank(text.classify_text(F.col("desc1"))).alias("rank"))


@query("class_kg", f"""WITH {KLASS_SQL} SELECT event_id, (CASE klass WHEN 'MASS_1' THEN 0.3 WHEN 'MASS_2' THEN 2 WHEN 'MASS_3' THEN 7
   WHEN 'MASS_4' THEN 14 WHEN 'MASS_5' THEN 25 END)::DOUBLE AS kg FROM kl""")
def _(t):
    return I.incidents(t).select("event_id", text.class_kg(text.classify_text(F.col("desc1"))).alias("kg"))


SUB_SQL = """CASE WHEN regexp_matches(coalesce(desc1, ''), '\\barson\\b|\\bincendiar', 'i') THEN 'ARSON'
  WHEN regexp_matches(coalesce(desc1, ''), 'vandal|criminal damag|malicious mischief|criminal mischief|graffiti|destruction/damage|destruction of property|damage to property', 'i')
  THEN 'VANDALISM' ELSE 'OTHER_NOLOOT' END"""


@query("noloot_subclass", f"WITH {INC_SQL} SELECT event_id, {SUB_SQL} AS sub FROM inc")
def _(t):
    return I.incidents(t).select("event_id", text.noloot_subclass(F.col("desc1")).alias("sub"))


@query("offence_group", f"""WITH {KLASS_SQL} SELECT event_id, CASE WHEN klass LIKE 'MASS_%' THEN 'THEFT'
   WHEN klass = 'NO_LOOT' THEN {SUB_SQL} ELSE 'SKIP' END AS grp FROM kl""")
def _(t):
    return I.incidents(t).select("event_id", text.offence_group(text.classify_text(F.col("desc1")), F.col("desc1")).alias("grp"))


# ---- scalar families ----------------------------------------------------------------
def erf_sql(z: str) -> str:
    a = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    tt = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {a}))"
    poly = repr(_ERFC[-1]) + "::DOUBLE"
    for c in reversed(_ERFC[:-1]):
        poly = f"({poly} * {tt} + ({c!r}))"
    tail = f"({tt} * exp({poly} - {a} * {a}) / 2.0)"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


@query("norm_cdf", f"SELECT event_id, {q6(erf_sql('((value - 50) / 40)'))} AS p FROM events")
def _(t):
    return t.events.select("event_id", r6(norm_cdf((F.col("value") - 50) / 40)).alias("p"))


GRAD = "((l_discount - l_tax) * 8)"
CLIPG = f"greatest(least({GRAD}, 0.5::DOUBLE), -0.5::DOUBLE)"
MINETTI_SQL = lambda g: (f"((((((1337.8::DOUBLE * {g} + 278.19) * {g} - 517.39) * {g} - 78.199) * {g} + 93.419) * {g} + 19.825) * {g} + 1.64)")


@query("minetti_cost", f"SELECT l_orderkey, l_linenumber::INT AS l_linenumber, {q6(MINETTI_SQL(CLIPG))} AS cost FROM lineitem")
def _(t):
    g = (F.col("l_discount") - F.col("l_tax")) * 8
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), r6(terrain.minetti_cost(g)).alias("cost"))


@query("tobler_speed", f"SELECT l_orderkey, l_linenumber::INT AS l_linenumber, {q6(f'6.0 * exp(-3.5 * abs({GRAD} + 0.05))')} AS kmh FROM lineitem")
def _(t):
    g = (F.col("l_discount") - F.col("l_tax")) * 8
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), r6(terrain.tobler_speed(g)).alias("kmh"))


@query("vertical_work_kj", f"SELECT event_id, {q6('75.0::DOUBLE * 9.81 * greatest(value - 100, 0) / 1000.0', 8)} AS kj FROM events")
def _(t):
    return t.events.select("event_id", r6(terrain.vertical_work_kj(F.col("value") - 100), 8).alias("kj"))


@query("string_functions", """SELECT event_id, lower(desc1) AS lo, starts_with(desc1, 'THEFT') AS st, lpad((event_id % 1000)::VARCHAR, 9, '0') AS z,
   regexp_replace(lower(desc1), '[^a-z0-9]+', '_', 'g') AS slug, len(string_split(subcat, ' - '))::INT AS parts
   FROM (WITH """ + INC_SQL + """ SELECT * FROM inc)""")
def _(t):
    d = F.col("desc1")
    return I.incidents(t).select("event_id", F.lower(d).alias("lo"), d.startswith("THEFT").alias("st"),
                                 F.lpad((F.col("event_id") % 1000).cast("string"), 9, "0").alias("z"),
                                 text.slugify(d).alias("slug"), F.size(F.split("subcat", " - ")).alias("parts"))


@query("date_functions", f"""SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS dow, ts >= TIMESTAMP '2024-01-15' AS post,
   ts::DATE::VARCHAR AS day, {q6("date_diff('day', DATE '2018-01-01', ts::DATE) / 365.25")} AS years FROM events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.hour(ts).alias("hour"), F.weekday(ts).alias("dow"),
                           (ts >= F.lit("2024-01-15").cast("timestamp")).alias("post"), F.to_date(ts).cast("string").alias("day"),
                           r6(F.datediff(F.to_date(ts), F.lit("2018-01-01").cast("date")) / 365.25).alias("years"))


@query("math_functions", f"""SELECT event_id, {q6('ln(value)')} AS a, {q6('ln(1 + value)')} AS b, {q6('sqrt(value * value + 9)')} AS c,
   {q6('degrees(atan(value / 100))')} AS d, {q6('100 * (exp(value / 1000) - 1)')} AS e, floor(value)::BIGINT AS f FROM events""")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", r6(ln(v)).alias("a"), r6(ln(v, 1.0)).alias("b"), r6(F.hypot(v, F.lit(3.0))).alias("c"),
                           r6(F.degrees(F.atan(v / 100))).alias("d"), r6(100 * (F.exp(v / 1000) - 1)).alias("e"), F.floor(v).alias("f"))


# ---- sample steps -------------------------------------------------------------------
@query("clip_log_controls", f"""WITH {PANEL_SQL} SELECT cell, {q6('CASE WHEN median_hh_income IS NOT NULL THEN ln(greatest(median_hh_income, 5000)) END')} AS log_income,
   {q6('CASE WHEN median_home_value IS NOT NULL THEN ln(greatest(median_home_value, 50000)) END')} AS log_value,
   {q6('ln(housing_units_cell + pop_cell)')} AS log_density FROM panel""")
def _(t):
    d = sample.clip_log_controls(I.panel(t).withColumn("exposure", sample.exposure("housing_units_cell", "pop_cell")))
    return d.select("cell", *[r6(c).alias(c) for c in ("log_income", "log_value", "log_density")])


@query("zscore_by_city", f"""WITH {PANEL_SQL} SELECT cell, {q6('(tpi_500 - avg(tpi_500) OVER w) / stddev_samp(tpi_500) OVER w')} AS tpi_500_z
   FROM panel WINDOW w AS (PARTITION BY city)""")
def _(t):
    return sample.zscore_by(I.panel(t), "city", ["tpi_500"]).select("cell", r6("tpi_500_z").alias("tpi_500_z"))


@query("exposure_floor", f"WITH {PANEL_SQL} SELECT cell FROM panel WHERE housing_units_cell + pop_cell > 250")
def _(t):
    d = I.panel(t).withColumn("exposure", sample.exposure("housing_units_cell", "pop_cell"))
    return sample.exposure_floor(d, floor=250.0).select("cell")


@query("covered_groups", f"""WITH {PANEL_SQL} SELECT cell FROM panel QUALIFY sum(CASE WHEN "GEOID" % 4 = 0 THEN 0 ELSE n_total END) OVER (PARTITION BY city, "GEOID") > 0""")
def _(t):
    d = I.panel(t).withColumn("n_total", F.when(F.col("GEOID") % 4 == 0, 0).otherwise(F.col("n_total")))
    return sample.covered_groups(d, ["city", "GEOID"]).select("cell")


@query("sink_filter", f"WITH {PANEL_SQL} SELECT cell FROM panel WHERE n_total / greatest(housing_units_cell, 1.0) < 0.4")
def _(t):
    return sample.sink_filter(I.panel(t), expo="housing_units_cell", cap=0.4).select("cell")


@query("min_group_size", f"""WITH {PANEL_SQL}, f AS (SELECT * FROM panel WHERE n_MVT >= 6)
   SELECT cell FROM f QUALIFY count(*) OVER (PARTITION BY city, "GEOID") >= 3""")
def _(t):
    return sample.min_group_size(I.panel(t).where("n_MVT >= 6"), ["city", "GEOID"]).select("cell")


@query("drop_incomplete", f'WITH {PANEL_SQL} SELECT cell FROM panel WHERE median_hh_income IS NOT NULL AND "ALAND" IS NOT NULL')
def _(t):
    return sample.drop_incomplete(I.panel(t), ["median_hh_income", "ALAND"]).select("cell")


LOGS = """*, CASE WHEN median_hh_income IS NOT NULL THEN ln(greatest(median_hh_income, 5000)) END AS log_income,
  CASE WHEN median_home_value IS NOT NULL THEN ln(greatest(median_home_value, 50000)) END AS log_value, ln(exposure) AS log_density"""
SIZE3 = 'count(*) OVER (PARTITION BY city, "GEOID") >= 3'
Z_TPI = "(tpi_500 - avg(tpi_500) OVER (PARTITION BY city)) / stddev_samp(tpi_500) OVER (PARTITION BY city) AS tpi_500_z"
CELL_EXPO = "coalesce(housing_units_cell, 0) + coalesce(pop_cell, 0) AS exposure"
BLDG_EXPO = "coalesce(housing_units_bldg, 0) + coalesce(pop_bldg, 0) AS exposure"
COVERED = 'sum(n_total) OVER (PARTITION BY city, "GEOID") > 0'
RATE = "n_total / greatest(exposure, 1.0) < 50"
OUT3 = f"SELECT cell, {q6('exposure')} AS exposure, {q6('log_income')} AS log_income"
SES_OK = "log_income IS NOT NULL AND log_value IS NOT NULL AND owner_share IS NOT NULL AND vacancy_rate IS NOT NULL"
PREP_SQL = {
    "pilot": f"""a AS (SELECT *, {CELL_EXPO} FROM panel), b AS (SELECT {LOGS} FROM a WHERE exposure > 5), c AS (SELECT *, {Z_TPI} FROM b),
      d AS (SELECT * FROM c WHERE {SES_OK} AND tpi_500_z IS NOT NULL), prep AS (SELECT * FROM d QUALIFY {SIZE3})""",
    "national": f"""a AS (SELECT *, {CELL_EXPO} FROM panel), b AS (SELECT {LOGS} FROM a WHERE exposure > 5), c AS (SELECT *, {Z_TPI} FROM b),
      c2 AS (SELECT * FROM c QUALIFY {COVERED}), d AS (SELECT * FROM c2 WHERE {RATE} AND {SES_OK} AND tpi_500_z IS NOT NULL),
      prep AS (SELECT * FROM d QUALIFY {SIZE3})""",
    "spatial": f"""a AS (SELECT *, {BLDG_EXPO} FROM panel), b AS (SELECT {LOGS} FROM a WHERE exposure > 5), c AS (SELECT *, {Z_TPI} FROM b),
      c2 AS (SELECT * FROM c QUALIFY {COVERED}), d AS (SELECT * FROM c2 WHERE {RATE} AND {SES_OK} AND slope_deg IS NOT NULL),
      prep AS (SELECT * FROM d QUALIFY {SIZE3})""",
    "cells": f"""a AS (SELECT *, {BLDG_EXPO} FROM panel), b AS (SELECT {LOGS} FROM a WHERE exposure > 5), c AS (SELECT * FROM b WHERE {RATE}),
      c2 AS (SELECT * FROM c QUALIFY {SIZE3}),
      c3 AS (SELECT *, {Z_TPI}, slope_deg AS slope_deg_raw, "n_MASS_1" + "n_MASS_2" + "n_MASS_3" + "n_MASS_4" + "n_MASS_5" AS n_theft,
        "n_MASS_1" + "n_MASS_2" + "n_MASS_4" + "n_MASS_5" + "n_MVT" + "n_NO_LOOT" AS n_clean FROM c2),
      prep AS (SELECT * FROM c3 WHERE {SES_OK})""",
    "dated": f"""a AS (SELECT *, {BLDG_EXPO} FROM panel), b AS (SELECT {LOGS} FROM a WHERE exposure > 5), c AS (SELECT * FROM b WHERE {RATE}),
      c2 AS (SELECT * FROM c QUALIFY {SIZE3}), prep AS (SELECT * FROM c2 WHERE {SES_OK})""",
    "segments": f"""a AS (SELECT *, {CELL_EXPO}, "n_MASS_1" + "n_MASS_2" + "n_MASS_3" + "n_MASS_4" + "n_MASS_5" + "n_MVT" + "n_NO_LOOT" AS n_prop
        FROM panel WHERE seg_len_m >= 20), b AS (SELECT {LOGS} FROM a WHERE exposure > 2),
      c AS (SELECT * FROM b WHERE n_prop / greatest(exposure, 1.0) < 50), c2 AS (SELECT * FROM c QUALIFY {SIZE3}),
      prep AS (SELECT * FROM c2 WHERE {SES_OK})""",
    "targets": f"""a AS (SELECT *, {CELL_EXPO} FROM panel), b AS (SELECT {LOGS} FROM a WHERE exposure > 5),
      c2 AS (SELECT * FROM b QUALIFY {COVERED}), d AS (SELECT * FROM c2 WHERE {RATE} AND {SES_OK}),
      prep AS (SELECT * FROM d QUALIFY {SIZE3})""",
}


def _prep_query(variant):
    z = variant in ("pilot", "national", "cells")
    sql = f"WITH {PANEL_SQL}, {PREP_SQL[variant]} {OUT3}" + (f", {q6('tpi_500_z')} AS tpi_500_z" if z else "") + " FROM prep"

    @query(f"prep_sample_{variant}", sql)
    def _(t):
        d = sample.prep_sample(I.panel(t), variant)
        if variant == "targets":
            d = d.withColumn("exposure", F.col("expo_housing"))
        return d.select("cell", r6("exposure").alias("exposure"), r6("log_income").alias("log_income"),
                        *([r6("tpi_500_z").alias("tpi_500_z")] if z else []))


for _v in PREP_SQL:
    _prep_query(_v)


@query("qualifies", f"""WITH {PANEL_SQL}, g AS (SELECT city, stddev_samp(tpi_500) AS sd, sum(n_total)::BIGINT AS events, count(*) AS n_units FROM panel GROUP BY 1)
  SELECT city, {q6('sd')} AS tpi_sd, events, n_units, concat_ws(';', CASE WHEN sd < 4 THEN 'tpi_sd' END, CASE WHEN events < 20000 THEN 'events' END,
    CASE WHEN events::DOUBLE / n_units < 1 THEN 'events_per_unit' END) AS reasons, sd >= 4 AND events >= 20000 AND events::DOUBLE / n_units >= 1 AS included FROM g""")
def _(t):
    return sample.qualifies(I.panel(t)).withColumn("tpi_sd", r6("tpi_sd"))


@query("size_gate", f"WITH {PANEL_SQL} SELECT cell FROM panel QUALIFY count(*) OVER (PARTITION BY city) >= 300 AND sum(n_total) OVER (PARTITION BY city) >= 10000")
def _(t):
    return sample.size_gate(I.panel(t), "city", 300, 10000).select("cell")


# ---- feed screens ---------------------------------------------------------------------
COLNAMES = ["longitude", "long_desc", "lat_y", "occurred_date", "report_id", "crm_cd_desc", "weapon_desc", "category", "offense_type", "y", "status"]
FEEDS_SQL = f"""nm AS (SELECT s_suppkey AS feed, i AS pos, ({I.sql_list(COLNAMES)})[((s_suppkey * 3 + i * 7) % {len(COLNAMES)} + 1)::INT] AS column_name
   FROM supplier, range(0, 6) r(i))"""


def feed_columns(t):
    pick = F.element_at(F.array(*[F.lit(c) for c in COLNAMES]), ((F.col("s_suppkey") * 3 + F.col("pos") * 7) % len(COLNAMES) + 1).cast("int"))
    d = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    return d.select(F.col("s_suppkey").alias("feed"), "pos", pick.alias("column_name"))


_m = lambda c, p: f"regexp_matches({c}, '{p}', 'i')"
SCORE_SQL = (f"(CASE WHEN {_m('column_name', fields.DESC_GOOD)} THEN 2 ELSE 0 END + CASE WHEN {_m('column_name', 'desc')} THEN 1 ELSE 0 END"
             f" - CASE WHEN {_m('column_name', 'categor')} THEN 1 ELSE 0 END - CASE WHEN {_m('column_name', fields.DESC_BAD)} THEN 3 ELSE 0 END)")


@query("rank_desc", f"""WITH {FEEDS_SQL}, s AS (SELECT feed, pos, column_name, {SCORE_SQL} AS score FROM nm WHERE {_m('column_name', fields.DESC_NAME)})
  SELECT feed, column_name, score::INT AS score, row_number() OVER (PARTITION BY feed ORDER BY score DESC, pos)::INT AS place FROM s""")
def _(t):
    return fields.rank_desc(feed_columns(t)).select("feed", "column_name", F.col("score").cast("int").alias("score"), F.col("place").cast("int").alias("place"))


@query("pick_coord", f"""WITH {FEEDS_SQL} SELECT feed, arg_min(column_name, pos) AS lat_col FROM nm
  WHERE {_m('column_name', fields.LAT_NAME)} AND NOT {_m('column_name', fields.NOT_COORD_NAME)} GROUP BY feed""")
def _(t):
    return fields.pick_coord(feed_columns(t), fields.LAT_NAME, "lat_col")


def _pick_sql(dialect):
    rule = fields.DIALECTS[dialect]
    coord = lambda axis: (f"SELECT feed, arg_min(column_name, pos) AS {axis}_col FROM nm WHERE {_m('column_name', rule[axis])}"
                          + (f" AND NOT {_m('column_name', rule['not_coord'])}" if rule["not_coord"] else "") + " GROUP BY 1")
    return f"""WITH {FEEDS_SQL}, c AS (SELECT DISTINCT feed FROM nm), la AS ({coord('lat')}), lo AS ({coord('lon')}),
  da AS (SELECT feed, arg_min(column_name, pos) AS date_col FROM nm WHERE {_m('column_name', rule['date'])} AND NOT {_m('column_name', fields.NOT_DATE_NAME)} GROUP BY 1),
  de AS (SELECT feed, column_name AS desc_col FROM nm WHERE {_m('column_name', rule['desc'])} QUALIFY row_number() OVER (PARTITION BY feed ORDER BY {SCORE_SQL} DESC, pos) = 1)
  SELECT feed, lat_col, lon_col, date_col, desc_col FROM c LEFT JOIN la USING (feed) LEFT JOIN lo USING (feed) LEFT JOIN da USING (feed) LEFT JOIN de USING (feed)"""


@query("pick_field", _pick_sql("registry"))
def _(t):
    return fields.pick_field(feed_columns(t))


@query("pick_field_catalog", _pick_sql("catalog"))
def _(t):
    return fields.pick_field(feed_columns(t), dialect="catalog")


@query("pick_field_layer", _pick_sql("layer"))
def _(t):
    return fields.pick_field(feed_columns(t), dialect="layer")


LONG_SQL = f"""{INC_SQL}, vals AS (SELECT feed, 'desc1' AS column_name, desc1 AS value FROM inc UNION ALL SELECT feed, 'event_type', event_type FROM inc
   UNION ALL SELECT feed, 'subcat', subcat FROM inc UNION ALL SELECT feed, 'value', value::VARCHAR || ' theft' FROM inc)"""
NORM = "regexp_replace(coalesce(value, ''), '[-_/|]+', ' ', 'g')"
FIELD_SCORE_SQL = f"""{LONG_SQL}, s AS (SELECT feed, column_name, count(*) AS nv, count(DISTINCT value) AS nu,
    sum(CASE WHEN {cascade_sql(NORM, text.RULES_V1)} <> 'OTHER' THEN 1 ELSE 0 END)::DOUBLE AS nh
    FROM vals WHERE value IS NOT NULL AND value <> '' AND lower(value) NOT IN ('none', 'nan', 'null') GROUP BY 1, 2),
  s2 AS (SELECT feed, column_name, nh / nv * CASE WHEN nu::DOUBLE / nv > 0.6 THEN 0.3 ELSE 1 END AS score FROM s WHERE nv >= 20),
  s3 AS (SELECT feed, column_name, score, row_number() OVER (PARTITION BY feed ORDER BY score DESC, column_name DESC) AS place FROM s2 WHERE score > 0.15)"""


def feed_values(t):
    d = I.incidents(t).withColumn("value", F.concat(F.col("value").cast("string"), F.lit(" theft")))
    return fields.long_values(d, "feed", ["desc1", "event_type", "subcat", "value"])


@query("score_desc_fields", f"WITH {FIELD_SCORE_SQL} SELECT feed, column_name, {q6('score')} AS score, place::INT AS place FROM s3 WHERE place <= 3")
def _(t):
    return fields.score_desc_fields(feed_values(t)).select("feed", "column_name", r6("score").alias("score"), F.col("place").cast("int").alias("place"))


@query("top_k_fields", f"WITH {FIELD_SCORE_SQL} SELECT feed, string_agg(column_name, ';' ORDER BY place) AS picked FROM s3 WHERE place <= 3 GROUP BY feed")
def _(t):
    s = fields.score_desc_fields(feed_values(t))
    return s.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("place", "column_name"))).alias("a")).select(
        "feed", F.array_join(F.transform("a", lambda x: x["column_name"]), ";").alias("picked"))


@query("pick_date_field", f"""WITH d AS (SELECT user_id % 7 AS feed, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS occurred, ts AS report_time,
      CASE WHEN event_id % 3 = 0 THEN ts END AS began, ts + INTERVAL 60 YEARS AS start_expiry FROM events),
  l AS (SELECT feed, 'occurred' AS column_name, occurred AS v FROM d UNION ALL SELECT feed, 'report_time', report_time FROM d UNION ALL SELECT feed, 'began', began FROM d
    UNION ALL SELECT feed, 'start_expiry', start_expiry FROM d),
  s AS (SELECT feed, column_name, count(*) AS n, count(v) AS f, count(DISTINCT v::DATE) AS days FROM l GROUP BY 1, 2 HAVING max(v) BETWEEN TIMESTAMP '1990-01-01' AND now()::TIMESTAMP + INTERVAL 400 DAYS),
  s2 AS (SELECT feed, column_name, f AS rows, f * CASE WHEN column_name IN ('occurred', 'began') THEN 1.15::DOUBLE ELSE 1 END * (f::DOUBLE / n) AS score FROM s
    WHERE f >= 20 AND days >= 2 AND f::DOUBLE / n >= 0.5)
  SELECT feed::BIGINT AS feed, column_name, rows, {q6('score')} AS score FROM s2 QUALIFY row_number() OVER (PARTITION BY feed ORDER BY score DESC, column_name DESC) = 1""")
def _(t):
    k, ts = F.col("event_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    d = t.events.select((F.col("user_id") % 7).alias("feed"), F.when(k % 4 != 0, ts).alias("occurred"),
                        ts.alias("report_time"), F.when(k % 3 == 0, ts).alias("began"),
                        F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL 60 YEARS"), "yyyy-MM-dd HH:mm:ss").alias("start_expiry"))
    best = fields.pick_date_field(fields.long_values(d, "feed", ["occurred", "report_time", "began", "start_expiry"]), clean.parse_mixed(F.col("value")))
    return best.withColumn("score", r6("score"))


FEEDNAME = ["Police Incident Reports", "Crime Data 2019", "Fire Incidents", "Parking Citations", "Offense Log", "Building Permits", "Part 1 crimes by year"]
GATE_SQL = f"""f AS (SELECT s_suppkey AS id, 'data.city' || (s_suppkey % 23) || CASE WHEN s_suppkey % 19 = 0 THEN '.test.gov' ELSE '.gov' END AS domain,
    ({I.sql_list(FEEDNAME)})[(s_suppkey % 7 + 1)::INT] AS name, round(s_acctbal)::BIGINT AS rows, (s_suppkey % 10)::DOUBLE / 8 AS geo_share,
    30.0::DOUBLE AS mnla, 30.0::DOUBLE + (s_suppkey % 40) / 20.0 AS mxla, -100.0::DOUBLE AS mnlo, -99.5::DOUBLE + (s_suppkey % 3) / 10.0 AS mxlo FROM supplier)"""


def feeds(t):
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("id"), F.concat(F.lit("data.city"), k % 23, F.when(k % 19 == 0, ".test.gov").otherwise(".gov")).alias("domain"),
        F.element_at(F.array(*[F.lit(v) for v in FEEDNAME]), (k % 7 + 1).cast("int")).alias("name"), F.round("s_acctbal").cast("bigint").alias("rows"),
        ((k % 10) / 8.0).alias("geo_share"), F.lit(30.0).alias("mnla"), (30.0 + (k % 40) / 20.0).alias("mxla"),
        F.lit(-100.0).alias("mnlo"), (-99.5 + (k % 3) / 10.0).alias("mxlo"))


GATE_OK = f"{_m('name', fields.FEED_GOOD)} AND NOT {_m('name', fields.FEED_BAD)}"


@query("name_gate", f"WITH {GATE_SQL} SELECT id FROM f WHERE {GATE_OK}")
def _(t):
    return feeds(t).where(fields.name_gate(F.col("name"))).select("id")


@query("feed_quality_gate", f"""WITH {GATE_SQL} SELECT domain, id, rows FROM f WHERE geo_share > 0.5 AND mxla - mnla BETWEEN 0.01 AND 1.5 AND mxlo - mnlo BETWEEN 0.01 AND 1.5
   AND mnla BETWEEN 18 AND 72 AND mxlo BETWEEN -180 AND -65 AND {GATE_OK} AND NOT {_m('domain', fields.TEST_DOMAIN)}
   QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rows DESC, id) = 1""")
def _(t):
    return fields.feed_quality_gate(feeds(t)).select("domain", "id", "rows")


@query("best_per_key", """SELECT c_nationkey::INT AS nation, arg_max(c_custkey, c_acctbal * 1e6 - c_custkey)::BIGINT AS best FROM customer GROUP BY 1""")
def _(t):
    return t.customer.groupBy(F.col("c_nationkey").cast("int").alias("nation")).agg(
        F.max_by("c_custkey", F.col("c_acctbal") * 1e6 - F.col("c_custkey")).alias("best"))


@query("class_share_profile", f"""WITH {KLASS_SQL}, g AS (SELECT feed, count(*) AS n, count(*) FILTER (klass NOT IN ('OTHER', 'ROBBERY')) AS p, count(*) FILTER (klass = 'NO_LOOT') AS z FROM kl GROUP BY 1)
  SELECT feed, n, {q6('p::DOUBLE / n')} AS prop_share, {q6('z::DOUBLE / greatest(p, 1)')} AS no_loot_share, round(z::DOUBLE / greatest(p, 1), 3) >= 0.03 AS no_loot FROM g""")
def _(t):
    d = fields.class_share_profile(I.incidents(t).withColumn("klass", text.classify_text(F.col("desc1"))), "feed")
    return d.withColumns({"prop_share": r6("prop_share"), "no_loot_share": r6("no_loot_share")})


@query("merge_shards", """WITH RECURSIVE l AS (SELECT 'c' || (s_nationkey % 12) AS city, 'u' || lpad(s_suppkey::VARCHAR, 8, '0') AS url, (s_suppkey % 2)::VARCHAR AS host,
     s_suppkey % 3 = 0 AS no_loot, 2000 + (s_suppkey * 7) % 24 AS d0, 2000 + (s_suppkey * 7) % 24 + s_suppkey % 3 AS d1, round(s_acctbal)::BIGINT AS rows FROM supplier),
   o AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY no_loot DESC, d1 DESC, rows DESC, url DESC) AS rn FROM l),
   k AS (SELECT city, rn, [{'u': url, 'h': host, 'a': d0, 'b': d1, 'r': rows}] AS kept FROM o WHERE rn = 1
     UNION ALL SELECT o.city, o.rn, CASE WHEN o.host <> kept[1].h OR len(list_filter(kept, lambda x: NOT (o.d1 < x.a OR x.b < o.d0))) > 0 THEN kept
       ELSE list_append(kept, {'u': o.url, 'h': o.host, 'a': o.d0, 'b': o.d1, 'r': o.rows}) END FROM k JOIN o ON o.city = k.city AND o.rn = k.rn + 1),
   f AS (SELECT city, kept[1:6] AS kept FROM k QUALIFY rn = max(rn) OVER (PARTITION BY city))
   SELECT city, array_to_string(list_transform(kept, lambda x: x.u), '|') AS url, list_sum(list_transform(kept, lambda x: x.r))::BIGINT AS rows,
     list_min(list_transform(kept, lambda x: x.a))::BIGINT AS date_min, list_max(list_transform(kept, lambda x: x.b))::BIGINT AS date_max, len(kept)::BIGINT AS n_layers FROM f""")
def _(t):
    k = F.col("s_suppkey")
    d0 = 2000 + (k * 7) % 24
    layers = t.supplier.select(F.concat(F.lit("c"), F.col("s_nationkey") % 12).alias("city"), F.concat(F.lit("u"), F.lpad(k.cast("string"), 8, "0")).alias("url"),
                               (k % 2).cast("string").alias("host"), (k % 3 == 0).alias("no_loot"), d0.alias("date_min"), (d0 + k % 3).alias("date_max"),
                               F.round("s_acctbal").cast("bigint").alias("rows"))
    return fields.merge_shards(layers)


@query("category_filter", f"WITH {INC_SQL} SELECT event_id FROM inc WHERE subcat IN ('Vandalism', 'Fraud') AND ts >= TIMESTAMP '2024-01-10'")
def _(t):
    return I.incidents(t).where(clean.category_filter(F.col("subcat"), F.col("ts"), ["Vandalism", "Fraud"], "2024-01-10")).select("event_id")


@query("center_gate", f"""WITH {VALID_SQL}, c AS (SELECT feed, med_lat, med_lon, 37.75 + (feed[6:6]::INT % 3) * 0.4 AS c_lat, -122.4::DOUBLE AS c_lon FROM med)
  SELECT feed, {q6('sqrt(power(med_lat - c_lat, 2) + power((med_lon - c_lon) * cos(radians(c_lat)), 2))', 5)} AS deg_off,
   sqrt(power(med_lat - c_lat, 2) + power((med_lon - c_lon) * cos(radians(c_lat)), 2)) <= 0.45 AS ok FROM c""")
def _(t):
    med = clean.feed_medians(valid(t), "feed")
    centres = I.incidents(t).select("feed").distinct().withColumns({
        "c_lat": 37.75 + (F.substring("feed", 6, 1).cast("int") % 3) * 0.4, "c_lon": F.lit(-122.4)})
    return clean.center_gate(med, centres, "feed").select("feed", r6("deg_off", 5).alias("deg_off"), "ok")


@query("sentinel_code_drop", "SELECT event_id FROM events WHERE event_id % 9 <> 0 AND event_id % 10 <> 0")
def _(t):
    v = F.when(F.col("event_id") % 9 == 0, 5555.0).when(F.col("event_id") % 10 != 0, F.col("value"))
    return clean.sentinel_code_drop(t.events.withColumn("v", v), "v").select("event_id")


@query("active_filter", """SELECT event_id, event_type IN ('view') AS garage FROM events WHERE event_type IN ('view', 'click') AND user_id % 2 = 0""")
def _(t):
    d = t.events.withColumns({"flag": F.when(F.col("event_type") == "view", "M").when(F.col("event_type") == "click", "T").otherwise("U"),
                              "place": F.when(F.col("user_id") % 2 == 0, "ON").otherwise("OFF"),
                              "g": F.when(F.col("event_type") == "view", "True").otherwise("no")})
    return d.where(clean.active_meter(F.col("flag"), F.col("place"))).select("event_id", (clean.flag_of_text(F.col("g")) > 0).alias("garage"))


@query("window_select", f"WITH {I.PTS_SQL} SELECT id FROM pts WHERE x >= -100 AND x < 100 AND y >= -50 AND y < 150")
def _(t):
    return I.points(t).where("x >= -100 and x < 100 and y >= -50 and y < 150").select("id")


@query("json_access", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    """Payload access without parsing the whole document into columns first."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
