"""Readers for landed files: parquet panels, registries, census pipes, REST pages, footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import geometry as G

BLOCK_GROUP_PREFIX = "1500000US"


def scan_parquet(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def scan_parquet_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """One table per city by glob; the city comes from the file or folder name."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)\.parquet(?:/[^/]*)?$", 1)
    return df.withColumn("city", name)


def prefer_segments(tables: DataFrame) -> DataFrame:
    """Of (city, unit, ...) manifest rows keep segments where a city has them, else cells."""
    first = F.when(F.col("unit") == "segment", 0).otherwise(1)
    w = Window.partitionBy("city").orderBy(first)
    return tables.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def scan_psv_acs(spark: SparkSession, path: str, rename: dict[str, str]) -> DataFrame:
    """Pipe-separated census summary: block groups only, prefix stripped, text to numbers."""
    raw = spark.read.option("sep", "|").option("header", "true").csv(path)
    keep = raw.where(F.col("GEO_ID").startswith(BLOCK_GROUP_PREFIX))
    geoid = F.substring("GEO_ID", len(BLOCK_GROUP_PREFIX) + 1, 40)
    return keep.select(geoid.alias("GEOID"),
                       *[F.col(c).try_cast("double").alias(n) for c, n in rename.items()])


RECORDS = ["$.features", "$.result.records", "$.records", "$.rows", "$"]


def scan_json_pages(spark: SparkSession, path: str, attributes: str, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """REST pages, one JSON object a line, to rows (source, attributes, lat, lon).

    The page itself is the object or its ``page``; its records are the first array among ``features``
    (with ``attributes`` and ``geometry``), ``result.records``, ``records``, ``rows`` and the page as
    an array.  Coordinates come from the geometry, else from the fields ``lat`` and ``lon``.  Values
    of another type are converted, null where that cannot be done; lines that are no JSON are left out.
    Paging may repeat a record, so rows are unique on (source, record_id).
    """
    named = [[x.strip() for x in f.split(":", 1)] for f in attributes.split(",")]
    whole = F.try_parse_json("value")
    d = spark.read.text(path).select(whole.alias("v")).where("v IS NOT NULL")
    d = d.select(F.try_variant_get("v", "$.source", "string").alias("source"), F.coalesce(F.try_variant_get("v", "$.page", "variant"), "v").alias("page"))
    lists = [F.try_variant_get("page", p, "array<variant>") for p in RECORDS]
    d = d.select("source", F.explode(F.coalesce(*lists)).alias("r"))
    d = d.select("source", "r", F.coalesce(F.try_variant_get("r", "$.attributes", "variant"), "r").alias("a"))

    def place(axis, field):
        own = F.try_variant_get("r", f"$.geometry.{axis}", "double")
        return F.coalesce(own, F.try_variant_get("a", f"$['{field}']", "double")) if field else own
    rows = d.select("source", *[F.try_variant_get("a", f"$['{n}']", kind).alias(n) for n, kind in named], place("y", lat).alias("lat"), place("x", lon).alias("lon"))
    return rows.dropDuplicates(["source", "record_id"])


def scan_geojsonseq(spark: SparkSession, path: str, box: tuple | None = None) -> DataFrame:
    """Newline GeoJSON polygons and multipolygons (gzip as it lands) to parts with boxes, filtered by overlap.

    ``parts`` lists each polygon's outer ``ring`` and its ``holes``, all without the closing
    point; the box is that of all outer rings.  Features of other types are no areas and are left out.
    """
    schema = "properties struct<id: bigint>, geometry struct<type: string, coordinates: string>"
    f = spark.read.schema(schema).json(path).where("geometry.type IN ('Polygon', 'MultiPolygon')")
    rings = "array<array<array<double>>>"
    text = F.col("geometry.coordinates")
    polygons = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(text, rings))).otherwise(F.from_json(text, f"array<{rings}>"))

    def opened(ring):
        closed = F.transform(ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
        return F.slice(closed, F.lit(1), F.greatest(F.size(closed) - 1, F.lit(0)))

    def part(p):
        holes = F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
        return F.struct(opened(p[0]).alias("ring"), F.transform(holes, opened).alias("holes"))
    d = f.select(F.col("properties.id").alias("id"), F.transform(polygons, part).alias("parts"))
    x0, y0, x1, y1 = G.bbox(F.flatten(F.transform("parts", lambda p: p["ring"])))
    d = d.withColumns({"minx": x0, "miny": y0, "maxx": x1, "maxy": y1})
    if box:
        w, s, e, n = box
        d = d.where((F.col("maxx") >= w) & (F.col("minx") <= e) & (F.col("maxy") >= s) & (F.col("miny") <= n))
    return d


def scan_pixels(df: DataFrame, low: float = -5.0, high: float = 5000.0) -> DataFrame:
    """A pixel table with water, nodata and non-finite heights as NULL."""
    ok = ~F.isnan("z") & (F.col("z") > low) & (F.col("z") < high)
    return df.withColumn("z", F.when(ok, F.col("z")))


JSON_ROW = T.StringType()
