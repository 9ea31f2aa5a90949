"""The stateless part of incident cleaning under Structured Streaming.

Clean, class and bin are per-row once the feeds' median anchors are known, so
the batch operators run unchanged on a stream; anchors come in as a static
table and are refreshed by the batch side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import geo, text
from panelwright.operators import clean, tables


def classed_cells(stream: DataFrame, anchors: DataFrame, desc: list[str], grid: dict, feed: str = "feed") -> DataFrame:
    """Incidents with class and grid cell.  ``grid``: left, top, step, ncol, nrow."""
    d = stream.where(clean.valid_latlon(F.col("lat"), F.col("lon")))
    d = clean.median_anchor_filter(d, feed, anchors=anchors)
    d = d.withColumn("klass", text.classify_text(text.concat_desc(*[F.col(c) for c in desc])))
    d = geo.project_utm(d)
    return tables.grid_bin(d, F.col("ux"), F.col("uy"), grid["left"], grid["top"], grid["step"], grid["ncol"], grid["nrow"])
