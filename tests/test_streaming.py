"""A stream of landed files gives the rows the batch run gives."""

import tempfile

from panelwright.operators import clean
from panelwright.plans import inputs
from panelwright.plans.queries_clean import valid
from panelwright.plans.registry import Tables
from panelwright.streaming.ingest import classed_cells

GRID = {"left": 547000.0, "top": 4184000.0, "step": 100.0, "ncol": 90, "nrow": 110}


def test_stream_equals_batch(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    inputs.incidents(t).repartition(3).write.parquet(f"{base}/landed")
    anchors = clean.feed_medians(valid(t), "feed").cache()
    batch = classed_cells(spark.read.parquet(f"{base}/landed"), anchors, ["desc1"], GRID).select("event_id", "klass", "cell")
    live = spark.readStream.schema(spark.read.parquet(f"{base}/landed").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
    q = (classed_cells(live, anchors, ["desc1"], GRID).select("event_id", "klass", "cell").writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).isEmpty()
