"""Lines of one small file are dealt out before they are cut into edges and repeated into buckets."""

from panelwright.operators import spatial


def test_edges_are_cut_after_a_shuffle(spark):
    one = spark.sql("SELECT id AS seg_id, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', double(id)), named_struct('x', 2D, 'y', 0D)) AS line FROM range(0, 20, 1, 1)")
    edges = spatial.line_edges(one)
    assert "REPARTITION_BY_COL" in edges._jdf.queryExecution().executedPlan().toString()
    assert edges.count() == 40
