"""Keyed permutations: bijective, the same from NumPy and from Columns, and what rests on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.permute import permuted, permuted_column
from panelwright.operators import dependence
from panelwright.operators.ranks import ordered_index


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000])
def test_permutations_are_bijective_and_differ(n):
    for key in (0, 1, 998):
        assert sorted(permuted(np.arange(n), key, n, 3)) == list(range(n))
    if n > 60:
        seen = np.stack([permuted(np.arange(n), k, n, 3) for k in range(200)])
        assert len({tuple(r) for r in seen}) == 200
        # every place is hit about evenly: mean image of each unit within five standard errors
        assert np.abs(seen.mean(0) - (n - 1) / 2).max() < 5.5 * n / np.sqrt(12 * 200)
        assert abs(np.mean([np.corrcoef(np.arange(n), r)[0, 1] for r in seen])) < 5 / np.sqrt(200 * n)


def test_columns_give_the_same(spark):
    d = spark.range(300).select("id", F.explode(F.array(F.lit(0), F.lit(5), F.lit(998))).alias("rep"))
    for r in d.select("id", "rep", permuted_column(F.col("id"), F.col("rep"), 300, 7).alias("p")).groupBy("rep").agg(
            F.sort_array(F.collect_list(F.struct("id", "p"))).alias("x")).collect():
        assert [v.p for v in r.x] == permuted(np.arange(300), r.rep, 300, 7).tolist()


def test_sent_and_joined_values_agree(spark, monkeypatch):
    r = np.random.default_rng(2)
    pts = spark.createDataFrame([(i * 3, float(a), float(b)) for i, (a, b) in enumerate(r.uniform(0, 9, (50, 2)))], "id bigint, x double, y double")
    w = dependence.knn_weights(pts, 4).cache()
    idx = ordered_index(pts.select("id", F.col("x").alias("z")), [], "id", "pos").cache()
    assert [x.pos for x in idx.orderBy("id").collect()] == list(range(50))
    sent = {x.rep: x.num for x in dependence._permuted(w, idx, 50, 30, 1).collect()}
    monkeypatch.setattr(dependence, "BROADCAST_UNITS", 10)
    joined = {x.rep: x.num for x in dependence._permuted(w, idx, 50, 30, 1).collect()}
    assert set(sent) == set(joined) == set(range(30)) and all(abs(sent[k] - joined[k]) < 1e-9 for k in sent)


def test_ordered_index_over_far_numbers(spark):
    ids = [0, 5, 10 ** 15, -10 ** 15, 10 ** 15 + 1, 7]
    d = ordered_index(spark.createDataFrame([(k, i) for k in "ab" for i in ids], "k string, i bigint"), ["k"], "i", "pos")
    for k in "ab":
        assert [r.i for r in d.where(F.col("k") == k).orderBy("pos").collect()] == sorted(ids)
