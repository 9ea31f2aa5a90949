"""Replicate vectors against rows copied by replicate, and against the plain fit."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import replicates, resample
from panelwright.operators.ppml import Spec, build_design, centre_within, newton_slopes, ppml_fe


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(600):
        g = 0 if i % 3 == 0 else int(r.integers(1, 30))         # a third of all rows in one group
        x, z = float(r.normal()), float(r.normal())
        rows.append(("a" if i % 2 else "b", g, x, z, float(r.poisson(np.exp(0.3 * x - 0.1 * z + 0.05 * g))), float(r.uniform(0.5, 2))))
    return spark.createDataFrame(rows, "city string, GEOID int, x double, z double, n double, exposure double").cache()


def both(spark, panel, specs, reps, monkeypatch, **how):
    d = centre_within(build_design(panel.withColumn("_unit", F.col("GEOID").cast("string")), specs, ["city"], "GEOID", carry=["_unit"]), ["city", "model_id"]).cache()
    units = panel.select("city", F.col("GEOID").cast("string").alias("unit")).distinct()
    draws = resample.draw_multiplicity(units, ["city"], reps, 3).cache()
    km = ["city", "model_id"]
    for k, v in how.items():
        monkeypatch.setattr(replicates, k, v)
    new = replicates.replicate_slopes(replicates.with_weights(d, draws, ["city"], "_unit", reps), km, reps, {})
    old = newton_slopes(resample.weighted_replicates(d, draws, ["city"], "_unit").drop("_unit"), [*km, "rep"], 60)
    key = lambda r: (r.city, r.model_id, r.rep)
    return {key(r): r for r in new.collect()}, {key(r): r for r in old.collect()}


@pytest.mark.parametrize("how", [{}, {"SALT_ROWS": 20, "BLOCK_VALUES": 200}])
def test_vectors_equal_copied_rows(spark, panel, monkeypatch, how):
    specs = [Spec("one", "n", ["x"]), Spec("two", "n", ["x", "z"], where=F.col("z") > -1)]
    new, old = both(spark, panel, specs, 25, monkeypatch, **how)
    assert set(old) <= set(new) and len(new) == 2 * 2 * 25
    for k, r in old.items():
        assert new[k].converged and r.converged and np.allclose(new[k].b, r.b, atol=1e-7)


def test_weights_of_one_give_the_plain_fit(spark, panel):
    spec = Spec("one", "n", ["x", "z"])
    d = centre_within(build_design(panel, [spec], ["city"]), ["city", "model_id"]).withColumn("m", F.array(F.lit(1).cast("smallint"), F.lit(2).cast("smallint")))
    fit = {r.city: r for r in ppml_fe(panel, [spec], ["city"]).collect()}
    got = replicates.replicate_slopes(d, ["city", "model_id"], 2, {("a", "one"): [0.3, -0.1]}).collect()
    assert len(got) == 4 and all(r.converged and np.allclose(r.b, fit[r.city].b, atol=1e-8) for r in got)


def test_too_many_slopes_go_the_other_way(spark, panel, monkeypatch):
    spec = Spec("one", "n", ["x"])
    small = resample.bootstrap_slopes(panel, [spec], ["city"], F.col("GEOID"), 8, 5)
    monkeypatch.setattr(replicates, "MOST_BYTES", 8)
    rows = resample.bootstrap_slopes(panel, [spec], ["city"], F.col("GEOID"), 8, 5)
    a, b = ({(r.city, r.rep): r.beta for r in d.collect()} for d in (small, rows))
    assert set(a) == set(b) and np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(a)], atol=1e-7)


def test_binomial_quantiles_have_the_law():
    import math
    r = np.random.default_rng(1)
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.02), (512, 0.97), (512, 0.5)):
        cdf = np.cumsum([math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)])
        u = r.uniform(size=400)
        got = resample.binomial_quantile(np.full(400, n), np.full(400, p), u)
        if p <= 0.5:
            assert (got == np.searchsorted(cdf, u)).all()
        else:
            assert abs(got.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / 400)
    assert (resample.binomial_quantile(np.array([5, 5, 0]), np.array([0.0, 1.0, 0.5]), np.array([0.9, 0.1, 0.5])) == [0, 5, 0]).all()


def test_relabelling_has_the_law_and_keeps_all(spark):
    counts = spark.createDataFrame([(c, p, n) for c in range(40) for p, n in (("A", 1500), ("B", 3), ("C", 9))], "cell int, pred string, n bigint")
    conf = spark.createDataFrame([("A", "A", .6), ("A", "B", .3), ("A", "C", .1), ("B", "B", .5), ("B", "D", .5)], "pred string, truth string, p double")
    got = resample.relabel_draws(counts, conf, ["cell"], 50, 7).toPandas()
    assert (got.groupby(["cell", "rep"]).n.sum() == 1512).all()
    again = resample.relabel_draws(counts.repartition(9), conf, ["cell"], 50, 7).toPandas()
    order = ["cell", "rep", "truth"]
    assert got.sort_values(order).n.tolist() == again.sort_values(order).n.tolist()
    wide = got.pivot_table(index=["cell", "rep"], columns="truth", values="n", fill_value=0)
    mean = {"A": 900, "B": 451.5, "C": 159, "D": 1.5}
    var = {"A": 1500 * .24, "B": 1500 * .21 + .75, "C": 1500 * .09, "D": .75}
    for c in mean:
        assert abs(wide[c].mean() - mean[c]) < 5 * np.sqrt(var[c] / len(wide)) and wide[c].var() == pytest.approx(var[c], rel=0.15)
    assert np.corrcoef(wide["A"], wide["B"])[0, 1] == pytest.approx(-np.sqrt(.6 * .3 / (.4 * .7)), abs=0.08)


def test_only_blocks_of_dealt_groups_move(spark, panel, monkeypatch):
    """Rounds send scores and Hessians of each partition and model, not a block of every group."""
    def moved(salt):
        monkeypatch.setattr(replicates, "SALT_ROWS", salt)
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        seen = {stages().apply(i).stageId() for i in range(stages().size())}
        got = {(r.city, r.rep): r.b for r in replicates.replicate_slopes(d, ["city", "model_id"], 40, {}).collect()}
        now = stages()
        new = [now.apply(i) for i in range(now.size()) if now.apply(i).stageId() not in seen]
        return sum(s.shuffleWriteBytes() for s in new), got
    spec = Spec("one", "n", ["x", "z"])
    many = panel.withColumn("GEOID", F.row_number().over(Window.partitionBy("city").orderBy("x", "z")) % 100)
    d = centre_within(build_design(many, [spec], ["city"]), ["city", "model_id"])
    d = d.withColumn("m", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: (1 + (k + F.hash("grp")) % 3 % 2).cast("smallint"))).cache()
    d.count()
    here, a = moved(50_000)
    dealt, b = moved(1)
    assert set(a) == set(b) and all(np.allclose(a[k], b[k], atol=1e-7) for k in a)
    assert here < dealt / 3
