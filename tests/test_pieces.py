"""Replicates by packed pieces: weights ride once a unit and group, label draws are kept as sums by group only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import replicates, resample
from panelwright.operators.ppml import Spec, build_design, centre_within, newton_slopes


@pytest.fixture(scope="module")
def cells(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(400):
        g = 0 if i % 4 == 0 else int(r.integers(1, 25))         # a quarter of all rows in one group
        rows.append(("a" if i % 2 else "b", i, g, int(r.integers(0, 6)), float(r.normal()), float(r.normal()), int(r.poisson(3)), int(r.poisson(2)), float(r.uniform(0.5, 2))))
    return spark.createDataFrame(rows, "city string, cell long, GEOID int, tile int, x double, z double, n_A int, n_B int, exposure double").withColumn("n_total", F.col("n_A") + F.col("n_B")).cache()


@pytest.mark.parametrize("salt", [50_000, 7])
def test_units_across_groups_equal_copied_rows(spark, cells, monkeypatch, salt):
    """A group's rows of several units are several pieces, which still make one group; a dealt one as well."""
    monkeypatch.setattr(replicates, "SALT_ROWS", salt)
    km = ["city", "model_id"]
    d = centre_within(build_design(cells.withColumn("_unit", F.col("tile").cast("string")), [Spec("one", "n_A", ["x", "z"]), Spec("two", "n_B", ["x"])], ["city"], carry=["_unit"]), km).cache()
    draws = resample.draw_multiplicity(cells.select("city", F.col("tile").cast("string").alias("unit")).distinct(), ["city"], 12, 3).cache()
    weighed, kept = [], replicates.with_weights
    monkeypatch.setattr(replicates, "with_weights", lambda d, *a: weighed.append(d.count()) or kept(d, *a))
    new = {(r.city, r.model_id, r.rep): r for r in replicates.replicate_slopes(d, km, 12, {}, draws=draws, unit="_unit").collect()}
    old = newton_slopes(resample.weighted_replicates(d, draws, ["city"], "_unit").drop("_unit"), [*km, "rep"], 60).where("converged").collect()
    assert len(old) > 40 and all(np.allclose(new[r.city, r.model_id, r.rep].b, r.b, atol=1e-7) for r in old)
    pieces = d.select(*km, "grp", "_unit").distinct().count()
    assert weighed == [pieces] if salt > 7 else pieces < weighed[0] <= d.count()


def test_bootstrap_weighs_a_group_once(spark, cells, monkeypatch):
    weighed, kept = [], replicates.with_weights
    monkeypatch.setattr(replicates, "with_weights", lambda d, *a: weighed.append(d.count()) or kept(d, *a))
    resample.bootstrap_slopes(cells, [Spec("one", "n_A", ["x"]), Spec("two", "n_B", ["x"])], ["city"], F.col("GEOID"), 6, 5)
    assert weighed == [2 * cells.select("city", "GEOID").distinct().count()]


def test_label_draws_are_not_kept(spark, cells, monkeypatch):
    """The spread over relabellings is that of fits to the rows of every draw, which only these fits here are given."""
    counts = cells.select("city", "cell", F.explode(F.array(*[F.struct(F.lit(c).alias("pred"), F.col(f"n_{c}").alias("n")) for c in "AB"])).alias("c")).select("city", "cell", "c.*")
    conf = spark.createDataFrame([("A", "A", .8), ("A", "C", .2), ("B", "B", .7), ("B", "A", .3)], "pred string, truth string, p double")
    reps, seed, km = 15, 20260804, ["city", "model_id"]
    drawn = resample.relabel_draws(counts, conf, ["city", "cell"], reps, seed)
    every = cells.crossJoin(spark.range(reps).select(F.col("id").cast("int").alias("rep")))
    wide = drawn.groupBy("city", "cell", "rep").agg(*[F.sum(F.when(F.col("truth").isin(*c), F.col("n"))).alias(o) for o, c in (("total", "AB"), ("theft", "A"), ("noloot", "B"))])
    d = every.join(wide, ["city", "cell", "rep"], "left").fillna(0, ["total", "theft", "noloot"])
    fits = []
    for o in ("total", "theft", "noloot"):
        one = centre_within(build_design(d, [Spec(o, o, ["x"])], ["city", "rep"]), ["city", "rep", "model_id"])
        fits += [(r.city, o, r.rep, r.b[0]) for r in newton_slopes(one, [*km, "rep"], 60).collect() if r.converged]
    b = {(c, o, k): v for c, o, k, v in fits}
    monkeypatch.setattr(resample, "relabelled", lambda *_: pytest.fail("draws became rows"))
    for most in (replicates.MOST_BYTES, 8):
        monkeypatch.setattr(replicates, "MOST_BYTES", most)
        for r in resample.label_noise_draws(cells, counts, conf, ["A", "B"], ["x"], ["city"], reps=reps, theft=["A"], no_loot="B").collect():
            total, diff = [b[r.city, "total", k] for k in range(reps)], [b[r.city, "theft", k] - b[r.city, "noloot", k] for k in range(reps)]
            assert r.draws == reps and r.se_label == pytest.approx(np.std(total, ddof=1), rel=1e-6)
            assert r.diff_sd_label == pytest.approx(np.std(diff, ddof=1), rel=1e-6)


def test_draws_counted_in_lists_are_the_hashes(spark, monkeypatch):
    """Slots and units dealt to many tasks give the draws that one row a draw gives."""
    monkeypatch.setattr(resample, "UNITS_AT_ONCE", 4)
    monkeypatch.setattr(resample, "SLOTS_AT_ONCE", 7)
    units = spark.createDataFrame([(c, f"u{i}") for c, n in (("a", 23), ("b", 5), ("c", 1)) for i in range(n)], "city string, unit string")
    got = {(r.city, r.unit): list(r.m) for r in resample.multiplicities(units, ["city"], 9, 3).collect()}
    idx = resample.dense_index(units, ["city"], F.xxhash64(F.lit(3), "city", "unit"), "j").cache()
    size = idx.groupBy("city").agg(F.count("*").alias("g"))
    slots = idx.join(size, "city").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(8))))
    picks = slots.select("city", "rep", F.pmod(F.xxhash64(F.lit(3), "rep", "city", F.col("j").cast("bigint")), F.col("g")).alias("j"))
    want = {k: [0] * 9 for k in got}
    for r in picks.join(idx, ["city", "j"]).collect():
        want[r.city, r.unit][r.rep] += 1
    assert got == want and sum(map(sum, got.values())) == 29 * 9
