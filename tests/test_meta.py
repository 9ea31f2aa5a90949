"""Pools against published result values of the same inputs."""

import pytest
from pyspark.sql import functions as F

from panelwright.functions import stats
from panelwright.operators import meta

# published inputs and results (fixed values)
CITIES = [
    ("Pittsburgh", 4.823143, True, -0.09780416016272578, 0.01019457763257654),
    ("San Francisco", 4.5397367, True, -0.07277839435673501, 0.010629640404390859),
    ("Seattle", 4.0962243, True, -0.05895734559825144, 0.006744685736940298),
    ("Cincinnati", 3.3620226, True, -0.060041563753788524, 0.008469877334325924),
    ("Baltimore", 2.1547163, False, -0.08052234015955671, 0.01185842385772541),
    ("Kansas City", 1.9838147, False, -0.14995598469248508, 0.016932441180132735),
    ("Montgomery", 1.9561207, False, -0.242742582881028, 0.016503467389698743),
    ("Charlotte", 1.8100202, False, -0.20628025079610302, 0.019126159163806004),
    ("Chicago", 0.9250653, False, -0.22016191872407803, 0.022558106128661742),
]
POOLS = {
    "all": dict(k=9, fe=-8.729947793448101, pct=-12.233115698786023, pct_lo=-17.06400727970846, pct_hi=-7.120832255281884,
                pct_lo_normal=-16.342526404941125, tau2=0.005179380022399589, tau2_dl=0.0032647705449766105,
                tau2_pm=0.005216992016521972, tau2_lo=0.0022474212704179353, tau2_hi=0.019807045822474955,
                I2=0.9751474362841147, I2_lo=0.9445237513113686, Q=205.86271346000473, Q_p=0.0, pct_pi_lo=-26.67204952262, pct_pi_hi=5.048974228713621),
    "above": dict(k=4, fe=-6.6071776902787205, pct=-6.894196616656445, pct_lo=-9.506566873102429, pct_hi=-4.206412287377203,
                  pct_lo_normal=-8.499440716279194, tau2=0.00023373388608642151, tau2_dl=0.0002170992806942214,
                  tau2_pm=0.00023875694151319457, tau2_lo=1.8510655963196004e-05, tau2_hi=0.004448384827756804,
                  I2=0.7514079937037539, I2_lo=0.19314528907923248, Q=11.422608436657605, Q_p=0.009646994321132363, pct_pi_lo=-13.712971226686221, pct_pi_hi=0.4634270862600154),
    "below": dict(k=5, fe=-14.553135552770103, pct=-16.37341126133538, pct_lo=-22.947354707970902, pct_hi=-9.238595020835739,
                  pct_lo_normal=-21.11773456121272, tau2=0.004128322542209529, tau2_dl=0.005520016238005601,
                  tau2_pm=0.00403809452908308, tau2_lo=0.001309776304833164, tau2_hi=0.03495067628721203,
                  I2=0.9367675234337409, I2_lo=0.8245671607731209, Q=83.23523672014221, Q_p=0.0, pct_pi_lo=-33.24949071145985, pct_pi_hi=4.769333127266329),
}
LEFT_OUT = {"Pittsburgh": (-12.614857052708196, 0.005806744197708179, 0.976689887800751),
            "Chicago": (-11.292709039928873, 0.004721831047968871, 0.9752200684926943),
            "Montgomery": (-10.96258005701678, 0.0038644293653500657, 0.9689119451387685)}
LEFT_OUT_ABOVE = {"Pittsburgh": (-6.014248207710649, 0.0, 0.0), "Seattle": (-7.356046409811112, 0.0002823449184866983, 0.7490528625401764)}


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame(CITIES, "label string, slope_sd double, qualifies boolean, beta double, se double").cache()


def pools(cities):
    q = F.when(F.col("qualifies"), "above").otherwise("below")
    return cities.withColumn("sample", F.explode(F.array(F.lit("all"), q)))


def test_random_effects(cities):
    got = {r["sample"]: r.asDict() for r in meta.pool_random(pools(cities), ["sample"]).collect()}
    fe = {r["sample"]: r.pooled_pct for r in meta.pool_fixed(pools(cities), ["sample"]).collect()}
    for name, want in POOLS.items():
        assert fe[name] == pytest.approx(want["fe"], rel=1e-10)
        for c, v in want.items():
            if c != "fe":
                assert got[name][c] == pytest.approx(v, rel=2e-7, abs=1e-12), (name, c)


def test_leave_one_out(cities):
    got = {r.dropped: r for r in meta.leave_one_out(cities, [], "label").collect()}
    assert len(got) == 9
    for k, (p, t, i) in LEFT_OUT.items():
        assert (got[k].pct, got[k].tau2, got[k].I2) == (pytest.approx(p, rel=1e-8), pytest.approx(t, rel=1e-7), pytest.approx(i, rel=1e-7))
    above = {r.dropped: r for r in meta.leave_one_out(cities.where("qualifies"), [], "label").collect()}
    for k, (p, t, i) in LEFT_OUT_ABOVE.items():
        assert (above[k].pct, above[k].tau2, above[k].I2) == (pytest.approx(p, rel=1e-8), pytest.approx(t, rel=1e-6, abs=1e-12), pytest.approx(i, rel=1e-6, abs=1e-9))


def test_meta_regression(cities):
    d = cities.withColumn("x", F.col("slope_sd") - 3.0)
    terms = meta.meta_regression(d, [], ["x"])
    r = {x.term: x for x in terms.collect()}
    i, s = r["intercept"], r["x"]
    assert (i.beta, i.se, i.lo, i.hi) == tuple(pytest.approx(v, rel=1e-8) for v in (-0.1250808760326076, 0.017327179488052322, -0.16605314486175715, -0.08410860720345803))
    assert (s.beta, s.se, s.t, s.p) == tuple(pytest.approx(v, rel=1e-7) for v in (0.03978068735420636, 0.013296946785170191, 2.991715917715256, 0.020177272955941294))
    assert (s.tau2_resid, s.tau2_null, s.R2) == tuple(pytest.approx(v, rel=1e-7) for v in (0.0021074534317304687, 0.005179380022399589, 0.5931070084418921))
    grid = {x.i: x for x in meta.prediction_grid(terms, d, "x").collect()}
    assert grid[0].pct == pytest.approx(-18.748686976021578, rel=1e-8) and grid[1].pct == pytest.approx(-18.53485532049629, rel=1e-8)
    assert len(grid) == 60


def test_equivalence(spark):
    rows = [("vandalism only", 0.0008732885771731563, -0.018450007325069004, 0.021393020237135903),
            ("vandalism only", 0.0040130265669380966, -0.014967994913726523, 0.021511075915142685),
            ("vandalism only", 0.015412271071932701, 0.004366399626974083, 0.02652327184586854),
            ("vandalism only", -0.01982287260244959, -0.040063235421301725, -0.005633723922033576),
            ("matched", 0.002540509956036191, -0.017304081265524195, 0.022782596265650993),
            ("matched", 0.0007932837225809175, -0.017741888101144687, 0.018582057294037294),
            ("matched", 0.016274103088310926, 0.005129735748904042, 0.02731449533499723),
            ("matched", -0.018756335156518304, -0.037968903106320256, -0.004173494155539264)]
    d = spark.createDataFrame(rows, "contrast string, beta double, lo double, hi double").withColumn("se", (F.col("hi") - F.col("lo")) / (2 * 1.96))
    p = meta.pool_random(d.select("contrast", "beta", "se"), ["contrast"])
    t = {r.contrast: r for r in meta.tost(p, "mu", "se_hk", F.abs(F.log(F.lit(1 - 0.0661))) / 2).collect()}
    v, m = t["vandalism only"], t["matched"]
    assert v.pct == pytest.approx(0.09042071600611212, rel=1e-7) and v.tau2 == pytest.approx(0.00016972366467888728, rel=1e-6)
    assert v.pct_lo == pytest.approx(-2.280662322067173, rel=1e-7) and v.I2 == pytest.approx(0.7157064996543462, rel=1e-6)
    assert v.tost_p == pytest.approx(4.960256703150264e-06, rel=1e-5) and v.equivalent
    assert m.pct == pytest.approx(0.09793332605931848, rel=1e-7) and m.tost_p == pytest.approx(4.120968582389029e-06, rel=1e-5)


def test_trend_and_stage_two(spark):
    cls = [(0.3, -0.6052202977424338, 0.2209220858604111), (2.0, -0.010462100699033756, 0.054405357692287507), (7.0, -0.1564231263629628, 0.041939098841033084),
           (14.0, -0.056029361535450586, 0.030753496221347633), (25.0, -0.1979837944828719, 0.055150502769671574), (None, -0.06600674173111307, 0.03436855585159754), (0.0, -0.10166565052849888, 0.040187129871525284)]
    r = meta.wls_line(spark.createDataFrame(cls, "kg double, beta double, se double"), [], "kg").first()
    assert r.n == 6 and r.slope == pytest.approx(-0.001837033905559989, rel=1e-9) and r.intercept_pct == pytest.approx(-7.899770551552754, rel=1e-9)
    two = [(-0.1884918375459431, 0.20653401824222611, 0.06615672103379609), (0.12095870705290206, 0.06036213529837047, 0.04740096768209521), (-0.07775937262552092, 0.0772613292167449, 0.04280036405395328),
           (0.16752833801536943, -0.0264367469140007, 0.03312404514851028), (0.12803036695562395, 0.027706526579327883, 0.025108126078351254), (0.11653534941057757, -0.5194779217210339, 0.12280602463166193),
           (-0.26809672771245274, 0.18827030643334264, 0.02618790060816389), (-0.1340525543382801, 0.1848899111411747, 0.022862867806272946), (0.10733562943964467, -0.09575015274179646, 0.03767503207761478),
           (0.6161882831100864, 0.6678235076105741, 0.627010922586433), (0.4128194327511113, 0.11721404404418764, 0.047792218040328585)]
    r = meta.wls_line(spark.createDataFrame(two, "rho double, beta double, se double"), [], "rho").first()
    want = (0.08353713582723155, 0.028421447264954162, -0.38377948047501964, 0.15119054796141201, 9.002665937079302)
    assert (r.intercept, r.intercept_se, r.slope, r.slope_se, r.naive_mean_pct) == tuple(pytest.approx(v, rel=1e-8) for v in want)


def test_single_and_pair_pools(spark):
    d = spark.createDataFrame([("one", 0.1, 0.05), ("two", 0.1, 0.05), ("two", 0.3, 0.04), ("bad", 0.1, 0.0)], "p string, beta double, se double")
    got = {r.p: r for r in meta.pool_random(d, ["p"]).collect()}
    assert set(got) == {"one", "two"}
    assert got["one"].method == "single" and got["one"].tau2 == 0 and got["one"].pi_lo is None
    assert got["two"].k == 2 and got["two"].tau2_hi is None and got["two"].pi_lo is None


def test_quantiles():
    assert stats.t_ppf_value(0.975, 3) == pytest.approx(3.182446305284263, rel=1e-10)
    assert stats.chi2_ppf_value(0.975, 8) == pytest.approx(17.534546139484647, rel=1e-10)
    assert stats.chi2_cdf_value(11.422608436657605, 3) == pytest.approx(1 - 0.009646994321132363, rel=1e-10)
