"""Queries: street-network measures (with SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import graph
from panelwright.plans import inputs as I
from panelwright.plans.inputs import NET_SQL, q6, r6
from panelwright.plans.registry import query

UND_SQL = f"""{NET_SQL}, und AS MATERIALIZED (SELECT net, least(src, dst) AS lo, greatest(src, dst) AS hi, min(length) AS length FROM edges WHERE src <> dst GROUP BY 1, 2, 3),
  arcs AS MATERIALIZED (SELECT net, lo AS u, hi AS v, length FROM und UNION ALL SELECT net, hi, lo, length FROM und)"""


@query("street_segments", f"""WITH {NET_SQL}, s AS (SELECT net, least(src, dst) AS lo, greatest(src, dst) AS hi, min(length) AS length FROM edges GROUP BY 1, 2, 3)
   SELECT s.net, lo || '_' || hi || '_0' AS seg_id, length, (a.x + b.x) / 2 AS mid_x, (a.y + b.y) / 2 AS mid_y FROM s JOIN nodes a ON a.net = s.net AND a.node = lo JOIN nodes b ON b.net = s.net AND b.node = hi
   WHERE (a.x + b.x) / 2 BETWEEN 50 AND 600 AND (a.y + b.y) / 2 BETWEEN 50 AND 5000""")
def _(t):
    n, e = I.streets(t)
    return graph.street_segments(e, n, (50.0, 50.0, 600.0, 5000.0)).select("net", "seg_id", "length", "mid_x", "mid_y")


@query("node_degree", f"WITH {UND_SQL} SELECT net, u AS node, count(*) AS degree FROM arcs GROUP BY 1, 2")
def _(t):
    return graph.node_degree(I.streets(t)[1])


@query("intersections", f"WITH {UND_SQL} SELECT net, u AS node FROM arcs GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t):
    n, e = I.streets(t)
    return graph.intersections(n, e).select("net", "node")


BOUND_SQL = """bx AS (SELECT net, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes GROUP BY 1),
  bn AS (SELECT net, node FROM nodes JOIN bx USING (net) WHERE least(x - x0, x1 - x, y - y0, y1 - y) < 100)"""


@query("boundary_nodes", f"WITH {NET_SQL}, {BOUND_SQL} SELECT net, node FROM bn")
def _(t):
    return graph.boundary_nodes(I.streets(t)[0])


def _peel_sql(rounds=25):
    out = "al0 AS (SELECT net, lo, hi FROM und)"
    for i in range(rounds):
        out += f""", lf{i} AS MATERIALIZED (SELECT net, u FROM (SELECT net, lo AS u FROM al{i} UNION ALL SELECT net, hi FROM al{i}) GROUP BY 1, 2 HAVING count(*) = 1 AND (net, u) NOT IN (SELECT (net, node) FROM fz)),
          al{i + 1} AS MATERIALIZED (SELECT net, lo, hi FROM al{i} WHERE (net, lo) NOT IN (SELECT (net, u) FROM lf{i}) AND (net, hi) NOT IN (SELECT (net, u) FROM lf{i}))"""
    return out


@query("dead_ends", f"""WITH {UND_SQL}, fz AS (SELECT net, node FROM nodes WHERE node % 8 = 0), {_peel_sql()}
   SELECT net, lo, hi, (net, lo) IN (SELECT (net, u) FROM lf0) OR (net, hi) IN (SELECT (net, u) FROM lf0) AS is_deadend, (net, lo, hi) NOT IN (SELECT (net, lo, hi) FROM al25) AS cul_de_sac FROM und""")
def _(t):
    n, e = I.streets(t)
    return graph.dead_ends(e, n.where("node % 8 = 0"))


def _reach_sql(r, rounds):
    out = "r0 AS (SELECT DISTINCT net, u AS s, u AS n, 0.0::DOUBLE AS d FROM arcs)"
    for i in range(rounds):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT net, s, n, min(d) AS d FROM (SELECT * FROM r{i} UNION ALL SELECT r.net, r.s, a.v, r.d + a.length FROM r{i} r JOIN arcs a ON a.net = r.net AND a.u = r.n WHERE r.d + a.length <= {r}) GROUP BY 1, 2, 3)"""
    return out


@query("egress_count", f"""WITH {UND_SQL}, {_reach_sql(200, 4)}, fr AS (SELECT DISTINCT r.net, r.s, r.n FROM r4 r JOIN arcs a ON a.net = r.net AND a.u = r.n LEFT JOIN r4 q ON q.net = r.net AND q.s = r.s AND q.n = a.v WHERE q.n IS NULL),
   b AS (SELECT DISTINCT u.net, lo, hi, n FROM und u JOIN fr ON fr.net = u.net AND (fr.s = lo OR fr.s = hi)), c AS (SELECT net, lo, hi, count(*) AS k FROM b GROUP BY 1, 2, 3)
   SELECT net, lo, hi, coalesce(k, 0) AS egress_count FROM und LEFT JOIN c USING (net, lo, hi)""")
def _(t):
    return graph.egress_count(I.streets(t)[1])


def _between_sql(rounds=48):
    """Both weights: least distances in unrolled rounds, then paths and dependencies hop by hop as recursive sums."""
    out = f"""WITH RECURSIVE {NET_SQL}, arc AS MATERIALIZED (
     SELECT net, 0 AS m, src AS u, dst AS v, min(travel_time) AS w FROM edges WHERE src <> dst GROUP BY 1, 3, 4
     UNION ALL SELECT net, 1, src, dst, min(length) FROM edges WHERE src <> dst GROUP BY 1, 3, 4),
   ms AS (SELECT unnest([0, 1]) AS m), d0 AS MATERIALIZED (SELECT net, m, node AS s, node AS v, 0.0::DOUBLE AS d FROM nodes, ms)"""
    for i in range(rounds):
        out += f""", d{i + 1} AS MATERIALIZED (SELECT net, m, s, v, min(d) AS d FROM (SELECT * FROM d{i} UNION ALL
          SELECT net, m, d.s, a.v, d.d + a.w FROM d{i} d JOIN arc a USING (net, m) WHERE a.u = d.v) GROUP BY ALL)"""
    return out + f""", tight AS MATERIALIZED (SELECT a.net, a.m, f.s, a.u, a.v FROM arc a
     JOIN d{rounds} f ON f.net = a.net AND f.m = a.m AND f.v = a.u JOIN d{rounds} t ON t.net = a.net AND t.m = a.m AND t.s = f.s AND t.v = a.v AND f.d + a.w = t.d),
   walk AS (SELECT net, m, s, v, 1.0::DOUBLE AS c, 0 AS hop FROM d0 UNION ALL
     SELECT t.net, t.m, t.s, t.v, sum(w.c), w.hop + 1 FROM walk w JOIN tight t ON t.net = w.net AND t.m = w.m AND t.s = w.s AND t.u = w.v GROUP BY 1, 2, 3, 4, 6),
   c AS MATERIALIZED (SELECT net, m, s, v, sum(c) AS c FROM walk GROUP BY ALL),
   home AS (SELECT net, m, s, v, 1 / c AS x, 0 AS hop FROM c UNION ALL
     SELECT t.net, t.m, t.s, t.u, sum(h.x), h.hop + 1 FROM home h JOIN tight t ON t.net = h.net AND t.m = h.m AND t.s = h.s AND t.v = h.v GROUP BY 1, 2, 3, 4, 6),
   x AS MATERIALIZED (SELECT net, m, s, v, sum(x) AS x FROM home GROUP BY ALL),
   f AS (SELECT t.net, t.m, least(t.u, t.v) AS lo, greatest(t.u, t.v) AS hi, sum(c.c * x.x) AS f FROM tight t
     JOIN c ON c.net = t.net AND c.m = t.m AND c.s = t.s AND c.v = t.u JOIN x ON x.net = t.net AND x.m = t.m AND x.s = t.s AND x.v = t.v GROUP BY 1, 2, 3, 4),
   n AS (SELECT net, count(*)::DOUBLE AS n FROM nodes GROUP BY 1),
   und AS (SELECT DISTINCT net, least(src, dst) AS lo, greatest(src, dst) AS hi FROM edges WHERE src <> dst)
   SELECT und.net, und.lo, und.hi, {q6('coalesce(a.f / (n * (n - 1)), 0)', 9)} AS betweenness, {q6('coalesce(b.f / (n * (n - 1)), 0)', 9)} AS betweenness_len, true AS exact
   FROM und JOIN n USING (net) LEFT JOIN f a ON a.m = 0 AND a.net = und.net AND a.lo = und.lo AND a.hi = und.hi
   LEFT JOIN f b ON b.m = 1 AND b.net = und.net AND b.lo = und.lo AND b.hi = und.hi"""


@query("edge_betweenness", _between_sql())
def _(t):
    n, e = I.streets(t)
    # lattices of the nations; lengths are whole numbers, so equal paths tie exactly
    both = graph.betweenness(e, n, ["travel_time", "length"]).groupBy("net", "lo", "hi", "exact").agg(
        F.max_by("betweenness", -F.col("metric")).alias("betweenness"), F.max_by("betweenness", "metric").alias("betweenness_len"))
    return both.select("net", "lo", "hi", r6("betweenness", 9).alias("betweenness"), r6("betweenness_len", 9).alias("betweenness_len"), "exact")
