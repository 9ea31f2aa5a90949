"""Mixing sources to target weights.

Documents belong to one source or to several; they are first added up by membership
pattern.  A minimum-cost flow then routes the patterns' words to the sources' quotas: a
pattern offers its words once at no cost, a second time at cost 1, a third at cost 3 and
so on, so repetition is convex and is used only where a quota needs it.  The driver holds
one row a pattern, never one a document.

Documents are selected in the order of a seeded hash.  A pattern that has to give q times
its words and r more gives every document q times and, once more, the documents up to a
point in that order: the point is found from sums over 65,536 hash bins and from the rows
of the one bin that holds it.  Where a document is too large for what is left, the order is
gone on with among the documents that are not larger, again and again, until what is left is
below ``NEAR`` of the words asked for or no document is that small; single documents, added, left or
exchanged, then close the gap as long as one such step makes it smaller.  What decides is thus a few numbers a pattern, and each row is decided
where it is read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import fields, over_texts, with_results
from panelwright.session import cut

MOST, SEED, NEAR = 3, 23, 0.0005
LOWEST = -(2 ** 63)
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    sizes: dict             # words of each source (documents of several sources count in each)
    targets: dict           # target of each source
    decisions: DataFrame    # pattern, q, cuts (largest size, bin, hash, id), single documents to add and to leave: a row a pattern


def shares(sizes: dict, total: float, most: int = MOST) -> dict:
    """Targets of the sources: weights 1, 2, 3, 1, ... by code point, null last; none above ``most`` times its size.

    What a stopped source leaves is shared among the others by weight, until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_, left = {}, list(names), float(total)
    while open_:
        all_ = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / all_ > most * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / all_ for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


def route(supply: list[int], members: list[list[int]], quota: list[int], most: int = MOST) -> list[int]:
    """Words each pattern gives in a cheapest flow that fills the quotas as far as it can be done.

    Cheapest paths are found one after the other (costs may fall along backward arcs),
    each filled to its narrowest arc.
    """
    p, s = len(supply), len(quota)
    start, end = p + s, p + s + 1
    arcs, out = [], [[] for _ in range(p + s + 2)]

    def arc(a, b, room, cost):
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
    for i, n in enumerate(supply):
        for times in range(most):
            arc(start, i, n, times * (times + 1) // 2)
        for j in members[i]:
            arc(i, p + j, n * most, 0)
    for j, n in enumerate(quota):
        arc(p + j, end, n, 0)
    while True:
        far, via, queue, waiting = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for k in out[a]:
                b, room, cost = arcs[k]
                if room > 0 and far[a] + cost < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + cost, k
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if end not in far:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        room = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= room
            arcs[k ^ 1][1] += room
    return [sum(arcs[k ^ 1][1] for k in out[start] if arcs[k][0] == i and k % 2 == 0) for i in range(p)]


def _keys(doc: str, text: str, source: str, kind: str, seed: int) -> dict[str, Column]:
    """Pattern (as JSON text), order hash and hash bin of a row, computed where it is read."""
    s = F.col(source)
    listed = s if kind.startswith("array") else F.array(s)
    listed = F.when(F.coalesce(F.size(listed), F.lit(0)) <= 0, F.array(F.lit(None).cast("string"))).otherwise(listed.cast("array<string>"))
    h = F.xxhash64(F.lit(seed), F.col(doc), F.col(text))
    return {"__p": F.to_json(F.array_sort(F.array_distinct(listed))), "__h": h, "__bin": F.shiftrightunsigned(h, 48).cast("int"),
            "__d": F.coalesce(F.col(doc).cast("bigint"), F.lit(LOWEST))}


def sized(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, the keys and ``size`` (words; 0 for null), written to the checkpoint folder once."""
    kind = dict(docs.dtypes)[source]
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"),
                       *[c.alias(k) for k, c in _keys(doc, text, source, kind, seed).items()])
    results = {"size": "bigint"}

    def start():
        return lambda b, texts: with_results(b, {"size": pa.array(np.array([len(t.split()) if t else 0 for t in texts], np.int64))})
    return cut(over_texts(rows, fields(rows, results), start))


def plan(rows: DataFrame, most: int = MOST, targets: dict | None = None) -> Plan:
    """Decisions for rows of ``sized``; targets by ``shares`` unless they are given."""
    import json

    per = [(json.loads(r[0]), r[0], int(r[1])) for r in rows.groupBy("__p").agg(F.sum("size")).orderBy("__p").collect()]
    sizes: dict = {}
    for names, _, n in per:
        for s in names:
            sizes[s] = sizes.get(s, 0) + n
    total = sum(n for _, _, n in per)
    goal = shares(sizes, total, most) if targets is None else targets
    order = list(sizes)
    give = route([n for _, _, n in per], [[order.index(s) for s in names] for names, _, _ in per], [int(goal.get(s, 0)) for s in order], most)
    spark = rows.sparkSession
    start = [(p, *(divmod(g, n) if n else (0, 0))) for (_, p, n), g in zip(per, give)]
    cuts: dict = {p: [] for p, _, _ in start}
    left = {p: r for p, _, r in start if r}
    goal_ = {p: give_ for (_, p, _), give_ in zip(per, give)}
    quotient, open_ = {p: q for p, q, _ in start}, dict(left)
    while open_:
        now = spark.createDataFrame([(p, quotient[p], cuts[p], [], [], g) for p, g in open_.items()], _DECISION + ", gap bigint")
        free = rows.join(F.broadcast(now), "__p").filter(~_taken("size") & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
        free = free.select("__p", "__bin", "__h", "__d", "size", "gap")
        bins = free.groupBy("__p", "__bin", "gap").agg(F.sum("size").alias("n"))
        so_far = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("__p").orderBy("__bin")))
        edge = so_far.groupBy("__p").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.col("__bin"))).alias("edge"), F.max("upto").alias("all_"))
        edge = so_far.join(edge, "__p").filter("edge IS NULL OR __bin = edge").groupBy("__p", "edge", "all_").agg(F.min(F.col("upto") - F.col("n")).alias("before"))
        edge = _small(edge)
        inside = free.join(F.broadcast(edge), "__p").filter("__bin = edge").withColumn(
            "upto", F.col("before") + F.sum("size").over(Window.partitionBy("__p").orderBy("__h", "__d").rangeBetween(Window.unboundedPreceding, 0)))
        last = inside.filter("upto <= gap").groupBy("__p").agg(F.max(F.struct("__h", "__d")).alias("m"), F.max("upto").alias("have"))
        found = {r["__p"]: r for r in edge.join(last, "__p", "left").select("__p", "edge", "all_", "before", "m.__h", "m.__d", "have").collect()}
        still = {}
        for p, gap in open_.items():
            r = found.get(p)
            if r is None:                                   # no document is that small
                continue
            took = r.all_ if r.edge is None else r.have if r.have is not None else r.before
            cuts[p].append((gap, 1 << 16 if r.edge is None else r.edge, r["__h"], r["__d"]))
            left[p] = gap - took
            if took and left[p] > max(NEAR * goal_[p], 0):
                still[p] = left[p]
        open_ = still
    added: dict = {p: ([], []) for p in cuts}
    open_ = {p: g for p, g in left.items() if g > NEAR * goal_[p]}
    while open_:
        now = spark.createDataFrame([(p, quotient[p], cuts[p], *added[p], g) for p, g in open_.items()], _DECISION + ", gap bigint")
        found = _closing(rows, now)
        for p, (gap, fill, drop) in found.items():
            open_[p] = gap
            for k, row in zip((0, 1), (fill, drop)):
                if row[1] is not None:
                    added[p][k].append(row[1:])
        open_ = {p: open_[p] for p in found if abs(open_[p]) > NEAR * goal_[p]}
    return Plan(sizes, goal, spark.createDataFrame([(p, q, cuts[p], *added[p]) for p, q, _ in start], _DECISION))


def _closing(rows: DataFrame, now: DataFrame) -> dict:
    """For each pattern of ``now`` that can come closer: (gap then left, document to add, document to leave), each (size, hash, id).

    One row for each size that is still free or taken, of the patterns whose gap is not closed, comes to the driver.
    """
    by_size = (rows.join(F.broadcast(now), "__p").filter("size > 0").select("__p", "gap", "size", _once_more("size").alias("t"), "__h", "__d")
               .groupBy("__p", "gap", "size", "t").agg(F.min(F.struct("__h", "__d")).alias("m")))
    seen: dict = {}
    for r in by_size.select("__p", "gap", "size", "t", "m.*").collect():
        seen.setdefault((r["__p"], r.gap), ([(0, None, None)], [(0, None, None)]))[r.t].append((r.size, r["__h"], r["__d"]))
    out = {}
    for (p, gap), (free, taken) in seen.items():
        free.sort(key=lambda x: x[0])
        sizes, least = [x[0] for x in free], abs(gap)
        for drop in sorted(taken, key=lambda x: x[0]):
            i = bisect_left(sizes, gap + drop[0])
            for fill in free[max(i - 1, 0): i + 1]:
                if abs(gap + drop[0] - fill[0]) < least:
                    least = abs(gap + drop[0] - fill[0])
                    out[p] = (gap + drop[0] - fill[0], fill, drop)
    return out


_DECISION = "__p string, q int, cuts array<struct<most: bigint, edge: int, hash: bigint, doc: bigint>>, fills array<struct<hash: bigint, doc: bigint>>, drops array<struct<hash: bigint, doc: bigint>>"


def _small(df: DataFrame) -> DataFrame:
    """A row a pattern, through the driver, which holds the patterns: a join with it then needs no shuffle of the documents."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _taken(size: str) -> Column:
    """Whether one of the cuts gives a row once more: it is small enough and comes before the cut's point."""
    h, d, b, n = (F.col(c) for c in ("__h", "__d", "__bin", size))
    return F.exists("cuts", lambda c: (n <= c["most"]) & ((b < c["edge"]) | ((b == c["edge"]) & F.coalesce(
        (h < c["hash"]) | ((h == c["hash"]) & (d <= c["doc"])), F.lit(False)))))


def _once_more(size: str) -> Column:
    """1 for a row that is given once more than q times."""
    is_in = lambda k: F.exists(k, lambda c: (F.col("__h") == c["hash"]) & (F.col("__d") == c["doc"]))
    return ((_taken(size) | is_in("fills")) & ~is_in("drops")).cast("int")


def _copies(size: str = "size") -> Column:
    return F.least(F.col("q") + _once_more(size), F.lit(MOST))


def _decided(rows: DataFrame, p: Plan) -> DataFrame:
    """Rows with their pattern's decision, which the driver holds anyway (a row a pattern)."""
    return rows.join(F.broadcast(p.decisions), "__p")


def copies(rows: DataFrame, p: Plan) -> DataFrame:
    """doc_id, source, size and ``copies`` (0 to ``most``) for rows of ``sized``.

    Rows of equal id and text are decided alike, as they share their place in the order.
    """
    return _decided(rows, p).select("doc_id", "source", "size", _copies().alias("copies"))


def mixed(docs: DataFrame, p: Plan, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns unchanged, whatever their names.

    Null and empty texts have no words and are given q times like the others of their pattern; a null source is a source of its own; an
    empty table gives no rows.
    """
    keys = {**_keys(doc, text, source, dict(docs.dtypes)[source], seed), "__n": F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0))}
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])
    return _decided(d, p).withColumn("__c", F.explode(F.array_repeat(F.lit(0), _copies("__n")))).select("row.*")


def source_table(spark, p: Plan) -> DataFrame:
    """source, source_size, target: a row a source."""
    return spark.createDataFrame([(s, n, float(p.targets.get(s, 0.0))) for s, n in p.sizes.items()], "source string, source_size bigint, target double")
