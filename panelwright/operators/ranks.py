"""Exact percentiles, ranks and dense numbering without one-task groups.

A window over a key that holds a third of the rows would sort those rows in
one task.  Here values are first collapsed to counts or cut into many buckets,
so only bucket totals (a few per key) are ever cumulated together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import partitions


SLICES = 64


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                      names: list[str], accuracy: int = 1000) -> DataFrame:
    """Linear-interpolated percentiles per key, exact at any size.

    An approximate sketch brackets each wanted order statistic.  Rows below the
    bracket are only counted; distinct values inside it are counted too, and
    put in order in even slices of the bracket, so no task orders a whole key.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if not keys:
        one = exact_percentiles(v.withColumn("_all", F.lit(1)), ["_all"], "_v", probs, names, accuracy)
        return one.drop("_all")
    probs, m = [float(p) for p in probs], len(probs)
    slack = 4.0 / accuracy
    ask = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = v.groupBy(*keys).agg(
        F.percentile_approx("_v", ask, accuracy).alias("_q"), F.count("*").alias("_n"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # in a small key a bracket of few rows could miss the neighbour the interpolation needs
    small = F.col("_n") <= 20 * accuracy
    spans = [F.struct(
        F.lit(i).alias("i"), (F.lit(p) * (F.col("_n") - 1)).alias("pos"),
        (F.col("_min") if p <= slack else F.when(small, F.col("_min")).otherwise(F.col("_q")[i])).alias("a"),
        (F.col("_max") if p >= 1 - slack else F.when(small, F.col("_max")).otherwise(F.col("_q")[m + i])).alias("b"))
        for i, p in enumerate(probs)]
    wanted = sketch.select(*keys, F.array(*spans).alias("_w"))
    part = v.join(wanted, keys).select(*keys, "_v", F.explode("_w").alias("_w")).where("_v <= _w.b")
    width = F.col("_w.b") - F.col("_w.a")
    piece = F.when(F.col("_v") < F.col("_w.a"), -1).when(width > 0, F.least(
        F.floor((F.col("_v") - F.col("_w.a")) / width * SLICES), F.lit(SLICES - 1))).otherwise(0)
    counts = part.groupBy(
        *keys, F.col("_w.i").alias("_i"), F.col("_w.pos").alias("_pos"), piece.cast("int").alias("_p"),
        F.when(F.col("_v") >= F.col("_w.a"), F.col("_v")).alias("_x")).agg(F.count("*").alias("_c"))
    k = [*keys, "_i"]
    sums = counts.groupBy(*k, "_p").agg(F.sum("_c").alias("_t"))
    sums = sums.withColumn("_o", F.sum("_t").over(Window.partitionBy(*k).orderBy("_p")) - F.col("_t")).drop("_t")
    inner = F.sum("_c").over(Window.partitionBy(*k, "_p").orderBy("_x"))
    ranked = counts.withColumn("_hi", inner).join(sums, [*k, "_p"]).withColumn("_hi", F.col("_hi") + F.col("_o"))
    at = lambda pos: F.max(F.when((F.col("_hi") - F.col("_c") <= pos) & (pos < F.col("_hi")), F.col("_x")))
    picked = ranked.groupBy(*k, "_pos").agg(at(F.floor("_pos")).alias("_l"), at(F.ceil("_pos")).alias("_h"))
    value_at = F.col("_l") + (F.col("_pos") - F.floor("_pos")) * (F.col("_h") - F.col("_l"))
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_i") == i, value_at)).alias(n) for i, n in enumerate(names)])


def _value_bucket(df: DataFrame, value: str, buckets: int) -> Column:
    """Bucket number of a value under global quantile cuts (a short literal array)."""
    row = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000)).first()
    cuts = sorted(set(row[0] or []))
    if not cuts:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0),
                       lambda acc, c: acc + F.when(F.col(value) > c, 1).otherwise(0))


def cumulative_counts(counts: DataFrame, keys: list[str], value: str, count: str = "_c") -> DataFrame:
    """Per key, rows strictly below each distinct value (``_below``) and the key's total (``_n``)."""
    b = max(2, min(256, partitions(counts.sparkSession)))
    c = counts.withColumn("_b", _value_bucket(counts, value, b))
    inner = Window.partitionBy(*keys, "_b").orderBy(value)
    within = c.withColumn("_in", F.sum(count).over(inner) - F.col(count))
    per = c.groupBy(*keys, "_b").agg(F.sum(count).alias("_t"))
    wb = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    wk = Window.partitionBy(*keys)
    offs = per.withColumn("_o", F.sum("_t").over(wb) - F.col("_t")).withColumn("_n", F.sum("_t").over(wk))
    return within.join(offs.drop("_t"), [*keys, "_b"]).withColumn(
        "_below", F.col("_in") + F.col("_o")).drop("_in", "_o", "_b")


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank of ``value`` among non-null rows of its key (ties share the mean rank)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranks = cumulative_counts(counts, keys, value).select(
        *keys, value, (F.col("_below") + (F.col("_c") + 1) / 2).alias(out), F.col("_n").alias(f"{out}_n"))
    return df.join(ranks, [*keys, value], "left")


def dense_index(df: DataFrame, keys: list[str], order: Column, out: str = "idx") -> DataFrame:
    """Number rows 0..n-1 inside each key in the order of a 64-bit hash.

    The hash is uniform, so its leading bits cut every key into even buckets;
    no key's rows are sorted in one task.
    """
    b = max(2, min(1024, partitions(df.sparkSession)))
    h = df.withColumn("_h", order)
    h = h.withColumn("_b", F.pmod(F.shiftright("_h", 40), F.lit(b)))
    per = h.groupBy(*keys, "_b").agg(F.count("*").alias("_t"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    offs = per.withColumn("_o", F.sum("_t").over(wb) - F.col("_t")).drop("_t")
    inner = Window.partitionBy(*keys, "_b").orderBy("_h")
    return (h.withColumn("_r", F.row_number().over(inner) - 1)
             .join(offs, [*keys, "_b"])
             .withColumn(out, (F.col("_r") + F.col("_o")).cast("long"))
             .drop("_h", "_b", "_r", "_o"))


def ordered_index(df: DataFrame, keys: list[str], number: str, out: str = "idx") -> DataFrame:
    """Number rows 0..n-1 inside each key in the order of a whole ``number``, cut into slices by its value."""
    low, high = df.agg(F.min(number), F.max(number)).first()
    low, span = low or 0, (high or 0) - (low or 0) + 1
    place = (F.col(number) - low).cast("bigint")
    slices = max(2, min(1024, partitions(df.sparkSession)))
    return dense_index(df, keys, F.shiftleft(F.floor(place / float(span) * slices).cast("bigint"), 40) + F.pmod(place, F.lit(1 << 40)), out)


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates by a partial-aggregated groupBy and a join.

    Unlike an unframed window this never gathers a hot group in one task; AQE
    broadcasts the small side or splits the skewed join.  Rows with a null key stay,
    with null aggregates.
    """
    g = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(g, keys, "left")
