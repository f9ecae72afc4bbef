"""Exact quantiles of huge groups by rank selection.

The built-in exact percentile keeps all distinct values of a group in one task.  Here the
values are counted first (equal values collapse before the shuffle), then a histogram over
monotone value buckets locates the buckets that hold the wanted ranks, and only those
buckets are sorted.  A bucket spans a relative width of 1/2000 in log scale, so a group
has at most about a hundred thousand buckets whatever its number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E = 2_000


def _bucket(x: Column) -> Column:
    """Monotone bucket number of a double."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * 1e6) * BUCKETS_PER_E)


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles on index p * (n - 1), one output column per entry."""
    # explicit NOT NULL on the keys keeps both readers of the counts on one shuffle
    for c in (*keys, value):
        df = df.where(F.col(c).isNotNull())
    counts = (
        df.groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
        # NaN sorts behind every number, and so does its bucket
        .withColumn("_b", F.when(F.isnan("_x"), F.lit(2**62)).otherwise(
            F.coalesce(_bucket(F.col("_x")), F.lit(0))))
    )
    per_group = Window.partitionBy(*keys)
    in_order = per_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")).select(
        *keys, "_b", "_bn", F.coalesce(F.sum("_bn").over(in_order), F.lit(0)).alias("_base"),
        F.sum("_bn").over(per_group).alias("_total"))

    def low(p: float) -> Column:
        return F.floor(F.lit(p) * (F.col("_total") - 1)).cast("long")

    def high(p: float) -> Column:
        return F.least(low(p) + 1, F.col("_total") - 1)

    ranks = F.array_distinct(F.array(*[f(p) for p in probs.values() for f in (low, high)]))
    wanted = hist.withColumn("_ranks", F.filter(
        ranks, lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_bn")))
    ).where(F.size("_ranks") > 0)
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(
        Window.unboundedPreceding, -1)
    picked = (
        counts.join(wanted, [*keys, "_b"])
        .withColumn("_first", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .withColumn("_last", F.col("_first") + F.col("_n") - 1)
    )

    def value_at(rank: Column) -> Column:
        hit = (rank >= F.col("_first")) & (rank <= F.col("_last"))
        return F.max(F.when(hit, F.col("_x")))

    spots = picked.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[value_at(low(p)).alias(f"_lo_{n}") for n, p in probs.items()],
        *[value_at(high(p)).alias(f"_hi_{n}") for n, p in probs.items()])

    def interpolated(name: str, p: float) -> Column:
        at = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = at - F.floor(at)
        return F.when(share == 0, lo).otherwise(lo + share * (hi - lo))

    return spots.select(*keys, *[interpolated(n, p).alias(n) for n, p in probs.items()])
