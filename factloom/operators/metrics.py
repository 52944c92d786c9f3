"""Scores, comparisons and verdicts over long-format metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    """Into [0, 1] by fixed bounds."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, in the order given; an unknown (null) check fails."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()])), ",")


def weighted(values: dict[Column | str, float], missing: str = "ignore") -> Column:
    """Weighted mean; missing values are left out ("ignore") or count 0.5 ("prior")."""
    cols = [(F.col(c) if isinstance(c, str) else c, w) for c, w in values.items()]
    if missing == "prior":
        return sum(F.coalesce(c, F.lit(0.5)) * w for c, w in cols) / sum(w for _, w in cols)
    top = sum(F.coalesce(c * w, F.lit(0.0)) for c, w in cols)
    return top / F.nullif(sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in cols), F.lit(0.0))


def composite(rows: DataFrame, group: list[str], score: Column, weight: Column, applicable: Column) -> DataFrame:
    """Integer composite: sum(score * weight) div sum(weight) over the applicable metrics."""
    top, low = F.sum(F.when(applicable, score * weight)), F.sum(F.when(applicable, weight))
    return rows.groupBy(*group).agg(top.alias("t"), low.alias("l")).withColumn("composite", F.coalesce(F.expr("t div nullif(l, 0)"), F.lit(0)).cast("long")).drop("t", "l")


def winners(rows: DataFrame, pair: str, side: str, left: str, right: str) -> DataFrame:
    """Both sides' composites of each pair and which is higher."""
    both = rows.groupBy(pair).agg(F.coalesce(F.sum(F.when(F.col(side) == left, F.col("composite"))), F.lit(0)).alias("left_score"), F.coalesce(F.sum(F.when(F.col(side) == right, F.col("composite"))), F.lit(0)).alias("right_score"))
    return both.withColumn("winner", F.when(F.col("left_score") > F.col("right_score"), left).when(F.col("left_score") < F.col("right_score"), right).otherwise("tie"))


def percentiles(samples: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles and the mean."""
    exact = [F.expr(f"cast(percentile_disc({p}) within group (order by `{value}`) as double)").alias(n) for n, p in points.items()]
    return samples.groupBy(group).agg(*[F.round(x, 6).alias(n) for x, n in zip(exact, points, strict=True)], F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("samples"))


def regressions(baseline: DataFrame, current: DataFrame, key: str, value: str, allowed: float) -> DataFrame:
    """Metrics that fell by more than is allowed."""
    both = baseline.select(key, F.col(value).alias("before")).join(current.select(key, F.col(value).alias("after")), key)
    return both.withColumn("drop", F.round(F.col("before") - F.col("after"), 6)).filter(F.col("drop") > allowed)


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Deltas of all metrics of either side; one that only one side has, has none."""
    both = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key, "full_outer")
    return both.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def verdict(deltas: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(names beyond tolerance, clear / hold / incident): incident from two violations, or one beyond twice its tolerance."""
    over = F.array_compact(F.array(*[F.when(F.abs(d) > t, F.lit(n)) for n, (d, t) in deltas.items()]))
    far = F.greatest(*[F.when(F.abs(d) > 2 * t, 1).otherwise(0) for d, t in deltas.values()])
    return F.array_join(over, ","), F.when((F.size(over) > 1) | (far == 1), "incident").when(F.size(over) == 1, "hold").otherwise("clear")


def freshness(changes: dict[str, Column], gone: Column, moved: Column) -> tuple[Column, Column]:
    """(reasons, class) of one observation against the one before it."""
    why = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in changes.items()]))
    return F.array_join(why, ","), F.when(gone, "unavailable").when(moved, "superseded").when(F.size(why) == 0, "unchanged").when(F.size(why) == 1, "updated").otherwise("investigate")
