"""Whether a good configuration has good neighbours on the grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from barograph.functions.columns import finite, plateau_verdict
from barograph.sources.shared import written


def swept_axes(evaluations: DataFrame, names: list[str]) -> list[str]:
    """Numeric parameters with more than one value."""
    numeric = [f.name for f in evaluations.schema.fields if f.name in names and isinstance(f.dataType, NumericType)]
    if not numeric:
        return []
    n = evaluations.agg(*[F.count_distinct(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if n[c] > 1]


def plateau(evaluations: DataFrame, axes: list[str]) -> DataFrame:
    """``evaluations`` with n_neighbours, neighbour_mean, _min, _std, robustness and verdict.

    Neighbours differ by one step on one axis, where steps are between values that were tried; those without
    a finite score don't count. Robustness is their mean over the score, null unless the score is positive. One equality
    join an axis; configurations without axes have no neighbours.
    """
    evaluations = written(evaluations, "evaluations")  # a sweep is read for each axis and not made again
    ranked = evaluations
    for a in axes:
        values = evaluations.select(a).distinct().withColumn(f"_r_{a}", F.row_number().over(Window.orderBy(a)))  # few: the values of one axis
        ranked = ranked.join(values, a)
    near = ranked.select(*[F.col(f"_r_{a}") for a in axes], finite(F.col("score")).alias("_s")).where("_s is not null")
    pairs = []
    for a in axes:
        for step in (-1, 1):
            moved = near.withColumn(f"_r_{a}", F.col(f"_r_{a}") + step)
            pairs.append(ranked.select("ord", *[f"_r_{x}" for x in axes]).join(moved, [f"_r_{x}" for x in axes]).select("ord", "_s"))
    stats = ["n_neighbours", "neighbour_mean", "neighbour_min", "neighbour_std"]
    if not pairs:
        out = evaluations.withColumns({"n_neighbours": F.lit(0).cast("long")} | {c: F.lit(None).cast("double") for c in stats[1:]})
    else:
        found = reduce(DataFrame.unionByName, pairs).groupBy("ord").agg(F.count("*").alias(stats[0]), F.avg("_s").alias(stats[1]), F.min("_s").alias(stats[2]), F.coalesce(F.stddev_samp("_s"), F.lit(0.0)).alias(stats[3]))
        out = evaluations.join(found, "ord", "left").withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0).cast("long")))
    out = out.withColumns({c: F.when(finite(F.col("score")).isNotNull(), F.col(c)) for c in stats[1:]})
    out = out.withColumn("robustness", F.when(finite(F.col("score")) > 0, F.try_divide("neighbour_mean", "score")))
    return out.withColumn("verdict", plateau_verdict(F.col("score"), F.col("n_neighbours"), F.col("robustness")))


def rank_by_robustness(evaluations: DataFrame, axes: list[str], top: int = 10, least: float = 0.7) -> DataFrame:
    """The ``top`` highest finite scores, those with robust neighbours first."""
    picked = plateau(evaluations, axes).where(finite(F.col("score")).isNotNull()).orderBy(F.desc("score"), "ord").limit(top)
    robust = F.coalesce(F.col("robustness") >= least, F.lit(False))
    return picked.withColumn("robust", robust).orderBy(F.desc("robust"), F.desc("score"), "ord")
