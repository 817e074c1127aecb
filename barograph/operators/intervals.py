"""Points in ranges: as an equality join on an index of cells, and counts of them from running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.operators.ordered import scan

#: Levels of cells: a cell of level k holds 2^k whole numbers.
LEVELS = 62


def cells_of(start: str, stop: str) -> Column:
    """The cells (level, cell) that make up [start, stop): two a level at most, each as large as fits."""
    low, high = f"(-shiftright(-`{start}`, k))", f"shiftright(`{stop}`, k)"
    first = f"CASE WHEN {low} < {high} AND ({low} & 1) = 1 THEN {low} END"
    last = f"CASE WHEN {low} < {high} AND ({high} & 1) = 1 THEN {high} - 1 END"
    each = f"transform(filter(array({first}, {last}), c -> c IS NOT NULL), c -> named_struct('level', k, 'cell', c))"
    return F.expr(f"flatten(transform(sequence(0, {LEVELS}), k -> {each}))")


def interval_join(points: DataFrame, ranges: DataFrame, at: str, start: str, stop: str, by: list[str] | None = None) -> DataFrame:
    """Each point with each range [start, stop) that holds it, and the columns of both; ranges of any lengths, which may overlap.

    A range is listed under O(log length) cells, a point under its cell of each level that ranges use: 63 numbers at most meet on
    the driver. Empty ranges, and nulls, match nothing. ``by``: columns of both that must be equal, too. The join is a merge join
    by hint: Spark's estimates don't see that points are listed many times, and would send them all through the driver.
    ``interval_counts`` is the way if only numbers of points are wanted.
    """
    by = by or []
    whole = ranges.withColumns({start: F.col(start).cast("long"), stop: F.col(stop).cast("long")})
    listed = whole.select("*", F.explode(cells_of(start, stop)).alias("_cell")).withColumns({"_level": F.col("_cell.level"), "_cell": F.col("_cell.cell")})
    levels = sorted(r[0] for r in listed.select("_level").distinct().collect())
    if not levels:
        return points.join(whole, by, "inner").where(F.lit(False)) if by else points.join(whole, F.lit(False))
    placed = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_cell", F.expr(f"shiftright(cast(`{at}` AS bigint), _level)"))
    return placed.join(listed.hint("merge"), [*by, "_level", "_cell"]).drop("_level", "_cell")


def interval_counts(points: DataFrame, ranges: DataFrame, at: str, start: str, stop: str, by: list[str], width: int, to: str) -> DataFrame:
    """``by``, start, stop and ``to``, the number of points, of each distinct range [start, stop) that holds any.

    Points and the bounds of ranges are one series, whose running count is made by blocks of ``width``: a range has the points
    before its stop less those before its start. No point meets a range, however many ranges hold it. Times are whole numbers;
    ``by`` names at least one column, and nulls match nothing.
    """
    here = lambda df, *cs: df.dropna(subset=[*by, *cs])
    low, high = F.col(start).cast("long").alias("_low"), F.col(stop).cast("long").alias("_high")
    counted = here(points, at).groupBy(*by, F.col(at).cast("long").alias("_at")).agg(F.count("*").alias("_n"))
    spans = here(ranges, start, stop).select(*by, low, high).where("_low < _high").distinct()
    bounds = spans.select("*", F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(k).cast("long").alias("sign")) for c, k in (("_low", -1), ("_high", 1))))).alias("_b"))
    bounds = bounds.select(*by, F.col("_b.at").alias("_at"), F.lit(0).cast("long").alias("_n"), "_low", "_high", F.col("_b.sign").alias("_sign"))
    line = counted.withColumns({"_low": F.lit(None).cast("long"), "_high": F.lit(None).cast("long"), "_sign": F.lit(0).cast("long")}).unionByName(bounds)
    # of equal times bounds, which count nothing, come first
    run = scan(line, by, ["_at", "_n"], width, {"_before": ("sum", F.col("_n"), False)}).where("_sign != 0")
    return run.groupBy(*by, F.col("_low").alias(start), F.col("_high").alias(stop)).agg(F.sum(F.col("_before") * F.col("_sign")).alias(to)).where(F.col(to) > 0)
