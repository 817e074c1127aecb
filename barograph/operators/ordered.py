"""Scans of ordered series by many tasks: carries over blocks, rolling frames with a halo, order statistics.

A series is cut into blocks of its order (so much time, so many positions). Windows run inside of a block; what a
block needs of those before it is a small summary, a row a block. Summaries are carried on over all blocks of a series
where time bounds their number, or else in two levels, over stretches of FAN blocks and over stretches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barograph.sources.shared import written

#: Blocks of a stretch.
FAN = 1024
BLOCK = "_block"


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join on keys, of which nulls are equal, too; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*(f"_right_{k}" for k in keys))


#: By kind of carry: the summary of rows in order, the window aggregate, and a carry put before another.
KINDS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (lambda v, at: F.sum(v), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (lambda v, at: F.max(v), F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def scan(rows: DataFrame, by: list[str], order: list[str], width: int, wanted: dict[str, tuple[str, Column, bool]], levels: int = 2) -> DataFrame:
    """``rows`` with running values and their block, ``_block``.

    ``wanted``: {name: (kind, value, with the row itself)}; kinds are sum, max and last (the last value that isn't null). Rows are taken in
    ``order`` within ``by``, of which nulls are a group; a block is ``width`` of the first order column, a whole number. Equal rows are taken
    in any order. A sum before the first row is 0, the others null. With one of ``levels`` a task lines up a row for each block of a series:
    enough for blocks of an hour (9,000 a year). With two it is a row for each of FAN blocks.
    """
    held = {f"_v_{n}": v for n, (_, v, _) in wanted.items()}
    marked = rows.withColumns({BLOCK: F.floor(F.col(order[0]) / F.lit(width)), **held})
    stretch = F.floor(F.col(BLOCK) / F.lit(FAN)).alias("_stretch")
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])

    def summed(df: DataFrame, keys: list, place: Column, of: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[KINDS[k][0](F.col(f"{of}{n}"), place).alias(f"_s_{n}") for n, (k, _, _) in wanted.items()])

    def before(df: DataFrame, keys: list[str], place: str, to: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"{to}{n}": KINDS[k][1](F.col(f"_s_{n}")).over(w) for n, (k, _, _) in wanted.items()})

    w = Window.partitionBy(*by, BLOCK).orderBy(*order)
    own = {f"_o_{n}": KINDS[k][1](F.col(f"_v_{n}")).over(w.rowsBetween(Window.unboundedPreceding, 0 if self_too else -1)) for n, (k, _, self_too) in wanted.items()}
    added = [KINDS[k][2](F.col(f"_c_{n}"), F.col(f"_o_{n}")).alias(n) for n, (k, _, _) in wanted.items()]
    if levels == 1:
        carried = before(summed(marked, [*by, BLOCK], at, "_v_"), by, BLOCK, "_c_").select(*by, BLOCK, *(f"_c_{n}" for n in wanted))
        return same(marked.withColumns(own), carried, [*by, BLOCK]).select(*rows.columns, BLOCK, *added)
    blocks = summed(marked, [*by, BLOCK], at, "_v_").withColumn("_stretch", stretch)
    tops = before(summed(blocks, [*by, "_stretch"], F.col(BLOCK), "_s_"), by, "_stretch", "_t_")  # a row for each stretch
    tops = tops.select(*by, "_stretch", *(f"_t_{n}" for n in wanted))
    inner = before(blocks, [*by, "_stretch"], BLOCK, "_i_").select(*by, BLOCK, "_stretch", *(f"_i_{n}" for n in wanted))
    carried = same(inner, tops, [*by, "_stretch"])
    carried = carried.select(*by, BLOCK, *(KINDS[k][2](F.col(f"_t_{n}"), F.col(f"_i_{n}")).alias(f"_c_{n}") for n, (k, _, _) in wanted.items()))
    return same(marked.withColumns(own), carried, [*by, BLOCK]).select(*rows.columns, BLOCK, *added)


def rolling(rows: DataFrame, by: list[str], i: str, n: int, wanted: dict[str, Callable[[WindowSpec], Column]], block: int = 4096) -> DataFrame:
    """``rows`` with window values whose frames reach back over at most ``n`` rows, the row itself included.

    ``i`` counts 0, 1, ... within ``by``. Each block of ``block`` positions is given the n - 1 rows before it; a longer frame takes rows of
    several blocks. ``wanted``: {name: function of the window}, ordered by ``i``.
    """
    own = F.floor(F.col(i) / F.lit(block))
    copies = rows.withColumns({"_own": own, BLOCK: F.explode(F.sequence(own, F.floor((F.col(i) + (n - 1)) / F.lit(block))))})
    w = Window.partitionBy(*by, BLOCK).orderBy(i)
    return copies.withColumns({name: f(w) for name, f in wanted.items()}).where(F.col("_own") == F.col(BLOCK)).select(*rows.columns, *wanted)


def largest(rows: DataFrame, by: list[str], value: Column, k: int) -> DataFrame:
    """``by`` and ``top``, the k largest values in falling order, of rows that have a block (from ``scan``). Nulls don't count."""
    top = lambda lists: F.slice(F.sort_array(lists, asc=False), 1, k).alias("top")
    of_block = rows.select(*by, BLOCK, value.alias("_x")).where("_x is not null").groupBy(*by, BLOCK).agg(top(F.collect_list("_x")))
    of_stretch = of_block.groupBy(*by, F.floor(F.col(BLOCK) / F.lit(FAN)).alias("_stretch")).agg(top(F.flatten(F.collect_list("top"))))
    return of_stretch.groupBy(*by).agg(top(F.flatten(F.collect_list("top"))))


def most_frequent(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``by``, value and n of the most frequent value, the smallest of ties. Values are counted before they meet."""
    counts = rows.select(*by, value.alias("_x")).where("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by("_x", F.struct("n", (-F.col("_x")).alias("least"))).alias("value"), F.max("n").alias("n"))


def percentiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """``by`` and exact percentiles {name: share}, between neighbours by linear interpolation; nulls don't count, and groups without values are missing.

    Distinct values are counted, and the counts are sorted over range partitions. Sums by partition tell which ones hold the
    wanted ranks; only in those are values lined up.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.select(*by, value.alias("_x")).where("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    dealt = written(counts.repartitionByRange(parts, *by, "_x").withColumn("_part", F.spark_partition_id()), "value-counts")
    ends = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))  # at most a row for each partition
    group, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_total"), F.col("_n").alias("_here"))
    place = {name: (F.col("_total") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    ranks = F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)])
    ends = ends.where(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_here")))).drop("_here")
    near = same(dealt, ends, [*by, "_part"])
    reach = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_reach", reach)
    at = lambda r: F.max(F.when((r >= F.col("_reach") - F.col("_n")) & (r < F.col("_reach")), F.col("_x")))
    picked = near.groupBy(*by).agg(*[at(f(p)).alias(f"_{s}_{name}") for name, p in place.items() for s, f in (("low", F.floor), ("high", F.ceil))], F.max("_total").alias("_total"))
    part = {name: p - F.floor(p) for name, p in place.items()}
    return picked.select(*by, *((F.col(f"_low_{name}") * (1 - part[name]) + F.col(f"_high_{name}") * part[name]).alias(name) for name in wanted))
