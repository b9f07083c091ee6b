"""Segmented scans: what needs the rows before it within a chain, without one task that sees the whole chain.

Heights (or arrival numbers) are cut into ranges of about equal size, from approximate quantiles of the rows and even steps between
them. Each range of each chain is summarised (its last row, its largest values), which combines on the map side; a window over the
summaries alone, a row for each range of a chain, carries them forward; and what is carried into a range is put in front of its rows as
one row more. A window over the range then sees all that it needs, so the rows are shuffled once, by range, and a task holds some
ranges however long a chain is. No summary is collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles that the rows are cut at, and even steps between two of them.
CUTS, STEPS = 64, 32
RANGE, SEED = "_range", "_seed"


def _stretch(value: Column, cuts: list[int], low: int, high: int) -> Column:
    """The stretch between two cuts that holds a value, by halving: (its number, where it begins, the width of a step)."""
    if high - low == 1:
        return F.struct(F.lit(low).alias("i"), F.lit(cuts[low]).cast("long").alias("at"), F.lit(max(1, -(-(cuts[high] - cuts[low]) // STEPS))).cast("long").alias("step"))
    mid = (low + high) // 2
    return F.when(value < cuts[mid], _stretch(value, cuts, low, mid)).otherwise(_stretch(value, cuts, mid, high))


def with_ranges(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``_range``: rising with the integer column ``order``, rows that are alike in it in one range."""
    found = rows.agg(F.percentile_approx(F.col(order).cast("long"), [i / CUTS for i in range(CUTS + 1)], 20 * CUTS), F.min(order), F.max(order)).first()
    cuts = sorted({int(found[1]), *map(int, found[0])}) if found[0] else [0]
    cuts.append(max(int(found[2] or 0), cuts[-1]) + 1)
    value = F.col(order).cast("long")
    at = _stretch(value, cuts, 0, len(cuts) - 1)
    step = F.least(F.lit(STEPS - 1), F.greatest(F.lit(0), F.floor((value - at["at"]) / at["step"])))
    return rows.withColumn(RANGE, F.when(value.isNull(), -1).otherwise(at["i"] * STEPS + step).cast("long"))


def carried(rows: DataFrame, keys: list[str], order: list[str], last: list[str] = (), most: dict[str, Column] | None = None) -> tuple[DataFrame, Window]:
    """Rows with what comes before their range, and the window to look at them through.

    In front of a range that isn't its chain's first stands a row with ``_seed`` true, which has the columns ``last`` of the row before
    the range, and for each of ``most`` the largest value of that expression before the range (``rows`` have the expression's value).
    Leave these rows out by ``~_seed`` once the window has been taken. ``order`` begins with an integer column.
    """
    most = most or {}
    ranged = with_ranges(rows, order[0])
    for name, value in most.items():
        ranged = ranged.withColumn(name, value)
    sums = [F.max_by(F.struct(*last), F.struct(*order)).alias("_last")] if last else []
    sums += [F.max(name).alias(name) for name in most]
    ranges = ranged.groupBy(*keys, RANGE).agg(*sums)
    w = Window.partitionBy(*keys).orderBy(RANGE)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seeds = ranges.select(*keys, RANGE, F.lag(RANGE).over(w).isNotNull().alias("_any"), *([F.lag("_last").over(w).alias("_last")] if last else []), *[F.max(name).over(before).alias(name) for name in most]).filter("_any")
    own = {f.name: f.dataType for f in ranged.schema.fields}
    given = set(keys) | {RANGE} | set(most)
    seeds = seeds.select(*[F.col(c) if c in given else F.col(f"_last.{c}").alias(c) if c in last else F.lit(None).cast(t).alias(c) for c, t in own.items()], F.lit(True).alias(SEED))
    both = ranged.withColumn(SEED, F.lit(False)).unionByName(seeds).repartitionByRange(*keys, RANGE)
    return both, Window.partitionBy(*keys, RANGE).orderBy(F.desc(SEED), *order)


def uncarried(rows: DataFrame, *more: str) -> DataFrame:
    """The rows themselves, without the scan's own columns."""
    return rows.filter(~F.col(SEED)).drop(SEED, RANGE, *more)
