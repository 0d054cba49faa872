"""Exact percentiles by selection: counts in bins, refined until the bin of each wanted rank is small.

A group's values are never in one place. Every pass counts all values of the intervals still wanted in BINS bins each, with
the least and largest value of each bin; partial counts are made before the shuffle, so a group of all rows sends BINS rows
a task. The bin that holds a wanted rank is its next interval, from its own least to its largest value, so each pass leaves
at least one value out, and as a rule all but one in BINS; a few passes do, whatever the values' spread. What is left of a rank's interval, LEAF values at most, is sorted.

Defined results: nulls and NaN take no part; a group without other values has no row; equal values count each; positions
between two values are interpolated, as percentile() does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources import tables

BINS, LEAF = 1024, 1 << 14
#: From this ratio of an interval's ends on, its bins are equal in logarithms.
WIDE = 1000.0


def _bin(x: Column, bins: int) -> Column:
    """The bin of a value between low and high: by sign where they differ in it, by logarithms where they are far apart, else of equal width. The order of bins is that of values, and low and high are in different ones."""
    low, high = F.col("low"), F.col("high")
    near, far = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
    logs = (F.log(F.abs(x)) - F.log(near)) / (F.log(far) - F.log(near))
    place = F.when(far / near > WIDE, F.when(low > 0, logs).otherwise(1 - logs)).otherwise((x - low) / (high - low))
    of_place = F.least(F.floor(place * bins), F.lit(bins - 1))
    return F.when((low <= 0) & (high >= 0), F.signum(x).cast("long")).otherwise(of_place)


def percentiles(values: DataFrame, keys: list[str], num: str, ps: list[float], leaf: int = LEAF, bins: int = BINS) -> DataFrame:
    """values (keys, num) → (keys, n, p): p has a value for each of ps, in their order."""
    rows = values.select(*keys, F.col(num).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    sizes = tables.written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")), "sizes")
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in ps))))
    ranks = sizes.select(*keys, F.explode(wanted).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    done = None
    while True:
        ranks = tables.written(ranks, "ranks")
        small = (F.col("low") == F.col("high")) | (F.col("inside") <= leaf)
        done = ranks.where(small) if done is None else done.unionByName(ranks.where(small))
        wide = ranks.where(~small)
        if wide.isEmpty():
            break
        spans = wide.select(*keys, "low", "high").distinct()
        held = rows.join(spans, keys).where((F.col("__x") >= F.col("low")) & (F.col("__x") <= F.col("high")))
        counts = held.groupBy(*keys, "low", "high", _bin(F.col("__x"), bins).alias("bin")).agg(F.count("*").alias("held"), F.min("__x").alias("from"), F.max("__x").alias("to"))
        order = Window.partitionBy(*keys, "low", "high").orderBy("bin")
        counts = counts.withColumn("before", F.sum("held").over(order) - F.col("held"))
        met = wide.join(counts, [*keys, "low", "high"]).where((F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("held")))
        ranks = met.select(*keys, "rank", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("held").alias("inside"))
    done = tables.written(done, "selected")
    single = done.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
    spans = done.where("low < high").select(*keys, "low", "high", "below").distinct()
    inside = rows.join(spans, keys).where((F.col("__x") >= F.col("low")) & (F.col("__x") <= F.col("high")))
    inside = inside.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "low", "high").orderBy("__x")) - 1 + F.col("below"))
    several = inside.join(done.where("low < high").select(*keys, "low", "high", "rank"), [*keys, "low", "high", "rank"]).select(*keys, "rank", F.col("__x").alias("value"))
    found = single.unionByName(several).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def at(p: float):
        place = (F.col("n") - 1) * p
        one, two = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        return F.when(one == two, one).otherwise((F.ceil(place) - place) * one + (place - F.floor(place)) * two)

    return found.join(sizes, keys).select(*keys, "n", F.array(*(at(p) for p in ps)).alias("p"))


def large_groups(values: DataFrame, keys: list[str], num: str, leaf: int = LEAF) -> DataFrame | None:
    """The keys of groups of more than leaf values; None if there are none."""
    found = values.where(F.col(num).isNotNull() & ~F.isnan(F.col(num).cast("double"))).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > leaf).select(*keys)
    found = tables.written(found, "large")
    return None if found.isEmpty() else found


def of_groups(values: DataFrame, keys: list[str], num: str, ps: list[float], large: DataFrame | None, leaf: int = LEAF) -> DataFrame:
    """The same, by selection for the large groups, and by one aggregation for all others, which fit in memory."""
    rows = values.select(*keys, F.col(num).cast("double").alias(num)).where(F.col(num).isNotNull() & ~F.isnan(num))
    one = lambda some: some.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(num, F.array(*map(F.lit, ps))).alias("p"))
    if large is None:
        return one(rows)
    return one(rows.join(large, keys, "left_anti")).unionByName(percentiles(rows.join(large, keys, "left_semi"), keys, num, ps, leaf))
