"""Percentiles by selection equal percentile()."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import detect, quantiles

PS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


def values(spark):
    rng = random.Random(3)
    groups = {
        "even": [rng.uniform(-5, 5) for _ in range(1500)],
        "far": [rng.gauss(0, 1) for _ in range(700)] + [1.7e308, -1.7e308, 1e-300, 0.0, -0.0],
        "ties": [float(rng.randint(0, 3)) for _ in range(900)],
        "same": [7.5] * 800,
        "steep": [10.0 ** rng.uniform(-200, 200) for _ in range(900)],
        "one": [3.0],
        "two": [1.0, 2.0],
        "odd": [None, float("nan"), 4.0, 9.0],
        "none": [None, float("nan")],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, num double").repartition(3)


@pytest.mark.parametrize(("leaf", "bins"), [(40, 64), (quantiles.LEAF, quantiles.BINS)])
def test_selection_equals_percentile(spark, leaf, bins):
    rows = values(spark)
    got = {r.g: (r.n, list(r.p)) for r in quantiles.percentiles(rows, ["g"], "num", PS, leaf, bins).collect()}
    want = rows.where("num is not null and not isnan(num)").groupBy("g").agg(F.count("*").alias("n"), F.percentile("num", F.array(*map(F.lit, PS))).alias("p"))
    assert got == {r.g: (r.n, list(r.p)) for r in want.collect()} and "none" not in got
    assert quantiles.percentiles(rows.limit(0), ["g"], "num", PS).count() == 0


def test_ranges_of_large_and_small_groups(spark, monkeypatch):
    rows = values(spark).where("g in ('even', 'ties', 'same', 'odd')").select(F.lit("c").alias("category"), F.col("g").alias("attr"), "num")
    whole = sorted(map(tuple, detect.learn_ranges(rows).collect()))
    groups, large = quantiles.of_groups, quantiles.large_groups
    monkeypatch.setattr(quantiles, "of_groups", lambda v, keys, num, ps, found: groups(v, keys, num, ps, found, 850))
    monkeypatch.setattr(quantiles, "large_groups", lambda v, keys, num: large(v, keys, num, 850))
    assert sorted(map(tuple, detect.learn_ranges(rows).collect())) == whole and len(whole) == 3
