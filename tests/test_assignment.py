"""Fields and attributes are assigned as by a greedy loop."""

import random

from shelfwise.operators import feeds

SCHEMA = "source string, attr string, field string, scale double, share double, n long"


def greedy(rows):
    used, out = set(), []
    for r in sorted(rows, key=lambda r: (-r[4], -r[5], abs(r[3] - 1), r[1], r[2], r[3])):
        if (r[0], "attr", r[1]) not in used and (r[0], "field", r[2]) not in used:
            used |= {(r[0], "attr", r[1]), (r[0], "field", r[2])}
            out.append(r)
    return sorted(out)


def test_second_choice(spark):
    rows = [("s", "A", "f", 1.0, 0.9, 9), ("s", "B", "f", 1.0, 0.8, 9), ("s", "B", "g", 1.0, 0.7, 9), ("s", "C", "g", 1.0, 0.6, 9), ("s", "C", "h", 0.1, 0.5, 9)]
    got = sorted(map(tuple, feeds.assign_fields(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [(r[1], r[2]) for r in got] == [("A", "f"), ("B", "g"), ("C", "h")] and got == greedy(rows)
    assert feeds.assign_fields(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_tables(spark):
    rng = random.Random(2)
    rows = [(f"s{s}", f"a{a}", f"f{f}", scale, rng.choice((0.7, 0.8, 0.9)), rng.choice((5, 6))) for s in range(6) for a in range(6) for f in range(7) for scale in (1.0, 0.1) if rng.random() < 0.4]
    assert sorted(map(tuple, feeds.assign_fields(spark.createDataFrame(rows, SCHEMA)).collect())) == greedy(rows)
