"""Pairs of short texts that can reach a score, by an inverted index of the rarest grams with bounds on lengths and counts.

fuzzy.score() is a Python function, so it should see few pairs. grams of a text are the pairs of neighbouring signs within
its words (a word of one sign is its own gram), as a set: the order of words plays no part. One sign less costs a text at
most two of them, one sign more at most one. A ratio of R says how long the longest common subsequence is at least, and so
how many signs go and come, and how many grams two texts have in common at least. Of a text that must share c of its n
grams, any n - c + 1 meet the other's: the rarest are looked up. What meets is counted in full and held against the bound
of its own two lengths. Texts with a whole word in common are looked up by it, as word-wise comparison needs no more.

All is exact: no pair that reaches the score is lost. Texts so short that they need share nothing meet all others of
fitting length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import fuzzy
from shelfwise.sources import tables

# Fixed values of the score: its weights and bounds of length.
WORDS, PART, APART, FAR = 0.95, 0.9, 1.5, 8.0
_SLACK = 1e-9
#: Pairs of all blocks together up to which an index costs more than it saves.
FEW = 100_000


def words(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def grams(c: Column | str) -> Column:
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda k: F.substring(w, k, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(words(c), lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(pairs(w)))))


def _lost(length, ratio: float):
    """The most grams that a text of this length loses at that ratio, whatever the other's length."""
    return length * (4 * (1 - ratio) / (2 - ratio))


def _with_parts(rows: DataFrame, name: str) -> DataFrame:
    signs = F.array_distinct(F.split(F.replace(name, F.lit(" "), F.lit("")), ""))
    return rows.withColumns({f"{name}_words": words(name), f"{name}_grams": grams(name), f"{name}_signs": signs, f"{name}_length": F.length(name)})


def possible(rows: DataFrame, a: str, b: str, least: float) -> Column:
    """Of pairs with their parts: whether they can reach the score."""
    la, lb = F.col(f"{a}_length"), F.col(f"{b}_length")
    na, nb = F.size(f"{a}_grams"), F.size(f"{b}_grams")
    common = F.size(F.array_intersect(f"{a}_grams", f"{b}_grams"))
    short, long = F.least(la, lb), F.greatest(la, lb)
    apart = long / short
    gone, come = (F.size(F.array_except(f"{x}_signs", f"{y}_signs")) for x, y in ((a, b), (b, a)))  # signs that the other doesn't have at all

    def whole(one, two, ratio: float) -> Column:
        kept = F.ceil((one + two) * (ratio / 2) - _SLACK)  # of the common subsequence, at least
        need = F.greatest(na - (2 * one + two - 3 * kept), nb - (2 * two + one - 3 * kept))
        return (kept <= F.least(one, two)) & (gone <= one - kept) & (come <= two - kept) & (common >= need)

    ok = whole(la, lb, least / 100)
    part = least / (100 * PART)
    if part <= 1:
        n_short = F.when(la <= lb, na).otherwise(nb)
        n_either = F.when(la == lb, F.least(na, nb)).otherwise(n_short)
        missing = F.when(la < lb, gone).when(la > lb, come).otherwise(F.least(gone, come))
        ok |= (apart >= APART) & (apart <= FAR) & (missing <= short * ((2 - 2 * part) / (2 - part)) + _SLACK) & (common >= n_either - _lost(short, part) - 2 - _SLACK)
    both = F.array_intersect(f"{a}_words", f"{b}_words")
    length = lambda w: F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)) + F.size(w) - 1
    l0, l1, l2 = length(both), length(F.col(f"{a}_words")), length(F.col(f"{b}_words"))
    inside = F.size(both) == F.least(F.size(f"{a}_words"), F.size(f"{b}_words"))
    by_set = inside | (2 * l0 >= (l0 + F.least(l1, l2)) * (least / (100 * WORDS)) - _SLACK) | whole(l1, l2, least / (100 * WORDS))
    ok |= (F.size(both) > 0) & (((apart < APART) & by_set) | ((apart >= APART) & (apart <= FAR) & F.lit(least <= 100 * WORDS * PART)))
    return ok


def candidates(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float, few: int = FEW) -> DataFrame:
    """left (keys, a) and right (keys, b) → (keys, a, b), a superset of the pairs whose score is least at least. Blank texts have none. So few pairs as `few` in all are held against their bounds without the index."""
    ours = tables.written(_with_parts(left.select(*keys, a).where(F.col(a) != "").distinct(), a), "ours")
    theirs = tables.written(_with_parts(right.select(*keys, b).where(F.col(b) != "").distinct(), b), "theirs")
    sizes = (rows.groupBy(*keys).agg(F.count("*").alias(n)) for rows, n in ((ours, "__n"), (theirs, "__m")))
    if next(sizes).join(next(sizes), keys).agg(F.coalesce(F.sum(F.col("__n") * F.col("__m")), F.lit(0))).first()[0] <= few:
        pairs = ours.join(theirs, keys)
        return pairs.where(possible(pairs, a, b, least)).select(*keys, a, b)
    full, part = least / 100, min(1.0, least / (100 * PART))
    held = theirs.select(*keys, F.explode(f"{b}_grams").alias("__gram")).groupBy(*keys, "__gram").agg(F.count("*").alias("__held"))
    own = ours.select(*keys, F.explode(f"{a}_grams").alias("__gram")).groupBy(*keys, "__gram").agg(F.count("*").alias("__held"))

    def rarest(rows: DataFrame, name: str, lost: Column, counts: DataFrame) -> DataFrame:
        """The grams of which one at least is met: so many as may be lost, and one more."""
        long = rows.select(*keys, name, F.floor(lost + _SLACK).alias("__lost"), F.explode(f"{name}_grams").alias("__gram")).join(counts, [*keys, "__gram"], "left")
        w = Window.partitionBy(*keys, name).orderBy(F.coalesce("__held", F.lit(0)), "__gram")
        return long.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= F.col("__lost") + 1).where("__held is not null").select(*keys, name, "__gram")

    lost = lambda name: F.greatest(_lost(F.col(f"{name}_length"), full), _lost(F.col(f"{name}_length"), part) + 2)
    loose = lambda rows, name: rows.where(F.size(f"{name}_grams") <= lost(name)).select(*keys, name)
    of = lambda rows, name, what: rows.select(*keys, name, F.explode(f"{name}_{what}").alias("__gram"))
    met = [
        rarest(ours, a, lost(a), held).join(of(theirs, b, "grams"), [*keys, "__gram"]),
        rarest(theirs, b, lost(b), own).join(of(ours, a, "grams"), [*keys, "__gram"]),
        of(ours, a, "words").join(of(theirs, b, "words"), [*keys, "__gram"]),
        loose(ours, a).join(theirs.select(*keys, b), keys),
        ours.select(*keys, a).join(loose(theirs, b), keys),
    ]
    pairs = met[0].select(*keys, a, b)
    for more in met[1:]:
        pairs = pairs.unionByName(more.select(*keys, a, b))
    pairs = pairs.distinct().join(ours, [*keys, a]).join(theirs, [*keys, b])
    return pairs.where(possible(pairs, a, b, least)).select(*keys, a, b)


def scored(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float, few: int = FEW) -> DataFrame:
    """(keys, a, b, score) of the pairs that reach the score; each two texts are compared once."""
    pairs = candidates(left, right, keys, a, b, least, few)
    names = pairs.select(a, b).distinct().withColumn("score", fuzzy.score(a, b)).where(F.col("score") >= least)
    return pairs.join(names, [a, b])
