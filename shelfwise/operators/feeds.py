"""Supplier feeds in long form (source, rec, field, value): profiles, keys, mapping, units, matching, consensus, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import findings as f
from shelfwise.operators import similar
from shelfwise.sources import tables

# Tolerances, scales and bounds.
TOLERANCE, WEIGHT_TOLERANCE, WEIGHT = 0.03, 0.10, "Waga"
SCALES = {"Szerokość": (1.0, 0.1, 100.0), "Wysokość": (1.0, 0.1, 100.0), "Głębokość": (1.0, 0.1, 100.0), "Waga": (1.0, 0.001)}
VALUE_UNITS = {"mm": 0.1, "m": 100.0, "g": 0.001}
LEAST_PAIRS, LEAST_SHARE = 5, 0.5
SCORE, MARGIN = 88.0, 6.0
BASE = {"L4-UZUPELNIA": 0.80, "L4-ROZJAZD": 0.82}
BY_NAME_MOST, MORE, MOST = 0.55, 0.05, 0.95


def profile(long: DataFrame, examples: int = 3) -> DataFrame:
    """Of each (source, field): fill rate, distinct values, numeric share, and a few short examples."""
    size = long.groupBy("source").agg(F.countDistinct("rec").alias("records"))
    full = long.where(F.trim("value") != "")
    numeric = F.avg(text.number(F.col("value")).isNotNull().cast("int"))
    own = full.groupBy("source", "field").agg(F.countDistinct("rec").alias("n"), numeric.alias("numeric"), F.countDistinct("value").alias("kinds"))
    w = Window.partitionBy("source", "field").orderBy("value")
    some = full.select("source", "field", F.substring("value", 1, 60).alias("value")).distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= examples)
    shown = some.groupBy("source", "field").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return own.join(size, "source").join(shown, ["source", "field"]).select("source", "field", F.round(F.col("n") / F.col("records"), 3).alias("fill"), (F.col("numeric") > 0.8).alias("numeric"), "kinds", "examples")


def guess_key(long: DataFrame, keys: DataFrame, least_fill: float = 0.5) -> DataFrame:
    """(source, field, hits): the field whose normalised values hit most distinct keys (key)."""
    size = long.groupBy("source").agg(F.countDistinct("rec").alias("records"))
    rows = long.where(F.trim("value") != "").withColumn("key", text.norm(F.col("value")))
    full = rows.groupBy("source", "field").agg(F.countDistinct("rec").alias("n")).join(size, "source").where(F.col("n") >= least_fill * F.col("records"))
    hits = rows.join(keys.select("key").distinct(), "key", "left_semi").groupBy("source", "field").agg(F.countDistinct("key").alias("hits"))
    return full.join(hits, ["source", "field"]).groupBy("source").agg(F.max_by("field", F.struct("hits", F.col("field"))).alias("field"), F.max("hits").alias("hits"))


def guess_mapping(profiles: DataFrame, words: DataFrame) -> DataFrame:
    """words (target, target_rank, word, word_rank, numeric): a field for each target, none used twice.

    A field belongs to the first target that wants it, and that target takes its best word's field.
    """
    near = profiles.join(F.broadcast(words.withColumnRenamed("numeric", "must")), F.col("field").isNotNull() & F.expr("contains(lower(field), word)")).where((~F.col("must") | F.col("numeric")) & ~text.is_package(F.col("field")))
    mine = Window.partitionBy("source", "field").orderBy("target_rank", "word_rank")
    once = near.withColumn("k", F.row_number().over(mine)).where("k = 1")
    best = Window.partitionBy("source", "target").orderBy("word_rank", F.desc("fill"), "field")
    return once.withColumn("j", F.row_number().over(best)).where("j = 1").select("source", "target", "field")


def load(long: DataFrame, mapping: DataFrame, key_fields: DataFrame, name: str = "nazwa") -> DataFrame:
    """(source, key, mapped map, raw map): mapped fields of each record; the last record of a key counts; without key none. A source without a key field takes the field that is mapped to the name."""
    named = mapping.where(F.col("target") == name).select("source", "field").join(key_fields.select("source").distinct(), "source", "left_anti")
    fields = key_fields.select("source", "field").unionByName(named)
    key = long.join(fields, ["source", "field"]).select("source", "rec", text.norm(F.col("value")).alias("key")).where("key <> ''").groupBy("source", "rec").agg(F.min("key").alias("key"))
    last = key.groupBy("source", "key").agg(F.max("rec").alias("rec"))
    own = long.join(last, ["source", "rec"]).join(mapping, ["source", "field"], "left")
    return own.groupBy("source", "key").agg(F.map_from_entries(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "value")))).alias("mapped"), F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("raw"))


def allowed_scales(attr) -> Column:
    """The factors that an attribute's values may need, the likeliest first; others are taken as they are."""
    return F.coalesce(*(F.when(attr == a, F.array(*map(F.lit, scales))) for a, scales in SCALES.items()), F.array(F.lit(1.0)))


def scales(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """pairs (source, attr, theirs, ours) → the factor that agrees most often, of those its attribute allows and in their order on a tie; from LEAST_PAIRS pairs and LEAST_SHARE on."""
    tries = pairs.where("ours <> 0").withColumn("scale", F.explode(allowed_scales(F.col("attr"))))
    share = tries.groupBy("source", "attr", "scale").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("theirs") * F.col("scale") - F.col("ours")) / F.abs("ours") <= tolerance).cast("double")).alias("share"))
    rank = -F.array_position(allowed_scales(F.col("attr")), F.col("scale"))
    return share.where((F.col("n") >= LEAST_PAIRS) & (F.col("share") >= LEAST_SHARE)).groupBy("source", "attr").agg(F.max_by("scale", F.struct("share", rank)).alias("scale"), F.max("share").alias("share"))


def rescaled(items: DataFrame, factors: DataFrame) -> DataFrame:
    """items (source, key, attr, num) in our units."""
    return items.join(F.broadcast(factors.select("source", "attr", "scale")), ["source", "attr"], "left").withColumn("num", F.col("num") * F.coalesce("scale", F.lit(1.0))).drop("scale")


def of_makers(found: DataFrame, products: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Matches (source, id, …) without those of a source that is one producer's, with products of another. sources: (source, producer), null for any."""
    if sources is None:
        return found
    own = sources.where(F.coalesce("producer", F.lit("")) != "").groupBy("source").agg(F.min("producer").alias("__maker"))
    made = products.select("id", F.col("producer").alias("__made"))
    return found.join(own, "source", "left").join(made, "id", "left").where(F.col("__maker").isNull() | (F.col("__maker") == F.col("__made"))).select(*found.columns)


def match_by_code(keys: DataFrame, items: DataFrame, products: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """keys (id, key) ⋈ items (source, key): (source, id, key), the smallest key on several. With products (id, producer) and sources, only products of a source's producer."""
    met = of_makers(keys.join(items.select("source", "key").distinct(), "key"), products, sources)
    return met.groupBy("source", "id").agg(F.min("key").alias("key")).withColumn("method", F.lit("kod"))


def match_by_name(products: DataFrame, items: DataFrame, least: float = SCORE, margin: float = MARGIN, sources: DataFrame | None = None) -> DataFrame:
    """Best name within a block of producer and collection, clear of the second best. Names that can't come within the margin of the least score are not compared."""
    ours = products.select("id", F.col("producer").alias("p"), text.norm(F.col("collection")).alias("c"), text.comparable_name(F.col("name"), F.col("collection")).alias("a"))
    theirs = items.select("source", "key", F.col("producer").alias("p"), text.norm(F.col("collection")).alias("c"), text.comparable_name(F.col("name"), F.col("collection")).alias("b"))
    names = similar.scored(ours, theirs, ["p", "c"], "a", "b", least - margin)
    pairs = names.join(theirs.select("source", "p", "c", "b").distinct(), ["p", "c", "b"])
    w = Window.partitionBy("source", "p", "c", "a").orderBy(F.desc("score"), "b")
    ranked = pairs.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    top = ranked.where((F.col("k") == 1) & (F.col("score") >= least) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin)))
    alone = theirs.groupBy("source", "p", "c", "b").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    found = ours.join(top.select("source", "p", "c", "a", "b"), ["p", "c", "a"]).join(alone, ["source", "p", "c", "b"]).select("source", "id", "key", F.lit("nazwa").alias("method"))
    return of_makers(found, products, sources)


def match_all(products: DataFrame, keys: DataFrame, items: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Codes first, then names of what codes left, for each source; sources (source, producer) may be limited to a producer."""
    coded = match_by_code(keys, items, products, sources)
    named = match_by_name(products, items, sources=sources).join(coded.select("source", "id"), ["source", "id"], "left_anti")
    return coded.unionByName(named)


def match_report(matches: DataFrame) -> DataFrame:
    part = lambda c: matches.groupBy(F.lit(c).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return part("method").unionByName(part("source"))


def consensus(votes: DataFrame) -> DataFrame:
    """votes (id, attr, source, num, method): one vote a source; the median, whether all lie within tolerance, and who said what."""
    one = votes.where("num > 0").groupBy("id", "attr", "source").agg(F.min("num").alias("num"), F.min("method").alias("method"))
    middle = one.groupBy("id", "attr").agg(F.median("num").alias("middle"))
    tol = F.when(F.col("attr") == WEIGHT, WEIGHT_TOLERANCE).otherwise(TOLERANCE)
    near = F.abs(F.col("num") - F.col("middle")) <= tol * F.col("middle")
    return one.join(middle, ["id", "attr"]).groupBy("id", "attr", "middle").agg(F.count("*").alias("sources"), F.bool_and(near).alias("agreed"), F.bool_and(F.col("method") == "nazwa").alias("by_name"), F.array_sort(F.collect_list(F.struct("source", "num"))).alias("said"))


def compare(agreed: DataFrame, nums: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(L4 findings, conflicts). A disagreement among sources, or with us by a factor of ten, is a conflict."""
    rows = agreed.join(nums.select("id", "attr", "num"), ["id", "attr"], "left").join(raw.select("id", "attr").distinct().withColumn("present", F.lit(True)), ["id", "attr"], "left")
    tol = F.when(F.col("attr") == WEIGHT, WEIGHT_TOLERANCE).otherwise(TOLERANCE)
    off = F.col("num").isNotNull() & (F.abs(F.col("num") - F.col("middle")) > tol * F.col("middle"))
    units = off & text.unit_factor(F.col("num"), F.col("middle"), tol)
    case = F.when(~F.col("agreed"), "zrodla").when(units, "jednostki").when(off, "L4-ROZJAZD").when(F.col("num").isNull() & F.col("present").isNull(), "L4-UZUPELNIA")
    rows = rows.withColumn("case", case).where("case is not null")
    sure = F.least(F.lit(MOST), F.when(F.col("case") == "L4-ROZJAZD", BASE["L4-ROZJAZD"]).otherwise(BASE["L4-UZUPELNIA"]) + MORE * (F.col("sources") - 1))
    sure = F.round(F.when(F.col("by_name"), F.least(F.lit(BY_NAME_MOST), sure)).otherwise(sure), 4)
    out = f.emit(rows.where("case like 'L4-%'"), F.col("case"), "L4", F.when(F.col("case") == "L4-ROZJAZD", f.CRITICAL).otherwise(f.MIDDLE), sure, old=text.number_text(F.col("num")), new=text.number_text(F.col("middle")), evidence="feeds")
    return out, rows.where("case in ('zrodla', 'jednostki')").select("id", "attr", F.col("num").alias("ours"), "said", F.col("case").alias("reason"))


def append(found: DataFrame, new: DataFrame) -> DataFrame:
    """The run's findings with layer 4; gaps of cells that a feed fills go."""
    filled = new.where("old_value is null").select("id", "attr").distinct()
    gap = F.col("rule_id").startswith("L2-LUKA-") | (F.col("rule_id") == "L1-LUKA-BRAK")
    kept = found.where(~gap).unionByName(found.where(gap).join(filled, ["id", "attr"], "left_anti").select(*found.columns))
    return kept.unionByName(new)


def conflict_pairs(conflicts: DataFrame, top: int = 10) -> DataFrame:
    """The groups of sources that disagree most often."""
    return conflicts.where("reason = 'zrodla'").groupBy(F.array_join(F.array_sort(F.transform("said", lambda s: s["source"])), " + ").alias("sources")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sources").limit(top)


def recognise(long: DataFrame, index: DataFrame, products: DataFrame, least_fill: float = 0.3) -> DataFrame:
    """Of each tab: the field that hits most distinct products of index (key, id), their commonest producer and its share."""
    size = long.groupBy("source").agg(F.countDistinct("rec").alias("records"))
    rows = long.where(F.trim("value") != "").withColumn("key", text.norm(F.col("value")))
    full = rows.groupBy("source", "field").agg(F.countDistinct("rec").alias("n")).join(size, "source").where(F.col("n") >= least_fill * F.col("records")).select("source", "field")
    hit = rows.join(full, ["source", "field"]).join(index, "key").select("source", "field", "id").distinct()
    best = hit.groupBy("source", "field").agg(F.count("*").alias("hits")).groupBy("source").agg(F.max_by("field", F.struct("hits", "field")).alias("field"), F.max("hits").alias("hits"))
    makers = hit.join(best.select("source", "field"), ["source", "field"]).join(products.select("id", "producer"), "id").groupBy("source", "producer").agg(F.count("*").alias("n"))
    first = makers.groupBy("source").agg(F.max_by("producer", F.struct("n", "producer")).alias("producer"), F.max("n").alias("most"))
    return best.join(first, "source").select("source", "field", "hits", "producer", F.round(F.col("most") / F.col("hits"), 3).alias("share"), (F.col("most") / F.col("hits") < 0.9).alias("warning"))


def numeric_fields(long: DataFrame, matches: DataFrame, key_rec: DataFrame, nums: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, attr, field, scale, share, n): how well each numeric field is each attribute, at each scale."""
    theirs = long.where(~text.is_package(F.col("field"))).withColumn("x", text.number(F.col("value"))).where("x is not null").select("source", "rec", "field", "x")
    own = theirs.join(key_rec, ["source", "rec"]).join(matches.select("source", "key", "id"), ["source", "key"]).join(nums.select("id", "attr", "num"), "id").where("num <> 0")
    tries = own.withColumn("scale", F.explode(allowed_scales(F.col("attr"))))
    out = tries.groupBy("source", "attr", "field", "scale").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("x") * F.col("scale") - F.col("num")) / F.abs("num") <= tolerance).cast("double")).alias("share"))
    return out.where((F.col("n") >= LEAST_PAIRS) & (F.col("share") >= LEAST_SHARE))


def assign_fields(candidates: DataFrame) -> DataFrame:
    """(source, attr, field, scale, share, n): the greedy assignment, the best pair first, each attribute and field once.

    A pair that is the best of both its ends is in the greedy assignment whatever else is; so each round takes all such pairs,
    of all sources at once, and leaves out what they use, until no candidate is left. An attribute whose first field is
    taken gets its second. Ties go by attribute, field and scale, so the order is total.
    """
    order = [F.desc("share"), F.desc("n"), F.abs(F.col("scale") - 1), "attr", "field", "scale"]
    a, b = Window.partitionBy("source", "attr").orderBy(*order), Window.partitionBy("source", "field").orderBy(*order)
    left, taken = tables.written(candidates.select("source", "attr", "field", "scale", "share", "n"), "fields"), None
    while taken is None or not left.isEmpty():
        best = left.withColumn("ka", F.row_number().over(a)).withColumn("kb", F.row_number().over(b)).where("ka = 1 and kb = 1").drop("ka", "kb")
        best = tables.written(best, "assigned")
        taken = best if taken is None else taken.unionByName(best)
        left = tables.written(left.join(best.select("source", "attr"), ["source", "attr"], "left_anti").join(best.select("source", "field"), ["source", "field"], "left_anti").select(*left.columns), "fields")
    return taken


def recommended(tabs: DataFrame, mapped: DataFrame, least: int = 5) -> DataFrame:
    return tabs.where(F.col("hits") >= least).join(mapped.select("source").distinct(), "source", "left_semi")


def producer_of_tab(tabs: DataFrame, producers: DataFrame) -> DataFrame:
    """tabs (tab) → the shortest producer (producer) whose name, without spaces, starts the tab's core, or the other way round; cores under three signs don't count."""
    core = tabs.withColumn("core", text.producer_core(F.col("tab"))).where(F.length("core") >= 3)
    known = producers.select("producer", F.replace(text.norm(F.col("producer")), F.lit(" "), F.lit("")).alias("p")).distinct().where("p <> ''")
    starts = lambda whole, k: F.substring(whole, 1, k)
    short, long = known.where(F.length("p") < 3), known.where(F.length("p") >= 3)
    near = core.join(long, starts("core", 3) == starts("p", 3)).where(F.expr("startswith(core, p) or startswith(p, core)"))
    for k in (1, 2):  # names shorter than the block
        near = near.unionByName(core.join(short.where(F.length("p") == k), starts("core", k) == F.col("p")))
    best = near.groupBy("tab").agg(F.min_by("producer", F.struct(F.length("p"), F.col("producer"))).alias("producer"))
    return tabs.join(best, "tab", "left")


def scale_hints(long: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping (source, field, target) → (source, field, target, scale): what a field's name says, else the unit that most of its values end in; only factors that the target allows."""
    unit = F.lower(F.regexp_extract("value", r"(?i)\d\s*([a-z]+)\s*$", 1))
    own = long.groupBy("source", "field", unit.alias("unit")).agg(F.count("*").alias("n"))
    said = own.where("unit <> ''").groupBy("source", "field").agg(F.max_by("unit", F.struct("n", "unit")).alias("unit"), F.max("n").alias("n"))
    most = own.groupBy("source", "field").agg(F.sum("n").alias("of")).join(said, ["source", "field"], "left")
    allowed = allowed_scales(F.col("target"))
    suffix = F.coalesce(*(F.when((F.col("n") * 2 > F.col("of")) & (F.col("unit") == u) & F.array_contains(allowed, F.lit(x)), F.lit(x)) for u, x in VALUE_UNITS.items()))
    hinted = mapping.join(most, ["source", "field"]).where(F.col("target").isin(*SCALES))
    return hinted.select("source", "field", "target", F.coalesce(text.scale_from_field(F.col("field"), allowed), suffix).alias("scale"))
