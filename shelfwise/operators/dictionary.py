"""Normalisation of attribute cells against a dictionary.

cells: (id, attr, value); kinds: (attr, kind of liczba | enum | multi_enum | bool | tekst); dictionary: (attr, pos,
label); aliases: (attr, alias, label). The last three are small rule tables. Values repeat thousands of times, so
matching is done once for each distinct (attr, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import findings as f
from shelfwise.operators import similar
from shelfwise.sources import tables

#: Scores from which a fuzzy match is taken over, or suggested.
AUTO, SUGGEST = 92, 78


def renamed(cells: DataFrame, attrs: DataFrame, values: DataFrame) -> DataFrame:
    """Old attribute (old, new) and value (attr, old, new) names to current ones, a member at a time."""
    out = cells.join(F.broadcast(attrs.select(F.col("old").alias("attr"), F.col("new").alias("__new"))), "attr", "left")
    out = out.select("id", F.coalesce("__new", "attr").alias("attr"), "value")
    pairs = values.groupBy("attr").agg(F.map_from_arrays(F.collect_list("old"), F.collect_list("new")).alias("__pairs"))
    new = F.array_join(F.transform(text.members(F.col("value")), lambda m: F.coalesce(F.element_at("__pairs", m), m)), ", ")
    return out.join(F.broadcast(pairs), "attr", "left").select("id", "attr", F.when(F.col("__pairs").isNull(), F.col("value")).otherwise(new).alias("value"))


def number_cells(cells: DataFrame) -> DataFrame:
    """cells with num, parts (their numbers) and all_numbers."""
    parts = F.transform(text.members(F.col("value"), ",;"), text.number)
    whole = text.number(F.col("value"))
    every = (F.size(parts) > 1) & F.forall(parts, lambda x: x.isNotNull())
    same = every & (F.size(F.array_distinct(parts)) == 1)
    return cells.select("*", F.when(whole.isNotNull(), whole).when(same, F.get(parts, F.lit(0))).alias("num"), whole.isNotNull().alias("plain"), every.alias("every"), same.alias("same"))


def number_findings(cells: DataFrame) -> DataFrame:
    """L1-FORMAT-DUBEL, L1-FORMAT-ROZNE and L1-NIE-LICZBA in one pass."""
    odd = number_cells(cells).where(~F.col("plain") & (F.trim("value") != ""))
    rule = F.when(F.col("same"), "L1-FORMAT-DUBEL").when(F.col("every"), "L1-FORMAT-ROZNE").otherwise("L1-NIE-LICZBA")
    sure = F.when(F.col("same"), 0.95).when(F.col("every"), 0.40).otherwise(0.90)
    group = F.when(F.col("every"), F.concat_ws("|", rule, "attr")).otherwise(F.concat_ws("|", rule, "attr", "value"))
    return f.emit(odd, rule, "L1", f.CRITICAL, sure, old="value", new=F.when(F.col("same"), text.number_text(F.col("num"))), evidence="not one number", group=group)


def match(values: DataFrame, dictionary: DataFrame, aliases: DataFrame, auto: float = AUTO, suggest: float = SUGGEST) -> DataFrame:
    """distinct (attr, value) → label (null if the attribute has no dictionary), how, score: exact, alias, fuzzy, near, outside, free. score is that of fuzzy and near ones: labels that can't reach `suggest` are not compared."""
    own = values.select("attr", "value").distinct().withColumn("n", text.norm(F.col("value")))
    words = dictionary.withColumn("n", text.norm(F.col("label")))
    exact = words.groupBy("attr", "n").agg(F.min_by("label", "pos").alias("exact"))
    named = aliases.select("attr", text.norm(F.col("alias")).alias("n"), F.col("label").alias("alias_of")).groupBy("attr", "n").agg(F.min("alias_of").alias("alias_of"))
    first = own.join(exact, ["attr", "n"], "left").join(named, ["attr", "n"], "left")
    first = first.join(F.broadcast(dictionary.select("attr").distinct().withColumn("known", F.lit(True))), "attr", "left")
    missed = first.where("exact is null and alias_of is null and known").select("attr", "n").distinct()
    labels = words.groupBy("attr", F.col("n").alias("m")).agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))
    pairs = similar.scored(missed, labels, ["attr"], "n", "m", suggest).join(labels, ["attr", "m"])
    scored = pairs.groupBy("attr", "n").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("pos"))).alias("best"))
    out = first.join(scored, ["attr", "n"], "left")
    s = F.col("best.score")
    how = F.when(F.col("known").isNull(), "free").when(F.col("exact").isNotNull(), "exact").when(F.col("alias_of").isNotNull(), "alias").when(s >= auto, "fuzzy").when(s >= suggest, "near").otherwise("outside")
    label = F.coalesce("exact", "alias_of", F.when(s >= suggest, F.col("best.label")))
    return out.select("attr", "value", label.alias("label"), how.alias("how"), F.when(F.col("exact").isNull() & F.col("alias_of").isNull(), s).alias("score"))


def match_findings(cells: DataFrame, matched: DataFrame) -> DataFrame:
    """L1-ZAPIS, L1-ALIAS, L1-SLOWNIK-AUTO, L1-SLOWNIK-SUGESTIA, L1-SPOZA-SLOWNIKA of the cells' members."""
    rows = cells.join(matched, ["attr", "value"]).where("how <> 'free' and not (how = 'exact' and label = value)")
    pick = lambda *x: F.when(F.col("how") == "exact", x[0]).when(F.col("how") == "alias", x[1]).when(F.col("how") == "fuzzy", x[2]).when(F.col("how") == "near", x[3]).otherwise(x[4])
    return f.emit(rows, pick("L1-ZAPIS", "L1-ALIAS", "L1-SLOWNIK-AUTO", "L1-SLOWNIK-SUGESTIA", "L1-SPOZA-SLOWNIKA"), "L1", pick(f.INFO, f.INFO, f.INFO, f.MIDDLE, f.MIDDLE), pick(0.99, 0.95, 0.95, 0.60, 0.50), old="value", new=F.when(F.col("how") != "outside", F.col("label")), evidence=F.concat(F.lit("dictionary: "), F.col("how")))


def members_of(cells: DataFrame) -> DataFrame:
    """(id, attr, whole, value) for each member of a cell."""
    return cells.select("id", "attr", F.col("value").alias("whole"), F.explode(text.members(F.col("value"))).alias("value"))


def multi_cells(cells: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of several values: (id, attr, value, norm) with members matched, distinct and in order; and the findings of lists."""
    parts = members_of(cells).join(matched, ["attr", "value"], "left")
    chosen = F.when(F.col("how").isin("exact", "alias", "fuzzy"), F.col("label")).otherwise(F.col("value"))
    lists = parts.groupBy("id", "attr", "whole").agg(F.array_sort(F.collect_set(chosen)).alias("canon"), F.array_sort(F.collect_list("value")).alias("raw"))
    lists = lists.select("id", "attr", F.col("whole").alias("value"), F.array_join("canon", ", ").alias("norm"), "canon", "raw")
    twice = (F.size("canon") < F.size("raw")) & (F.size(F.array_distinct("raw")) < F.size("raw"))
    turned = ~twice & (F.col("norm") != F.col("value")) & (F.col("norm") == F.array_join("raw", ", "))
    odd = lists.where(twice | turned).withColumn("twice", twice)
    rule = F.when(F.col("twice"), "L1-LISTA-DUBEL").otherwise("L1-LISTA-KOLEJNOSC")
    found = f.emit(odd, rule, "L1", F.when(F.col("twice"), f.MIDDLE).otherwise(f.INFO), F.when(F.col("twice"), 0.98).otherwise(0.99), old="value", new=F.col("norm"), evidence="list")
    return lists.select("id", "attr", "value", "norm"), found


def enum_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of one value: repeated ones made single, and L1-ENUM-DUBEL for them."""
    parts = text.members(F.col("value"))
    twice = (F.size(parts) > 1) & (F.size(F.array_distinct(F.transform(parts, text.norm))) == 1)
    rows = cells.withColumn("twice", twice).withColumn("one", F.when(twice, F.get(parts, F.lit(0))).otherwise(F.trim("value")))
    found = f.emit(rows.where("twice"), "L1-ENUM-DUBEL", "L1", f.MIDDLE, 0.97, old=F.trim("value"), new=F.col("one"), evidence="the same value twice")
    return rows.select("id", "attr", F.col("one").alias("value"), F.col("value").alias("raw")), found


def bool_findings(cells: DataFrame) -> DataFrame:
    return f.emit(cells.where((F.trim("value") != "") & text.yes_no(F.col("value")).isNull()), "L1-BOOL", "L1", f.MIDDLE, 0.70, old="value", evidence="neither yes nor no")


def normalise(cells: DataFrame, kinds: DataFrame, dictionary: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All cells by their kind: (id, attr, raw, norm, num), and the findings."""
    long, found = normalise_by_kind(cells, kinds, dictionary, aliases)
    return long, f.union(found)


def normalise_by_kind(cells: DataFrame, kinds: DataFrame, dictionary: DataFrame, aliases: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The same with the findings apart, by the detectors that make them.

    The matches of distinct values are written once: both outputs use them several times, and they are few.
    """
    typed = cells.join(F.broadcast(kinds), "attr", "left").withColumn("kind", F.coalesce("kind", F.lit("tekst")))
    of = lambda k: typed.where(F.col("kind") == k).select("id", "attr", "value")
    nums, enums, multis = of("liczba"), of("enum"), of("multi_enum")
    single, twice = enum_cells(enums)
    matched = tables.written(match(single.select("attr", "value").unionByName(members_of(multis).select("attr", "value")), dictionary, aliases), "matched")
    lists, lists_found = multi_cells(multis, matched)
    one = single.join(matched, ["attr", "value"], "left").select("id", "attr", "raw", F.when(F.col("how").isin("exact", "alias", "fuzzy"), F.col("label")).otherwise(F.col("value")).alias("norm"))
    rest = typed.where(F.col("kind").isin("tekst", "bool")).select("id", "attr", F.col("value").alias("raw"), F.when(F.col("kind") == "bool", F.coalesce(text.yes_no(F.col("value")), "value")).otherwise(F.trim(F.regexp_replace("value", r"\s+", " "))).alias("norm"), F.lit(None).cast("double").alias("num"))
    long = (
        number_cells(nums).select("id", "attr", F.col("value").alias("raw"), F.when(F.col("num").isNotNull(), text.number_text(F.col("num"))).otherwise(F.col("value")).alias("norm"), "num")
        .unionByName(one.select("id", "attr", "raw", "norm", F.lit(None).cast("double").alias("num")))
        .unionByName(lists.select("id", "attr", F.col("value").alias("raw"), "norm", F.lit(None).cast("double").alias("num")))
        .unionByName(rest)
    )
    found = [number_findings(nums), twice, lists_found, match_findings(single.select("id", "attr", "value"), matched), match_findings(members_of(multis).select("id", "attr", "value"), matched), bool_findings(of("bool"))]
    return long, found


def enum_label(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """counts (attr, count) → label: the exact one, else 'bez…' for 0, else the first '… i więcej' that covers it."""
    words = dictionary.select("attr", "pos", "label", text.count_in_label(F.col("label")).alias("lo"), text.norm(F.col("label")).contains("wiecej").alias("more"))
    near = counts.select("attr", "count").distinct().join(words, "attr").where("(lo = count and not more) or (more and count >= lo)")
    return near.groupBy("attr", "count").agg(F.min_by("label", F.struct("more", "pos")).alias("label"))


def canonical(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """cells with the shop's spelling of their value, null where the shop doesn't know it."""
    spelled = labels.select("attr", text.norm(F.col("label")).alias("__n"), F.col("label").alias("canonical")).groupBy("attr", "__n").agg(F.min("canonical").alias("canonical"))
    return cells.withColumn("__n", text.norm(F.col("value"))).join(spelled, ["attr", "__n"], "left").drop("__n")


def bad_lists(cells: DataFrame, multi: DataFrame) -> DataFrame:
    """Cells with a comma in an attribute (attr) that takes one value."""
    return cells.where(F.col("value").contains(",")).join(F.broadcast(multi.select("attr").distinct()), "attr", "left_anti")
