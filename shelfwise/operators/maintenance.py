"""Dictionary upkeep: learning, snapshots, renames, duplicates, multi-valued attributes, the catalogue of attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text


def learn(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells (attr, cell) of a panel export → (attr, n, label, ids) of 'id|label' members, and attributes that only ever had plain text."""
    parts = cells.select("attr", F.explode(F.transform(F.split("cell", ","), lambda x: F.trim(x))).alias("part")).where("part <> ''")
    coded = parts.where(parts["part"].rlike(r"^\d+\|.+$")).select("attr", F.regexp_extract("part", r"^(\d+)\|", 1).alias("pid"), F.regexp_extract("part", r"\|(.+)$", 1).alias("label"))
    ids = coded.groupBy("attr", text.norm(F.col("label")).alias("n")).agg(F.min("label").alias("label"), F.array_sort(F.collect_set("pid")).alias("ids"))
    return ids, parts.select("attr").distinct().join(coded.select("attr").distinct(), "attr", "left_anti")


def last_snapshot(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sheets (sheet, attr, pid, label): the last sheet's labels, 'NULL' ones left out and counted."""
    last = sheets.groupBy().agg(F.max("sheet").alias("sheet"))
    own = sheets.join(F.broadcast(last), "sheet")
    return own.where("label <> 'NULL'").select("attr", "pid", "label"), own.groupBy("attr").agg(F.count_if(F.col("label") == "NULL").alias("dropped"))


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(attr, pid, old, new) of values whose id stayed and whose label changed; only ids that are unique on either side."""
    one = lambda d, c: d.groupBy("attr", "pid").agg(F.count("*").alias("k"), F.min("label").alias(c)).where("k = 1").drop("k")
    return one(old, "old").join(one(new, "new"), ["attr", "pid"]).where(text.norm(F.col("old")) != text.norm(F.col("new")))


def add_renames(known: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new) pairs; A→B then B→C gives A→C."""
    later = new.select(F.col("old").alias("mid"), F.col("new").alias("last"))
    moved = known.join(later, known["new"] == later["mid"], "left").select("old", F.coalesce("last", "new").alias("new"))
    fresh = new.select("old", "new").join(moved.select("old"), "old", "left_anti")
    return moved.unionByName(fresh).where("old <> new")


def duplicate_labels(panel: DataFrame) -> DataFrame:
    return panel.groupBy("attr", text.norm(F.col("label")).alias("n")).agg(F.array_sort(F.collect_set("pid")).alias("ids")).where(F.size("ids") > 1)


def multi_valued(cells: DataFrame, panel: DataFrame) -> DataFrame:
    """Attributes with a list whose members all are labels of one id: how many, and an example."""
    ids = panel.groupBy("attr", text.norm(F.col("label")).alias("n")).agg(F.countDistinct("pid").alias("k")).where("k = 1").select("attr", "n", F.lit(True).alias("known"))
    lists = cells.where(F.col("value").contains(",")).select("attr", "value").groupBy("attr", "value").agg(F.count("*").alias("times"))
    parts = lists.select("attr", "value", "times", F.explode(text.members(F.col("value"))).alias("part")).withColumn("n", text.norm(F.col("part"))).join(F.broadcast(ids), ["attr", "n"], "left")
    whole = parts.groupBy("attr", "value", "times").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all")).where(F.col("all"))
    return whole.groupBy("attr").agg(F.sum("times").alias("n"), F.min("value").alias("example"))


def catalogue(attrs: DataFrame, panel: DataFrame, multi: DataFrame, search: str = "") -> DataFrame:
    """attrs (attr, status) with their labels; search looks in names and labels."""
    labels = panel.groupBy("attr").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    out = attrs.join(labels, "attr", "left").join(F.broadcast(multi.select("attr").distinct().withColumn("multi", F.lit(True))), "attr", "left")
    out = out.select("attr", "status", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("multi", F.lit(False)).alias("multi"))
    n = text.norm(F.lit(search))
    return out.where(text.norm(F.col("attr")).contains(n) | F.exists("labels", lambda x: text.norm(x).contains(n))) if search else out


def under_current_names(config: DataFrame, pairs: DataFrame) -> DataFrame:
    """A config table with an attr column, its old names replaced, repeated rows once."""
    return config.join(F.broadcast(pairs.select(F.col("old").alias("attr"), "new")), "attr", "left").withColumn("attr", F.coalesce("new", "attr")).drop("new").dropDuplicates()


def filter_seed(rows: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (level, kind, category, filter) of site measurements → filters of our categories (site, key), and site categories without one."""
    own = rows.where("level in ('grupa', 'kategoria') and kind in ('pewna', 'obicie')").withColumn("n", text.norm(F.col("category")))
    keyed = own.join(F.broadcast(categories.select(text.norm(F.col("site")).alias("n"), "key")), "n", "left")
    return keyed.where("key is not null").groupBy("key").agg(F.array_sort(F.collect_set("filter")).alias("filters")), keyed.where("key is null and level = 'kategoria'").select("category").distinct()
