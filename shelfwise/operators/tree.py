"""Category tree: parents, closure, and the node of a product's type and subtype.

nodes: (node, name, level, pos, hidden). Trees are small; products are joined by their distinct (type, subtype).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.sources import tables


def parents(nodes: DataFrame) -> DataFrame:
    """The nearest earlier row of a lower level."""
    b = nodes.select(F.col("node").alias("parent"), F.col("pos").alias("p_pos"), F.col("level").alias("p_level"))
    up = nodes.join(F.broadcast(b), (F.col("p_pos") < F.col("pos")) & (F.col("p_level") < F.col("level"))).groupBy("node").agg(F.max_by("parent", "p_pos").alias("parent"))
    return nodes.join(up, "node", "left")


def closure(tree: DataFrame) -> DataFrame:
    """(node, below, depth) with every node below itself at depth 0."""
    return tree.sparkSession.sql(
        """WITH RECURSIVE c(node, below, depth) AS (SELECT node, node, 0 FROM {tree} UNION ALL SELECT c.node, t.node, c.depth + 1 FROM c JOIN {tree} t ON t.parent = c.below)
        SELECT node, below, depth FROM c""",
        tree=tree.select("node", "parent"),
    )


def subtype_node(pairs: DataFrame, below: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (type, subtype, top) → the descendant of top whose name is the subtype, or holds all of its stems with fewest others; none on a tie."""
    names = nodes.select(F.col("node").alias("below"), "name", text.norm(F.col("name")).alias("n"), text.stems(F.col("name")).alias("have"))
    near = pairs.join(F.broadcast(below.where("depth > 0").withColumnRenamed("node", "top")), "top").join(F.broadcast(names), "below")
    want = text.stems(F.col("subtype"))
    near = near.withColumn("same", text.norm(F.col("subtype")) == F.col("n")).withColumn("extra", F.when(F.col("same"), -1).when((F.size(want) > 0) & (F.size(F.array_except(want, "have")) == 0), F.size(F.array_except("have", want)))).where("extra is not null")
    best = near.groupBy("type", "subtype", "top").agg(F.min("extra").alias("extra"))
    return near.join(best, ["type", "subtype", "top", "extra"]).groupBy("type", "subtype").agg(F.count("*").alias("ties"), F.min("below").alias("found"), F.first("same").alias("same")).where("ties = 1").select("type", "subtype", "found", F.when(F.col("same"), "subtype").otherwise("stems").alias("by"))


def assign(pairs: DataFrame, nodes: DataFrame, below: DataFrame, pair_aliases: DataFrame, type_aliases: DataFrame, excluded: DataFrame) -> DataFrame:
    """distinct (type, subtype) → node, how. Order: alias of the pair, excluded type, alias or name of the type, then its subtype."""
    own = pairs.select("type", "subtype").distinct()
    visible = nodes.where("not hidden").groupBy(text.norm(F.col("name")).alias("t")).agg(F.count("*").alias("n"), F.min("node").alias("by_name")).where("n = 1").select("t", "by_name")
    out = own.withColumn("t", text.norm(F.col("type"))).withColumn("s", text.norm(F.col("subtype")))
    out = out.join(F.broadcast(pair_aliases.select(text.norm(F.col("type")).alias("t"), text.norm(F.col("subtype")).alias("s"), F.col("node").alias("by_pair"))), ["t", "s"], "left")
    out = out.join(F.broadcast(excluded.select(text.norm(F.col("type")).alias("t")).distinct().withColumn("out", F.lit(True))), "t", "left")
    out = out.join(F.broadcast(type_aliases.select(text.norm(F.col("type")).alias("t"), F.col("node").alias("by_alias"))), "t", "left").join(F.broadcast(visible), "t", "left")
    out = out.withColumn("top", F.coalesce("by_alias", "by_name"))
    sub = subtype_node(out.where("top is not null and s <> ''").select("type", "subtype", "top"), below, nodes)
    out = out.join(sub, ["type", "subtype"], "left")
    how = F.when(F.col("by_pair").isNotNull(), "pair").when(F.col("out"), "excluded").when(F.col("top").isNull(), "none").when(F.col("found").isNotNull(), F.col("by")).otherwise("type")
    node = F.when(F.col("by_pair").isNotNull(), F.col("by_pair")).when(F.col("out"), None).otherwise(F.coalesce("found", "top"))
    return out.select("type", "subtype", node.alias("node"), how.alias("how"))


def with_node(products: DataFrame, nodes: DataFrame, pair_aliases: DataFrame, type_aliases: DataFrame, excluded: DataFrame) -> DataFrame:
    """products (type, subtype, …) with node and node_by, by their distinct pairs. nodes: (node, name, level, pos, hidden). The tree and the pairs are few, and written, so that plans stay short."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    pairs = products.select(said("type").alias("type"), said("subtype").alias("subtype")).distinct()
    below = tables.written(closure(tables.written(parents(nodes), "parents")), "closure")
    found = tables.written(assign(pairs, nodes, below, pair_aliases, type_aliases, excluded), "pairs")
    found = found.select(F.col("type").alias("__type"), F.col("subtype").alias("__subtype"), "node", F.col("how").alias("node_by"))
    rows = products.drop("node", "node_by")
    return rows.join(found, (said("type") == F.col("__type")) & (said("subtype") == F.col("__subtype")), "left").drop("__type", "__subtype")


def without_node(products: DataFrame, assigned: DataFrame) -> DataFrame:
    """(type, subtype) pairs that have no node, with the reason, by their number of products."""
    return products.join(assigned.where("node is null"), ["type", "subtype"]).groupBy("type", "subtype", "how").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type", "subtype")


def node_filters(filters: DataFrame, renames: DataFrame) -> DataFrame:
    """filters (node, attrs array) as (node, attr) under current names (old, new)."""
    long = filters.select("node", F.explode("attrs").alias("old"))
    return long.join(F.broadcast(renames), "old", "left").select("node", F.coalesce("new", "old").alias("attr")).distinct()


def load_matrix(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (node, pos, level, name, filters array) and known attributes (attr, slug) → tree with parents, and filters mapped by slug; attr null where unmapped."""
    flat = rows.select("node", F.explode("filters").alias("filter")).withColumn("slug", text.slug(F.col("filter")))
    return parents(rows.drop("filters")), flat.join(F.broadcast(known), "slug", "left").select("node", "filter", "attr")
