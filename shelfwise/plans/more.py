"""Queries of the tree, gaps, feeds, photos, upkeep and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import feeds, gaps, maintenance, photos, tree
from shelfwise.plans.bridge import norm_sql, number_text_sql, oracle, table, view
from shelfwise.plans.registry import query
from shelfwise.sources import mixed, readers, tables

# ---- tree: regions and nations; a root above

TREE = """SELECT 0 AS node, 'ALL' AS name, 0 AS level, 0 AS pos, false AS hidden
UNION ALL SELECT r_regionkey + 1, r_name, 1, (r_regionkey + 1) * 1000, r_regionkey = 4 FROM region
UNION ALL SELECT n_nationkey + 100, n_name || ' of region', 2, (n_regionkey + 1) * 1000 + n_nationkey + 1, false FROM nation"""


def _tree(spark, d):
    return spark.sql(TREE.replace("FROM region", "FROM {region}").replace("FROM nation", "FROM {nation}"), region=table(spark, d, "region"), nation=table(spark, d, "nation"))


T = f"WITH RECURSIVE nodes AS ({TREE}), tree AS (SELECT n.*, (SELECT arg_max(p.node, p.pos) FROM nodes p WHERE p.pos < n.pos AND p.level < n.level) AS parent FROM nodes n), clo(node, below, depth) AS (SELECT node, node, 0 FROM tree UNION ALL SELECT c.node, t.node, c.depth + 1 FROM clo c JOIN tree t ON t.parent = c.below)"


#: A tree of brands and their sizes, which grows with the catalogue.
BRAND_RANKS = "SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS r FROM (SELECT DISTINCT p_brand FROM part)"
BRAND_TREE = f"""SELECT 0 AS node, 'ALL' AS name, 0 AS level, 0 AS pos, false AS hidden
UNION ALL SELECT cast(r * 1000 AS int), p_brand, 1, cast(r * 1000 AS int), false FROM ({BRAND_RANKS}) AS b
UNION ALL SELECT cast(r * 1000 + p_size AS int), p_brand || ' ' || cast(p_size AS string), 2, cast(r * 1000 + p_size AS int), false FROM (SELECT DISTINCT p_brand, p_size FROM part) AS s JOIN ({BRAND_RANKS}) AS b USING (p_brand)"""
BT = T.replace(TREE, BRAND_TREE)


def _brand_tree(spark, d):
    return spark.sql(BRAND_TREE.replace("FROM part", "FROM {p}"), p=table(spark, d, "part"))


@query(BT + " SELECT node, parent FROM tree")
def n1_parents(spark, d):
    return tree.parents(_brand_tree(spark, d)).select("node", "parent")


@query(BT + " SELECT node, below, depth FROM clo")
def n2_n3_closure(spark, d):
    return tree.closure(tree.parents(_brand_tree(spark, d)))


PAIRS = "SELECT r.r_name AS type, 'nation_' || cast(c_nationkey AS string) AS subtype FROM customer JOIN region r ON r.r_regionkey = c_custkey % 6"


def _pairs(spark, d):
    return spark.sql(PAIRS.replace("FROM customer", "FROM {c}").replace("JOIN region", "JOIN {r}"), c=table(spark, d, "customer"), r=table(spark, d, "region"))


def _assigned(spark, d):
    nodes = _tree(spark, d)
    none = spark.sql("SELECT '' AS type, '' AS subtype, 0 AS node WHERE false")
    pair = spark.sql("SELECT 'AFRICA' AS type, 'nation_3' AS subtype, 77 AS node")
    return tree.assign(_pairs(spark, d), nodes, tree.closure(tree.parents(nodes)), pair, none.drop("subtype"), spark.sql("SELECT 'ASIA' AS type"))


N5 = T + f""", pairs AS (SELECT DISTINCT type, subtype FROM ({PAIRS})), m AS (SELECT p.*, t.node AS top, (SELECT min(x.node) FROM clo c JOIN nodes x ON x.node = c.below WHERE c.node = t.node AND c.depth > 0 AND lower(x.name) = p.subtype || ' of region') AS sub,
(SELECT count(*) FROM clo c JOIN nodes x ON x.node = c.below WHERE c.node = t.node AND c.depth > 0) AS kids FROM pairs p LEFT JOIN nodes t ON t.name = p.type AND NOT t.hidden)"""


@query(N5 + """ SELECT type, subtype, CASE WHEN type = 'AFRICA' AND subtype = 'nation_3' THEN 77 WHEN type = 'ASIA' THEN NULL WHEN kids = 1 THEN NULL ELSE top END AS top, CASE WHEN type = 'AFRICA' AND subtype = 'nation_3' THEN 'pair' WHEN type = 'ASIA' THEN 'excluded' WHEN top IS NULL THEN 'none' ELSE 'type' END AS how FROM m""")
def n5_assign(spark, d):
    """Stems of five letters are alike for all nations, so N4 ties and the type's own node stays."""
    a = _assigned(spark, d)
    return a.select("type", "subtype", F.col("node").alias("top"), "how")


@query(N5 + f""", a AS (SELECT type, subtype, CASE WHEN type = 'ASIA' THEN 'excluded' ELSE 'none' END AS how FROM m WHERE (type = 'ASIA' OR top IS NULL) AND NOT (type = 'AFRICA' AND subtype = 'nation_3')) SELECT p.type, p.subtype, a.how, count(*) AS n FROM ({PAIRS}) p JOIN a ON a.type = p.type AND a.subtype = p.subtype GROUP BY ALL""")
def n6_without_node(spark, d):
    return tree.without_node(_pairs(spark, d), _assigned(spark, d))


#: Filters of tree nodes that the catalogue's brands and sizes make.
BRANDS = "SELECT dense_rank() OVER (ORDER BY p_brand, p_size) AS node, p_brand, p_size FROM (SELECT DISTINCT p_brand, p_size FROM part)"


def _brands(spark, d):
    return spark.sql(BRANDS.replace("FROM part", "FROM {p}"), p=table(spark, d, "part"))


@query(f"SELECT node, unnest(CASE WHEN p_size % 2 = 0 THEN ['width', 'Styl', p_brand] ELSE ['Styl', p_brand] END) AS attr FROM ({BRANDS})")
def n7_node_filters(spark, d):
    b = _brands(spark, d)
    rows = b.select("node", F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Szerokość"), F.lit("Styl"), "p_brand")).otherwise(F.array(F.lit("Styl"), "p_brand")).alias("attrs"))
    return tree.node_filters(rows, spark.sql("SELECT 'Szerokość' AS old, 'width' AS new"))


@query(f"SELECT node, unnest(['Rodzaj (typ)', 'Nieznany filtr', p_brand]) AS filter, unnest(['Rodzaj', NULL, CASE WHEN p_brand = 'Brand#7' THEN 'Marka' END]) AS attr FROM ({BRANDS})")
def s11_load_matrix(spark, d):
    b = _brands(spark, d)
    rows = b.select("node", F.col("node").alias("pos"), F.lit(1).alias("level"), F.concat_ws(" ", "p_brand", "p_size").alias("name"), F.array(F.lit("Rodzaj (typ)"), F.lit("Nieznany filtr"), "p_brand").alias("filters"))
    return tree.load_matrix(rows, spark.sql("SELECT * FROM (VALUES ('Rodzaj', 'rodzaj-typ'), ('Marka', 'brand-7')) AS t(attr, slug)"))[1]


# ---- gaps

FILTERS = "SELECT * FROM (VALUES ('ECONOMY', 'Materiał'), ('ECONOMY', 'Styl'), ('STANDARD', 'Materiał'), ('STANDARD', 'Liczba drzwi'), ('PROMO', 'Styl'), ('PROMO', 'Szerokość powierzchni spania'), ('PROMO', 'Długość powierzchni spania'), ('PROMO', 'Funkcje')) AS t(category, attr)"
NODE_FILTERS = "SELECT * FROM (VALUES (1, 'Kolor'), (1, 'Styl')) AS t(node, attr)"
G = oracle("products", "attrs", "components") + f""", filters AS ({FILTERS}), nodefil AS ({NODE_FILTERS}), eff AS (SELECT id, attr, value FROM attrs UNION ALL SELECT id, attr, value FROM components c WHERE NOT EXISTS (SELECT 1 FROM attrs a WHERE a.id = c.id AND a.attr = c.attr)),
own0 AS (SELECT p.id, f.attr FROM products p JOIN nodefil f ON f.node = 1 WHERE p.n % 10 = 1 UNION SELECT p.id, f.attr FROM products p JOIN filters f ON f.category = p.category WHERE p.n % 10 <> 1),
own AS (SELECT * FROM own0 WHERE NOT (attr LIKE '%powierzchni spania' AND id IN (SELECT id FROM own0 WHERE attr = 'Funkcje')))"""


class _Gaps:
    def __init__(self, spark, d):
        self.spark = spark
        self.products = view(spark, d, "products").withColumn("node", F.when(F.col("n") % 10 == 1, 1))
        self.values = gaps.effective(view(spark, d, "attrs"), view(spark, d, "components"))
        self.own = gaps.cells(self.products, spark.sql(NODE_FILTERS), spark.sql(FILTERS), self.values)

    def subtype_rules(self):
        return self.spark.sql("SELECT * FROM (VALUES ('Stojąca', 'Styl', 'klasyczny', array('loftt')), ('wisząca', 'Materiał', 'metal', array('szkło'))) AS t(subtype, attr, value, allowed)")

    def name_rules(self):
        return self.spark.sql("SELECT * FROM (VALUES (0, 'Styl', 'retro', 'small', 'ring', array('PROMO', 'ECONOMY')), (1, 'Styl', 'loft', 'red', CAST(NULL AS STRING), CAST(NULL AS ARRAY<STRING>))) AS t(pos, attr, value, include, exclude, categories)")

    def reads(self):
        return self.products.select("id", F.lit("Styl").alias("attr"), F.when(F.col("n") % 2 == 0, "LOFT").otherwise("inny").alias("read"), (0.5 + (F.col("n") % 5) / 10).alias("confidence"))

    def subtype(self):
        return gaps.from_subtype(self.products, self.own, self.values, self.subtype_rules())

    def name(self):
        return gaps.from_name(self.products, self.own, self.values, self.name_rules())

    def family(self):
        return gaps.from_family(self.products, self.own, self.values.where("attr = 'Liczba drzwi' and value <> 'bez drzwi' and value <> '3-drzwiowe'"), self.spark.sql("SELECT 'Liczba drzwi' AS attr, '2-drzwiowe' AS label"), [F.col("category"), F.col("producer")])

    def all(self):
        return self.subtype().unionByName(self.name())


@query(G + " SELECT id, attr, value FROM eff")
def g1_effective(spark, d):
    return _Gaps(spark, d).values


@query(G + " SELECT id, attr FROM own")
def g2_filter_cells(spark, d):
    return _Gaps(spark, d).own


SUB = f"""sub AS (SELECT o.id, o.attr, CASE WHEN e.value IS NULL THEN 'L2-LUKA-PODTYP' ELSE 'L2-LUKA-PODTYP-SPRZECZNE' END AS rule_id, e.value AS old_value, CASE WHEN p.subtype = 'stojąca' THEN 'klasyczny' ELSE 'metal' END AS new_value,
CASE WHEN e.value IS NULL THEN 0.92 ELSE 0.88 END AS confidence FROM own o JOIN products p ON p.id = o.id LEFT JOIN eff e ON e.id = o.id AND e.attr = o.attr
WHERE (p.subtype = 'stojąca' AND o.attr = 'Styl' AND (e.value IS NULL OR (e.value NOT IN ('klasyczny', 'loftt')))) OR (p.subtype = 'wisząca' AND o.attr = 'Materiał' AND (e.value IS NULL OR e.value NOT IN ('metal', 'szkło'))))"""
NAM = """nam AS (SELECT o.id, o.attr, 'L2-LUKA-NAZWA' AS rule_id, cast(NULL AS varchar) AS old_value, CASE WHEN p.name LIKE '%small%' AND p.name NOT LIKE '%ring%' AND p.category IN ('PROMO', 'ECONOMY') THEN 'retro' ELSE 'loft' END AS new_value, 0.8 AS confidence
FROM own o JOIN products p ON p.id = o.id LEFT JOIN eff e ON e.id = o.id AND e.attr = o.attr WHERE o.attr = 'Styl' AND e.id IS NULL AND ((p.name LIKE '%small%' AND p.name NOT LIKE '%ring%' AND p.category IN ('PROMO', 'ECONOMY')) OR p.name LIKE '%red%'))"""


@query(G + f", {SUB} SELECT * FROM sub")
def g3_from_subtype(spark, d):
    return _Gaps(spark, d).subtype().select("id", "attr", "rule_id", "old_value", "new_value", "confidence")


@query(G + f", {NAM} SELECT * FROM nam")
def g4_from_name(spark, d):
    return _Gaps(spark, d).name().select("id", "attr", "rule_id", "old_value", "new_value", "confidence")


SIZES = "SELECT cast(p_partkey AS string) AS id, cast(p_size + 60 AS string) || 'x' || cast(150 + p_partkey % 101 AS string) AS size, CASE p_partkey % 5 WHEN 0 THEN cast(p_size + 65 AS string) WHEN 1 THEN cast(least(p_size + 60, 150 + p_partkey % 101) AS string) || ' cm' WHEN 2 THEN 'szeroka' END AS given FROM part"


@query(f"""WITH s AS ({SIZES}), p AS (SELECT *, cast(string_split(size, 'x')[1] AS integer) AS a, cast(string_split(size, 'x')[2] AS integer) AS b FROM s),
t AS (SELECT id, 'W' AS attr, least(a, b) AS due, given FROM p UNION ALL SELECT id, 'L', greatest(a, b), NULL FROM p), j AS (SELECT *, try_cast(regexp_replace(given, ' cm$', '') AS double) AS num FROM t)
SELECT id, attr, CASE WHEN given IS NULL THEN 'L2-LUKA-ROZMIAR' ELSE 'L2-LUKA-ROZMIAR-SPRZECZNE' END AS rule_id, given AS old_value, CASE WHEN given IS NULL THEN cast(due AS varchar) END AS new_value FROM j WHERE given IS NULL OR num IS NULL OR abs(num - due) > 0.5""")
def g5_from_size(spark, d):
    """Widths that agree, differ, can't be read, or are missing."""
    p = spark.sql(SIZES.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    values = p.select("id", F.lit("S").alias("attr"), F.col("size").alias("value")).unionByName(p.where("given is not null").select("id", F.lit("W").alias("attr"), F.col("given").alias("value")))
    own = p.select("id", F.explode(F.array(F.lit("W"), F.lit("L"))).alias("attr"))
    return gaps.from_size(own, values, "S", ("W", "L")).select("id", "attr", "rule_id", "old_value", "new_value")


SLEEP = """SELECT cast(p_partkey AS string) AS id, CASE WHEN p_partkey % 7 = 2 THEN 'Sofa rozkładana' WHEN p_partkey % 7 = 3 THEN 'Fotel rozkładany do stołu' ELSE 'Sofa ' || p_name END AS name, CASE WHEN p_partkey % 11 = 4 THEN 'Kanapy' ELSE 'Meble' END AS node_name,
CASE p_partkey % 8 WHEN 0 THEN 'Z funkcją spania' WHEN 1 THEN 'bez funkcji' WHEN 2 THEN 'tak' END AS old, CASE WHEN p_partkey % 9 = 1 THEN 'DL' WHEN p_partkey % 9 = 2 THEN 'bez mechanizmu' END AS mechanism,
CASE p_partkey % 10 WHEN 1 THEN 'z barkiem' WHEN 2 THEN 'z barkiem, Z funkcją spania' WHEN 3 THEN 'bez funkcji spania' END AS now FROM part"""


@query(f"""WITH s AS ({SLEEP}), e AS (SELECT *, greatest(CASE WHEN old LIKE 'Z funkcj%' THEN 0.92 ELSE 0 END, CASE WHEN mechanism <> '' THEN 0.9 ELSE 0 END, CASE WHEN node_name = 'Kanapy' THEN 0.92 ELSE 0 END, CASE WHEN name LIKE '%rozkładan%' AND name NOT LIKE '%do stołu%' THEN 0.8 ELSE 0 END) AS sure FROM s)
SELECT id, cast(sure AS double) AS confidence, CASE WHEN now IS NULL THEN 'z funkcją spania' ELSE now || ', z funkcją spania' END AS new_value FROM e WHERE sure > 0 AND coalesce(old, '') NOT LIKE 'bez%' AND coalesce(now, '') NOT LIKE '%, Z funkcją spania'""")
def g6_from_sleep(spark, d):
    """Evidence of the old field, a mechanism, the node and the name, alone and together."""
    p = spark.sql(SLEEP.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    values = p.select("id", F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(c).alias("value")) for a, c in (("Funkcja spania", "old"), ("Mechanizm", "mechanism"), ("Funkcje", "now")))))).where("value is not null")
    labels = spark.sql("SELECT 'Funkcje' AS attr, 'z funkcją spania' AS label")
    return gaps.from_sleep(p, p.select("id", F.lit("Funkcje").alias("attr")), values, not_named="do stolu", node_named="^kanap", labels=labels).select("id", "confidence", "new_value")


@query(G + """, fam AS (SELECT o.id, p.category, p.producer, e.value FROM own o JOIN products p ON p.id = o.id LEFT JOIN eff e ON e.id = o.id AND e.attr = o.attr AND e.value NOT IN ('bez drzwi', '3-drzwiowe') WHERE o.attr = 'Liczba drzwi'),
t AS (SELECT category, producer, count(value) AS known FROM fam GROUP BY ALL HAVING count(value) >= 3)
SELECT f.id, '2-drzwiowe' AS new_value, round(least(0.95, (t.known + 1) / (t.known + 2)), 3) AS confidence FROM fam f JOIN t ON t.category = f.category AND t.producer = f.producer WHERE f.value IS NULL""")
def g7_from_family(spark, d):
    return _Gaps(spark, d).family().select("id", "new_value", "confidence")


@query(G + """ SELECT o.id, 'loft' AS new_value, least(0.8, 0.5 + (cast(o.id AS bigint) % 5) / 10.0) AS confidence FROM own o LEFT JOIN eff e ON e.id = o.id AND e.attr = 'Styl' WHERE o.attr = 'Styl' AND e.id IS NULL AND cast(o.id AS bigint) % 2 = 0""")
def g8_from_photos(spark, d):
    g = _Gaps(spark, d)
    return gaps.from_photos(g.own, g.values, g.reads(), spark.sql("SELECT 'Styl' AS attr, 'loft' AS label")).select("id", "new_value", F.round("confidence", 4).alias("confidence"))


BEST = f"""{SUB}, {NAM}, allc AS (SELECT *, 1 AS r FROM sub UNION ALL SELECT *, 2 FROM nam), best AS (SELECT * EXCLUDE (r, k) FROM (SELECT *, row_number() OVER (PARTITION BY id, attr ORDER BY confidence DESC, r, new_value) AS k FROM allc) WHERE k = 1)"""


@query(G + f", {BEST} SELECT * FROM best")
def g9_best(spark, d):
    return gaps.best(_Gaps(spark, d).all()).select("id", "attr", "rule_id", "old_value", "new_value", "confidence")


@query(G + f", {BEST} SELECT o.id, o.attr FROM own o WHERE o.attr <> 'Kolor' AND NOT EXISTS (SELECT 1 FROM eff e WHERE e.id = o.id AND e.attr = o.attr) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.id = o.id AND b.attr = o.attr)")
def g10_remaining(spark, d):
    g = _Gaps(spark, d)
    return gaps.remaining(g.own, g.values, gaps.best(g.all()), spark.sql("SELECT 'Kolor' AS attr")).select("id", "attr")


class _AllGaps(_Gaps):
    """The same catalogue with sleeping sizes and functions for some of PROMO, so that each of the six sources has something to say."""

    def __init__(self, spark, d):
        super().__init__(spark, d)
        promo = self.products.where("category = 'PROMO'")
        said = ((F.col("n") % 5 == 0, "Funkcja spania", "z funkcją spania"), (F.col("n") % 5 == 2, "Funkcje", "z funkcją spania"), (F.col("n") % 5 == 2, "Rozmiar", "90x200"), (F.col("n") % 10 == 2, "Szerokość powierzchni spania", "95"))
        cells = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(a).alias("attr"), F.lit(v).alias("value"))) for when, a, v in said)))
        self.values = tables.written(self.values.unionByName(promo.select("id", F.inline(cells))), "effective")  # six sources read both
        self.own = tables.written(gaps.cells(self.products, spark.sql(NODE_FILTERS), spark.sql(FILTERS), self.values), "filter-cells")

    def all(self):
        labels = self.spark.sql("SELECT * FROM (VALUES ('Styl', 'nowoczesny'), ('Styl', 'klasyczny'), ('Styl', 'skandynawski'), ('Styl', 'loft')) AS t(attr, label)")
        products = self.products.withColumn("collection", F.concat(F.lit("C"), (F.col("n") % 5).cast("string")))
        return gaps.candidates(products, self.own, self.values, labels, subtypes=self.subtype_rules(), names=self.name_rules(), reads=self.reads(), family=[F.col("category"), F.col("collection")])


G6 = oracle("products", "attrs", "components") + f""", filters AS ({FILTERS}), nodefil AS ({NODE_FILTERS}), eff AS (SELECT id, attr, value FROM attrs UNION ALL SELECT id, attr, value FROM components c WHERE NOT EXISTS (SELECT 1 FROM attrs a WHERE a.id = c.id AND a.attr = c.attr)
 UNION ALL SELECT p.id, v.attr, v.value FROM products p JOIN (VALUES (5, 0, 'Funkcja spania', 'z funkcją spania'), (5, 2, 'Funkcje', 'z funkcją spania'), (5, 2, 'Rozmiar', '90x200'), (10, 2, 'Szerokość powierzchni spania', '95')) AS v(m, k, attr, value) ON p.n % v.m = v.k WHERE p.category = 'PROMO'),
own0 AS (SELECT p.id, f.attr FROM products p JOIN nodefil f ON f.node = 1 WHERE p.n % 10 = 1 UNION SELECT p.id, f.attr FROM products p JOIN filters f ON f.category = p.category WHERE p.n % 10 <> 1),
own AS (SELECT * FROM own0 o WHERE NOT (attr LIKE '%powierzchni spania' AND id IN (SELECT id FROM own0 WHERE attr = 'Funkcje') AND NOT EXISTS (SELECT 1 FROM eff e WHERE e.id = o.id AND e.attr = 'Funkcje'))),
{SUB}, {NAM},
siz AS (SELECT o.id, o.attr, CASE WHEN e.id IS NULL THEN 'L2-LUKA-ROZMIAR' ELSE 'L2-LUKA-ROZMIAR-SPRZECZNE' END AS rule_id, e.value AS old_value, CASE WHEN e.id IS NULL THEN CASE WHEN o.attr LIKE 'Szer%' THEN '90' ELSE '200' END END AS new_value, CASE WHEN e.id IS NULL THEN 0.95 ELSE 1.0 END AS confidence
 FROM own o JOIN eff s ON s.id = o.id AND s.attr = 'Rozmiar' LEFT JOIN eff e ON e.id = o.id AND e.attr = o.attr WHERE o.attr LIKE '%powierzchni spania'),
sle AS (SELECT o.id, o.attr, 'L2-LUKA-FUNKCJA-SPANIA' AS rule_id, cast(NULL AS varchar) AS old_value, 'z funkcją spania' AS new_value, 0.92 AS confidence FROM own o JOIN eff e ON e.id = o.id AND e.attr = 'Funkcja spania' WHERE o.attr = 'Funkcje'),
pho AS (SELECT o.id, o.attr, 'L2-LUKA-ZDJECIE' AS rule_id, cast(NULL AS varchar) AS old_value, 'loft' AS new_value, least(0.8, 0.5 + (p.n % 5) / 10.0) AS confidence FROM own o JOIN products p ON p.id = o.id WHERE o.attr = 'Styl' AND p.n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM eff e WHERE e.id = o.id AND e.attr = 'Styl')),
fam AS (SELECT o.id, p.category, p.n % 5 AS k, e.value FROM own o JOIN products p ON p.id = o.id LEFT JOIN eff e ON e.id = o.id AND e.attr = 'Styl' WHERE o.attr = 'Styl'),
known AS (SELECT category, k, count(*) AS n, CASE any_value(value) WHEN 'Nowoczesny' THEN 'nowoczesny' ELSE any_value(value) END AS due FROM fam WHERE value IS NOT NULL GROUP BY category, k HAVING count(*) >= 3 AND k IN (1, 2, 3)),
rod AS (SELECT f.id, 'Styl' AS attr, 'L2-LUKA-RODZINA' AS rule_id, cast(NULL AS varchar) AS old_value, g.due AS new_value, round(least(0.95, (g.n + 1) / (g.n + 2)), 3) AS confidence FROM fam f JOIN known g ON g.category = f.category AND g.k = f.k WHERE f.value IS NULL),
allc AS (SELECT *, 1 AS r FROM sub UNION ALL SELECT *, 2 FROM nam UNION ALL SELECT *, 3 FROM siz UNION ALL SELECT *, 4 FROM sle UNION ALL SELECT *, 5 FROM pho UNION ALL SELECT *, 6 FROM rod),
best AS (SELECT * EXCLUDE (r, k) FROM (SELECT *, row_number() OVER (PARTITION BY id, attr ORDER BY confidence DESC, r, new_value) AS k FROM allc) WHERE k = 1)"""


@query(G6 + " SELECT id, attr, rule_id, old_value, new_value, cast(confidence AS double) AS confidence FROM best")
def g9_best_of_all(spark, d):
    """Of all six sources; g9_best is the part of subtype and name."""
    return gaps.best(_AllGaps(spark, d).all()).select("id", "attr", "rule_id", "old_value", "new_value", F.round("confidence", 4).alias("confidence"))


@query(G6 + " SELECT o.id, o.attr FROM own o WHERE o.attr <> 'Kolor' AND NOT EXISTS (SELECT 1 FROM eff e WHERE e.id = o.id AND e.attr = o.attr) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.id = o.id AND b.attr = o.attr)")
def g10_remaining_of_all(spark, d):
    """What all six sources leave open."""
    g = _AllGaps(spark, d)
    return gaps.remaining(g.own, g.values, gaps.best(g.all()), spark.sql("SELECT 'Kolor' AS attr")).select("id", "attr")


RECON = """WITH e AS (SELECT c_custkey AS k, cast(c_custkey AS varchar) AS id, CASE WHEN c_custkey % 3 > 0 THEN 'v' || cast(c_custkey % 2 AS varchar) END AS new_value, 0.5 + (c_custkey % 4) / 10.0 AS confidence FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 1),
g AS (SELECT c_custkey AS k, cast(c_custkey AS varchar) AS id, CASE WHEN c_custkey % 5 > 0 THEN 'v0' END AS new_value, 0.65 AS confidence FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 2),
b AS (SELECT e.id, CASE WHEN e.new_value IS NULL THEN 'g' WHEN g.new_value IS NULL THEN 'e' WHEN g.confidence >= e.confidence THEN 'g' ELSE 'e' END AS stay, e.new_value <> g.new_value AS clash FROM e JOIN g ON g.id = e.id)
SELECT 'e' AS side, e.id, e.new_value, round(CASE WHEN b.clash THEN least(0.6, e.confidence) ELSE e.confidence END, 4) AS confidence FROM e LEFT JOIN b ON b.id = e.id WHERE b.stay IS NULL OR b.stay = 'e'
UNION ALL SELECT 'g', g.id, g.new_value, round(CASE WHEN b.clash THEN least(0.6, g.confidence) ELSE g.confidence END, 4) FROM g LEFT JOIN b ON b.id = g.id WHERE b.stay IS NULL OR b.stay = 'g'"""


@query(RECON)
def g11_reconcile(spark, d):
    from shelfwise.operators.findings import emit

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("id"), F.lit("A").alias("attr"))
    e = c.where("k % 2 = 0 or k % 3 = 1").withColumns({"v": F.when(F.col("k") % 3 > 0, F.concat(F.lit("v"), (F.col("k") % 2).cast("string"))), "s": 0.5 + (F.col("k") % 4) / 10})
    g = c.where("k % 2 = 0 or k % 3 = 2").withColumns({"v": F.when(F.col("k") % 5 > 0, "v0"), "s": F.lit(0.65)})
    one, two = gaps.reconcile(emit(e, "R", "L2", "info", F.col("s"), new=F.col("v")), emit(g, "L2-LUKA-NAZWA", "L2", "info", F.col("s"), new=F.col("v")))
    out = one.withColumn("side", F.lit("e")).unionByName(two.withColumn("side", F.lit("g")))
    return out.select("side", "id", "new_value", F.round("confidence", 4).alias("confidence"))


# ---- feeds: three sources over parts; S2 in millimetres

FEED = """SELECT s AS source, p_partkey AS rec, p_partkey AS n, 'P-' || cast(p_partkey AS string) AS code, p_name || ' model' AS title, p_brand AS producer, 'C' || cast(p_partkey % 50 AS string) AS collection,
cast((p_size + 40.0) * CASE WHEN s = 'S2' THEN 10 ELSE 1 END * CASE WHEN p_partkey % 20 = 0 THEN 1.5 WHEN p_partkey % 33 = 0 AND s = 'S3' THEN 1.2 ELSE 1 END AS double) AS width FROM part JOIN (VALUES ('S1', 3), ('S2', 2), ('S3', 5)) AS v(s, m) ON p_partkey % m = 0"""


def _feed(spark, d):
    return spark.sql(FEED.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


def _long(spark, d):
    f = _feed(spark, d)
    cells = F.array(*(F.struct(F.lit(k).alias("field"), c.alias("value")) for k, c in (("kod", F.col("code")), ("nazwa", F.col("title")), ("Szerokość", text.number_text(F.col("width"))), ("karton szer", F.lit("5")), ("uwagi", F.when(F.col("n") % 2 == 0, "x").otherwise("")))))
    return f.select("source", "rec", F.inline(cells))


def _keys(spark, d):
    return table(spark, d, "part").where("p_partkey % 4 <> 1").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("key"))


def _items(spark, d):
    return _feed(spark, d).select("source", text.norm(F.col("code")).alias("key"), "producer", "collection", F.col("title").alias("name"), "width")


FD = f"WITH feed AS ({FEED}), z AS (SELECT source, count(*) AS records FROM feed GROUP BY 1)"


@query(FD + """ SELECT source, 'kod' AS field, 1.0 AS fill, false AS numeric, count(*) AS kinds FROM feed GROUP BY 1 UNION ALL SELECT source, 'nazwa', 1.0, false, count(DISTINCT title) FROM feed GROUP BY 1 UNION ALL SELECT source, 'Szerokość', 1.0, true, count(DISTINCT width) FROM feed GROUP BY 1
UNION ALL SELECT source, 'karton szer', 1.0, true, 1 FROM feed GROUP BY 1 UNION ALL SELECT f.source, 'uwagi', round(count(*) FILTER (n % 2 = 0) / any_value(records), 3), false, 1 FROM feed f JOIN z ON z.source = f.source GROUP BY 1""")
def x1_profile(spark, d):
    return feeds.profile(_long(spark, d)).drop("examples")


@query(FD + " SELECT source, 'kod' AS field, count(*) FILTER (n % 4 <> 1) AS hits FROM feed GROUP BY 1")
def x2_guess_key(spark, d):
    return feeds.guess_key(_long(spark, d), _keys(spark, d))


@query(FD + " SELECT source, 'Szerokość' AS target, 'Szerokość' AS field FROM z UNION ALL SELECT source, 'Nazwa', 'nazwa' FROM z")
def x3_guess_mapping(spark, d):
    words = spark.sql("SELECT * FROM (VALUES ('Szerokość', 0, 'szer', 0, true), ('Nazwa', 1, 'nazwa', 0, false), ('Nazwa', 1, 'szer', 1, false)) AS t(target, target_rank, word, word_rank, numeric)")
    return feeds.guess_mapping(feeds.profile(_long(spark, d)), words)


@query(FD + f" SELECT source, 'p-' || cast(n AS varchar) AS key, {number_text_sql('width')} AS width, 5 AS fields FROM feed")
def x4_x5_load(spark, d):
    long = _long(spark, d)
    keys = spark.sql("SELECT * FROM (VALUES ('S1', 'kod'), ('S2', 'kod'), ('S3', 'kod')) AS t(source, field)")
    mapping = spark.sql("SELECT * FROM (VALUES ('S1', 'Szerokość', 'Szerokość'), ('S2', 'Szerokość', 'Szerokość'), ('S3', 'Szerokość', 'Szerokość')) AS t(source, target, field)")
    return feeds.load(long, mapping, keys).select("source", "key", F.col("mapped")["Szerokość"].alias("width"), F.size("raw").alias("fields"))


def _matched(spark, d):
    return feeds.match_by_code(_keys(spark, d), _items(spark, d))


def _ours(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("Szerokość").alias("attr"), (F.col("p_size") + 40.0).alias("num"))


def _pairs_of(spark, d):
    return _matched(spark, d).join(_items(spark, d), ["source", "key"]).join(_ours(spark, d), "id").select("source", "id", "key", "attr", F.col("width").alias("theirs"), F.col("num").alias("ours"), "method")


def _factors(spark, d):
    return feeds.scales(_pairs_of(spark, d))


@query(FD + """, m AS (SELECT f.source, f.width, p.p_size + 40.0 AS num FROM feed f JOIN part p ON p.p_partkey = f.n WHERE f.n % 4 <> 1) SELECT source, 'Szerokość' AS attr, CASE WHEN source = 'S2' THEN 0.1 ELSE 1.0 END AS scale, round(avg(CASE WHEN abs(width * CASE WHEN source = 'S2' THEN 0.1 ELSE 1.0 END - num) / num <= 0.03 THEN 1.0 ELSE 0.0 END), 6) AS share FROM m GROUP BY 1""")
def x6_scales(spark, d):
    return _factors(spark, d).withColumn("share", F.round("share", 6))


@query(FD + " SELECT source, cast(n AS varchar) AS id, 'p-' || cast(n AS varchar) AS key FROM feed WHERE n % 4 <> 1")
def x7_match_by_code(spark, d):
    return _matched(spark, d).drop("method")


def _products(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("producer"), F.concat(F.lit("C"), (F.col("p_partkey") % 50).cast("string")).alias("collection"))


@query()
def x8_match_by_name(spark, d):
    return feeds.match_by_name(_products(spark, d), _items(spark, d))


@query()
def x9_x10_match_report(spark, d):
    return feeds.match_report(feeds.match_all(_products(spark, d), _keys(spark, d), _items(spark, d)))


def _consensus(spark, d):
    p = _pairs_of(spark, d)
    votes = feeds.rescaled(p.select("source", "key", "id", "attr", F.col("theirs").alias("num"), "method"), _factors(spark, d))
    return feeds.consensus(votes)


CON = FD + """, votes AS (SELECT cast(n AS varchar) AS id, n, source, width * CASE WHEN source = 'S2' THEN 0.1 ELSE 1.0 END AS num FROM feed WHERE n % 4 <> 1), mid AS (SELECT id, n, median(num) AS middle, count(*) AS sources FROM votes GROUP BY 1, 2),
con AS (SELECT m.*, bool_and(abs(v.num - m.middle) <= 0.03 * m.middle) AS agreed FROM mid m JOIN votes v ON v.id = m.id GROUP BY ALL), cmp AS (SELECT c.*, p.p_size + 40.0 AS ours FROM con c JOIN part p ON p.p_partkey = c.n)"""


@query(CON + " SELECT id, round(middle, 4) AS middle, sources, agreed FROM con")
def x11_consensus(spark, d):
    return _consensus(spark, d).select("id", F.round("middle", 4).alias("middle"), "sources", "agreed")


def _compared(spark, d):
    ours = _ours(spark, d).where("cast(id as bigint) % 9 <> 0")
    return feeds.compare(_consensus(spark, d), ours, ours.select("id", "attr"))


@query(CON + """ SELECT id, CASE WHEN n % 9 = 0 THEN 'L4-UZUPELNIA' ELSE 'L4-ROZJAZD' END AS rule_id, round(least(0.95, CASE WHEN n % 9 = 0 THEN 0.8 ELSE 0.82 END + 0.05 * (sources - 1)), 4) AS confidence FROM cmp WHERE agreed AND (n % 9 = 0 OR abs(ours - middle) > 0.03 * middle)""")
def x12_compare(spark, d):
    return _compared(spark, d)[0].select("id", "rule_id", "confidence")


@query(CON + " SELECT id, 'zrodla' AS reason, sources FROM cmp WHERE NOT agreed")
def x12_conflicts(spark, d):
    return _compared(spark, d)[1].select("id", "reason", F.size("said").alias("sources"))


@query(oracle("findings") + " SELECT fid, rule_id FROM findings WHERE NOT ((rule_id = 'L1-LUKA-BRAK' OR rule_id LIKE 'L2-LUKA-%') AND attr = 'A3')")
def x13_append(spark, d):
    from shelfwise.operators.findings import emit

    found = view(spark, d, "findings").select("fid", "id", "attr", "rule_id", "old_value")
    new = emit(view(spark, d, "findings").where("attr = 'A3'").select("id").distinct(), "L4-UZUPELNIA", "L4", "srednia", 0.8, attr=F.lit("A3"))
    return feeds.append(found, new.select(F.lit(None).cast("long").alias("fid"), "id", "attr", "rule_id", "old_value")).where("fid is not null").select("fid", "rule_id")


@query(CON + ", s AS (SELECT c.id, string_agg(v.source, ' + ' ORDER BY v.source) AS sources FROM cmp c JOIN votes v ON v.id = c.id WHERE NOT c.agreed GROUP BY c.id) SELECT sources, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, sources LIMIT 10")
def x14_conflict_pairs(spark, d):
    return feeds.conflict_pairs(_compared(spark, d)[1])


def _tabs(spark, d):
    return feeds.recognise(_long(spark, d), _keys(spark, d), table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("producer")))


@query(FD + ", h AS (SELECT source, producer, count(*) AS n FROM feed WHERE n % 4 <> 1 GROUP BY 1, 2) SELECT source, 'kod' AS field, cast(sum(n) AS bigint) AS hits, arg_max(producer, (n, producer)) AS producer, round(max(n) / sum(n), 3) AS share FROM h GROUP BY 1")
def x15_recognise(spark, d):
    return _tabs(spark, d).drop("warning")


def _fields(spark, d):
    long = _long(spark, d)
    key_rec = long.where("field = 'kod'").select("source", "rec", text.norm(F.col("value")).alias("key"))
    return feeds.assign_fields(feeds.numeric_fields(long, _matched(spark, d), key_rec, _ours(spark, d)))


@query(FD + " SELECT source, 'Szerokość' AS attr, 'Szerokość' AS field, CASE WHEN source = 'S2' THEN 0.1 ELSE 1.0 END AS scale FROM z")
def x16_numeric_fields(spark, d):
    return _fields(spark, d).select("source", "attr", "field", "scale")


@query(FD + " SELECT source FROM z")
def x17_recommended(spark, d):
    return feeds.recommended(_tabs(spark, d), _fields(spark, d)).select("source")


# ---- photos: verdicts out of events

VERDICTS = """SELECT event_id AS seq, cast(user_id AS string) AS id, 'A' || cast(event_id % 5 AS string) AS attr, CASE event_id % 7 WHEN 0 THEN 'blad' WHEN 1 THEN 'zgodne' WHEN 2 THEN 'nie_widac' ELSE 'niezgodne' END AS verdict,
CASE WHEN event_id % 5 = 0 THEN '' ELSE 'W' || cast(event_id % 4 AS string) END AS read, cast(0.5 + (event_id % 5) / 10.0 AS double) AS confidence, event_id % 900 AS tokens_in, event_id % 70 AS tokens_out, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'big' END AS model FROM events WHERE event_id % 6 = 0"""
V = oracle("findings", "people") + f", verdicts AS ({VERDICTS})"


def _verdicts(spark, d):
    return spark.sql(VERDICTS.replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))


PRICES = {"base": (1.0, 4.0), "big": (2.0, 8.0)}


@query(V + " SELECT DISTINCT f.id, f.attr FROM findings f JOIN people p ON p.id = f.id AND p.photo <> '' WHERE f.confidence < 0.85 AND f.attr IN ('A1', 'A2', 'A3') AND NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.id = f.id AND v.attr = f.attr AND v.verdict <> 'blad')")
def v1_candidates(spark, d):
    return photos.candidates(view(spark, d, "findings"), view(spark, d, "people"), _verdicts(spark, d), visible=("A1", "A2", "A3")).select("id", "attr")


GALLERY = "SELECT cast(p_partkey AS string) AS id, k AS pos, CASE (p_partkey + k) % 13 WHEN 0 THEN 'Wnętrze szafy – otwarte' WHEN 1 THEN 'Zamknięty - front' WHEN 2 THEN 'Rysunek techniczny' WHEN 3 THEN 'Inne' WHEN 4 THEN 'Otwarty - front' WHEN 5 THEN 'Widok z boku' WHEN 6 THEN 'Schemat/Infografika' WHEN 7 THEN 'Aranżacja' WHEN 8 THEN 'Przekrój' WHEN 9 THEN 'Tyłem' WHEN 10 THEN 'Szczegóły' WHEN 11 THEN 'Front' ELSE 'Zamknięty' END AS label, 'u' || cast(p_partkey AS string) || '-' || cast(k AS string) AS url FROM part JOIN (VALUES (0), (1), (2)) AS v(k) ON k <= p_partkey % 4"
GA = f"WITH gal AS ({GALLERY}), gk AS (SELECT *, CASE WHEN label IN ('Wnętrze szafy – otwarte', 'Otwarty - front', 'Przekrój') THEN 'interior' WHEN label IN ('Rysunek techniczny', 'Schemat/Infografika') THEN 'drawing' WHEN label IN ('Zamknięty - front', 'Zamknięty', 'Widok z boku', 'Tyłem') THEN 'front' WHEN label IN ('Aranżacja', 'Szczegóły') THEN 'arrangement' ELSE 'other' END AS kind FROM gal), best AS (SELECT id, arg_min(url, (CASE kind WHEN 'front' THEN 1 WHEN 'arrangement' THEN 2 WHEN 'drawing' THEN 3 WHEN 'interior' THEN 4 ELSE 5 END, pos)) AS url FROM gk GROUP BY 1)"


def _gallery(spark, d):
    return spark.sql(GALLERY.replace("FROM part", "FROM {p}"), p=table(spark, d, "part"))


@query(GA + ", f AS (SELECT DISTINCT cast(l_partkey AS varchar) AS id, 'A' || cast(l_linenumber % 3 AS varchar) AS attr FROM lineitem) SELECT f.id, f.attr FROM f WHERE f.attr <> 'A2' AND f.id IN (SELECT id FROM gk) AND (f.attr <> 'A1' OR f.id IN (SELECT id FROM gk WHERE kind = 'interior'))")
def v2_gap_candidates(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.concat(F.lit("A"), (F.col("l_linenumber") % 3).cast("string")).alias("attr"), F.lit("L1-LUKA-BRAK").alias("rule_id"))
    return photos.gap_candidates(f, _gallery(spark, d), spark.sql("SELECT 'A2' AS attr"), ("A1",)).select("id", "attr")


@query(GA + " SELECT * FROM best")
def v3_best_photo(spark, d):
    return photos.best_photo(_gallery(spark, d))


ASKED = "SELECT id, attr FROM gal JOIN (VALUES ('Liczba półek'), ('Liczba szuflad'), ('Styl'), ('Szerokość'), ('Kolor')) AS a(attr) ON pos = 0"


@query(GA + f""", asked AS ({ASKED}), r AS (SELECT a.id, a.attr, g.pos, g.url, g.kind, CASE WHEN attr = 'Liczba półek' AND kind = 'interior' THEN 1 WHEN attr = 'Liczba szuflad' THEN CASE kind WHEN 'interior' THEN 1 WHEN 'front' THEN 2 WHEN 'drawing' THEN 3 END
WHEN attr = 'Styl' THEN CASE kind WHEN 'arrangement' THEN 1 WHEN 'front' THEN 2 END WHEN attr = 'Szerokość' AND kind = 'drawing' THEN 1 END AS rank,
CASE label WHEN 'Otwarty - front' THEN 0 WHEN 'Wnętrze szafy – otwarte' THEN 3 WHEN 'Przekrój' THEN 5 WHEN 'Rysunek techniczny' THEN 0 WHEN 'Schemat/Infografika' THEN 1 WHEN 'Zamknięty - front' THEN 0 WHEN 'Zamknięty' THEN 1 WHEN 'Widok z boku' THEN 3 WHEN 'Tyłem' THEN 4 WHEN 'Aranżacja' THEN 0 WHEN 'Szczegóły' THEN 2 ELSE 0 END AS place FROM asked a JOIN gk g ON g.id = a.id)
SELECT id, attr, arg_min(url, (coalesce(rank, 99), CASE WHEN rank IS NULL THEN 0 ELSE place END, pos)) AS url FROM r GROUP BY id, attr HAVING attr <> 'Liczba półek' OR bool_or(kind = 'interior')""")
def v3_best_photo_of(spark, d):
    g = _gallery(spark, d)
    return photos.best_photo_of(spark.sql(ASKED.replace("FROM gal ", "FROM {g} "), g=g), g)


@query(GA + ", o AS (SELECT g.*, row_number() OVER (PARTITION BY g.id ORDER BY pos, g.url) AS k FROM gk g JOIN best b ON b.id = g.id WHERE g.url <> b.url QUALIFY row_number() OVER (PARTITION BY g.id, kind ORDER BY pos, g.url) = 1) SELECT id, kind, url FROM o WHERE k <= 2")
def v4_extra_photos(spark, d):
    g = _gallery(spark, d)
    return photos.extra_photos(g, photos.best_photo(g)).select("id", "kind", "url")


@query(GA + " SELECT kind, count(*) AS n, count(DISTINCT id) AS products FROM gk GROUP BY 1")
def f37_v4_photo_kinds(spark, d):
    return photos.photo_kinds(_gallery(spark, d))


@query("WITH r AS (SELECT c_custkey, substr(sha1(c_mktsegment || '|q' || cast(c_nationkey AS varchar) || '|v|m'), 1, 16) AS h, c_nationkey FROM customer) SELECT 'hit' AS kind, count(*) AS n FROM r WHERE c_nationkey < 10 UNION ALL SELECT 'miss', count(DISTINCT h) FROM r WHERE c_nationkey >= 10")
def v5_reuse(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("A").alias("attr"), F.col("c_mktsegment").alias("url"), F.concat(F.lit("q"), F.col("c_nationkey").cast("string")).alias("question"), F.lit("v").alias("value"), "c_nationkey")
    cache = r.where("c_nationkey < 10").select(text.question_hash(F.col("url"), F.col("question"), F.col("value"), F.lit("m")).alias("hash"), F.lit("a").alias("answer")).distinct()
    hits, misses = photos.reuse(r, cache, "m")
    return hits.agg(F.count("*").alias("n")).select(F.lit("hit").alias("kind"), "n").unionByName(misses.agg(F.count("*").alias("n")).select(F.lit("miss").alias("kind"), "n"))


READS = ", last AS (SELECT * FROM verdicts WHERE verdict <> 'blad' QUALIFY row_number() OVER (PARTITION BY id, attr ORDER BY seq DESC) = 1), reads AS (SELECT id, attr, read, confidence FROM last WHERE verdict = 'niezgodne' AND read <> '')"


@query(V + READS + " SELECT id, attr, read, round(confidence, 4) AS confidence FROM reads")
def v6_latest_reads(spark, d):
    return photos.latest_reads(_verdicts(spark, d)).withColumn("confidence", F.round("confidence", 4))


@query(V + READS + """, g AS (SELECT f.fid, f.id, f.attr, f.rule_id, f.new_value, r.read FROM findings f LEFT JOIN reads r ON r.id = f.id AND r.attr = f.attr AND r.read IN ('W0', 'W1') WHERE f.rule_id = 'L1-LUKA-BRAK') SELECT id, attr, CASE WHEN read IS NULL THEN 'L1-LUKA-BRAK' ELSE 'L2-LUKA-ZDJECIE' END AS rule_id, lower(read) AS new_value, read IS NOT NULL OR new_value IS NOT NULL AS changed FROM g""")
def v7_rewrite_gaps(spark, d):
    labels = spark.sql("SELECT 'A' || cast(id AS string) AS attr, label FROM range(9) JOIN (VALUES ('w0'), ('w1')) AS t(label)")
    return photos.rewrite_gaps(view(spark, d, "findings"), photos.latest_reads(_verdicts(spark, d)), labels).drop("confidence")


@query(V + ", p AS (SELECT count(*) AS calls, avg(tokens_in) AS i, avg(tokens_out) AS o FROM verdicts WHERE tokens_in > 0) SELECT calls, (SELECT count(*) FROM findings) AS n, round((SELECT count(*) FROM findings) * (i * 1.0 + o * 4.0) / 1e6, 6) AS usd FROM p")
def v8_estimate(spark, d):
    return photos.estimate(_verdicts(spark, d), view(spark, d, "findings").agg(F.count("*").alias("n")), PRICES, "base", "base")


@query(V + " SELECT verdict, attr, count(*) AS n, count(*) FILTER (verdict = 'niezgodne') AS disagree, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, round(sum(CASE WHEN model = 'base' THEN tokens_in + 4.0 * tokens_out ELSE 2.0 * tokens_in + 8.0 * tokens_out END) / 1e6, 6) AS usd FROM verdicts GROUP BY 1, 2")
def v9_statistics(spark, d):
    return photos.statistics(_verdicts(spark, d), PRICES, "base")


@query(V + " SELECT v.attr, v.verdict, v.id, p.name, v.read FROM verdicts v JOIN people p ON p.id = v.id WHERE v.verdict <> 'blad'")
def s19_calibration_sheet(spark, d):
    return photos.calibration_sheet(_verdicts(spark, d), view(spark, d, "people")).drop("rating")


RATED = "SELECT attr, verdict, CASE seq % 4 WHEN 0 THEN 'ok' WHEN 2 THEN 'zle' END AS rating FROM verdicts WHERE verdict <> 'blad'"


@query(V + f", s AS ({RATED}), a AS (SELECT 'all' AS kind, 'all' AS value, rating FROM s UNION ALL SELECT 'attr', attr, rating FROM s UNION ALL SELECT 'verdict', verdict, rating FROM s) SELECT kind, value, count(*) FILTER (rating = 'ok') AS ok, count(*) FILTER (rating = 'zle') AS bad, count(*) FILTER (rating IS NULL) AS unrated, round(count(*) FILTER (rating = 'ok') / nullif(count(rating), 0), 3) AS accuracy FROM a GROUP BY 1, 2")
def v10_calibration(spark, d):
    v = _verdicts(spark, d)
    return photos.calibration(spark.sql(RATED.replace("FROM verdicts", "FROM {v}"), v=v))


@query(oracle("dictionary", "attrs") + ", p AS (SELECT DISTINCT attr, value AS label FROM attrs) SELECT coalesce(d.attr, p.attr) AS attr, coalesce(d.l, p.l) AS answers FROM (SELECT attr, list(DISTINCT label ORDER BY label) AS l FROM dictionary GROUP BY 1) d FULL JOIN (SELECT attr, list(label ORDER BY label) AS l FROM p GROUP BY 1) p ON p.attr = d.attr")
def v11_allowed_answers(spark, d):
    panel = view(spark, d, "attrs").select("attr", F.col("value").alias("label"))
    return photos.allowed_answers(view(spark, d, "dictionary"), panel)


@query(oracle("attrs") + f""", s AS (SELECT cast(p_partkey AS varchar) AS id, unnest(['Szerokość', 'Wysokość', 'Głębokość']) AS attr, unnest([(p_size + 5) / 10.0, cast(p_size + 1 AS double) / 10, NULL]) AS cm FROM part) SELECT s.id, s.attr, {number_text_sql('cm')} AS value FROM s WHERE cm IS NOT NULL AND NOT EXISTS (SELECT 1 FROM attrs a WHERE a.id = s.id AND a.attr = s.attr)""")
def v12_v13_drawing_sizes(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.to_json(F.struct((F.col("p_size") + 5).alias("szerokosc"), (F.col("p_size") + 1).alias("wysokosc"), F.lit("MM").alias("jednostka"), F.lit(0.7).alias("pewnosc"))).alias("answer"))
    return photos.drawing_sizes(a, view(spark, d, "attrs")).drop("confidence")


@query("SELECT cast(event_id AS varchar) AS id, CASE WHEN event_type IN ('zgodne', 'niezgodne') THEN event_type ELSE 'nie_widac' END AS verdict, '' AS read, value AS confidence FROM events")
def f41_clean_verdicts(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(F.col("event_type").alias("werdykt"), F.col("value").alias("pewnosc"))).alias("answer"))
    return photos.clean_verdicts(e)


# ---- upkeep

PANEL = "SELECT p_brand AS attr, cast(p_partkey % 40 AS string) AS pid, p_name || ' ' || cast(p_partkey % 40 AS string) AS label FROM part"


def _panel(spark, d):
    return spark.sql(f"SELECT DISTINCT * FROM ({PANEL.replace('FROM part', 'FROM {p}')})", p=table(spark, d, "part"))


P = f"WITH panel AS (SELECT DISTINCT * FROM ({PANEL}))"


@query(f"WITH c AS (SELECT p_brand AS attr, p_partkey % 40 AS pid, p_name AS label FROM part WHERE p_partkey % 3 > 0) SELECT attr, {norm_sql('label')} AS n, min(label) AS label, list(DISTINCT cast(pid AS varchar) ORDER BY cast(pid AS varchar)) AS ids FROM c GROUP BY 1, 2")
def s9_learn(spark, d):
    cells = table(spark, d, "part").select(F.col("p_brand").alias("attr"), F.when(F.col("p_partkey") % 3 > 0, F.concat((F.col("p_partkey") % 40).cast("string"), F.lit("|"), "p_name")).otherwise("plain").alias("cell"))
    return maintenance.learn(cells)[0]


@query("SELECT o_orderpriority AS attr, cast(o_custkey % 50 AS varchar) AS pid, 'L' || o_orderstatus AS label FROM orders WHERE o_orderkey % 3 = 2 AND o_orderstatus <> 'P'")
def s10_last_snapshot(spark, d):
    s = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("sheet"), F.col("o_orderpriority").alias("attr"), (F.col("o_custkey") % 50).cast("string").alias("pid"), F.when(F.col("o_orderstatus") == "P", "NULL").otherwise(F.concat(F.lit("L"), "o_orderstatus")).alias("label"))
    return maintenance.last_snapshot(s)[0]


@query("WITH x AS (SELECT cast(c_custkey AS varchar) AS pid, c_name AS a, CASE WHEN c_custkey % 6 = 0 THEN 'new ' || c_name WHEN c_custkey % 6 = 1 THEN upper(c_name) ELSE c_name END AS b, c_mktsegment AS attr FROM customer) SELECT attr, pid, a AS old, b AS new FROM x WHERE lower(a) <> lower(b)")
def m1_renames(spark, d):
    c = table(spark, d, "customer")
    new = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("new "), "c_name")).when(F.col("c_custkey") % 6 == 1, F.upper("c_name")).otherwise(F.col("c_name"))
    base = lambda x: c.select(F.col("c_mktsegment").alias("attr"), F.col("c_custkey").cast("string").alias("pid"), x.alias("label"))
    return maintenance.renames(base(F.col("c_name")), base(new))


@query("SELECT 'a' || cast(c_custkey AS varchar) AS old, CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'b' END || cast(c_custkey AS varchar) AS new FROM customer UNION ALL SELECT 'b' || cast(c_custkey AS varchar), 'c' || cast(c_custkey AS varchar) FROM customer WHERE c_custkey % 2 = 0")
def m2_add_renames(spark, d):
    k = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), (F.col("c_custkey") % 2 == 0).alias("even"))
    pair = lambda rows, a, b: rows.select(F.concat(F.lit(a), "k").alias("old"), F.concat(F.lit(b), "k").alias("new"))
    return maintenance.add_renames(pair(k, "a", "b"), pair(k.where("even"), "b", "c"))


@query(P + f" SELECT attr, {norm_sql('left(label, 3)')} AS n, list(DISTINCT pid ORDER BY pid) AS ids FROM panel GROUP BY 1, 2 HAVING count(DISTINCT pid) > 1")
def m4_duplicate_labels(spark, d):
    return maintenance.duplicate_labels(_panel(spark, d).withColumn("label", F.substring("label", 1, 3)))


@query(oracle("attrs") + " SELECT attr, count(*) AS n, min(value) AS example FROM attrs WHERE value IN ('metal, płyta meblowa', 'płyta meblowa, metal', 'drewno, drewno', 'nowoczesny, nowoczesny') GROUP BY 1")
def m5_multi_valued(spark, d):
    return maintenance.multi_valued(view(spark, d, "attrs"), view(spark, d, "dictionary").select("attr", F.col("pos").cast("string").alias("pid"), "label"))


#: The panel's attributes are those that the catalogue uses, and their values the whole single ones that it holds.
CATALOGUE = """, used AS (SELECT attr, count(*) AS n FROM attrs GROUP BY attr), status AS (SELECT attr, CASE WHEN n * 20 >= (SELECT max(n) FROM used) THEN 'ACTIVE' ELSE 'DRAFT' END AS status FROM used),
labels AS (SELECT DISTINCT attr, value AS label FROM attrs WHERE value NOT LIKE '%,%' AND NOT regexp_matches(value, '^[0-9]')), multi AS (SELECT attr FROM attrs WHERE value LIKE '%,%' GROUP BY attr HAVING count(DISTINCT value) > 1)"""


@query(oracle("attrs") + CATALOGUE + f""" SELECT s.attr, s.status, coalesce((SELECT list(DISTINCT label ORDER BY label) FROM labels l WHERE l.attr = s.attr), []) AS labels, s.attr IN (SELECT attr FROM multi) AS multi FROM status s
WHERE {norm_sql('s.attr')} LIKE '%drzwi%' OR EXISTS (SELECT 1 FROM labels l WHERE l.attr = s.attr AND {norm_sql('l.label')} LIKE '%drzwi%')""")
def m6_catalogue(spark, d):
    attrs = view(spark, d, "attrs")
    used = attrs.groupBy("attr").agg(F.count("*").alias("n"))
    status = used.withColumn("most", F.lit(used.agg(F.max("n")).first()[0])).select("attr", F.when(F.col("n") * 20 >= F.col("most"), "ACTIVE").otherwise("DRAFT").alias("status"))
    labels = attrs.where("value not like '%,%'").where(~F.col("value").rlike("^[0-9]")).select("attr", F.col("value").alias("label"))
    multi = attrs.where("value like '%,%'").groupBy("attr").agg(F.countDistinct("value").alias("kinds")).where("kinds > 1")
    return maintenance.catalogue(status, labels, multi, "Drzwi")


@query("SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'SALE' ELSE p_type END AS attr, p_brand AS column_name FROM part")
def m8_current_names(spark, d):
    return maintenance.under_current_names(table(spark, d, "part").select(F.col("p_type").alias("attr"), F.col("p_brand").alias("column_name")), spark.sql("SELECT 'PROMO' AS old, 'SALE' AS new"))


@query("SELECT 'k' || c_mktsegment AS key, list(DISTINCT 'F' || cast(c_nationkey % 7 AS varchar) ORDER BY 'F' || cast(c_nationkey % 7 AS varchar)) AS filters FROM customer WHERE c_custkey % 3 < 2 AND c_mktsegment <> 'MACHINERY' GROUP BY 1")
def s12_filter_seed(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.when(F.col("c_custkey") % 3 == 0, "grupa").when(F.col("c_custkey") % 3 == 1, "kategoria").otherwise("inne").alias("level"), F.lit("pewna").alias("kind"), F.lower("c_mktsegment").alias("category"), F.concat(F.lit("F"), (F.col("c_nationkey") % 7).cast("string")).alias("filter"))
    known = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("site"), F.concat(F.lit("k"), "c_mktsegment").alias("key")).distinct()
    return maintenance.filter_seed(rows, known)[0]


# ---- sources

@query(oracle("products", "attrs") + """, m AS (SELECT id, count(*) AS n FROM attrs GROUP BY 1) SELECT p.id, p.name, p.category AS type, coalesce(m.n, 0) AS n_attrs, ('K' || p.id) AS code, CASE WHEN p.photo = '' THEN 0 ELSE 1 END AS n_photos FROM products p LEFT JOIN m ON m.id = p.id""")
def s1_catalogue(spark, d):
    packed = view(spark, d, "attrs").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "attr", "value"))), " | ").alias("Atrybuty"))
    p = view(spark, d, "products").join(packed, "id", "left")
    rows = p.select(F.col("id").alias("ID"), F.col("name").alias("Nazwa"), F.col("producer").alias("Producent"), F.col("category").alias("Kategoria"), "Atrybuty", F.concat(F.lit("K"), "id").alias("SKU"), F.when(F.col("photo") != "", F.concat(F.lit("Front: "), "photo")).alias("Zdjęcia"))
    readers.save_csv(rows, path := f"{tables.shared_dir(spark)}/export-{uuid.uuid4().hex}")
    c = readers.read_catalogue(spark, path)
    return c.select("id", "name", "type", F.size("attributes").cast("long").alias("n_attrs"), F.col("codes")["sku"].alias("code"), F.size("photos").alias("n_photos"))


@query(oracle("products") + " SELECT id, CASE WHEN n % 3 = 0 THEN category WHEN n % 2 = 0 THEN 'T' || cast(n % 5 AS varchar) END AS type FROM products")
def s2_side_file(spark, d):
    p = view(spark, d, "products")
    side = p.where("n % 2 = 0").select(F.col("id").alias("short_id"), F.concat(F.lit("T"), (F.col("n") % 5).cast("string")).alias("type"), F.lit("s").alias("subtype"))
    side.write.csv(path := f"{tables.shared_dir(spark)}/side-{uuid.uuid4().hex}", header=True, sep=";")
    return readers.with_side_file(p.select("id", F.when(F.col("n") % 3 == 0, F.col("category")).otherwise(" ").alias("type"), "subtype"), readers.read_side_file(spark, path)).select("id", "type")


@query("SELECT field, count(*) AS n, count(*) FILTER (value = '') AS blank FROM (SELECT unnest(['s_name', 's_acctbal']) AS field, unnest([s_name, cast(s_acctbal AS varchar)]) AS value FROM supplier) GROUP BY 1")
def s3_csv_feed(spark, d):
    table(spark, d, "supplier").select("s_name", "s_acctbal").write.csv(path := f"{tables.shared_dir(spark)}/feed-{uuid.uuid4().hex}", header=True)
    long = readers.read_csv_feed(spark, path, "S")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("blank"))


@query("SELECT cast(event_id AS varchar) AS source, 'k' AS field, regexp_extract(props, '(\\d+)', 1) AS value FROM events WHERE props LIKE '{\"k\": %'")
def s4_json_feed(spark, d):
    docs = table(spark, d, "events").select(F.col("event_id").cast("string").alias("source"), F.concat(F.lit('{"short": [], "items": ['), "props", F.lit('], "n": 1}')).alias("json"))
    return readers.json_records(docs).select("source", "field", "value")


XML = "'<shop><offers><offer id=\"' || c_custkey || '\"><name>' || c_name || '</name><attrs><attr name=\"W\">5</attr><attr>6</attr><attr>7</attr></attrs></offer><offer id=\"x\"><name>n</name></offer></offers></shop>'"


def _xml(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source"), F.expr(XML).alias("xml"))


@query("""SELECT cast(c_custkey AS varchar) AS source, unnest([0, 0, 0, 0, 0, 1, 1]) AS rec, unnest(['@id', 'name', 'attrs.attr:W', 'attrs.attr', 'attrs.attr[2]', '@id', 'name']) AS field, unnest([cast(c_custkey AS varchar), c_name, '5', '6', '7', 'x', 'n']) AS value FROM customer""")
def s5_xml_feed(spark, d):
    return readers.xml_records(_xml(spark, d), "offer").withColumn("rec", F.col("rec").cast("int"))


@query("SELECT cast(c_custkey AS varchar) AS doc, 'offer' AS tag FROM customer")
def s6_record_tag(spark, d):
    return readers.record_tag(readers.xml_elements(_xml(spark, d).withColumnRenamed("source", "doc")))


@query("SELECT page_id, 'xml' AS format FROM pages UNION ALL SELECT event_id, 'json' FROM events UNION ALL SELECT c_custkey, 'csv' FROM customer")
def s7_sniff(spark, d):
    part = lambda t, k, c: table(spark, d, t).select(F.col(k).alias("page_id"), F.col(k).cast("string").alias("path"), F.encode(F.concat(F.lit(" \n"), c), "UTF-8").alias("content"))
    files = part("pages", "page_id", "html").unionByName(part("events", "event_id", "props")).unionByName(part("customer", "c_custkey", "c_name"))
    return readers.sniff(files).select(F.col("path").cast("long").alias("page_id"), "format")


@query("""SELECT c_mktsegment AS source, unnest(['name', 'nation']) AS field, unnest([c_name, CASE WHEN c_custkey % 2 = 0 THEN cast(c_nationkey AS varchar) ELSE '' END]) AS value FROM customer""")
def s8_sheet_records(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_mktsegment").alias("tab"), (F.col("c_custkey") + 1).alias("row_no"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_name", F.col("c_nationkey").cast("string"))).otherwise(F.array("c_name")).alias("cells"))
    heads = c.select(F.col("c_mktsegment").alias("tab"), F.lit(0).cast("long").alias("row_no"), F.array(F.lit("name "), F.lit("nation"), F.lit("")).alias("cells")).distinct()
    return readers.sheet_records(rows.unionByName(heads)).select("source", "field", "value")


@query(FD + " SELECT source, count(*) * 5 AS rows, count(*) FILTER (n % 2 = 0) * 0 AS mined FROM feed GROUP BY 1")
def s23_mined(spark, d):
    long = readers.mined(_long(spark, d))
    return long.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("field").contains("»")).alias("mined"))


#: A feed of each brand, by its number: XML, JSON, CSV, XML that breaks off, and tabs of XML, JSON and a table.
LINE = "'wymiary: ' || cast(p_size * 10 + 600 AS string) || 'x' || cast(p_size * 10 + 1000 AS string) || 'x400 mm'"
MIXED = f"SELECT replace(p_brand, '#', '') AS source, p_partkey AS n, p_name AS name, {LINE} AS desc, cast(replace(p_brand, 'Brand#', '') AS int) % 7 AS kind FROM part"


def _documents(spark, d):
    p = spark.sql(MIXED.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    fields = {"id": F.col("n").cast("string"), "name": F.col("name"), "desc": F.col("desc")}
    tag = lambda name, *inside: F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name}>"))
    as_xml = tag("offer", *(tag(k, c) for k, c in fields.items()))
    as_json = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    as_csv = F.concat_ws(";", *(F.concat(F.lit('"'), c, F.lit('"')) for c in fields.values()))
    return p.select("source", "n", "kind", *(c.alias(k) for k, c in (("xml", as_xml), ("json", as_json), ("csv", as_csv))), F.array(*fields.values()).alias("cells"))


def _mixed(spark, d):
    p = tables.written(_documents(spark, d), "documents")
    whole = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), by)
    kind = F.col("kind")
    body = F.when(kind == 0, F.concat(F.lit('<?xml version="1.0"?><feed><shop/>'), whole("xml", "\n"), F.lit("</feed>"))).when(kind == 1, F.concat(F.lit('{"meta": [1], "items": ['), whole("json", ","), F.lit("]}")))
    body = body.when(kind == 2, F.concat(F.lit("id;name;desc\n"), whole("csv", "\n"))).when(kind == 3, F.concat(F.lit("<feed>"), whole("xml", ""), F.lit("<offer>")))
    made = p.where("kind < 4").groupBy("source", "kind").agg(body.alias("text")).select("source", "text")
    made.repartition("source").write.partitionBy("source").text(at := f"{tables.shared_dir(spark)}/mixed-{uuid.uuid4().hex}")
    cells = p.where("kind >= 4").select(F.col("source").alias("tab"), F.col("n").alias("row_no"), F.when(kind == 4, F.array("xml")).when(kind == 5, F.array("json")).otherwise(F.col("cells")).alias("cells"))
    heads = p.where("kind = 6").select(F.col("source").alias("tab"), F.lit(-1).cast("long").alias("row_no"), F.array(F.lit("id"), F.lit("name"), F.lit("desc"), F.lit("")).alias("cells")).distinct()
    return mixed.scan(mixed.files(spark, at, "source=([^/]+)/"), cells.unionByName(heads))


@query(f"""WITH m AS ({MIXED}), f AS (SELECT source, kind, unnest(['id', 'name', 'desc', 'desc » wymiar 1', 'desc » wymiar 2', 'desc » wymiar 3']) AS field, unnest([cast(n AS varchar), name, "desc", split_part(split_part("desc", ' ', 2), 'x', 1), split_part(split_part("desc", ' ', 2), 'x', 2), '400']) AS value FROM m),
v AS (SELECT source, field, CASE WHEN field LIKE '%»%' THEN cast(cast(value AS integer) // 10 AS varchar) ELSE value END AS value FROM f)
SELECT source, field, count(*) AS n, min(value) AS low, max(value) AS high FROM v GROUP BY ALL UNION ALL SELECT source, '!error', 1, 'broken', 'broken' FROM m WHERE kind = 3 GROUP BY source""")
def s8_s23_mixed_sources(spark, d):
    """Files and tabs of all formats in one scan, with what their descriptions hold; feeds that break off keep what came before."""
    long = _mixed(spark, d)
    value = F.when(F.col("field") == "!error", "broken").otherwise(F.col("value"))
    return long.groupBy("source", "field").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
