"""The import from a file to findings, as a stream: queries over the catalogue written as an export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.plans import jobs, more
from shelfwise.plans.bridge import oracle, view
from shelfwise.plans.cells import PANEL, RULES
from shelfwise.plans.registry import query
from shelfwise.sources import log, readers, tables
from shelfwise.streaming import arrivals

COLUMNS = ["id", "nazwa", "producent", "kolekcja", "zdjecie", "typ", "podtyp", "atrybuty", "atrybuty-skladowe", "omit_components_in_attributes"]
#: The shop's types, and a tree in which one type has a node of its own below it.
TYPES = "SELECT 'Economy' AS type, 'tanie' AS key"
NODES = "SELECT * FROM (VALUES (1, 'Meble', 0, 1, false), (2, 'ECONOMY', 1, 2, false), (3, 'Meble stojące', 2, 3, false), (4, 'STANDARD', 1, 4, false), (5, 'MEDIUM', 1, 5, true)) AS t(node, name, level, pos, hidden)"
SENT = "SELECT row_number() OVER (ORDER BY id) AS seq, id, 'Materiał' AS attr, 'drewnoo' AS old_value, 'zastosowana' AS status, 'drewno' AS new_value, cast('2026-01-01' AS timestamp) AS ts, cast(1 AS bigint) AS batch_id FROM {products} WHERE n % 9 IN (0, 5, 6)"


def export(spark, d):
    """The catalogue as rows of an export."""
    packed = lambda name, to: view(spark, d, name).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "attr", "value"))), " | ").alias(to))
    p = view(spark, d, "products").join(packed("attrs", "atrybuty"), "id", "left").join(packed("components", "atrybuty-skladowe"), "id", "left").join(view(spark, d, "cut_off").withColumn("cut", F.lit("1")), "id", "left")
    kind = F.when(F.col("n") % 4 == 0, F.col("category")).when(F.col("n") % 4 == 1, "inne").otherwise("")
    return p.select("id", F.col("name").alias("nazwa"), F.col("producer").alias("producent"), F.col("collection").alias("kolekcja"), F.col("photo").alias("zdjecie"), kind.alias("typ"), F.col("subtype").alias("podtyp"), "atrybuty", "atrybuty-skladowe", F.coalesce("cut", F.lit("")).alias("omit_components_in_attributes"))


def config(spark, d):
    sent = spark.sql(SENT, products=view(spark, d, "products"))
    return {
        "types": spark.sql(TYPES), "name_rules": spark.sql(RULES), "nodes": spark.sql(NODES),
        "pair_aliases": spark.sql("SELECT 'STANDARD' AS type, 'narożna' AS subtype, 1 AS node"), "type_aliases": spark.sql("SELECT 'x' AS type, 1 AS node WHERE false"), "excluded": spark.sql("SELECT 'inne' AS type"),
        "kinds": view(spark, d, "kinds"), "dictionary": view(spark, d, "dictionary"), "aliases": view(spark, d, "aliases"), "panel": spark.sql(PANEL),
        "junk": spark.sql("SELECT 'stary klucz' AS attr, 'old' AS reason"), "disabled_rules": spark.sql("SELECT 'L2-DUPLIKAT' AS rule_id"), "disabled_attrs": spark.sql("SELECT 'x' AS attr WHERE false"),
        "node_filters": spark.sql("SELECT * FROM (VALUES (2, 'Kolor'), (3, 'Kolor')) AS t(node, attr)"), "category_filters": spark.sql(more.FILTERS),
        "decisions": sent, "batches": spark.sql("SELECT cast(1 AS bigint) AS batch_id, cast('2026-01-02' AS timestamp) AS created"), "withdrawn": spark.sql("SELECT cast(0 AS bigint) AS batch_id WHERE false"), "taken_at": spark.sql("SELECT cast('2026-02-01' AS timestamp) AS taken_at"),
    }


def imported(spark, d) -> log.Runs:
    """Written as files, taken by the stream, and the first batch again as after a lost driver."""
    at = f"{tables.shared_dir(spark)}/import-{uuid.uuid4().hex}"
    readers.save_csv(export(spark, d).coalesce(1), f"{at}/in")
    own = config(spark, d)
    arrivals.imports(spark, f"{at}/in", COLUMNS, f"{at}/offsets", own, f"{at}/runs").awaitTermination()
    jobs.import_products(readers.read_catalogue(spark, f"{at}/in"), own, f"{at}/runs", 0)
    return log.Runs(spark, f"{at}/runs")


@query(oracle("products", "attrs", "components", "cut_off") + """, typed AS (SELECT *, CASE n % 4 WHEN 0 THEN category WHEN 1 THEN 'inne' ELSE '' END AS type FROM products),
placed AS (SELECT *, CASE WHEN type = 'ECONOMY' THEN 'tanie' WHEN regexp_matches(name, '\\bring') THEN 'pierscien' WHEN regexp_matches(name, '\\bgadget|widget') THEN 'przyrzad' WHEN regexp_matches(name, '\\bsmall') THEN 'maly' ELSE 'nieznana' END AS shop,
 CASE WHEN type = 'STANDARD' AND subtype = 'narożna' THEN 1 WHEN type = 'ECONOMY' THEN CASE subtype WHEN 'stojąca' THEN 3 ELSE 2 END WHEN type = 'STANDARD' THEN 4 END AS node FROM typed),
enough AS (SELECT id FROM attrs WHERE trim(value) <> '' GROUP BY id HAVING count(DISTINCT attr) >= 3),
gap AS (SELECT p.id, 'Kolor' AS attr FROM placed p JOIN enough USING (id) WHERE p.node IN (2, 3) AND NOT EXISTS (SELECT 1 FROM components c WHERE c.id = p.id AND c.attr = 'Kolor' AND c.id NOT IN (SELECT id FROM cut_off))),
found AS (SELECT 'L1-BRAK-ZDJECIA' AS rule FROM placed JOIN enough USING (id) WHERE photo = '' UNION ALL SELECT 'L1-KLUCZ-SMIEC' FROM attrs JOIN enough USING (id) WHERE attr = 'stary klucz' UNION ALL SELECT 'L1-LUKA-BRAK' FROM gap),
sent AS (SELECT p.id, a.value FROM products p LEFT JOIN attrs a ON a.id = p.id AND a.attr = 'Materiał' WHERE p.n % 9 IN (0, 5, 6))
SELECT 'runs' AS kind, '0' AS key, count(*) AS n FROM products UNION ALL SELECT 'category', shop, count(*) FROM placed GROUP BY shop UNION ALL SELECT 'node', coalesce(cast(node AS varchar), 'none'), count(*) FROM placed GROUP BY 2
UNION ALL SELECT 'rule', rule, count(*) FROM found GROUP BY rule
UNION ALL SELECT 'sent', CASE value WHEN 'drewno' THEN 'weszlo' WHEN 'mdf' THEN 'inna_wartosc' WHEN 'drewnoo' THEN 'bez_zmian' ELSE 'brak_atrybutu' END, count(*) FROM sent GROUP BY 2""")
def s24_import(spark, d):
    """Runs and products, categories, nodes, findings of rules whose definition is short in SQL, and the states of sent corrections."""
    runs = imported(spark, d)
    products, found, sent = (runs.table(t) for t in ("products", "findings", "verified"))
    part = lambda rows, kind, key: rows.groupBy(F.lit(kind).alias("kind"), key.alias("key")).agg(F.count("*").alias("n"))
    out = part(products, "runs", F.col("run_id").cast("string")).unionByName(part(products, "category", F.col("category"))).unionByName(part(products, "node", F.coalesce(F.col("node").cast("string"), F.lit("none"))))
    gaps = (F.col("rule_id") == "L1-LUKA-BRAK") & (F.col("attr") == "Kolor")
    out = out.unionByName(part(found.where(F.col("rule_id").isin("L1-BRAK-ZDJECIA", "L1-KLUCZ-SMIEC") | gaps), "rule", F.col("rule_id")))
    return out.unionByName(part(sent, "sent", F.col("state")))
