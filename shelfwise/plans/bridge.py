"""Catalogue tables out of the driver's star schema.

Each view is one SELECT that Spark and the oracle's engine both read, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRODUCTS = """
SELECT cast(p_partkey AS string) AS id,
       p_name || CASE p_partkey % 12 WHEN 0 THEN ' 3-drzwiowa z 2 szufladami' WHEN 1 THEN ' dwudrzwiowa' WHEN 2 THEN ' z szufladą' WHEN 3 THEN ' bez drzwi'
              WHEN 4 THEN ' 2d1w3s' WHEN 5 THEN ' ' || cast(10 + p_size AS string) || 'x' || cast(100 + p_partkey % 90 AS string)
              WHEN 6 THEN ' śr. ' || cast(30 + p_size AS string) WHEN 7 THEN ' z szufladami' WHEN 8 THEN ' 80 cm AB12X' ELSE '' END AS name,
       p_brand AS producer, 'C' || cast(p_partkey % 50 AS string) AS collection, p_type AS category,
       CASE WHEN p_partkey % 37 = 0 THEN '' ELSE 'https://img/' || cast(p_partkey AS string) END AS photo,
       CASE p_partkey % 3 WHEN 0 THEN 'stojąca' WHEN 1 THEN 'wisząca' ELSE 'narożna' END AS subtype,
       p_partkey AS n, p_size AS size, p_retailprice AS price
FROM part"""

#: Long attributes, with a defect for some keys of each kind.
ATTRS = """
SELECT cast(p_partkey AS string) AS id, 'Szerokość' AS attr,
       CASE WHEN p_partkey % 17 = 0 THEN '12, 12' WHEN p_partkey % 19 = 0 THEN '12, 13' WHEN p_partkey % 23 = 0 THEN 'szeroka'
            WHEN p_partkey % 29 = 0 THEN cast(p_size * 10 + 400 AS string) ELSE cast(p_size + 40 AS string) || CASE WHEN p_partkey % 2 = 0 THEN ' cm' ELSE '' END END AS value
FROM part WHERE p_partkey % 31 <> 0
UNION ALL SELECT cast(p_partkey AS string), 'Wysokość', cast(p_size + 60 AS string) || ',5' FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT cast(p_partkey AS string), 'Głębokość', cast(30 + p_partkey % 40 AS string) FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT cast(p_partkey AS string), 'Materiał',
       CASE p_partkey % 9 WHEN 0 THEN 'drewno' WHEN 1 THEN 'Drewno' WHEN 2 THEN 'drewno, drewno' WHEN 3 THEN 'metal, płyta meblowa' WHEN 4 THEN 'płyta meblowa, metal'
            WHEN 5 THEN 'mdf' WHEN 6 THEN 'drewnoo' WHEN 7 THEN 'szkło' ELSE 'kamień dziwny' END FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT cast(p_partkey AS string), 'Styl', CASE p_partkey % 5 WHEN 0 THEN 'nowoczesny, nowoczesny' WHEN 1 THEN 'Nowoczesny' WHEN 2 THEN 'klasyczny' WHEN 3 THEN 'skandynawski' ELSE 'loftt' END FROM part WHERE p_partkey % 13 <> 0
UNION ALL SELECT cast(p_partkey AS string), 'Liczba szuflad', CASE p_partkey % 4 WHEN 0 THEN 'bez szuflad' WHEN 1 THEN '1 szuflada' WHEN 2 THEN '2 szuflady' ELSE '4 i więcej' END FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT cast(p_partkey AS string), 'Liczba drzwi', CASE p_partkey % 3 WHEN 0 THEN '2-drzwiowe' WHEN 1 THEN '3-drzwiowe' ELSE 'bez drzwi' END FROM part WHERE p_partkey % 6 < 4
UNION ALL SELECT cast(p_partkey AS string), 'stary klucz', 'x' FROM part WHERE p_partkey % 41 = 0"""

COMPONENTS = """
SELECT cast(p_partkey AS string) AS id, 'Szerokość' AS attr, cast(p_size + 40 + CASE WHEN p_partkey % 10 = 0 THEN 25 ELSE 0 END AS string) AS value FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT cast(p_partkey AS string), 'Materiał', CASE p_partkey % 4 WHEN 0 THEN 'metal' WHEN 1 THEN 'drewno' ELSE 'metal, płyta meblowa, szkło' END FROM part WHERE p_partkey % 5 < 3
UNION ALL SELECT cast(p_partkey AS string), 'Kolor', 'biały' FROM part WHERE p_partkey % 8 = 0
UNION ALL SELECT cast(p_partkey AS string), 'Nieznany', 'q' FROM part WHERE p_partkey % 16 = 0"""

DICTIONARY = """
SELECT * FROM (VALUES ('Materiał', 0, 'drewno'), ('Materiał', 1, 'metal'), ('Materiał', 2, 'płyta meblowa'), ('Materiał', 3, 'szkło'), ('Materiał', 4, 'płyta MDF'),
  ('Styl', 0, 'nowoczesny'), ('Styl', 1, 'klasyczny'), ('Styl', 2, 'skandynawski'), ('Styl', 3, 'loft'),
  ('Liczba szuflad', 0, 'bez szuflad'), ('Liczba szuflad', 1, '1 szuflada'), ('Liczba szuflad', 2, '2 szuflady'), ('Liczba szuflad', 3, '4 i więcej'),
  ('Liczba drzwi', 0, 'bez drzwi'), ('Liczba drzwi', 1, '1-drzwiowe'), ('Liczba drzwi', 2, '2-drzwiowe'), ('Liczba drzwi', 3, '3-drzwiowe')) AS t(attr, pos, label)"""
ALIASES = "SELECT * FROM (VALUES ('Materiał', 'mdf', 'płyta MDF'), ('Styl', 'industrialny', 'loft')) AS t(attr, alias, label)"
KINDS = "SELECT * FROM (VALUES ('Szerokość', 'liczba'), ('Wysokość', 'liczba'), ('Głębokość', 'liczba'), ('Materiał', 'multi_enum'), ('Styl', 'enum'), ('Liczba szuflad', 'enum'), ('Liczba drzwi', 'enum')) AS t(attr, kind)"

FINDINGS = """
SELECT event_id AS fid, cast(user_id AS string) AS id, 'A' || cast(event_id % 9 AS string) AS attr,
       CASE event_type WHEN 'click' THEN 'L1-ZAPIS' WHEN 'view' THEN 'L2-OUTLIER' WHEN 'error' THEN 'L2-LUKA-NAZWA' WHEN 'purchase' THEN 'L1-LUKA-BRAK' ELSE 'L0-KONFLIKT' END AS rule_id,
       CASE event_id % 3 WHEN 0 THEN 'krytyczna' WHEN 1 THEN 'srednia' ELSE 'info' END AS severity,
       cast(round((event_id * 7 % 101) / 100.0, 2) AS double) AS confidence,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'v' || cast(event_id % 13 AS string) END AS old_value,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'w' || cast(event_id % 6 AS string) END AS new_value,
       'L' || cast(event_id % 5 AS string) AS layer, 'G' || cast(event_id % 997 AS string) AS grp, ts
FROM events"""

#: Products whose components the shop has cut off, and categories that are no furniture.
CUT_OFF = "SELECT cast(p_partkey AS string) AS id FROM part WHERE p_partkey % 21 = 0"
OTHER_CATEGORIES = "SELECT 'PROMO' AS category"

#: A log: later rows of a key replace earlier ones.
DECISIONS = """
SELECT event_id AS seq, cast(user_id AS string) AS id, 'A' || cast(event_id % 9 AS string) AS attr,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'v' || cast(event_id % 13 AS string) END AS old_value,
       CASE event_id % 4 WHEN 1 THEN 'falszywy_alarm' WHEN 2 THEN 'odlozona' ELSE 'zastosowana' END AS status,
       'w' || cast(event_id % 6 AS string) AS new_value, ts,
       CASE WHEN event_id % 3 = 0 THEN cast(event_id % 40 AS bigint) ELSE NULL END AS batch_id
FROM events WHERE event_id % 2 = 0"""

PEOPLE = """
SELECT cast(c_custkey AS string) AS id, c_name AS name, 'P' || cast(c_nationkey AS string) AS producer, c_mktsegment AS category,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'https://img' END AS photo, cast(c_nationkey AS int) AS node
FROM customer"""

VIEWS = {"products": PRODUCTS, "attrs": ATTRS, "components": COMPONENTS, "dictionary": DICTIONARY, "aliases": ALIASES, "kinds": KINDS, "findings": FINDINGS, "decisions": DECISIONS, "people": PEOPLE, "cut_off": CUT_OFF, "others": OTHER_CATEGORIES}
SOURCES = {"products": "part", "attrs": "part", "components": "part", "findings": "events", "decisions": "events", "people": "customer", "cut_off": "part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame of the tables in sf_dir."""
    source, sql = SOURCES.get(name), VIEWS[name]
    if not source:
        return spark.sql(sql)
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(*names: str) -> str:
    """The views as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(translate(coalesce({x}, ''), 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ')), '[^\\p{{L}}\\p{{N}}_\\s./x-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def number_sql(x: str) -> str:
    t = f"trim(regexp_replace(trim({x}), '\\s*(cm|mm|m|kg|g)\\s*$', '', 'i'))"
    return f"CASE WHEN length({t}) - length(translate({t}, ',.', '')) <= 1 AND regexp_full_match(replace({t}, ',', '.'), '-?\\d+(\\.\\d+)?') THEN cast(replace({t}, ',', '.') AS double) END"


def number_text_sql(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN cast(cast({x} AS bigint) AS varchar) ELSE regexp_replace(cast(round({x}, 4) AS varchar), '\\.?0+$', '') END"
