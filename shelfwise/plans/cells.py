"""Queries of the column functions, the dictionary and the detectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import detect, dictionary, quantiles
from shelfwise.operators import findings as fs
from shelfwise.plans.bridge import norm_sql, number_sql, number_text_sql, oracle, table, view
from shelfwise.plans.registry import query
from shelfwise.sources import tables

OUT = "id, attr, rule_id, layer, severity, confidence, old_value, new_value, grp"


def seen(found):
    """A finding without its evidence, which is for reading only."""
    return found.drop("evidence").withColumn("confidence", F.round("confidence", 4))


@query(f"SELECT doc_id, {norm_sql('text')} AS norm_text, length({norm_sql('text')}) AS n FROM documents")
def f2_norm(spark, d):
    n = text.norm(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("norm_text"), F.length(n).cast("long").alias("n"))


@query(oracle("attrs") + f" SELECT id, attr, value, {number_sql('value')} AS num FROM attrs")
def f3_number(spark, d):
    return view(spark, d, "attrs").select("id", "attr", "value", text.number(F.col("value")).alias("num"))


@query(oracle("products") + r""", d AS (SELECT id, name, regexp_extract(name, '(\d{2,3})\s*[x×]\s*(\d{2,3})', 1) AS a, regexp_extract(name, '(\d{2,3})\s*[x×]\s*(\d{2,3})', 2) AS b, regexp_extract(name, 'śr\. (\d{2,3})', 1) AS f FROM products)
SELECT id, try_cast(a AS double) AS a, try_cast(b AS double) AS b, try_cast(f AS double) AS diameter FROM d""")
def f4_dimensions(spark, d):
    return view(spark, d, "products").select("id", text.dimensions(F.col("name")).alias("x")).select("id", "x.a", "x.b", "x.diameter")


PART_N = f"n0 AS (SELECT id, {norm_sql('name')} AS t FROM products)"
PARTS_SQL = PART_N + r""", n1 AS (SELECT id, t, try_cast(regexp_extract(t, '(\d+)\s*-?\s*drzwiow', 1) AS integer) AS dd, try_cast(regexp_extract(t, '(\d+)\s*-?\s*szuflad', 1) AS integer) AS ds,
CASE WHEN t LIKE '%jednodrzwiow%' THEN 1 WHEN t LIKE '%dwudrzwiow%' THEN 2 WHEN t LIKE '%trzydrzwiow%' THEN 3 WHEN t LIKE '%czterodrzwiow%' THEN 4 WHEN t LIKE '%pieciodrzwiow%' THEN 5 WHEN t LIKE '%szesciodrzwiow%' THEN 6 END AS wd,
list_filter(string_split(t, ' '), lambda z: regexp_full_match(z, '(\d+d)?(\d+w)?(\d+s)?') AND regexp_matches(z, '\d'))[1] AS code FROM n0),
n2 AS (SELECT *, CASE WHEN dd <= 20 THEN dd END AS a, CASE WHEN ds <= 20 THEN ds END AS b, regexp_matches(t, '\bz szuflad(a|ka|ami)?\b') AS has, regexp_matches(t, '\bz szuflad(a|ka)\b') AS single FROM n1),
parts AS (SELECT id, coalesce(a, wd, CASE WHEN regexp_matches(t, '\bbez drzwi\b') THEN 0 END, try_cast(regexp_extract(code, '(\d+)d', 1) AS integer)) AS doors,
coalesce(b, CASE WHEN has AND single THEN 1 END, CASE WHEN regexp_matches(t, '\bbez szuflad\b') THEN 0 END, try_cast(regexp_extract(code, '(\d+)s', 1) AS integer)) AS drawers, has AND b IS NULL AND NOT single AS has_drawers FROM n2)"""


@query(oracle("products") + ", " + PARTS_SQL + " SELECT id, doors, drawers, has_drawers FROM parts")
def f5_part_counts(spark, d):
    return view(spark, d, "products").select("id", text.part_counts(F.col("name")).alias("x")).select("id", "x.doors", "x.drawers", "x.has_drawers")


@query(oracle("products") + f""" SELECT base, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({norm_sql('name')}, '(\\d{{2,3}})\\s*x\\s*(\\d{{2,3}})', ' ', 'g'), '\\b\\d+\\s*(cm|mm|kg)\\b', ' ', 'g'), '\\b\\d{{2,}}\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS base FROM products) GROUP BY base""")
def f6_base_name(spark, d):
    return view(spark, d, "products").groupBy(text.base_name(F.col("name")).alias("base")).agg(F.count("*").alias("n"))


PACKED = "SELECT id, string_agg(attr || ' : ' || value, ' | ' ORDER BY attr) || ' | junk | Szerokość: 99' AS line FROM attrs GROUP BY id"


@query(oracle("attrs") + " SELECT id, attr AS key, value FROM attrs WHERE attr <> 'Szerokość' UNION ALL SELECT DISTINCT id, 'Szerokość', '99' FROM attrs")
def f7_packed(spark, d):
    lines = view(spark, d, "attrs").groupBy("id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attr", "value"))), lambda x: F.concat(x["attr"], F.lit(" : "), x["value"])), " | "), F.lit(" | junk | Szerokość: 99")).alias("line"))
    return lines.select("id", F.inline(text.packed(F.col("line"))))


@query("SELECT c_custkey, substr(sha1(c_mktsegment), 1, 12) AS h, substr(sha1(c_name || '|' || c_mktsegment || '||m'), 1, 16) AS q FROM customer")
def f10_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.value_hash(F.col("c_mktsegment")).alias("h"), text.question_hash(F.col("c_name"), F.col("c_mktsegment"), F.lit(None).cast("string"), F.lit("m")).alias("q"))


@query(oracle("attrs") + f" SELECT id, attr, value, CASE WHEN {norm_sql('value')} LIKE 'bez%' THEN 0 ELSE try_cast(regexp_extract({norm_sql('value')}, '^(\\d+)', 1) AS integer) END AS n FROM attrs WHERE attr LIKE 'Liczba%'")
def f12_count_in_label(spark, d):
    return view(spark, d, "attrs").where("attr like 'Liczba%'").select("id", "attr", "value", text.count_in_label(F.col("value")).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN least(p_size + 60, 200) WHEN p_partkey % 3 = 1 THEN least(p_size + 60, 200) END AS short, CASE WHEN p_partkey % 3 < 2 THEN greatest(p_size + 60, 200) END AS long FROM part""")
def f15_size_pair(spark, d):
    w = (F.col("p_size") + 60).cast("string")
    one = F.concat(w, F.lit("x200"))
    value = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, F.concat(one, F.lit(", 200 x "), w)).otherwise(F.concat(one, F.lit(", 10x20")))
    return table(spark, d, "part").select("p_partkey", text.size_pair(value).alias("s")).select("p_partkey", "s.short", "s.long")


@query(oracle("attrs", "components") + f""", p AS (SELECT a.id, a.attr, a.value AS a, c.value AS b FROM attrs a JOIN components c ON a.id = c.id AND a.attr = c.attr),
q AS (SELECT *, {number_sql('a')} AS x, {number_sql('b')} AS y, list_distinct(list_transform(string_split(a, ','), lambda z: {norm_sql('z')})) AS s, list_distinct(list_transform(string_split(b, ','), lambda z: {norm_sql('z')})) AS t FROM p)
SELECT id, attr, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x = y ELSE {norm_sql('a')} = {norm_sql('b')} OR (list_has_all(s, t) AND list_has_all(t, s)) END AS same,
CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN x = y THEN 'same number' WHEN abs(x - y) <= 1 THEN 'rounding' ELSE 'different numbers' END
WHEN list_has_all(s, t) AND list_has_all(t, s) THEN 'same list' WHEN list_has_all(s, t) THEN 'more members' WHEN list_has_all(t, s) THEN 'fewer members' ELSE 'different values' END AS kind FROM q""")
def f20_f21_same_and_difference(spark, d):
    p = view(spark, d, "attrs").join(view(spark, d, "components").withColumnRenamed("value", "other"), ["id", "attr"])
    return p.select("id", "attr", text.same_value(F.col("value"), F.col("other")).alias("same"), text.difference(F.col("value"), F.col("other"))["kind"].alias("kind"))


@query("""SELECT p_partkey, unnest(['wymiar 1', 'wymiar 2', 'wymiar 3', 'materiał', 'kolor']) AS field,
unnest([cast(p_size + 60 AS varchar), cast(p_size + 100 AS varchar), '40', 'stal malowana', 'biały']) AS value FROM part""")
def f22_described_fields(spark, d):
    line = F.concat(F.lit("wymiary: "), (F.col("p_size") * 10 + 600).cast("string"), F.lit("x"), (F.col("p_size") * 10 + 1000).cast("string"), F.lit("x400 mm, materiał: stal malowana, kolor: biały"))
    return table(spark, d, "part").select("p_partkey", F.inline(text.described_fields(line)))


@query(oracle("products") + f""", t AS (SELECT id, upper(name || ' ' || producer || '-' || n || ' x/' || size || 'a.b7') AS name FROM products),
k AS (SELECT id, list_filter(regexp_extract_all(name, '\\b([A-Z0-9][A-Z0-9/-]{{3,}})\\b', 1), lambda z: regexp_matches(z, '[0-9]')) AS codes FROM t)
SELECT id, list_concat([{norm_sql("'P-' || id")}, {norm_sql("'K' || id || 'Z'")}], list_filter(list_transform(codes, lambda z: {norm_sql("z")}), lambda z, i: list_position(list_transform(codes, lambda y: {norm_sql("y")}), z) = i)) AS keys FROM k""")
def f24_product_keys(spark, d):
    name = F.concat("name", F.lit(" "), "producer", F.lit("-"), "n", F.lit(" x/"), "size", F.lit("a.b7"))
    return view(spark, d, "products").select("id", text.product_keys(name, F.concat(F.lit("P-"), "id"), F.array(F.concat(F.lit("K"), "id", F.lit("Z")), F.lit("xy"))).alias("keys"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (abs(l_quantity * 10 - l_extendedprice) <= 0.5 * abs(l_extendedprice)) OR (abs(l_quantity * 100 - l_extendedprice) <= 0.5 * abs(l_extendedprice)) OR (abs(l_quantity * 1000 - l_extendedprice) <= 0.5 * abs(l_extendedprice)) OR (abs(l_extendedprice * 10 - l_quantity) <= 0.5 * abs(l_quantity)) OR (abs(l_extendedprice * 100 - l_quantity) <= 0.5 * abs(l_quantity)) OR (abs(l_extendedprice * 1000 - l_quantity) <= 0.5 * abs(l_quantity)) AS factor FROM lineitem")
def f25_unit_factor(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.unit_factor(F.col("l_quantity"), F.col("l_extendedprice"), 0.5).alias("factor"))


@query("""SELECT event_id, event_type, (value * 10) AS v, round(CASE WHEN event_type = 'click' THEN (event_id * 2 + value * 8) / 1e6 ELSE (event_id * 1 + value * 4) / 1e6 END, 6) AS cost,
CASE WHEN event_type LIKE 'c%' THEN '''' || event_type ELSE event_type END AS cell, 'https://shop/' || cast(event_id AS varchar) AS link FROM events""")
def f28_f30_f33_costs_cells_links(spark, d):
    e = table(spark, d, "events")
    cost = text.token_cost({"base": (1.0, 4.0), "click": (2.0, 8.0)}, F.col("event_type"), F.col("event_id"), F.col("value"), "base")
    signed = F.when(F.col("event_type").startswith("c"), F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    return e.select("event_id", "event_type", (F.col("value") * 10).alias("v"), F.round(cost, 6).alias("cost"), F.replace(text.csv_safe(signed), F.lit("="), F.lit("")).alias("cell"), text.deep_link("https://shop/{id}", F.col("event_id").cast("string")).alias("link"))


@query(oracle("attrs") + """, k AS (SELECT id, list(attr) AS keys FROM attrs GROUP BY id) SELECT id, CASE WHEN len(keys) < 3 THEN 'szczatkowy' WHEN NOT list_has_any(keys, ['Szerokość', 'Wysokość', 'Głębokość']) THEN 'bez_wymiarow' ELSE 'ok' END AS completeness FROM k""")
def f29_completeness(spark, d):
    maps = view(spark, d, "attrs").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("m"))
    return maps.select("id", text.completeness(F.col("m")).alias("completeness"))


NUMBERS = oracle("attrs") + f""", c AS (SELECT *, list_filter(list_transform(string_split_regex(value, '[,;]'), lambda z: trim(z)), lambda z: z <> '') AS parts FROM attrs WHERE attr IN ('Szerokość', 'Wysokość', 'Głębokość')),
n AS (SELECT *, {number_sql('value')} AS whole, list_transform(parts, lambda z: {number_sql('z')}) AS nums FROM c),
m AS (SELECT *, len(parts) > 1 AND len(list_filter(nums, lambda z: z IS NULL)) = 0 AS every, len(list_distinct(nums)) = 1 AS same FROM n),
r AS (SELECT *, CASE WHEN every AND same THEN 'L1-FORMAT-DUBEL' WHEN every THEN 'L1-FORMAT-ROZNE' ELSE 'L1-NIE-LICZBA' END AS rule_id FROM m WHERE whole IS NULL)"""


@query(NUMBERS + f""" SELECT id, attr, rule_id, 'L1' AS layer, 'krytyczna' AS severity, CASE rule_id WHEN 'L1-FORMAT-DUBEL' THEN 0.95 WHEN 'L1-FORMAT-ROZNE' THEN 0.4 ELSE 0.9 END AS confidence, value AS old_value,
CASE WHEN rule_id = 'L1-FORMAT-DUBEL' THEN {number_text_sql('nums[1]')} END AS new_value, rule_id || '|' || attr || CASE WHEN rule_id = 'L1-NIE-LICZBA' THEN '|' || value ELSE '' END AS grp FROM r""")
def d2_number_cells(spark, d):
    return seen(dictionary.number_findings(view(spark, d, "attrs").where("attr in ('Szerokość', 'Wysokość', 'Głębokość')")))


def _normalised(spark, d):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return dictionary.normalise(view(spark, d, "attrs"), view(spark, d, "kinds"), view(spark, d, "dictionary"), view(spark, d, "aliases"))


@query()
def d1_normalise(spark, d):
    return _normalised(spark, d)[0]


@query()
def d5_d6_dictionary_match(spark, d):
    values = dictionary.members_of(view(spark, d, "attrs").where("attr in ('Materiał', 'Styl')"))
    return dictionary.match(values, view(spark, d, "dictionary"), view(spark, d, "aliases"))


@query(oracle("attrs") + """ SELECT id, attr, 'L1-ENUM-DUBEL' AS rule_id, 'L1' AS layer, 'srednia' AS severity, 0.97 AS confidence, value AS old_value, 'nowoczesny' AS new_value, 'L1-ENUM-DUBEL|Styl|' || value AS grp FROM attrs WHERE attr = 'Styl' AND value = 'nowoczesny, nowoczesny'""")
def d4_enum_cells(spark, d):
    return seen(dictionary.enum_cells(view(spark, d, "attrs").where("attr = 'Styl'"))[1])


@query(oracle("attrs") + """ SELECT id, attr, rule_id, 'L1' AS layer, CASE rule_id WHEN 'L1-LISTA-DUBEL' THEN 'srednia' ELSE 'info' END AS severity, CASE rule_id WHEN 'L1-LISTA-DUBEL' THEN 0.98 ELSE 0.99 END AS confidence, value AS old_value,
CASE rule_id WHEN 'L1-LISTA-DUBEL' THEN 'drewno' ELSE 'metal, płyta meblowa' END AS new_value, rule_id || '|' || attr || '|' || value AS grp
FROM (SELECT *, CASE WHEN value = 'drewno, drewno' THEN 'L1-LISTA-DUBEL' ELSE 'L1-LISTA-KOLEJNOSC' END AS rule_id FROM attrs WHERE attr = 'Materiał' AND value IN ('drewno, drewno', 'płyta meblowa, metal'))""")
def d3_multi_cells(spark, d):
    cells = view(spark, d, "attrs").where("attr = 'Materiał'")
    matched = dictionary.match(dictionary.members_of(cells), view(spark, d, "dictionary"), view(spark, d, "aliases"))
    return seen(dictionary.multi_cells(cells, matched)[1])


@query(oracle("attrs", "dictionary") + """, m AS (SELECT id, attr, trim(x) AS value FROM (SELECT id, attr, unnest(string_split(value, ',')) AS x FROM attrs WHERE attr = 'Materiał'))
SELECT id, attr, value, CASE WHEN value = 'Drewno' THEN 'L1-ZAPIS' ELSE 'L1-ALIAS' END AS rule_id, CASE WHEN value = 'Drewno' THEN 'drewno' ELSE 'płyta MDF' END AS new_value FROM m WHERE value IN ('Drewno', 'mdf')""")
def d5_exact_and_alias(spark, d):
    cells = dictionary.members_of(view(spark, d, "attrs").where("attr = 'Materiał'")).select("id", "attr", "value")
    found = dictionary.match_findings(cells, dictionary.match(cells, view(spark, d, "dictionary"), view(spark, d, "aliases")))
    return found.where("rule_id in ('L1-ZAPIS', 'L1-ALIAS')").select("id", "attr", F.col("old_value").alias("value"), "rule_id", "new_value")


PANEL = "SELECT * FROM (VALUES ('Szerokość', 'ACTIVE'), ('Materiał', 'ACTIVE'), ('Kolor', 'ACTIVE'), ('Styl', 'DRAFT')) AS t(attr, status)"


MOVED = f"""SELECT c.id, c.attr, 'L0-ZE-SKLADOWYCH' AS rule_id, 'L0' AS layer, 'srednia' AS severity, 0.9 AS confidence, cast(NULL AS varchar) AS old_value, c.value AS new_value, 'L0-ZE-SKLADOWYCH|' || c.attr || '|' || {norm_sql('c.value')} AS grp
FROM components c JOIN panel p ON p.attr = c.attr AND p.status = 'ACTIVE' WHERE NOT EXISTS (SELECT 1 FROM attrs a WHERE a.id = c.id AND a.attr = c.attr) AND c.id NOT IN (SELECT id FROM cut_off)"""


@query(oracle("attrs", "components", "cut_off") + f", panel AS ({PANEL}) {MOVED}")
def z1_moved_components(spark, d):
    return seen(_moved(spark, d))


def _moved(spark, d):
    return detect.moved_components(view(spark, d, "components"), view(spark, d, "attrs"), spark.sql(PANEL), view(spark, d, "cut_off"))


def _conflicts(spark, d):
    return detect.component_conflicts(view(spark, d, "components"), view(spark, d, "attrs"), spark.sql(PANEL), view(spark, d, "cut_off"))


CONFLICTS = f"""SELECT a.id, a.attr, a.value AS old_value, c.value AS new_value, 'L0-KONFLIKT|' || a.attr || '|' || {norm_sql('a.value')} || '=>' || {norm_sql('c.value')} AS grp
FROM attrs a JOIN components c ON a.id = c.id AND a.attr = c.attr WHERE {norm_sql('a.value')} <> {norm_sql('c.value')} AND a.id NOT IN (SELECT id FROM cut_off)"""


@query(oracle("attrs", "components", "cut_off") + " " + CONFLICTS)
def z2_component_conflicts(spark, d):
    return _conflicts(spark, d).select("id", "attr", "old_value", "new_value", "grp")


@query(oracle("attrs", "components", "cut_off") + f""", panel AS ({PANEL}), moved AS ({MOVED}), con AS ({CONFLICTS}), q AS (SELECT *, {number_sql('old_value')} AS x, {number_sql('new_value')} AS y,
list_distinct(list_transform(string_split(old_value, ','), lambda z: {norm_sql('z')})) AS s, list_distinct(list_transform(string_split(new_value, ','), lambda z: {norm_sql('z')})) AS t FROM con),
j AS (SELECT *, attr IN (SELECT attr FROM panel) AND CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(x - y) > 1 ELSE NOT list_has_all(s, t) AND NOT list_has_all(t, s) END AS critical FROM q)
SELECT (SELECT count(*) FROM moved) AS to_move, count(*) AS conflicts, count(*) FILTER (critical) AS critical, (SELECT count(DISTINCT grp) FROM (SELECT grp FROM moved UNION ALL SELECT grp FROM con)) AS groups FROM j""")
def z3_l0_summary(spark, d):
    return detect.l0_summary(_moved(spark, d).unionByName(_conflicts(spark, d)))


@query(oracle("attrs", "components") + f""" SELECT coalesce(a.id, c.id) AS id, coalesce(a.attr, c.attr) AS attr, c.value AS component, a.value AS own,
CASE WHEN a.id IS NULL THEN 'only_components' WHEN c.id IS NULL THEN 'only_attributes' WHEN {norm_sql('a.value')} = {norm_sql('c.value')} THEN 'equal' ELSE 'differs' END AS state FROM attrs a FULL JOIN components c ON a.id = c.id AND a.attr = c.attr""")
def z4_side_by_side(spark, d):
    return detect.side_by_side(view(spark, d, "components"), view(spark, d, "attrs")).drop("place")


@query(oracle("products") + " SELECT id, 'zdjecie' AS attr, 'L1-BRAK-ZDJECIA' AS rule_id, 'L1' AS layer, 'krytyczna' AS severity, 0.99 AS confidence, cast(NULL AS varchar) AS old_value, cast(NULL AS varchar) AS new_value, 'L1-BRAK-ZDJECIA' AS grp FROM products WHERE photo = ''")
def d9_missing_photo(spark, d):
    return seen(detect.missing_photo(view(spark, d, "products")))


@query(oracle("attrs") + " SELECT id, attr, 'L1-KLUCZ-SMIEC' AS rule_id, 'L1' AS layer, 'krytyczna' AS severity, 0.9 AS confidence, value AS old_value, cast(NULL AS varchar) AS new_value, 'L1-KLUCZ-SMIEC|stary klucz|x' AS grp FROM attrs WHERE attr = 'stary klucz'")
def d10_junk_keys(spark, d):
    return seen(detect.junk_keys(view(spark, d, "attrs"), spark.sql("SELECT 'stary klucz' AS attr, 'old' AS reason")))


COVER = oracle("products", "attrs") + """, s AS (SELECT category, count(*) AS of FROM products GROUP BY category),
cov AS (SELECT p.category, a.attr, count(*) / s.of AS share FROM products p JOIN attrs a ON a.id = p.id JOIN s ON s.category = p.category GROUP BY p.category, a.attr, s.of)"""


@query(COVER + " SELECT category, attr, round_even(share, 3) AS share, share >= 0.9 AS required FROM cov")
def r2_coverage(spark, d):
    return detect.coverage(view(spark, d, "products"), view(spark, d, "attrs"))


@query(COVER + """ SELECT p.id, c.attr, CASE WHEN c.attr IN ('Szerokość', 'Wysokość', 'Głębokość', 'Waga', 'Materiał') THEN 'krytyczna' ELSE 'srednia' END AS severity, 'L1-BRAK-WYMAGANEGO|' || p.category || '|' || c.attr AS grp
FROM products p JOIN cov c ON c.category = p.category AND round_even(c.share, 3) >= 0.85 WHERE p.category <> 'PROMO' AND NOT EXISTS (SELECT 1 FROM attrs a WHERE a.id = p.id AND a.attr = c.attr)""")
def d11_missing_required(spark, d):
    p, a = view(spark, d, "products"), view(spark, d, "attrs")
    return detect.missing_required(p, a, detect.coverage(p, a), 0.85, view(spark, d, "others")).select("id", "attr", "severity", "grp")


@query(oracle("attrs") + """ SELECT x.id, x.attr, 'SPR-SZUFLADY' AS rule_id, x.value AS old_value, 'SPR-SZUFLADY|Głębokość|' || x.value AS grp FROM attrs x JOIN attrs a ON a.id = x.id AND a.attr = 'Liczba szuflad' AND a.value = 'bez szuflad' JOIN attrs b ON b.id = x.id AND b.attr = 'Styl' AND b.value = 'klasyczny' WHERE x.attr = 'Głębokość'""")
def d12a_contradictions(spark, d):
    conditions = spark.sql("SELECT * FROM (VALUES ('SPR-SZUFLADY', 'Liczba szuflad', 'bez szuflad'), ('SPR-SZUFLADY', 'Styl', 'klasyczny')) AS t(rule_id, attr, value)")
    return detect.contradictions(view(spark, d, "attrs"), conditions, spark.sql("SELECT 'SPR-SZUFLADY' AS rule_id, 'Głębokość' AS attr")).select("id", "attr", "rule_id", "old_value", "grp")


@query(oracle("products", "attrs") + """ SELECT a.id, a.attr, 'SPR-DRZWI-NAZWA' AS rule_id, a.value AS old_value, 'SPR-DRZWI-NAZWA|Liczba drzwi' AS grp FROM attrs a JOIN products p ON p.id = a.id WHERE a.attr = 'Liczba drzwi' AND a.value = '2-drzwiowe' AND p.name LIKE '%bez drzwi%'""")
def d12b_name_contradictions(spark, d):
    conditions = spark.sql("SELECT 'SPR-DRZWI' AS rule_id, 'Liczba drzwi' AS attr, '2-drzwiowe' AS value")
    return detect.name_contradictions(view(spark, d, "products"), view(spark, d, "attrs"), conditions, spark.sql("SELECT 'SPR-DRZWI' AS rule_id, 'bez drzwi' AS fragment")).select("id", "attr", "rule_id", "old_value", "grp")


def _nums(spark, d):
    return dictionary.number_cells(view(spark, d, "attrs").where("attr in ('Szerokość', 'Wysokość', 'Głębokość')")).where("num is not null").select("id", "attr", "num")


NUMS = NUMBERS + ", num AS (SELECT id, attr, coalesce(whole, nums[1]) AS num FROM m WHERE whole IS NOT NULL OR (every AND same))"


@query(NUMS + f""" SELECT a.id, a.attr, 'REL-SZER-WYS' AS rule_id, {number_text_sql('a.num')} AS old_value, 'REL-SZER-WYS' AS grp FROM num a JOIN num b ON a.id = b.id AND a.attr = 'Szerokość' AND b.attr = 'Wysokość' WHERE a.num > b.num""")
def d13_relations(spark, d):
    return detect.relations(_nums(spark, d), spark.sql("SELECT 'REL-SZER-WYS' AS rule_id, 'Szerokość' AS low, 'Wysokość' AS high, false AS strict")).select("id", "attr", "rule_id", "old_value", "grp")


RANGES = """r0 AS (SELECT category, attr, count(*) AS n, median(num) AS med, mad(num) AS md, quantile_cont(num, 0.01) AS q1, quantile_cont(num, 0.99) AS q99 FROM val GROUP BY category, attr HAVING count(*) >= 30),
ranges AS (SELECT category, attr, n, round_even(med, 2) AS median, round_even(md, 2) AS mad, round_even(q1, 2) AS p1, round_even(q99, 2) AS p99,
 round_even(greatest(0, CASE WHEN md > 0 THEN least(q1, med - 6 * md) ELSE q1 END), 1) AS low, round_even(CASE WHEN md > 0 THEN greatest(q99, med + 6 * md) ELSE q99 END, 1) AS high FROM r0)"""


@query(f"WITH val AS (SELECT l_returnflag || l_linestatus AS category, 'q' AS attr, l_quantity AS num FROM lineitem), {RANGES} SELECT * FROM ranges")
def r1_learn_ranges(spark, d):
    return detect.learn_ranges(table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("category"), F.lit("q").alias("attr"), F.col("l_quantity").alias("num")))


@query("""WITH v AS (SELECT 'all' AS category, l_extendedprice - l_partkey * 3.7 AS num FROM lineitem UNION ALL SELECT 'flag ' || l_returnflag, l_extendedprice FROM lineitem UNION ALL SELECT 'few ' || l_suppkey, l_quantity FROM lineitem WHERE l_orderkey < 500)
SELECT category, count(*) AS n, round(quantile_cont(num, 0.01), 6) AS p1, round(median(num), 6) AS middle, round(quantile_cont(num, 0.99), 6) AS p99 FROM v GROUP BY category""")
def r1_exact_percentiles(spark, d):
    """One group of all rows, three large ones and many small, by selection with intervals of at most 500 values."""
    line = table(spark, d, "lineitem")
    values = line.select(F.lit("all").alias("category"), (F.col("l_extendedprice") - F.col("l_partkey") * 3.7).alias("num"))
    values = values.unionByName(line.select(F.concat(F.lit("flag "), "l_returnflag").alias("category"), F.col("l_extendedprice").alias("num")))
    values = values.unionByName(line.where("l_orderkey < 500").select(F.concat(F.lit("few "), F.col("l_suppkey").cast("string")).alias("category"), F.col("l_quantity").alias("num")))
    found = quantiles.percentiles(values, ["category"], "num", [0.01, 0.5, 0.99], leaf=500, bins=64)
    return found.select("category", "n", *(F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("p1", "middle", "p99"))))


@query(NUMS + f""", val AS (SELECT 'all' AS category, attr, num FROM num), {RANGES},
o AS (SELECT n.id, n.attr, n.num, r.* EXCLUDE (category, attr), n.num > r.high * 1.5 OR n.num < r.low / 1.5 AS far FROM num n JOIN ranges r ON r.attr = n.attr WHERE n.num < r.low OR n.num > r.high),
s AS (SELECT *, CASE WHEN NOT far THEN NULL WHEN num * 10 BETWEEN p1 AND p99 THEN '×10' WHEN num * 0.1 BETWEEN p1 AND p99 THEN '÷10' WHEN num * 0.01 BETWEEN p1 AND p99 THEN '÷100' WHEN num * 100 BETWEEN p1 AND p99 THEN '×100' END AS fit FROM o)
SELECT s.id, s.attr, CASE WHEN fit IS NULL THEN 'L2-OUTLIER' ELSE 'L2-SKALA' END AS rule_id, CASE WHEN fit IS NULL THEN 0.55 ELSE 0.88 END AS confidence, fit IS NOT NULL AS scaled,
CASE WHEN fit IS NULL THEN 'L2-OUTLIER|' || p.p_type || '|' || s.attr ELSE 'L2-SKALA|' || s.attr || '|' || fit END AS grp FROM s JOIN part p ON cast(p.p_partkey AS varchar) = s.id WHERE p.p_type <> 'PROMO'""")
def r3_d14_out_of_range(spark, d):
    nums = _nums(spark, d)
    ranges = detect.learn_ranges(nums.withColumn("category", F.lit("all")))
    rows = nums.join(view(spark, d, "products").select("id", "category"), "id")
    parents = view(spark, d, "products").select("category").distinct().withColumn("parent", F.lit("all"))
    return detect.out_of_range(detect.with_range(rows, ranges, parents), view(spark, d, "others")).select("id", "attr", "rule_id", "confidence", F.col("new_value").isNotNull().alias("scaled"), "grp")


@query(oracle("products", "attrs", "dictionary") + ", " + PARTS_SQL + f""", said AS (SELECT id, 'Liczba drzwi' AS attr, doors AS n, false AS hint FROM parts WHERE doors IS NOT NULL UNION ALL SELECT id, 'Liczba szuflad', drawers, false FROM parts WHERE drawers IS NOT NULL UNION ALL SELECT id, 'Liczba szuflad', 1, true FROM parts WHERE has_drawers),
lab AS (SELECT attr, pos, label, {norm_sql('label')} AS l, try_cast(regexp_extract({norm_sql('label')}, '^(\\d+)', 1) AS integer) AS k FROM dictionary),
x AS (SELECT s.*, a.value, CASE WHEN {norm_sql('a.value')} LIKE 'bez%' THEN 0 ELSE try_cast(regexp_extract({norm_sql('a.value')}, '^(\\d+)', 1) AS integer) END AS held, {norm_sql('a.value')} LIKE '%wiecej%' AS more,
 coalesce((SELECT arg_min(label, pos) FROM lab WHERE lab.attr = s.attr AND (CASE WHEN l LIKE 'bez%' THEN s.n = 0 ELSE lab.k = s.n AND l NOT LIKE '%wiecej%' END)), (SELECT arg_min(label, pos) FROM lab WHERE lab.attr = s.attr AND l LIKE '%wiecej%' AND s.n >= lab.k)) AS label
 FROM said s LEFT JOIN attrs a ON a.id = s.id AND a.attr = s.attr),
c AS (SELECT *, CASE WHEN hint AND value = 'bez szuflad' THEN 'none' WHEN NOT hint AND value IS NULL THEN 'gap' WHEN NOT hint AND held <> n AND NOT (more AND n >= held) THEN 'differs' END AS kind FROM x)
SELECT id, attr, CASE kind WHEN 'gap' THEN 'L2-NAZWA-UZUPELNIA' ELSE 'L2-NAZWA-ROZJAZD' END AS rule_id, 'L2' AS layer, CASE kind WHEN 'gap' THEN 'srednia' ELSE 'krytyczna' END AS severity, CASE kind WHEN 'none' THEN 0.8 WHEN 'gap' THEN 0.7 ELSE 0.78 END AS confidence,
value AS old_value, CASE WHEN kind <> 'none' THEN label END AS new_value, CASE kind WHEN 'gap' THEN 'L2-NAZWA-UZUPELNIA|' ELSE 'L2-NAZWA-ROZJAZD|' END || attr || CASE kind WHEN 'none' THEN '|bez' ELSE '' END AS grp FROM c WHERE kind IS NOT NULL""")
def d15_d16_name_against_counts(spark, d):
    words = view(spark, d, "dictionary")
    parts = detect.named_parts(view(spark, d, "products"))
    return seen(detect.name_against_counts(view(spark, d, "products"), view(spark, d, "attrs"), dictionary.enum_label(parts, words)))


@query(NUMS + f""", {oracle('products')[5:]}, w AS (SELECT p.id, p.size + 10.0 AS a, p.n % 90 + 100.0 AS b FROM products p WHERE p.n % 12 = 5)
SELECT n.id, 'Szerokość' AS attr, 'L2-NAZWA-WYMIAR' AS rule_id, {number_text_sql('n.num')} AS old_value, cast(NULL AS varchar) AS new_value FROM num n JOIN w ON w.id = n.id WHERE n.attr = 'Szerokość' AND NOT EXISTS (SELECT 1 FROM num x WHERE x.id = n.id AND (abs(x.num - w.a) <= 3 OR abs(x.num - w.b) <= 3))
UNION ALL SELECT id, 'Średnica', 'L2-NAZWA-UZUPELNIA', NULL, cast(30 + size AS varchar) FROM products WHERE n % 12 = 6""")
def d17_d18_name_against_sizes(spark, d):
    return detect.name_against_sizes(view(spark, d, "products"), _nums(spark, d)).select("id", "attr", "rule_id", "old_value", "new_value")


@query(oracle("products", "attrs") + """, own AS (SELECT a.*, p.producer, p.category FROM attrs a JOIN products p ON p.id = a.id WHERE a.attr IN ('Materiał', 'Liczba drzwi', 'Liczba szuflad', 'Styl')),
c AS (SELECT producer, category, attr, value, count(*) AS n FROM own GROUP BY ALL), t AS (SELECT producer, category, attr, sum(n) AS of, count(*) AS kinds, max(n) AS most, arg_max(value, n) AS common FROM c GROUP BY ALL HAVING sum(n) >= 4 AND count(*) >= 2 AND max(n) > 0.5 * sum(n))
SELECT o.id, o.attr, o.value AS old_value, t.common AS new_value FROM own o JOIN t ON t.producer = o.producer AND t.category = o.category AND t.attr = o.attr WHERE o.value <> t.common""")
def d12_family_outliers(spark, d):
    return detect.family_outliers(view(spark, d, "products"), view(spark, d, "attrs"), [F.col("producer"), F.col("category")], share=0.500001).select("id", "attr", "old_value", "new_value")


@query("""WITH k AS (SELECT cast(p_partkey AS varchar) AS id, p_brand, p_name, p_size % 2 AS num FROM part), g AS (SELECT p_brand, p_name FROM k GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT num) = 1)
SELECT k.id, 'L2-DUPLIKAT|' || k.p_brand || '|' || k.p_name AS grp FROM k JOIN g ON g.p_brand = k.p_brand AND g.p_name = k.p_name""")
def d19_duplicates(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("producer"), (F.col("p_size") % 2).cast("double").alias("num"))
    return detect.duplicates(p, p.select("id", F.lit("x").alias("attr"), "num")).select("id", "grp")


RULES = "SELECT * FROM (VALUES (1, 'pierscien', 'ring'), (2, 'przyrzad', 'gadget|widget'), (3, 'maly', 'small')) AS t(priority, key, pattern)"


@query("""WITH p AS (SELECT cast(p_partkey AS varchar) AS id, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 4 = 1 THEN 'inne' ELSE '' END AS type FROM part)
SELECT id, CASE WHEN type = 'ECONOMY' THEN 'tanie' WHEN regexp_matches(p_name, '\\bring') THEN 'pierscien' WHEN regexp_matches(p_name, '\\bgadget|\\bwidget|widget') THEN 'przyrzad' WHEN regexp_matches(p_name, '\\bsmall') THEN 'maly' ELSE 'nieznana' END AS category,
CASE WHEN type = 'ECONOMY' THEN 'sklep' WHEN type <> '' THEN 'sklep_niezmapowany' ELSE 'nazwa' END AS source FROM p""")
def c1_c2_categories(spark, d):
    kind = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).when(F.col("p_partkey") % 4 == 1, "inne").otherwise("")
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), kind.alias("type"))
    return detect.assign_category(p, spark.sql("SELECT 'Economy' AS type, 'tanie' AS key"), spark.sql(RULES))


def all_findings(spark, d):
    """All findings of layers 0 to 2 and the gaps over the bridge's catalogue."""
    from shelfwise.plans import jobs, more

    g = more._Gaps(spark, d)
    products, raw, components = (tables.written(df, n) for n, df in (("products", g.products.join(view(spark, d, "cut_off").withColumn("cut_off", F.lit(True)), "id", "left").withColumn("cut_off", F.coalesce("cut_off", F.lit(False)))), ("attrs", view(spark, d, "attrs")), ("components", view(spark, d, "components"))))  # some thirty detectors read them
    long, cells = dictionary.normalise(raw, view(spark, d, "kinds"), view(spark, d, "dictionary"), view(spark, d, "aliases"))
    long = tables.written(long, "long")
    config = {
        "dictionary": view(spark, d, "dictionary"),
        "panel": spark.sql(PANEL),
        "junk": spark.sql("SELECT 'stary klucz' AS attr, 'old' AS reason"),
        "disabled_rules": spark.sql("SELECT 'L2-DUPLIKAT' AS rule_id"),
        "disabled_attrs": spark.sql("SELECT 'stary klucz' AS attr"),
        "parents": products.select("category").distinct().withColumn("parent", F.lit("all")),
        "conditions": spark.sql("SELECT * FROM (VALUES ('SPR-SZUFLADY', 'Liczba szuflad', 'bez szuflad'), ('SPR-SZUFLADY', 'Styl', 'klasyczny'), ('SPR-DRZWI', 'Liczba drzwi', '2-drzwiowe')) AS t(rule_id, attr, value)"),
        "forbidden": spark.sql("SELECT 'SPR-SZUFLADY' AS rule_id, 'Głębokość' AS attr"),
        "fragments": spark.sql("SELECT 'SPR-DRZWI' AS rule_id, 'bez drzwi' AS fragment"),
        "relations": spark.sql("SELECT 'REL-SZER-WYS' AS rule_id, 'Szerokość' AS low, 'Wysokość' AS high, false AS strict"),
        "non_furniture": view(spark, d, "others"),
        "node_filters": spark.sql(more.NODE_FILTERS),
        "category_filters": spark.sql(more.FILTERS),
        "subtypes": g.subtype_rules(),
        "names": g.name_rules(),
        "reads": g.reads(),
        "optional": spark.sql("SELECT 'Kolor' AS attr"),
    }
    return jobs.find_all(products, raw, components, long, cells, config, f"{tables.shared_dir(spark)}/import-{uuid.uuid4().hex}", 0.85, [F.col("producer"), F.col("category")])


@query()
def a1_all_findings(spark, d):
    return all_findings(spark, d).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"))


@query(oracle("products", "attrs") + " SELECT id, CASE WHEN attr = 'Styl' THEN 'Stylistyka' ELSE attr END AS attr, CASE WHEN attr = 'Materiał' THEN replace(replace(value, 'metal', 'stal'), 'szkło', 'szkło hartowane') ELSE value END AS value FROM attrs")
def f8_renamed(spark, d):
    attrs = spark.sql("SELECT 'Styl' AS old, 'Stylistyka' AS new")
    return dictionary.renamed(view(spark, d, "attrs"), attrs, spark.sql("SELECT * FROM (VALUES ('Materiał', 'metal', 'stal'), ('Materiał', 'szkło', 'szkło hartowane')) AS t(attr, old, new)"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, {number_text_sql('l_quantity / 4')} AS n, translate(l_returnflag || 'ąŻó', 'ąŻó', 'aZo') AS plain FROM lineitem")
def f1_f9_number_text(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text.number_text(F.col("l_quantity") / 4).alias("n"), text.strip_accents(F.concat("l_returnflag", F.lit("ąŻó"))).alias("plain"))


@query(oracle("attrs") + " SELECT id, attr, value, list_filter(list_transform(string_split(value, ','), lambda z: trim(z)), lambda z: z <> '') AS parts FROM attrs")
def f14_members(spark, d):
    return view(spark, d, "attrs").select("id", "attr", "value", text.members(F.col("value")).alias("parts"))


@query(oracle("attrs", "dictionary") + f" SELECT a.id, a.attr, a.value, (SELECT min(d.label) FROM dictionary d WHERE d.attr = a.attr AND {norm_sql('d.label')} = {norm_sql('a.value')}) AS canonical FROM attrs a")
def f17_canonical(spark, d):
    return dictionary.canonical(view(spark, d, "attrs"), view(spark, d, "dictionary"))


@query(oracle("products") + f" SELECT id, CASE WHEN n % 2 = 0 THEN 'K' || id END AS code, regexp_replace(regexp_replace({norm_sql('name')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, list_sort(list_distinct(list_transform(string_split({norm_sql('name')}, ' '), lambda w: left(w, 5)))) AS stems FROM products")
def f18_f19_codes_and_slugs(spark, d):
    codes = F.when(F.col("n") % 2 == 0, F.create_map(F.lit("Kod  Producenta"), F.concat(F.lit("K"), "id"), F.lit("sku"), F.lit("x"))).otherwise(F.create_map(F.lit("sku"), F.lit("x")))
    return view(spark, d, "products").select("id", text.producer_code(codes).alias("code"), text.slug(F.col("name")).alias("slug"), F.array_sort(text.stems(F.col("name"))).alias("stems"))


COMPARED = oracle("products") + f""", w AS (SELECT id, regexp_replace(regexp_replace({norm_sql("name || ' ' || name")}, '\\b([a-z]{{1,3}}[0-9]{{1,4}}[a-z]?|[0-9]+([.,][0-9]+)?(cm|mm|kg)?)\\b', ' ', 'g'), '\\b(gadget|red)\\b', ' ', 'g') AS n FROM products)
SELECT id, trim(regexp_replace(n, '\\s+', ' ', 'g')) AS compared FROM w"""


def _compared(spark, d):
    """Of the name twice, as repeated words stay, and a collection whose words are in some names."""
    return view(spark, d, "products").select("id", text.comparable_name(F.concat_ws(" ", "name", "name"), F.lit("Gadget Red")).alias("compared"))


@query(COMPARED)
def f23_comparable_name(spark, d):
    return _compared(spark, d)


@query(COMPARED)
def f23_comparable_name_all(spark, d):
    return _compared(spark, d)


#: Feeds with a unit in the field's name, or in some of the values, or in neither.
HINTED = """SELECT p_brand AS source, field, target, cast(p_size AS string) || CASE WHEN p_partkey % 3 < wide THEN ' ' || unit ELSE '' END AS value FROM part
JOIN (VALUES ('Szer (mm)', 'Szerokość', 'cm', 0), ('wys', 'Wysokość', 'mm', 2), ('gleb', 'Głębokość', 'mm', 1), ('Dł. m', 'Szerokość', '', 0), ('Waga gr', 'Waga', '', 0), ('waga netto', 'Waga', 'g', 3), ('waga mm', 'Waga', 'mm', 3), ('opis » wymiar mm', 'Szerokość', '', 0), ('inne mm', 'Kolor', 'mm', 3)) AS f(field, target, unit, wide) ON p_size IS NOT NULL"""


@query(f"""WITH h AS ({HINTED}), u AS (SELECT source, field, target, count(*) AS n, regexp_extract(value, '[0-9] *([a-z]+)$', 1) AS unit FROM h GROUP BY ALL),
t AS (SELECT source, field, target, sum(n) AS of, arg_max(unit, n) FILTER (unit <> '') AS unit, coalesce(max(n) FILTER (unit <> ''), 0) AS most FROM u GROUP BY ALL),
n AS (SELECT *, CASE WHEN contains(field, '»') THEN NULL WHEN target <> 'Waga' AND regexp_matches(lower(field), '(^|[^a-z])mm([^a-z]|$)') THEN 0.1 WHEN target <> 'Waga' AND regexp_matches(lower(field), '(^|[^a-z])m([^a-z]|$)') THEN 100.0
WHEN target = 'Waga' AND regexp_matches(lower(field), '(^|[^a-z])gr?([^a-z]|$)') THEN 0.001 END AS by_name, CASE WHEN 2 * most > of THEN CASE WHEN target <> 'Waga' AND unit = 'mm' THEN 0.1 WHEN target <> 'Waga' AND unit = 'm' THEN 100.0 WHEN target = 'Waga' AND unit = 'g' THEN 0.001 END END AS by_value FROM t)
SELECT source, field, target, coalesce(by_name, by_value) AS scale FROM n WHERE target IN ('Szerokość', 'Wysokość', 'Głębokość', 'Waga')""")
def f26_scale_hints(spark, d):
    from shelfwise.operators import feeds

    rows = spark.sql(HINTED.replace("FROM part", "FROM {p}"), p=table(spark, d, "part"))
    return feeds.scale_hints(rows, rows.select("source", "field", "target").distinct())


@query("SELECT o_orderkey, cast(o_custkey AS varchar) AS ident, o_orderpriority AS other FROM orders")
def f31_identifier(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.identifier(F.concat(F.col("o_custkey").cast("string"), F.lit(".0 "))).alias("ident"), text.identifier(F.col("o_orderpriority")).alias("other"))


@query(oracle("attrs") + " SELECT id, attr, value FROM attrs WHERE value LIKE '%,%' AND attr NOT IN ('Materiał')")
def f34_bad_lists(spark, d):
    return dictionary.bad_lists(view(spark, d, "attrs"), spark.sql("SELECT 'Materiał' AS attr"))


@query(oracle("products") + " SELECT id, n % 8 IN (0, 1, 3, 4, 6) AS package, CASE n % 3 WHEN 0 THEN 'tak' WHEN 1 THEN 'nie' END AS yes_no, CASE WHEN photo = '' THEN 1 ELSE 2 END AS n_photos, CASE WHEN photo <> '' THEN 'Front: x' ELSE 'Wnętrze' END AS label FROM products")
def f36_f38_f39_fields(spark, d):
    p = view(spark, d, "products")
    photos = F.concat(F.when(F.col("photo") != "", F.concat(F.lit("Front: x: "), "photo", F.lit(" | none | "))).otherwise(""), F.lit("Wnętrze: http://b/2"))
    g = text.gallery(photos)
    answer = F.when(F.col("n") % 3 == 0, "TAK").when(F.col("n") % 3 == 1, " nie").otherwise("może")
    return p.select("id", text.is_package(F.element_at(F.array(*map(F.lit, ("Wymiar paczki", "package.pack@width", "Wymiar", "Koszt wysyłki", "Waga brutto", "box", "shipping weight", "waga"))), (F.col("n") % 8 + 1).cast("int"))).alias("package"), text.yes_no(answer).alias("yes_no"), F.size(g).alias("n_photos"), F.get(g, F.lit(0))["label"].alias("label"))


#: Tabs named after each producer, with the endings that sheets give them.
TABS = "SELECT DISTINCT replace(p_brand, '#', '') || CASE p_size % 6 WHEN 0 THEN 'Stock' WHEN 1 THEN 'Products' WHEN 2 THEN 'productV2' WHEN 3 THEN 'LogisticsOurs' WHEN 4 THEN '' ELSE ' nowe' END AS tab FROM part"
TAB_PRODUCERS = f"""WITH tabs AS ({TABS}), b AS (SELECT DISTINCT p_brand AS producer FROM part), k AS (SELECT producer, replace({norm_sql('producer')}, ' ', '') AS p FROM b), c AS (SELECT tab, lower(regexp_replace(tab, '(?:stock|products?|logistics|fromimporter|ours|v[0-9]+)+$', '', 'i')) AS core FROM tabs)
SELECT c.tab, (SELECT arg_min(k.producer, (length(k.p), k.producer)) FROM k WHERE length(c.core) >= 3 AND (starts_with(k.p, c.core) OR starts_with(c.core, k.p))) AS producer FROM c"""


def _tab_producers(spark, d):
    from shelfwise.operators import feeds

    part = table(spark, d, "part")
    return feeds.producer_of_tab(spark.sql(TABS.replace("FROM part", "FROM {p}"), p=part), part.select(F.col("p_brand").alias("producer")).distinct())


@query(TAB_PRODUCERS)
def f40_producer_of_tab(spark, d):
    return _tab_producers(spark, d)


@query(TAB_PRODUCERS)
def f40_producer_of_tab_all(spark, d):
    return _tab_producers(spark, d)


@query(oracle("products") + " SELECT id, CASE WHEN category = 'ECONOMY' THEN 'Tanie' ELSE category END AS shown, category <> 'ECONOMY' AS furniture FROM products")
def c3_category_names(spark, d):
    return detect.with_category_names(view(spark, d, "products"), spark.sql("SELECT 'ECONOMY' AS category, 'Tanie' AS shown, false AS furniture")).select("id", "shown", "furniture")


@query(oracle("products") + " SELECT 'photo' AS what, count(*) AS n FROM products WHERE photo = '' UNION ALL SELECT 'products', count(*) FROM products")
def s13_s21_save_and_read(spark, d):
    """A run written as tables and read back."""
    import uuid

    from shelfwise.sources import log, readers

    folder = f"{tables.shared_dir(spark)}/run-{uuid.uuid4().hex}"
    products = view(spark, d, "products")
    readers.save_run(products, detect.missing_photo(products), folder, 7)
    runs = log.Runs(spark, folder)
    runs.commit(7)
    found = runs.table("findings").where("run_id = 7 and old_hash = 'da39a3ee5e6b'")
    return found.agg(F.count("*").alias("n")).select(F.lit("photo").alias("what"), "n").unionByName(runs.table("products").agg(F.count("*").alias("n")).select(F.lit("products").alias("what"), "n"))
