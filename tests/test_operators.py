"""Operators on tiny tables: what they emit, and what they stay silent on."""

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import analytics, decisions, detect, dictionary, feeds, gaps, maintenance, photos, review, tree
from shelfwise.operators import findings as fs
from shelfwise.sources import readers
from shelfwise.streaming import arrivals


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


PRODUCT = "id string, name string, producer string, collection string, category string, photo string"
CELL = "id string, attr string, value string"
NUM = "id string, attr string, num double"


def rules(found):
    return sorted((r.id, r.rule_id, r.new_value) for r in found.collect())


def test_number_cells(spark):
    cells = frame(spark, CELL, ("1", "Waga", "46, 46"), ("2", "Waga", "46, 52"), ("3", "Waga", "ciężka"), ("4", "Waga", "46,5"), ("5", "Waga", ""))
    assert rules(dictionary.number_findings(cells)) == [("1", "L1-FORMAT-DUBEL", "46"), ("2", "L1-FORMAT-ROZNE", None), ("3", "L1-NIE-LICZBA", None)]


def test_dictionary_cascade(spark):
    words = frame(spark, "attr string, pos int, label string", ("M", 0, "drewno"), ("M", 1, "metal"), ("M", 2, "płyta meblowa"))
    aliases = frame(spark, "attr string, alias string, label string", ("M", "stal", "metal"))
    cells = frame(spark, CELL, ("1", "M", "Drewno"), ("2", "M", "STAL"), ("3", "M", "drewnoo"), ("4", "M", "drzewno"), ("5", "M", "kamień"), ("6", "M", "metal"), ("7", "wolny", "x"))
    found = dictionary.match_findings(cells, dictionary.match(cells, words, aliases))
    assert [r[:2] for r in rules(found)] == [("1", "L1-ZAPIS"), ("2", "L1-ALIAS"), ("3", "L1-SLOWNIK-AUTO"), ("4", "L1-SLOWNIK-AUTO"), ("5", "L1-SPOZA-SLOWNIKA")]


def test_lists_and_enums(spark):
    words = frame(spark, "attr string, pos int, label string", ("M", 0, "metal"), ("M", 1, "płyta meblowa"), ("M", 2, "drewno"))
    none = frame(spark, "attr string, alias string, label string")
    cells = frame(spark, CELL, ("1", "M", "drewno, drewno"), ("2", "M", "płyta meblowa, metal"), ("3", "M", "metal, płyta meblowa"))
    lists, found = dictionary.multi_cells(cells, dictionary.match(dictionary.members_of(cells), words, none))
    assert rules(found) == [("1", "L1-LISTA-DUBEL", "drewno"), ("2", "L1-LISTA-KOLEJNOSC", "metal, płyta meblowa")]
    assert {r.id: r.norm for r in lists.collect()}["2"] == "metal, płyta meblowa"
    single, twice = dictionary.enum_cells(frame(spark, CELL, ("1", "S", "nowoczesny, Nowoczesny"), ("2", "S", "a, b")))
    assert rules(twice) == [("1", "L1-ENUM-DUBEL", "nowoczesny")] and {r.value for r in single.collect()} == {"nowoczesny", "a, b"}


def test_contradictions_and_relations(spark):
    values = frame(spark, CELL, ("1", "Drzwi", "bez drzwi"), ("1", "Rodzaj drzwi", "uchylne"), ("2", "Drzwi", "2"), ("2", "Rodzaj drzwi", "uchylne"))
    found = detect.contradictions(values, frame(spark, "rule_id string, attr string, value string", ("SPR-DRZWI", "Drzwi", "bez drzwi")), frame(spark, "rule_id string, attr string", ("SPR-DRZWI", "Rodzaj drzwi")))
    assert rules(found) == [("1", "SPR-DRZWI", None)]
    nums = frame(spark, NUM, ("1", "od ziemi", 90.0), ("1", "Wysokość", 80.0), ("2", "od ziemi", 80.0), ("2", "Wysokość", 80.0))
    rule = frame(spark, "rule_id string, low string, high string, strict boolean", ("REL-WYS-ZIEMIA", "od ziemi", "Wysokość", False))
    assert rules(detect.relations(nums, rule)) == [("1", "REL-WYS-ZIEMIA", None)]


def test_ranges_tell_scale_from_outlier(spark):
    r = "category string, attr string, n long, median double, mad double, p1 double, p99 double, low double, high double"
    ranges = frame(spark, r, ("fotel", "Waga", 50, 30.0, 1.0, 8.0, 68.0, 0.0, 77.0), ("all", "Głębokość", 50, 40.0, 1.0, 28.5, 56.4, 20.0, 60.0))
    rows = frame(spark, "id string, category string, attr string, num double", ("1", "fotel", "Waga", 85.0), ("2", "fotel", "Głębokość", 4.3), ("3", "fotel", "Waga", 30.0), ("4", "x", "Waga", 500.0))
    parents = frame(spark, "category string, parent string", ("fotel", "all"))
    assert rules(detect.out_of_range(detect.with_range(rows, ranges, parents))) == [("1", "L2-OUTLIER", None), ("2", "L2-SKALA", "43")]


def test_names_against_attributes(spark):
    products = frame(spark, PRODUCT, ("1", "Szafa 3-drzwiowa", "p", "c", "szafa", ""), ("2", "Komoda 5-szufladowa", "p", "c", "komoda", ""), ("3", "Komoda z szufladami", "p", "c", "komoda", ""), ("4", "Szafa 2-drzwiowa", "p", "c", "szafa", ""))
    values = frame(spark, CELL, ("1", "Liczba drzwi", "2-drzwiowe"), ("2", "Liczba szuflad", "4 i więcej"), ("3", "Liczba szuflad", "bez szuflad"))
    words = frame(spark, "attr string, pos int, label string", ("Liczba drzwi", 0, "2-drzwiowe"), ("Liczba drzwi", 1, "3-drzwiowe"), ("Liczba szuflad", 0, "4 i więcej"))
    labels = dictionary.enum_label(detect.named_parts(products), words)
    assert rules(detect.name_against_counts(products, values, labels)) == [("1", "L2-NAZWA-ROZJAZD", "3-drzwiowe"), ("3", "L2-NAZWA-ROZJAZD", None), ("4", "L2-NAZWA-UZUPELNIA", "2-drzwiowe")]
    beds = frame(spark, PRODUCT, ("1", "Łóżko (90x200)", "p", "c", "lozko", ""), ("2", "Łóżko (90x200)", "p", "c", "lozko", ""), ("3", "Stół 120x80", "p", "c", "stol", ""))
    nums = frame(spark, NUM, ("1", "Szerokość", 108.0), ("1", "Szerokość powierzchni spania", 90.0), ("3", "Szerokość", 60.0), ("3", "Głębokość", 82.0))
    assert rules(detect.name_against_sizes(beds, nums)) == [("2", "L2-NAZWA-UZUPELNIA", "90")]


def test_families_and_duplicates(spark):
    products = [(str(k), f"Komoda Avola {k}0x80", "p", "c", "k", "") for k in range(1, 10)] + [(f"s{k}", "Stół", "p", "c", "s", "") for k in range(8)]
    values = [(str(k), "Materiał", "drewno" if k == 9 else "płyta meblowa") for k in range(1, 10)] + [(f"s{k}", "Materiał", "a" if k < 4 else "b") for k in range(8)]
    p = frame(spark, PRODUCT, *products)
    assert rules(detect.family_outliers(p, frame(spark, CELL, *values))) == [("9", "L2-RODZINA", "płyta meblowa")]
    nums = frame(spark, NUM, *((f"s{k}", "Waga", 5.0) for k in range(8)))
    assert {r.id for r in detect.duplicates(p, nums).collect()} == {f"s{k}" for k in range(8)}
    assert {r.evidence for r in detect.duplicates(p, nums).collect()} == {"s0, s1, s2, s3, s4, s5"}


def test_components(spark):
    raw = frame(spark, CELL, ("1", "Szerokość", "90,5"), ("1", "Kolor", "biały"))
    parts = frame(spark, CELL, ("1", "Szerokość", "90"), ("1", "Materiał", "metal"), ("1", "Tajne", "x"), ("1", "Kolor", "Biały"))
    panel = frame(spark, "attr string, status string", ("Materiał", "ACTIVE"), ("Szerokość", "ACTIVE"), ("Tajne", "DISABLED"))
    assert rules(detect.moved_components(parts, raw, panel)) == [("1", "L0-ZE-SKLADOWYCH", "metal")]
    got = detect.component_conflicts(parts, raw, panel).collect()
    assert [(r.old_value, r.new_value, r.severity, r.confidence) for r in got] == [("90,5", "90", "info", 0.6)]


LOG = "seq long, id string, attr string, old_value string, status string, new_value string, ts timestamp, batch_id long"


def test_decision_to_next_snapshot(spark):
    t = "2026-09-01 10:00:00"
    log = spark.createDataFrame([(k, str(k), "Materiał", "plyta", "zastosowana", "drewno", t, 7) for k in (1, 2, 3, 4)] + [(5, "5", "Materiał", None, "zastosowana", "x", t, 8)], LOG.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    made = frame(spark, "batch_id long, created string", (7, "2026-09-02"), (8, "2026-09-09")).withColumn("created", F.to_timestamp("created"))
    none = frame(spark, "batch_id long")
    raw = frame(spark, CELL, ("1", "Materiał", "drewno"), ("2", "Materiał", "plyta"), ("3", "Materiał", "metal"), ("5", "Materiał", "x"))
    now = raw.select("id").distinct()
    states = decisions.verify(log, made, none, now, raw, F.lit("2026-09-03").cast("timestamp"))
    assert {r.id: r.state for r in states.collect()} == {"1": "weszlo", "2": "bez_zmian", "3": "inna_wartosc", "4": "brak_produktu"}
    assert decisions.verified_summary(states).first().effectiveness == 25.0
    assert decisions.verify(log, made, frame(spark, "batch_id long", (7,)), now, raw, F.lit("2026-09-03").cast("timestamp")).count() == 0
    later = log.where("seq = 1").withColumns({"seq": F.lit(9).cast("long"), "status": F.lit("cofnieta")})
    assert decisions.current(log.unionByName(later)).count() == 4
    assert decisions.undo(log, log).count() == 0


def test_queue_counters_and_scope_agree(spark):
    f = spark.range(40).select(F.col("id").alias("fid"), (F.col("id") % 7).cast("string").alias("id"), F.lit("A1").alias("attr"), F.lit("R").alias("rule_id"), F.lit("L1").alias("layer"), F.lit("info").alias("severity"), (F.col("id") / 40).alias("confidence"), F.concat(F.lit("o"), (F.col("id") % 3).cast("string")).alias("old_value"), F.when(F.col("id") % 2 == 0, "n").alias("new_value"), (F.col("id") % 4).cast("string").alias("grp"))
    p = spark.range(7).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name"), F.lit("p").alias("producer"), F.lit("c").alias("category"), F.lit("u").alias("photo"), F.lit(1).alias("node"))
    log = spark.range(2).select(F.col("id").alias("seq"), F.lit("0").alias("id"), F.lit("A1").alias("attr"), F.lit("o0").alias("old_value"), F.when(F.col("id") == 1, "zastosowana").otherwise("odlozona").alias("status"), F.lit("n").alias("new_value"), F.current_timestamp().alias("ts"), F.lit(None).cast("long").alias("batch_id"))
    rows = review.base(f, p, log).cache()
    c = review.counters(rows).first()
    assert c.findings == 40 and c.open + c.decided == 40 and c.auto + c.photo + c.human == c.open and c.critical + c.middle + c.info == c.open and c.applied == c.decided > 0
    page = {r.grp: r.n for r in review.group_page(rows.where("status is null")).collect()}
    assert sum(page.values()) == c.open and all(review.group_members(rows.where("status is null"), g).count() == n for g, n in page.items())
    assert sum(r.n for r in review.facets(rows, {}, {"attr": "attr"}).collect()) == 40


def test_reconcile_leaves_one_for_a_cell(spark):
    e = frame(spark, "id string, v string, s double", ("1", "a", 0.9), ("2", "a", 0.7), ("3", None, 0.9), ("4", None, 0.9))
    g = frame(spark, "id string, v string, s double", ("1", "b", 0.8), ("2", "a", 0.8), ("3", "b", 0.8), ("4", None, 1.0))
    make = lambda d, rule: fs.emit(d, rule, "L2", "info", F.col("s"), attr=F.lit("A"), new=F.col("v"))
    one, two = gaps.reconcile(make(e, "R"), make(g, "L2-LUKA-NAZWA"))
    assert [(r.id, r.new_value, r.confidence, "SPOR" in r.grp) for r in one.collect()] == [("1", "a", 0.6, True)]
    assert sorted((r.id, r.new_value, r.confidence) for r in two.collect()) == [("2", "a", 0.8), ("3", "b", 0.8), ("4", None, 1.0)]


def test_tree(spark):
    rows = frame(spark, "node int, name string, level int, pos int, hidden boolean", (1, "Meble", 0, 0, False), (2, "Szafy", 1, 1, False), (3, "Szafy przesuwne", 2, 2, False), (4, "Szafy narożne duże", 2, 3, False), (5, "Stoły", 1, 4, True))
    t = tree.parents(rows)
    assert {r.node: r.parent for r in t.collect()} == {1: None, 2: 1, 3: 2, 4: 2, 5: 1}
    pairs = frame(spark, "type string, subtype string", ("Szafy", "szafa przesuwna"), ("Szafy", "Narożna"), ("Szafy", ""), ("Stoły", ""), ("szafy", "szafy przesuwne"))
    none = frame(spark, "type string, subtype string, node int")
    got = tree.assign(pairs, rows, tree.closure(t), none, none.drop("subtype"), none.select("type"))
    assert {(r.type, r.subtype): (r.node, r.how) for r in got.collect()} == {("Szafy", "szafa przesuwna"): (2, "type"), ("Szafy", "Narożna"): (4, "stems"), ("Szafy", ""): (2, "type"), ("Stoły", ""): (None, "none"), ("szafy", "szafy przesuwne"): (3, "subtype")}


def test_feeds(spark):
    pairs = frame(spark, "source string, attr string, theirs double, ours double", *(("S", "Szerokość", 1200.0, 120.0),) * 6, *(("S", "Waga", 5.0, 5.0),) * 4)
    assert [(r.attr, r.scale, r.share) for r in feeds.scales(pairs).collect()] == [("Szerokość", 0.1, 1.0)]
    votes = frame(spark, "id string, attr string, source string, num double, method string", ("1", "W", "a", 140.0, "kod"), ("1", "W", "b", 141.0, "kod"), ("2", "W", "a", 140.0, "kod"), ("2", "W", "b", 90.0, "kod"), ("3", "W", "a", 50.0, "nazwa"), ("4", "W", "a", 1200.0, "kod"))
    nums = frame(spark, NUM, ("1", "W", 100.0), ("4", "W", 120.0))
    found, conflicts = feeds.compare(feeds.consensus(votes), nums, nums.select("id", "attr"))
    assert sorted((r.id, r.rule_id, r.confidence) for r in found.collect()) == [("1", "L4-ROZJAZD", 0.87), ("3", "L4-UZUPELNIA", 0.55)]
    assert sorted((r.id, r.reason) for r in conflicts.collect()) == [("2", "zrodla"), ("4", "jednostki")]
    p = frame(spark, "id string, name string, producer string, collection string", ("1", "Komoda trzydrzwiowa Avola", "P", "Avola"), ("2", "Szafa", "P", "Avola"))
    items = frame(spark, "source string, key string, producer string, collection string, name string", ("S", "k1", "P", "Avola", "Avola komoda trzydrzwiowa"), ("S", "k2", "P", "Avola", "szafka nocna"), ("S", "k3", "Q", "Avola", "Szafa"))
    assert [(r.id, r.key) for r in feeds.match_by_name(p, items).collect()] == [("1", "k1")]


def test_photos(spark):
    v = frame(spark, "seq long, id string, attr string, verdict string, read string, confidence double", (1, "1", "A", "niezgodne", "x", 0.9), (2, "1", "A", "zgodne", "", 0.9), (3, "2", "A", "niezgodne", "y", 0.9), (4, "2", "A", "blad", "", 0.0))
    assert [(r.id, r.read) for r in photos.latest_reads(v).collect()] == [("2", "y")]


def test_upkeep(spark):
    cells = frame(spark, "attr string, cell string", ("A", "1|biały, 2|czarny"), ("A", "3|Biały"), ("B", "free"), ("A", "free"))
    ids, plain = maintenance.learn(cells)
    assert {r.n: r.ids for r in ids.collect()} == {"bialy": ["1", "3"], "czarny": ["2"]} and [r.attr for r in plain.collect()] == ["B"]
    known = frame(spark, "old string, new string", ("A", "B"))
    assert sorted(map(tuple, maintenance.add_renames(known, frame(spark, "old string, new string", ("B", "C"))).collect())) == [("A", "C"), ("B", "C")]


def test_readers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿ID;Nazwa;Kategoria;Atrybuty;Zdjęcia;SKU\n1;"Stół ""A""";stoły;Waga: 5 | Waga: 6 | x;Front: http://a/b: 1 | Tył: https://c/d;K1\n;bez id;;;;\n', encoding="utf-8")
    r = readers.read_catalogue(spark, str(path)).collect()
    assert len(r) == 1 and r[0].name == 'Stół "A"' and r[0].attributes == {"Waga": "6"} and r[0].codes == {"sku": "K1"} and [p.url for p in r[0].photos] == ["http://a/b:", "https://c/d"]
    assert readers.separator(spark, str(path)) == ";"
    docs = frame(spark, "source string, json string", ("a", '[{"k": 1}, {"k": null}]'), ("b", '{"x": [{"k": 2}], "y": [{"k": 3}, {"k": 4}], "z": "t"}'), ("c", "no json"))
    assert sorted(map(tuple, readers.json_records(docs).collect())) == [("a", 0, "k", "1"), ("a", 1, "k", ""), ("b", 0, "k", "3"), ("b", 1, "k", "4")]


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.csv").write_text(f"id;nazwa\n{k};x\n")
    out = str(tmp_path / "out")
    run = lambda products, n: products.select("id").withColumn("run", F.lit(n)).write.mode("append").parquet(out)
    for _ in range(2):  # the second time nothing is new
        arrivals.watch(spark, str(tmp_path / "in"), ["id", "nazwa"], str(tmp_path / "check"), run).awaitTermination()
    assert sorted((r.id, r.run) for r in spark.read.parquet(out).collect()) in ([("0", 0), ("1", 1)], [("0", 1), ("1", 0)])


def test_producers_and_daily(spark):
    products = spark.range(20).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 10, "BRW").otherwise("Halmar").alias("producer"))
    log = spark.range(8).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.lit("A").alias("attr"), F.lit("o").alias("old_value"), F.when(F.col("id") < 6, "zastosowana").otherwise("falszywy_alarm").alias("status"), F.lit("n").alias("new_value"), F.lit("2026-01-01").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("batch_id"))
    m = {r.producer: r for r in analytics.producers(products, log.select("id"), log).collect()}
    assert (m["BRW"].precision, m["BRW"].errors_per_product, m["Halmar"].precision) == (0.75, 0.6, None)
    assert analytics.half_of_errors(analytics.producers(products, log.select("id"), log)).first().producers == 1


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
