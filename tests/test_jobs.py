"""Jobs: that every detector and every gap takes part."""

from pyspark.sql import functions as F

from shelfwise.plans import jobs
from test_operators import CELL, frame


def test_all_findings_of_a_snapshot(spark, tmp_path):
    n = 40
    products = [(str(k), "Szafa" if k else "Szafa bez drzwi 3-szufladowa", "p", "c", "szafa", "u", {"Szerokość": "1000" if k == 1 else str(90 + k % 10), "Wysokość": "50" if k == 2 else "200", "Drzwi": "tak", "Styl": "loft", "Kod": "x", "Liczba szuflad": "1 szuflada"}) for k in range(n)]
    products[3][6].pop("Styl")
    products[4][6].pop("Styl")
    products[5][6].pop("Wysokość")
    products += [("sparse", "Szafa", "p", "c", "szafa", "", {"Drzwi": "tak", "Kod": "x"})]
    p = frame(spark, "id string, name string, producer string, collection string, category string, photo string, attributes map<string, string>", *products)
    rule = lambda schema, *rows: frame(spark, schema, *rows)
    config = {
        "kinds": rule("attr string, kind string", ("Szerokość", "liczba"), ("Wysokość", "liczba"), ("Styl", "enum"), ("Liczba szuflad", "enum")),
        "dictionary": rule("attr string, pos int, label string", ("Styl", 0, "loft"), ("Liczba szuflad", 0, "1 szuflada"), ("Liczba szuflad", 1, "3 szuflady")),
        "aliases": rule("attr string, alias string, label string"),
        "panel": rule("attr string, status string", ("Styl", "ACTIVE")),
        "junk": rule("attr string, reason string", ("Kod", "old")),
        "disabled_rules": rule("rule_id string"),
        "disabled_attrs": rule("attr string"),
        "conditions": rule("rule_id string, attr string, value string", ("SPR", "Drzwi", "tak")),
        "forbidden": rule("rule_id string, attr string", ("SPR", "Styl")),
        "fragments": rule("rule_id string, fragment string", ("SPR", "bez drzwi")),
        "relations": rule("rule_id string, low string, high string, strict boolean", ("REL", "Szerokość", "Wysokość", False)),
        "category_filters": rule("category string, attr string", ("szafa", "Styl"), ("szafa", "Kolor"), ("szafa", "Głębia")),
        "optional": rule("attr string", ("Głębia",)),
    }
    votes = [(k, a, s, x, "kod") for k, a, x in (("6", "Szerokość", 300.0), ("7", "Szerokość", 97.0), ("8", "Waga", 5.0), ("5", "Wysokość", 210.0), ("gone", "Waga", 5.0)) for s in ("S1", "S2")] + [("9", "Waga", "S1", 5.0, "kod"), ("9", "Waga", "S2", 9.0, "kod")]
    config["votes"] = rule("id string, attr string, source string, num double, method string", *votes)
    sent = ((1, "10", "Styl", "x", "zastosowana", "loft", 7), (2, "11", "Styl", "loft", "zastosowana", "glamour", 7), (3, "12", "Styl", "x", "zastosowana", "loft", 8), (4, "gone", "Styl", "x", "zastosowana", "loft", 7))
    config["decisions"] = rule("seq long, id string, attr string, old_value string, status string, new_value string, batch_id long", *sent).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    config["batches"] = rule("batch_id long, created string", (7, "2026-01-02"), (8, "2026-03-01")).withColumn("created", F.to_timestamp("created"))
    config["withdrawn"], config["taken_at"] = rule("batch_id long"), rule("at string", ("2026-02-01",)).select(F.to_timestamp("at"))
    components = frame(spark, CELL, ("4", "Styl", "loft"))
    jobs.run_snapshot(p, components, config, str(tmp_path), 1)
    found = spark.read.parquet(f"{tmp_path}/findings").collect()
    has = {(r.rule_id, r.id, r.attr) for r in found}
    assert {("L1-KLUCZ-SMIEC", "0", "Kod"), ("SPR", "0", "Styl"), ("SPR-NAZWA", "0", "Drzwi"), ("REL", "2", "Szerokość"), ("L2-SKALA", "1", "Szerokość"), ("L2-NAZWA-ROZJAZD", "0", "Liczba szuflad")} <= has
    assert {x for x in has if x[2] == "Styl" and x[1] in ("3", "4")} == {("L2-LUKA-RODZINA", "3", "Styl"), ("L0-ZE-SKLADOWYCH", "4", "Styl")}  # a gap in place of L1-BRAK-WYMAGANEGO; none where layer 0 has the value
    assert {x[1] for x in has if x[0] == "L1-LUKA-BRAK" and x[2] == "Kolor"} == {str(k) for k in range(n)} and not any(x[2] == "Głębia" for x in has)
    assert ("L1-BRAK-WYMAGANEGO", "5", "Wysokość") in has
    assert not any(x[1] == "sparse" for x in has)
    assert {(r.id, r.attr, r.rule_id, r.new_value) for r in found if r.layer == "L4"} == {("6", "Szerokość", "L4-ROZJAZD", "300"), ("8", "Waga", "L4-UZUPELNIA", "5"), ("5", "Wysokość", "L4-UZUPELNIA", "210")}
    assert [(r.id, r.reason) for r in spark.read.parquet(f"{tmp_path}/conflicts").collect()] == [("9", "zrodla")]
    assert {(r.id, r.state) for r in spark.read.parquet(f"{tmp_path}/verified").collect()} == {("10", "weszlo"), ("11", "bez_zmian"), ("gone", "brak_produktu")}
    assert {r.grp for r in found if r.rule_id == "L1-LUKA-BRAK"} == {"L1-LUKA-BRAK|szafa|Kolor|p"}


def test_registered_import_has_all_parts(spark):
    from shelfwise.plans import cells

    n = {r.rule_id: r["count"] for r in cells.all_findings(spark, "/root/testdata/sf0.001").groupBy("rule_id").count().collect()}
    assert {"SPR-SZUFLADY", "SPR-DRZWI-NAZWA", "REL-SZER-WYS", "L2-NAZWA-ROZJAZD", "L2-LUKA-PODTYP", "L1-LUKA-BRAK"} <= set(n)
    assert n.keys() & {"L2-SKALA", "L2-OUTLIER"} and "L2-DUPLIKAT" not in n
