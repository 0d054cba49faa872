"""Queries over all rows, against plain versions."""

import re

from shelfwise.plans.registry import ORACLE_SQL
from shelfwise.plans.bridge import view

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SUFFIXES = ("-drzwiowa z szufladami", "dwudrzwiowa", "z szuflada", "bez drzwi", "2d1w3s", "{size}", "sr.", "z szufladami", "cm", "", "", "")


def _duck(sql, sf=SF):
    import duckdb

    c = duckdb.connect()
    for name in ("part",):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c.execute(re.sub(r"\bstring\b", "varchar", sql)).fetchall()


def test_comparable_names_of_all_products(spark):
    from shelfwise.plans import cells

    plain = {r.p_partkey: (r.p_name, f"{10 + r.p_size}x{100 + r.p_partkey % 90}") for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    got = {int(r.id): r.compared for r in cells.f23_comparable_name_all(spark, SF).collect()}
    assert {k % 12 for k in got} == set(range(12)) and len(got) == view(spark, SF, "products").count()
    for k, (name, size) in plain.items():
        one = f"{name} {SUFFIXES[k % 12].format(size=size)}".strip()
        assert got[k] == " ".join(w for w in f"{one} {one}".split() if w not in ("gadget", "red")), k


def test_producers_of_all_tabs(spark):
    from shelfwise.plans import cells

    got = sorted(map(tuple, cells.f40_producer_of_tab_all(spark, SF).collect()))
    assert got == sorted(_duck(ORACLE_SQL["f40_producer_of_tab_all"]))
    assert {("Brand12Stock", "Brand#1"), ("Brand7", "Brand#7"), ("Brand9LogisticsOurs", "Brand#9"), ("Brand8productV2", "Brand#8")} & set(got) and len({t for t, _ in got}) == len(got)


def test_gaps_of_all_sources(spark):
    from shelfwise.plans import more

    got = [tuple(r) for r in more.g9_best_of_all(spark, SF2).collect()]
    sql = [(*r[:5], float(r[5])) for r in _duck(ORACLE_SQL["g9_best_of_all"], SF2)]
    key = lambda r: tuple(map(str, (*r[:5], round(r[5], 4))))
    assert sorted(map(key, got)) == sorted(map(key, sql))
    assert {"L2-LUKA-" + x for x in ("PODTYP", "NAZWA", "ROZMIAR", "ROZMIAR-SPRZECZNE", "FUNKCJA-SPANIA", "ZDJECIE", "RODZINA")} <= {r[2] for r in got}
    left = sorted(map(tuple, more.g10_remaining_of_all(spark, SF2).collect()))
    print(len(got), len(left))
    assert left == sorted(_duck(ORACLE_SQL["g10_remaining_of_all"], SF2)) and not set(left) & {r[:2] for r in got}
