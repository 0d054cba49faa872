"""The import from file to findings, committed once, and versions of a folder."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import imports, jobs
from shelfwise.sources import log, readers, tables
from shelfwise.streaming import arrivals

SF = "/root/testdata/sf0.001"


def test_versions_are_made_once(spark, tmp_path):
    one, two = log.Versions(spark, f"{tmp_path}/v"), log.Versions(spark, f"{tmp_path}/v")
    assert one.latest() == 0 and not one.has(1)
    assert one.commit(1, {"by": "one"}) and not two.commit(1, {"by": "two"})
    assert two.read(1) == {"by": "one"} and two.latest() == 1
    assert not [f for f in (tmp_path / "v").iterdir() if f.name.endswith(".json") and f.name[0] == "."]


def test_a_lost_race_is_tried_again(spark, tmp_path):
    versions, seen = log.Versions(spark, f"{tmp_path}/v"), []

    def make(last):
        seen.append(last)
        if len(seen) == 1:  # another writer is first
            versions.commit(last + 1, {"by": "other"})
        return {"by": "me", "after": last}

    assert versions.append(make) == (2, {"by": "me", "after": 1}) and seen == [0, 1]
    with pytest.raises(RuntimeError):
        versions.append(lambda last: versions.commit(last + 1, {}) and {}, 2)


def test_a_batch_that_comes_twice_leaves_each_row_once(spark, tmp_path):
    own = imports.config(spark, SF)
    readers.save_csv(imports.export(spark, SF).coalesce(1), f"{tmp_path}/in")
    arrivals.imports(spark, f"{tmp_path}/in", imports.COLUMNS, f"{tmp_path}/offsets", own, f"{tmp_path}/runs").awaitTermination()
    runs = log.Runs(spark, f"{tmp_path}/runs")
    before = sorted(map(str, runs.table("findings").collect()))
    assert runs.latest() == 0 and len(before) == runs.versions.read(0)["findings"] > 100
    # the driver was lost before Spark noted the batch: a new query takes it again
    arrivals.imports(spark, f"{tmp_path}/in", imports.COLUMNS, f"{tmp_path}/other-offsets", own, f"{tmp_path}/runs").awaitTermination()
    assert sorted(map(str, runs.table("findings").collect())) == before
    # and lost before the run was committed: what it left is replaced
    (tmp_path / "runs" / "_runs" / "000000000000.json").unlink()
    spark.createDataFrame([("x", "left over")], "id string, attr string").write.mode("append").parquet(f"{tmp_path}/runs/findings/run_id=0")
    jobs.import_products(readers.read_catalogue(spark, f"{tmp_path}/in"), own, f"{tmp_path}/runs", 0)
    assert sorted(map(str, runs.table("findings").collect())) == before
    # a run that broke off is not seen
    spark.range(3).write.parquet(f"{tmp_path}/runs/findings/run_id=1")
    assert runs.latest() == 0 and sorted(map(str, runs.table("findings").collect())) == before
    with pytest.raises(ValueError, match="committed"):
        runs.save(spark.range(1), "findings", 0)


def test_categories_and_nodes_of_scanned_rows(spark):
    rows = [("1", "Szafa ring", "Economy", "stojące meble"), ("2", "gadget", None, None), ("3", None, "nowy typ", ""), ("3", "mały widget", "nowy typ", ""), ("4", "x", "INNE", "a"), ("5", "x", "STANDARD", "Narożna")]
    scanned = spark.createDataFrame(rows, "id string, name string, type string, subtype string")
    own = imports.config(spark, SF)
    got = {r.id: (r.name, r.category, r.category_source, r.node, r.node_by) for r in jobs.prepared(scanned, own).collect()}
    assert got == {
        "1": ("Szafa ring", "tanie", "sklep", 3, "stems"),
        "2": ("gadget", "przyrzad", "nazwa", None, "none"),
        "3": ("mały widget", "przyrzad", "sklep_niezmapowany", None, "none"),
        "4": ("x", "nieznana", "sklep_niezmapowany", None, "excluded"),
        "5": ("x", "nieznana", "sklep_niezmapowany", 1, "pair"),
    }
    side = spark.createDataFrame([("2", "Economy", "y"), ("1", "z", "z")], "id string, type string, subtype string")
    assert {r.id: r.type for r in jobs.prepared(scanned, {**own, "side": side}).where(F.col("id") < "3").collect()} == {"1": "Economy", "2": "Economy"}


def test_cut_off_components_are_no_values(spark, tmp_path):
    """A product whose components the shop has cut off lacks the filter; where it hasn't, they have the value."""
    rows = [(str(k), "Szafa", "p", "c", "u", "ECONOMY", "", "Styl: loft | Szerokość: 90 | Wysokość: 80", "Kolor: biały" if k < 4 else "", "1" if k < 2 else "") for k in range(6)]
    scanned = readers.catalogue(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in imports.COLUMNS)))
    jobs.import_products(scanned, imports.config(spark, SF), f"{tmp_path}/runs", 5)
    found = log.Runs(spark, f"{tmp_path}/runs").table("findings", 5).where("attr = 'Kolor' and layer <> 'L0'").collect()
    assert {(r.id, r.rule_id) for r in found} == {("0", "L1-LUKA-BRAK"), ("1", "L1-LUKA-BRAK"), ("4", "L1-LUKA-BRAK"), ("5", "L1-LUKA-BRAK")}


def _plans(spark, since):
    """Plans of what ran after the execution with that number, by their own."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {x.executionId(): x.physicalPlanDescription() for x in map(ran.apply, range(ran.size())) if x.executionId() > since}


def test_no_plan_of_an_import_holds_all_detectors(spark, tmp_path):
    """The driver holds a plan for each job, and makes it anew after each of its stages: one of all detectors took it hundreds of MB. The file is scanned by one job alone."""
    readers.save_csv(imports.export(spark, SF).coalesce(1), f"{tmp_path}/in")
    own, scanned = imports.config(spark, SF), readers.read_catalogue(spark, f"{tmp_path}/in")
    since = max(_plans(spark, -1))
    jobs.import_products(scanned, own, f"{tmp_path}/runs", 0)
    plans = _plans(spark, since).values()
    assert max(len(re.findall(r"^\(\d+\) (?:Scan|BroadcastExchange|Exchange)", p, re.M)) for p in plans) <= 60
    assert sum("Scan csv" in p for p in plans) == 1


def test_parts_gathered_are_one_table(spark):
    """In the columns of the first, whatever the order of the others', with empty parts and repeated rows."""
    one = spark.createDataFrame([("1", 1.5), ("1", 1.5), (None, None)], "id string, x double")
    got = tables.gathered([one, one.where("false"), spark.createDataFrame([(2, "2")], "x int, id string")], "parts")
    assert got.dtypes == [("id", "string"), ("x", "double")]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", 1.5), ("1", 1.5), ("2", 2.0), (None, None)]
