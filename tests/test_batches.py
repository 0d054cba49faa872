"""Batches: taken once, withdrawn, and two planners at once."""

import datetime as dt

import pytest

from shelfwise.operators import batches, decisions

LOG = "seq long, id string, attr string, old_value string, status string, new_value string, ts timestamp, batch_id long"


@pytest.fixture()
def parts(spark, tmp_path):
    made = spark.createDataFrame([(k, str(k), "Materiał", "plyta", "zastosowana", "drewno", dt.datetime(2026, 1, k), None) for k in (1, 2, 3)], LOG)
    products = spark.createDataFrame([(str(k), "c", "p") for k in range(1, 10)], "id string, category string, producer string")
    checked = spark.createDataFrame([(str(k), "Materiał", "drewno", "2104|drewno", None) for k in range(1, 10)], "id string, attr string, value string, text string, reason string")
    return made, products, checked


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_batches_take_what_is_not_exported(spark, tmp_path, parts):
    b = batches.Batches(spark, f"{tmp_path}/b")
    assert b.take(*parts, 2) == 1 and ids(b.rows()) == ["1", "2"]
    assert b.take(*parts, 50) == 2 and ids(b.rows().where("batch_id = 2")) == ["3"]
    assert b.take(*parts, 50) is None and b.versions.latest() == 2
    assert ids(decisions.waiting(b.of_log(parts[0]))) == []
    assert b.withdraw(1) == 2 and b.withdraw(1) == 0 and b.withdraw(9) == 0
    assert ids(decisions.waiting(b.of_log(parts[0]))) == ["1", "2"]
    assert b.take(*parts, 50) == 4 and ids(b.rows().where("batch_id = 4")) == ["1", "2"]
    assert {(r.batch_id, r.products, r.decisions, r.withdrawn) for r in b.table().collect()} == {(1, 2, 0, True), (2, 1, 1, False), (4, 2, 2, False)}


def test_a_decision_made_anew_waits_again(spark, tmp_path, parts):
    made, products, checked = parts
    b = batches.Batches(spark, f"{tmp_path}/b")
    b.take(made, products, checked, 50)
    more = made.unionByName(spark.createDataFrame([(9, "1", "Materiał", "plyta", "zastosowana", "drewno", dt.datetime(2026, 2, 1), None)], LOG))
    assert b.take(more, products, checked, 50) == 2 and ids(b.rows().where("batch_id = 2")) == ["1"]
    off = spark.createDataFrame([("Materiał",)], "attr string")
    assert batches.Batches(spark, f"{tmp_path}/c").take(made, products, checked, 50, disabled=off) is None


def test_requests_come_back_too(spark, tmp_path, parts):
    asked = spark.createDataFrame([("3", None), ("7", None)], "id string, batch_id long")
    b = batches.Batches(spark, f"{tmp_path}/b")
    assert b.take(*parts, 5, asked) == 1
    assert ids(b.rows()) == ["1", "2", "3", "7"] and ids(b.of_requests(asked).where("batch_id is null")) == []
    b.withdraw(1)
    assert ids(b.of_requests(asked).where("batch_id is null")) == ["3", "7"]


def test_two_planners_take_no_decision_twice(spark, tmp_path, parts, monkeypatch):
    mine, other = batches.Batches(spark, f"{tmp_path}/b"), batches.Batches(spark, f"{tmp_path}/b")
    plan, raced = decisions.plan, []

    def slow(*a):
        out = plan(*a)
        if not raced:
            raced.append(None)
            raced[0] = other.take(*parts, 2)
        return out

    monkeypatch.setattr(decisions, "plan", slow)
    assert mine.take(*parts, 2) == 2 and raced == [1]
    assert sorted((r.batch_id, r.id) for r in mine.rows().collect()) == [(1, "1"), (1, "2"), (2, "3")]
