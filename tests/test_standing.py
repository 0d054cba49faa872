"""The queue as a table that follows its inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import review, standing
from shelfwise.plans import queue as plans

LOG = "seq long, id string, attr string, old_value string, status string, new_value string, ts timestamp, batch_id long"
AT = dt.datetime(2026, 1, 1)


def decision(seq, pid, attr="A", old="x", status="zastosowana", new="y", day=0, batch=None):
    return (seq, str(pid), attr, old, status, new, AT + dt.timedelta(days=day), batch)


@pytest.fixture()
def parts(spark, tmp_path):
    findings = spark.createDataFrame([(k, str(k), a, "R", "info", 0.9, "x", "y", "L1", f"g{k % 3}") for k in range(40) for a in ("A", "B")], "fid long, id string, attr string, rule_id string, severity string, confidence double, old_value string, new_value string, layer string, grp string")
    products = spark.createDataFrame([(str(k), f"n{k}", "p", "c", "", k % 2) for k in range(40)], "id string, name string, producer string, category string, photo string, node int")
    return findings, products, spark.createDataFrame([decision(1, 1), decision(2, 2, day=5)], LOG)


def state(rows):
    return {(r.id, r.attr): (r.status, r.decided_value, r.batch_id) for r in rows.where("status is not null").collect()}


def test_a_decision_between_pages_shows(spark, tmp_path, parts):
    findings, products, log = parts
    q = standing.Queue(spark, f"{tmp_path}/q", 8)
    assert q.build(findings, products, log) == 1
    first = review.count(q.read().where("status is null")).first().findings
    assert q.decide(spark.createDataFrame([decision(3, 7)], LOG)) == 2
    assert review.count(q.read().where("status is null")).first().findings == first - 1 == 77
    one, two = q.versions.read(1), q.versions.read(2)
    part = str(spark.range(1).select(F.pmod(F.xxhash64(F.lit("7")), F.lit(8))).first()[0])
    assert two["rewritten"] == [part] and {p for p in one["parts"] if one["parts"][p] != two["parts"][p]} == {part}
    assert state(q.read(1)).keys() == {("1", "A"), ("2", "A")}  # an older version stays readable
    q.clean(1)
    assert q.read().count() == 80


def test_changes_may_come_late_twice_and_be_taken_back(spark, tmp_path, parts):
    findings, products, log = parts
    changes = [
        [decision(9, 3, day=3), decision(8, 3, status="falszywy_alarm", day=2)],  # the later counts
        [decision(3, 2, status="odlozona", day=1)],  # older than what the row holds
        [decision(10, 1, status="cofnieta", day=6), decision(11, 99), decision(12, 4, old="other"), decision(13, 5, batch=4)],
        [decision(10, 1, status="cofnieta", day=6)],
        [decision(14, 1, status="odlozona", new="z", day=7)],
    ]
    q = standing.Queue(spark, f"{tmp_path}/q", 4)
    q.build(findings, products, log)
    whole = log
    for rows in changes:
        more = spark.createDataFrame(rows, LOG)
        q.decide(more)
        whole = whole.unionByName(more)
        assert state(q.read()) == state(review.base(findings, products, whole))
    assert state(q.read()) == {("1", "A"): ("odlozona", "z", None), ("2", "A"): ("zastosowana", "y", None), ("3", "A"): ("zastosowana", "y", None), ("5", "A"): ("zastosowana", "y", 4)}
    q.judge(spark.createDataFrame([("6", "B", "zle", 5), ("6", "B", "dobrze", 4), ("77", "B", "zle", 1)], "id string, attr string, verdict string, seq long"))
    q.judge(spark.createDataFrame([("6", "B", "dobrze", 3)], "id string, attr string, verdict string, seq long"))
    assert {(r.id, r.attr, r.verdict) for r in q.read().where("verdict is not null").collect()} == {("6", "B", "zle")}


def test_writers_lose_no_changes(spark, tmp_path, parts, monkeypatch):
    findings, products, log = parts
    mine, other = standing.Queue(spark, f"{tmp_path}/q", 1), standing.Queue(spark, f"{tmp_path}/q", 1)
    mine.build(findings, products, log)
    write, raced = mine._write, []

    def slow(rows):
        if not raced:
            raced.append(other.decide(spark.createDataFrame([decision(20, 20)], LOG)))
        return write(rows)

    monkeypatch.setattr(mine, "_write", slow)
    assert mine.decide(spark.createDataFrame([decision(21, 21)], LOG)) == 3 and raced == [2]
    assert {("20", "A"), ("21", "A")} <= state(mine.read()).keys()


def test_empty_queues(spark, tmp_path, parts):
    findings, products, log = parts
    q = standing.Queue(spark, f"{tmp_path}/q", 4)
    q.build(findings.limit(0), products, log)
    q.decide(log)
    q.decide(log.limit(0))
    assert q.read().count() == 0 and "status" in q.read().columns


def test_the_registered_queue_follows_its_tables(spark, tmp_path):
    for name, n in (("events", 400), ("customer", None)):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (rows.limit(n) if n else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    before = plans.q5_count(spark, d).first(), plans.q11_counters(spark, d).first().findings
    same = plans.standing_queue(spark, d).version()
    assert plans.standing_queue(spark, d).version() == same == 1
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(150).write.mode("overwrite").parquet(f"{d}/events.parquet")
    assert plans.q11_counters(spark, d).first().findings < before[1] and plans.standing_queue(spark, d).version() == 2
