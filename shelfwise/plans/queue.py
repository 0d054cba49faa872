"""Queries of the review queue, decisions, verification and analytics, over events as findings and decisions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from shelfwise.operators import analytics, batches, decisions, review, standing
from shelfwise.plans.bridge import norm_sql, oracle, table, view
from shelfwise.plans.registry import query
from shelfwise.sources import tables

CUR = """, cur AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id, attr, hash ORDER BY ts DESC, seq DESC) AS rn FROM (SELECT *, substr(sha1(coalesce(old_value, '')), 1, 12) AS hash FROM decisions)) WHERE rn = 1)"""
BASE = oracle("findings", "people", "decisions") + CUR + """, b AS (SELECT f.*, p.name, p.producer, p.category, p.photo, p.node, c.status, c.new_value AS decided_value, c.batch_id,
CASE WHEN f.confidence >= 0.85 AND f.new_value IS NOT NULL THEN 'auto' WHEN f.confidence < 0.85 AND p.photo <> '' AND f.attr IN ('A1', 'A2', 'A3') THEN 'photo' ELSE 'human' END AS route,
CASE f.severity WHEN 'krytyczna' THEN 0 WHEN 'srednia' THEN 1 ELSE 2 END AS rank
FROM (SELECT *, substr(sha1(coalesce(old_value, '')), 1, 12) AS hash FROM findings) f JOIN people p ON p.id = f.id LEFT JOIN cur c ON c.id = f.id AND c.attr = f.attr AND c.hash = f.hash)"""
#: Attributes of these findings that a photo can show.
SHOWN = ("A1", "A2", "A3")
READY = "confidence >= 0.85 AND new_value IS NOT NULL"


def base(spark, d):
    return review.base(view(spark, d, "findings"), view(spark, d, "people"), view(spark, d, "decisions"))


def standing_queue(spark, d) -> standing.Queue:
    """The application's queue of these tables: made at the first page, and anew when a table's files change."""
    queue = standing.Queue(spark, f"{tables.shared_dir(spark)}/queue-{hashlib.sha1(d.encode()).hexdigest()}")
    inputs = standing.inputs_of(spark, f"{d}/events.parquet", f"{d}/customer.parquet")
    if not queue.follows(inputs):
        queue.build(view(spark, d, "findings"), view(spark, d, "people"), view(spark, d, "decisions"), inputs=inputs)
    return queue


def queue(spark, d):
    """The queue as its pages read it: the latest version."""
    return standing_queue(spark, d).read()


@query(BASE + " SELECT fid, id, attr, hash, name, status, decided_value, batch_id FROM b")
def q0_standing_queue(spark, d):
    """A queue made with every third decision, and the others added as two changes: the same as all joined at once."""
    at = standing.Queue(spark, f"{tables.shared_dir(spark)}/queue-{uuid.uuid4().hex}")
    log = view(spark, d, "decisions")
    at.build(view(spark, d, "findings"), view(spark, d, "people"), log.where("seq % 3 = 1"))
    for rest in (2, 0):
        at.decide(log.where(f"seq % 3 = {rest}"))
    return at.read().select("fid", "id", "attr", "hash", "name", "status", "decided_value", "batch_id")


@query(BASE + " SELECT fid, id, attr, hash, name, status, decided_value, batch_id FROM b")
def q0_base(spark, d):
    return base(spark, d).select("fid", "id", "attr", "hash", "name", "status", "decided_value", "batch_id")


@query(BASE + " SELECT fid, id FROM b WHERE producer = 'P3' AND severity = 'krytyczna' AND status IS NULL AND photo <> '' AND rule_id LIKE 'L%'")
def q1_filters(spark, d):
    return base(spark, d).where(review.predicate(producer="P3", severity="krytyczna", is_open=True, photo=True, rule="L*")).select("fid", "id")


@query(BASE + " SELECT status IS NULL AS is_open, count(*) AS n FROM b GROUP BY 1")
def q2_open_and_decided(spark, d):
    rows = base(spark, d)
    part = lambda o: rows.where(review.predicate(is_open=o)).select(F.lit(o).alias("is_open"))
    return part(True).unionByName(part(False)).groupBy("is_open").agg(F.count("*").alias("n"))


@query(BASE + " SELECT fid, rule_id FROM b WHERE starts_with(rule_id, 'L2-LUKA-')")
def q3_rule_family(spark, d):
    return base(spark, d).where(review.predicate(rule="L2-LUKA-*")).select("fid", "rule_id")


@query(BASE + " SELECT route, count(*) AS n FROM b WHERE status IS NULL GROUP BY route")
def q4_routing(spark, d):
    return base(spark, d).where(review.predicate(is_open=True)).groupBy(review.routing(SHOWN).alias("route")).agg(F.count("*").alias("n"))


@query(BASE + " SELECT count(*) AS findings, count(DISTINCT grp) AS groups FROM b WHERE name ILIKE '%99%'")
def q5_count(spark, d):
    return review.count(base(spark, d).where(review.predicate(search="99")))


@query(BASE + """, g AS (SELECT grp, count(*) AS n, count(DISTINCT coalesce(new_value, '')) AS proposals, count(DISTINCT coalesce(old_value, '')) AS olds, min(rank) AS rank,
arg_min({'id': id, 'attr': attr, 'rule_id': rule_id, 'old_value': old_value, 'new_value': new_value}, (rank, id, fid)) AS f FROM b WHERE status IS NULL GROUP BY grp)
SELECT grp, n, proposals, olds, rank, proposals <= 1 AND olds <= 1 AS uniform, f.id, f.attr, f.rule_id, f.old_value, f.new_value FROM g ORDER BY rank, n DESC, grp LIMIT 50 OFFSET 10""")
def q6_group_page(spark, d):
    return review.group_page(queue(spark, d).where("status is null"), 50, 10)


@query(BASE + " SELECT fid, id, confidence FROM b WHERE status IS NULL ORDER BY rank, confidence DESC, id, fid LIMIT 50 OFFSET 20")
def q7_flat_page(spark, d):
    return review.flat_page(queue(spark, d).where("status is null"), 50, 20).select("fid", "id", "confidence")


@query(BASE + " SELECT fid, id FROM b WHERE grp = 'G5' ORDER BY producer, name, id, fid LIMIT 200")
def q8_group_members(spark, d):
    return review.group_members(queue(spark, d), "G5").select("fid", "id")


@query(BASE + f""", g AS (SELECT id, min(rank) AS rank, count(*) AS n, count(*) FILTER ({READY}) AS ready, list(fid ORDER BY rank, attr, fid) AS fids FROM b WHERE status IS NULL GROUP BY id) SELECT * FROM g ORDER BY rank, n DESC, id LIMIT 20""")
def q9_by_product(spark, d):
    return review.by_product(queue(spark, d).where("status is null"))


@query(BASE + """, o AS (SELECT * FROM b WHERE status IS NULL), f AS (SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM o WHERE attr = 'A3' GROUP BY severity
UNION ALL SELECT 'attr', attr, count(*) FROM o WHERE severity = 'info' GROUP BY attr
UNION ALL SELECT * FROM (SELECT 'producer', producer, count(*) AS n FROM o WHERE severity = 'info' AND attr = 'A3' GROUP BY producer ORDER BY n DESC, producer LIMIT 40)
UNION ALL SELECT 'severity', 'info', 0 UNION ALL SELECT 'attr', 'A3', 0) SELECT dimension, value, max(n) AS n FROM f GROUP BY 1, 2""")
def q10_facets(spark, d):
    return review.facets(queue(spark, d).where("status is null"), {"severity": "info", "attr": "A3"}, {"severity": "severity", "attr": "attr", "producer": "producer"})


@query(BASE + """ SELECT count(*) AS findings, count(*) FILTER (status IS NULL) AS open, count(status) AS decided, count(DISTINCT CASE WHEN status IS NULL THEN grp END) AS open_groups, count(DISTINCT CASE WHEN status IS NULL THEN id END) AS open_products,
count(*) FILTER (status IS NULL AND route = 'auto') AS auto, count(*) FILTER (status IS NULL AND route = 'photo') AS photo, count(*) FILTER (status IS NULL AND route = 'human') AS human,
count(*) FILTER (status IS NULL AND rank = 0) AS critical, count(*) FILTER (status IS NULL AND rank = 1) AS middle, count(*) FILTER (status IS NULL AND rank = 2) AS info,
count(*) FILTER (status = 'zastosowana') AS applied, count(*) FILTER (status = 'falszywy_alarm') AS false_alarms FROM b""")
def q11_counters(spark, d):
    return review.counters(queue(spark, d), SHOWN)


@query(BASE + " SELECT fid, attr, status FROM b WHERE id = '8'")
def q12_product_card(spark, d):
    return review.product_card(queue(spark, d), "8").select("fid", "attr", "status")


@query(BASE + " SELECT 'w5' AS scope, count(*) AS n FROM b WHERE node = 5 UNION ALL SELECT 'MACHINERY', count(*) FROM b WHERE category = 'MACHINERY'")
def q13_scope(spark, d):
    rows = base(spark, d)
    part = lambda s: rows.where(review.scope(s)).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n")
    return part("w5").unionByName(part("MACHINERY"))


@query(oracle("decisions") + CUR + " SELECT id, attr, hash, status, new_value, batch_id FROM cur")
def s14_current_decisions(spark, d):
    return decisions.current(view(spark, d, "decisions")).select("id", "attr", "hash", "status", "new_value", "batch_id")


@query(oracle("decisions") + CUR + " SELECT id, attr, old_value AS from_value, new_value AS to_value, 'correction' AS kind FROM cur WHERE status = 'zastosowana' UNION ALL SELECT id, attr, new_value, old_value, 'rollback' FROM cur WHERE status = 'zastosowana'")
def s15_corrections(spark, d):
    forward, back = decisions.corrections(view(spark, d, "decisions"))
    return forward.withColumn("kind", F.lit("correction")).unionByName(back.withColumn("kind", F.lit("rollback")))


@query(BASE + """ SELECT rule_id AS grp, count(*) AS n FROM b WHERE status IS NULL AND old_value = 'v1' AND new_value = 'w1' AND rule_id IN ('L1-ZAPIS', 'L2-LUKA-NAZWA') GROUP BY 1""")
def p1_decide_group(spark, d):
    rows = base(spark, d).withColumn("grp", F.col("rule_id"))
    alike = rows.where("old_value = 'v1' and new_value = 'w1'")
    out = [decisions.decide_group(r, g, decisions.APPLIED).groupBy().agg(F.count("*").alias("n")).select(F.lit(g).alias("grp"), "n").where("n > 0") for r, g in ((alike, "L1-ZAPIS"), (alike, "L2-LUKA-NAZWA"), (rows, "L2-OUTLIER"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(BASE + f" SELECT attr, old_value, new_value, 'zastosowana' AS status FROM b WHERE id = '8' AND status IS NULL AND {READY}")
def p2_decide_product(spark, d):
    return decisions.decide_product(base(spark, d), "8", decisions.APPLIED).select("attr", "old_value", "new_value", "status")


@query(BASE + """, m AS (SELECT DISTINCT id, attr FROM b WHERE grp = 'G7' AND status IS NULL) SELECT id, attr, 'n' || id AS new_value FROM m WHERE cast(id AS bigint) % 3 <> 0""")
def p3_decide_values(spark, d):
    people = view(spark, d, "people")
    given = people.select("id", F.when(F.col("id").cast("bigint") % 3 == 0, " ").otherwise(F.concat(F.lit("n"), "id")).alias("new_value"))
    return decisions.decide_values(base(spark, d), "G7", given, spark.sql("SELECT 'A1' AS attr")).select("id", "attr", "new_value")


@query(oracle("decisions") + CUR + " SELECT id, attr, 'cofnieta' AS status FROM cur WHERE batch_id IS NULL AND attr = 'A4'")
def p4_undo(spark, d):
    log = view(spark, d, "decisions")
    return decisions.undo(log, log.where("attr = 'A4'")).select("id", "attr", "status")


PANEL = "SELECT * FROM (VALUES ('A0', 'w0', '10'), ('A0', 'W0', '10'), ('A1', 'w1', '11'), ('A1', 'w1', '12'), ('A2', 'w2', '13'), ('A2', 'w4', '14')) AS t(attr, label, pid)"
COLUMNS = "SELECT * FROM (VALUES ('A0'), ('A1'), ('A2'), ('A3')) AS t(attr)"
CHECKED = f""", panel AS ({PANEL}), ids AS (SELECT attr, {norm_sql('label')} AS n, count(DISTINCT pid) AS kinds, min(pid) AS pid, min(label) AS label FROM panel GROUP BY 1, 2),
cells AS (SELECT DISTINCT id, attr, new_value AS value FROM decisions), chk AS (SELECT c.*, CASE WHEN c.attr > 'A3' THEN 'no column' WHEN c.attr = 'A3' THEN NULL WHEN i.kinds IS NULL THEN 'unknown' WHEN i.kinds > 1 THEN 'ambiguous' END AS reason,
CASE WHEN c.attr = 'A3' THEN c.value WHEN c.attr < 'A3' AND i.kinds = 1 THEN i.pid || '|' || i.label END AS text FROM cells c LEFT JOIN ids i ON i.attr = c.attr AND i.n = {norm_sql('c.value')})"""


def _checked(spark, d):
    cells = view(spark, d, "decisions").select("id", "attr", F.col("new_value").alias("value")).distinct()
    return decisions.dictionary_values(cells, spark.sql(PANEL), spark.sql(COLUMNS))


@query(oracle("decisions") + CHECKED + " SELECT id, attr, value, text, reason FROM chk")
def f32_p6_dictionary_values(spark, d):
    return _checked(spark, d)


REQUESTS = "SELECT cast(c_custkey AS string) AS id, cast(CASE WHEN c_custkey % 3 = 0 THEN 1 END AS bigint) AS batch_id FROM customer"
REQ = f", requests AS ({REQUESTS})"


def _requests(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 3 == 0, 1).cast("bigint").alias("batch_id"))


WAIT = ", w AS (SELECT * FROM cur WHERE status = 'zastosowana' AND new_value IS NOT NULL AND batch_id IS NULL)"


@query(oracle("people", "decisions") + CUR + WAIT + REQ + """, i AS (SELECT id FROM w UNION SELECT id FROM requests WHERE batch_id IS NULL)
SELECT 'category' AS kind, category AS value, count(*) AS products FROM people WHERE id IN (SELECT id FROM i) GROUP BY category UNION ALL SELECT 'producer', producer, count(*) FROM people WHERE id IN (SELECT id FROM i) GROUP BY producer""")
def p7_scopes(spark, d):
    return decisions.scopes(view(spark, d, "decisions"), _requests(spark, d), view(spark, d, "people"))


PLAN = oracle("people", "decisions") + CUR + WAIT + CHECKED + """, due AS (SELECT w.*, p.producer, p.category, c.text, c.reason FROM w JOIN people p ON p.id = w.id LEFT JOIN chk c ON c.id = w.id AND c.attr = w.attr AND c.value = w.new_value),
good AS (SELECT * FROM due WHERE reason IS NULL AND text IS NOT NULL), first AS (SELECT id, min((ts, seq)) AS f FROM good GROUP BY id ORDER BY f, id LIMIT 25), pl AS (SELECT g.*, x.last_batch FROM good g JOIN first f ON f.id = g.id LEFT JOIN (SELECT id, max(batch_id) AS last_batch FROM cur GROUP BY id) x ON x.id = g.id)"""


def _plan(spark, d):
    return decisions.plan(view(spark, d, "decisions"), view(spark, d, "people"), _checked(spark, d), 25)


@query(PLAN + " SELECT id, attr, hash, text, last_batch FROM pl")
def p8_plan(spark, d):
    return _plan(spark, d)[0].select("id", "attr", "hash", "text", "last_batch")


@query(PLAN + REQ + """, t AS (SELECT id FROM requests WHERE batch_id IS NULL EXCEPT SELECT id FROM pl), lim AS (SELECT id FROM t ORDER BY id LIMIT 30)
SELECT id, attr, text, 'change' AS why FROM pl UNION ALL SELECT c.id, c.attr, c.text, 'request' FROM chk c WHERE c.reason IS NULL AND c.text IS NOT NULL AND c.id IN (SELECT id FROM requests WHERE batch_id IS NULL) AND c.id IN (SELECT id FROM lim UNION SELECT id FROM pl)
AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.id = c.id AND pl.attr = c.attr)""")
def p9_requests(spark, d):
    return decisions.add_requests(_plan(spark, d)[0], _requests(spark, d), _checked(spark, d), 30)


@query(PLAN + " SELECT attr, new_value, coalesce(reason, 'unchecked') AS reason, count(*) AS n, min(id) AS example FROM due WHERE reason IS NOT NULL OR text IS NULL GROUP BY ALL")
def p10_skipped(spark, d):
    return decisions.skipped_summary(_plan(spark, d)[1])


@query(PLAN + " SELECT id, min(text) FILTER (attr = 'A3') AS \"A3\", min(text) FILTER (attr = 'A2') AS \"A2\", min(text) FILTER (attr = 'A0') AS \"A0\" FROM pl GROUP BY id")
def s16_wide_batch(spark, d):
    return decisions.wide(_plan(spark, d)[0], ["A3", "A2", "A0"])


MADE = "SELECT DISTINCT cast(o_orderkey % 40 AS bigint) AS batch_id, cast('2024-01-01' AS date) AS created FROM orders WHERE o_orderkey % 40 < 38"
GONE = "SELECT * FROM (VALUES (cast(3 AS bigint)), (cast(9 AS bigint))) AS t(batch_id)"


def _made(spark, d):
    return spark.sql(MADE.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@query(oracle("decisions") + CUR + f", made AS ({MADE}), gone AS ({GONE}) SELECT m.batch_id, m.created, CASE WHEN g.batch_id IS NOT NULL THEN 0 ELSE (SELECT count(*) FROM cur c WHERE c.batch_id = m.batch_id) END AS decisions, g.batch_id IS NOT NULL AS withdrawn FROM made m LEFT JOIN gone g ON g.batch_id = m.batch_id")
def p11_batches(spark, d):
    return decisions.batches(view(spark, d, "decisions"), _made(spark, d), spark.sql(GONE))


@query(oracle("people", "decisions") + CUR + WAIT + CHECKED + """, good AS (SELECT w.*, chk.text FROM w JOIN people p ON p.id = w.id JOIN chk ON chk.id = w.id AND chk.attr = w.attr AND chk.value = w.new_value WHERE chk.reason IS NULL AND chk.text IS NOT NULL AND w.attr <> 'A0'),
f AS (SELECT id, row_number() OVER (ORDER BY min((ts, seq)), id) AS rn FROM good GROUP BY id), t AS (SELECT * FROM (VALUES (1, 1, 25, true), (2, 26, 50, false), (4, 1, 25, false)) AS v(batch_id, low, high, withdrawn))
SELECT t.batch_id, t.withdrawn, g.id, g.attr, g.hash, g.text FROM good g JOIN f ON f.id = g.id JOIN t ON f.rn BETWEEN t.low AND t.high""")
def p11_take_and_withdraw(spark, d):
    """Two batches of 25 products, the first withdrawn, and one more, which takes the same decisions again. One attribute is out of circulation."""
    kept = batches.Batches(spark, f"{tables.shared_dir(spark)}/batches-{uuid.uuid4().hex}")
    log, people, checked, off = tables.written(view(spark, d, "decisions"), "log"), view(spark, d, "people"), tables.written(_checked(spark, d), "checked"), spark.sql("SELECT 'A0' AS attr")
    for _ in range(2):
        kept.take(log, people, checked, 25, disabled=off)
    kept.withdraw(1)
    kept.take(log, people, checked, 25, disabled=off)
    return kept.rows(withdrawn=True).join(kept.table().select("batch_id", "withdrawn"), "batch_id").select("batch_id", "withdrawn", "id", "attr", "hash", "text")


@query(oracle("decisions") + CUR + WAIT + " SELECT id, attr, old_value, new_value FROM w")
def p12_waiting(spark, d):
    return decisions.waiting(view(spark, d, "decisions")).select("id", "attr", "old_value", "new_value")


@query(BASE + CHECKED + """, g AS (SELECT DISTINCT id FROM chk WHERE reason IS NULL AND text IS NOT NULL AND cast(id AS bigint) % 2 = 0) SELECT DISTINCT id, attr, old_value, new_value, 'do_importu' AS status FROM b WHERE status IS NULL AND rule_id <> 'L1-LUKA-BRAK' AND id IN (SELECT id FROM g)""")
def p5_request_import(spark, d):
    ids = view(spark, d, "people").where("cast(id as bigint) % 2 = 0").select("id")
    return decisions.request_import(base(spark, d), ids, _checked(spark, d))[1]


#: A snapshot: what the shop holds for each decided cell.
SNAP = """SELECT id, attr, min(CASE event % 5 WHEN 0 THEN new_value WHEN 1 THEN upper(new_value) WHEN 2 THEN old_value WHEN 3 THEN 'other' END) AS value FROM (SELECT *, seq % 5 AS event FROM decisions) AS s GROUP BY id, attr"""
STATE = oracle("people", "decisions") + CUR + f""", snap AS (SELECT * FROM ({SNAP}) WHERE value IS NOT NULL), made AS ({MADE}), gone AS ({GONE}),
v AS (SELECT c.batch_id, c.id, c.attr, c.hash, c.new_value AS expected, s.value AS found, CASE WHEN p.id IS NULL THEN 'brak_produktu' WHEN s.value IS NULL THEN 'brak_atrybutu' WHEN {norm_sql('s.value')} = {norm_sql('c.new_value')} THEN 'weszlo' WHEN substr(sha1(s.value), 1, 12) = c.hash THEN 'bez_zmian' ELSE 'inna_wartosc' END AS state
FROM cur c JOIN made m ON m.batch_id = c.batch_id LEFT JOIN (SELECT * FROM people WHERE cast(id AS bigint) % 10 <> 0) p ON p.id = c.id LEFT JOIN snap s ON s.id = c.id AND s.attr = c.attr WHERE c.status = 'zastosowana' AND c.batch_id NOT IN (SELECT batch_id FROM gone))"""


def states(spark, d):
    log = view(spark, d, "decisions")
    snap = spark.sql(SNAP.replace("FROM decisions", "FROM {log}"), log=log).where("value is not null")
    return decisions.verify(log, _made(spark, d), spark.sql(GONE), view(spark, d, "people").where("cast(id as bigint) % 10 <> 0"), snap, F.lit("2024-02-01").cast("date"))


@query(STATE + " SELECT * FROM v")
def w1_verify(spark, d):
    return states(spark, d)


COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in decisions.STATES)


@query(STATE + f" SELECT batch_id, {COUNTS}, count(*) AS n FROM v GROUP BY batch_id")
def w2_by_batch(spark, d):
    return decisions.verified_by_batch(states(spark, d))


@query(STATE + " SELECT batch_id, id, attr, state FROM v WHERE state <> 'weszlo' ORDER BY batch_id, id, attr, hash LIMIT 200")
def w3_details(spark, d):
    return decisions.verified_details(states(spark, d)).select("batch_id", "id", "attr", "state")


@query(STATE + f" SELECT count(*) AS n, {COUNTS}, round(100.0 * count(*) FILTER (state = 'weszlo') / count(*), 1) AS effectiveness FROM v")
def w4_summary(spark, d):
    return decisions.verified_summary(states(spark, d))


@query(oracle("people", "decisions") + CUR + " SELECT c.id, c.attr, c.seq, p.name FROM cur c LEFT JOIN people p ON p.id = c.id WHERE c.status = 'odlozona' AND c.batch_id IS NULL ORDER BY c.ts DESC, c.seq DESC LIMIT 50")
def w5_decided_page(spark, d):
    return decisions.decided_page(view(spark, d, "decisions"), view(spark, d, "people"), "odlozona", False).select("id", "attr", "seq", "name")


DECIDED = oracle("people", "decisions", "findings") + CUR + f""", made AS ({MADE}), gone AS ({GONE}), ff AS (SELECT *, row_number() OVER (PARTITION BY id, attr, substr(sha1(coalesce(old_value, '')), 1, 12) ORDER BY fid) AS k, substr(sha1(coalesce(old_value, '')), 1, 12) AS hash FROM findings),
dec AS (SELECT c.*, p.name, p.producer, p.category, f.rule_id, f.severity, f.grp, m.created AS batch_created, g.batch_id IS NOT NULL AS batch_withdrawn FROM cur c LEFT JOIN people p ON p.id = c.id LEFT JOIN ff f ON f.k = 1 AND f.id = c.id AND f.attr = c.attr AND f.hash = c.hash
LEFT JOIN made m ON m.batch_id = c.batch_id LEFT JOIN gone g ON g.batch_id = m.batch_id)"""


def _decided(spark, d):
    return decisions.decided(view(spark, d, "decisions"), view(spark, d, "people"), view(spark, d, "findings"), _made(spark, d), spark.sql(GONE))


@query(DECIDED + """, s AS (SELECT * FROM dec WHERE status = 'zastosowana' AND batch_id IS NOT NULL AND (name ILIKE '%1%' OR id = '1')), w AS (SELECT * FROM dec WHERE status = 'zastosowana' AND batch_id IS NULL AND rule_id = 'L1-ZAPIS' AND category = 'MACHINERY')
SELECT 'sent' AS list, (SELECT count(*) FROM s) AS n, id, attr, seq, rule_id, severity, grp, batch_created, batch_withdrawn FROM (SELECT * FROM s ORDER BY ts DESC, seq DESC LIMIT 60 OFFSET 20)
UNION ALL SELECT 'waiting', (SELECT count(*) FROM w), id, attr, seq, rule_id, severity, grp, batch_created, batch_withdrawn FROM (SELECT * FROM w ORDER BY ts DESC, seq DESC LIMIT 60)""")
def w5_decided_list(spark, d):
    """Two lists under several filters, with finding, batch and count."""
    rows, out = tables.written(_decided(spark, d), "decided"), []
    for name, offset, filters in (("sent", 20, {"status": "zastosowana", "export": "sent", "search": "1"}), ("waiting", 0, {"export": "waiting", "rule": "L1-ZAPIS", "category": "MACHINERY"})):
        page, n = decisions.decided_list(rows, 60, offset, **filters)
        out.append(page.select(F.lit(name).alias("list"), F.lit(n.first().n).alias("n"), "id", "attr", "seq", "rule_id", "severity", "grp", "batch_created", "batch_withdrawn"))
    return out[0].unionByName(out[1])


@query(DECIDED + """, f AS (SELECT 'attr' AS dimension, attr AS value, count(*) AS n FROM dec WHERE status = 'zastosowana' AND producer = 'P3' GROUP BY attr UNION ALL SELECT 'rule', rule_id, count(*) FROM dec WHERE status = 'zastosowana' AND producer = 'P3' AND attr = 'A3' GROUP BY rule_id
UNION ALL SELECT 'category', category, count(*) FROM dec WHERE status = 'zastosowana' AND producer = 'P3' AND attr = 'A3' GROUP BY category UNION ALL SELECT * FROM (SELECT 'producer', producer, count(*) AS n FROM dec WHERE status = 'zastosowana' AND attr = 'A3' GROUP BY producer ORDER BY n DESC, producer LIMIT 40)
UNION ALL SELECT 'attr', 'A3', 0 UNION ALL SELECT 'producer', 'P3', 0) SELECT dimension, value, max(n) AS n FROM f WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2""")
def w6_decided_facets(spark, d):
    return decisions.decided_facets(_decided(spark, d), {"status": "zastosowana", "attr": "A3", "producer": "P3"})


@query(oracle("decisions") + CUR + """ SELECT count(*) AS n, count(*) FILTER (status = 'zastosowana') AS applied, count(*) FILTER (status = 'falszywy_alarm') AS false_alarms, count(*) FILTER (status = 'odlozona') AS postponed, count(batch_id) AS exported, count(*) FILTER (status = 'zastosowana' AND batch_id IS NULL) AS waiting FROM cur""")
def w6_decided_counters(spark, d):
    return decisions.decided_counters(view(spark, d, "decisions"))


@query(STATE + """, a AS (SELECT cast(ts AS date) AS day, count(*) FILTER (status = 'zastosowana') AS applied, count(*) FILTER (status = 'falszywy_alarm') AS false_alarms, count(*) FILTER (status = 'odlozona') AS postponed FROM cur GROUP BY 1),
m AS (SELECT cast(o_orderdate AS date) AS day, count(*) AS batches FROM orders GROUP BY 1), r AS (SELECT cast(l_shipdate AS date) AS day, count(*) AS requests FROM lineitem GROUP BY 1),
t AS (SELECT cast('2024-01-01' AS date) + cast(batch_id AS integer) AS day, count(*) FILTER (state = 'weszlo') AS won, count(*) AS verified FROM v GROUP BY 1)
SELECT day, coalesce(applied, 0) AS applied, coalesce(false_alarms, 0) AS false_alarms, coalesce(postponed, 0) AS postponed, coalesce(batches, 0) AS batches, coalesce(requests, 0) AS requests, coalesce(won, 0) AS won, coalesce(verified, 0) AS verified,
round(100.0 * won / nullif(verified, 0), 1) AS effectiveness FROM a FULL JOIN m USING (day) FULL JOIN r USING (day) FULL JOIN t USING (day) ORDER BY day DESC LIMIT 60""")
def t1_daily(spark, d):
    made = table(spark, d, "orders").select(F.col("o_orderdate").alias("created"))
    asked = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("created"))
    checked = states(spark, d).withColumn("checked", F.date_add(F.lit("2024-01-01").cast("date"), F.col("batch_id").cast("int")))
    return analytics.daily(view(spark, d, "decisions"), made, asked, checked, 60)


@query(STATE + f", {oracle('findings')[5:]} SELECT (SELECT count(*) FROM findings) AS findings, (SELECT count(DISTINCT id) FROM findings) AS products, (SELECT count(*) FROM cur) AS decided, (SELECT count(*) FROM cur WHERE status = 'zastosowana') AS applied, (SELECT count(batch_id) FROM cur) AS exported, (SELECT count(*) FROM v WHERE state = 'weszlo') AS won, (SELECT count(*) FROM v) AS verified")
def t2_overall(spark, d):
    return analytics.overall(view(spark, d, "findings"), view(spark, d, "decisions"), states(spark, d))


PRODUCERS = oracle("people", "findings", "decisions") + CUR + """, m AS (SELECT p.producer, count(*) AS products, any_value(f.n) AS findings, any_value(d.decided) AS decided, any_value(d.errors) AS errors, any_value(d.fa) AS false_alarms FROM people p
LEFT JOIN (SELECT producer, count(*) AS n FROM findings JOIN people USING (id) GROUP BY 1) f ON f.producer = p.producer
LEFT JOIN (SELECT producer, count(*) AS decided, count(*) FILTER (status = 'zastosowana') AS errors, count(*) FILTER (status = 'falszywy_alarm') AS fa FROM cur JOIN people USING (id) GROUP BY 1) d ON d.producer = p.producer GROUP BY p.producer),
z AS (SELECT producer, products, coalesce(findings, 0) AS findings, coalesce(decided, 0) AS decided, coalesce(errors, 0) AS errors, coalesce(false_alarms, 0) AS false_alarms FROM m)"""


@query(PRODUCERS + " SELECT *, round(errors / nullif(errors + false_alarms, 0), 3) AS precision, round(decided / nullif(findings, 0), 3) AS coverage, round(errors / products, 3) AS errors_per_product, round(findings / products, 3) AS findings_per_product FROM z")
def t3_t4_producers(spark, d):
    return analytics.producers(view(spark, d, "people"), view(spark, d, "findings"), view(spark, d, "decisions"))


@query(PRODUCERS + ", o AS (SELECT errors, coalesce(sum(errors) OVER (ORDER BY errors DESC, producer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z WHERE errors > 0) SELECT count(*) FILTER (before * 2 < (SELECT sum(errors) FROM z)) AS producers, (SELECT sum(errors) FROM z) AS errors FROM o")
def t5_half_of_errors(spark, d):
    return analytics.half_of_errors(analytics.producers(view(spark, d, "people"), view(spark, d, "findings"), view(spark, d, "decisions")))


def _hashed(spark, d):
    return view(spark, d, "findings").withColumn("hash", F.substring(F.sha1(F.coalesce("old_value", F.lit("")).cast("binary")), 1, 12))


@query(BASE + " SELECT producer, rule_id, count(*) AS findings, count(*) FILTER (status = 'zastosowana') AS errors, count(*) FILTER (status = 'falszywy_alarm') AS false_alarms FROM b GROUP BY 1, 2")
def t6_producer_rules(spark, d):
    return analytics.by_producer(_hashed(spark, d), view(spark, d, "people"), view(spark, d, "decisions"), "rule_id")


@query(oracle("findings", "decisions") + CUR + """, n AS (SELECT rule_id, count(*) AS findings, count(*) FILTER (status = 'zastosowana') AS applied, count(*) FILTER (status = 'falszywy_alarm') AS false_alarms FROM (SELECT *, substr(sha1(coalesce(old_value, '')), 1, 12) AS hash FROM findings) f LEFT JOIN (SELECT id, attr, hash, status FROM cur) c USING (id, attr, hash) GROUP BY 1),
r AS (SELECT DISTINCT rule_id FROM findings UNION ALL SELECT 'L9-NONE') SELECT r.rule_id, coalesce(findings, 0) AS findings, coalesce(applied, 0) AS applied, coalesce(false_alarms, 0) AS false_alarms, CASE WHEN applied + false_alarms >= 5 THEN round(applied / (applied + false_alarms), 3) END AS effectiveness FROM r LEFT JOIN n ON n.rule_id = r.rule_id""")
def t7_rule_catalogue(spark, d):
    rules = view(spark, d, "findings").select("rule_id").distinct().unionByName(spark.sql("SELECT 'L9-NONE' AS rule_id"))
    return analytics.rule_catalogue(rules, _hashed(spark, d), view(spark, d, "decisions"))


INCOMPLETE = oracle("products", "attrs") + """, k AS (SELECT p.id, p.producer, p.category, count(a.attr) AS n_attrs FROM products p LEFT JOIN attrs a ON a.id = p.id GROUP BY ALL), c AS (SELECT *, CASE WHEN n_attrs = 0 THEN 'pusty' WHEN n_attrs < 5 THEN 'szczatkowy' ELSE 'ok' END AS completeness FROM k)"""


def _incomplete(spark, d):
    n = view(spark, d, "products").join(view(spark, d, "attrs"), "id", "left").groupBy("id", "producer", "category").agg(F.count("attr").alias("n_attrs"))
    return n.withColumn("completeness", F.when(F.col("n_attrs") == 0, "pusty").when(F.col("n_attrs") < 5, "szczatkowy").otherwise("ok"))


@query(INCOMPLETE + " SELECT id, producer, category, n_attrs, completeness FROM c WHERE completeness <> 'ok' ORDER BY n_attrs, producer, id LIMIT 50")
def t8_s17_missing_data(spark, d):
    return analytics.missing_data(_incomplete(spark, d))


@query(INCOMPLETE + ", i AS (SELECT * FROM c WHERE completeness <> 'ok') SELECT 'completeness' AS kind, completeness AS value, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'producer', producer, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM i GROUP BY 2")
def t9_missing_counters(spark, d):
    return analytics.missing_counters(_incomplete(spark, d))


@query(oracle("findings") + " SELECT rule_id, severity, count(*) AS n, count(DISTINCT grp) AS groups, count(DISTINCT id) AS products FROM findings GROUP BY 1, 2")
def t10_report(spark, d):
    return analytics.report(view(spark, d, "findings"))


@query("SELECT o_orderkey AS run_id, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def t11_history(spark, d):
    return analytics.history(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created")))


FILTERS = "SELECT * FROM (VALUES ('ECONOMY', 'Szerokość'), ('ECONOMY', 'Styl'), ('STANDARD', 'Materiał'), ('PROMO', 'Kolor')) AS t(scope, attr)"
GAPS = "SELECT id, 'Styl' AS attr, CASE WHEN n % 2 = 0 THEN 'loft' END AS new_value FROM products WHERE n % 13 = 0"
K = oracle("products", "attrs") + f""", filters AS ({FILTERS}), gaps AS ({GAPS}), k AS (SELECT f.scope, f.attr, p.id, p.name, p.producer, a.id IS NOT NULL AS have, g.new_value FROM products p JOIN filters f ON f.scope = p.category LEFT JOIN attrs a ON a.id = p.id AND a.attr = f.attr LEFT JOIN gaps g ON g.id = p.id AND g.attr = f.attr)"""


def _k(spark, d):
    p = view(spark, d, "products").withColumn("scope", F.col("category"))
    gaps = spark.sql(GAPS.replace("FROM products", "FROM {p}"), p=p)
    return p, spark.sql(FILTERS), view(spark, d, "attrs"), gaps


@query(K + " SELECT scope, attr, count(*) AS products, count(*) FILTER (have) AS with_value, count(*) FILTER (NOT have AND new_value IS NOT NULL) AS proposals, count(*) FILTER (NOT have AND new_value IS NULL) AS without, round(count(*) FILTER (have) / count(*), 3) AS coverage FROM k GROUP BY 1, 2")
def k1_filter_coverage(spark, d):
    return analytics.filter_coverage(*_k(spark, d))


@query(K + " SELECT id, name, producer, new_value AS proposal FROM k WHERE scope = 'ECONOMY' AND attr = 'Styl' AND NOT have")
def k2_s18_lacking(spark, d):
    p, _, values, gaps = _k(spark, d)
    return analytics.lacking(p, values, gaps, "ECONOMY", "Styl")


@query(K + " SELECT producer, count(*) FILTER (NOT have) AS missing, count(*) FILTER (NOT have AND new_value IS NOT NULL) AS with_proposal, count(*) AS total FROM k WHERE scope = 'ECONOMY' AND attr = 'Styl' GROUP BY 1 HAVING count(*) FILTER (NOT have) > 0")
def k3_lacking_by_producer(spark, d):
    p, _, values, gaps = _k(spark, d)
    return analytics.lacking_by_producer(p, values, gaps, "ECONOMY", "Styl")
